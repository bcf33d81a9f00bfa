"""Embedding of texts with a pluggable encoder; each distinct text is encoded once."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 768


def hashed_trigrams(texts: list[str], width: int = WIDTH) -> np.ndarray:
    """Unit vectors of signed hashed letter trigrams; the default encoder, as no model is at hand."""
    out = np.zeros((len(texts), width), dtype=np.float32)
    for i, t in enumerate(texts):
        s = f" {t.lower()} ".encode()
        for k in range(len(s) - 2):
            h = zlib.crc32(s[k : k + 3])
            out[i, h % width] += 1 if h & 0x80000000 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def encode(df: DataFrame, column: str, to: str, encoder: Callable[[list[str]], np.ndarray] = hashed_trigrams) -> DataFrame:
    """df with the vector of a text column; null stays null, repeated texts are encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = encoder(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(v), pa.list_(pa.float32()))], names=["__text", to])

    texts = df.where(F.col(column).isNotNull()).select(F.col(column).alias("__text")).distinct()
    vectors = texts.mapInArrow(run, f"__text string, {to} array<float>")
    return df.join(vectors, df[column] == vectors["__text"], "left").drop("__text")


def pair(dataset: DataFrame, abstracts: DataFrame, context_size: int = 1000, from_end: bool = True, strict: bool = False) -> DataFrame:
    """``(row_id, source_id, target_id, context, abstract)``: contexts cut to size, with the cited abstract.

    strict fails when a cited article has no abstract; else such rows are left out.
    """
    text = F.right(F.col("context"), F.lit(context_size)) if from_end else F.left(F.col("context"), F.lit(context_size))
    if strict and dataset.join(abstracts, dataset["target_id"] == abstracts["id"], "left_anti").limit(1).count():
        raise ValueError("an article that is cited has no abstract")
    return dataset.join(abstracts.withColumnRenamed("id", "target_id"), "target_id").select("row_id", "source_id", "target_id", text.alias("context"), "abstract")


def reverse_map(embedded: DataFrame) -> DataFrame:
    """``(vec_id, kind, target_id)``, distinct: which article each vector stands for or cites."""
    c = embedded.select(F.col("ctx_id").alias("vec_id"), F.lit("context").alias("kind"), "target_id")
    return c.unionByName(embedded.select(F.col("abs_id").alias("vec_id"), F.lit("article").alias("kind"), "target_id")).distinct()
