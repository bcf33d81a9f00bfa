"""Citation contexts: where the keys of a paper's references stand in its body, and the text before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import latex, spans

LOOK_BACK, SIZE = 5000, 1000


def hits(bodies: DataFrame, refs: DataFrame, within_cites: bool = False) -> DataFrame:
    """``(paper_id, body_id, cite_key, target_id, at)``: all places of the keys in the bodies of their paper.

    By default a hit is the literal key anywhere; within_cites asks for a citation command of that key alone.
    Repeated references of one paper and key count once; bodies of one paper count each.
    """
    keys = refs.where(F.col("cite_key").isNotNull() & (F.col("cite_key") != "")).groupBy("paper_id", "cite_key").agg(F.max("target_id").alias("target_id"))
    text = bodies.where(F.col("body").isNotNull()).select("paper_id", "body_id", "body")
    needle = F.concat(F.lit("{"), F.col("cite_key"), F.lit("}")) if within_cites else F.col("cite_key")
    both = text.join(keys, "paper_id").where(F.col("body").contains(needle))
    shift = 1 if within_cites else 0
    return both.select("paper_id", "body_id", "cite_key", "target_id", "body", F.explode(spans.offsets(F.col("body"), needle)).alias("at")).withColumn("at", F.col("at") + shift)


def contexts(found: DataFrame, size: int = SIZE, look_back: int = LOOK_BACK, clean: Column | None = None) -> DataFrame:
    """``(paper_id, body_id, cite_key, target_id, at, context)``; too mathematical and empty contexts are dropped."""
    text = spans.before(F.col("body"), F.col("at"), look_back)
    text = latex.plain_context(text) if clean is None else clean
    out = found.withColumn("context", spans.tail(text, size)).drop("body")
    return out.where(~spans.too_dense(F.col("context")))


def dataset(bodies: DataFrame, refs: DataFrame, size: int = SIZE, clean: Column | None = None) -> DataFrame:
    """Distinct ``(source_id, target_id, context)`` of matched references."""
    found = hits(bodies, refs.where(F.col("target_id").isNotNull() & (F.col("target_id") != "")))
    return contexts(found, size, clean=clean).select(F.col("paper_id").alias("source_id"), "target_id", "context").distinct()


def update(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Union of existing rows and the new rows of sources that existing lacks, without repeated rows.

    Updating twice gives what updating once gives; an empty existing table gives the distinct new rows.
    """
    fresh = new.join(existing.select("source_id").distinct(), "source_id", "left_anti")
    columns = ["source_id", "target_id", "context"]
    return existing.select(*columns).unionByName(fresh.select(*columns)).distinct()


def per_paper(bodies: DataFrame, kept: DataFrame) -> DataFrame:
    """``(paper_id, n_contexts)`` for each paper that has a body, 0 where it yields none."""
    n = kept.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    return bodies.select("paper_id").distinct().join(n, "paper_id", "left").select("paper_id", F.coalesce("n", F.lit(0)).alias("n_contexts"))
