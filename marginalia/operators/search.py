"""Hyper-parameter search: a stored, resumable study of trials, a seeded random sampler, and accuracy as what is sought."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import embedding, evaluate, learn
from marginalia.plans.runtime import discard, materialize
from marginalia.sources.tables import delete, read_or_empty

TRIAL = "trial int, metric string, margin double, context_size int, value double, state string, curve array<double>"


def study(spark: SparkSession, path: str, continue_existing: bool = True) -> DataFrame:
    """The trials stored at path, none where there is no study yet; an existing one is deleted unless it is to be continued."""
    if not continue_existing:
        delete(spark, path)
    return read_or_empty(spark, path, TRIAL)


def sample(trial: int, seed: int = 42, metrics: tuple[str, ...] = ("squared_euclidean", "euclidean", "manhattan"), sizes: tuple[int, ...] = tuple(range(0, 1001, 100))) -> dict:
    """Parameters of one trial: metric, a margin between 0.05 and 1.5 on a log scale, a context size. Same trial, same parameters."""
    r = random.Random(f"{seed}:{trial}")
    return {"metric": r.choice(metrics), "margin": math.exp(r.uniform(math.log(0.05), math.log(1.5))), "context_size": r.choice(sizes)}


def run(spark: SparkSession, objective: Callable[[dict], Iterator[float]], trials: int, done: DataFrame | None = None, seed: int = 42, warm_up: int = 3, path: str | None = None) -> DataFrame:
    """Trials table after ``trials`` trials; those of ``done``, or stored at path, are not run again.

    objective yields a value after each epoch. A trial is pruned when, after its
    first epoch, it is below the median of what earlier trials had at that epoch.
    With a path each trial is stored as soon as it has ended, so a search that breaks off goes on where it was.
    """
    if path and done is None:
        done = study(spark, path)
    rows = [tuple(r) for r in done.collect()] if done is not None else []  # one row a trial
    known, curves = {r[0] for r in rows}, [list(r[6] or []) for r in rows]
    for t in range(trials):
        if t in known:
            continue
        p, curve, state = sample(t, seed), [], "COMPLETE"
        for value in objective(p):
            curve.append(float(value))
            at = sorted(c[len(curve) - 1] for c in curves if len(c) >= len(curve))
            if len(curve) > 1 and len(at) >= warm_up and value < at[len(at) // 2]:
                state = "PRUNED"
                break
        curves.append(curve)
        rows.append((t, p["metric"], p["margin"], p["context_size"], curve[-1] if curve else None, state, curve))
        if path:
            spark.createDataFrame(rows[-1:], TRIAL).coalesce(1).write.mode("append").parquet(path)
    return spark.createDataFrame(rows, TRIAL)


def accuracy_objective(dataset: DataFrame, abstracts: DataFrame, epochs: int, k: int = 20, share: float = 0.9, encoder: Callable[[list[str]], np.ndarray] = embedding.hashed_trigrams, width: int = embedding.WIDTH) -> Callable[[dict], Iterator[float]]:
    """Objective of a trial: contexts cut to its size and embedded, a metric trained epoch by epoch, top-k accuracy on the rest.

    The rows up to ``share`` of the ids train. What a trial has written is deleted when it ends.
    """

    def trial(p: dict) -> Iterator[float]:
        pairs = embedding.pair(dataset, abstracts, p["context_size"]).where("context is not null and abstract is not null")
        both = embedding.encode(embedding.encode(pairs, "context", "ctx_vec", encoder), "abstract", "abs_vec", encoder)
        rows = materialize(both.select("row_id", "target_id", "ctx_vec", "abs_vec"), "trial")
        cut = int(rows.agg(F.max("row_id")).first()[0] or 0) * share
        train, test = rows.where(F.col("row_id") <= cut), rows.where(F.col("row_id") > cut)
        vectors = materialize(learn.with_vectors(learn.triplets(train), rows, width), "triplets")
        queries = test.select(F.col("row_id").alias("query"), F.col("ctx_vec").alias("vec"), F.col("abs_vec").alias("goal"))
        targets = rows.select(F.col("target_id").alias("target"), F.col("abs_vec").alias("vec"))
        log = None
        try:
            for _ in range(epochs):
                params, log = learn.train(vectors, width, 1, p["margin"], p["metric"], start=log)
                yield evaluate.topk_accuracy(queries, targets, k, p["metric"], np.exp(params), width).first()["accuracy"] or 0.0
        finally:
            discard(vectors)
            discard(rows)

    return trial
