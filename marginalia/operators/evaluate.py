"""Retrieval evaluation: exact nearest neighbours in blocks, top-k accuracy, popularity, blind tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions.vectors import metric_of, row_pairs, sums
from marginalia.plans.running import hash_order

#: Rows of a block of queries and of targets.
QUERY_BLOCK, TARGET_BLOCK = 2048, 8192
#: Distances are told apart to so many digits.
DIGITS = 9


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    n = len(column)
    return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _blocks(queries: DataFrame, targets: DataFrame, fn, schema: str) -> DataFrame:
    """fn on each pair of a query block and a target block. queries ``(query, vec, ..)``, targets ``(target, vec)``.

    The grid sends each target once for every QUERY_BLOCK queries, and each query once for every TARGET_BLOCK targets.
    """
    nq = max(1, -(-queries.count() // QUERY_BLOCK))
    nt = max(1, -(-targets.count() // TARGET_BLOCK))
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("query"), F.lit(nq)).cast("int")).withColumn("tb", grid(nt))
    t = targets.withColumn("tb2", F.pmod(F.xxhash64("target"), F.lit(nt)).cast("int")).withColumn("qb2", grid(nq))
    return q.groupBy("qb", "tb").cogroup(t.groupBy("qb2", "tb2")).applyInArrow(fn, schema)


def _slack(total: np.ndarray, metric: str) -> np.ndarray:
    """How far two sums before any root can be apart whose distances are equal to DIGITS digits."""
    unit = 10.0**-DIGITS
    return 2 * unit * (np.sqrt(np.maximum(total, 0)) + unit) if metric_of(metric).root else np.full(len(total), 2 * unit)


def _same_width(df: DataFrame, width: int) -> DataFrame:
    return df.where((F.size("vec") == width) & ~F.exists("vec", lambda x: x.isNull()))


def nearest(queries: DataFrame, targets: DataFrame, k: int, metric: str = "euclidean", weights: np.ndarray | None = None, width: int = 64) -> DataFrame:
    """``(query, rank, target, distance)``: the exact k nearest targets of each query, not itself.

    Vectors that are null or not of that width take no part. Ties go to the smaller
    target; with fewer than k targets there are fewer ranks; a target id of
    several rows counts once.
    """
    w = np.ones(width) if weights is None else np.asarray(weights, dtype=float)
    kind = dict(queries.dtypes)["query"]

    def fn(q: pa.Table, t: pa.Table) -> pa.Table:
        ids, names = np.asarray(q.column("query")), np.asarray(t.column("target"))
        if not len(ids) or not len(names):
            return pa.table({"query": q.column("query").slice(0, 0), "target": t.column("target").slice(0, 0), "distance": pa.array([], pa.float64())})
        order = np.argsort(names, kind="stable")
        names = names[order]
        x, y = _rows(q.column("vec")), _rows(t.column("vec"))[order]
        rough, off = sums(metric, x, y, w)
        rough[ids[:, None] == names[None, :]] = np.inf
        last = np.partition(rough, min(k, len(names)) - 1, axis=1)[:, min(k, len(names)) - 1]
        # what may be among the k nearest is measured exactly, and ties go by the target
        row, col = np.nonzero((rough <= (last + 2 * off + _slack(last, metric))[:, None]) & np.isfinite(rough))
        dist = np.concatenate([np.round(row_pairs(metric, x[row[i : i + 4096]], y[col[i : i + 4096]], w), DIGITS) for i in range(0, len(row), 4096)] or [np.zeros(0)])
        by = np.lexsort((col, dist, row))
        row, col, dist = row[by], col[by], dist[by]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return pa.table({"query": pa.array(ids[row[keep]]), "target": pa.array(names[col[keep]]), "distance": pa.array(dist[keep])})

    near = _blocks(_same_width(queries, width).dropDuplicates(["query"]), _same_width(targets, width).dropDuplicates(["target"]), fn, f"query {kind}, target {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "target"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "target", "distance")


def closer_targets(pairs: DataFrame, targets: DataFrame, metric: str = "euclidean", weights: np.ndarray | None = None, width: int = 768) -> DataFrame:
    """``(query, n_closer)``: how many targets are strictly closer to a query's vec than its own ``goal`` vector is."""
    w = np.ones(width) if weights is None else np.asarray(weights, dtype=float)

    def fn(q: pa.Table, t: pa.Table) -> pa.Table:
        if not q.num_rows or not t.num_rows:
            n = np.zeros(q.num_rows, dtype=np.int64)
        else:
            x, goal, y = _rows(q.column("vec")), _rows(q.column("goal")), _rows(t.column("vec"))
            own = np.round(row_pairs(metric, x, goal, w), DIGITS)
            rough, off = sums(metric, x, y, w)
            mine = own**2 if metric_of(metric).root else own
            off = 2 * off + _slack(mine, metric)
            n = (rough < (mine - off)[:, None]).sum(1)
            # near ties are measured exactly
            row, col = np.nonzero(np.abs(rough - mine[:, None]) <= off[:, None])
            for i in range(0, len(row), 4096):
                r, c = row[i : i + 4096], col[i : i + 4096]
                np.add.at(n, r[np.round(row_pairs(metric, x[r], y[c], w), DIGITS) < own[r]], 1)
        return pa.table({"query": q.column("query"), "n": pa.array(n.astype(np.int64))})

    good = _same_width(pairs, width).where(F.size("goal") == width)
    return _blocks(good, _same_width(targets, width).dropDuplicates(["target"]), fn, "query long, n long").groupBy("query").agg(F.sum("n").alias("n_closer"))


def topk_accuracy(pairs: DataFrame, targets: DataFrame, k: int = 20, metric: str = "euclidean", weights: np.ndarray | None = None, width: int = 768, mini_eval: int = 0) -> DataFrame:
    """One row ``(n, hits, accuracy)``: the share of queries whose goal has fewer than k strictly closer targets.

    mini_eval: only the first so many queries by their id, and their number as the divisor; 0 takes all.
    """
    if mini_eval:
        pairs = pairs.orderBy("query").limit(mini_eval)
    c = closer_targets(pairs, targets, metric, weights, width)
    return c.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_closer") < k).alias("hits"), F.avg((F.col("n_closer") < k).cast("double")).alias("accuracy"))


def target_sets(dataset: DataFrame, train: float = 0.9, key: str = "row_id") -> DataFrame:
    """``(kind, target_id)``: distinct targets of All, Train and Validation; the first part by key order of ids trains."""
    n = dataset.count()
    cut = dataset.withColumn("part", F.when(F.col(key) <= int(n * train), "Train").otherwise("Validation"))
    return cut.select(F.explode(F.array(F.lit("All"), F.col("part"))).alias("kind"), "target_id").distinct()


def popular(train: DataFrame, k: int = 20) -> DataFrame:
    """``(target_id, n)``: the k targets cited most often; ties go to the one met first."""
    counts = train.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(k).select("target_id", "n")


def popularity_score(train: DataFrame, test: DataFrame, k: int = 20) -> DataFrame:
    """One row ``(n, hits, percent)``: how many test rows cite one of the k popular targets."""
    hit = test.join(F.broadcast(popular(train, k).select("target_id", F.lit(1).alias("hit"))), "target_id", "left")  # k rows
    return hit.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"), (100.0 * F.count("hit") / F.count(F.lit(1))).alias("percent"))


def balanced_slots(contexts: DataFrame, seed: int = 42, each: int = 5) -> DataFrame:
    """``(context_no, slot, model_no, rank)``: 2 * each slots in random order, half of them each model's, ranked within it."""
    slots = contexts.select("context_no", F.explode(F.sequence(F.lit(0), F.lit(2 * each - 1))).alias("i")).withColumn("h", hash_order(seed, F.col("context_no"), F.col("i")))
    placed = slots.withColumn("slot", F.row_number().over(Window.partitionBy("context_no").orderBy("h", "i"))).withColumn("model_no", F.when(F.col("i") < each, 1).otherwise(2))
    run = Window.partitionBy("context_no", "model_no").orderBy("slot")
    return placed.select("context_no", "slot", "model_no", F.row_number().over(run).alias("rank"))


def blind_table(contexts: DataFrame, model1: DataFrame, model2: DataFrame, seed: int = 42, each: int = 5) -> DataFrame:
    """``(context_no, slot, model_no, predicted_id)``: each model's nearest, interleaved so that raters can't tell the models."""
    both = model1.withColumn("model_no", F.lit(1)).unionByName(model2.withColumn("model_no", F.lit(2)))
    near = both.select(F.col("query").alias("context_no"), "model_no", "rank", F.col("target").alias("predicted_id"))
    return balanced_slots(contexts, seed, each).join(near, ["context_no", "model_no", "rank"]).select("context_no", "slot", "model_no", "predicted_id")


def identify(vectors: DataFrame, known: DataFrame) -> DataFrame:
    """``(key, vec_id)`` of vectors ``(key, vec)`` and known ones ``(vec_id, vec)`` with equal components.

    The join is on a hash of the components, and the components themselves decide. Null vectors equal none; a vector
    known under several ids gives a row for each, a known id of several rows counts once.
    """
    hashed = lambda df: df.where(F.col("vec").isNotNull()).withColumn("h", F.xxhash64("vec"))
    k = hashed(known).dropDuplicates(["vec_id", "h"]).withColumnRenamed("vec", "known")
    return hashed(vectors).join(k, "h").where(F.col("vec") == F.col("known")).select("key", "vec_id")
