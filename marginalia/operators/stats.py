"""Statistics of experiments: signed-rank test, running means, weight traces, trial tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.plans.running import running

# The paired scores of the blind test, thirty contexts, of five each.
PAIRED_SCORES = [(4, 3), (2, 2), (0, 0), (1, 1), (4, 2), (2, 3), (3, 3), (1, 0), (2, 1), (0, 0), (4, 3), (0, 0), (3, 2), (1, 1), (0, 2), (1, 0), (0, 0), (5, 5), (0, 0), (3, 3), (4, 2), (3, 2), (1, 1), (5, 5), (5, 4), (2, 2), (2, 2), (0, 0), (3, 3), (2, 2)]


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """One row ``(n, w_plus, w_minus, ties)`` of ``(x, y)``: zero differences drop out, equal sizes share their mean rank.

    Ranks come from the counts of the distinct sizes, summed in two levels, so no task sees all sizes: a cell
    is a 256th of an octave.
    ties is the sum of t^3 - t over the groups of equal sizes. Null on either side drops the row.
    """
    d = pairs.select((F.col("x") - F.col("y")).cast("double").alias("d")).where("d <> 0")
    sizes = d.groupBy(F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = running(sizes, F.floor(256 * F.log2("size")), [F.col("size")], {"below": F.col("t")}).withColumn("rank", F.col("below") + (F.col("t") + 1) / 2)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ranked.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("n"), zero(F.sum(F.col("rank") * F.col("up"))).alias("w_plus"), zero(F.sum(F.col("rank") * (F.col("t") - F.col("up")))).alias("w_minus"),
        zero(F.sum(F.pow("t", F.lit(3.0)) - F.col("t"))).alias("ties"),
    )


def wilcoxon(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row ``(n, w_plus, w_minus, statistic, p_value, significant)``, two-sided, by the normal approximation with ties.

    p is 1 where no difference is left.
    """
    r = signed_ranks(pairs).first()
    n, spread = r["n"], (r["n"] * (r["n"] + 1) * (2 * r["n"] + 1) - r["ties"] / 2) / 24
    t = min(r["w_plus"], r["w_minus"])
    p = math.erfc(abs(t - n * (n + 1) / 4) / math.sqrt(2 * spread)) if spread > 0 else 1.0
    return pairs.sparkSession.createDataFrame([(n, r["w_plus"], r["w_minus"], t, p, p < alpha)], "n long, w_plus double, w_minus double, statistic double, p_value double, significant boolean")


def prefix_mean(series: DataFrame, order: str, value: str, cell) -> DataFrame:
    """``(order, prefix_mean)``: mean of all values up to each row; cell grows with order and cuts it into ranges."""
    out = running(series.select(order, value).where(F.col(value).isNotNull()), cell, [F.col(order)], {"__s": F.col(value), "__n": F.lit(1)})
    return out.select(order, ((F.col("__s") + F.col(value)).cast("double") / (F.col("__n") + 1)).alias("prefix_mean"))


def file_stamp(at: Column) -> Column:
    """A time as it stands in file names."""
    return F.date_format(at, "yyyyMMdd-HHmmss")


def elapsed(seconds: Column) -> Column:
    """Seconds as ``HH:MM:SS``; hours may have more digits."""
    s = F.floor(seconds)
    return F.concat_ws(":", F.lpad(F.floor(s / 3600).cast("string"), 2, "0"), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"), F.lpad((s % 60).cast("string"), 2, "0"))


def weight_trace(log: DataFrame, vector: str, dims: list[int], key: str) -> DataFrame:
    """``(key, dim, weight)`` of some components of each row's vector."""
    return log.select(key, F.posexplode(vector).alias("dim", "weight")).where(F.col("dim").isin(dims))


def best_trials(trials: DataFrame) -> DataFrame:
    """``(metric, trial, value, n_trials, n_pruned)``: the best finished trial of each metric; ties go to the earliest."""
    done = F.when(F.col("state") == "COMPLETE", F.struct(F.col("value"), -F.col("trial")))
    best = trials.groupBy("metric").agg(F.max(done).alias("b"), F.count(F.lit(1)).alias("n_trials"), F.count_if(F.col("state") == "PRUNED").alias("n_pruned"))
    return best.select("metric", (-F.col("b")[f"col2"]).alias("trial"), F.col("b.value").alias("value"), "n_trials", "n_pruned")


def history(trials: DataFrame) -> DataFrame:
    """``(trial, value, best_so_far)`` of finished trials; a study has few trials, so one window holds them."""
    order = Window.orderBy("trial").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return trials.where("state = 'COMPLETE'").select("trial", "value", F.max("value").over(order).alias("best_so_far"))


def importance(trials: DataFrame, parameters: list[str]) -> DataFrame:
    """``(parameter, importance)``: squared rank correlation of a parameter with the value, scaled to sum to 1."""
    ranked = trials.where("state = 'COMPLETE'").select(*[F.rank().over(Window.orderBy(c)).cast("double").alias(c) for c in [*parameters, "value"]])
    got = ranked.agg(*[F.coalesce(F.pow(F.corr(p, "value"), F.lit(2.0)), F.lit(0.0)).alias(p) for p in parameters])
    rows = got.select(F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).alias("importance")) for p in parameters])).alias("r")).select("r.*")
    total = F.sum("importance").over(Window.partitionBy(F.lit(1)))
    return rows.select("parameter", F.when(total > 0, F.col("importance") / total).otherwise(0.0).alias("importance"))
