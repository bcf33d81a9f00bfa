"""Mixing sources to target weights: one corpus whose sizes by source meet target shares.

Method: a low-discrepancy source schedule. The points frac(k * golden ratio) run
through the cumulative weights, which names a source for slot k; slots are
ranked within their source, and slot r of a source takes its block r. Blocks are
runs of about ``BLOCK`` tokens of the source's documents in shuffled order, each
pass over a repeated source shuffled anew.

The total is the largest at which no source has to repeat beyond its cap: the
least of tokens * cap / share. Each source gives whole documents up to the
document boundary nearest its quota, so it is off by half a document at most.

A source may hold any part of the rows: running sums and ranks are taken in two
levels (within ranges of the shuffled order, then over the sums of the ranges),
so no task sees a whole source.

Defined results: documents without tokens (null, empty) take no part; a listed
source without tokens, or with a null or non-positive share or cap, gives
nothing and the other shares are scaled to one; sources that are not listed have
share 0; repeated documents count each; without any usable source the corpus is
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marginalia.llm.tokens import count_tokens
from marginalia.plans.running import running
from marginalia.plans.runtime import materialize

BLOCK = 2048
#: Rows of a range in the two-level running sums.
RANGE = 50_000
GOLDEN = 0.6180339887498949
SEED = 17


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, share, cap, have, docs, quota)`` of each usable source; as many rows as targets has."""
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.count(F.lit(1)).alias("docs"))
    t = targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0)).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").cast("long").alias("cap"))
    use = t.join(have, "source")
    everything = Window.partitionBy(F.lit(1))
    use = use.withColumn("share", F.col("target_share") / F.sum("target_share").over(everything))
    return use.withColumn("quota", F.floor(F.min(F.col("have") * F.col("cap") / F.col("share")).over(everything) * F.col("share"))).select("source", "share", "cap", "have", "docs", "quota")


def mix(docs: DataFrame, targets: DataFrame, path: str | None = None, seed: int = SEED) -> DataFrame:
    """``(slot, place, source, doc_id, copy, n_tokens)``: the corpus in order of (slot, place)."""
    sized = materialize(count_tokens(docs, "doc_id", "text", ("source",), path).where(F.col("n_tokens") > 0), "sized")
    # targets is a table of sources, not of documents: its plan is small whatever the corpus
    quota = materialize(plan(sized, targets), "plan")
    rows = sized.join(F.broadcast(quota) if quota.count() <= 10_000 else quota, "source")
    passes = F.least(F.col("cap"), F.floor(F.col("quota") / F.col("have")) + 1)
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), passes)))
    copies = copies.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "copy"))
    ranges = F.greatest(F.lit(1), F.ceil(F.col("docs") / RANGE))
    # shuffled order within a pass: pass first, then the hash; the cell is the pass and the hash's range
    share = (F.col("h") / F.lit(2.0**64)) + 0.5
    cell = F.col("copy") * 1_000_000 + F.least(F.floor(share * ranges), ranges - 1)
    placed = running(copies, cell, [F.col("h"), F.col("doc_id")], {"__before": F.col("n_tokens")}, ["source"])
    kept = placed.where(F.col("__before") + F.col("n_tokens") / 2 <= F.col("quota"))
    kept = kept.withColumn("block", F.floor(F.col("__before") / BLOCK)).select("source", "block", F.col("__before").alias("place"), "doc_id", "copy", "n_tokens")

    slots = schedule(quota)
    # blocks beyond a source's last slot follow behind the schedule, in turns, so that no slot has two sources
    sources = quota.select("source", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("source")).alias("turn"))
    last = sources.join(slots.groupBy("source").agg((F.max("block") + 1).alias("n")), "source", "left")
    turns, total = quota.agg(F.count(F.lit(1)), F.coalesce(F.sum("quota"), F.lit(0))).first()
    out = kept.join(slots, ["source", "block"], "left").join(F.broadcast(last) if turns <= 10_000 else last, "source", "left")
    late = -(-int(total) // BLOCK) + (F.col("block") - F.coalesce("n", F.lit(0))) * turns + F.col("turn") - 1
    return out.select(F.coalesce("slot", late).cast("long").alias("slot"), "place", "source", "doc_id", "copy", "n_tokens")


def schedule(quota: DataFrame) -> DataFrame:
    """``(slot, source, block)``: slot k belongs to the source in whose weight interval frac(k * golden ratio) falls."""
    spark = quota.sparkSession
    parts = quota.orderBy("source").select("source", "share", "quota").collect()  # one row a source of targets
    total = sum(r["quota"] for r in parts)
    n = -(-total // BLOCK) if parts else 0
    bounds, acc = [], 0.0
    for r in parts:
        bounds.append((r["source"], acc, acc + r["share"]))
        acc += r["share"]
    if not n:
        return spark.createDataFrame([], "slot long, source string, block long")
    point = (F.col("slot") * F.lit(GOLDEN)) % 1.0
    # the bounds are one list, and the source is the first whose interval ends beyond the point
    passed = F.size(F.filter(F.lit([high for _, _, high in bounds[:-1]]) if len(bounds) > 1 else F.array().cast("array<double>"), lambda high: high <= point))
    source = F.get(F.lit([name for name, _, _ in bounds]), passed)
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("source", source)
    ranked = running(slots, F.floor(F.col("slot") / RANGE), [F.col("slot")], {"block": F.lit(1)}, ["source"])
    return ranked.select("slot", "source", F.col("block").cast("long").alias("block"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, tokens, documents, most_copies, actual_share, off)`` for each listed source."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copy").alias("most_copies"))
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    zero = F.lit(0).cast(T.LongType())
    out = t.join(got, "source", "left").withColumn("actual_share", F.coalesce(F.col("tokens") / total, F.lit(0.0)))
    return out.select("source", "target_share", F.coalesce("tokens", zero).alias("tokens"), F.coalesce("documents", zero).alias("documents"), F.coalesce("most_copies", zero).alias("most_copies"), "actual_share", F.abs(F.col("actual_share") - F.col("target_share")).alias("off"))
