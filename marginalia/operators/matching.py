"""References to articles: blocked by last name, compared by indel ratio, best one kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.authors import last_name, longest_segment
from marginalia.functions.similarity import lcs_ratio, may_reach
from marginalia.operators.catalogue import author_index

#: A pair matches from this ratio on: rounded half to even it is above 77.
LEAST = 77.5


def best_match(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, a: str, b: str, least: float = LEAST) -> DataFrame:
    """``(left_id, right_id, score)``: for each left row the right row of its block whose text is most alike.

    left and right hold the block key, an id and a text (a, b). A text can reach
    the ratio only if its length allows, which the JVM tests before the UDF.
    Ties go to the smallest right id. Repeated rows of one block are compared once
    for each distinct text; a hot block is split by AQE, since pairs are scored
    row by row.
    """
    texts_l = left.select(key, F.col(a).alias("__a")).where(F.col("__a").isNotNull()).distinct()
    texts_r = right.select(key, F.col(b).alias("__b"), right_id).where(F.col("__b").isNotNull())
    texts_r = texts_r.groupBy(key, "__b").agg(F.min(right_id).alias("__r"))
    pairs = texts_l.join(texts_r, key).where(may_reach(F.col("__a"), F.col("__b"), least))
    scored = pairs.withColumn("score", lcs_ratio("__a", "__b")).where(F.col("score") >= least)
    best = scored.groupBy("__a", key).agg(F.min_by(F.struct(F.col("__r").alias(right_id), "score"), F.struct(-F.col("score"), "__r")).alias("m"))
    got = left.select(left_id, key, F.col(a).alias("__a")).join(best, ["__a", key]).select(left_id, F.col(f"m.{right_id}").alias(right_id), F.col("m.score").alias("score"))
    return got.groupBy(left_id).agg(F.min_by(F.struct(right_id, "score"), F.struct(-F.col("score"), right_id)).alias("m")).select(left_id, F.col(f"m.{right_id}").alias(right_id), F.col("m.score").alias("score"))


def match_references(refs: DataFrame, catalogue: DataFrame, least: float = LEAST, parity: bool = False) -> DataFrame:
    """refs with ``target_id`` and ``score`` of the matched article, null where none reaches the ratio.

    A reference with a title is compared by it with titles; one without by the
    longest segment of its info with the articles' info. Empty text counts as none.
    """
    index = author_index(catalogue, parity)
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    keyed = refs.select("ref_id", last_name(F.col("author_ln")).alias("last_name"), blank("title").alias("title"), F.when(blank("title").isNull(), longest_segment(blank("info"))).alias("info"))
    side = index.join(catalogue.select("id", blank("title").alias("title"), blank("info").alias("info")), "id")
    by_title = best_match(keyed, side, "last_name", "ref_id", "id", "title", "title", least)
    by_info = best_match(keyed, side, "last_name", "ref_id", "id", "info", "info", least)
    both = by_title.unionByName(by_info).withColumnRenamed("id", "target_id")
    return refs.drop("target_id").join(both, "ref_id", "left")


def match_counts(matched: DataFrame) -> DataFrame:
    """One row ``(n_total, n_hits, n_no_author, n_no_text)``."""
    none = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return matched.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("target_id").isNotNull()).alias("n_hits"), F.count_if(none("author_ln")).alias("n_no_author"), F.count_if(none("title") & none("info")).alias("n_no_text"))
