"""Queries of the training-data operators, over whole tables; SQL only where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import encoding, linkage, markup, mixing, neighbours, people, subjects, tokens
from marginalia.plans.runtime import table

_FIELDS = [("catalogue_raw", "row_id", "title"), ("catalogue_raw", "row_id", "abstract"), ("refs", "ref_id", "info")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return people.found(table(spark, d, "catalogue_raw"), table(spark, d, "refs"))


def p1_people(spark: SparkSession, d: str) -> DataFrame:
    return people.people(table(spark, d, "catalogue_raw"), table(spark, d, "refs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.found(table(spark, d, "bodies"), "body_id", "body")


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore(table(spark, d, "bodies"), "body_id", "body")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.found(table(spark, d, "embedded"))


def p3_search(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.searched(table(spark, d, "embedded"))


def _clean(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, key, column in _FIELDS:
        one = markup.clean(table(spark, d, name), [key], column).select(F.lit(column).alias("field"), F.col(key).alias("rec_id"), "has_markup", "kinds", "clean", "residue")
        out = one if out is None else out.unionByName(one)
    return out


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).where("residue").select("field", "rec_id")


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return linkage.found(table(spark, d, "refs"), table(spark, d, "catalogue"))


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link(table(spark, d, "refs"), table(spark, d, "catalogue"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_column(table(spark, d, "documents"), "doc_id", "text")


def p7_decode(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode_column(p7_ids(spark, d), "doc_id")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, d, "documents"), targets), targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.found(table(spark, d, "documents"), table(spark, d, "subjects"), table(spark, d, "subject_labels"))


def p9_posteriors(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects(table(spark, d, "documents"), table(spark, d, "subjects"), table(spark, d, "subject_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_people, p2_found, p2_restored, p3_found, p3_search, p5_found, p5_clean, p6_found, p6_links, p7_ids, p7_decode, p8_mix, p8_shares, p9_found, p9_posteriors)
}

ORACLES: dict[str, str] = {"p7_decode": "select doc_id, coalesce(text, '') as text from documents"}
