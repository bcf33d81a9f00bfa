"""Article catalogue: category filter, clean records, last record of an id, abstracts, shuffles and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import latex
from marginalia.plans.running import positions


def in_categories(df: DataFrame, categories: list[str], column: str = "categories") -> DataFrame:
    """Rows that hold any of the categories as a substring; no categories keep all rows, null holds none."""
    if not categories:
        return df
    return df.where(reduce(lambda a, b: a | b, [F.col(column).contains(c) for c in categories]))


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last by order; one shuffle, combined before it."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def clean_records(raw: DataFrame) -> DataFrame:
    """``(id, info, title, authors)``; null parts count as empty.

    info is authors, title and date; its title keeps equations, the title column does not.
    """
    authors = latex.collapse(latex.remove_commands(F.coalesce("authors", F.lit(""))))
    title = latex.remove_commands(F.coalesce("title", F.lit("")))
    info = F.concat_ws(". ", authors, latex.collapse(title), F.coalesce("update_date", F.lit("")))
    return raw.select("id", info.alias("info"), latex.collapse(latex.remove_equations(title)).alias("title"), authors.alias("authors"))


def build(raw: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Clean catalogue: filtered, the last record of an id, cleaned."""
    return clean_records(last_wins(in_categories(raw, categories or []), ["id"], ["loaded_at", "row_id"]))


def abstracts(raw: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """``(id, abstract)`` of the last record of each id, as plain text."""
    return last_wins(in_categories(raw, categories or []), ["id"], ["loaded_at", "row_id"]).select("id", latex.plain_context(F.col("abstract")).alias("abstract"))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """df with ``pos``, its place in a seeded order."""
    return positions(df, seed, key)


def windows(df: DataFrame, start: int, end: int, size: int) -> DataFrame:
    """Rows with start <= pos < end and the ``round`` of size rows each falls into; the last may be shorter."""
    return df.where((F.col("pos") >= start) & (F.col("pos") < end)).withColumn("round", F.floor((F.col("pos") - start) / size))


def rounds(start: int, end: int, size: int) -> int:
    """How many rounds a range takes."""
    return max(0, -(-(end - start) // size))


def file_id(article: Column) -> Column:
    """Id as it stands in file names."""
    return F.replace(article, F.lit("/"), F.lit("_slash"))


def article_id(file: Column) -> Column:
    """Id from a file name."""
    return F.replace(file, F.lit("_slash"), F.lit("/"))


def source_links(ids: DataFrame, base: str) -> DataFrame:
    """``(id, link, file)`` of the source archives of articles."""
    return ids.select("id", F.concat(F.lit(base), F.col("id")).alias("link"), F.concat(file_id(F.col("id")), F.lit(".tar")).alias("file"))


def author_index(catalogue: DataFrame, parity: bool = False) -> DataFrame:
    """``(last_name, id)``, distinct: which articles have an author of that last name."""
    from marginalia.functions.authors import author_list, last_name

    names = catalogue.where(F.col("authors").isNotNull()).select("id", F.explode(author_list(F.col("authors"), parity)).alias("author"))
    return names.select(last_name(F.col("author")).alias("last_name"), "id").where(F.col("last_name") != "").distinct()
