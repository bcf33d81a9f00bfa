"""Places and pieces of text as Column expressions; positions count code points from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the signs that count as mathematics.
SYMBOLS = "\\_^+-*/=()<>|0123456789"


def offsets(text: Column, key: Column) -> Column:
    """Starts of all non-overlapping places of a literal key; none for an empty or null key."""
    quoted = F.concat(F.lit("\\Q"), F.replace(key, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    before = F.slice(F.split(text, quoted, -1), 1, F.greatest(F.size(F.split(text, quoted, -1)) - 1, F.lit(0)))
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, p: F.struct((a["at"] + F.length(p) + F.length(key)).alias("at"), F.concat(a["out"], F.array(a["at"] + F.length(p))).alias("out"))
    return F.when(F.length(key) > 0, F.aggregate(before, seed, step, lambda a: a["out"])).otherwise(F.array().cast("array<int>"))


def symbols(text: Column) -> Column:
    """How many signs of a text count as mathematics."""
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def too_dense(text: Column, tenth: int = 10) -> Column:
    """True where at least one sign in ``tenth`` is mathematics; an empty text is too dense."""
    return symbols(text) * tenth >= F.length(text)


def tail(text: Column, n: int) -> Column:
    """The last n signs."""
    return F.right(text, F.lit(n)) if n > 0 else F.substring(text, 1, 0)


def head(text: Column, n: int) -> Column:
    """The first n signs."""
    return F.substring(text, 1, max(n, 0))


def before(text: Column, at: Column, n: int) -> Column:
    """The n signs before a place."""
    return F.substring(text, F.greatest(at - n, F.lit(0)) + 1, F.least(at, F.lit(n)))
