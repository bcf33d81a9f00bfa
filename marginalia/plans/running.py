"""Positions and running sums over whole tables without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hash digits that cut a hash order into cells: 65,536 cells, whose totals are the only rows of the outer window.
DIGITS = 4


def hash_order(seed: int, *keys: Column) -> Column:
    """A seeded order that other engines can reproduce: md5 of ``seed:key:key``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def running(df: DataFrame, cell: Column, order: list[Column], sums: dict[str, Column], group: list[str] | None = None) -> DataFrame:
    """df with, for each entry of sums, the total over the rows before, by (cell, order) within group.

    cell must grow with order; its totals are summed first, so the window over a
    group holds one row a cell, and the window over rows holds one cell.
    """
    group = group or []
    inner = Window.partitionBy(*group, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__cell", cell)
    totals = rows.groupBy(*group, "__cell").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    starts = totals.select(*group, "__cell", *[F.coalesce(F.sum(f"__t_{n}").over(outer), F.lit(0)).alias(f"__s_{n}") for n in sums])
    rows = rows.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"__i_{n}") for n, c in sums.items()])
    out = rows.join(starts, [*group, "__cell"])
    return out.select(*df.columns, *[(F.col(f"__i_{n}") + F.col(f"__s_{n}")).alias(n) for n in sums])


def positions(df: DataFrame, seed: int, *keys: str, name: str = "pos") -> DataFrame:
    """df with its 0-based position in seeded hash order, ties by the keys."""
    h = hash_order(seed, *[F.col(k) for k in keys])
    ordered = df.withColumn("__h", h)
    return running(ordered, F.substring("__h", 1, DIGITS), [F.col("__h"), *[F.col(k) for k in keys]], {name: F.lit(1)}).drop("__h")


def numbered(df: DataFrame, order: str, width: int = 10_000, name: str = "pos") -> DataFrame:
    """df with its 0-based position by an integer column; ``width`` values of it make a cell. Equal values have no set order."""
    return running(df, F.floor(F.col(order) / width), [F.col(order)], {name: F.lit(1)})
