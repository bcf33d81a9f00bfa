"""Tables at rest: JSON lines in, Parquet in and out, safe replacement, audit, and paced fetching."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CATALOGUE = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "title", "authors", "update_date", "categories", "abstract", "_corrupt_record")])
AUDIT = "stage string, paper_id string, path string, reason string"


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = CATALOGUE) -> DataFrame:
    """JSON lines under a given schema; broken lines keep their text in ``_corrupt_record``."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The Parquet table at path, or an empty one of that schema where there is none; other errors are raised."""
    recover(spark, path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def delete(spark: SparkSession, path: str) -> None:
    """Delete the table at path, with what a replacement may have left beside it; a missing one is no error."""
    for s in ("", ".new", ".old"):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + s)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def recover(spark: SparkSession, path: str) -> None:
    """Finish a replacement that broke off between its two renames.

    Then there is no table at path: a new one that was written whole takes its place, else the old one comes back.
    """
    jvm = spark.sparkContext._jvm
    fresh, target, old = (jvm.org.apache.hadoop.fs.Path(path + s) for s in (".new", "", ".old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target) and fs.exists(old):
        whole = fs.exists(jvm.org.apache.hadoop.fs.Path(path + ".new/_SUCCESS"))
        fs.rename(fresh if whole else old, target)


def replace(df: DataFrame, path: str) -> None:
    """Write df and put it in the place of the table at path, which df may read from.

    The old table is deleted only when the new one is in place; ``recover`` mends a replacement that broke off.
    """
    recover(df.sparkSession, path)
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    fresh, target, old = (jvm.org.apache.hadoop.fs.Path(path + s) for s in (".new", "", ".old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(path + ".new")
    if fs.exists(target):
        fs.delete(old, True)
        if not fs.rename(target, old):
            raise OSError(f"{path} can't be moved")
    if not fs.rename(fresh, target):
        raise OSError(f"{path}.new can't be moved")
    fs.delete(old, True)


def append_audit(rows: DataFrame, path: str) -> None:
    """Add ``(stage, paper_id, path, reason)`` rows to the audit table."""
    rows.select("stage", "paper_id", "path", "reason").write.mode("append").parquet(path)


def fetch(links: DataFrame, get: Callable[[str], bytes], pause: float = 3.0) -> DataFrame:
    """``(path, content, error)`` of links ``(link, file)``, one after another with a random pause of at least ``pause`` seconds.

    get brings the network; the library has none of its own. A failure gives a row with its error and the rest goes on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for link, file in zip(b["link"], b["file"]):
                try:
                    row = (file, get(link), None)
                except Exception as e:  # noqa: BLE001
                    row = (file, None, type(e).__name__)
                yield pd.DataFrame([row], columns=["path", "content", "error"])
                time.sleep(pause + abs(random.gauss(pause, pause / 3)) if pause else 0)

    return links.select("link", "file").coalesce(1).mapInPandas(run, "path string, content binary, error string")
