"""Source archives: landed tar files to member rows, with an audit of what could not be read."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER = "paper_id string, path string, content binary, error string"
#: Bytes up to which a member is unpacked, unless told otherwise; a larger one is named in the audit.
MAX_MEMBER = 64 << 20


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, content)`` of the files in a folder that end in ``.tar``, whatever the case."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][aA][rR]").load(folder).select("path", "content")


def untar(archives: DataFrame, max_member: int = MAX_MEMBER) -> DataFrame:
    """``(paper_id, path, content, error)``: one row a member; an unreadable archive gives one row with its error.

    Members are read in memory; links, devices and paths that leave the archive are
    left out, and a member above max_member bytes gives an error row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                paper = path.rsplit("/", 1)[-1][:-4]
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(content or b"")) as t:
                        for m in t:
                            parts = m.name.split("/")
                            if not m.isfile() or m.name.startswith("/") or ".." in parts or parts[-1] == ".DS_Store":
                                continue
                            if m.size > max_member:
                                rows.append((paper, m.name, None, "too large"))
                            else:
                                rows.append((paper, "/".join(p for p in parts if p not in ("", ".")), t.extractfile(m).read(), None))
                except (tarfile.TarError, OSError, EOFError) as e:
                    rows.append((paper, None, None, type(e).__name__))
                yield pd.DataFrame(rows, columns=["paper_id", "path", "content", "error"])

    return archives.select("path", "content").mapInPandas(run, MEMBER)


def failures(members: DataFrame) -> DataFrame:
    """``(stage, paper_id, path, reason)`` rows for the audit table."""
    return members.where("error is not null").select(F.lit("untar").alias("stage"), "paper_id", "path", F.col("error").alias("reason"))


def members_of(unpacked: DataFrame) -> DataFrame:
    """The readable members."""
    return unpacked.where("error is null").select("paper_id", "path", "content")
