"""LaTeX projects to one text each: main file, inlined inputs, split and isolated citations.

A project is the rows ``(paper_id, path, content)`` of its members. One project
is one group: its size is that of a source archive, not of the corpus.
"""

from __future__ import annotations

import posixpath
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import latex

#: Inputs that may be open inside each other, unless told otherwise; deeper ones are named in the audit.
MAX_DEPTH = 20
_MAIN = r"(?m)^(?:[^%\n]|(?<=\\)%)*\\document(?:class|style)\b"
_INPUT = re.compile(r"\\(?:input|include)\s*\{([^}]*)\}")


def decoded(content: Column) -> Column:
    """Bytes as ISO-8859-1 text with line feeds."""
    return F.regexp_replace(F.decode(content, "ISO-8859-1"), r"\r\n?", "\n")


def source_files(members: DataFrame) -> DataFrame:
    """Members that are TeX, BibTeX or compiled bibliographies, whatever the case of their ending."""
    return members.where(F.lower("path").rlike(r"\.(tex|bib|bbl)$"))


def dropped_files(members: DataFrame) -> DataFrame:
    """``(paper_id, paths)``: what source_files leaves out, for the audit."""
    return members.where(~F.lower("path").rlike(r"\.(tex|bib|bbl)$")).groupBy("paper_id").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def is_main(path: Column, text: Column) -> Column:
    """A TeX file at the root that declares a document class outside comments."""
    return F.lower(path).endswith(".tex") & ~path.contains("/") & text.rlike(_MAIN)


def main_files(files: DataFrame) -> DataFrame:
    """``(paper_id, path)`` of papers that have exactly one main file."""
    mains = files.where(is_main(F.col("path"), F.col("text"))).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    return mains.where("n = 1").select("paper_id", "path")


def audit_mains(files: DataFrame) -> DataFrame:
    """``(paper_id, n_mains, kept)`` of every paper."""
    return files.groupBy("paper_id").agg(F.count_if(is_main(F.col("path"), F.col("text"))).alias("n_mains")).withColumn("kept", F.col("n_mains") == 1)


def inline(main: str, files: dict[str, str], max_depth: int = MAX_DEPTH, deeper: set[str] | None = None) -> str:
    """Text of main with its inputs put in, depth first; a missing file or one that is open already leaves nothing.

    An input below max_depth open ones is left out, and its path is added to deeper.
    """

    def fill(path: str, opened: frozenset[str]) -> str:
        def one(m: re.Match) -> str:
            name = m.group(1).strip().replace("\\", "/")
            name = name if re.search(r"\.(tex|bbl|bib)$", name, re.I) else name + ".tex"
            for p in (posixpath.normpath(name), posixpath.normpath(posixpath.join(posixpath.dirname(path), name))):
                if p in files and p not in opened:
                    if len(opened) < max_depth:
                        return fill(p, opened | {p})
                    if deeper is not None:
                        deeper.add(p)
            return ""

        return _INPUT.sub(one, files[path])

    return fill(main, frozenset([main]))


def bodies(files: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``(paper_id, body)``: comments removed, inputs inlined, one citation for each key on a line of its own."""
    text = _inlined(files, max_depth)
    return text.select("paper_id", latex.isolate_cites(latex.split_cites(F.col("body"))).alias("body"))


def too_deep(files: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``(stage, paper_id, path, reason)``: inputs that lie too deep to be put in, for the audit."""
    rows = _inlined(files, max_depth).select(F.lit("inline").alias("stage"), "paper_id", F.explode("deeper").alias("path"))
    return rows.withColumn("reason", F.lit("too deep"))


def _inlined(files: DataFrame, max_depth: int) -> DataFrame:
    clean = files.select("paper_id", "path", latex.remove_comments(F.col("text")).alias("text"))
    mains = main_files(files).withColumnRenamed("path", "main")
    grouped = clean.join(mains, "paper_id").groupBy("paper_id")

    def one(g: pd.DataFrame) -> pd.DataFrame:
        texts = {posixpath.normpath(p): t or "" for p, t in zip(g["path"], g["text"])}
        deeper: set[str] = set()
        body = inline(posixpath.normpath(g["main"].iloc[0]), texts, max_depth, deeper)
        return pd.DataFrame({"paper_id": [g["paper_id"].iloc[0]], "body": [body], "deeper": [sorted(deeper)]})

    return grouped.applyInPandas(one, "paper_id string, body string, deeper array<string>")
