"""Bibliographies to reference rows: LaTeX bibitems and BibTeX entries.

Defined results: text without a bibliography gives no rows; of a key that comes
twice in one paper the last wins (see ``merge``); an item that is neither
``[..]{key}`` nor ``{key}`` is left out; broken BibTeX entries are left out and
the rest of the file is still read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import latex
from marginalia.functions.authors import first_author_of_entry
from marginalia.operators.catalogue import last_wins

#: Levels of braces inside a group that are read as one group.
LEVELS = 12
_NEST = r"[^{}]*+"
for _ in range(LEVELS):
    _NEST = rf"[^{{}}]*+(?:\{{{_NEST}\}}[^{{}}]*+)*+"


def bibitems(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``(*keys, pos, cite_key, title, info, author_ln, target_id)`` of each item of the first bibliography.

    Items with a label are read by what follows their key: a braced author group, the marked
    fields of a bibliography tool, or free text. An e-print number in a braced item is kept as target_id.
    """
    body = F.regexp_replace(latex.remove_comments(latex.bibliography(F.col(text))), r"\\providecommand[^\n]*(?:\n|\z)", "")
    body = F.regexp_replace(F.regexp_replace(body, r"\A\\begin\{thebibliography\}", ""), r"\\end\{thebibliography\}\z", "")
    parts = F.split(body, r"\\bibitem(?![a-zA-Z])", -1)
    items = df.select(*keys, F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).alias("pos", "item")).where("item is not null")

    labelled = F.col("item").startswith("[")
    plain = F.col("item").startswith("{")
    rest = F.when(labelled, F.regexp_replace("item", r"(?s)\A\[.*?\]", "")).otherwise(F.regexp_replace(F.regexp_replace("item", r"\\newline|\\newblock", " "), "\n", " "))
    rows = items.where(labelled | plain).withColumn("rest", rest)
    rows = rows.withColumn("cite_key", F.regexp_replace(F.regexp_extract("rest", r"(?s)\A([^}]*)\}", 1), r"\{", ""))
    rows = rows.withColumn("cite_key", F.when(plain, F.trim("cite_key")).otherwise(F.col("cite_key")))
    rows = rows.withColumn("info", F.trim(F.regexp_replace("rest", r"(?s)\A[^}]*\}", "")))
    braced = labelled & F.col("info").startswith("{")
    marked = labelled & ~braced & (F.col("info").contains("\\bibfield") | F.col("info").contains("\\bibinfo"))
    group = F.regexp_extract("info", rf"(?s)\A\{{({_NEST})\}}", 1)
    surname = F.regexp_extract("info", rf"(?s)\\bibnamefont\s*\{{({_NEST})\}}", 1)
    inner = F.regexp_extract("info", r"(?s)\\BibitemOpen(.*?)(?:\\BibitemShut|\z)", 1)
    inner = F.when(inner == "", F.col("info")).otherwise(inner)
    free = latex.remove_commands(latex.without_first(F.col("info"), "url"))
    info = F.when(braced, latex.remove_commands(F.col("info"))).when(marked, latex.remove_commands(latex.without_first(latex.without_bibinfo(inner), "href"))).otherwise(free)
    author = F.when(braced, F.element_at(F.split(F.trim(group), r"\s+"), -1)).when(marked, latex.remove_commands(surname)).otherwise(first_author_of_entry(free))
    eprint = F.when(braced, F.nullif(F.regexp_extract("info", r"\\eprint\{([^}]*)\}", 1), F.lit("")))
    return rows.select(
        *keys, "pos", "cite_key", F.lit(None).cast("string").alias("title"), latex.collapse(F.regexp_replace(info, r"\\(?:textbf|textit|emph)", "")).alias("info"), F.nullif(author, F.lit("")).alias("author_ln"), eprint.alias("target_id")
    )


def _value(s: str, i: int) -> tuple[str, int]:
    """A field's value from place i: braces, quotes, bare words, joined by ``#``."""
    out = []
    while i < len(s):
        while i < len(s) and s[i].isspace():
            i += 1
        if i >= len(s):
            break
        if s[i] == "{" or s[i] == '"':
            quote, depth, j = s[i] == '"', 0, i + 1
            while j < len(s):
                c = s[j]
                if c == "\\":
                    j += 1
                elif c == "{":
                    depth += 1
                elif c == "}" and depth:
                    depth -= 1
                elif (c == '"' and quote and not depth) or (c == "}" and not quote):
                    break
                j += 1
            out.append(s[i + 1 : j])
            i = j + 1
        else:
            m = re.compile(r"[^\s,#}]+").match(s, i)
            if not m:
                break
            out.append("\x00" + m.group())
            i = m.end()
        m = re.compile(r"\s*#").match(s, i)
        if not m:
            break
        i = m.end()
    return "\x01".join(out), i


def parse_bibtex(text: str | None) -> list[tuple[str, dict[str, str]]]:
    """(key, fields) of the entries of a BibTeX file; ``@string`` names are filled in, comments and preambles left out."""
    s, names, out = text or "", {m: m for m in ()}, []
    for m in re.finditer(r"@\s*(\w+)\s*[{(]", s):
        kind, i = m.group(1).lower(), m.end()
        if kind in ("comment", "preamble"):
            continue
        key = ""
        if kind != "string":
            k = re.compile(r"\s*([^\s,{}=]+)\s*,").match(s, i)
            if not k:
                continue
            key, i = k.group(1), k.end()
        fields = {}
        while True:
            f = re.compile(r"\s*,?\s*([\w-]+)\s*=").match(s, i)
            if not f:
                break
            raw, i = _value(s, f.end())
            fields[f.group(1).lower()] = "".join(names.get(p[1:].lower(), p[1:]) if p.startswith("\x00") else p for p in raw.split("\x01"))
        if kind == "string":
            names.update({a.lower(): b for a, b in fields.items()})
        elif fields:
            out.append((key, fields))
    return out


def bibtex(df: DataFrame, text: str, keys: list[str], with_author: bool = True) -> DataFrame:
    """``(*keys, pos, cite_key, title, info, author_ln, target_id)`` of each entry with a title.

    with_author off leaves author_ln empty, for results that should not match by it.
    """
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                for pos, (key, f) in enumerate(parse_bibtex(r[-1])):
                    if f.get("title"):
                        rows.append((*r[:-1], pos, key, f["title"], f.get("author"), f.get("eprint")))
            yield pd.DataFrame(rows, columns=[*keys, "pos", "cite_key", "raw", "author", "target_id"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", pos int, cite_key string, raw string, author string, target_id string"
    rows = df.select(*keys, text).mapInPandas(run, schema)
    title = latex.collapse(latex.remove_equations(latex.remove_commands(F.col("raw"))))
    first = F.split("author", r"\s+and\s+", 2)[0]
    last = F.when(first.contains(","), F.split(first, ",", 2)[0]).otherwise(F.element_at(F.split(F.trim(first), r"\s+"), -1))
    author = latex.remove_commands(last) if with_author else F.lit(None).cast("string")
    return rows.select(*keys, "pos", "cite_key", title.alias("title"), F.lit(None).cast("string").alias("info"), F.nullif(author, F.lit("")).alias("author_ln"), "target_id")


def merge(tables: list[DataFrame], paper: str = "paper_id") -> DataFrame:
    """References of several origins, later tables over earlier ones, later places over earlier ones."""
    out = None
    for rank, t in enumerate(tables):
        t = t.withColumn("origin", F.lit(rank))
        out = t if out is None else out.unionByName(t)
    return last_wins(out, [paper, "cite_key"], ["origin", "pos"])


def item_text(key: Column, info: Column) -> Column:
    """A bibitem of a key, for building bibliographies."""
    return F.concat(F.lit("\\bibitem{"), key, F.lit("} "), info, F.lit("\n"))
