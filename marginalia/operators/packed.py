"""Several values packed in one field: one row per value, with its place.

Method: the field is split on quote characters. Odd pieces are quoted literals,
even pieces are split on delimiters, and array folds put values back together
with their ordinals. Everything stays in JVM expressions.

Defined results:
* null, empty and blank fields give no row; an empty place between delimiters
  is no value and takes no ordinal;
* a quote only opens a literal at the start of a value, so inner quotes
  (``Oliver "Ollie" Habubrox``) belong to the value; a doubled quote in a
  literal is one quote; an unclosed quote is an ordinary sign;
* ties and repeated rows are kept: the operator is a per-row map;
* extra columns of the input are carried along only if named in ``keys``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks put in place of delimiters in unquoted text. Control signs that no field holds; any there are blanked first.
STRONG, WEAK, QUOTE = "\x01", "\x02", "\x03"

#: Particles that belong to a last name.
PARTICLES = ["van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "ter", "ten", "zu", "zum", "zur", "af", "av", "al", "el", "bin", "ben"]

_PARTICLE = "(?i:" + "|".join(PARTICLES) + ")"
#: A last name alone: particles and one word without a dot.
_BARE = rf"^(?:{_PARTICLE}\s+)*[^\s.]+$"
#: Given names alone: initials, abbreviations or one given name, at most with initials.
_GIVEN = r"^(?:\p{Lu}\.?(?:[\s-]*\p{Lu}\.)*|\p{Lu}[^\s.]*\.?(?:[\s-]+\p{Lu}\.)*(?:\s+\p{Lu})?)$"


def _quoted(field: Column, apostrophes: bool) -> Column:
    """Opening and closing quotes of values become QUOTE; other quotes stay as they are."""
    out = field
    edge_r = r"(?=\s*(?:$|[\];,|/&\n\r(]|and\b))"
    for q in ['"', "'"] if apostrophes else ['"']:
        # a literal: quote at a value's start, then text in which the quote is doubled or inner, then quote at a value's end
        # (an apostrophe between letters is no quote)
        inner = r"(?<=\p{L})'(?=\p{L})|" if q == "'" else ""
        lit = rf"(?:^|(?<=[\[;,|/&\n\r])|(?<=\band))(\s*){q}((?:{inner}{q}{q}|[^{q}])*+){q}{edge_r}"
        out = F.regexp_replace(out, lit, f"$1{QUOTE}$2{QUOTE}")
    return out


def split_packed(field: Column, kind: str = "names") -> Column:
    """Array of the values of a packed field, in order. kind: ``names`` or ``codes``."""
    names = kind == "names"
    s = F.regexp_replace(field, "[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    s = F.regexp_replace(s, r"^\s*\[(.*)\]\s*$", "$1") if not names else F.regexp_replace(s, r"(?s)^\s*\[(.*)\]\s*$", "$1")
    if names:
        s = F.regexp_replace(s, r"\r\n?", "\n")
    s = _quoted(s, apostrophes=True)
    pieces = F.split(s, QUOTE, -1)

    def delimit(p: Column) -> Column:
        if names:
            p = F.regexp_replace(p, r"\s*\([^()]*\)", " ")
            p = F.regexp_replace(p, r"\n(?=\S)", STRONG)
            p = F.regexp_replace(p, r"\s+(?i:and)(?=\s|$)|^(?i:and)(?=\s)|[;|&/]", STRONG)
            return F.regexp_replace(p, ",", WEAK)
        p = F.regexp_replace(p, "[;|,/]", STRONG)
        # blanks part codes (which hold a dot or a hyphen); plain words next to one another are one value
        code = r"[^\s\x01.-]*[.-][^\s\x01]*"
        return F.regexp_replace(p, rf"(?<=^|[\s\x01])({code})\s+(?=[^\s\x01])|\s+(?={code}(?:[\s\x01]|$))", f"$1{STRONG}")

    n = F.size(pieces)
    marked = F.transform(
        pieces,
        lambda p, i: F.when(i % 2 == 1, F.concat(F.lit(QUOTE), F.regexp_replace(F.regexp_replace(p, '""', '"'), "''", "'"), F.lit(QUOTE))).otherwise(delimit(p)),
    )
    joined = F.array_join(marked, "")
    groups = F.split(joined, STRONG, -1)
    clean = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    if not names:
        values = F.transform(groups, lambda g: clean(F.regexp_replace(g, QUOTE, "")))
        return F.filter(values, lambda v: v != "")

    def parts(g: Column) -> Column:
        """Weak places of one group, with ``Last, First`` put together again by a fold."""
        bits = F.filter(F.transform(F.split(g, WEAK, -1), clean), lambda b: b != "")
        empty = F.array().cast("array<string>")

        def step(acc: Column, b: Column) -> Column:
            last = F.element_at(acc, -1)
            # QUOTE marks keep a quoted value from being taken for half a name; a joined name holds a comma and is not bare
            pair = (F.size(acc) > 0) & F.coalesce(last.rlike("(?U)" + _BARE), F.lit(False)) & ~F.coalesce(last.contains(QUOTE), F.lit(False)) & b.rlike("(?U)" + _GIVEN) & ~b.contains(QUOTE)
            # element_at of an empty array fails in ANSI mode, so the last value is read by slice
            return F.when(pair, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit(", "), b)))).otherwise(F.concat(acc, F.array(b)))

        def safe(acc: Column, b: Column) -> Column:
            return F.when(F.size(acc) == 0, F.array(b)).otherwise(step(acc, b))

        return F.aggregate(bits, empty, safe)

    values = F.flatten(F.transform(groups, parts))
    values = F.transform(values, lambda v: F.regexp_replace(v, QUOTE, ""))
    values = F.transform(values, lambda v: F.regexp_replace(v, r"\s*\([^()]*\)\s*$", ""))
    values = F.transform(values, lambda v: F.trim(F.regexp_replace(v, r"(?:^|\s+)et\.?\s+al\b\.?$", "")))
    return F.filter(values, lambda v: (v != "") & ~v.rlike(r"^[.,;]+$"))


def explode_packed(df: DataFrame, keys: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """One row ``(*keys, field, pos, item)`` per value of each field; fields maps a column to its kind."""
    arrays = df.select(*keys, *[split_packed(F.col(f), kind).alias(f"__{f}") for f, kind in fields.items()])
    out = None
    for f in fields:
        one = arrays.select(*keys, F.lit(f).alias("field"), F.posexplode(f"__{f}").alias("pos", "item"))
        one = one.withColumn("pos", (F.col("pos") + 1).cast("int"))
        out = one if out is None else out.unionByName(one)
    return out
