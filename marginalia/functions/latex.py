"""LaTeX text functions as Column expressions. Null in gives null out; empty stays empty.

Equations are spans ``$..$`` and ``$$..$$``; an escaped ``\\$`` opens none, and an
unterminated equation reaches to the end of the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EQUATION = r"(?<!\\)\$\$(?s:.*?)(?:\$\$|\z)|(?<!\\)\$[^$]+(?:\$|\z)"
# the signs at which a command name ends
_BREAK = r" {}\"'´`\\_^"
_ANY_BREAK = rf"[^{_BREAK}]*"
CITES = ["cite", "footcite", "citep", "citet"]
_CITE = r"\\(?:cite|footcite|citep|citet)\{[^}\n]*\}"
ENVIRONMENTS = ["figure", "equation", "equation*", "align", "align*", "gather", "gather*"]


def collapse(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def remove_equations(text: Column, to: str = "") -> Column:
    """Equations cut out (or replaced by ``to``); a lone dollar sign at the end stays."""
    return F.regexp_replace(text, _EQUATION, to)


def remove_comments(text: Column) -> Column:
    """Comment environments and everything from an unescaped percent sign to the line's end; line ends stay."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)\\begin\{comment\}.*?\\end\{comment\}", ""), r"(?d)(?<!\\)%.*", "")


def remove_commands(text: Column) -> Column:
    """Commands cut from text outside equations.

    A command in front of a blank or a quote goes with that sign, in front of a
    brace it goes alone, in front of another command or of a sub- or superscript
    only its backslash goes; one that reaches the end goes whole. Then all braces
    go, and quotes and accents before all else.
    """
    t = F.regexp_replace(F.regexp_replace(text, r"et~al\.|\n", " "), "['`´]", "")
    t = F.regexp_replace(t, rf"({_EQUATION})|\\(?:({_ANY_BREAK})(?=[\\}}_^])|{_ANY_BREAK}(?:[ \"]|(?=\{{)|\z))", "$1$2")
    return F.trim(F.regexp_replace(t, r"[{}]", ""))


def plain_context(text: Column) -> Column:
    """Text of a citation's surroundings: without citations, labels, floats, equations and commands, on one line."""
    t = F.regexp_replace(text, r"\\(?:citep|citet|cite|footcite|label|ref)\{.*?\}", "")
    for env in ENVIRONMENTS:
        name = env.replace("*", r"\*")
        t = F.regexp_replace(t, rf"(?s)\\begin\{{{name}\}}.*?\\end\{{{name}\}}", "")
    t = remove_equations(t, " ")
    t = F.regexp_replace(t, r"\\(?=['`´])|\\\z", "")
    t = F.regexp_replace(t, rf"\\(?:({_ANY_BREAK})(?=[\\}}_^])|{_ANY_BREAK}(?=[ {{\"'´`]|\z))", "$1")
    return collapse(F.regexp_replace(t, r"[{}]", ""))


def isolate_cites(text: Column) -> Column:
    """Each citation command on a line of its own."""
    return F.regexp_replace(text, f"({_CITE})", "\n$1\n")


def split_cites(text: Column) -> Column:
    """Citations of several keys to one citation for each key; keys are stripped.

    The text is cut around the commands, the commands are rewritten key by key,
    and the two lists are put together again.
    """
    found = F.regexp_extract_all(text, F.lit(f"({_CITE})"), 1)
    between = F.split(text, _CITE, -1)

    def spread(c: Column) -> Column:
        name = F.regexp_extract(c, r"^(\\\w+)\{", 1)
        keys = F.split(F.regexp_extract(c, r"\{([^}\n]*)\}", 1), ",", -1)
        return F.array_join(F.transform(keys, lambda k: F.concat(name, F.lit("{"), F.trim(k), F.lit("}"))), " ")

    return F.array_join(F.zip_with(between, F.transform(found, spread), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


_BIB = r"(?s)\\begin\{thebibliography\}.*?\\end\{thebibliography\}"


def bibliography(text: Column) -> Column:
    """The first bibliography of a text with its begin and end; ``''`` without one."""
    return F.regexp_extract(text, f"({_BIB})", 1)


def without_bibliography(text: Column) -> Column:
    """Text without its first bibliography; a text without one stays as it is."""
    bib = bibliography(text)
    at = F.locate("\\begin{thebibliography}", text)
    return F.when(bib == "", text).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(bib), F.length(text))))


def without_first(text: Column, command: str) -> Column:
    """Text without the first ``\\command{..}``, up to the next closing brace."""
    return F.regexp_replace(text, rf"(?s)\A(.*?)\\{command}\{{[^}}]*\}}", "$1")


def without_bibinfo(text: Column) -> Column:
    """Text without the heads of ``\\bibinfo{..}`` and ``\\bibfield{..}``."""
    return F.regexp_replace(text, r"(?s)\\bib(?:info|field)[^}]*\}", "")


def input_path(name: Column) -> Column:
    """Path that ``\\input{name}`` means: forward slashes, with an ending."""
    p = F.regexp_replace(F.trim(name), r"\\", "/")
    return F.when(F.lower(p).rlike(r"\.(tex|bbl|bib)$"), p).otherwise(F.concat(p, F.lit(".tex")))
