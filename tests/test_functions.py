import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import authors, latex, spans
from marginalia.functions.similarity import lcs_length, lcs_ratio, may_reach


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


COMMANDS = {
    "\\textbf{Foo} bar": ("Foo bar", "Foo bar"),
    'Schr\\"odinger x': ("Schrodinger x", 'Schr"odinger x'),
    "Andr\\'e Weil": ("AndrWeil", "Andr'e Weil"),
    "a $x_1$ b $$y$$ c": ("a $x_1$ b $$y$$ c", "a b c"),
    "cost \\$5 and $z": ("cost and $z", "cost and"),
    "see \\alpha_s \\cite{": ("see alpha_s", "see alpha_s"),
    "a \\foo": ("a", "a"),
    "$\\alpha$ \\beta c": ("$\\alpha$ c", "c"),
    "a$": ("a$", "a$"),
    "": ("", ""),
}


def test_commands(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*COMMANDS, None])], "i int, t string")
    got = [(r.a, r.b) for r in df.select("i", latex.remove_commands(F.col("t")).alias("a"), latex.plain_context(F.col("t")).alias("b")).orderBy("i").collect()]
    assert got == [*COMMANDS.values(), (None, None)]


@pytest.mark.parametrize("text,want", [("a\\%b%c\nd", "a\\%b\nd"), ("x\\begin{comment}\n1\n\\end{comment}y", "xy"), ("", "")])
def test_comments(spark, text, want):
    assert one(spark, text, latex.remove_comments) == want


@pytest.mark.parametrize(
    "text,want",
    [("\\cite{a, b} x", "\\cite{a} \\cite{b} x"), ("\\citep{a}", "\\citep{a}"), ("\\footcite{a,b}\\citet{x,y}", "\\footcite{a} \\footcite{b}\\citet{x} \\citet{y}"), ("\\cite[p.1]{a,b}", "\\cite[p.1]{a,b}"), ("\\cite{a,\nb}", "\\cite{a,\nb}"), ("none", "none")],
)
def test_split_cites(spark, text, want):
    assert one(spark, text, latex.split_cites) == want


def test_isolated_and_bibliography(spark):
    assert one(spark, "a\\cite{k}b", latex.isolate_cites) == "a\n\\cite{k}\nb"
    assert one(spark, "no bibliography", latex.without_bibliography) == "no bibliography"
    t = "x\\begin{thebibliography}{9}\\bibitem{a}\\end{thebibliography}y"
    assert one(spark, t, latex.without_bibliography) == "xy"
    assert one(spark, "x/y\\z", latex.input_path) == "x/y/z.tex"


@pytest.mark.parametrize("text,want", [("A. Foo and B. Bar", "bar"), ("X", "x"), ("Foo (MIT)", "Foo (MIT)"), ("J.~Smith", "smith"), ("", ""), (None, None), ("Müller", "müller")])
def test_last_name(spark, text, want):
    assert one(spark, text, authors.last_name) == want


@pytest.mark.parametrize("text,want", [("J. Smith, Title", "Smith"), ("A.~B.~Doe and C. Roe", "Doe"), ("X, y", None), ("Li, Title", "Li")])
def test_first_author(spark, text, want):
    assert one(spark, text, authors.first_author_of_entry) == want


def test_segments_and_spans(spark):
    assert one(spark, "ab;cde;fgh", authors.longest_segment) == "cde"
    df = spark.createDataFrame([("smith2000 x smith2000a", "smith2000"), ("a.b", "a.b"), ("q\\Eq", "\\E"), ("x", ""), ("aaaa", "aa")], "t string, k string")
    assert [r.o for r in df.select(spans.offsets(F.col("t"), F.col("k")).alias("o")).collect()] == [[0, 12], [0], [1], [], [0, 2]]
    assert one(spark, "123456789a", spans.too_dense) and one(spark, "", spans.too_dense)
    assert one(spark, "1abcdefghi", spans.too_dense) and not one(spark, "1abcdefghij", spans.too_dense)
    assert one(spark, "abc", lambda c: spans.tail(c, 0)) == "" and one(spark, "abc", lambda c: spans.tail(c, 2)) == "bc"


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def test_lcs_against_plain_table(spark):
    r = random.Random(5)
    pairs = [("".join(r.choice("abcé ") for _ in range(r.randrange(30))), "".join(r.choice("abcé ") for _ in range(r.randrange(30)))) for _ in range(300)]
    for a, b in pairs:
        assert lcs_length(a, b) == table_lcs(a, b) == lcs_length(b, a)
    df = spark.createDataFrame([*pairs, ("", ""), (None, "a")], "a string, b string")
    for row in df.select("a", "b", lcs_ratio("a", "b").alias("s"), may_reach(F.col("a"), F.col("b"), 77.5).alias("m")).collect():
        if row.a is None:
            assert row.s is None
        else:
            assert 0 <= row.s <= 100 and (row.s == 100) == (row.a == row.b) and (row.m or row.s < 77.5)
