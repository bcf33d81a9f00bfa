import pytest
from pyspark.sql import functions as F

from marginalia.operators.packed import explode_packed

NAMES = {
    "A. Foo and B. Bar": ["A. Foo", "B. Bar"],
    "A. Foo, B. Bar, and C. Van Baz": ["A. Foo", "B. Bar", "C. Van Baz"],
    'Foo, A.|"Bar, ""Bo"" B.";C. Baz,': ["Foo, A.", 'Bar, "Bo" B.', "C. Baz"],
    'Oliver "Ollie" Foo & D. Bar (Dept. of Forms; Quiet Harbour), et al.': ['Oliver "Ollie" Foo', "D. Bar"],
    "'A. Foo';'B. O'Bar'": ["A. Foo", "B. O'Bar"],
    "A. Foo\nB. Bar": ["A. Foo", "B. Bar"],
    "A. Foo and Michael\n  Bar": ["A. Foo", "Michael Bar"],
    "Foo, Susanna": ["Foo, Susanna"],
    "van der Foo, U. and Bar, M. N.": ["van der Foo, U.", "Bar, M. N."],
    "A. Foo, , B. Bar": ["A. Foo", "B. Bar"],
    'A. Foo "': ['A. Foo "'],
    ", ;": [],
    "": [],
    "  ": [],
}
CODES = {
    "a.b c.d-x": ["a.b", "c.d-x"],
    '["a.b", "numbers, theory of"]': ["a.b", "numbers, theory of"],
    "pure forms, a.b;c-d": ["pure forms", "a.b", "c-d"],
    "pure forms": ["pure forms"],
    "'a.b','x; y'": ["a.b", "x; y"],
    "a.b//c.d/": ["a.b", "c.d"],
}


@pytest.mark.parametrize("kind,cases", [("names", NAMES), ("codes", CODES)])
def test_values_and_places(spark, kind, cases):
    rows = [(i, t) for i, t in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, f string").withColumn("item", F.lit("clash")).withColumn("pos", F.lit(9))
    got = {i: [] for i, _ in rows}
    for r in explode_packed(df, ["k"], {"f": kind}).orderBy("k", "pos").collect():
        got[r["k"]].append(r["item"])
        assert r["pos"] == len(got[r["k"]])
    assert [got[i] for i, _ in rows] == list(cases.values())


def test_null_empty_repeated_and_long(spark):
    long = ", ".join(f"A. Name{i}" for i in range(3000))
    df = spark.createDataFrame([(1, None), (2, "A. Foo"), (2, "A. Foo"), (3, long)], "k int, f string")
    n = {r["k"]: r["count"] for r in explode_packed(df, ["k"], {"f": "names"}).groupBy("k").count().collect()}
    assert n == {2: 2, 3: 3000}
    assert explode_packed(df.where("k > 9"), ["k"], {"f": "names"}).count() == 0
