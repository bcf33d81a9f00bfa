import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import encoding, linkage, markup, mixing, neighbours, people, subjects, tokens


def test_only_the_subpackage_knows_itself():
    import pathlib

    root = pathlib.Path(encoding.__file__).parent.parent
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "marginalia.llm" not in f.read_text()


# 1 names

RAW = [
    (1, "Zacharias Foolisund, Robert Barrikant"),
    (2, "Z. Foolisund and B. Other"),
    (3, 'Foolisund, Zacharias; "Robert ""Bob"" Barrikant"'),
    (4, "Bob Barrikant"),
    (5, "Johanna Foolisund"),
    (6, "Dagliglo Collaboration, The Dagliglo Collaboration, DAGLIGLO Coll., Collaboration Dagliglo"),
    (7, None),
    (8, "  "),
    (9, "ZACHARIAS FOOLISUND, Zachauias Foolisund"),
]
REFS = [(1, None, "Z. Foolisund, A title of some length, J. Wave Stud. 1, 2 (2001).", "Foolisund"), (2, None, "Foolisund, Z.; A title; J. Wave Stud. 1 (2001) 2", "Foolisuad"), (3, None, None, None), (4, None, "J Foolisund, Other title, Ann. Norvel Soc. 5, 9 (2002).", "foolisund"), (5, None, "see text", "")]


def names(spark):
    raw = spark.createDataFrame([(*r, "A title") for r in RAW], "row_id long, authors string, title string").withColumn("name", F.lit("clash"))
    refs = spark.createDataFrame(REFS, "ref_id long, title string, info string, author_ln string").withColumn("last", F.lit("clash"))
    return raw, refs


def test_names_of_one_person(spark):
    raw, refs = names(spark)
    pairs = {(r.name_a, r.name_b) for r in people.found(raw, refs).collect()}
    link = lambda a, b: (min(a, b), max(a, b)) in pairs
    for a in ("Z. Foolisund", "Foolisund, Zacharias", "ZACHARIAS FOOLISUND", "Zachauias Foolisund", "Foolisund", "Foolisuad"):
        assert link("Zacharias Foolisund", a), a
    assert link("Robert Barrikant", "Bob Barrikant") and link('Robert "Bob" Barrikant', "Bob Barrikant")
    assert link("Dagliglo Collaboration", "DAGLIGLO Coll.") and link("Collaboration Dagliglo", "The Dagliglo Collaboration")
    assert link("Johanna Foolisund", "foolisund") and not link("Johanna Foolisund", "Zacharias Foolisund")
    assert all(a < b for a, b in pairs)
    assert people.found(raw.limit(0), refs.limit(0)).count() == 0


def test_nicknames_are_learned_from_lists_of_one_title(spark):
    rows = [(1, f"{t} of a title that is long enough", [(1, "", last, g, "full")]) for t, last, g in [("A", "x", "robert"), ("A", "x", "bob"), ("B", "y", "robert"), ("B", "y", "bob"), ("C", "z", "anna"), ("C", "z", "ute"), ("D", "x", "robert"), ("D", "x", "rober"), ("E", "y", "robert"), ("E", "y", "rober")]]
    lists = spark.createDataFrame(rows, "row_id long, title string, typed array<struct<pos:int,name:string,last:string,given:string,kind:string>>")
    names = spark.createDataFrame([("Q", "last", "margarete", "full", "gretel")], "name string, last string, given string, kind string, nick string")
    assert {(r.nick, r.given) for r in people.nicknames(names, lists).collect()} == {("bob", "robert"), ("gretel", "margarete")}


def test_name_parsing():
    assert people.parse_name("Foo, A. B.")[:3] == ("foo", "a", "initial")
    assert people.parse_name("A.Foo")[:3] == ("foo", "a", "initial")
    assert people.parse_name("Foo B")[:3] == ("foo", "b", "initial")
    assert people.parse_name("Cor. van der Foo")[:3] == ("foo", "cor", "short")
    assert people.parse_name("Foo")[2] == "bare" and people.parse_name("")[2] == "bare"
    assert people.parse_name("the Foo team")[:3] == ("foo", "", "group")


def test_slips_in_any_place_are_paired(spark):
    near = [("Smith", "Smyth"), ("Meyer", "Meier"), ("Novak", "Nowak"), ("Fischer", "Fishcer"), ("Lang", "Lange"), ("Lin", "Lind"), ("Oberhauserbergmann", "Oberhausarbargmann")]
    rows = [(x.lower(), "j") for p in near for x in p]
    got = {(r.a, r.b) for r in people.suffix_pairs(spark.createDataFrame(rows, "last string, initial string")).collect()}
    assert {tuple(sorted(x.lower() for x in p)) for p in near} - got == set()


def test_slips_are_paired_in_blocks_of_any_size(spark):
    heads = [a + b for a in "bcdfghklmn" for b in "aeiou"]
    rows = [(h + "rgmann", "j") for h in heads]
    got = {(r.a, r.b) for r in people.suffix_pairs(spark.createDataFrame(rows, "last string, initial string")).collect()}
    assert len(rows) > people.COMMON and ("bargmann", "bergmann") in got and ("bargmann", "cargmann") in got


def test_slip_keys_miss_no_pair():
    from marginalia.functions.similarity import lcs_length

    r = random.Random(2)
    for _ in range(3000):
        a = "".join(r.choice("abcde") for _ in range(r.randrange(2, 20)))
        b = list(a)
        for _ in range(r.randrange(1, 4)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(2)] = r.choice(["", "x", "a"])
        b = "".join(b)
        if abs(len(a) - len(b)) <= 2 and 2 * lcs_length(a, b) >= people.CLOSE * (len(a) + len(b)):
            assert people.slip_keys(a) & people.slip_keys(b), (a, b)


# 2 encodings


def test_garbled_text(spark):
    clean = ["Größere Öffnungen führen zu Überlagerung für alle.", "El año pasado se midió otra señal más débil.", "Żółw i źródło: łatwe słowa próby.", "The façade – 3.5 µm thick – “quiet” isn’t."]
    rows = [(i, clean[i % 4] + " plain words here") for i in range(400)]
    bad = {1000: clean[0].encode().decode("cp1252", "replace").replace("�", ""), 1001: clean[1].encode().decode("mac_roman"), 1002: clean[1].encode("cp1252").decode("cp1251"), 1003: clean[0].encode().decode("latin-1").encode().decode("latin-1"), 1004: "lost � sign"}
    right = {2000: "Das Feld Â und der Wert Ã sind Symbole.", 2001: "├── run\n└── plot", 2002: "", 2003: None, 2004: "  ", 2005: "SÃO", 2006: "x" * 200_000}
    df = spark.createDataFrame([*rows, *bad.items(), *right.items(), (1001, bad[1001])], "body_id long, body string").withColumn("garbled", F.lit(1))
    got = [(r.body_id, r) for r in encoding.restore(df, "body_id", "body").collect()]
    assert sorted(k for k, r in got if r.garbled) == [1000, 1001, 1001, 1002, 1003, 1004]
    by = dict(got)
    assert by[1001].restored == clean[1] and by[1002].restored == clean[1] and by[1003].restored == clean[0]
    assert by[2003].restored is None and by[2002].restored == "" and by[2001].restored == right[2001]
    assert encoding.found(df.limit(0), "body_id", "body").count() == 0


def test_unknown_code_page_is_learned_from_the_body(spark):
    clean = ["Größere Öffnungen führen zu Überlagerung für alle.", "Später wären mögliche Änderungen für Gefäße nötig.", "El año pasado se midió otra señal más débil."]
    assert ("cp852", "cp1252") not in encoding.SWAPS
    texts = [" ".join(clean[:2]), clean[2]]
    rows = [(i, texts[i % 2]) for i in range(60)] + [(100 + i, texts[0].encode("cp1252").decode("cp852")) for i in range(2)]
    got = {r.body_id: r for r in encoding.restore(spark.createDataFrame(rows, "body_id long, body string"), "body_id", "body").collect()}
    assert sorted(k for k, r in got.items() if r.garbled) == [100, 101]
    assert got[100].restored == got[101].restored == texts[0]


def test_entries_of_a_map_move(spark):
    clean = ["Größere Öffnungen führen zu Überlagerung für alle.", "Später wären mögliche Änderungen für Gefäße nötig.", "Der größte Körper löst später öfter Brüche aus und prüft Gewölbe."]
    text = " ".join(clean)
    # a page that is cp1251 but for one sign: what it reads as another letter stands for the a with dots
    wrong = text.encode("cp1252").decode("cp1251").replace("д", "щ")
    rows = [(i, f"{text} {i}") for i in range(60)] + [(100 + i, f"{wrong} {i}") for i in range(3)]
    df = spark.createDataFrame(rows, "body_id long, body string")
    model = encoding.learn(df, "body")
    table, start = model.tables["cp1252 as cp1251"], encoding.swap_tables()["cp1252 as cp1251"]
    assert start[ord("щ")] == "ù" and table[ord("щ")] == "ä"
    assert {k: v for k, v in table.items() if k != ord("щ")} == {k: v for k, v in start.items() if k != ord("щ")}
    got = {r.body_id: r for r in encoding.restore(df, "body_id", "body", model).collect()}
    assert all(got[k].garbled == (k >= 100) for k in got) and got[100].restored == f"{text} 0"


# 3 vectors


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((120, 32))
    v = np.concatenate([centre + 0.45 * rng.standard_normal((120, 32)) for _ in range(10)])
    v[7] = v[8]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    extra = [(5000, None), (5001, [0.0] * 32), (5002, [1.0]), (5003, []), (3, rows[3][1])]
    return v, spark.createDataFrame([*rows, *extra], "id long, vec array<float>")


def brute(v, i, k=5):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u[i]
    s[i] = -2
    return set(np.argsort(-s)[:k].tolist())


def test_nearest_vectors_recall(spark, vectors):
    v, df = vectors
    got = {r["id"]: [c["nb"] for c in r["cand"]] for r in neighbours.nearest(df, 5).collect()}
    assert set(got) == set(range(len(v))) and all(len(set(x)) == 5 and i not in x for i, x in got.items())
    assert np.mean([len(brute(v, i) & set(got[i])) / 5 for i in got]) > 0.97
    assert 8 in got[7]


def test_greedy_search_recall(spark, vectors):
    v, df = vectors
    graph, sk, width, _ = neighbours.build(df)
    q = sk.where("id % 20 = 0")
    hits = {}
    for r in neighbours.search(graph, sk, q, neighbours.whole_bytes(df, width)).collect():
        hits.setdefault(r["query"], set()).add(r["vec_id"])
    assert len(hits) == len(v) // 20
    assert np.mean([len(brute(v, i) & x) / 5 for i, x in hits.items()]) >= 0.9


def test_equal_vectors_are_one_node_and_come_apart_again(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((300, 16)).round(2)
    v[100:300] = v[100]  # two thirds of all are equal
    v[20:23] = v[20]
    df = spark.createDataFrame([(1000 + i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vec array<float>")
    _, sk, _, _ = neighbours.build(df)
    assert sk.count() == 99
    got = {r["id"]: [c["nb"] for c in r["cand"]] for r in neighbours.nearest(df, 5).collect()}
    assert set(got) == set(range(1000, 1300))
    assert got[1250] == [1100, 1101, 1102, 1103, 1104] and got[1101] == [1100, 1102, 1103, 1104, 1105]
    assert got[1021][:2] == [1020, 1022] and len(set(got[1021])) == 5
    e = spark.createDataFrame([(r["id"], r["vec"], r["id"], r["vec"]) for r in df.collect()], "ctx_id long, ctx_vec array<float>, abs_id long, abs_vec array<float>")
    hits = {}
    for r in neighbours.searched(e).collect():
        hits.setdefault(r["query"], []).append(r["vec_id"])
    assert set(hits) == set(range(1000, 1300, 20)) and sorted(hits[1200]) == [1100, 1101, 1102, 1103, 1104]
    alone = df.where("id >= 1100")
    assert {len(r["cand"]) for r in neighbours.nearest(alone, 5).collect()} == {5}


def test_few_vectors(spark, vectors):
    _, df = vectors
    e = lambda rows: spark.createDataFrame(rows, "ctx_id long, ctx_vec array<float>, abs_id long, abs_vec array<float>")
    assert neighbours.found(e([])).count() == 0
    assert neighbours.found(e([(1, [1.0, 0.0], 1, [1.0, 0.0])])).count() == 0
    got = neighbours.found(e([(1, [1.0, 0.0], 2, [1.0, 0.1]), (3, None, 2, [1.0, 0.1]), (3, [0.0, 1.0], 9, [0.0, 0.0])])).collect()
    assert {(r.vec_a, r.vec_b) for r in got} == {(1, 2), (1, 3), (2, 3)}


# 5 markup

MARKED = {
    "A <b>bold</b> word": "A bold word",
    "x &amp; y &quot;z&quot;": 'x & y "z"',
    "**a** and __b__ and ~~c~~ `d`": "a and b and c `d`",
    "[[Topic|a cell]] and {{term|b}} ''c''": "a cell and b c",
    "# Summary\n\ntext\n\n- one\n- two": "# Summary\n\ntext\n\n- one\n- two",
    "== Aim ==\ntext\n* one\n* two": "## Aim\ntext\n- one\n- two",
    "\\section*{Aim} text \\emph{word} {\\bf more}": "# Aim\ntext word more",
    "$x_{i}^{2}$ stays \\(p \\leq q\\)": "$x_{i}^{2}$ stays $p \\leq q$",
    "<h2>Head</h2>text<ul><li>a</li><li>b</li></ul>": "## Head\ntext\n\n- a\n\n- b",
    "caf\\'e na\\\"{i}ve \\c{c}": None,
    "a<!-- hidden -->b": "a b",
    "```\nrun < x\n```\ntail": "```\nrun < x\n```\ntail",
    "In Notes Est.~Inf. 9": "In Notes Est. Inf. 9",
    "<i>never closed": "never closed",
    "&Sigma; &#945;&#x3b8; &theta;&nbsp;x &nosuch; &#1; &amp;lt;": "Σ αθ θ x &nosuch; &#1; &lt;",
    "| a | b |\n|---|:-:|\n| 1 | 2 |": "a, b\n1, 2",
    "{| class=\"w\"\n|+ Cap\n! a !! b\n|-\n| 1 || 2\n|}\nend": "Cap\na, b\n1, 2\nend",
    "Aim\n=====\ntext\nWay\n---\nmore": "# Aim\ntext\n## Way\nmore",
    "a $" + "x+" * 300 + "y$ b": "a $" + "x+" * 300 + "y$ b",
    "so $a +\nb$ is": "so $a +\nb$ is",
    "**" + "many words " * 60 + "end** of it": "many words " * 60 + "end of it",
    "``" + "many words " * 60 + "end'' of it": "“" + "many words " * 60 + "end” of it",
}
PROSE = ["p < 0.01 and n > 30", "R&D budgets", "5 * 3 * 2 points", "costs $4 to $6 in total", "max_step_size", "in {0, 1}.", "(*) marks", "entry #3 [12, 31]", "degree is <k> = 4.2", "-- that is, almost none.", "We keep 95% of them; 5% are lost.", "", " ", None, "a~ b", "don't; it's"]


def test_markup(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*MARKED, *PROSE])], "k int, t string").withColumn("clean", F.lit(0))
    got = {r.k: r for r in markup.clean(df, ["k"], "t").collect()}
    for i, (t, want) in enumerate(MARKED.items()):
        assert got[i].has_markup and got[i].kinds and got[i].residue, t
        if want is not None:
            assert got[i].clean == want, t
    for i, t in enumerate(PROSE, len(MARKED)):
        assert not got[i].has_markup and not got[i].residue, t
        assert got[i].clean == (None if t is None else " ".join(t.split()))
    assert markup.clean(df.limit(0), ["k"], "t").count() == 0


def test_line_blocks_drop_short_runs(spark):
    page = "\n".join(["menu", "home", "a", "", ""] + ["a long line of running text " * 4] * 4 + ["", "", "b", "c", ""])
    df = spark.createDataFrame([(page,)], "t string")
    out = markup.line_blocks(df, "t", "t", 1, 40).first()["t"].split("\n")
    assert len(out) == 4


def test_runs_of_page_furniture_fall_away_at_the_ends(spark):
    link = lambda x: f'<a href="/{x}">{x}</a>'
    menu = "<nav class='top'>Home<br>News<br>\n<ul><li>About</li></ul></nav>"
    cases = {
        f"{menu}<p>First text.</p><p>Last text.</p><footer>Imprint<br/>Terms<br/>Privacy</footer>": "First text.\n\nLast text.",
        f"{link('a')}\n{link('b')} | {link('c')}\n{link('d')}\nThe text.\n{link('e')}": "The text.\ne",  # one line is no run
        f"The text.\n<ul><li>{link('a')}</li><li>{link('b')}</li><li>{link('c')}</li></ul>": "The text.\n\n- a\n\n- b\n\n- c",
        f"{link('a')}\n\n\n{link('b')}\n\nThe text.": "a\n\nb\n\nThe text.",
        f"First.\n{link('a')}\n{link('b')}\n{link('c')}\nLast.": "First.\na\nb\nc\nLast.",
        menu: "Home\nNews\n\n- About",
        f"{link('a')}\n{link('b')}\n{link('c')}": "a\nb\nc",
        f"The text.\n`x` {link('a')}\n`y` {link('b')}\n`z` {link('c')}": "The text.\n`x` a\n`y` b\n`z` c",
        "<nav>Home<br>News<br>About\n\nnever closed": "Home\nNews\nAbout\n\nnever closed",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = {r.k: r for r in markup.clean(df, ["k"], "t").collect()}
    for i, (t, want) in enumerate(cases.items()):
        assert got[i].clean == want and got[i].residue, t
    bare = df.select(markup.strip_markup(F.col("t")).alias("t")).where("t rlike '[\\ufdd0\\ufdd1]'")
    assert bare.count() == 0


# 6 linkage


def articles(spark):
    rows = [(f"a{i}", f"Author{chr(97 + i)}son X., Second Y. On the {w} of Gluv{chr(97 + i)}nd measurements. 200{i}-01-01", f"On the {w} of Gluv{chr(97 + i)}nd measurements", f"Xaver Author{chr(97 + i)}son, Yves Second") for i, w in enumerate(["quantum dot", "web crawler", "plasma wave", "gene map", "bond yield", "kernel trick"])]
    rows += [("p1", "Q. Parter. The long study. Part 1. 2001-01-01", "The long study of crystals. Part 1", "Q. Parter"), ("p2", "Q. Parter. The long study. Part 2. 2002-01-01", "The long study of crystals. Part 2", "Q. Parter"), ("n", None, None, None)]
    return spark.createDataFrame(rows, "id string, info string, title string, authors string").withColumn("key", F.lit("clash"))


def test_links(spark):
    refs = [
        (1, None, "X. Authorason and Y. Second, On the quantum dot of Gluvand measurements, J. Wave Stud. 1, 2 (2000).", "Authorason", "a0"),
        (2, "On the web crawler of Gluvbnd measuremnts", None, None, None),
        (3, None, "Parter Q, The long study of crystals. Part 2, Ann. Norvel Soc. 3, 4 (2002).", "Parter", None),
        (4, None, "Z. Nobody, A very different piece of work, Ann. Norvel Soc. 3, 4 (2002).", "Nobody", None),
        (5, None, None, None, None),
        (6, "", "see text", "Authorason", None),
        (7, None, "Authorcson, X.; Second, Y., Ann. Norvel Soc. 9, 9 (2002)", "Authorcson", None),
        (2, "On the web crawler of Gluvbnd measuremnts", None, None, None),
    ]
    df = spark.createDataFrame(refs, "ref_id long, title string, info string, author_ln string, target_id string").withColumn("id", F.lit("clash"))
    got = {r.ref_id: r["id"] for r in linkage.found(df, articles(spark)).collect()}
    assert got == {1: "a0", 2: "a1", 3: "p2", 7: "a2"}
    assert linkage.found(df, articles(spark).limit(0)).count() == 0 and linkage.found(df.limit(0), articles(spark)).count() == 0


def test_weights_stay_bounded_on_separable_labels_and_rivals_share():
    import pandas as pd

    rows = [(e, f"a{e}-{k}", 1, True, float(k == 0), 1.0, 0.99 if k == 0 else 0.7, 0.9 if k == 0 else 0.5, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0) for e in range(500) for k in range(3)]
    sample = pd.DataFrame(rows, columns=["e_key", "c_key", "copies", "titled", "truth", *linkage.FEATURES])
    w = linkage.fit(sample, True)
    assert np.abs(w).max() < 100  # full Newton steps would run away here
    assert np.array_equal(linkage.fit(sample.iloc[:0], True), np.array(linkage.PRIOR[True]))


def test_equally_fitting_articles_share_the_confidence(spark):
    arts = [(f"x{i}", "B. Twin. A study of the grommel lattice at rest. 2001-01-01", "A study of the grommel lattice at rest", "Bela Twin") for i in (1, 2)]
    df = spark.createDataFrame(arts, "id string, info string, title string, authors string")
    ref = [(1, None, "B. Twin, A study of the grommel lattice at rest, J. Wave Stud. 1, 2 (2001).", "Twin", None)]
    refs = spark.createDataFrame(ref, "ref_id long, title string, info string, author_ln string, target_id string")
    got = linkage.link(refs, df).collect()
    assert [r["id"] for r in got] == ["x1"] and got[0].confidence <= 0.5
    assert linkage.link(refs, df.where("id = 'x2'")).first().confidence > 0.9


def test_entries_without_title_and_with_one_author_are_linked_where_nothing_else_fits(spark):
    arts = [("a", "C. Lonely. On rest. 2003-01-01", "On the rest of grommels", "Cora Lonely"), ("b", "D. Other. On rest. 2004-01-01", "On the unrest of grommels", "Dora Other"), ("c", "D. Other. On work. 2004-05-01", "On the work of grommels", "Dora Other")]
    df = spark.createDataFrame(arts, "id string, info string, title string, authors string")
    refs = spark.createDataFrame([(1, None, "C. Lonely, J. Wave Stud. 1, 2 (2003).", "Lonely", None), (2, None, "D. Other, J. Wave Stud. 1, 2 (2004).", "Other", None)], "ref_id long, title string, info string, author_ln string, target_id string")
    got = {r.ref_id: r for r in linkage.link(refs, df).collect()}
    assert got[1]["id"] == "a" and 0 < got[1].confidence
    assert got[2].confidence < 0.5


def test_entries_without_title_meet_all_works_of_their_names(spark):
    # Usual and Common have several works each, and one together; Hot has 40 with others, of 40 years
    arts = [("u1", None, "On rest one", "Ada Usual"), ("u2", None, "On rest two", "Ada Usual"), ("c1", None, "On rest three", "Cora Common"), ("c2", None, "On rest four", "Cora Common"), ("j", "A. Usual, C. Common. On rest five. 2003-01-01", "On rest five", "Ada Usual, Cora Common")]
    arts += [(f"h{i:02}", f"H. Hot, M. Mate{chr(97 + i % 26)}{chr(97 + i // 26)}x. On work. {1960 + i}-01-01", f"On work {i}", f"Hal Hot, Mo Mate{chr(97 + i % 26)}{chr(97 + i // 26)}x") for i in range(40)]
    df = spark.createDataFrame(arts, "id string, info string, title string, authors string")
    rows = [(1, None, "A. Usual, C. Common, J. Wave Stud. 1, 2.", "Usual", None), (2, None, "A. Usual, C. Common, J. Wave Stud. 1, 2 (1990).", "Usual", None), (3, None, None, "Usual", "u2"), (4, None, None, "Hot", "h07"), (5, None, None, "Hot", None)]
    refs = spark.createDataFrame(rows, "ref_id long, title string, info string, author_ln string, target_id string")
    scored = linkage.candidates(refs, df)
    got = {k: [(r.c_key, r.copies, r.holds, r.far_year) for r in scored.collect() if r.e_key == k] for k in range(1, 6)}
    assert got[1] == [("j", 1, False, 0.0)] and got[2] == [("j", 1, False, 1.0)]
    assert got[3] == [("j", 3, True, 0.0)]  # u1, u2 and j fit equally well
    assert got[4] == [("h00", 40, True, 0.0)] and got[5] == [("h00", 40, False, 0.0)]
    links = {r.ref_id: r for r in linkage.link(refs, df).collect()}
    assert set(links) == {1, 2, 3, 4, 5} and links[1]["id"] == "j" and links[5].confidence <= 1 / 40


def test_titles_of_common_words_are_linked(spark):
    words = ["granular", "packing", "pairing", "coupled", "datasets", "turbulent", "lattice", "spectra"]
    arts = [(f"a{i}", None, " ".join(w for w in words if w != x), None) for i, x in enumerate(words)]
    df = spark.createDataFrame(arts, "id string, info string, title string, authors string")
    assert set(words) <= linkage.common_words(df)
    refs = spark.createDataFrame([(i, a[2], None, None, None) for i, a in enumerate(arts)], "ref_id long, title string, info string, author_ln string, target_id string")
    assert {r.ref_id: r["id"] for r in linkage.found(refs, df).collect()} == {i: f"a{i}" for i in range(len(words))}


def test_hamming_join_is_exact(spark):
    r = random.Random(9)
    base = [r.getrandbits(512) for _ in range(40)]
    vecs = base + [b ^ sum(1 << k for k in r.sample(range(512), r.randrange(12))) for b in base]
    rows = [(linkage._longs(v),) for v in vecs]
    got = {(tuple(x.cb_l), tuple(x.cb_r)) for x in linkage.hamming_pairs(spark.createDataFrame(rows, "cb array<long>"), spark.createDataFrame(rows, "cb array<long>")).collect()}
    want = {(tuple(a[0]), tuple(b[0])) for a, x in zip(rows, vecs) for b, y in zip(rows, vecs) if (x ^ y).bit_count() < linkage.CHUNKS}
    assert got == want


def test_hamming_join_is_exact_on_short_titles(spark):
    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    base = [[word(r.randrange(2, 10)) for _ in range(1 + i % 3)] for i in range(240)]
    slips = [[w[:k] + r.choice(letters) + w[k + 1 :] for w in ws[:1] for k in [r.randrange(len(w))]] + ws[1:] for ws in base]
    vecs = [linkage.bits_of(ws) for ws in base + slips] + [0]
    rows = [(linkage._longs(v),) for v in vecs]
    df = spark.createDataFrame(rows, "cb array<long>")
    got = [(tuple(x.cb_l), tuple(x.cb_r)) for x in linkage.hamming_pairs(df, df).collect()]
    want = {(tuple(a[0]), tuple(b[0])) for a, x in zip(rows, vecs) for b, y in zip(rows, vecs) if (x ^ y).bit_count() < linkage.CHUNKS}
    assert set(got) == want and len(got) == len(want)


# 7 tokens

TEXTS = ["", None, "Hello world, it's 2024!", "  \n\t ", "<|endoftext|> is text", "é ü 漢字 🙂‍👩", "a" * 5000, "1234567890" * 300, "x" * 3 + " " * 700 + "y", "\x00​﻿"]


def test_tokens_equal_the_public_library_and_come_back(spark):
    tk = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    tk.encode_special_tokens = True
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2])], "doc_id long, text string").withColumn("ids", F.lit(1))
    strings = {b: a for a, b in tokens.load_ranks().items()}
    rows = tokens.encode_column(df, "doc_id", "text").collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        assert r.ids == tk.encode(text, add_special_tokens=False).ids
        assert tokens.decode(r.ids, strings) == text
    assert {(r.doc_id, r.text) for r in tokens.decode_column(tokens.encode_column(df, "doc_id", "text"), "doc_id").collect()} == {(i, t or "") for i, t in enumerate(TEXTS)}
    assert tokens.encode_column(df.limit(0), "doc_id", "text").count() == 0


# 8 mixing


def test_mix_meets_shares_and_caps(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["word"] * r.randrange(20, 60)), "big" if i < 500 else "small" if i < 530 else "unlisted") for i in range(600)] + [(900, None, "big"), (901, "", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_tokens", F.lit(0))
    targets = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 3), ("absent", 0.1, 2), ("none", None, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets).cache()
    got = {x.source: x for x in mixing.shares(mixed, targets).collect()}
    assert got["small"].actual_share == pytest.approx(0.2, abs=0.01) and got["small"].most_copies <= 3
    assert got["big"].most_copies <= 1 and got["absent"].tokens == 0
    assert mixed.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    assert mixed.select("slot", "place", "source").distinct().count() == mixed.count()
    assert {x.source for x in mixed.select("source").distinct().collect()} == {"big", "small"}
    assert mixed.groupBy("slot").agg(F.count_distinct("source").alias("n")).where("n > 1").count() == 0
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0


# 9 subjects


def test_subjects(spark):
    r = random.Random(4)
    words = {"phys": ["laser", "plasma", "photon", "magnet"], "law": ["court", "appeal", "statute", "judge"], "sport": ["goal", "league", "coach", "match"]}
    say = lambda s: f"The {r.choice(words[s])} was seen near the {r.choice(words[s])} again. "
    docs, labels = [], []
    for i in range(300):
        subs = r.sample(sorted(words), 1 if i % 4 else 2)
        docs.append((i, "".join(say(subs[k % len(subs)]) for k in range(8))))
        if i % 3 == 0:
            labels += [(i, s) for s in subs] * 2
        docs[-1] = (*docs[-1], subs)
    rows = [d[:2] for d in docs] + [(900, None), (901, ""), (902, "No new content is given here."), (903, docs[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("subject", F.lit("clash"))
    kinds = spark.createDataFrame([("phys", "Physics", "Lasers."), ("law", "Law", "Courts."), ("sport", "Sport", None)], "subject string, label string, about string")
    lab = spark.createDataFrame(labels + [(99999, "law"), (0, "other")], "doc_id long, subject string")
    got = {}
    for x in subjects.found(df, kinds, lab).collect():
        got.setdefault(x.doc_id, set()).add(x.subject)
    right = sum(got.get(i, set()) == set(s) for i, _, s in docs)
    assert right / len(docs) > 0.95 and not {900, 901, 902} & set(got) and got[903] == got[5]
    assert subjects.found(df.limit(0), kinds, lab).count() == 0
    assert subjects.found(df, kinds, lab.limit(0)).count() >= 0


def test_notes_without_subject_teach_nothing(spark):
    r = random.Random(6)
    words = {"phys": ["laser", "plasma", "photon", "magnet"], "law": ["court", "appeal", "statute", "judge"]}
    notes = ["The referees were thanked for their reports.", "Pages were set anew on request.", "A later version replaced the record."]
    docs = [(i, " ".join(f"The {r.choice(words[s])} met the {r.choice(words[s])} {r.choice(['again', 'there', 'once'])}." for _ in range(6)), s) for i in range(300) for s in [r.choice(sorted(words))]]
    rows = [d[:2] for d in docs] + [(1000 + i, " ".join(r.sample(notes, 1 + i % 3))) for i in range(200)]
    # chance ties a word of the notes to one subject
    rows[0] = (0, rows[0][1] + " The record was set.")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kinds = spark.createDataFrame([("phys", "Physics", "Lasers."), ("law", "Law", "Courts.")], "subject string, label string, about string")
    lab = spark.createDataFrame([(i, s) for i, _, s in docs[:80]], "doc_id long, subject string")
    got = {(x.doc_id, x.subject) for x in subjects.found(df, kinds, lab).collect()}
    assert not [x for x in got if x[0] >= 1000]
    assert len(got & {(i, s) for i, _, s in docs}) > 0.97 * len(docs)
