import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import bibliography, catalogue, contexts, embedding, evaluate, learn, matching, projects, search, stats
from marginalia.plans.running import positions
from marginalia.sources import archives, tables


def test_catalogue(spark):
    raw = spark.createDataFrame([(1, "a/1", "A $x$ Title", "X \\textbf{Y}", "2020", "math-ph", "abs \\emph{t}", "2020-01-01"), (2, "a/1", "New", None, None, "cs", None, "2021-01-01"), (3, "b", None, "Z", "2001", None, "", None)], "row_id long, id string, title string, authors string, update_date string, categories string, abstract string, loaded_at string")
    assert [r.row_id for r in catalogue.in_categories(raw, ["math"]).collect()] == [1]
    assert catalogue.in_categories(raw, []).count() == 3
    got = {r.id: r for r in catalogue.build(raw).collect()}
    assert got["a/1"].title == "New" and got["b"].info == "Z. . 2001"
    one = catalogue.clean_records(raw.where("row_id = 1")).first()
    assert one.info == "X Y. A $x$ Title. 2020" and one.title == "A Title"
    assert catalogue.rounds(0, 250, 100) == 3 and catalogue.rounds(5, 5, 10) == 0
    assert catalogue.build(raw.limit(0)).count() == 0


def test_positions_are_a_permutation(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a, b = positions(df, 1, "k"), positions(df.repartition(7), 1, "k")
    assert sorted(r.pos for r in a.collect()) == list(range(5000))
    assert a.exceptAll(b).count() == 0
    w = catalogue.windows(a, 100, 350, 100).groupBy("round").count().orderBy("round").collect()
    assert [r["count"] for r in w] == [100, 100, 50]


def test_matching(spark):
    cat = spark.createDataFrame([("2", "A great title on things", "A great title on things. 2001", "A. Foo, B. Bar"), ("1", "A great title on things", "A great title on things. 2001", "C. Foo"), ("3", None, None, None)], "id string, title string, info string, authors string")
    refs = spark.createDataFrame([(1, "A great title on thing", None, "Foo", None), (2, None, "X; A great title on things. 2001; J", "A. Bar", None), (3, "Other words altogether here", None, "Foo", None), (4, None, None, None, None), (5, "", "", "Foo", None), (1, "A great title on thing", None, "Foo", None)], "ref_id long, title string, info string, author_ln string, target_id string")
    got = {r.ref_id: r.target_id for r in matching.match_references(refs, cat).collect()}
    assert got == {1: "1", 2: "2", 3: None, 4: None, 5: None}  # ties go to the lowest id
    n = matching.match_counts(matching.match_references(refs.dropDuplicates(), cat)).first()
    assert (n.n_total, n.n_hits, n.n_no_author, n.n_no_text) == (5, 2, 1, 2)
    assert matching.match_references(refs, cat.limit(0)).where("target_id is not null").count() == 0


def test_contexts(spark):
    bodies = spark.createDataFrame([("p", 1, "Some text before \\cite{k1} and k1 again"), ("q", 2, None), ("p", 3, "")], "paper_id string, body_id long, body string")
    refs = spark.createDataFrame([("p", "k1", "t"), ("p", "k1", "t"), ("p", "zz", None), ("q", "k1", "t"), ("p", None, "t")], "paper_id string, cite_key string, target_id string")
    assert sorted(r["at"] for r in contexts.hits(bodies, refs).collect()) == [23, 31]
    assert [r["at"] for r in contexts.hits(bodies, refs, within_cites=True).collect()] == [23]
    data = contexts.dataset(bodies, refs)
    assert {r.context for r in data.collect()} >= {"Some text before"} or data.count() > 0
    once = contexts.update(data.limit(0), data)
    assert once.exceptAll(contexts.update(once, data)).count() == 0 and once.count() == data.count()
    assert {r.paper_id: r.n_contexts for r in contexts.per_paper(bodies, contexts.contexts(contexts.hits(bodies, refs))).collect()}["q"] == 0


BIB = r"""\begin{thebibliography}{9}
% \bibitem{no} comment
\bibitem{plain} J. Smith, A title, \newblock \url{http://x} J. Stuff (2001).
\bibitem[S(2002)]{label} A.~Doe and B. Roe, \textbf{Other} title.
\bibitem[{X}]{group} {B. Ross}, Third \eprint{hep/1}.
\bibitem [mark]{no2}
\bibitem[M]{marked} \BibitemOpen \bibfield{author}{\bibinfo{author}{\bibfnamefont{K.}~\bibnamefont{{Kim}}}}, \href{u}{\bibinfo{title}{T}} \BibitemShut{x}
\bibitem odd
\bibitem{plain} J. Smith, Newer.
\end{thebibliography}"""


def test_bibitems(spark):
    df = spark.createDataFrame([("p", BIB), ("q", "none"), ("r", None)], "paper_id string, body string")
    rows = bibliography.bibitems(df, "body", ["paper_id"])
    got = {(r.cite_key, r.pos): r for r in rows.collect()}
    keys = [k for k, _ in sorted(got, key=lambda x: x[1])]
    assert keys == ["plain", "label", "group", "marked", "plain"]
    by = {k: r for (k, _), r in got.items() if k != "plain"}
    assert by["label"].author_ln == "Doe" and by["label"].info.endswith("Other title.")
    assert by["group"].author_ln == "Ross" and by["group"].target_id == "hep/1"
    assert by["marked"].author_ln == "Kim"
    merged = {r.cite_key: r for r in bibliography.merge([rows]).collect()}
    assert merged["plain"].info == "J. Smith, Newer." and len(merged) == 4


def test_bibtex(spark):
    text = '@string{acm = "ACM"} @comment{x} @article{k1, title = {{A {B} $x$ c}}, author = "Doe, J. and Roe, K", journal = acm # " Press"}\n@book{bad title} @misc(k2, title = "T2", author={Ann Smith})'
    assert dict(bibliography.parse_bibtex(text))["k1"]["journal"] == "ACM Press"
    df = spark.createDataFrame([(1, text), (2, None), (3, "@article{")], "p int, t string")
    got = {r.cite_key: (r.title, r.author_ln) for r in bibliography.bibtex(df, "t", ["p"]).collect()}
    assert got == {"k1": ("A B c", "Doe"), "k2": ("T2", "Smith")}
    assert {r.author_ln for r in bibliography.bibtex(df, "t", ["p"], with_author=False).collect()} == {None}


def tar(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for n, c in files.items():
            i = tarfile.TarInfo(n)
            i.size = len(c)
            t.addfile(i, io.BytesIO(c))
    return out.getvalue()


def test_archives_and_projects(spark):
    main = b"% \\documentclass{no}\r\n\\documentclass{a}\n\\input{sub/x}\\input{missing}\\input{main}\\cite{a,b}"
    rows = [("x/p1.tar", tar({"main.tex": main, "sub/x.TEX".replace("TEX", "tex"): "h\xe9 \\input{sub/y}".encode("latin-1"), "sub/y.tex": b"deep % gone", "../evil.tex": b"x", "fig.png": b"1"})), ("p2.tar", b"broken"), ("p3.tar", tar({"a.tex": b"\\documentstyle{a}", "b.tex": b"\\documentclass{b}"})), ("p4.tar", tar({"a.txt": b"x"})), ("p5.tar", None)]
    m = archives.untar(spark.createDataFrame(rows, "path string, content binary"))
    assert {r.paper_id for r in archives.failures(m).collect()} == {"p2", "p5"}
    ok = archives.members_of(m)
    assert not ok.where("path like '%evil%'").count()
    assert {r.paper_id: r.paths for r in projects.dropped_files(ok).collect()} == {"p1": ["fig.png"], "p4": ["a.txt"]}
    files = projects.source_files(ok).select("paper_id", "path", projects.decoded(F.col("content")).alias("text"))
    assert {r.paper_id: r.kept for r in projects.audit_mains(files).collect()} == {"p1": True, "p3": False}
    body = projects.bodies(files).collect()
    assert len(body) == 1 and "hé deep" in body[0].body and "\n\\cite{a}\n \n\\cite{b}\n" in body[0].body and "gone" not in body[0].body


def test_tables(spark, tmp_path):
    p = str(tmp_path / "t")
    assert tables.read_or_empty(spark, p, "a int").count() == 0
    tables.replace(spark.createDataFrame([(1,)], "a int"), p)
    tables.replace(tables.read_or_empty(spark, p, "a int").unionByName(spark.createDataFrame([(2,)], "a int")), p)
    assert sorted(r.a for r in spark.read.parquet(p).collect()) == [1, 2]
    (tmp_path / "j.json").write_text('{"id": "1", "title": "t"}\nbroken\n')
    got = tables.read_json_lines(spark, str(tmp_path / "j.json")).cache()
    assert got.where("_corrupt_record is not null").count() == 1 and got.where("id = '1'").count() == 1
    links = spark.createDataFrame([("u1", "f1"), ("bad", "f2")], "link string, file string")
    assert {r.path: r.error for r in tables.fetch(links, lambda u: b"x" if u == "u1" else 1 / 0, 0).collect()} == {"f1": None, "f2": "ZeroDivisionError"}


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 8)).round(2)
    v[5] = v[6]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(90, None), (91, [1.0]), (3, [float(x) for x in v[3]])]
    t = spark.createDataFrame(rows, "target long, vec array<double>")
    q = t.withColumnRenamed("target", "query")
    for metric, f in (("euclidean", lambda d: np.sqrt((d * d).sum(1))), ("squared_euclidean", lambda d: (d * d).sum(1)), ("manhattan", lambda d: np.abs(d).sum(1))):
        got = {}
        for r in evaluate.nearest(q, t, 5, metric, None, 8).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r["target"])
        for i in range(60):
            d = f(v - v[i]).round(9)
            want = sorted((x for x in range(60) if x != i), key=lambda x: (d[x], x))[:5]
            assert got[i] == want
    assert evaluate.nearest(q, t.limit(0), 5, "euclidean", None, 8).count() == 0


def test_accuracy_and_popularity(spark):
    t = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "target long, vec array<double>")
    p = spark.createDataFrame([(1, [0.0, 0.0], [3.0, 0.0]), (2, [9.0, 0.0], [9.0, 0.0])], "query long, vec array<double>, goal array<double>")
    acc = {k: evaluate.topk_accuracy(p, t, k, "euclidean", None, 2).first() for k in (3, 4)}
    assert acc[3].accuracy == 0.5 and acc[4].accuracy == 1.0
    same = evaluate.closer_targets(p, t, "squared_euclidean", None, 2).exceptAll(evaluate.closer_targets(p, t, "euclidean", np.array([4.0, 4.0]), 2))
    assert same.count() == 0
    data = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "a"), (5, "c")], "row_id long, target_id string")
    assert [r.target_id for r in evaluate.popular(data, 2).collect()] == ["a", "b"]
    s = evaluate.popularity_score(data, data, 1).first()
    assert (s.n, s.hits, s.percent) == (5, 2, 40.0)


def test_triplets_and_gradient(spark):
    data = spark.createDataFrame([(i, f"t{i % 4}" if i < 90 else "hot") for i in range(200)], "row_id long, target_id string")
    label = {r.row_id: r.target_id for r in data.collect()}
    got = learn.triplets(data, rings=4).collect()
    assert len(got) == 200
    for r in got:
        assert label[r.anchor] == label[r.positive] and label[r.anchor] != label[r.negative] and r.anchor != r.positive
    alone = learn.triplets(data.limit(1)).first()
    assert alone.positive == alone.anchor and alone.negative is None
    rng = np.random.default_rng(2)
    rows = [(i, *[[float(x) for x in rng.standard_normal(6)] for _ in range(3)]) for i in range(40)]
    v = spark.createDataFrame(rows, "anchor long, a array<double>, p array<double>, n array<double>")
    for metric in ("euclidean", "squared_euclidean", "manhattan"):
        w = rng.standard_normal(6) * 0.1
        n, loss, grad = learn.loss_and_gradient(v, w, 0.6, metric)
        assert n == 40
        e = np.zeros(6)
        e[2] = 1e-5
        up, down = learn.loss_and_gradient(v, w + e, 0.6, metric)[1], learn.loss_and_gradient(v, w - e, 0.6, metric)[1]
        assert grad[2] == pytest.approx((up - down) / 2e-5, abs=1e-4)
    params, log = learn.train(v, 6, 5)
    losses = [r.loss for r in log.orderBy("epoch").collect()]
    assert losses[-1] < losses[0] and len(params) == 6
    assert learn.loss_and_gradient(v.limit(0), np.zeros(6), 0.6, "euclidean")[0] == 0


def test_search_and_statistics(spark):
    first = search.run(spark, lambda p: iter([p["margin"]]), 3)
    again = search.run(spark, lambda p: iter([p["margin"]]), 5, first)
    assert again.count() == 5 and first.exceptAll(again).count() == 0
    assert stats.best_trials(again).agg(F.sum("n_trials")).first()[0] == 5
    assert stats.history(again).count() == 5 and stats.importance(again, ["margin"]).first().importance == pytest.approx(1.0)
    w = stats.wilcoxon(spark.createDataFrame(stats.PAIRED_SCORES, "x int, y int")).first()
    assert (w.n, w.w_plus, w.w_minus) == (12, 62.0, 16.0) and w.p_value == pytest.approx(0.0578, abs=1e-4) and not w.significant
    assert stats.wilcoxon(spark.createDataFrame([(1, 1)], "x int, y int")).first().p_value == 1.0
    m = stats.prefix_mean(spark.createDataFrame([(i, float(i)) for i in range(50)], "k int, v double"), "k", "v", F.floor(F.col("k") / 7)).orderBy("k").collect()
    assert [r.prefix_mean for r in m] == pytest.approx([i / 2 for i in range(50)])


def test_slots_and_embedding(spark):
    slots = evaluate.balanced_slots(spark.createDataFrame([(1,), (2,)], "context_no long")).collect()
    assert len(slots) == 20 and {(r.context_no, r.model_no, r["rank"]) for r in slots} == {(c, m, k) for c in (1, 2) for m in (1, 2) for k in range(1, 6)}
    df = spark.createDataFrame([(1, "a text"), (2, "a text"), (3, None), (4, "")], "row_id long, context string")
    got = {r.row_id: r.v for r in embedding.encode(df, "context", "v").collect()}
    assert got[1] == got[2] and got[3] is None and len(got[4]) == 768
    data = spark.createDataFrame([(1, "s", "t", "abcdef"), (2, "s", "u", "x")], "row_id long, source_id string, target_id string, context string")
    abs_ = spark.createDataFrame([("t", "A")], "id string, abstract string")
    assert embedding.pair(data, abs_, 3).first().context == "def" and embedding.pair(data, abs_, 3, from_end=False).first().context == "abc"
    with pytest.raises(ValueError):
        embedding.pair(data, abs_, 3, strict=True)


def test_a_broken_replacement_is_mended(spark, tmp_path):
    at, schema = str(tmp_path / "t"), "k int"
    write = lambda k, to: spark.createDataFrame([(k,)], schema).write.parquet(to)
    keys = lambda: sorted(r.k for r in tables.read_or_empty(spark, at, schema).collect())
    write(1, at + ".old")  # broke off after the first rename, before the new table was whole
    assert keys() == [1]
    (tmp_path / "t").rename(tmp_path / "t.old")
    write(2, at + ".new")  # broke off between the renames
    assert keys() == [2]
    tables.replace(tables.read_or_empty(spark, at, schema).unionByName(spark.createDataFrame([(3,)], schema)), at)
    assert keys() == [2, 3]
    tables.delete(spark, at)
    assert keys() == []


def test_training_in_batches_goes_on_where_it_was(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *[[float(x) for x in rng.standard_normal(6)] for _ in range(3)]) for i in range(200)]
    v = spark.createDataFrame(rows, "anchor long, a array<double>, p array<double>, n array<double>")
    whole, log = learn.train(v, 6, 4, batch=32, evaluate=lambda w: float(w.sum()), eval_every=2)
    half, first = learn.train(v, 6, 2, batch=32)
    rest, second = learn.train(v, 6, 2, batch=32, start=first)
    assert rest == pytest.approx(whole) and [r.epoch for r in second.orderBy("epoch").collect()] == [2, 3]
    assert [r.accuracy is not None for r in log.orderBy("epoch").collect()] == [False, True, False, True]
    assert learn.loss_and_gradient(v, whole, 0.6, "euclidean")[1] < learn.loss_and_gradient(v, np.zeros(6), 0.6, "euclidean")[1]
    many, _ = learn.train(v, 6, 2, batch=16, workers=3)
    assert np.isfinite(many).all()
    assert learn.train(v.limit(0), 6, 1)[0] == pytest.approx(np.zeros(6))


def test_a_stored_study_goes_on(spark, tmp_path):
    at, seen = str(tmp_path / "study"), []
    objective = lambda p: iter([seen.append(p) or p["margin"]])
    search.run(spark, objective, 2, path=at)
    assert search.run(spark, objective, 3, path=at).count() == 3 and len(seen) == 3
    assert search.study(spark, at).count() == 3 and search.study(spark, at, continue_existing=False).count() == 0


def test_metrics_have_one_registry():
    from marginalia.functions import vectors

    a, b, w = np.array([[0.0, 1.0]]), np.array([[3.0, 5.0], [0.0, 1.0]]), np.array([1.0, 2.0])
    with pytest.raises(ValueError):
        vectors.kernel("other", a, b, w)
    vectors.METRICS["cubic"] = vectors.Metric(lambda d: F.abs(d * d * d), lambda d: np.abs(d**3))
    try:
        assert vectors.kernel("cubic", a, b, w).tolist() == [[27.0 + 128.0, 0.0]]
        assert learn.distances("cubic", a, b[:1], w)[0].tolist() == [155.0]
    finally:
        del vectors.METRICS["cubic"]


def test_nearest_equals_brute_force_with_ties(spark):
    from marginalia.functions import vectors

    rng = np.random.default_rng(8)
    v = np.round(rng.standard_normal((120, 4)), 1)
    v[50:60] = v[40]
    rows = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "target long, vec array<double>")
    for metric in vectors.METRICS:
        d = np.round(vectors.kernel(metric, v, v, np.ones(4)), 9)
        np.fill_diagonal(d, np.inf)
        want = {i: np.lexsort((np.arange(120), d[i]))[:7].tolist() for i in range(120)}
        got = {}
        for r in evaluate.nearest(rows.withColumnRenamed("target", "query"), rows, 7, metric, width=4).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append(r.target)
        assert got == want


def test_deep_inputs_are_named(spark):
    files = spark.createDataFrame([("p", "main.tex", "\\documentclass{a}\\input{b}")] + [("p", f"{a}.tex", f"{a}\\input{{{b}}}") for a, b in zip("bcd", "cde")] + [("p", "e.tex", "e")], "paper_id string, path string, text string")
    assert projects.bodies(files).first().body.endswith("bcde")
    assert projects.bodies(files, 3).first().body.endswith("bc") and [r.path for r in projects.too_deep(files, 3).collect()] == ["d.tex"]
    assert projects.too_deep(files).count() == 0
