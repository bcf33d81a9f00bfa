"""Queries of the core operators over whole tables, and the SQL they are held against.

Where the reference's own inputs (LaTeX projects, archives) are not among the
tables, a query builds them row by row from a table, so that what must come out is known.
"""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import authors, latex, spans, vectors
from marginalia.functions.similarity import lcs_ratio
from marginalia.operators import bibliography, catalogue, contexts, embedding, evaluate, learn, matching, projects, search, stats
from marginalia.operators.packed import explode_packed
from marginalia.plans.running import numbered, positions
from marginalia.plans.runtime import materialize, shared_dir, table
from marginalia.sources import archives, tables
from marginalia.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def p4_found(s: SparkSession, d: str) -> DataFrame:
    return explode_packed(table(s, d, "catalogue_raw"), ["row_id"], {"authors": "names", "categories": "codes"})


# catalogue


@query("select row_id, id from catalogue_raw where contains(categories, 'math') or contains(categories, 'stat')")
def category_filter(s, d):
    return catalogue.in_categories(table(s, d, "catalogue_raw"), ["math", "stat"]).select("row_id", "id")


_LATEST = "select * from catalogue_raw qualify row_number() over (partition by id order by loaded_at desc nulls last, row_id desc) = 1"


@query(f"select id, row_id, title, categories from ({_LATEST})")
def catalogue_latest(s, d):
    return catalogue.last_wins(table(s, d, "catalogue_raw"), ["id"], ["loaded_at", "row_id"]).select("id", "row_id", "title", "categories")


#: Signs that end a command name, and RE2 forms of the equations and of all white space.
_B = r""" {}"'´`\_^"""
_EQ = r"\$\$(?s:.*?)(?:\$\$|\z)|\$[^$]+(?:\$|\z)"
_BLANK = r"[\s\x0b\x{85}\p{Z}]+"


def _sql_collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, '{_BLANK}', ' ', 'g'))"


def _sql_without_equations(t: str) -> str:
    """An escaped dollar sign opens none, so it is put out of the way first."""
    return rf"replace(regexp_replace(replace({t}, '\$', '\' || chr(2)), '{_EQ}', '', 'g'), chr(2), '$')"


def _sql_without_commands(rows: str, column: str) -> str:
    """rows with column ``column_f1``: the text cut at equations and command names, each name judged by the sign behind it."""
    signs = "".join("\\" + c if c in "\\^" else c for c in _B).replace("'", "''")
    cut = rf"'{_EQ}|\\[^{signs}]*'"
    text = rf"replace(regexp_replace(regexp_replace({column}, 'et~al\.|\n', ' ', 'g'), '[''`´]', '', 'g'), '\$', '\' || chr(2))"
    command = lambda i: rf"(left(k[{i}], 1) = '\')"
    behind = lambda i: f"(case when b[{i} + 1] <> '' then left(b[{i} + 1], 1) when {i} = len(k) then '' else '\\' end)"
    name = f"case when i > len(k) then '' when not {command('i')} then k[i] when {behind('i')} in ('\\', '}}', '_', '^') then substring(k[i], 2) else '' end"
    between = f"case when i > 1 and {command('(i - 1)')} and {behind('(i - 1)')} in (' ', '\"') then substring(b[i], 2) else b[i] end"
    joined = f"array_to_string(list_transform(range(1, len(k) + 2), lambda i: {between} || {name}), '')"
    return f"""select *, trim(regexp_replace(replace({joined}, chr(2), '$'), '[{{}}]', '', 'g')) as {column}_f1
from (select *, regexp_extract_all(t_, {cut}) as k, regexp_split_to_array(t_, {cut}) as b from (select *, {text} as t_ from ({rows})))"""


_NAMED = _sql_without_commands(f"select id, coalesce(title, '') as title, coalesce(authors, '') as authors, coalesce(update_date, '') as update_date from ({_LATEST})", "title")
_CLEAN = _sql_without_commands(f"select id, title_f1, authors, update_date from ({_NAMED})", "authors")


@query(f"""select id, {_sql_collapse('authors_f1')} || '. ' || {_sql_collapse('title_f1')} || '. ' || update_date as info, {_sql_collapse(_sql_without_equations('title_f1'))} as title,
{_sql_collapse('authors_f1')} as authors from ({_CLEAN})""")
def catalogue_build(s, d):
    return catalogue.build(table(s, d, "catalogue_raw"))


@query()
def abstract_build(s, d):
    return catalogue.abstracts(table(s, d, "catalogue_raw"))


@query("select id, row_number() over (order by md5('42:' || id), id) - 1 as pos from catalogue")
def seeded_shuffle(s, d):
    return catalogue.shuffled(table(s, d, "catalogue").select("id"), "id").select("id", F.col("pos").cast("long").alias("pos"))


@query("with p as (select id, row_number() over (order by md5('42:' || id), id) - 1 as pos from catalogue) select pos // 100 as round, count(*) as n, min(id) as first_id from p group by 1")
def batch_windows(s, d):
    ids = table(s, d, "catalogue").select("id")
    placed = catalogue.windows(catalogue.shuffled(ids, "id"), 0, ids.count(), 100)
    return placed.groupBy(F.col("round").cast("long").alias("round")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("select id, 'https://example.org/e-print/' || id as link, replace(id, '/', '_slash') || '.tar' as file from catalogue")
def source_links(s, d):
    return catalogue.source_links(table(s, d, "catalogue"), "https://example.org/e-print/")


@query("select distinct source_id, replace(source_id, '_slash', '/') as id from dataset")
def file_ids(s, d):
    return table(s, d, "dataset").select("source_id", catalogue.article_id(F.col("source_id")).alias("id")).distinct()


@query(r"""select distinct case when m <> '' then lower(m) else a end as last_name, id from (
  select id, a, regexp_extract(a, '[\p{L}\p{M}\p{N}_]+$') as m from (
    select id, trim(unnest(regexp_split_to_array(regexp_replace(authors, '\s*\([^()]*\)', '', 'g'), ',|\s+and\s+|;'))) as a
    from catalogue where authors is not null) where a <> '')""")
def author_index(s, d):
    return catalogue.author_index(table(s, d, "catalogue"))


# references


@query("select ref_id, list_filter(string_split(info, ';'), lambda x: length(x) = list_max(list_transform(string_split(info, ';'), lambda y: length(y))))[1] as segment from refs where info is not null")
def longest_segment(s, d):
    return table(s, d, "refs").where("info is not null").select("ref_id", authors.longest_segment(F.col("info")).alias("segment"))


@query(r"""select ref_id, case when length(w) > 1 then w end as author from (select ref_id, string_split(string_split(split_part(regexp_replace(h, '^(?:.?[ .~-])+', ''), '.', 1), ' ')[-1], '~')[-1] as w
from (select ref_id, case when strpos(h, '~') > 0 and not contains(substring(h, 1, strpos(h, '~')), '\url') then substring(h, strpos(h, '~') + 1) else h end as h
from (select ref_id, split_part(split_part(info, ',', 1), ' and ', 1) as h from refs where info is not null)))""")
def first_authors(s, d):
    return table(s, d, "refs").where("info is not null").select("ref_id", authors.first_author_of_entry(F.col("info")).alias("author"))


@query("""with recursive n as (select distinct p_name as s from part where p_name is not null),
p as (select a.s as a, b.s as b from n a, n b where a.s <> b.s and regexp_extract(a.s, '[a-z]+$') = regexp_extract(b.s, '[a-z]+$')),
dp as (select a, b, 0 as j, list_transform(range(0, length(a) + 1), lambda i: 0::bigint) as r from p
  union all
  select a, b, j + 1, list_transform(range(0, length(a) + 1), lambda i: list_max(list_transform(range(0, i + 1), lambda k: greatest(r[k + 1],
    case when k > 0 and substring(a, k, 1) = substring(b, j + 1, 1) then r[k] + 1 else 0 end)))) from dp where j < length(b)),
sc as (select a, b, 200.0 * r[length(a) + 1] / (length(a) + length(b)) as score from dp where j = length(b))
select a, b, round(score, 6) as score from sc qualify row_number() over (partition by a order by score desc, b) = 1""")
def fuzzy_parts(s, d):
    names = table(s, d, "part").where("p_name is not null").select(F.col("p_name").alias("a")).distinct().withColumn("w", F.regexp_extract("a", "[a-z]+$", 0))
    pairs = names.join(names.select(F.col("a").alias("b"), "w"), "w").where("a <> b").withColumn("score", lcs_ratio("a", "b"))
    best = pairs.groupBy("a").agg(F.min_by(F.struct("b", "score"), F.struct(-F.col("score"), "b")).alias("m"))
    return best.select("a", "m.b", F.round("m.score", 6).alias("score"))


_LCS = """with recursive l as (select distinct p_name as s from part where p_name is not null), p as (select a.a, b.s as b from (select distinct replace(s, 'a', '') as a, regexp_extract(s, '[a-z]+$') as w from l) a join l b on regexp_extract(b.s, '[a-z]+$') = a.w),
dp as (select a, b, 0 as j, list_transform(range(0, length(a) + 1), lambda i: 0::bigint) as r from p
  union all
  select a, b, j + 1, list_transform(range(0, length(a) + 1), lambda i: list_max(list_transform(range(0, i + 1), lambda k: greatest(r[k + 1],
    case when k > 0 and substring(a, k, 1) = substring(b, j + 1, 1) then r[k] + 1 else 0 end)))) from dp where j < length(b)),
sc as (select a, b, 200.0 * r[length(a) + 1] / (length(a) + length(b)) as score from dp where j = length(b)),"""


@query(_LCS + """ k as (select p_partkey, replace(p_name, 'a', '') as a, regexp_extract(p_name, '[a-z]+$') as w from part where p_name is not null),
m as (select k.p_partkey as part, t.p_partkey as target, score from k join sc on k.a = sc.a join part t on t.p_name = sc.b and regexp_extract(t.p_name, '[a-z]+$') = k.w where score >= 77.5)
select part, target, round(score, 6) as score from m qualify row_number() over (partition by part order by score desc, target) = 1""")
def best_parts(s, d):
    parts = table(s, d, "part").where("p_name is not null").withColumn("w", F.regexp_extract("p_name", "[a-z]+$", 0))
    left = parts.select("w", F.col("p_partkey").alias("part"), F.replace("p_name", F.lit("a"), F.lit("")).alias("a"))
    got = matching.best_match(left, parts.select("w", F.col("p_partkey").alias("target"), F.col("p_name").alias("b")), "w", "part", "target", "a", "b")
    return got.select("part", "target", F.round("score", 6).alias("score"))


@query()
def reference_matches(s, d):
    return matching.match_references(table(s, d, "refs"), table(s, d, "catalogue")).select("ref_id", "target_id", "score")


@query()
def match_counts(s, d):
    return matching.match_counts(matching.match_references(table(s, d, "refs"), table(s, d, "catalogue")))


@query("select paper_id, cite_key, max(ref_id) as ref_id, count(*) as n from refs group by 1, 2")
def merged_references(s, d):
    refs = table(s, d, "refs")
    last = bibliography.merge([refs.select("paper_id", "cite_key", "ref_id", F.col("ref_id").alias("pos"))]).select("paper_id", "cite_key", "ref_id")
    return last.join(refs.groupBy("paper_id", "cite_key").agg(F.count(F.lit(1)).alias("n")), ["paper_id", "cite_key"])


# contexts

_HITS = f"""with k as (select paper_id, cite_key, max(target_id) as target_id from refs where cite_key <> '' group by 1, 2),
h as (select b.paper_id, b.body_id, k.cite_key, b.body, string_split(b.body, k.cite_key) as parts from bodies b join k on b.paper_id = k.paper_id where contains(b.body, k.cite_key)),
o as (select *, unnest(range(1, len(parts))) as i from h),
p as (select paper_id, body_id, cite_key, body, list_sum(list_transform(parts[1:i], lambda x: length(x)))::bigint + (i - 1) * length(cite_key) as place from o),
c as (select paper_id, body_id, cite_key, place, right(trim(regexp_replace(substring(body, greatest(place - 5000, 0) + 1, least(place, 5000)), '[ \t\n\r]+', ' ', 'g')), 1000) as context from p),
z as (select * from c where (length(context) - length(translate(context, '{spans.SYMBOLS}', ''))) * 10 < length(context))"""


def _plain_contexts(s, d):
    found = contexts.hits(table(s, d, "bodies"), table(s, d, "refs"))
    text = F.trim(F.regexp_replace(spans.before(F.col("body"), F.col("at"), contexts.LOOK_BACK), "[ \t\n\r]+", " "))
    return contexts.contexts(found, clean=text)


@query(_HITS + " select paper_id, body_id, cite_key, place, context from z")
def ctx_extract(s, d):
    return _plain_contexts(s, d).select("paper_id", "body_id", "cite_key", F.col("at").cast("long").alias("place"), "context")


@query(_HITS + ", n as (select paper_id, count(*) as n from z group by 1) select b.paper_id, coalesce(n.n, 0) as n_contexts from (select distinct paper_id from bodies) b left join n on b.paper_id = n.paper_id")
def ctx_per_paper(s, d):
    return contexts.per_paper(table(s, d, "bodies"), _plain_contexts(s, d))


@query(_HITS.replace("from refs where cite_key <> ''", "from refs where cite_key <> '' and target_id <> ''").replace("select paper_id, body_id, cite_key, body, list_sum", "select paper_id, body_id, cite_key, target_id, body, list_sum").replace("select b.paper_id, b.body_id, k.cite_key,", "select b.paper_id, b.body_id, k.cite_key, k.target_id,").replace("c as (select paper_id,", "c as (select target_id, paper_id,") + " select distinct paper_id as source_id, target_id, context from z")
def ctx_matched(s, d):
    text = F.trim(F.regexp_replace(spans.before(F.col("body"), F.col("at"), contexts.LOOK_BACK), "[ \t\n\r]+", " "))
    return contexts.dataset(table(s, d, "bodies"), table(s, d, "refs"), clean=text)


@query()
def ctx_dataset(s, d):
    return contexts.dataset(table(s, d, "bodies"), table(s, d, "refs").withColumn("target_id", F.coalesce("target_id", F.lit("unknown"))))


@query(f"select doc_id, length(text) - length(translate(text, '{spans.SYMBOLS}', '')) as symbols, (length(text) - length(translate(text, '{spans.SYMBOLS}', ''))) * 10 >= length(text) as dense from documents where text is not null")
def density_filter(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", spans.symbols(F.col("text")).cast("long").alias("symbols"), spans.too_dense(F.col("text")).alias("dense"))


@query("select row_id, left(context, 100) as head, right(context, 100) as tail from dataset where context is not null")
def context_cuts(s, d):
    return table(s, d, "dataset").where("context is not null").select("row_id", spans.head(F.col("context"), 100).alias("head"), spans.tail(F.col("context"), 100).alias("tail"))


# the dataset as a set


@query("select distinct source_id, target_id, context from dataset")
def dedupe(s, d):
    return table(s, d, "dataset").select("source_id", "target_id", "context").distinct()


@query("""with n as (select count(*) as n from dataset), e as (select * from dataset, n where row_id <= n // 2)
select source_id, target_id, context from e union select source_id, target_id, context from dataset where source_id not in (select source_id from e)""")
def incremental_update(s, d):
    data = table(s, d, "dataset")
    return contexts.update(data.where(F.col("row_id") <= data.count() // 2), data)


@query("select distinct paper_id from bodies where paper_id in (select paper_id from refs)")
def semi_surviving(s, d):
    return table(s, d, "bodies").select("paper_id").distinct().join(table(s, d, "refs"), "paper_id", "left_semi")


@query("select id from catalogue where id not in (select target_id from dataset)")
def anti_uncited(s, d):
    return table(s, d, "catalogue").select("id").join(table(s, d, "dataset").select(F.col("target_id").alias("id")), "id", "left_anti")


@query(f"select d.row_id, d.source_id, d.target_id, right(d.context, 500) as context, a.abstract from dataset d join ({_LATEST}) a on d.target_id = a.id")
def embedding_pairs(s, d):
    latest = catalogue.last_wins(table(s, d, "catalogue_raw"), ["id"], ["loaded_at", "row_id"]).select("id", "abstract")
    return embedding.pair(table(s, d, "dataset"), latest, 500)


@query()
def embedded_contexts(s, d):
    return embedding.encode(table(s, d, "dataset").select("row_id", "context"), "context", "ctx_vec")


@query("select distinct ctx_id as vec_id, 'context' as kind, target_id from embedded union select distinct abs_id, 'article', target_id from embedded")
def reverse_map(s, d):
    return embedding.reverse_map(table(s, d, "embedded"))


# LaTeX


@query(r"select body_id, regexp_replace(body, '(\\(?:cite|footcite|citep|citet)\{[^}\n]*\})', chr(10) || '\1' || chr(10), 'g') as text from bodies where body is not null")
def isolate_cites(s, d):
    return table(s, d, "bodies").where("body is not null").select("body_id", latex.isolate_cites(F.col("body")).alias("text"))


@query(r"select ref_id, 'See \citet{' || cite_key || '} \citet{' || paper_id || '} here' as text from refs")
def split_cites(s, d):
    text = F.concat(F.lit("See \\citet{"), "cite_key", F.lit(" ,"), "paper_id", F.lit("} here"))
    return table(s, d, "refs").select("ref_id", latex.split_cites(text).alias("text"))


@query(r"select id, regexp_replace(title || ' % note' || chr(10) || '50\% kept%', '(^|[^\\])%[^\n]*', '\1', 'g') as text from catalogue where title is not null")
def latex_comments(s, d):
    text = F.concat("title", F.lit(" % note\n50\\% kept%"))
    return table(s, d, "catalogue").where("title is not null").select("id", latex.remove_comments(text).alias("text"))


@query("select id, title || ' a b' as text from catalogue where title is not null")
def equation_removal(s, d):
    text = F.concat("title", F.lit(" a$x_1$ $$y$$b"))
    return table(s, d, "catalogue").where("title is not null").select("id", latex.remove_equations(text).alias("text"))


# text, without commands, as plain context
_CASES = [
    (r"\textbf{Foo} bar", "Foo bar", "Foo bar"), (r"Schr\"odinger x", "Schrodinger x", 'Schr"odinger x'), (r"Andr\'e Weil", "AndrWeil", "Andr'e Weil"), (r"a $x_1$ b $$y$$ c", "a $x_1$ b $$y$$ c", "a b c"),
    (r"cost \$5 and $z", "cost and $z", "cost and"), (r"see \alpha_s \cite{", "see alpha_s", "see alpha_s"), (r"a \foo", "a", "a"), (r"$\alpha$ \beta c", r"$\alpha$ c", "c"), ("a$", "a$", "a$"),
]


def _sql_cases() -> str:
    quoted = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in c[1:]) + f", {i})" for i, c in enumerate(_CASES))
    return f"select id, i, word || ' ' || f1 as commands_removed, word || ' ' || f2 as plain from (select id, regexp_replace(id, '[^a-zA-Z0-9]', '', 'g') as word from catalogue), (values {quoted}) t(f1, f2, i)"


@query(_sql_cases())
def latex_cases(s, d):
    cases = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c[0]).alias("text")) for i, c in enumerate(_CASES)])
    rows = table(s, d, "catalogue").select("id", F.explode(cases).alias("c")).select("id", "c.i", F.concat_ws(" ", F.regexp_replace("id", "[^a-zA-Z0-9]", ""), F.col("c.text")).alias("text"))
    return rows.select("id", "i", latex.remove_commands(F.col("text")).alias("commands_removed"), latex.plain_context(F.col("text")).alias("plain"))


@query()
def latex_clean(s, d):
    text = F.col("abstract")
    return table(s, d, "catalogue_raw").select("row_id", latex.remove_commands(text).alias("commands_removed"), latex.plain_context(text).alias("plain"))


@query("select body_id, body || ' tail' as text from bodies where body is not null")
def bibliography_cut(s, d):
    text = F.concat("body", F.lit("\\begin{thebibliography}{9}\n\\bibitem{a} X.\n\\end{thebibliography} tail"))
    return table(s, d, "bodies").where("body is not null").select("body_id", latex.without_bibliography(text).alias("text"))


@query("select ref_id, cite_key from refs where info is not null")
def bibitem_keys(s, d):
    text = F.concat(F.lit("\\begin{thebibliography}{9}\n"), bibliography.item_text(F.col("cite_key"), F.regexp_replace("info", r"[\\{}%]", "")), F.lit("\\end{thebibliography}"))
    return bibliography.bibitems(table(s, d, "refs").where("info is not null").select("ref_id", text.alias("bib")), "bib", ["ref_id"]).select("ref_id", "cite_key")


# one item for each way in which an item is read: text behind \bibitem, cite key, info, e-print number; N stands for the name, W for its last word
_ITEMS = [
    (r"{plain} J. W, N.", "plain", "J. W, N.", None),
    (r"[W(2001)]{label} A.~W and B. Roe, \textbf{N} title.", "label", "A.~W and B. Roe, N title.", None),
    (r"[x]{group} {B. W}, N", "group", "B. W, N", None),
    (r"[x]{marked}\BibitemOpen \bibfield{author}{\bibinfo{author}{\bibfnamefont{C.}~\bibnamefont{W}}}, \bibinfo{title}{N}, \href{http://x/y}{Z} \BibitemShut{Stop}", "marked", "C.~W, N, Z", None),
    (r"{blocks} D. W, \newblock N \url{http://x/y}", "blocks", "D. W, N", None),
    (r"[x]{eprint} {E. W}, N \eprint{hep/1}", "eprint", "E. W, N hep/1", "hep/1"),
]
_ITEM_ROWS = ", ".join(f"('{k}', '{i}', {repr(e) if e else 'null'})" for _, k, i, e in _ITEMS)


@query(f"""select p_partkey, cite_key, replace(replace(info, 'W', w), 'N', p_name) as info, w as author_ln, target_id
from (select p_partkey, p_name, regexp_extract(p_name, '[a-z]+$') as w from part where p_name is not null), (values {_ITEM_ROWS}) t(cite_key, info, target_id)""")
def bibitem_records(s, d):
    named = table(s, d, "part").where("p_name is not null").withColumn("w", F.regexp_extract("p_name", "[a-z]+$", 0))
    text = F.concat(F.lit("\\begin{thebibliography}{9}\n\\providecommand{\\x}[1]{#1}\n% \\bibitem{no} none\n"), *[F.lit("\\bibitem" + t + "\n") for t, *_ in _ITEMS], F.lit("\\end{thebibliography}"))
    text = F.regexp_replace(F.regexp_replace(text, r"\bW\b", "\ue000"), r"\bN\b", "\ue001")
    rows = named.select("p_partkey", F.replace(F.replace(text, F.lit("\ue000"), F.col("w")), F.lit("\ue001"), F.col("p_name")).alias("bib"))
    return bibliography.bibitems(rows, "bib", ["p_partkey"]).select("p_partkey", "cite_key", "info", "author_ln", "target_id")


@query("select p_partkey, 'k' || p_partkey as cite_key, p_name as title, lower(p_brand) as author_ln from part where p_name is not null")
def parse_bibtex(s, d):
    text = F.concat(F.lit("@article{k"), "p_partkey", F.lit(", title = {{"), "p_name", F.lit('}}, author = "'), F.lower("p_brand"), F.lit(', A. and B, C", year = 2001}'))
    rows = bibliography.bibtex(table(s, d, "part").where("p_name is not null").select("p_partkey", text.alias("bib")), "bib", ["p_partkey"])
    return rows.select("p_partkey", "cite_key", "title", "author_ln")


# projects


def _archives(s, d) -> DataFrame:
    """One archive for each body, with a main file that puts the body in, and a picture."""
    files = _files({"main.tex": F.lit("\\documentclass{a}\n\\input{parts/body}"), "parts/body.tex": F.col("body"), "plot.png": F.lit("x")})
    return _packed(table(s, d, "bodies").where("body is not null").select(F.concat("body_id", F.lit(".tar")).alias("path"), files.alias("files")))


def _files(texts: dict[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), t.alias("text")) for n, t in texts.items()])


def _packed(projects_: DataFrame) -> DataFrame:
    """``(path, content)``: a tar file of the files ``(name, text)`` of each row."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, files in zip(b["path"], b["files"]):
                out = io.BytesIO()
                with tarfile.open(fileobj=out, mode="w") as t:
                    for name, content in (x.values() if isinstance(x, dict) else x for x in files):
                        raw = content.encode("iso-8859-1", "replace")
                        info = tarfile.TarInfo(name)
                        info.size = len(raw)
                        t.addfile(info, io.BytesIO(raw))
                rows.append((path, out.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return projects_.mapInPandas(pack, "path string, content binary")


@query("select b.body_id::varchar as paper_id, m.path, case when m.path = 'plot.png' then 1 else 0 end as dropped from bodies b, (values ('main.tex'), ('parts/body.tex'), ('plot.png')) m(path) where b.body is not null")
def untar_members(s, d):
    members = archives.members_of(archives.untar(_archives(s, d)))
    kept = projects.source_files(members).select("paper_id", "path", F.lit(1).alias("kept"))
    return members.select("paper_id", "path").join(kept, ["paper_id", "path"], "left").select("paper_id", "path", F.when(F.col("kept") == 1, 0).otherwise(1).alias("dropped"))


@query("select body_id::varchar as paper_id, 1 as n_mains, true as kept from bodies where body is not null")
def main_file_audit(s, d):
    files = projects.source_files(archives.members_of(archives.untar(_archives(s, d)))).select("paper_id", "path", projects.decoded(F.col("content")).alias("text"))
    return projects.audit_mains(files)


_CITE = r"\\(?:cite|footcite|citep|citet)\{[^}\n]*\}"
_SPLIT = "array_to_string(list_transform(string_split(regexp_extract(c, '\\{([^}]*)\\}', 1), ','), lambda k: chr(10) || regexp_extract(c, '^[^{]*') || '{' || trim(k) || '}' || chr(10)), ' ')"


@query(rf"""with b as (select body_id, '\documentclass{{a}}' || chr(10) || regexp_replace(regexp_replace(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[^\x{{0}}-\x{{ff}}]', '?', 'g'), '(^|[^\\])%[^\n]*', '\1', 'g') as t from bodies where body is not null),
p as (select body_id, regexp_extract_all(t, '{_CITE}') as f, regexp_split_to_array(t, '{_CITE}') as g from b)
select body_id::varchar as paper_id, array_to_string(list_transform(range(1, len(f) + 2), lambda i: g[i] || case when i > len(f) then '' else array_to_string(list_transform([f[i]], lambda c: {_SPLIT}), '') end), '') as body from p""")
def project_bodies(s, d):
    files = projects.source_files(archives.members_of(archives.untar(_archives(s, d)))).select("paper_id", "path", projects.decoded(F.col("content")).alias("text"))
    return projects.bodies(files)


# archives to dataset: each article is made a project that cites the article by an item and by an entry of a file
_MADE = "select id, replace(id, '/', '_slash') as paper_id, trim(regexp_replace(title, '[^a-zA-Z]+', ' ', 'g')) as name from catalogue where title is not null"


@query(f"""with m as (select * from ({_MADE}) where length(name) > 10)
select paper_id as source_id, id as target_id, unnest(['a document Words about ' || name || ' are given', 'a document Words about ' || name || ' are given and again']) as context from m""")
def pipeline_dataset(s, d):
    made = table(s, d, "catalogue").where("title is not null").select("id", catalogue.file_id(F.col("id")).alias("paper_id"), F.trim(F.regexp_replace("title", "[^a-zA-Z]+", " ")).alias("name")).where(F.length("name") > 10)
    made = made.withColumn("last", F.concat(F.lit("Zz"), F.regexp_replace("id", "[^0-9a-zA-Z]", "_")))
    main = F.lit("\\documentclass{a} % a comment\n\\begin{document}\n\\input{text}\n\\input{refs.bbl}\n\\end{document}")
    text = F.concat(F.lit("Words about "), "name", F.lit(" are given \\cite{k1, k2} and again \\citep{k2}."))
    items = F.concat(F.lit("\\begin{thebibliography}{9}\n\\bibitem{k1} A. "), "last", F.lit(", "), "name", F.lit(".\n\\end{thebibliography}"))
    entries = F.concat(F.lit("@article{k2, title = {"), "name", F.lit("}, author = {A. "), "last", F.lit("}}"))
    files = _files({"main.tex": main, "text.tex": text, "refs.bbl": items, "more.bib": entries, "plot.png": F.lit("x")})
    unpacked = archives.members_of(archives.untar(_packed(made.select(F.concat("paper_id", F.lit(".tar")).alias("path"), files.alias("files")))))
    sources = materialize(projects.source_files(unpacked).select("paper_id", "path", projects.decoded(F.col("content")).alias("text")), "sources")
    whole = projects.bodies(sources)
    listed = bibliography.bibitems(whole, "body", ["paper_id"])
    filed = bibliography.bibtex(sources.where(F.lower("path").endswith(".bib")), "text", ["paper_id"])
    refs = bibliography.merge([filed, listed]).withColumn("ref_id", F.xxhash64("paper_id", "cite_key"))
    articles = made.select("id", F.col("name").alias("title"), F.concat(F.lit("A. "), "last", F.lit(", "), "name", F.lit(".")).alias("info"), F.concat(F.lit("A. "), "last").alias("authors"))
    matched = matching.match_references(refs, articles)
    bodies = whole.select("paper_id", F.xxhash64("paper_id").alias("body_id"), latex.without_bibliography(F.col("body")).alias("body"))
    data = contexts.dataset(bodies, matched)
    return contexts.update(s.createDataFrame([], ingest.DATASET), data)


# vectors

_STEP = {"euclidean": "g * g", "squared_euclidean": "g * g", "manhattan": "abs(g)"}


def _sql_distance(metric: str, a: str, b: str) -> str:
    f = "(z[1]::double - z[2]::double)"
    part = f"abs({f})" if metric == "manhattan" else f"{f} * {f}"
    total = f"list_sum(list_transform(list_zip({a}, {b}), lambda z: {part}))"
    return f"sqrt({total})" if metric == "euclidean" else total


def _sql_knn(metric: str) -> str:
    return f"""with d as (select q.vec_id as query, t.vec_id as target, round({_sql_distance(metric, 'q.embedding', 't.embedding')}, 9) as distance
from embeddings q join embeddings t on q.vec_id <> t.vec_id where q.vec_id % 20 = 0)
select query, row_number() over (partition by query order by distance, target) as rank, target, round(distance, 6) as distance from d qualify rank <= 5"""


def _knn(s, d, metric):
    e = table(s, d, "embeddings")
    near = evaluate.nearest(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("target"), F.col("embedding").alias("vec")), 5, metric)
    return near.select("query", F.col("rank").cast("long").alias("rank"), "target", F.round("distance", 6).alias("distance"))


@query(_sql_knn("euclidean"))
def knn_euclidean(s, d):
    return _knn(s, d, "euclidean")


@query(_sql_knn("squared_euclidean"))
def knn_squared(s, d):
    return _knn(s, d, "squared_euclidean")


@query(_sql_knn("manhattan"))
def knn_manhattan(s, d):
    return _knn(s, d, "manhattan")


_FULL = "ctx_vec is not null and abs_vec is not null and len(ctx_vec) = 768 and len(abs_vec) = 768"


@query("select row_id, " + ", ".join(f"round({_sql_distance(m, 'ctx_vec', 'abs_vec')}, 6) as {m}" for m in vectors.METRICS) + f" from embedded where {_FULL}")
def row_distances(s, d):
    e = table(s, d, "embedded").where((F.size("ctx_vec") == 768) & (F.size("abs_vec") == 768))
    return e.select("row_id", *[F.round(f(F.col("ctx_vec"), F.col("abs_vec")), 6).alias(m) for m, f in vectors.METRICS.items()])


_WEIGHT = "exp(((z[3] % 7) - 3) / 5.0)"


def _sql_weighted(metric: str, a: str, b: str) -> str:
    f = "(z[1]::double - z[2]::double)"
    part = f"abs({f})" if metric == "manhattan" else f"{f} * {f}"
    total = f"list_sum(list_transform(list_zip({a}, {b}, range(0, 768)), lambda z: {part} * {_WEIGHT}))"
    return f"sqrt({total})" if metric == "euclidean" else total


@query("select row_id, " + ", ".join(f"round({_sql_weighted(m, 'ctx_vec', 'abs_vec')}, 6) as {m}" for m in vectors.METRICS) + f" from embedded where {_FULL}")
def row_distances_weighted(s, d):
    e = table(s, d, "embedded").where((F.size("ctx_vec") == 768) & (F.size("abs_vec") == 768))
    w = vectors.positive_weights(F.transform(F.sequence(F.lit(0), F.lit(767)), lambda i: (i % 7 - 3) / 5.0))
    return e.select("row_id", *[F.round(f(F.col("ctx_vec"), F.col("abs_vec"), w), 6).alias(m) for m, f in vectors.METRICS.items()])


@query("with a as (select distinct ctx_id as vec_id, ctx_vec as vec from embedded where ctx_vec is not null union select distinct abs_id, abs_vec from embedded where abs_vec is not null) select e.row_id as key, a.vec_id from embedded e join a on e.ctx_vec = a.vec")
def vector_ids(s, d):
    e = table(s, d, "embedded")
    known = e.select(F.col("ctx_id").alias("vec_id"), F.col("ctx_vec").alias("vec")).unionByName(e.select(F.col("abs_id").alias("vec_id"), F.col("abs_vec").alias("vec")))
    return evaluate.identify(e.select(F.col("row_id").alias("key"), F.col("ctx_vec").alias("vec")), known)


@query("with a as (select source_id, row_number() over (order by row_id) - 1 as pos from dataset), b as (select ctx_id, row_number() over (order by row_id) - 1 as pos from embedded) select pos, source_id, ctx_id from a join b using (pos)")
def positional_zip(s, d):
    a = numbered(table(s, d, "dataset").select("row_id", "source_id"), "row_id").select("pos", "source_id")
    return a.join(numbered(table(s, d, "embedded").select("row_id", "ctx_id"), "row_id").select("pos", "ctx_id"), "pos").select(F.col("pos").cast("long").alias("pos"), "source_id", "ctx_id")


def _accuracy_parts(s, d):
    e = table(s, d, "embedded")
    n = e.count()
    full = e.where((F.size("ctx_vec") == 768) & (F.size("abs_vec") == 768))
    pairs = full.where(F.col("row_id") > int(n * 0.9)).select(F.col("row_id").alias("query"), F.col("ctx_vec").alias("vec"), F.col("abs_vec").alias("goal"))
    return pairs, full.select(F.col("abs_id").alias("target"), F.col("abs_vec").alias("vec"))


@query(f"""with n as (select count(*) as n from embedded), f as (select * from embedded where {_FULL}),
q as (select row_id, ctx_vec, abs_vec from f, n where row_id > floor(n * 0.9)), t as (select abs_id, any_value(abs_vec) as v from f group by 1),
g as (select q.row_id, round({_sql_distance('euclidean', 'q.ctx_vec', 'q.abs_vec')}, 9) as own, round({_sql_distance('euclidean', 'q.ctx_vec', 't.v')}, 9) as dist from q, t),
c as (select row_id, count(*) filter (dist < own) as n_closer from g group by 1)
select count(*) as n, count(*) filter (n_closer < 20) as hits, avg(case when n_closer < 20 then 1.0 else 0.0 end) as accuracy from c""")
def topk_accuracy(s, d):
    return evaluate.topk_accuracy(*_accuracy_parts(s, d), 20)


@query(f"""with n as (select count(*) as n from embedded), f as (select * from embedded where {_FULL}),
q as (select row_id, ctx_vec, abs_vec from f, n where row_id > floor(n * 0.9) order by row_id limit 20), t as (select abs_id, any_value(abs_vec) as v from f group by 1),
g as (select q.row_id, round({_sql_weighted('manhattan', 'q.ctx_vec', 'q.abs_vec')}, 9) as own, round({_sql_weighted('manhattan', 'q.ctx_vec', 't.v')}, 9) as dist from q, t),
c as (select row_id, count(*) filter (dist < own) as n_closer from g group by 1)
select count(*) as n, count(*) filter (n_closer < 5) as hits, avg(case when n_closer < 5 then 1.0 else 0.0 end) as accuracy from c""")
def topk_mini(s, d):
    return evaluate.topk_accuracy(*_accuracy_parts(s, d), 5, "manhattan", np.exp((np.arange(768) % 7 - 3) / 5.0), mini_eval=20)


@query("with n as (select count(*) as n from dataset), p as (select target_id, case when row_id <= floor(n * 0.9) then 'Train' else 'Validation' end as kind from dataset, n) select distinct kind, target_id from p union select distinct 'All', target_id from p")
def target_sets(s, d):
    return evaluate.target_sets(table(s, d, "dataset"))


_TRAIN = "with n as (select count(*) as n from dataset), tr as (select d.* from dataset d, n where row_id <= floor(n * 0.9)), te as (select d.* from dataset d, n where row_id > floor(n * 0.9)), p as (select target_id, count(*) as n, min(row_id) as f from tr group by 1 order by n desc, f limit 20)"


@query(_TRAIN + " select target_id, n from p")
def popular_targets(s, d):
    data = table(s, d, "dataset")
    return evaluate.popular(data.where(F.col("row_id") <= int(data.count() * 0.9)))


@query(_TRAIN + " select count(*) as n, count(p.target_id) as hits, 100.0 * count(p.target_id) / count(*) as percent from te left join p on te.target_id = p.target_id")
def popularity(s, d):
    data = table(s, d, "dataset")
    cut = int(data.count() * 0.9)
    return evaluate.popularity_score(data.where(F.col("row_id") <= cut), data.where(F.col("row_id") > cut))


# learning

_TRIPLETS = """with r as (select row_id, target_id, md5('42:' || row_id) as h from dataset),
pos as (select row_id, coalesce(lead(row_id) over (partition by target_id order by h, row_id), first_value(row_id) over (partition by target_id order by h, row_id)) as positive from r),
g as (select *, ('0x' || substring(h, 1, 4))::int % 16 as ring from r),
w as (select *, case when lag(target_id) over (partition by ring order by h, row_id) is distinct from target_id then 1 else 0 end as new from g),
u as (select *, sum(new) over (partition by ring order by h, row_id) as run from w),
st as (select ring, run, row_id as start, target_id as start_target from u where new = 1),
neg as (select u.row_id, coalesce(n.start, case when f.start_target <> u.target_id then f.start end, g.start) as negative
  from u left join st n on n.ring = u.ring and n.run = u.run + 1 join st f on f.ring = u.ring and f.run = 1 left join st g on g.ring = u.ring and g.run = 2),
tri as (select pos.row_id as anchor, positive, negative from pos join neg on pos.row_id = neg.row_id)"""


@query(_TRIPLETS + " select anchor, positive, negative from tri")
def triplets(s, d):
    return learn.triplets(table(s, d, "dataset"))


_VECTORS = _TRIPLETS + """, v as (select anchor, a.ctx_vec as a, p.abs_vec as p, n.abs_vec as n from tri join embedded a on a.row_id = anchor and a.ctx_vec is not null and len(a.ctx_vec) = 768
join embedded p on p.row_id = positive and p.abs_vec is not null and len(p.abs_vec) = 768 join embedded n on n.row_id = negative and n.abs_vec is not null and len(n.abs_vec) = 768)"""


def _triplet_vectors(s, d):
    return materialize(learn.with_vectors(learn.triplets(table(s, d, "dataset")), table(s, d, "embedded"), 768), "triplets")


@query(_VECTORS + f" select count(*) as n, round(avg(greatest({_sql_distance('euclidean', 'a', 'p')} - {_sql_distance('euclidean', 'a', 'n')} + 0.6, 0)), 6) as loss from v")
def triplet_loss(s, d):
    n, loss, _ = learn.loss_and_gradient(_triplet_vectors(s, d), np.zeros(768), 0.6, "euclidean")
    return s.createDataFrame([(n, round(float(loss), 6))], "n long, loss double")


@query(_VECTORS + f""", act as (select *, {_sql_distance('squared_euclidean', 'a', 'p')} - {_sql_distance('squared_euclidean', 'a', 'n')} + 0.6 > 0 as active from v),
e as (select active, unnest(range(0, 768)) as dim, unnest(a) as x, unnest(p) as y, unnest(n) as z from act)
select dim, round(avg(case when active then (x::double - y::double) * (x::double - y::double) - (x::double - z::double) * (x::double - z::double) else 0 end), 6) as gradient from e group by 1""")
def triplet_gradient(s, d):
    _, _, grad = learn.loss_and_gradient(_triplet_vectors(s, d), np.zeros(768), 0.6, "squared_euclidean")
    return s.createDataFrame([(i, round(float(g), 6)) for i, g in enumerate(grad)], "dim long, gradient double")


@query()
def train_metric(s, d):
    _, log = learn.train(_triplet_vectors(s, d), 768, 4)
    return log


@query("select row_id, (row_number() over (order by md5('3:' || row_id), row_id) - 1) // 64 as batch from dataset")
def minibatches(s, d):
    return learn.minibatches(table(s, d, "dataset").select("row_id"), "row_id", 64, 3).select("row_id", F.col("batch").cast("long").alias("batch"))


@query()
def search_trials(s, d):
    abstracts = catalogue.last_wins(table(s, d, "catalogue_raw"), ["id"], ["loaded_at", "row_id"]).select("id", "abstract")
    objective = search.accuracy_objective(table(s, d, "dataset"), abstracts, 2)
    path = f"{shared_dir(s)}/marginalia/study-{uuid.uuid4().hex}"
    search.run(s, objective, 1, path=path)  # a search that broke off goes on from what is stored
    return stats.best_trials(search.run(s, objective, 3, path=path))


# statistics

_SCORES = ", ".join(f"({x}, {y})" for x, y in stats.PAIRED_SCORES)


def _scores(s):
    return s.createDataFrame(stats.PAIRED_SCORES, "x int, y int")


@query(f"""with d as (select x - y as d from (values {_SCORES}) t(x, y) where x <> y), r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 as rk from d)
select count(*) as n, sum(case when d > 0 then rk else 0 end) as w_plus, sum(case when d < 0 then rk else 0 end) as w_minus from r""")
def wilcoxon_ranks(s, d):
    return stats.signed_ranks(_scores(s)).select("n", "w_plus", "w_minus")


_RANKS = ORACLES["wilcoxon_ranks"].replace("select count(*) as n,", "select count(*)::bigint as n, (select sum(t * t * t - t) from (select count(*) as t from r group by abs(d))) as ties,")
_ERF = "2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda k: power(-1, k) * power(z, 2 * k + 1) / (factorial(k::int)::double * (2 * k + 1))))"


@query(f"""with w as ({_RANKS}), s as (select *, least(w_plus, w_minus) as statistic, abs(least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(2 * (n * (n + 1) * (2 * n + 1) - ties / 2.0) / 24) as z from w)
select n, w_plus, w_minus, statistic, round(1 - {_ERF.replace('factorial(k::int)::double', 'gamma(k + 1.0)')}, 9) as p_value, 1 - {_ERF.replace('factorial(k::int)::double', 'gamma(k + 1.0)')} < 0.05 as significant from s""")
def wilcoxon(s, d):
    return stats.wilcoxon(_scores(s)).withColumn("p_value", F.round("p_value", 9))


@query("select event_id, strftime(ts, '%Y%m%d-%H%M%S') as stamp, printf('%02d:%02d:%02d', event_id // 3600, event_id % 3600 // 60, event_id % 60) as elapsed from events where ts is not null")
def time_labels(s, d):
    return table(s, d, "events").where("ts is not null").select("event_id", stats.file_stamp(F.col("ts")).alias("stamp"), stats.elapsed(F.col("event_id")).alias("elapsed"))


@query("select event_id, round(avg(value) over (order by event_id rows unbounded preceding), 6) as prefix_mean from events where value is not null")
def prefix_mean(s, d):
    # decimals have exact sums, in whatever order partitions are added
    got = stats.prefix_mean(table(s, d, "events").withColumn("value", F.col("value").cast("decimal(20,6)")), "event_id", "value", F.floor(F.col("event_id") / 10_000))
    return got.select("event_id", F.round("prefix_mean", 6).alias("prefix_mean"))


@query("select vec_id, dim, round(embedding[dim + 1]::double, 6) as weight from embeddings, (values (0), (7), (15), (31), (63)) t(dim)")
def weight_trace(s, d):
    return stats.weight_trace(table(s, d, "embeddings"), "embedding", [0, 7, 15, 31, 63], "vec_id").select("vec_id", "dim", F.round(F.col("weight").cast("double"), 6).alias("weight"))


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) as n, round(avg(value), 6) as mean from events group by 1")
def epoch_stats(s, d):
    return table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("select round(avg(m), 6) as mean_of_means from (select avg(value) as m from events group by strftime(ts, '%Y-%m-%d'))")
def mean_of_means(s, d):
    return table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("value").alias("m")).agg(F.round(F.avg("m"), 6).alias("mean_of_means"))


_SLOTS = """with c as (select row_id as context_no from dataset order by md5('7:' || row_id), row_id limit 30),
i as (select context_no, i, md5('42:' || context_no || ':' || i) as h from c, range(0, 10) t(i)),
p as (select context_no, i, case when i < 5 then 1 else 2 end as model_no, row_number() over (partition by context_no order by h, i) as slot from i)"""


def _drawn(s, d):
    return positions(table(s, d, "dataset").select("row_id"), 7, "row_id").orderBy("pos").limit(30).select(F.col("row_id").alias("context_no"))


@query(_SLOTS + " select context_no, slot, model_no, row_number() over (partition by context_no, model_no order by slot) as rank from p")
def balanced_slots(s, d):
    return evaluate.balanced_slots(_drawn(s, d)).select("context_no", F.col("slot").cast("long").alias("slot"), "model_no", F.col("rank").cast("long").alias("rank"))


def _sql_near(metric: str, no: int) -> str:
    return f"""select context_no, {no} as model_no, row_number() over (partition by context_no order by dist, target) as rank, target as predicted_id from (
select c.context_no, t.abs_id as target, round({_sql_distance(metric, 'e.ctx_vec', 't.v')}, 9) as dist from c join embedded e on e.row_id = c.context_no and e.ctx_vec is not null and len(e.ctx_vec) = 768, t where t.abs_id <> c.context_no) qualify rank <= 5"""


@query(_SLOTS + f""", s as (select context_no, slot, model_no, row_number() over (partition by context_no, model_no order by slot) as rank from p),
t as (select abs_id, any_value(abs_vec) as v from embedded where abs_vec is not null and len(abs_vec) = 768 group by 1), m as ({_sql_near('euclidean', 1)} union all {_sql_near('manhattan', 2)})
select context_no, slot, model_no, predicted_id from s join m using (context_no, model_no, rank)""")
def blind_table(s, d):
    e = table(s, d, "embedded")
    drawn = _drawn(s, d)
    q = e.join(drawn, e["row_id"] == drawn["context_no"]).select(F.col("row_id").alias("query"), F.col("ctx_vec").alias("vec"))
    t = e.select(F.col("abs_id").alias("target"), F.col("abs_vec").alias("vec"))
    return evaluate.blind_table(drawn, evaluate.nearest(q, t, 5, "euclidean", None, 768), evaluate.nearest(q, t, 5, "manhattan", None, 768)).select("context_no", F.col("slot").cast("long").alias("slot"), "model_no", "predicted_id")


# tables at rest


@query("select id, title, authors, update_date, categories, abstract from catalogue_raw")
def json_scan(s, d):
    at = f"{shared_dir(s)}/marginalia/json-{uuid.uuid4().hex}"
    columns = ["id", "title", "authors", "update_date", "categories", "abstract"]
    lines = table(s, d, "catalogue_raw").select(F.to_json(F.struct(*columns)).alias("value"))
    lines.unionByName(s.createDataFrame([('{"id": "broken',)], "value string")).write.text(at)
    return tables.read_json_lines(s, at).where("_corrupt_record is null").select(*columns)


@query("select id, title, authors from catalogue")
def table_replaced(s, d):
    at = f"{shared_dir(s)}/marginalia/table-{uuid.uuid4().hex}"
    schema = "id string, title string, authors string"
    first = table(s, d, "catalogue").select("id", "title", "authors")
    tables.replace(tables.read_or_empty(s, at, schema).unionByName(first), at)
    tables.replace(tables.read_or_empty(s, at, schema).unionByName(first).distinct(), at)  # reads the table it replaces
    return tables.read_or_empty(s, at, schema)


# streams


@query("select doc_id, source, n_chars from documents")
def stream_ingest(s, d):
    at = f"{shared_dir(s)}/marginalia/stream-{uuid.uuid4().hex}"
    src = table(s, d, "documents")
    stream = s.readStream.schema(src.schema).option("maxFilesPerTrigger", 4).format("parquet").load(f"{d}/documents.parquet*")
    ingest.copy_stream(stream.select("doc_id", "source", "n_chars"), f"{at}/table", f"{at}/log")
    return s.read.parquet(f"{at}/table")


@query("select distinct source_id, target_id, context from dataset")
def stream_update(s, d):
    at = f"{shared_dir(s)}/marginalia/update-{uuid.uuid4().hex}"
    src = table(s, d, "dataset")
    # rows of one source come in several files, one file a batch
    src.repartition(4, F.xxhash64("row_id")).write.parquet(f"{at}/landed")
    stream = s.readStream.schema(src.schema).format("parquet").option("maxFilesPerTrigger", 1).load(f"{at}/landed")
    ingest.update_dataset(stream.select("source_id", "target_id", "context"), f"{at}/table", f"{at}/log")
    return s.read.schema(ingest.DATASET).parquet(f"{at}/table")
