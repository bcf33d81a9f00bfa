"""Variant spellings of names typed by people: which typed names are one person or collaboration.

Method: suffix blocking. Spellings of last names are indexed by their token
suffixes of at least ``MIN_SUFFIX`` letters; a suffix that more than ``COMMON``
spellings of one initial share is not discarded but refined with the first letters,
and slip keys (``slip_keys``) meet the rest, so no pair depends on the size; pairs are compared by their longest-common-subsequence ratio. A
spelling joins the better attested one it is close to, unless bibliography
entries attest both of them. Within one last name the given names (full, short,
initials, nicknames learned from quoted forms and from lists of equal titles) tell people apart, in one pass
over the distinct names.

A bare last name stands for the first authors of the works it is typed for: the
bibliography entry it belongs to says who that is. Where an entry has the same
title as an article, the two author lists are set side by side, which ties
misspelled names to their usual spelling.

Defined results: null and blank names are no names; names that differ only by
case or accents are different strings of one person; repeated rows only add
weight; a name of which nothing is known but itself is alone and in no pair;
empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.names import plain, tokens
from marginalia.functions.similarity import lcs_length, lcs_ratio
from marginalia.llm.linkage import parse_entry, split_names
from marginalia.llm.markup import strip_markup
from marginalia.operators.packed import PARTICLES, explode_packed
from marginalia.plans.runtime import materialize, spread

MIN_SUFFIX, COMMON = 4, 40
#: Names of more letters are keyed by pieces, not by what is left without some letters.
SHORT = 14
CLOSE = 0.8
#: Entries in which a spelling must stand to count as attested.
ATTESTED = 2

_COLLAB = re.compile(r"\b(?:collaborations?|colaborations?|coll|collab|team|consortium)\b")
_QUOTED = re.compile(r"[\"“”](\w[\w.' -]*)[\"“”]")
_SHORT = frozenset(PARTICLES)

_PARSED = "core string, given string, kind string, swapped string"


def parse_name(name: str) -> tuple[str, str, str, str]:
    """(last name, given name, kind, nickname) of a typed name; kind is full, short, initial, bare or group.

    A full given name behind the last name without a comma can't be told from
    one before it, so ``orient`` settles the order of such names by what is usual.
    """
    low = plain(name)
    if _COLLAB.search(low):
        core = " ".join(w for w in _COLLAB.sub(" ", low).split() if w != "the")
        return core, "", "group", ""
    nick = _QUOTED.search(name)
    base = _QUOTED.sub(" ", name)
    if "," in base:
        last, _, given = base.partition(",")
        words, lead = tokens(last) or plain(last).split(), given
    else:
        parts = [w for w in re.sub(r"\.(?=\S)", ". ", base).split() if plain(w) not in _SHORT]
        long = [w for w in parts if not w.endswith(".") and len(plain(w)) > 1]
        if not long:
            return "", "", "bare", ""
        if len(parts) > 1 and long[0] is parts[0] and all(len(plain(w)) <= 1 or (w.endswith(".") and len(plain(w)) == 1) for w in parts[1:]):
            words, lead = [plain(parts[0])], " ".join(parts[1:])  # Last F
        else:
            words, lead = [plain(long[-1])], " ".join(w for w in parts if w is not long[-1])
    last = words[-1] if words else ""
    given = [w for w in re.sub(r"\.(?=\S)", ". ", lead).split() if plain(w)]
    if not given:
        return last, "", "bare", plain(nick.group(1)) if nick else ""
    g = given[0]
    full = next((w for w in given if len(plain(w)) > 1 and not w.endswith(".")), None)
    if full:
        return last, plain(full), "full", plain(nick.group(1)) if nick else ""
    kind = "initial" if len(plain(g)) == 1 else "short"
    return last, plain(g), kind, plain(nick.group(1)) if nick else ""


def _parse_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [parse_name(n) for n in b["name"]]
        yield pd.DataFrame({"name": b["name"], "n": b["n"], "last": [g[0] for g in got], "given": [g[1] for g in got], "kind": [g[2] for g in got], "nick": [g[3] for g in got]})


_ENTRY = "ref_id bigint, name string, title string, year int, more boolean, authors array<struct<last:string,initial:string>>"


def _entries_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Author lists and titles of bibliography entries."""
    for b in batches:
        rows = []
        for k, name, title, info in zip(b["ref_id"], b["author_ln"], b["title"], b["info"]):
            authors, more, inner, year = parse_entry(info) if info else ("", False, "", 0)
            people = []
            for p in split_names(authors):
                last, given, kind, _ = parse_name(p)
                if len(last) > 1:
                    people.append({"last": last, "initial": "+" if kind == "group" else given[:1]})
            rows.append((k, name, plain(title or inner), year, more, people))
        yield pd.DataFrame(rows, columns=["ref_id", "name", "title", "year", "more", "authors"])


def orient(names: DataFrame) -> DataFrame:
    """Settle which word of two full ones is the given name: the one that leads more different names."""
    full = (F.col("kind") == "full") & ~F.col("name").contains(",")
    lead = names.where(full).groupBy("given").agg(F.count_distinct("last").alias("w")).withColumnRenamed("given", "word")
    pairs = names.join(lead.select(F.col("word").alias("given"), F.col("w").alias("wg")), "given", "left").join(lead.select(F.col("word").alias("last"), F.col("w").alias("wl")), "last", "left")
    turn = full & (F.coalesce("wl", F.lit(0)) > F.coalesce("wg", F.lit(0)))
    return pairs.select("name", "n", F.when(turn, F.col("given")).otherwise(F.col("last")).alias("last"), F.when(turn, F.col("last")).otherwise(F.col("given")).alias("given"), "kind", "nick")


def nicknames(names: DataFrame, lists: DataFrame) -> DataFrame:
    """``(nick, given)`` learned from quoted forms, and from author lists ``(title, typed)`` of one title set side by side.

    Two full given names at one place of equal titles, with one last name, are one name if they are so for two
    different last names at least; the shorter one is the nickname.
    """
    quoted = names.where((F.col("nick") != "") & (F.col("kind") == "full")).select("nick", "given").distinct()
    places = lists.select("title", F.posexplode("typed").alias("k", "p")).where("p.kind = 'full'").select("title", "k", "p.last", "p.given").distinct()
    same = places.withColumnRenamed("given", "nick").join(places, ["title", "k", "last"])
    same = same.where((F.length("nick") < F.length("given")) | ((F.length("nick") == F.length("given")) & (F.col("nick") < F.col("given"))))
    seen = same.groupBy("nick", "given").agg(F.count_distinct("last").alias("lasts")).where("lasts >= 2")
    # what is spelled alike is a slip, and is met as one
    seen = seen.withColumn("ratio", lcs_ratio("nick", "given")).where(F.col("ratio") < 100 * CLOSE)
    return quoted.unionByName(seen.select("nick", "given")).distinct()


def _slips(n: int) -> int:
    """Most letters that a name of n letters can lose to its longest common subsequence with a name it is compared to."""
    return max(a for m in range(max(n - 2, 1), n + 3) for a in range(4) if 0 <= a + m - n <= 3 and 2 * a + m - n <= (1 - CLOSE) * (n + m) + 1e-9)


def slip_keys(last: str) -> set[str]:
    """Keys of which two names share one if their lengths differ by 2 at most, their Levenshtein distance is 3 at most and their LCS ratio reaches CLOSE.

    The name without up to ``_slips`` letters: one of these is the longest common subsequence. Of two names of
    over SHORT letters, which would have very many, one of four pieces stands in the other, 3 places off at most.
    """
    n, out = len(last), set()
    if n <= SHORT + 2:
        for k in range(_slips(n) + 1):
            out.update("-" + "".join(c) for c in combinations(last, n - k))
    if n > SHORT:
        for m in range(n - 2, n + 3):
            cuts = [m * i // 4 for i in range(5)]
            for i in range(4):
                size = cuts[i + 1] - cuts[i]
                out.update(f"#{m}.{i}.{last[p : p + size]}" for p in range(max(cuts[i] - 3, 0), min(cuts[i] + 3, n - size) + 1))
    return out


def _slip_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(last, initial, f"{key}-{initial}") for last, initial in zip(b["last"], b["initial"]) for key in slip_keys(last)]
        yield pd.DataFrame(rows, columns=["last", "initial", "block"])


def suffix_pairs(spellings: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of close spellings ``(last, initial)`` by suffix blocking and LCS ratio.

    A slip near the start of a last name leaves a long suffix of it as it is. A
    slip near the end leaves the other token, the given name, as it is: its
    suffixes are common to very many people, so they are only used refined with
    the first letters of the last name. Blocks by slips meet what these two miss:
    short names, slips in the middle, and slips in the first two letters of
    names whose suffix is refined.
    """
    s = spellings.select("last", "initial")
    offsets = F.filter(F.sequence(F.lit(0), F.lit(5)), lambda k: F.length("last") - k >= MIN_SUFFIX)
    by_suffix = s.where(F.length("last") >= MIN_SUFFIX).select("last", "initial", F.explode(F.transform(offsets, lambda k: F.substring(F.col("last"), k + 1, F.length("last")))).alias("block"))
    sizes = by_suffix.groupBy("block", "initial").agg(F.count(F.lit(1)).alias("size"))
    # refining costs no pair: the slip keys below meet every pair, at any size of a block
    refined = by_suffix.join(sizes, ["block", "initial"]).select(
        "last", "initial", F.when(F.col("size") > COMMON, F.concat_ws("|", "block", "initial", F.substring("last", 1, 2))).otherwise(F.concat_ws("|", "block", "initial")).alias("block")
    )
    by_other = s.where(F.length("last") >= MIN_SUFFIX).select("last", "initial", F.concat_ws("<", F.substring("last", 1, 4), F.col("initial")).alias("block"))
    # slips anywhere, in names of any length and blocks of any size
    rows = refined.unionByName(by_other).unionByName(spread(s).mapInPandas(_slip_batch, "last string, initial string, block string")).distinct()
    left = rows.select(F.col("last").alias("a"), F.col("initial"), "block")
    right = rows.select(F.col("last").alias("b"), F.col("initial").alias("initial_b"), "block")
    near = left.join(right, "block").where((F.col("initial") == F.col("initial_b")) & (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 2) & (F.levenshtein("a", "b", 3) >= 0))
    return near.select("a", "b", "initial").distinct().withColumn("ratio", lcs_ratio("a", "b")).where(F.col("ratio") >= 100 * CLOSE)


def people(catalogue_raw: DataFrame, refs: DataFrame) -> DataFrame:
    """``(name, person)``: each typed name with each person or collaboration it stands for."""
    items = explode_packed(catalogue_raw, ["row_id"], {"authors": "names"}).select("row_id", "pos", F.col("item").alias("name"))
    items = materialize(items, "items")
    names = items.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    names = materialize(orient(spread(names).mapInPandas(_parse_batch, "name string, n bigint, last string, given string, kind string, nick string")), "names")
    info = F.when(F.col("info").rlike(r"[\\<&*_~`$\[{]|''"), strip_markup(F.col("info"))).otherwise(F.col("info"))
    title = F.when(F.col("title").rlike(r"[\\<&*_~`$\[{]|''"), strip_markup(F.col("title"))).otherwise(F.col("title"))
    entries = materialize(spread(refs.select("ref_id", "author_ln", title.alias("title"), info.alias("info"))).mapInPandas(_entries_batch, _ENTRY), "entries")

    # entries and articles of the same title, their author lists side by side
    works = catalogue_raw.select("row_id", F.col("title"))
    works = works.select("row_id", F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.col("title"), r"[^\p{ASCII}]", "?"), r"[^a-zA-Z0-9]+", " "))).alias("title")).where(F.length("title") > 25)
    lists = items.join(names.select("name", "last", "given", "kind"), "name").groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "last", "given", "kind"))).alias("typed"))
    works = materialize(works.join(lists, "row_id").groupBy("title", "typed").agg(F.count(F.lit(1)).alias("n")), "works")
    lined = entries.where(F.length("title") > 25).groupBy("title", "authors").agg(F.count(F.lit(1)).alias("m")).join(works, "title")
    lined = lined.where((F.size("authors") > 0) & (F.size("authors") <= F.size("typed")))
    sides = lined.select(F.posexplode(F.arrays_zip("authors", F.slice("typed", 1, F.size("authors")).alias("typed"))).alias("k", "p"), "m")
    sides = sides.select(F.col("p")["typed"]["name"].alias("name"), F.col("p")["typed"]["last"].alias("typed_last"), F.col("p")["authors"]["last"].alias("last"), F.col("p")["authors"]["initial"].alias("initial"), "m")
    sides = sides.where(F.col("typed_last") != F.col("last")).groupBy("name", "typed_last", "last", "initial").agg(F.sum("m").alias("m"))
    sides = sides.withColumn("ratio", lcs_ratio("typed_last", "last")).where(F.col("ratio") >= 70)

    # spellings of last names and how well entries attest them
    attested = entries.select(F.explode("authors").alias("p")).select("p.last", "p.initial").groupBy("last", "initial").agg(F.count(F.lit(1)).alias("cited"))
    initial = F.when(F.col("kind") == "group", F.lit("+")).otherwise(F.substring("given", 1, 1))
    typed = names.where(F.length("last") > 1).withColumn("initial", initial).groupBy("last", "initial").agg(F.sum("n").alias("typed"))
    spell = attested.join(typed, ["last", "initial"], "full_outer").select("last", "initial", F.coalesce("cited", F.lit(0)).alias("cited"), F.coalesce("typed", F.lit(0)).alias("typed"))
    spell = materialize(spell.where(F.col("initial") != ""), "spellings")
    near = suffix_pairs(spell)
    weight = spell.select("last", "initial", F.struct(F.least("cited", F.lit(ATTESTED)).alias("ok"), (F.col("cited") + F.col("typed")).alias("n")).alias("w"))
    both = near.join(weight.withColumnsRenamed({"last": "a", "w": "wa"}), ["a", "initial"]).join(weight.withColumnsRenamed({"last": "b", "w": "wb"}), ["b", "initial"])
    turned = F.col("wa") > F.col("wb")
    moves = both.where(~((F.col("wa.ok") >= ATTESTED) & (F.col("wb.ok") >= ATTESTED))).select(
        F.when(turned, F.col("b")).otherwise(F.col("a")).alias("from"), "initial", F.when(turned, F.col("a")).otherwise(F.col("b")).alias("to"), F.struct(F.lit(0).alias("m"), F.col("ratio"), F.when(turned, F.col("wa")).otherwise(F.col("wb")).alias("w")).alias("why")
    )
    seen = sides.join(weight.select("last", "initial", "w"), ["last", "initial"]).select(F.col("typed_last").alias("from"), "initial", F.col("last").alias("to"), F.struct(F.col("m").cast("int").alias("m"), "ratio", "w").alias("why"))
    weak = spell.where(F.col("cited") < ATTESTED).select(F.col("last").alias("from"), "initial")
    moves = moves.unionByName(seen).join(weak, ["from", "initial"], "left_semi").groupBy("from", "initial").agg(F.max_by("to", "why").alias("to"))
    again = moves.select(F.col("from").alias("to"), "initial", F.col("to").alias("next"))
    moves = moves.join(again, ["to", "initial"], "left").select(F.col("from").alias("last"), "initial", F.coalesce("next", "to").alias("best")).where(F.col("last") != F.col("best"))
    moves = materialize(moves, "moves")

    def settle(df: DataFrame) -> DataFrame:
        return df.join(moves, ["last", "initial"], "left").withColumn("last", F.coalesce("best", "last")).drop("best")

    nick = nicknames(names, works).groupBy("nick").agg(F.collect_set("given").alias("long")).withColumnRenamed("nick", "given")
    mine = settle(names.where(F.length("last") > 1).withColumn("initial", initial)).join(nick, "given", "left")
    mine = mine.select("last", "name", "n", "given", F.col("kind"), F.coalesce("long", F.array().cast("array<string>")).alias("long"))
    firsts = entries.where(F.col("name").isNotNull() & (F.trim("name") != "") & (F.size("authors") > 0)).select("name", F.col("authors")[0].alias("p"))
    firsts = settle(firsts.groupBy("name", "p").agg(F.count(F.lit(1)).alias("n")).select("name", "p.last", "p.initial", "n"))
    alone = entries.where(F.col("name").isNotNull() & (F.trim("name") != "")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    stands = _stands(firsts)
    # names typed only in entries that do not say who is meant, but which hold an initial themselves
    rest = alone.join(stands.select("name").distinct(), "name", "left_anti")
    rest = settle(rest.mapInPandas(_parse_batch, "name string, n bigint, last string, given string, kind string, nick string").where(F.col("last") != "").withColumn("initial", initial)).where(F.col("initial") != "")
    stands = stands.unionByName(rest.select("last", "name", "n", F.col("initial").alias("given"), F.lit("entry").alias("kind"), F.array().cast("array<string>").alias("long")))
    rows = mine.unionByName(stands)
    return _by_last(rows).distinct()


def _by_last(rows: DataFrame) -> DataFrame:
    """_tell_apart on the rows of each last name; the groups are small and many, so a task cuts its sorted rows itself."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple] = []
        out: list[tuple[str, str]] = []
        for b in batches:
            for r in b.itertuples(index=False):
                if kept and kept[0].last != r.last:
                    out += _tell_apart(kept)
                    kept = []
                kept.append(r)
            if out:
                yield pd.DataFrame(out, columns=["name", "person"])
                out = []
        if kept:
            yield pd.DataFrame(_tell_apart(kept), columns=["name", "person"], dtype=object)

    return rows.repartition(parts, "last").sortWithinPartitions("last").mapInPandas(run, "name string, person string")


def _stands(firsts: DataFrame) -> DataFrame:
    """Typed last names with the first author their entries name, where the two are spelled alike."""

    @F.pandas_udf("string")
    def word(name: pd.Series, last: pd.Series) -> pd.Series:
        out = []
        for n, x in zip(name, last):
            t = tokens(n) or plain(n).split()
            out.append(max(t, key=lambda w: (sum(a == b for a, b in zip(w, x)), len(w))) if t else "")
        return pd.Series(out)

    firsts = firsts.withColumn("word", word("name", "last")).withColumn("ratio", lcs_ratio("word", "last"))
    return firsts.where(F.col("ratio") >= 70).select("last", "name", F.col("n").cast("bigint").alias("n"), F.col("initial").alias("given"), F.lit("entry").alias("kind"), F.array().cast("array<string>").alias("long"))


def _close(a: str, b: str) -> bool:
    """Given names that are one up to a slip or an abbreviation."""
    if a == b or (min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a))):
        return True
    if a[:1] != b[:1] and a[1:] != b[1:] or abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 4:
        return a[1:] == b or b[1:] == a if min(len(a), len(b)) >= 4 else False
    return 200 * lcs_length(a, b) >= 100 * CLOSE * (len(a) + len(b))


def _tell_apart(g: list) -> list[tuple[str, str]]:
    """People of one last name. One pass over its distinct names, most typed first; groups keep to themselves."""
    last = g[0].last
    out: list[tuple[str, str]] = []
    full: Counter = Counter()
    ways: dict[str, set[str]] = {}
    for r in g:
        if r.kind == "group" or (r.kind == "entry" and r.given == "+"):
            out.append((r.name, f"{last} +"))
        elif r.kind == "full":
            full[r.given] += r.n
            ways[r.given] = set(r.long)
    heads: dict[str, int] = {}
    belongs: dict[str, str] = {}
    by_initial: dict[str, list[str]] = {}
    long_first = sorted(full, key=lambda x: (bool(ways[x]), -full[x], x))
    for given in long_first:
        same = [h for h in heads if h == given or h in ways[given] or given in ways.get(h, ()) or (ways[given] & ways.get(h, set()))]
        if not same:
            near = [given, *sorted(ways[given])]
            same = [h for x in near for h in by_initial.get(x[:1], []) + by_initial.get(x[1:2], []) if _close(x, h)]
        head = max(same, key=lambda h: (heads[h], h)) if same else next(iter(sorted(ways[given])), given) if ways[given] else given
        if head not in heads:
            heads[head] = 0
            by_initial.setdefault(head[:1], []).append(head)
        heads[head] += full[given]
        belongs[given] = head
    for r in g:
        if r.kind == "full":
            out.append((r.name, f"{last} {belongs[r.given]}"))
        elif r.kind in ("initial", "short") or (r.kind == "entry" and r.given not in ("", "+")):
            fits = [h for h in by_initial.get(r.given[:1], []) if h.startswith(r.given)] or ([h for h in by_initial.get(r.given[:1], []) if _close(h, r.given)] if len(r.given) > 1 else [])
            head = max(fits, key=lambda h: (heads[h], h)) if fits else r.given[:1] + "."
            out.append((r.name, f"{last} {head}"))
        elif r.kind in ("bare", "entry") and len(heads) == 1:
            out.append((r.name, f"{last} {next(iter(heads))}"))
    return out


def found(catalogue_raw: DataFrame, refs: DataFrame) -> DataFrame:
    """``(name_a, name_b)``: pairs of different typed names of one person or collaboration, name_a < name_b by code points."""
    who = materialize(people(catalogue_raw, refs), "people")
    a, b = who.select(F.col("name").alias("name_a"), "person"), who.select(F.col("name").alias("name_b"), "person")
    return a.join(b, "person").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b").distinct()
