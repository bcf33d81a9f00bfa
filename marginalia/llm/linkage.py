"""Matching entities across sources without keys: reference entries to catalogue articles.

Method: q-grams of the title and of the authors' names are encoded as fixed bit
vectors. Close pairs of titles are found exactly by multi-index Hamming hashing:
the vector is cut into ``CHUNKS`` pieces, and two vectors within ``CHUNKS - 1``
bits agree on at least one piece, so a join on pieces misses none. Titles cut
short or with more slips meet their candidates through a name together with a telling
part of the title (``name_pairs``); entries without a title meet all works that share a
word of a name, of any year (``year_pairs``), and those that fit equally well are one
candidate (``shared_classes``). Field-weighted Dice scores are the features of a
conditional logit, in which an entry chooses one of its candidates or none; its
weights are fitted on the labelled entries (``target_id``), at most ``LABELS`` of
them with ``RIVALS`` candidates each, and the confidence is the fitted probability
(``calibration`` holds it against held-out labels).

Equal title vectors are compared once: the Hamming join runs over distinct
vectors, so a group of copies of any size costs one row. Pieces that are empty
in both vectors say nothing and are not joined; pairs that agree on empty pieces
only are found by an exact prefix join of their rarest bits (``sparse_pairs``).

Defined results: an entry without title, info and author gets no link; an empty
catalogue links nothing; null and empty fields count as missing; articles that fit
equally well share the probability, so none of them reaches a half, and the smallest id is
named; repeated entries each get their own link.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions.names import plain, tokens
from marginalia.functions.similarity import lcs_length
from marginalia.operators.packed import split_packed
from marginalia.llm.markup import strip_markup
from marginalia.plans.runtime import discard, materialize, spread

BITS, CHUNKS = 512, 8
#: Bits that a key of the sparse vectors' join holds.
SHARED_BITS = 3
COMMON_SHARE, COMMON_FLOOR = 0.01, 5
#: Labelled entries, and candidates of each, that fit the weights.
LABELS, RIVALS = 20_000, 50
THRESHOLD = 0.5
#: Titles of a pair are alike from here on.
ALIKE = 0.62
LONGS = BITS // 64

_P = r"(?:(?:van|von|de|der|den|del|della|di|da|du|la|le)\s+)*"
_NAME = rf"(?:(?:[A-Z]\.?[\s-]*){{1,3}}{_P}[^\W\d_a-z][^\W\d_]+|{_P}[^\W\d_a-z][^\W\d_]+,?\s+(?:[A-Z]\.?[\s-]*){{1,3}}(?=\W|$)|(?:[Tt]he )?[^\W\d_a-z][^\W\d_]+ [Cc]oll?[a-z]*\.?|[Tt]he [^\W\d_a-z][^\W\d_]+ team)"
_HEAD = re.compile(rf"^\W*((?:{_NAME})(?:\s*(?:[,;]|,?;?\s*and\b|&)\s*(?:and\s+)?(?:{_NAME})(?=\s*(?:[,;(“]|\.+\s*(?:[“(]|$)|and\b|et al|&|$)))*)(\W*et al\.*)?")
_JOURNAL = re.compile(r"(?:^|[,;.…?!]\s+)(?![Pp]art\s)(?:[^\W\d_a-z][\w.&]*\s+(?:[^\W\d_a-z][\w.&]*,?\s+){0,4})\d+\s*[,(:]")
_BOOK = re.compile(r"^[\s,.;:]*“(.*?)(?:”|\.?\s*In:)")
_YEAR = re.compile(r"(?<!\d)((?:18|19|20)\d\d)(?!\d)")
_PART = re.compile(r"(?:\bpart\s+(\w+)|[\s(]\(?(i{1,3}|iv|v|vi{0,3})\)?|:\s*(theory|experiment|simulation|applications?))\W*$", re.I)
# formulas that have strayed into an entry
_STRAY = re.compile(r"\$\$?[^$]+\$\$?")
_CUT = re.compile(r"(?:\.\.\.|…)\W*$")


def parse_entry(info: str) -> tuple[str, bool, str, int]:
    """(authors, et al., title, year) of a bibliography entry in any of its styles."""
    s = re.sub(r"\s+", " ", _STRAY.sub(" ", info.replace("{", "").replace("}", "").replace("`", ""))).strip()
    m = _HEAD.match(s)
    authors, rest = (m.group(1), s[m.end() :]) if m else ("", s)
    years = _YEAR.findall(rest)
    book = _BOOK.search(rest)
    if book:
        title = book.group(1)
    else:
        rest = re.sub(r"^[\s,.;:]*(?:\((?:18|19|20)\d\d[a-z]?\)[\s.,;:]*)?", "", rest)
        j = _JOURNAL.search(rest)
        title = rest[: j.start()] if j else re.sub(r"[\s,.;(]*\d[\d\s,.;:()\-–]*$", "", rest)
    return authors, bool(m and m.group(2)), title.strip(" .,;“”\"'"), int(years[-1]) if years else 0


def split_names(authors: str) -> list[str]:
    """Author names of a parsed entry."""
    out = re.split(r"\s*(?:;|\band\b|&)\s*|,\s*(?=[A-Z]\.?[\s-]*(?:[A-Z]\.?[\s-]*)*(?:van|von|de|der|[^\W\d_a-z][^\W\d_]))|(?<=[A-Z])\.?,\s+|,\s*(?=[^\W\d_a-z][^\W\d_]+\s+(?:[A-Z]\b|[Cc]oll))", authors)
    return [x.strip() for x in out if x and x.strip(" ,.;")]


def part_of(title: str) -> str:
    """Which part of a work a title says it is: number as digit, or its word; '' if none."""
    m = _PART.search(title)
    if not m:
        return ""
    got = (m.group(1) or m.group(2) or m.group(3)).lower()
    return {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "one": "1", "two": "2"}.get(got, got)


@lru_cache(100_000)
def _word_bits(word: str) -> int:
    """Bits of a word's padded bigrams; a letter slip changes four of them at most."""
    w, out = f"^{word}$", 0
    for k in range(len(w) - 1):
        out |= 1 << (zlib.crc32(w[k : k + 2].encode()) * 2654435761 % 2**32 % BITS)
    return out


class Common:
    """Common words of titles, and which words are slips of one: those say as little."""

    def __init__(self, words: frozenset[str]):
        self.words, self.memo = words, {}
        self.by: dict[tuple, list[str]] = {}
        for w in words:
            if len(w) > 3:
                for k in {(w[:2], 0), (w[-3:], 1)}:
                    self.by.setdefault(k, []).append(w)

    def __contains__(self, word: str) -> bool:
        if word in self.words:
            return True
        got = self.memo.get(word)
        if got is None:
            near = {w for k in ((word[:2], 0), (word[-3:], 1)) for w in self.by.get(k, ()) if abs(len(w) - len(word)) <= 1} if len(word) > 4 else ()
            got = self.memo[word] = any(200 * lcs_length(word, w) >= 85 * (len(word) + len(w)) for w in near)
        return got


def bits_of(words: list[str]) -> int:
    out = 0
    for w in words:
        out |= _word_bits(w)
    return out


def _longs(bits: int) -> list[int]:
    return np.frombuffer(bits.to_bytes(BITS // 8, "little"), dtype="<i8").tolist()


def _features(kind: str, key: str, common: frozenset[str]):
    """Arrow batches to features; kind: entry (title, info, author_ln) or article (title, info, authors)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        usual = Common(common)
        for b in batches:
            rows = []
            for k, title, info, who, names in zip(b["__key"], b["__title"], b["__info"], b["__who"], b["__names"]):
                title, info, who = title or "", info or "", who or ""
                cut, listed = False, True
                if kind == "entry":
                    authors, more, inner, year = parse_entry(info) if info else ("", False, "", 0)
                    raw = title or inner
                    cut = bool(_CUT.search(raw))
                    people = split_names(authors)
                    if not people and who:
                        people, more, listed = [who], True, False
                else:
                    more, people = False, list(names) if names is not None else []
                    end = re.search(r"\.\s*((?:18|19|20)\d\d)-\d\d-\d\d\s*$", info)
                    year = int(end.group(1)) if end else 0
                    raw = title
                    if not raw and info:
                        body = info[: end.start()] if end else info
                        raw = body[len(who) + 2 :] if who and body.startswith(who) else body.split(". ", 1)[-1]
                raw = _STRAY.sub(" ", raw)
                words = plain(_CUT.sub("", raw)).split()
                content = [w for w in words if len(w) > 1 and w not in usual]
                per = [tokens(p) for p in people]
                lasts = [w for t in per for w in t]
                # whom an entry names first; for an article any word of that name may be the last name
                first = [t[-1] if not re.match(r"^\W*[^\W\d_a-z][^\W\d_]+,?\s+[A-Z]\b", p) else t[0] for p, t in zip(people[:1], per[:1]) if t]
                lead = first if kind == "entry" else per[0] if per else []
                names_ = sorted(set(lasts) | set(tokens(who)[:2] if kind == "entry" else ()))
                rows.append((k, words, content, lead, listed, _longs(bits_of(words)), len(words), cut, part_of(raw), _longs(bits_of(content)), len(content), _longs(bits_of(lasts)), len(people), more, year, lasts, names_))
            yield pd.DataFrame(rows, columns=["key", "words", "content", "lead", "listed", "tb", "nt", "cut", "part", "cb", "nc", "ab", "na", "more", "year", "names", "keys"])

    schema = "key {0}, words array<string>, content array<string>, lead array<string>, listed boolean, tb array<bigint>, nt int, cut boolean, part string, cb array<bigint>, nc int, ab array<bigint>, na int, more boolean, year int, names array<string>, keys array<string>"
    return run, schema


def _ones(bits: Column) -> Column:
    """Set bits of a vector."""
    return sum((F.bit_count(bits[i]) for i in range(1, LONGS)), F.bit_count(bits[0]))


def _common_bits(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a[i].bitwiseAND(b[i])) for i in range(1, LONGS)), F.bit_count(a[0].bitwiseAND(b[0])))


def _apart(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, LONGS)), F.bit_count(a[0].bitwiseXOR(b[0])))


def common_words(articles: DataFrame) -> frozenset[str]:
    """Words of over a hundredth of the titles: at most a hundred times a title's mean number of words, whatever the table's size."""
    words = articles.select(F.explode(F.array_distinct(F.split(F.lower(F.col("title")), r"[^\p{L}\p{N}]+"))).alias("w"))
    n = articles.count()
    got = words.groupBy("w").count().where(F.col("count") > max(COMMON_SHARE * n, COMMON_FLOOR)).select("w").collect()
    return frozenset(x for r in got for x in plain(r["w"]).split())


def hamming_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(cb_l, cb_r)``: all pairs of distinct vectors within CHUNKS - 1 bits, by an exact join on equal pieces.

    left and right have a column ``cb``. Each of the LONGS pieces is one long, so
    CHUNKS equals LONGS and a piece is read without any shifting.
    """
    def pieces(df: DataFrame, side: str) -> DataFrame:
        v = df.select(F.col("cb").alias(f"cb_{side}")).distinct()
        return v.select(f"cb_{side}", F.posexplode(f"cb_{side}").alias("place", "piece")).where(F.col("piece") != 0)

    joined = pieces(left, "l").join(pieces(right, "r"), ["place", "piece"])
    near = joined.where(_apart(F.col("cb_l"), F.col("cb_r")) < CHUNKS)
    # a pair that agrees on several pieces is met several times; it is kept at its first
    before = [F.when((F.col("cb_l")[i] == F.col("cb_r")[i]) & (F.col("cb_l")[i] != 0), F.lit(i)) for i in range(LONGS)]
    return near.where(F.col("place") == F.coalesce(*before)).select("cb_l", "cb_r").unionByName(sparse_pairs(left, right))


def _set_bits(cb: list[int]) -> list[int]:
    return [64 * i + k for i, v in enumerate(cb) if v for k in range(64) if v >> k & 1]


def sparse_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(cb_l, cb_r)``: the pairs of distinct vectors within CHUNKS - 1 bits that agree on empty pieces only.

    Both vectors of such a pair have an empty piece. With the bits in one order for all, rare ones first, vectors
    within t bits that have m = SHARED_BITS bits in common share m of their first t + m bits, so a join on the
    m-sets of those misses none. Vectors with fewer bits in common have t + 2 (m - 1) bits between them at most;
    they are met by their numbers of bits.
    """
    t, m = CHUNKS - 1, SHARED_BITS
    few = t + 2 * (m - 1)

    def sparse(df: DataFrame) -> DataFrame:
        return df.select("cb").where(F.exists("cb", lambda x: x == 0)).distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BITS, dtype="int64")
        for b in batches:
            for v in b["cb"]:
                total[_set_bits([int(x) for x in v])] += 1
        yield pd.DataFrame({"bit": np.arange(BITS), "n": total})

    often = sparse(right).mapInPandas(count, "bit int, n bigint").groupBy("bit").agg(F.sum("n").alias("n")).collect()
    rank = {r["bit"]: k for k, r in enumerate(sorted(often, key=lambda r: (r["n"], r["bit"])))}

    def keys(side: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                vecs, out = [], []
                for v in b["cb"]:
                    bits = sorted(rank.get(k, k) for k in _set_bits([int(x) for x in v]))
                    mine = [sum(x << 10 * i for i, x in enumerate(c)) for c in combinations(bits[: t + m], m)]
                    if len(bits) <= few:  # the negative keys: how many bits the left vector has
                        mine += [-1 - len(bits)] if side == "l" else range(-1 - (few - len(bits)), 0)
                    vecs.append(v)
                    out.append(mine)
                yield pd.DataFrame({f"cb_{side}": vecs, "keys": out})

        df = sparse(left if side == "l" else right).mapInPandas(run, f"cb_{side} array<bigint>, keys array<bigint>")
        return df.select(f"cb_{side}", F.explode("keys").alias("key"))

    near = keys("l").join(keys("r"), "key").where(_apart(F.col("cb_l"), F.col("cb_r")) < CHUNKS)
    # pairs that agree on a piece with bits are met there
    for i in range(LONGS):
        near = near.where((F.col("cb_l")[i] != F.col("cb_r")[i]) | (F.col("cb_l")[i] == 0))
    return near.select("cb_l", "cb_r").distinct()


FEATURES = ["one", "title", "authors", "same_year", "near_year", "far_year", "all_authors", "part_differs", "swapped", "alone"]
#: Start and prior mean of the weights, in the order of FEATURES, for entries with and without a title.
PRIOR = {True: [-24.0, 23.0, 8.0, 1.0, 0.0, -3.0, 3.0, -10.0, -8.0, 0.0], False: [-9.0, 0.0, 6.0, 4.0, -3.0, -6.0, 2.0, 0.0, 0.0, -3.0]}


def _title_score(both: Column, e_ones: Column, c_ones: Column, cut: Column, words: Column) -> Column:
    """Dice of two titles' bits; of a title cut short what counts is how much of it the other holds."""
    dice = 2.0 * both / (e_ones + c_ones)
    return F.when(cut & (words > 2), F.greatest(dice, 0.96 * both / e_ones)).otherwise(dice)


def pair_features(pairs: DataFrame) -> DataFrame:
    """Scores of candidate pairs whose columns are those of _features with ``e_`` and ``c_`` in front, ``copies`` and ``holds``."""
    c = F.col
    # measures that are used more than once are columns of their own, so that they are computed once
    got = pairs.select(
        "e_key", "c_key", "copies", "holds", (c("e_nt") > 1).alias("titled"), ((c("e_na") > 0) & (c("c_na") > 0)).alias("known"), "e_cut", "e_nt", "e_na", "c_na", "e_more", "e_listed",
        _common_bits(c("e_tb"), c("c_tb")).alias("both"), F.greatest(_ones(c("e_tb")), F.lit(1)).alias("e_ones"), _ones(c("c_tb")).alias("c_ones"),
        (_common_bits(c("e_ab"), c("c_ab")) / F.greatest(_ones(c("e_ab")), F.lit(1))).alias("shared"),
        (F.size(F.array_intersect("e_names", "c_names")) / F.greatest(F.size("e_names"), F.lit(1))).alias("exact"),
        # words that only one title has: letter slips leave strings that are close, other words leave strings that are not
        F.array_join(F.array_except("e_words", "c_words"), " ").alias("only_e"), F.array_join(F.array_except("c_words", "e_words"), " ").alias("only_c"),
        F.when((c("e_year") > 0) & (c("c_year") > 0), F.abs(c("e_year") - c("c_year"))).alias("gap"),
        (c("e_part") != c("c_part")).alias("other_part"), F.arrays_overlap("e_lead", "c_lead").alias("same_lead"),
    )
    got = got.withColumn("only_c", F.when(c("e_cut"), F.left("only_c", F.length("only_e"))).otherwise(c("only_c")))
    got = got.withColumn("longer", F.greatest(F.length("only_e"), F.length("only_c")))
    title = _title_score(c("both"), c("e_ones"), c("c_ones"), c("e_cut"), c("e_nt"))
    swapped = F.when(c("titled") & (c("longer") > 3), F.greatest(F.levenshtein("only_e", "only_c") / c("longer") - 0.3, F.lit(0.0)) * F.least(c("longer") / 6.0, F.lit(1.0))).otherwise(0.0)
    return got.select(
        "e_key", "c_key", "copies", "holds", "titled", "known", F.lit(1.0).alias("one"),
        F.when(c("titled"), title).otherwise(0.0).alias("title"),
        F.when(c("known"), F.greatest(0.5 * c("shared") + 0.5 * c("exact"), 0.95 * F.when(c("shared") > 0.75, c("shared")).otherwise(0.0))).otherwise(0.5).alias("authors"),
        F.coalesce((c("gap") == 0).cast("double"), F.lit(0.3)).alias("same_year"), F.coalesce((c("gap") == 1).cast("double"), F.lit(0.0)).alias("near_year"),
        F.coalesce((c("gap") > 1).cast("double"), F.lit(0.0)).alias("far_year"),
        F.when(c("known") & ((c("e_na") == c("c_na")) | (c("e_more") & (c("e_na") < c("c_na")))), 1.0).otherwise(F.when(c("known"), 0.0).otherwise(0.5)).alias("all_authors"),
        F.when(c("titled") & ~c("e_cut") & c("other_part"), 1.0).otherwise(0.0).alias("part_differs"),
        swapped.alias("swapped"), F.when(c("titled") | (c("e_listed") & (c("e_na") > 1)), 0.0).otherwise(1.0).alias("alone"),
        (c("same_lead") | (c("shared") > 0.9)).alias("led"),
    )


def _rows(sample: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(features with the number of copies taken in, truth, entry of each pair, number of entries)."""
    _, entry = np.unique(sample["e_key"].to_numpy(), return_inverse=True)
    return sample[FEATURES].to_numpy(float), sample["truth"].to_numpy(float), entry, int(entry.max()) + 1 if len(entry) else 0


def fit(sample: pd.DataFrame, titled: bool) -> np.ndarray:
    """Weights of a conditional logit by damped Newton steps, drawn towards PRIOR; an empty sample gives PRIOR.

    An entry chooses one of its candidates or none, and none has the score 0. Labelled entries all cite an article
    of the catalogue, so each is used twice: as it is, and with its article hidden, when none is the right choice.
    """
    prior = np.array(PRIOR[titled])
    w = prior.copy()
    if sample.empty:
        return w
    x, y, entry, n = _rows(sample)
    copies = sample["copies"].to_numpy(float)
    has = np.bincount(entry, y, n) > 0
    views = ((copies, has), (copies - y, np.ones(n, bool)))

    def gain(w: np.ndarray) -> float:
        s = np.clip(x @ w, -40, 40)
        return float((s * y).sum() - sum(np.log1p(np.bincount(entry, np.exp(s) * m, n))[on].sum() for m, on in views) - 0.05 * ((w - prior) ** 2).sum())

    best = gain(w)
    for _ in range(50):
        odds = np.exp(np.clip(x @ w, -40, 40))
        grad, hess = y @ x - 0.1 * (w - prior), 0.1 * np.eye(len(w))
        for m, on in views:
            p = odds * m / (1 + np.bincount(entry, odds * m, n))[entry] * on[entry]
            mean = np.stack([np.bincount(entry, p * x[:, k], n) for k in range(len(w))], 1)
            grad, hess = grad - p @ x, hess + (x * p[:, None]).T @ x - mean.T @ mean
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and gain(w + size * step) < best:
            size /= 2
        new = gain(w + size * step)
        if new - best < 1e-6:
            break
        w, best = w + size * step, new
    return w


def confidences(scored: DataFrame, weights: dict[bool, np.ndarray]) -> DataFrame:
    """``(ref_id, id, confidence)``: the likeliest candidate of each entry; its probability among the candidates and none."""
    dot = lambda t: sum((float(w) * F.col(f) for w, f in zip(weights[t], FEATURES)), F.lit(0.0))
    logit = F.least(F.greatest(F.when(F.col("titled"), dot(True)).otherwise(dot(False)), F.lit(-40.0)), F.lit(40.0))
    best = scored.select("e_key", "c_key", "copies", logit.alias("logit")).groupBy("e_key").agg(
        F.min_by(F.struct("c_key", "logit"), F.struct(-F.col("logit"), F.col("c_key"))).alias("best"), F.sum(F.col("copies") * F.exp("logit")).alias("all")
    )
    return best.select(F.col("e_key").alias("ref_id"), F.col("best.c_key").alias("id"), (F.exp("best.logit") / (1 + F.col("all"))).alias("confidence"))


def title_pairs(ents: DataFrame, arts: DataFrame) -> DataFrame:
    """``(e_key, c_key)`` whose vectors lie within CHUNKS - 1 bits and whose whole titles are alike.

    A title of common words only is known by all its words. Vectors of one or two words lie near very many others, so
    the whole titles, and the names where both list some, are compared inside the last join, which moves each entry
    and each near article once. The bits are counted before it, and each measure is taken once.
    """
    def titled(df: DataFrame, side: str, *more: str) -> DataFrame:
        df = df.where(F.col("nt") > 0).withColumn("cb", F.when(F.col("nc") > 0, F.col("cb")).otherwise(F.col("tb")))
        kept = [F.col(c).alias(f"{side}_{c}") for c in ["key", "tb", "ab", "na", *more]]
        return df.select(*kept, F.greatest(_ones(F.col("tb")), F.lit(1)).alias(f"{side}_ones"), F.greatest(_ones(F.col("ab")), F.lit(1)).alias(f"{side}_names"), "cb")

    te, ta = titled(ents, "e", "cut", "nt"), titled(arts, "c")
    near = materialize(hamming_pairs(te, ta), "near")
    close = near.join(ta.withColumnRenamed("cb", "cb_r"), "cb_r").drop("cb_r", "c_names")
    c = F.col
    # _title_score > ALIKE, with the common bits on one side
    least = ALIKE * F.least((c("e_ones") + c("c_ones")) / 2, F.when(c("e_cut") & (c("e_nt") > 2), c("e_ones") / 0.96))
    alike = (c("e_nt") <= 1) | (_common_bits(c("e_tb"), c("c_tb")) > least)
    people = (c("e_na") == 0) | (c("c_na") == 0) | (_common_bits(c("e_ab"), c("c_ab")) >= 0.25 * c("e_names"))
    return te.join(close, (c("cb") == c("cb_l")) & people & alike).select("e_key", "c_key")


def name_pairs(ents: DataFrame, arts: DataFrame) -> DataFrame:
    """``(e_key, c_key)`` of entries with a title and articles that share a word of a name and a telling part of the title.

    Telling parts are the words that are not common, and the first and the last three words, which a title of common
    words keeps when it is cut short or holds a slip elsewhere. Name and part together are shared by few even where
    one name, or one word, is everywhere.
    """
    def keys(df: DataFrame, name: str) -> DataFrame:
        ends = F.array(F.concat_ws(" ", F.lit("^"), F.slice("words", 1, 3)), F.concat_ws(" ", F.lit("$"), F.slice("words", F.greatest(F.size("words") - 2, F.lit(1)), 3)))
        parts = F.concat(F.array_distinct("content"), ends)
        both = F.flatten(F.transform("keys", lambda n: F.transform(parts, lambda w: F.xxhash64(n, w))))
        return df.where(F.col("nt") > 1).select(F.col("key").alias(name), F.explode(F.array_distinct(both)).alias("both"))

    return keys(ents, "e_key").join(keys(arts, "c_key"), "both").select("e_key", "c_key").distinct()


#: What a group of articles, or of entries without a title, has in common besides the year.
WHO = ["ab", "na", "names", "lead", "keys"]


def year_pairs(ents: DataFrame, arts: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs ``(e_key, c_key, holds)``, articles with ``copies``, entries with their ``kind``) for entries without a title.

    All that such an entry says is names and perhaps a year, so articles of the same authors and year are one candidate, which
    counts as many as it has copies, and entries that say the same are one kind, named by the smallest of them. A kind meets all groups that
    share a word of a name, whatever the years, but those whose number of authors rules them out. holds: whether the group has the article of a labelled entry.
    """
    peers = Window.partitionBy(*WHO, "year")
    members = arts.select("key", *WHO, "year").dropDuplicates(["key"]).withColumn("group", F.min("key").over(peers)).withColumn("copies", F.count(F.lit(1)).over(peers))
    members = materialize(members, "groups")
    labels = entries.where(F.col("target_id").isNotNull()).select(F.col("ref_id").alias("key"), "target_id").dropDuplicates(["key"])
    homes = labels.join(members.select(F.col("key").alias("target_id"), F.col("group").alias("home")), "target_id").drop("target_id")
    bare = ents.where(F.col("nt") <= 1).select("key", *WHO, "year", "more", "listed").dropDuplicates(["key"])
    same = Window.partitionBy(*WHO, "year", "more", "listed", "home")
    kinds = materialize(bare.join(homes, "key", "left").withColumn("kind", F.min("key").over(same)), "kinds")
    groups = members.where(F.col("key") == F.col("group"))

    # as many authors, or more than those listed: -1 stands for any number
    says = kinds.where(F.col("key") == F.col("kind")).select(F.col("key").alias("e_key"), "more", F.col("na").alias("e_na"), "home", F.when(F.col("more"), -1).otherwise(F.col("na")).alias("n"), F.explode("keys").alias("name"))
    known = groups.select(F.col("key").alias("c_key"), F.col("na").alias("c_na"), F.explode("keys").alias("name"), "na").withColumn("n", F.explode(F.array("na", F.lit(-1)))).drop("na")
    near = says.join(known, ["name", "n"]).where((F.col("c_na") > 0) & (F.col("e_na") > 0) & (F.col("e_na") <= F.col("c_na")))
    return near.select("e_key", "c_key", F.coalesce(F.col("c_key") == F.col("home"), F.lit(False)).alias("holds")).distinct(), groups, kinds


def shared_classes(scored: DataFrame, kinds: DataFrame) -> DataFrame:
    """Candidates of entries without a title: those of a kind that fit equally well are one, with the smallest id and all copies, and each entry has those of its kind.

    However many works a name has, an entry keeps a few rows.
    """
    told = scored.groupBy("e_key", "titled", "known", *FEATURES)
    classes = told.agg(F.min("c_key").alias("c_key"), F.sum("copies").alias("copies"), F.bool_or("holds").alias("holds"))
    return classes.join(kinds.select(F.col("kind").alias("e_key"), F.col("key").alias("member")), "e_key").drop("e_key").withColumnRenamed("member", "e_key")


def candidates(entries: DataFrame, articles: DataFrame) -> DataFrame:
    """Scored candidate pairs ``(e_key, c_key, copies, titled, known, *FEATURES, holds)`` that are at all possible."""
    common = common_words(articles)
    run, schema = _features("article", "id", common)
    arts = spread(articles.select(F.col("id").alias("__key"), F.col("title").alias("__title"), F.col("info").alias("__info"), F.col("authors").alias("__who"), split_packed(F.col("authors"), "names").alias("__names")))
    arts = materialize(arts.mapInPandas(run, schema.format("string")), "articles")
    run, schema = _features("entry", "ref_id", common)
    clean = lambda c: F.when(F.col(c).rlike(r"[\\<&*_~`$\[{]|''"), strip_markup(F.col(c))).otherwise(F.col(c))
    ents = spread(entries.select(F.col("ref_id").alias("__key"), clean("title").alias("__title"), clean("info").alias("__info"), F.col("author_ln").alias("__who"), F.lit(None).cast("array<string>").alias("__names")))
    ents = materialize(ents.mapInPandas(run, schema.format("bigint")), "entries")

    pairs = title_pairs(ents, arts).unionByName(name_pairs(ents, arts)).distinct()
    by_year, groups, kinds = year_pairs(ents, arts, entries)
    wide = ["words", "lead", "tb", "part", "ab", "na", "year", "names"]
    e = ents.select(F.col("key").alias("e_key"), *[F.col(c).alias(f"e_{c}") for c in [*wide, "listed", "nt", "cut", "more"]], F.when(F.col("nt") <= 1, F.col("keys")).alias("e_keys"))
    a = arts.select(F.col("key").alias("c_key"), *[F.col(c).alias(f"c_{c}") for c in wide], F.lit(1).cast("bigint").alias("copies"), F.lit(False).alias("holds"))
    none = {"words": F.array().cast("array<string>"), "tb": F.array_repeat(F.lit(0).cast("bigint"), LONGS), "part": F.lit(""), "nt": F.lit(0), "cut": F.lit(False)}
    g = groups.select(F.col("key").alias("c_key"), *[none.get(c, F.col(c) if c in groups.columns else None).alias(f"c_{c}") for c in wide], "copies")
    k = kinds.where(F.col("key") == F.col("kind")).select(F.col("key").alias("e_key"), *[none.get(c, F.col(c) if c in kinds.columns else None).alias(f"e_{c}") for c in [*wide, "listed", "nt", "cut", "more"]])
    possible = F.when(F.col("titled"), (F.col("title") > ALIKE) & ~(F.col("known") & (F.col("authors") < 0.4))).otherwise(F.col("known") & F.col("led") & (F.col("authors") > 0.6) & (F.col("all_authors") == 1))
    # an entry of one word meets the articles that share a word of a name by their groups
    apart = (F.col("e_nt") > 1) | ~F.arrays_overlap("e_keys", "c_names")
    by_title = pair_features(pairs.join(a, "c_key").join(e, "e_key").where(apart)).where(possible).drop("led")
    by_names = shared_classes(pair_features(by_year.join(g, "c_key").join(k, "e_key")).where(possible), kinds)
    # rows that share an id are one entry, or one article
    scored = materialize(by_title.dropDuplicates(["e_key", "c_key"]).unionByName(by_names), "scored")
    for used in (ents, arts, groups, kinds):
        discard(used)
    return scored


def labelled(scored: DataFrame, entries: DataFrame) -> pd.DataFrame:
    """Candidates of at most LABELS labelled entries, drawn by hash; of each the RIVALS with the nearest titles, with the right one."""
    labels = entries.where(F.col("target_id").isNotNull()).select(F.col("ref_id").alias("e_key"), "target_id").dropDuplicates(["e_key"]).orderBy(F.xxhash64("e_key"), "e_key").limit(LABELS)
    rows = scored.join(labels, "e_key").withColumn("truth", ((F.col("c_key") == F.col("target_id")) | F.col("holds")).cast("double"))
    order = Window.partitionBy("e_key").orderBy(F.desc("truth"), F.desc("title"), F.desc("authors"), "c_key")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= RIVALS).select("e_key", "c_key", "copies", "titled", "truth", *FEATURES).toPandas()


def link(entries: DataFrame, articles: DataFrame) -> DataFrame:
    """``(ref_id, id, confidence)``: the article each entry cites, at most one."""
    scored = candidates(entries, articles)
    sample = labelled(scored, entries)
    return confidences(scored, {t: fit(sample[sample["titled"] == t], t) for t in (True, False)})


def calibration(scored: DataFrame, entries: DataFrame, bins: int = 10) -> pd.DataFrame:
    """Confidence against truth on held-out labels: weights of one half (by hash of the entry) judge the other, its article shown and hidden.

    One row a bin of confidence: ``(bin, n, confidence, right)``.
    """
    sample = labelled(scored, entries)
    out = []
    for t in (True, False):
        part = sample[sample["titled"] == t]
        fold = pd.util.hash_array(part["e_key"].to_numpy()) % 2
        for k in (0, 1):
            w, test = fit(part[fold != k], t), part[fold == k]
            hidden = test.assign(copies=test["copies"] - test["truth"], truth=0.0)
            for seen in (test, hidden[hidden["copies"] > 0]):
                if seen.empty:
                    continue
                x, y, entry, n = _rows(seen)
                odds = np.exp(np.clip(x @ w, -40, 40))
                p = odds / (1 + np.bincount(entry, odds * seen["copies"].to_numpy(float), n))[entry]
                top = pd.DataFrame({"entry": entry, "confidence": p, "right": y / seen["copies"].to_numpy(float)}).sort_values("confidence").groupby("entry").tail(1)
                out.append(top[["confidence", "right"]])
    if not out:
        return pd.DataFrame({"bin": [], "n": [], "confidence": [], "right": []})
    got = pd.concat(out)
    got["bin"] = np.minimum((got["confidence"] * bins).astype(int), bins - 1)
    return got.groupby("bin").agg(n=("right", "size"), confidence=("confidence", "mean"), right=("right", "mean")).reset_index()


def found(entries: DataFrame, articles: DataFrame) -> DataFrame:
    """``(ref_id, id)`` of the links whose confidence reaches THRESHOLD."""
    return link(entries, articles).where(F.col("confidence") >= THRESHOLD).select("ref_id", "id")
