"""Garbled text from wrong character encodings: find the records and restore the text.

Method: a code-page swap is a substitution cipher over the non-ASCII signs of a
word. Each word has a hidden swap (none, or one of the families below); swap
weights, the families' maps and a character bigram model are learned by expectation-maximization
over the whole corpus, and each body then adapts the swap weights to itself (the
body is the source). The maps start from those of the code pages, which are their prior: in
the E-step a sign of a misread word may be any letter, weighted by the bigrams of its neighbours, and
an entry moves where the expected letters outweigh the page's own (``moved``). A
body with words that no family explains gets a free family: its own map, learned
by expectation-maximization from the bigrams of the neighbours (``free_map``), so
single-byte pages outside the list are found too. Maps are applied with
``str.translate``; multi-byte misreadings are ciphers whose symbols are the sign
sequences that are valid UTF-8 in the misread code page.

What leaves the executors in training is bounded by the alphabet, not by the
corpus: signs outside ``ALPHABET`` share one class, so there are at most
``(len(ALPHABET) + 1) ** 2`` bigrams (about half a million, a few MB; a few
thousand in practice), and one weight for each swap.

Defined results: null and blank text is not garbled and is restored as itself;
U+FFFD marks text that was lost in decoding, so it counts as garbled but is left
in place; repeated rows are judged alike; text of any length is read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.plans.runtime import materialize, spread

#: Code pages through which UTF-8 may have been misread.
UTF8_PAGES = ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "iso8859-15", "iso8859-2", "cp1254"]
#: Single-byte swaps: (page the bytes were read with, page they were written in).
SWAPS = [("cp1251", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp1252"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1253", "cp1252"), ("cp1252", "cp1253"), ("iso8859-2", "cp1250"), ("cp1250", "cp1251")]
IDENTITY = "as is"
FAMILIES = [IDENTITY, *[f"utf-8 as {p}" for p in UTF8_PAGES], *[f"{r} as {w}" for w, r in SWAPS]]
ROUNDS = 4
#: Log weights: smoothing of the bigram model and the prior share of words that are right as they stand.
SMOOTH, PRIOR_RIGHT, ADAPT = 0.02, 0.985, 6.0
#: A chance UTF-8 sequence is rare, so such a reading starts with this log weight more.
UTF8_BONUS = 2.0
#: A word does not count as evidence for itself, up to so many times.
RARE = 3.0
FREE = "free map"
#: Prior share of a page's own letter for a sign, and the expected occurrences it starts with, when an entry may move.
OWN_LETTER, OWN_COUNT = 0.9, 3.0
#: Rounds of a free map's learning; the log cost of an entry that moves; the least log gain of a whole map, net of its entries, and of a word.
FREE_ROUNDS, FREE_ENTRY, FREE_MAP, FREE_WORD = 8, 5.0, 12.0, 4.0
#: Distinct words that a free map must restore, and how often the model must hold a letter for a sign to stand for it.
FREE_WORDS, FREE_LETTER = 3, 5.0
#: Words kept in a task's memo; it is emptied when full, which costs time only.
MEMO = 200_000

_BLOCKS = [(0x20, 0x24F), (0x2B0, 0x2FF), (0x370, 0x45F), (0x2010, 0x2044), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2190, 0x21FF), (0x2200, 0x22FF), (0x2310, 0x2321), (0x2500, 0x259F), (0x25A0, 0x25FF), (0xFB00, 0xFB06), (0xFFFD, 0xFFFD)]
ALPHABET = "".join(chr(c) for a, b in _BLOCKS for c in range(a, b + 1))
_KNOWN = frozenset(ALPHABET)
OTHER = "￿"
EDGE = " "
_SPLIT = re.compile(r"[ \t\n\r\f\v]+")
_HIGH = re.compile(r"[^\x00-\x7f]")
_HIGH_RUNS = re.compile(r"[^\x00-\x7f]+")
_HIGH_RUN = re.compile(r"[^\x00-\x7f]{2}")


def _byte_map(page: str) -> dict[str, int]:
    """Sign to byte of a code page; bytes it leaves undefined stand for the C1 control of that number."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            pass
        out.setdefault(chr(b), b) if b < 160 else None
    return out


_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_PAGES: dict[str, dict[str, int]] = {p: _byte_map(p) for p in UTF8_PAGES}


def undo_utf8(word: str, page: str) -> str:
    """Put together the UTF-8 sequences that were read through a code page, repeatedly (for double encoding)."""
    table = _PAGES[page]
    for _ in range(3):
        raw, out, changed, i = [table.get(c, -1) for c in word], [], False, 0
        while i < len(word):
            b = raw[i]
            n = 0 if b < 0xC2 or b > 0xF4 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            seq = raw[i : i + n]
            if n and len(seq) == n and min(seq) >= 0x80 and _UTF8.fullmatch(bytes(seq)):
                try:
                    out.append(bytes(seq).decode("utf-8"))
                    changed, i = True, i + n
                    continue
                except UnicodeDecodeError:
                    pass
            out.append(word[i])
            i += 1
        if not changed:
            break
        word = "".join(out)
    return word


def swap_tables() -> dict[str, dict[int, str]]:
    """The byte-to-letter maps: for each swap, what each misread sign was written as."""
    out = {}
    for wrong, right in SWAPS:
        table = {}
        for b in range(128, 256):
            try:
                w, r = bytes([b]).decode(wrong), bytes([b]).decode(right)
            except UnicodeDecodeError:
                continue
            if w != r:
                table[ord(w)] = r
        out[f"{right} as {wrong}"] = table
    return out


class Model:
    """Bigram counts, swap weights and maps; small, and sent to the executors with each task."""

    def __init__(self, bigrams: Counter, weights: dict[str, float], tables: dict[str, dict[int, str]]):
        self.bigrams, self.weights, self.tables = bigrams, weights, tables
        self.firsts: Counter = Counter()
        for (a, _), n in bigrams.items():
            self.firsts[a] += n
        self.size = max(200, len(self.firsts))
        self._logs: dict[str, float] = {}
        self.letters = sorted(c for c, n in self.firsts.items() if c > "\x9f" and c not in (OTHER, "\ufffd") and n >= FREE_LETTER)

        self.place = {c: i for i, c in enumerate(self.letters)}
        self._after: dict[str, np.ndarray] = {}
        self._before: dict[str, np.ndarray] = {}

    def _near(self, memo: dict[str, np.ndarray], c: str, first: bool) -> np.ndarray:
        if c not in memo:
            c_ = c if c in _KNOWN else OTHER
            pairs = [(c_, x) if first else (x, c_) for x in self.letters]
            memo[c] = np.array([(self.bigrams.get(a + b, 0.0) + SMOOTH) / (self.firsts.get(a, 0.0) + SMOOTH * self.size) for a, b in pairs])
        return memo[c]

    def after(self, c: str) -> np.ndarray:
        """Probability of each letter behind c."""
        return self._near(self._after, c, True)

    def before(self, c: str) -> np.ndarray:
        """Probability of c behind each letter."""
        return self._near(self._before, c, False)

    def score(self, word: str, without: float = 0.0, edged: str | None = None) -> float:
        """Log likelihood of a word with its edges (blanks, or as given); ``without`` counts of it are taken out of the model first."""
        w, total = "".join(c if c in _KNOWN else OTHER for c in edged) if edged else _edged(word), 0.0
        for k in range(len(w) - 1):
            pair = w[k : k + 2]
            got = self._logs.get(pair) if not without else None
            if got is None:
                n, m = self.bigrams.get(pair, 0) - without, self.firsts.get(pair[0], 0) - without
                got = math.log((max(n, 0.0) + SMOOTH) / (max(m, n, 0.0) + SMOOTH * self.size))
                if not without:
                    self._logs[pair] = got
            total += got
        return total

    def readings(self, word: str) -> dict[str, str]:
        """Each family's reading of a word, where it differs from the word."""
        out = {IDENTITY: word}
        for p in UTF8_PAGES:
            r = undo_utf8(word, p)
            if r != word:
                out[f"utf-8 as {p}"] = r
        for f, table in self.tables.items():
            r = word.translate(table)
            if r != word and not any(0x80 <= ord(c) < 0xA0 for c in r):
                out[f] = r
        return out

    def likelihoods(self, word: str, n: float = 0.0) -> dict[str, tuple[float, str]]:
        """Log likelihood and reading of each family; n: how often the word itself is counted in the model."""
        return {f: (self.score(r, min(n, RARE) if f == IDENTITY else 0.0) + (UTF8_BONUS if f.startswith("utf-8") else 0.0), r) for f, r in self.readings(word).items()}

    def shares(self, known: dict[str, tuple[float, str]], weights: dict[str, float]) -> dict[str, tuple[float, str]]:
        """Share and reading of each family for one word of known likelihoods."""
        logs = {f: math.log(weights.get(f, 1e-6) + 1e-9) + v for f, (v, _) in known.items()}
        top = max(logs.values())
        exps = {f: math.exp(v - top) for f, v in logs.items()}
        z = sum(exps.values())
        return {f: (e / z, known[f][1]) for f, e in exps.items()}


def _pairs(words: pd.Series, counts: pd.Series) -> Counter:
    out: Counter = Counter()
    for w, n in zip(words, counts):
        w = EDGE + "".join(c if c in _KNOWN else OTHER for c in w) + EDGE
        for k in range(len(w) - 1):
            out[w[k : k + 2]] += n
    return out


def _start_weights() -> dict[str, float]:
    rest = (1 - PRIOR_RIGHT) / (len(FAMILIES) - 1)
    return {f: PRIOR_RIGHT if f == IDENTITY else rest for f in FAMILIES}


def letters_meant(word: str, reading: str, model: Model) -> list[tuple[str, np.ndarray]]:
    """For each sign of a misread word, how likely each of the model's letters is, by its neighbours in the reading."""
    letters, r, out = model.letters, EDGE + reading + EDGE, []
    for i, (a, own) in enumerate(zip(word, reading), 1):
        if a <= "\x7f" or not letters:
            continue
        q = model.after(r[i - 1]) * model.before(r[i + 1]) * ((1 - OWN_LETTER) / max(len(letters) - 1, 1))
        rest = 0.0
        if own in model.place:
            q[model.place[own]] *= OWN_LETTER * max(len(letters) - 1, 1) / (1 - OWN_LETTER)
        else:  # a letter that the corpus does not hold
            rest = OWN_LETTER * math.exp(model.score(own, edged=r[i - 1] + own + r[i + 1]))
        out.append((a, q / max(q.sum() + rest, 1e-300)))
    return out


def moved(table: dict[int, str], meant: dict[str, dict[str, float]]) -> dict[int, str]:
    """A map after its M-step: signs whose expected letter outweighs the one they have take it, unless another sign has it with more right.

    meant: expected occurrences of the letters of each sign.
    """
    out = dict(table)
    weight = {a: {**c, table[ord(a)]: c.get(table[ord(a)], 0.0) + OWN_COUNT} for a, c in meant.items() if ord(a) in table}
    for a, c in sorted(weight.items(), key=lambda x: -max(x[1].values())):
        best = max(c, key=lambda k: (c[k], k))
        holders = [chr(b) for b, k in out.items() if k == best and chr(b) != a]
        if best != out[ord(a)] and all(weight.get(h, {}).get(best, OWN_COUNT) < c[best] for h in holders):
            out[ord(a)] = best
    return out


def learn(texts: DataFrame, column: str, rounds: int = ROUNDS) -> Model:
    """Learn swap weights and bigrams from all texts. An empty table gives the start model."""
    words = (
        texts.where(F.col(column).isNotNull())
        .select(F.explode(F.split(F.col(column), r"[ \t\n\r\f\x0b]+")).alias("word"))
        .where(F.col("word") != "")
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )
    words = materialize(words, "words")

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            total.update(_pairs(b["word"], b["n"]))
        if total:
            yield pd.DataFrame({"key": list(total), "n": [float(v) for v in total.values()]})

    ascii_only = ~F.col("word").rlike(r"[^\x00-\x7f]")
    fixed = Counter({r["key"]: r["n"] for r in words.where(ascii_only).mapInPandas(plain, "key string, n double").groupBy("key").agg(F.sum("n").alias("n")).collect()})
    odd = words.where(~ascii_only)
    first = Counter({r["key"]: r["n"] for r in odd.mapInPandas(plain, "key string, n double").groupBy("key").agg(F.sum("n").alias("n")).collect()})
    model = Model(fixed + first, _start_weights(), swap_tables())
    for _ in range(rounds):
        def expect(batches: Iterator[pd.DataFrame], m: Model = model) -> Iterator[pd.DataFrame]:
            total: Counter = Counter()
            for b in batches:
                for w, n in zip(b["word"], b["n"]):
                    for f, (p, r) in m.shares(m.likelihoods(w, n), m.weights).items():
                        if p < 1e-4:
                            continue
                        total["f", f] += p * n
                        if p >= 0.5 and f in m.tables and len(r) == len(w):
                            meant = letters_meant(w, r, m)
                            for a, q in meant:
                                for j in np.flatnonzero(q > 0.01):
                                    total["m", f"{f}\t{a}{m.letters[j]}"] += p * n * float(q[j])
                            # the letters that are meant are what the word teaches, not those that the map has so far
                            to = {ord(a): m.letters[int(q.argmax())] for a, q in meant if q.max() > 0.5}
                            r = "".join(to.get(ord(a), c) if a != c else c for a, c in zip(w, r))
                        for k, v in _pairs([r], [p * n]).items():
                            total["b", k] += v
            if total:
                yield pd.DataFrame({"kind": [k[0] for k in total], "key": [k[1] for k in total], "n": [float(v) for v in total.values()]})

        got = odd.mapInPandas(expect, "kind string, key string, n double").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
        seen: dict[str, Counter] = {"f": Counter(), "b": Counter(), "m": Counter()}
        for r in got:
            seen[r["kind"]][r["key"]] += r["n"]
        total = sum(seen["f"].values()) or 1.0
        prior = _start_weights()
        weights = {f: (seen["f"].get(f, 0.0) + 20 * prior[f]) / (total + 20) for f in FAMILIES}
        meant: dict[str, dict[str, dict[str, float]]] = {}
        for key, n in seen["m"].items():
            f, _, pair = key.partition("\t")
            meant.setdefault(f, {}).setdefault(pair[0], {})[pair[1]] = n
        model = Model(fixed + seen["b"], weights, {f: moved(t, meant.get(f, {})) for f, t in model.tables.items()})
    return model


class Apart:
    """A model without what one body's own words have told it; they would else be evidence for themselves."""

    def __init__(self, model: Model, words: list[str]):
        self.model, self.own, self.firsts = model, _pairs(pd.Series(words), pd.Series([RARE] * len(words))), Counter()
        for (a, _), n in self.own.items():
            self.firsts[a] += n

    def count(self, a: str, b: str) -> float:
        return max(self.model.bigrams.get(a + b, 0.0) - self.own.get(a + b, 0.0), 0.0)

    def log(self, a: str, b: str) -> float:
        n = self.count(a, b)
        return math.log((n + SMOOTH) / (max(self.model.firsts.get(a, 0.0) - self.firsts.get(a, 0.0), n) + SMOOTH * self.model.size))

    def score(self, word: str) -> float:
        w = _edged(word)
        return sum(self.log(a, b) for a, b in zip(w, w[1:]))

    def attested(self, word: str) -> bool:
        """Are all pairs with a sign beyond ASCII known from other texts?"""
        w = _edged(word)
        return all(self.count(a, b) > 0 for a, b in zip(w, w[1:]) if a > "\x7f" or b > "\x7f")


def _edged(word: str) -> str:
    return EDGE + "".join(c if c in _KNOWN else OTHER for c in word) + EDGE


def free_map(words: list[str], model: Model) -> dict[int, str]:
    """Map of the signs of one source's words to letters, by expectation-maximization; empty where no map explains them better.

    words: each occurrence of the words beyond ASCII that no family explains. E-step: forward and backward over each
    word, where a sign may be any letter of the model, weighted by the bigrams of its neighbours and the map so far.
    M-step: the expected letters of a sign are its new map.
    """
    apart = Apart(model, words)
    odd = sorted({w for w in words if not apart.attested(w)})
    if len(odd) < FREE_WORDS:
        return {}
    signs = sorted({c for w in odd for c in w if c > "\x7f" and c != "\ufffd"})
    letters = sorted(set(model.letters) | set(signs))
    place = {c: i for i, c in enumerate(letters)}
    shown = [c if c in _KNOWN else OTHER for c in letters]
    inner = np.exp([[apart.log(a, b) for b in shown] for a in shown]) if any(_HIGH_RUN.search(w) for w in odd) else None
    after: dict[str, np.ndarray] = {}
    before: dict[str, np.ndarray] = {}
    emit = {x: np.full(len(letters), 0.5 / len(letters)) for x in signs}
    for x in signs:
        emit[x][place[x]] += 0.5
    for _ in range(FREE_ROUNDS):
        total = {x: np.zeros(len(letters)) for x in signs}
        for w in odd:
            # runs of signs between two ASCII signs or edges are independent of each other
            for m in _HIGH_RUNS.finditer(w):
                run, a, b = m.group(), w[m.start() - 1] if m.start() else EDGE, w[m.end()] if m.end() < len(w) else EDGE
                if any(x not in emit for x in run):
                    continue
                if a not in after:
                    after[a] = np.exp([apart.log(a, c) for c in shown])
                if b not in before:
                    before[b] = np.exp([apart.log(c, b) for c in shown])
                fore, back = [after[a] * emit[run[0]]], [before[b]]
                for x in run[1:]:
                    v = (fore[-1] @ inner) * emit[x]
                    fore.append(v / max(v.sum(), 1e-300))
                for x in run[:0:-1]:
                    v = inner @ (back[-1] * emit[x])
                    back.append(v / max(v.sum(), 1e-300))
                for x, f, g in zip(run, fore, reversed(back)):
                    q = f * g
                    total[x] += q / max(q.sum(), 1e-300)
        for x in signs:
            v = total[x] + 0.5 / len(letters)
            emit[x] = v / v.sum()
    table: dict[int, str] = {}
    # a code page gives each sign another letter
    for n, x, c in sorted(((total[x].max(), x, letters[int(emit[x].argmax())]) for x in signs), reverse=True):
        if c != x and c not in table.values():
            table[ord(x)] = c

    base = {w: apart.score(w) for w in odd}

    def gains(t: dict[int, str]) -> list[float]:
        return [apart.score(w.translate(t)) - v for w, v in base.items()]

    while table:
        gain = gains(table)
        net = sum(gain) - FREE_ENTRY * len(table)
        less = max(((sum(gains({k: v for k, v in table.items() if k != x})) - FREE_ENTRY * (len(table) - 1), x) for x in table), default=(net, 0))
        if less[0] <= net:
            break
        del table[less[1]]
    right = [w for w, g in zip(base, gains(table)) if g >= FREE_WORD and apart.attested(w.translate(table))] if table else []
    return table if len(right) >= FREE_WORDS and 2 * len(right) > len(odd) and net >= FREE_MAP else {}


def restore_text(text: str | None, model: Model, memo: dict | None = None) -> tuple[str | None, int, bool, str | None]:
    """(restored text, garbled words, garbled at all, main swap) of one text; the swap weights adapt to it first."""
    if not text or not _HIGH.search(text):
        return text, 0, False, None
    memo = {} if memo is None else memo
    if len(memo) > MEMO:
        memo.clear()
    parts = re.split(r"([ \t\n\r\f\v]+)", text)
    odd = [k for k in range(0, len(parts), 2) if _HIGH.search(parts[k])]
    total = dict.fromkeys(FAMILIES, 0.0)
    known = {}
    for k in odd:
        w = parts[k]
        if w not in memo:
            like = model.likelihoods(w)
            memo[w] = like, model.shares(like, model.weights)
        known[w] = memo[w][0]
        for f, (p, _) in memo[w][1].items():
            total[f] += p
    n = len(odd)
    own = {f: (ADAPT * model.weights[f] + total[f]) / (ADAPT + n) for f in FAMILIES}
    bad, used, second, still, partly = 0, Counter(), {}, [], []
    for k in odd:
        w = parts[k]
        if w not in second:
            post = model.shares(known[w], own)
            f = max(post, key=lambda x: post[x][0])
            second[w] = (IDENTITY, w) if f == IDENTITY or post[IDENTITY][0] > 0.3 else (f, post[f][1])
        f, r = second[w]
        if f != IDENTITY:
            bad += 1
            used[f] += 1
            if len(r) == len(w):
                partly.append((k, w))
            parts[k] = r
        else:
            still.append(k)
    if len(still) >= FREE_WORDS:
        table = free_map([parts[k] for k in still], model)
        for k in still if table else ():
            r = parts[k].translate(table)
            if r != parts[k]:
                bad += 1
                used[FREE] += 1
                parts[k] = r
        # signs that a family of single bytes has left as they were in a word
        for k, w in partly if table else ():
            r = "".join(table.get(ord(a), a) if a == c else c for a, c in zip(w, parts[k]))
            if model.score(r) > model.score(parts[k]):
                parts[k] = r
    lost = "\ufffd" in text
    return "".join(parts), bad, bool(bad) or lost, used.most_common(1)[0][0] if used else None


def restore(texts: DataFrame, key: str, column: str, model: Model | None = None) -> DataFrame:
    """``(key, restored, garbled_words, garbled, swap)`` for each row of texts."""
    model = model or learn(texts.select(column), column)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for b in batches:
            got = [restore_text(t, model, memo) for t in b["__text"]]
            yield pd.DataFrame({key: b[key], "restored": pd.Series([g[0] for g in got], dtype=object), "garbled_words": np.array([g[1] for g in got], dtype="int32"), "garbled": np.array([g[2] for g in got], dtype=bool), "swap": pd.Series([g[3] for g in got], dtype=object)})

    rows = spread(texts.select(F.col(key), F.col(column).alias("__text")))
    kind = dict(rows.dtypes)[key]
    return rows.mapInPandas(run, f"{key} {kind}, restored string, garbled_words int, garbled boolean, swap string")


def found(texts: DataFrame, key: str, column: str) -> DataFrame:
    """Keys of the texts that hold garbled words or lost signs."""
    return restore(texts, key, column).where("garbled").select(key)
