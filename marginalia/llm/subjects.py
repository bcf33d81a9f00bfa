"""Subject areas of each document: none, one or more.

Method: complement naive Bayes, trained from labelled documents (and the subjects'
own descriptions), refined by expectation-maximization over all documents, with
independent calibrated posteriors. Subjects mix within a text, so the hidden
variable of the EM is the subject of each sentence, and a document's evidence for
a subject is the share of its telling sentences.

Words and word pairs are hashed into ``DIMS`` places, so the model has a fixed
size (DIMS x subjects floats, 8 MB for eight subjects) however large the corpus
is, and its broadcast is bounded. Counts are summed per partition before they are
shuffled, over all documents.

Calibration fits one logistic curve for each subject on at most ``LABELS``
labelled documents, drawn towards a common curve where a subject has few labels.
It is out of fold: labelled documents are dealt into two halves, and each is judged
by a model without its own counts.

Labelled documents all have a subject, so what has none is told by novelty: the
evidence of the labels and descriptions alone, summed over a document, must reach that of all but
``EDGE`` of the labelled documents (out of fold). Documents below have no subject and teach the EM
nothing; notes on records would otherwise drift to a subject by teaching themselves.

Defined results: null, empty and blank texts have no subject, nor have texts
without telling sentences; copies are judged alike; repeated labels count once;
without labels the descriptions alone train the model; labels of unknown
documents or subjects are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.plans.runtime import materialize, spread

DIMS = 1 << 18
ROUNDS = 3
LABELS = 20_000
#: Smoothing of the counts, weight of unlabelled sentences, sharpness, and how sure a telling sentence is.
ALPHA, UNLABELLED, SHARP, SURE = 0.05, 0.5, 1.0, 0.8
#: Smoothing of the counts that give evidence: a word seen once by chance is to say little there.
CAUTIOUS = 0.5
#: Share of the labelled documents whose evidence may lie below what a document needs to have a subject.
EDGE = 0.005
THRESHOLD = 0.5
MEMO = 500_000

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]{2,}(?:[-’'][^\W\d_]+)*")


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode()) % DIMS


def sentence_features(text: str | None, memo: dict[str, int] | None = None) -> list[list[int]]:
    """Hashed words and word pairs of each sentence that has any."""
    memo = {} if memo is None else memo
    out = []
    for s in _SENTENCE.split(text or ""):
        words = _WORD.findall(s.lower())
        if not words:
            continue
        row = []
        for f in [*words, *map(" ".join, zip(words, words[1:]))]:
            h = memo.get(f)
            if h is None:
                if len(memo) >= MEMO:
                    memo.clear()
                h = memo[f] = _hash(f)
            row.append(h)
        out.append(row)
    return out


def features(docs: DataFrame) -> DataFrame:
    """``(doc_id, labels, sizes, places)``: features of all sentences in one list, and how many each sentence has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for b in batches:
            got = [sentence_features(t, memo) for t in b.column(2).to_pylist()]
            sizes = [[len(s) for s in d] for d in got]
            places = [[p for s in d for p in s] for d in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "labels", "sizes", "places"])

    return spread(docs.select("doc_id", "labels", "text")).mapInArrow(run, "doc_id long, labels array<string>, sizes array<int>, places array<int>")


def weights(counts: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Complement naive Bayes: for each place and subject, how unlikely it is among the other subjects, centred over subjects."""
    other = counts.sum(1, keepdims=True) - counts
    w = -np.log((other + alpha) / (other.sum(0, keepdims=True) + alpha * len(counts)))
    return (w - w.mean(1, keepdims=True)).astype(np.float32)


def _batch(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, sentence of each place, document row of each sentence) of a batch of features."""
    sizes, places = b.column("sizes"), b.column("places")
    flat_sizes = sizes.flatten().to_numpy(zero_copy_only=False)
    per_doc = np.diff(sizes.offsets.to_numpy()) if len(sizes) else np.zeros(0, int)
    return places.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(flat_sizes)), flat_sizes), np.repeat(np.arange(len(per_doc)), per_doc)


def scores(places: np.ndarray, sentence: np.ndarray, n: int, w: np.ndarray) -> np.ndarray:
    """Sum of the weights of each sentence's places, by subject; sentences come in order and none is empty."""
    if not n:
        return np.zeros((0, w.shape[1]))
    return np.add.reduceat(w[places], np.searchsorted(sentence, np.arange(n)), axis=0).astype(float)


def by_document(doc: np.ndarray, values: np.ndarray, n_docs: int) -> np.ndarray:
    """Sums over the sentences of each document, by subject."""
    return np.stack([np.bincount(doc, weights=values[:, c], minlength=n_docs) for c in range(values.shape[1])], 1) if len(doc) else np.zeros((n_docs, values.shape[1]))


def evidence(places: np.ndarray, sentence: np.ndarray, doc: np.ndarray, n_docs: int, w: np.ndarray) -> np.ndarray:
    """Of each document, how much its words favour the subject that they favour most."""
    return by_document(doc, scores(places, sentence, len(doc), w), n_docs).max(1)


def judge(places: np.ndarray, sentence: np.ndarray, doc: np.ndarray, n_docs: int, w: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each sentence, prior of each document): sentences and their document's mix, settled in two rounds."""
    k = w.shape[1]
    n = len(doc)
    score = SHARP * scores(places, sentence, n, w)
    prior = np.full((n_docs, k), 1.0 / k)
    if allowed is not None:
        prior = allowed / np.maximum(allowed.sum(1, keepdims=True), 1e-9)
    post = np.zeros((n, k))
    for _ in range(2):
        z = score + np.log(prior[doc] + 1e-6)
        z -= z.max(1, keepdims=True)
        post = np.exp(z)
        post /= post.sum(1, keepdims=True)
        mass = by_document(doc, post, n_docs)
        mix = (mass + 0.5) / (mass.sum(1, keepdims=True) + 0.5 * k)
        prior = mix if allowed is None else np.where(allowed > 0, mix, 1e-9)
    return post, prior


def _count(feats: DataFrame, w: np.ndarray | None, names: list[str], first: np.ndarray | None = None, least: float = 0.0) -> np.ndarray:
    """Expected counts by place and subject over the documents; w None: of labelled documents alone.

    Documents without labels count where their evidence by the weights ``first`` reaches ``least``.
    """
    k = len(names)
    model = feats.sparkSession.sparkContext.broadcast((w, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DIMS, k))
        w, first = model.value
        for b in batches:
            places, sentence, doc = _batch(b)
            known = np.array([[1.0 if s in x else 0.0 for s in names] for x in (set(v or ()) for v in b.column("labels").to_pylist())]).reshape(b.num_rows, k)
            has = known.sum(1) > 0
            if w is None:
                share = known / np.maximum(known.sum(1, keepdims=True), 1)
                p = share[doc]
            else:
                allowed = np.where(has[:, None], known, 1.0)
                p, _ = judge(places, sentence, doc, b.num_rows, w, allowed)
                enough = has | (evidence(places, sentence, doc, b.num_rows, first) >= least)
                p = np.where((p.max(1, keepdims=True) >= SURE) & enough[doc][:, None], p, 0.0) * np.where(has[doc], 1.0, UNLABELLED)[:, None]
            if len(places):
                for c in range(k):
                    on = np.flatnonzero(p[:, c] > 1e-4)  # most sentences are of one subject
                    if len(on):
                        mine = np.zeros(len(p), bool)
                        mine[on] = True
                        at = mine[sentence]
                        total[:, c] += np.bincount(places[at], weights=p[sentence[at], c], minlength=DIMS)
        at = np.flatnonzero(total.sum(1) > 1e-6)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("int32"))] + [pa.array(total[at, c]) for c in range(k)], names=["place"] + [f"c{c}" for c in range(k)])

    schema = "place int, " + ", ".join(f"c{c} double" for c in range(k))
    rows = feats if w is not None else feats.where(F.col("labels").isNotNull())
    got = rows.mapInArrow(run, schema).groupBy("place").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(k)]).toPandas()
    model.destroy(True)  # each leaves its copies on the disks of all nodes else
    out = np.zeros((DIMS, k))
    if len(got):
        out[got["place"].to_numpy()] = got[[f"c{c}" for c in range(k)]].to_numpy()
    return out


def shares(feats: DataFrame, model: Broadcast, k: int) -> DataFrame:
    """``(doc_id, labels, telling, evidence, share)``: number of telling sentences, evidence, and each subject's share of the telling words.

    model holds the weights that judge, and those that say how much evidence there is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, first = model.value
        for b in batches:
            places, sentence, doc = _batch(b)
            p, _ = judge(places, sentence, doc, b.num_rows, w)
            tells = (p.max(1) >= SURE) if len(p) else np.zeros(0, bool)
            size = np.bincount(sentence, minlength=len(doc)).astype(float) if len(doc) else np.zeros(0)
            mass = by_document(doc, p * (tells * size)[:, None], b.num_rows)
            n = np.bincount(doc, weights=tells, minlength=b.num_rows) if len(doc) else np.zeros(b.num_rows)
            share = mass / np.maximum(mass.sum(1, keepdims=True), 1e-9)
            much = evidence(places, sentence, doc, b.num_rows, first)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("labels"), pa.array(n), pa.array(much), pa.array(list(share), pa.list_(pa.float64()))], names=["doc_id", "labels", "telling", "evidence", "share"])

    return feats.mapInArrow(run, "doc_id long, labels array<string>, telling double, evidence double, share array<double>")


def calibrate(share: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """(offset, slope) of each subject's logistic curve over its share, drawn towards a common curve at a share of a fifth."""
    k = truth.shape[1]
    out = np.tile(np.array([-6.0, 30.0]), (k, 1))
    base = out[0].copy()
    x_all, y_all = share.ravel(), truth.ravel()
    for c in [-1, *range(k)]:
        x, y = (x_all, y_all) if c < 0 else (share[:, c], truth[:, c])
        m = np.stack([np.ones(len(x)), x], 1)
        v, pull = base.copy(), np.array([0.05, 0.002]) if c < 0 else np.array([1.0, 0.05])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(m @ v, -30, 30)))
            step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + np.diag(pull), m.T @ (y - p) - pull * (v - base))
            v = v + np.clip(step, -10, 10)
        if c < 0:
            base = v
        else:
            out[c] = v
    return out


def subjects(docs: DataFrame, kinds: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, subject, share, posterior)`` for each document and subject it has any telling sentence of."""
    spark = docs.sparkSession
    known = kinds.orderBy("subject").collect()  # one row a subject
    names = [r["subject"] for r in known]
    mine = labels.where(F.col("subject").isin(names)).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("labels"))
    # labels join the texts, which are smaller than the features
    feats = materialize(features(docs.select("doc_id", "text").join(mine, "doc_id", "left")), "features")
    start = np.zeros((DIMS, len(names)))
    for c, r in enumerate(known):
        for s in sentence_features(f"{r['label'] or ''}. {r['about'] or ''}"):
            for p in s:
                start[p, c] += 1.0
    halves = [feats.where(F.col("labels").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == h)) for h in (0, 1)]
    given = [_count(h, None, names) for h in halves]
    others = [weights(start + given[1], CAUTIOUS), weights(start + given[0], CAUTIOUS)]
    # what chance has tied to a subject stands in one half only, and counts half here; what is telling stands in both
    first = (others[0] + others[1]) / 2

    def sample_of(models: list[np.ndarray]) -> pd.DataFrame:
        """Labelled documents by the model of the other half."""
        sent = [spark.sparkContext.broadcast(x) for x in zip(models, others)]
        judged = [shares(h, m, len(names)) for h, m in zip(halves, sent)]
        out = judged[0].unionByName(judged[1]).where(F.col("telling") > 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELS).toPandas()
        for m in sent:
            m.destroy(True)
        return out

    early = [weights(start + given[1]), weights(start + given[0])]
    alone = sample_of(early)
    least = float(alone["evidence"].quantile(EDGE, interpolation="lower")) if len(alone) else 0.0
    counts = start + given[0] + given[1]
    for _ in range(rounds):
        last = weights(counts)
        counts = start + _count(feats, last, names, first, least)
    w = weights(counts)
    # the last round once more for each half, to take its own counts out again
    sample = sample_of([weights(np.maximum(counts - _count(h, last, names, first, least), 0.0)) for h in halves] if rounds else early)
    judged = shares(feats, spark.sparkContext.broadcast((w, first)), len(names)).where((F.col("telling") > 0) & (F.col("evidence") >= least))
    share = np.array(sample["share"].tolist()).reshape(len(sample), len(names))
    truth = np.array([[1.0 if s in set(x) else 0.0 for s in names] for x in sample["labels"]]).reshape(len(sample), len(names))
    curve = calibrate(share, truth)
    pos = judged.select("doc_id", F.posexplode("share").alias("k", "share")).where(F.col("share") > 0)
    table = spark.createDataFrame([(k, n, float(a), float(b)) for k, (n, (a, b)) in enumerate(zip(names, curve))], "k int, subject string, a double, b double")
    return pos.join(F.broadcast(table), "k").select("doc_id", "subject", "share", (1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("share"))))).alias("posterior"))


def found(docs: DataFrame, kinds: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, subject)`` where the posterior reaches THRESHOLD."""
    return subjects(docs, kinds, labels).where(F.col("posterior") >= THRESHOLD).select("doc_id", "subject")
