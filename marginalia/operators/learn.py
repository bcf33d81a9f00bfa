"""Metric learning: triplets, hinge loss and its gradient in closed form, and the training loop.

Only one weight for each dimension is learned, as exp(w), so a step is one
distributed sum of a loss and a vector, and Adam on the driver moves a vector of
fixed length. Rows are read once for each step; nothing else grows on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions.vectors import metric_of
from marginalia.plans.running import hash_order

#: Rows of one ring of a target; larger targets get several rings.
RING = 50_000


def triplets(dataset: DataFrame, seed: int = 42, rings: int | None = None) -> DataFrame:
    """``(anchor, positive, negative)`` row ids: the next row in a seeded ring of the same target, and of another target.

    A target's rows form rings of at most about RING rows, so one target may hold any share of
    the rows. For negatives all rows are dealt into ``rings`` rings by hash, by default a power of two, 16 at least, of some RING rows each. A
    row alone in its target is its own positive; a ring of one target has no
    negative, which is null.
    """
    rings = rings or min(1 << 16, max(16, 1 << (dataset.count() // RING).bit_length()))
    rows = dataset.select("row_id", "target_id").withColumn("h", hash_order(seed, F.col("row_id")))
    sizes = rows.groupBy("target_id").agg(F.ceil(F.count(F.lit(1)) / RING).alias("parts"))
    own = rows.join(sizes, "target_id").withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts")))
    same = Window.partitionBy("target_id", "part").orderBy("h", "row_id")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pos = own.select("row_id", F.coalesce(F.lead("row_id").over(same), F.first("row_id").over(whole)).alias("positive"))
    ring = rows.withColumn("ring", F.pmod(F.conv(F.substring("h", 1, 4), 16, 10).cast("int"), F.lit(rings)))
    order = Window.partitionBy("ring").orderBy("h", "row_id")
    # runs of one target in the ring; the negative is where the next run starts; the last run takes the first one's
    # start, or the second one's where the first has its own target
    runs = ring.withColumn("new", (F.coalesce(F.lag("target_id").over(order) != F.col("target_id"), F.lit(True))).cast("int")).withColumn("run", F.sum("new").over(order))
    starts = runs.where("new = 1").select("ring", "run", F.col("row_id").alias("start"), F.col("target_id").alias("start_target"))
    first = starts.where("run <= 2").groupBy("ring").agg(F.max(F.when(F.col("run") == 1, F.col("start"))).alias("start1"), F.max(F.when(F.col("run") == 1, F.col("start_target"))).alias("target1"), F.max(F.when(F.col("run") == 2, F.col("start"))).alias("start2"))
    neg = runs.join(starts.withColumn("run", F.col("run") - 1), ["ring", "run"], "left").join(first, "ring")
    neg = neg.select("row_id", F.coalesce("start", F.when(F.col("target1") != F.col("target_id"), F.col("start1")), "start2").alias("negative"))
    return pos.join(neg, "row_id").select(F.col("row_id").alias("anchor"), "positive", "negative")


def with_vectors(trip: DataFrame, embedded: DataFrame, width: int) -> DataFrame:
    """``(anchor, a, p, n)``: context vector of the anchor, article vectors of its positive and negative; rows without all three go."""
    good = lambda c: embedded.where((F.size(c) == width) & ~F.exists(c, lambda x: x.isNull()))
    a = good("ctx_vec").select(F.col("row_id").alias("anchor"), F.col("ctx_vec").alias("a"))
    p = good("abs_vec").select(F.col("row_id").alias("positive"), F.col("abs_vec").alias("p"))
    n = good("abs_vec").select(F.col("row_id").alias("negative"), F.col("abs_vec").alias("n"))
    return trip.join(a, "anchor").join(p, "positive").join(n, "negative").select("anchor", "a", "p", "n")


def minibatches(df: DataFrame, key: str, size: int, epoch: int = 0) -> DataFrame:
    """df with ``batch``: rows dealt into batches of ``size`` in an order that changes with the epoch."""
    from marginalia.plans.running import positions

    return positions(df, epoch, key).withColumn("batch", F.floor(F.col("pos") / size)).drop("pos")


def distances(metric: str, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance of each row pair, its derivative by each weight parameter); w are the positive weights."""
    m = metric_of(metric)
    part = m.array(x - y) * w
    total = part.sum(1)
    if m.root:
        root = np.sqrt(total)
        return root, part / np.maximum(2 * root, 1e-12)[:, None]
    return total, part


def _gradient(a: np.ndarray, p: np.ndarray, n: np.ndarray, weights: np.ndarray, margin: float, metric: str) -> tuple[float, np.ndarray]:
    """(sum of the hinge losses, sum of their gradients) of some triplets."""
    dp, gp = distances(metric, a, p, weights)
    dn, gn = distances(metric, a, n, weights)
    h = dp - dn + margin
    on = h > 0
    return float(h[on].sum()), (gp[on] - gn[on]).sum(0)


def _triplet_rows(b: pa.RecordBatch, width: int) -> list[np.ndarray]:
    return [np.asarray(b.column(c).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(b.num_rows, width) for c in ("a", "p", "n")]


def loss_and_gradient(vectors: DataFrame, params: np.ndarray, margin: float, metric: str) -> tuple[int, float, np.ndarray]:
    """(rows, mean hinge loss, mean gradient) over all rows; partial sums leave the executors once a task."""
    weights, width = np.exp(params), len(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, grad = 0, 0.0, np.zeros(width)
        for b in batches:
            more, g = _gradient(*_triplet_rows(b, width), weights, margin, metric)
            n, loss, grad = n + b.num_rows, loss + more, grad + g
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([float(loss)]), pa.array([grad.tolist()], pa.list_(pa.float64()))], names=["n", "loss", "grad"])

    parts = vectors.select("a", "p", "n").mapInArrow(run, "n long, loss double, grad array<double>")
    # rows and loss travel as two more components, so that one sum by place gives all: width + 2 rows for the driver
    whole = F.concat(F.col("grad"), F.array(F.col("n").cast("double"), F.col("loss")))
    sums = parts.select(F.posexplode(whole).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    got = np.zeros(width + 2)
    for r in sums:
        got[r["i"]] = r["x"]
    n = int(got[width])
    return (n, got[width + 1] / n, got[:width] / n) if n else (0, 0.0, np.zeros(width))


@dataclass
class Adam:
    """Adam on one vector, with a rate that a plateau of the loss divides by ten."""

    width: int
    rate: float = 1e-2
    patience: int = 3
    floor: float = 1e-5
    params: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.params, self.m, self.v = (np.zeros(self.width) for _ in range(3))
        self.t, self.best, self.bad = 0, np.inf, 0

    def step(self, grad: np.ndarray) -> None:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        self.params = self.params - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)

    def plateau(self, loss: float) -> None:
        if loss < self.best * (1 - 1e-4):
            self.best, self.bad = loss, 0
        else:
            self.bad += 1
            if self.bad > self.patience:
                self.rate, self.bad = self.rate * 0.1, 0

    @property
    def done(self) -> bool:
        return self.rate <= self.floor


#: One row an epoch; what Adam holds after it, so that training can go on from any row.
LOG = "epoch int, loss double, rate double, accuracy double, params array<double>, m array<double>, v array<double>, t long, best double, bad int"
#: Triplets of one worker in an epoch of mini-batches.
WORKER_ROWS = 20_000


def epoch_of_batches(vectors: DataFrame, adam: Adam, margin: float, metric: str, batch: int, epoch: int, workers: int) -> tuple[int, float]:
    """(rows, mean loss) of an epoch of Adam steps on mini-batches; adam holds the result.

    Each worker takes its share of the rows, in an order seeded by the epoch, batch by batch. With one worker that is the
    plain sequential epoch; the states of several are averaged by their rows at its end, once an epoch, so that the
    driver never sees a batch and its work does not grow with the rows.
    """
    width, start = adam.width, adam

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Adam(width, start.rate)
        mine.params, mine.m, mine.v, mine.t = start.params, start.m, start.v, start.t
        rows, loss, rest = 0, 0.0, None
        for b in batches:
            rest = _triplet_rows(b, width) if rest is None else [np.concatenate(x) for x in zip(rest, _triplet_rows(b, width))]
            while len(rest[0]) >= batch:
                more, g = _gradient(*[x[:batch] for x in rest], np.exp(mine.params), margin, metric)
                rows, loss, rest = rows + batch, loss + more, [x[batch:] for x in rest]
                if more > 0:
                    mine.step(g / batch)
        if rest is not None and len(rest[0]):
            k = len(rest[0])
            more, g = _gradient(*rest, np.exp(mine.params), margin, metric)
            rows, loss = rows + k, loss + more
            if more > 0:
                mine.step(g / k)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([loss]), pa.array([mine.t]), *[pa.array([x.tolist()], pa.list_(pa.float64())) for x in (mine.params, mine.m, mine.v)]], names=["n", "loss", "t", "params", "m", "v"])

    placed = vectors.withColumn("__h", hash_order(epoch, F.col("anchor"))).repartition(workers, F.xxhash64("__h")).sortWithinPartitions("__h", "anchor")
    got = placed.select("a", "p", "n").mapInArrow(run, "n long, loss double, t long, params array<double>, m array<double>, v array<double>").collect()  # one row a worker
    n = sum(r["n"] for r in got)
    if not n:
        return 0, 0.0
    adam.params, adam.m, adam.v = (sum(np.array(r[c]) * (r["n"] / n) for r in got) for c in ("params", "m", "v"))
    adam.t = max(r["t"] for r in got)
    return n, sum(r["loss"] for r in got) / n


def train(vectors: DataFrame, width: int, epochs: int, margin: float = 0.6, metric: str = "euclidean", rate: float = 1e-2, start: DataFrame | None = None, batch: int | None = 64, workers: int | None = None, evaluate: Callable[[np.ndarray], float] | None = None, eval_every: int = 1) -> tuple[np.ndarray, DataFrame]:
    """(parameters, log with the columns of LOG): epochs of mini-batches, or of one whole batch where batch is None.

    The loss of an epoch is the mean before each step. A batch whose loss is 0 makes no step. start goes on from the last row
    of an earlier log, with all that Adam held. evaluate, if given, is asked for the accuracy after every ``eval_every``-th
    epoch. Stops early when the rate has fallen to its floor. workers defaults to one for each WORKER_ROWS rows.
    """
    adam, first, log = Adam(width, rate), 0, []
    if start is not None and (r := start.orderBy(F.desc("epoch")).first()):
        adam.params, adam.m, adam.v = (np.array(r[c], dtype=float) for c in ("params", "m", "v"))
        adam.rate, adam.t, adam.best, adam.bad, first = r["rate"], r["t"], r["best"], r["bad"], r["epoch"] + 1
    if batch and not workers:
        workers = max(1, -(-vectors.count() // WORKER_ROWS))
    for epoch in range(first, first + epochs):
        if adam.done:
            break
        if batch:
            _, loss = epoch_of_batches(vectors, adam, margin, metric, batch, epoch, workers)
        else:
            _, loss, grad = loss_and_gradient(vectors, adam.params, margin, metric)
            if loss > 0:
                adam.step(grad)
        adam.plateau(loss)
        seen = evaluate(np.exp(adam.params)) if evaluate and (epoch + 1) % eval_every == 0 else None
        log.append((epoch, float(loss), float(adam.rate), seen, *[[float(x) for x in y] for y in (adam.params, adam.m, adam.v)], adam.t, float(adam.best), adam.bad))
    return adam.params, vectors.sparkSession.createDataFrame(log, LOG)
