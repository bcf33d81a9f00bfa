"""Most similar vectors for every vector, by cosine.

Method: NN-descent. Random hyperplane cells give a first neighbour graph; Spark
joins of neighbours of neighbours improve it round by round; queries that are no
part of the graph walk it greedily. The descent works on sketches (random
projections of ``DIM`` bytes), and the ``GRAPH`` nearest by sketch are then
measured on the vectors themselves, rounded to bytes.

What moves: a vector's bytes once to its id and once to each block that needs it.
Blocks gather nodes with a common smallest neighbour of a neighbour, so most of a
node's neighbours are at home in its own block and a sketch or vector is sent
to little more than one place. Cells and blocks are split by deeper hyperplanes,
then by hash, so that none exceeds a few thousand vectors whatever share of
the data lies together.

Equal vectors are one node of the graph, named by the smallest of their ids, and are told
apart again at the end (``told_apart``). A node takes part in the lists of at most ``REVERSE``
of those that name it, the most similar; it is in all of their own lists still.

Stated loss: at least 0.98 of the true five neighbours are found (measured
against brute force by the tests and in the README).

Defined results: null, empty and all-zero vectors, and vectors that hold a null
or another number than the usual one of components, are no part of the collection; an id
with several rows counts once; identical vectors of different ids are neighbours
at similarity 1; ties go to the smaller id; a collection of n vectors gives each
min(k, n - 1) neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.plans.runtime import discard, materialize, spread

DIM, LEAF, BLOCK = 96, 1024, 4096
#: Neighbours kept by the graph, those joined in a round, and those each cell proposes.
GRAPH, JOINED, PROPOSED = 12, 8, 7
ROUNDS, DEPTH, SEED = 3, 30, 11
#: Nearest by which nodes find their home; the farther ones lead out of what lies together.
LABELLED = 4
#: Most nodes that name a node and are joined at it, the most similar of them.
REVERSE = 64
#: Least number of tables of hyperplane cells.
TABLES = 6
#: Standard errors of a sketch that a candidate may lie below the k-th best.
ERRORS = 3.0
#: Rows up to which the sizes of the cells are broadcast; beyond them they are joined by shuffling.
SMALL = 200_000
#: Nodes at which a query enters the graph, for each table.
DOORS = 128


def _projection(width: int, tables: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, width])
    return rng.standard_normal((width, DIM + DEPTH * tables)).astype(np.float32)


def _matrix(ids: pa.Array, vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of the usable rows of a batch."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1))
    good = np.flatnonzero((sizes == width) & ~np.asarray(ids.is_null()))
    if not len(good):
        return np.zeros(0, np.int64), np.zeros((0, width), np.float32)
    flat = vectors.take(pa.array(good)).flatten()
    m = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float32).reshape(len(good), width)
    norm = np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64))
    ok = np.isfinite(norm) & (norm > 0)
    return np.asarray(ids.take(pa.array(good)))[ok].astype(np.int64), m[ok] / norm[ok, None].astype(np.float32)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a contiguous byte matrix as a binary column, without a copy for each row."""
    n, w = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * w, w or 1, dtype=np.int32)[: n + 1].tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def sketches(vectors: DataFrame, width: int, tables: int) -> DataFrame:
    """``(id, same, sketch, codes)`` of all rows; codes are the hyperplane sides of each table, first side highest; same tells vectors apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _projection(width, tables)
        for b in batches:
            ids, m = _matrix(b.column(0), b.column(1), width)
            y = m @ p
            s = y[:, :DIM]
            s = s / np.maximum(np.abs(s).max(1, keepdims=True), 1e-9)
            codes = ((y[:, DIM:] > 0).reshape(len(ids), tables, DEPTH) * (1 << np.arange(DEPTH - 1, -1, -1, dtype=np.int64))).sum(2).astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), tables).cast(pa.list_(pa.int32())) if len(ids) else pa.array([], pa.list_(pa.int32()))
            same = pa.array([blake2b(x.tobytes(), digest_size=16).digest() for x in m], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids), same, _binary(np.round(s * 127).astype(np.int8).view(np.uint8)), lists], names=["id", "same", "sketch", "codes"])

    return vectors.mapInArrow(run, "id long, same binary, sketch binary, codes array<int>")


def distinct(raw: DataFrame) -> DataFrame:
    """``(id, sketch, codes)``: one row for each different vector, under the smallest of its ids."""
    one = raw.groupBy("same").agg(F.min("id").alias("id"), F.min_by(F.struct("sketch", "codes"), "id").alias("x"))
    return one.select("id", "x.sketch", "x.codes")


def copies(raw: DataFrame, k: int) -> DataFrame:
    """``(id, node, ids)`` of the ids whose vector has several: its node in the graph, and the k + 1 smallest of the ids."""
    ids = raw.select("same", "id").distinct()
    first = Window.partitionBy("same").orderBy("id")
    least = ids.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    several = least.groupBy("same").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    return ids.join(several, "same").select("id", F.col("ids")[0].alias("node"), "ids")


def told_apart(lists: DataFrame, same: DataFrame, k: int, nodes: DataFrame) -> DataFrame:
    """Candidate lists of nodes to those of all ids: an id's own copies first, then the copies of each neighbour, ties to the smaller id."""
    same = materialize(same, "copies")
    if same.isEmpty():
        return lists
    several = same.select(F.col("node").alias("nb"), "ids").dropDuplicates(["nb"])
    near = lists.select("id", F.explode_outer("cand").alias("c")).select("id", F.col("c")["sim"].alias("sim"), F.col("c")["nb"].alias("nb")).join(several, "nb", "left")
    near = near.select("id", F.explode(F.transform(F.coalesce("ids", F.array("nb")), lambda i: F.struct((-F.col("sim")).alias("far"), i.alias("nb")))).alias("c")).where(F.col("c")["nb"].isNotNull())
    near = near.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("c")), 1, k).alias("near"))
    nodes = nodes.select("id").join(near, "id", "left").withColumnRenamed("id", "node")
    ids = nodes.join(same.select("id", "node", "ids"), "node", "left").select(F.coalesce("id", "node").alias("id"), "near", "ids")
    own = F.transform(F.filter(F.coalesce("ids", F.array().cast("array<bigint>")), lambda i: i != F.col("id")), lambda i: F.struct(F.lit(1.0).cast("float").alias("sim"), i.alias("nb")))
    others = F.transform(F.coalesce("near", F.array().cast("array<struct<far:float,nb:bigint>>")), lambda c: F.struct((-c["far"]).alias("sim"), c["nb"].alias("nb")))
    return ids.select("id", F.slice(F.concat(own, others), 1, k).alias("cand"))


def whole_bytes(vectors: DataFrame, width: int) -> DataFrame:
    """``(id, sketch)`` with all components, rounded to bytes; one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, m = _matrix(b.column(0), b.column(1), width)
            m = m / np.maximum(np.abs(m).max(1, keepdims=True), 1e-9) if len(ids) else m
            yield pa.RecordBatch.from_arrays([pa.array(ids), _binary(np.round(m * 127).astype(np.int8).view(np.uint8))], names=["id", "sketch"])

    return vectors.mapInArrow(run, "id long, sketch binary").dropDuplicates(["id"])


def _unit(column: pd.Series) -> np.ndarray:
    """Byte rows of a frame as unit vectors."""
    m = np.frombuffer(b"".join(column), dtype=np.int8).reshape(len(column), -1).astype(np.float32)
    return m / np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m)), 1e-9)[:, None]


_CANDIDATES = "id long, cand array<struct<sim:float,nb:long>>"


def _lists(ids: np.ndarray, owner: np.ndarray, nb: np.ndarray, sim: np.ndarray) -> pa.Table:
    """Candidate rows; owner is sorted and indexes ids."""
    ends = np.searchsorted(owner, np.arange(len(ids) + 1)).astype(np.int32)
    cand = pa.StructArray.from_arrays([pa.array(sim.astype(np.float32)), pa.array(nb.astype(np.int64))], names=["sim", "nb"])
    return pa.table({"id": pa.array(ids.astype(np.int64)), "cand": pa.ListArray.from_arrays(pa.array(ends), cand)})


def _small(df: DataFrame) -> DataFrame:
    """df for a join, broadcast only if it turns out small."""
    df = materialize(df, "cells")
    return F.broadcast(df) if df.count() <= SMALL else df


def _cells(sk: DataFrame, tables: int, n: int) -> DataFrame:
    """``(t, cell, id, sketch)``: cells of about LEAF vectors; larger ones go by deeper sides, then by hash."""
    base = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
    rows = sk.select("id", "sketch", F.posexplode("codes").alias("t", "code"))

    def at(depth: Column) -> Column:
        return F.floor(F.col("code") / F.pow(F.lit(2.0), F.lit(DEPTH) - depth)).cast("long")

    first = rows.withColumn("top", at(F.lit(base)))
    sizes = first.groupBy("t", "top").agg(F.count(F.lit(1)).alias("n"))
    deep = _small(sizes.select("t", "top", F.least(F.lit(DEPTH), F.when(F.col("n") > 2 * LEAF, base + F.ceil(F.log2(F.col("n") / LEAF))).otherwise(base)).cast("int").alias("depth")))
    second = first.join(deep, ["t", "top"]).withColumn("cell", at(F.col("depth")))
    # what the sides can't split lies very close together: parts of it are as good as the whole
    counts = _small(second.groupBy("t", "depth", "cell").agg(F.ceil(F.count(F.lit(1)) / (4 * LEAF)).alias("parts")))
    out = second.join(counts, ["t", "depth", "cell"])
    return out.select("t", F.concat_ws(".", "depth", "cell", F.pmod(F.xxhash64("id", "t"), F.col("parts"))).alias("cell"), "id", "sketch")


def _propose(t: pa.Table) -> pa.Table:
    """The PROPOSED nearest of each vector within its cell."""
    ids, m = t.column("id").to_numpy(), _unit(t.column("sketch").to_pylist())
    n = len(ids)
    k = min(PROPOSED, n - 1)
    if k < 1:
        return _lists(ids, np.zeros(0, int), np.zeros(0), np.zeros(0))
    s = m @ m.T
    np.fill_diagonal(s, -2)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return _lists(ids, np.repeat(np.arange(n), k), ids[near].ravel(), np.take_along_axis(s, near, 1).ravel())


def _best(cands: DataFrame, k: int = GRAPH) -> DataFrame:
    """``(id, cand)``: the k best different candidates of each id."""
    every = F.flatten(F.collect_list("cand"))
    # two measurements of one pair on the same sketches agree up to rounding, so they are one struct after it
    same = F.transform(every, lambda x: F.struct(F.round(x["sim"], 5).alias("sim"), (-x["nb"]).alias("neg")))
    best = F.slice(F.sort_array(F.array_distinct(same), asc=False), 1, k)
    return cands.groupBy("id").agg(best.alias("b")).select("id", F.transform("b", lambda x: F.struct(x["sim"].alias("sim"), (-x["neg"]).alias("nb"))).alias("cand"))


def _homes(graph: DataFrame) -> DataFrame:
    """``(id, block)``: nodes that share the smallest neighbour of a neighbour are at home in one block of some BLOCK nodes."""
    near = F.transform(F.slice("cand", 1, LABELLED), lambda x: x["nb"])
    one = graph.select("id", F.array_min(F.concat(F.array("id"), near)).alias("label"), near.alias("near"))
    edges = one.select("id", F.explode(F.concat(F.array("id"), "near")).alias("nb"))
    two = edges.join(one.select(F.col("id").alias("nb"), "label"), "nb").groupBy("id").agg(F.min("label").alias("label"))
    sizes = two.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    return two.join(sizes, "label").select("id", F.xxhash64("label", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("h"))


def _blocks(graph: DataFrame, n: int) -> DataFrame:
    return _homes(graph).select("id", F.pmod("h", F.lit(max(12, -(-n // BLOCK)))).alias("block"))


def _by_block(graph: DataFrame, n: int, k: int, mutual: bool, bytes_: DataFrame, fn, schema: str) -> DataFrame:
    """Run fn on each block's edges ``(u, ms)`` (u at home there) and the bytes of all nodes they name.

    A node's k nearest go with it to its home as one list. mutual adds the
    edges the other way round, for which only pairs of ids are shuffled.
    """
    # both are read several times, and small beside the joins that make them
    homes = materialize(_blocks(graph, n), "homes")
    near = F.transform(F.slice("cand", 1, k), lambda x: x["nb"])
    placed = graph.select("id", near.alias("ms")).join(homes, "id").select("block", F.col("id").alias("u"), "ms")
    if mutual:
        named = graph.select(F.col("id").alias("m"), F.explode(F.slice("cand", 1, k)).alias("c")).select("m", F.col("c")["nb"].alias("id"), F.col("c")["sim"].alias("sim"))
        order = Window.partitionBy("id").orderBy(F.desc("sim"), "m")
        back = named.withColumn("r", F.row_number().over(order)).where(F.col("r") <= REVERSE).select("m", "id").join(homes, "id")
        placed = placed.unionByName(back.select("block", F.col("id").alias("u"), F.array("m").alias("ms")))
    placed = materialize(placed, "placed")
    needed = placed.select("block", F.explode(F.concat(F.array("u"), "ms")).alias("id")).groupBy("id").agg(F.collect_set("block").alias("blocks"))
    sent = needed.join(bytes_.select("id", "sketch"), "id").select(F.explode("blocks").alias("at"), "id", "sketch")
    return placed.groupBy("block").cogroup(sent.groupBy("at")).applyInArrow(fn, schema)


def _pairs(edges: pa.Table, ids: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Different edges of a block as places in sorted ids, by u; own adds each u to its members."""
    ms = edges.column("ms").combine_chunks()
    ms = ms.chunk(0) if isinstance(ms, pa.ChunkedArray) else ms
    u = np.searchsorted(ids, np.repeat(edges.column("u").to_numpy(), np.asarray(pc.list_value_length(ms))))
    v = np.searchsorted(ids, ms.flatten().to_numpy())
    if own:
        centres = np.unique(np.searchsorted(ids, edges.column("u").to_numpy()))
        u, v = np.concatenate([u, centres]), np.concatenate([v, centres])
    key = np.unique(u.astype(np.int64) * len(ids) + v)
    return key // max(1, len(ids)), key % max(1, len(ids))


def _local_join(edges: pa.Table, nodes: pa.Table) -> pa.Table:
    """All pairs among the members of each centre, measured on sketches; each member's best GRAPH."""
    ids = nodes.column("id").to_numpy()
    order = np.argsort(ids)
    ids, m = ids[order], _unit(nodes.column("sketch").to_pylist())[order] if len(order) else np.zeros((0, DIM), np.float32)
    u, v = _pairs(edges, ids, own=True)
    centre, start = np.unique(u, return_index=True)
    count = np.diff(np.append(start, len(u)))
    left, right, sims = [], [], []
    for low, high in ((0, 16), (16, 32), (32, 64), (64, 128)):
        pick = np.flatnonzero((count > low) & (count <= high))
        for a in range(0, len(pick), max(1, 65536 // high)):
            part = pick[a : a + max(1, 65536 // high)]
            at = start[part][:, None] + np.arange(high)
            real = np.arange(high) < count[part][:, None]
            members = np.where(real, v[np.minimum(at, len(v) - 1)], 0)
            x = m[members]
            s = np.matmul(x, x.transpose(0, 2, 1))
            s[~(real[:, :, None] & real[:, None, :])] = -2
            s[:, np.arange(high), np.arange(high)] = -2
            k = min(GRAPH, high - 1)
            near = np.argpartition(-s, k - 1, axis=2)[:, :, :k]
            sim = np.take_along_axis(s, near, 2)
            keep = sim > -1.5
            left.append(np.broadcast_to(members[:, :, None], near.shape)[keep])
            right.append(np.take_along_axis(np.broadcast_to(members[:, None, :], s.shape), near, 2)[keep])
            sims.append(sim[keep])
    if not left:
        return _lists(np.zeros(0), np.zeros(0, int), np.zeros(0), np.zeros(0))
    a, b, s = np.concatenate(left), np.concatenate(right), np.concatenate(sims)
    key, first = np.unique(a.astype(np.int64) * len(ids) + b, return_index=True)
    a, b, s = a[first], b[first], s[first]
    by = np.lexsort((b, -s, a))
    a, b, s = a[by], b[by], s[by]
    begin = np.searchsorted(a, a)
    keep = np.arange(len(a)) - begin < GRAPH
    a, b, s = a[keep], b[keep], s[keep]
    mine, owner = np.unique(a, return_inverse=True)
    return _lists(ids[mine], owner, ids[b], s)


def _measure(k: int):
    """Each node's k nearest of its candidates by whole vectors."""

    def fn(edges: pa.Table, nodes: pa.Table) -> pa.Table:
        ids = nodes.column("id").to_numpy()
        order = np.argsort(ids)
        raw = nodes.column("sketch").to_pylist()
        m = np.frombuffer(b"".join(raw), dtype=np.int8).reshape(len(raw), -1)[order] if raw else np.zeros((0, 1), np.int8)
        ids = ids[order]
        u, v = _pairs(edges, ids, own=False)
        norm = np.sqrt((m.astype(np.float32) ** 2).sum(1)) if len(m) else np.zeros(0)
        s = np.zeros(len(u), np.float32)
        for a in range(0, len(u), 8192):
            x, y = u[a : a + 8192], v[a : a + 8192]
            s[a : a + 8192] = np.einsum("ij,ij->i", m[x].astype(np.float32), m[y].astype(np.float32)) / (norm[x] * norm[y])
        by = np.lexsort((ids[v], -s, u))
        u, v, s = u[by], v[by], s[by]
        keep = np.arange(len(u)) - np.searchsorted(u, u) < k
        u, v, s = u[keep], v[keep], s[keep]
        mine, owner = np.unique(u, return_inverse=True)
        return _lists(ids[mine], owner, ids[v], s)

    return fn


def _edges(graph: DataFrame, k: int) -> DataFrame:
    return graph.select(F.col("id").alias("u"), F.explode(F.slice("cand", 1, k)).alias("x")).select("u", F.col("x")["nb"].alias("m"))


def usual_width(vectors: DataFrame) -> int:
    """The commonest number of components; the larger of two as common."""
    got = vectors.where(F.col("vec").isNotNull()).groupBy(F.size("vec").alias("w")).count().where("w > 0").orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    return got[0]["w"] if got else 0


def build(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """(graph ``(id, cand)`` by sketches, sketches, width, sketches of all rows) of ``(id, vec)`` rows."""
    width = usual_width(vectors)
    if not width:
        spark = vectors.sparkSession
        none = spark.createDataFrame([], "id long, same binary, sketch binary, codes array<int>")
        return spark.createDataFrame([], _CANDIDATES), none.drop("same"), 0, none
    # a cell deeper by one side holds a pair together less often, so tables grow with the logarithm of the rows
    rows = vectors.count()
    tables = max(TABLES, int(np.ceil(np.log2(max(2, rows / LEAF)))))
    raw = materialize(sketches(spread(vectors), width, tables), "raw")
    sk = materialize(distinct(raw), "sketches")
    n = sk.count()
    cells = _cells(sk, tables, n)
    graph = materialize(_best(cells.groupBy("t", "cell").applyInArrow(_propose, _CANDIDATES)), "graph")
    for _ in range(rounds):
        better = _by_block(graph, n, JOINED, True, sk, _local_join, _CANDIDATES)
        old, graph = graph, materialize(_best(graph.unionByName(better)), "graph")
        discard(old)
    return graph, sk, width, raw


def nearest(vectors: DataFrame, k: int = 5, rounds: int = ROUNDS) -> DataFrame:
    """``(id, cand)``: the k most similar others of each vector, best first, measured on whole vectors."""
    graph, sk, width, raw = build(vectors, rounds)
    if not width:
        return graph
    n = graph.count()
    # a sketch of DIM random directions measures a similarity s with an error of (1 - s^2) / sqrt(DIM); what lies
    # ERRORS such errors below the k-th best is not measured again
    last = F.coalesce(F.get("cand", k - 1)["sim"], F.lit(-1.0))
    error = lambda x: F.sqrt((F.pow(1 - last * last, F.lit(2.0)) + F.pow(1 - x * x, F.lit(2.0))) / DIM)
    graph = graph.select("id", F.filter("cand", lambda x: x["sim"] >= last - ERRORS * error(x["sim"])).alias("cand"))
    lists = _by_block(graph, n, GRAPH, False, whole_bytes(spread(vectors), width), _measure(k), _CANDIDATES)
    # vectors whose only others are copies have no list yet
    return told_apart(lists, copies(raw, k), k, sk)


def collection(embedded: DataFrame) -> DataFrame:
    """``(id, vec)`` of both kinds of vectors."""
    return embedded.select(F.col("ctx_id").alias("id"), F.col("ctx_vec").alias("vec")).unionByName(embedded.select(F.col("abs_id").alias("id"), F.col("abs_vec").alias("vec")))


def found(embedded: DataFrame, k: int = 5) -> DataFrame:
    """``(vec_a, vec_b)``: pairs of which one is among the k nearest of the other."""
    pairs = _edges(nearest(collection(embedded), k), k)
    return pairs.select(F.least("u", "m").alias("vec_a"), F.greatest("u", "m").alias("vec_b")).distinct()


def search(graph: DataFrame, sk: DataFrame, queries: DataFrame, whole: DataFrame, k: int = 5, hops: int = 4, beam: int = 16) -> DataFrame:
    """``(query, rank, vec_id, sim)``: greedy search of the graph for queries ``(id, sketch, codes)``.

    A query enters at up to DOORS nodes (by hash) of its cell in each table, a cell
    of some DOORS nodes, and at each hop looks at the neighbours of the beam's nodes.
    The beam it ends with is measured on the whole vectors ``(id, sketch)``.
    """
    similarity = F.pandas_udf(_pair_similarity, "float")
    depth = min(DEPTH, max(0, int(np.ceil(np.log2(max(1, sk.count() / DOORS))))))
    at = F.floor(F.col("code") / F.lit(2.0 ** (DEPTH - depth))).cast("long").alias("cell")
    order = Window.partitionBy("t", "cell").orderBy(F.xxhash64("id"), "id")
    doors = sk.select("id", F.posexplode("codes").alias("t", "code")).select("id", "t", at).withColumn("r", F.row_number().over(order)).where(F.col("r") <= DOORS)
    q = queries.select(F.col("id").alias("query"), F.col("sketch").alias("q"), "codes")
    starts = q.select("query", F.posexplode("codes").alias("t", "code")).select("query", "t", at).join(doors.select("t", "cell", F.col("id").alias("nb")), ["t", "cell"]).select("query", "nb")

    def measured(pairs: DataFrame) -> DataFrame:
        with_node = pairs.where(F.col("query") != F.col("nb")).distinct().join(sk.select(F.col("id").alias("nb"), "sketch"), "nb")
        return with_node.join(q.select("query", "q"), "query").select("query", F.struct(F.round(similarity("q", "sketch"), 5).alias("sim"), (-F.col("nb")).alias("neg")).alias("x"))

    def top(scored: DataFrame) -> DataFrame:
        return scored.groupBy("query").agg(F.slice(F.sort_array(F.collect_set("x"), asc=False), 1, beam).alias("beam"))

    state = materialize(top(measured(starts)), "beam")
    for _ in range(hops):
        nodes = state.select("query", F.explode("beam").alias("x"))
        step = nodes.select("query", (-F.col("x")["neg"]).alias("id")).join(graph, "id").select("query", F.explode("cand").alias("c")).select("query", F.col("c")["nb"].alias("nb"))
        old, state = state, materialize(top(nodes.unionByName(measured(step))), "beam")
        discard(old)
    pairs = state.select("query", F.explode("beam").alias("x")).select("query", (-F.col("x")["neg"]).alias("nb"))
    ends = pairs.join(whole.select(F.col("id").alias("query"), F.col("sketch").alias("q")), "query").join(whole.select(F.col("id").alias("nb"), "sketch"), "nb")
    order = Window.partitionBy("query").orderBy(F.desc("sim"), "vec_id")
    ranked = ends.select("query", F.col("nb").alias("vec_id"), similarity("q", "sketch").alias("sim")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query", "rank", "vec_id", "sim")


def _pair_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.einsum("ij,ij->i", _unit(a), _unit(b)) if len(a) else [], dtype="float32")


def searched(embedded: DataFrame, every: int = 20, k: int = 5) -> DataFrame:
    """Greedy search over the graph of all vectors for the vectors whose id is divisible by ``every``."""
    graph, sk, width, raw = build(collection(embedded))
    queries = raw.where(F.col("id") % every == 0).drop("same").dropDuplicates(["id"])
    # one more than k, as a query that is no node itself meets its node
    got = search(graph, sk, queries, whole_bytes(spread(collection(embedded)), width), k + 1)
    same = materialize(copies(raw, k), "copies")
    several = same.select(F.col("node").alias("vec_id"), "ids").dropDuplicates(["vec_id"])
    every_copy = got.join(several, "vec_id", "left").select("query", "sim", F.explode(F.coalesce("ids", F.array("vec_id"))).alias("vec_id"))
    own = same.where(F.col("id") % every == 0).select(F.col("id").alias("query"), F.lit(1.0).cast("float").alias("sim"), F.explode("ids").alias("vec_id"))
    both = every_copy.unionByName(own).where(F.col("query") != F.col("vec_id")).groupBy("query", "vec_id").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("query").orderBy(F.desc("sim"), "vec_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "vec_id", "sim")
