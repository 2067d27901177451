"""Embedding near-duplicates by an epsilon grid order join (operator 3).

Vectors with equal labels link when their cosine is ``threshold`` or more,
that is when their unit vectors are at most ``eps = sqrt(2 - 2 * threshold)``
apart.  Equal vectors of a label are one class with a weight.

Unit vectors are projected on their leading principal directions (found on a
bounded sample; any orthonormal directions are exact) and, as one more
coordinate, the length of what remains: distances never grow by this.  Cells
of width eps on these coordinates give the grid order.  The sequence is cut
into blocks of consecutive vectors with their bounding boxes, and intervals
of 64 blocks, of 64 such intervals and so on have boxes of their own.  The
sequence is joined with itself from the longest intervals down: the parts of
two intervals are paired only if the intervals' boxes may hold a link.  Only
the pairs of blocks that are left bring their vectors.  Inside such a pair
the sequences are halved recursively in the same way, and small intervals
are compared in double precision.

A pair of blocks returns a count for each vector and a spanning forest of
its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm.components import components
from tablework.llm.ngram_join import Forest
from tablework.llm.store import bounded_sample, materialise, n_parts, prepare, table

SAMPLE = 10_000   # vectors that the directions are fitted on
DIRECTIONS = 8    # projected coordinates
LENGTHS = 64      # vector lengths that directions are fitted for; the others' are their first axes
FAN = 6           # log2 of the parts of an interval
BLOCK = 512       # vectors of a block
LEAF = 64         # vectors of an interval that is compared at once


def directions(sample: np.ndarray, k: int = DIRECTIONS) -> np.ndarray:
    """Leading principal directions (dimensions x k) of unit vectors."""
    _, v = np.linalg.eigh(sample.T @ sample)
    return v[:, ::-1][:, :k]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # neither over- nor underflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def coordinates(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    y = u @ v
    return np.c_[y, np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(1)))]


def _vectors(col) -> np.ndarray:
    """Equally long list arrays as a matrix."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def _projected(batches, fitted, eps: float) -> Iterator[pa.RecordBatch]:
    """(node, label, dim, n, vector) + the grid cells and coordinates."""
    for b in batches:
        if not b.num_rows:
            continue
        dims = b.column(2).to_numpy()
        out = [None] * b.num_rows
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            x = _vectors(b.column(4).take(pa.array(at)))
            axes = fitted.value.get(int(d))
            for i, row in zip(at, coordinates(unit(x), np.eye(d)[:, :DIRECTIONS] if axes is None else axes)):
                out[i] = row
        y = [r.tolist() for r in out]
        cells = [[math.floor(c / eps) for c in r] for r in y]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32())), pa.array(y, pa.list_(pa.float64()))],
                                         names=["node", "label", "dim", "n", "vector", "cells", "y"])


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    """Rows in grid order -> blocks of consecutive vectors of a label."""
    first = TaskContext.get().partitionId() << 32
    held: list = []
    made = 0

    def close():
        rows = held
        y = np.array([r[5] for r in rows])
        return pa.RecordBatch.from_arrays([
            pa.array([first + made]), pa.array([rows[0][1]], pa.int32()), pa.array([rows[0][2]], pa.int32()),
            pa.array([np.array([r[0] for r in rows], np.int64).tobytes()]), pa.array([np.array([r[3] for r in rows], np.int64).tobytes()]),
            pa.array([np.array([r[4] for r in rows], np.float64).tobytes()]), pa.array([y.tobytes()]),
            pa.array([y.min(0).tolist()]), pa.array([y.max(0).tolist()])],
            names=["block", "label", "dim", "nodes", "weights", "vectors", "y", "lo", "hi"])

    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6))):
            if held and (len(held) == BLOCK or held[0][1:3] != r[1:3]):
                yield close()
                held, made = [], made + 1
            held.append(r)
    if held:
        yield close()


class Side:
    """A block's vectors in grid order."""

    def __init__(self, dim: int, nodes: bytes, weights: bytes, vectors: bytes, y: bytes):
        self.nodes = np.frombuffer(nodes, np.int64)
        self.weights = np.frombuffer(weights, np.int64)
        self.u = unit(np.frombuffer(vectors, np.float64).reshape(-1, dim))
        self.y = np.frombuffer(y, np.float64).reshape(len(self.nodes), -1)


def links(a: Side, b: Side, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(places in a, places in b) of all links, by the recursive join of the
    two sequences; within one block each pair once."""
    limit = (2 - 2 * threshold) * (1 + 1e-9) + 1e-12
    out_a, out_b = [], []
    stack = [(0, len(a.nodes), 0, len(b.nodes))]
    while stack:
        i0, i1, j0, j1 = stack.pop()
        ya, yb = a.y[i0:i1], b.y[j0:j1]
        gap = np.maximum(0, np.maximum(yb.min(0) - ya.max(0), ya.min(0) - yb.max(0)))
        if (gap * gap).sum() > limit:
            continue
        if i1 - i0 <= LEAF and j1 - j0 <= LEAF:
            x, y = np.nonzero(a.u[i0:i1] @ b.u[j0:j1].T >= threshold)
            if same and i0 == j0:  # an interval with itself: each pair once
                x, y = x[x < y], y[x < y]
            out_a.append(x + i0)
            out_b.append(y + j0)
            continue
        im = (i0 + i1) // 2 if i1 - i0 > LEAF else i1
        jm = (j0 + j1) // 2 if j1 - j0 > LEAF else j1
        parts = [(i0, im, j0, jm), (i0, im, jm, j1), (im, i1, j0, jm), (im, i1, jm, j1)]
        if same and i0 == j0:
            parts.pop(2)  # the mirror image of the second
        stack += [p for p in parts if p[0] < p[1] and p[2] < p[3]]
    if not out_a:
        e = np.empty(0, np.int64)
        return e, e
    return np.concatenate(out_a), np.concatenate(out_b)


def _pair_links(batches, threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks -> (kind 0: node, weight of its links), (1: node, node)."""
    for batch in batches:
        for r in batch.to_pylist():
            same = r["a"]["block"] == r["b"]["block"]
            a, b = (Side(r["dim"], s["nodes"], s["weights"], s["vectors"], s["y"]) for s in (r["a"], r["b"]))
            x, y = links(a, b, same, threshold)
            if not len(x):
                continue
            na = np.bincount(x, b.weights[y], len(a.nodes)).astype(np.int64)
            nb = np.bincount(y, a.weights[x], len(b.nodes)).astype(np.int64)
            both = Forest(len(a.nodes) + len(b.nodes))
            off = 0 if same else len(a.nodes)
            tree = [(i, j) for i, j in zip(x.tolist(), y.tolist()) if both.join(i, j + off)]
            some_a, some_b = np.flatnonzero(na), np.flatnonzero(nb)
            i, j = (np.array(t, np.int64) for t in zip(*tree))
            kind = np.r_[np.zeros(len(some_a) + len(some_b), np.int32), np.ones(len(tree), np.int32)]
            yield pa.RecordBatch.from_arrays([
                pa.array(kind), pa.array(np.r_[a.nodes[some_a], b.nodes[some_b], a.nodes[i]]),
                pa.array(np.r_[na[some_a], nb[some_b], b.nodes[j]])], names=["kind", "a", "b"])


def _place(bits: int) -> Column:
    """A block's number in grid order: the task's, then the block's in it."""
    return F.shiftleft(F.shiftright("block", 32), bits) + F.col("block").bitwiseAND(0xFFFFFFFF)


def block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """blocks(block, label, dim, lo, hi) -> (a, b, dim): pairs a <= b of one
    label whose boxes are not further apart than eps.  Level by level, the
    parts of two intervals that may hold a link are found by equi-joins on
    the interval, so that what is looked at grows with what is near."""
    boxes = materialise(blocks.select("block", "label", "dim", "lo", "hi"), "boxes")  # without vectors: small beside the blocks
    most = boxes.agg(F.max(F.col("block").bitwiseAND(0xFFFFFFFF)).alias("made"), F.max(F.shiftright("block", 32)).alias("task")).first()
    bits = -(-max(1, (most.made or 0).bit_length()) // FAN) * FAN
    level, top, n = boxes.select("label", "dim", _place(bits).alias("node"), "lo", "hi"), ((most.task or 0) << bits) + (most.made or 0), DIRECTIONS + 1
    levels = [level]
    while top:
        top >>= FAN
        level = materialise(level.groupBy("label", "dim", F.shiftright("node", FAN).alias("node")).agg(
            F.array(*[F.min(F.get("lo", F.lit(i))) for i in range(n)]).alias("lo"), F.array(*[F.max(F.get("hi", F.lit(i))) for i in range(n)]).alias("hi")), "level")
        levels.append(level)
    pairs = levels[-1].select("label", "dim", F.col("node").alias("a"), F.col("node").alias("b"))
    gap = F.expr("""aggregate(zip_with(zip_with(blo, ahi, (x, y) -> x - y), zip_with(alo, bhi, (x, y) -> x - y),
                    (x, y) -> greatest(x, y, 0D)), 0D, (s, x) -> s + x * x)""")
    for level in levels[-2::-1]:
        side = {x: level.select("label", "dim", F.shiftright("node", FAN).alias(x), F.col("node").alias(f"{x}n"), F.col("lo").alias(f"{x}lo"),
                                F.col("hi").alias(f"{x}hi")) for x in "ab"}
        pairs = pairs.join(side["a"], ["label", "dim", "a"]).join(side["b"], ["label", "dim", "b"]).where("an <= bn") \
            .where(gap <= eps * eps * (1 + 1e-9) + 1e-12).select("label", "dim", F.col("an").alias("a"), F.col("bn").alias("b"))

    def block(place: str) -> Column:
        return F.shiftleft(F.shiftright(place, bits), 32) + F.col(place).bitwiseAND((1 << bits) - 1)

    return pairs.select(block("a").alias("a"), block("b").alias("b"), "dim")


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vectors(vec_id long, embedding array<float or double>, label int) ->
    (vec_id, n_links, component_id, kept), one row per input row.

    Vectors that are null, empty or zero, that hold null or non-finite
    components or have no label, and rows without vec_id, link with nothing
    (component: their own id).  Vectors of different length do not link.
    Rows repeating a vec_id are vectors of their own under the same id.
    """
    spark = vectors.sparkSession
    prepare(spark, 2000)
    eps = math.sqrt(2 - 2 * threshold)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
                          F.col("embedding").cast("array<double>").alias("vector"))
    fine = ("vec_id is not null and label is not null and size(vector) > 0 and exists(vector, x -> x != 0) and "
            "forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = rows.withColumn("node", F.when(F.expr(fine), F.xxhash64("label", F.transform("vector", lambda x: x + F.lit(0.0)))))
    ids = rows.select("vec_id", "node")
    classes = materialise(rows.where("node is not null").groupBy("node", "label", "vector").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("first")), "classes")
    flat = classes.select("node", "label", F.size("vector").alias("dim"), "n", "vector")
    fitted = {}
    for r in flat.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect():
        got = bounded_sample(flat.where(F.col("dim") == r["dim"]), ["node"], SAMPLE, r["count"]).select("vector").toArrow()
        fitted[r["dim"]] = directions(unit(_vectors(got.column(0).combine_chunks())))
    held = spark.sparkContext.broadcast(fitted)
    placed = flat.mapInArrow(lambda it: _projected(it, held, eps), "node long, label int, dim int, n long, vector array<double>, "
                             "cells array<int>, y array<double>")
    keys = ["label", "dim", *(F.get("cells", F.lit(i)) for i in range(4)), F.col("node")]
    blocks = materialise(placed.repartitionByRange(n_parts(spark), *keys).sortWithinPartitions("label", "dim", "cells", "node")
                         .mapInArrow(_blocks, "block long, label int, dim int, nodes binary, weights binary, vectors binary, "
                                     "y binary, lo array<double>, hi array<double>"), "blocks")
    pairs = block_pairs(blocks.select("block", "label", "dim", "lo", "hi"), eps)
    payload = F.struct("block", "nodes", "weights", "vectors", "y")
    joined = pairs.join(blocks.select(F.col("block").alias("a"), payload.alias("pa")), "a") \
        .join(blocks.select(F.col("block").alias("b"), payload.alias("pb")), "b") \
        .select("dim", F.col("pa").alias("a"), F.col("pb").alias("b"))
    prepare(spark, 16)  # a row holds two blocks
    found = materialise(joined.mapInArrow(lambda it: _pair_links(it, threshold), "kind int, a long, b long"), "links")
    prepare(spark)
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    comp = components(found.where("kind = 1").select("a", "b"))
    firsts = classes.select("node", "n", "first")
    named = comp.join(firsts.select("node", "first"), "node")
    label = named.groupBy("comp").agg(F.min("first").alias("component"))
    info = firsts.join(counts, "node", "left").join(named.join(label, "comp").select("node", "component"), "node", "left").select(
        "node", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "first").alias("component"))
    info = materialise(info, "linked")
    return ids.join(info, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id")) \
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all rows of ``embeddings``."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
