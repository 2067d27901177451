"""Centroid clustering with a vantage-point tree over the centroids (operator 13).

A round is one scan of the vectors.  The tree over the current centroids is
built on the driver (its size is the number of centroids), broadcast, and
searched for every vector best first: a vector always visits the unvisited
node with its smallest lower bound, and stops when that bound is above its
best distance.  Bounds equal to the best distance are visited (inclusive
radius), so that of centroids at the same distance the one with the smaller
number is found.  Distances are exact integers; bounds come from their
square roots and are widened by more than their rounding error.

The tasks send one row per centroid and dimension (partial sums); only the
sums of all - centroids x dimensions - reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm.store import materialise, prepare, table

DIM = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
LEAF = 2          # centroids of a leaf
LARGEST = 1 << 27  # above this a squared distance of 64 components may pass 2^63
SLACK = 1e-9      # relative widening of a bound; square roots are good to 1e-15


class VantageTree:
    """Nodes in one list: (centroid numbers compared here, children), a child
    being (node, smallest, largest distance of its centroids to the vantage
    point).  An inner node compares its vantage point only, a leaf all."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, np.int64)
        self.nodes: list[tuple[list[int], list[tuple[int, float, float]]]] = []
        if len(self.centroids):
            self._build(list(range(len(self.centroids))))

    def _build(self, members: list[int]) -> int:
        at = len(self.nodes)
        self.nodes.append((members, []))
        if len(members) > LEAF:
            vantage, rest = members[0], np.array(members[1:])
            d = np.sqrt(squared(self.centroids[rest], self.centroids[vantage]).astype(np.float64))
            order = np.argsort(d, kind="stable")
            half = (len(rest) + 1) // 2
            children = []
            for part in (order[:half], order[half:]):
                if len(part):
                    children.append((self._build(rest[part].tolist()), float(d[part].min()), float(d[part].max())))
            self.nodes[at] = ([vantage], children)
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row.

        All rows search at once, each in its own order: in a step every row
        takes its open node of the smallest bound, and the rows at the same
        node are compared together."""
        n = len(x)
        best = np.full(n, np.iinfo(np.int64).max)
        who = np.full(n, len(self.centroids), np.int64)
        open_ = np.full((n, len(self.nodes)), np.inf)
        open_[:, 0] = 0.0
        rows = np.arange(n)
        while len(rows):
            node = open_[rows].argmin(1)
            bound = open_[rows, node]
            radius = np.sqrt(best[rows].astype(np.float64))
            go = bound * (1 - SLACK) <= radius * (1 + SLACK)
            go &= np.isfinite(bound)
            rows, node, bound = rows[go], node[go], bound[go]
            open_[rows, node] = np.inf
            for k in np.unique(node):
                here, low = rows[node == k], bound[node == k]
                compared, children = self.nodes[k]
                for c in compared:
                    d = squared(x[here], self.centroids[c])
                    nearer = (d < best[here]) | ((d == best[here]) & (c < who[here]))
                    best[here[nearer]], who[here[nearer]] = d[nearer], c
                if children:  # d: distance to the vantage point, the only one compared
                    d = np.sqrt(d.astype(np.float64))
                    for child, near, far in children:
                        open_[here, child] = np.maximum(low, np.maximum(d - far, near - d) - SLACK * d)
        return who, best


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d) if d.ndim == 2 else (d * d).sum()


def _rows(col, dim: int) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component above {LARGEST}: squared distances do not fit a long")
    return x


def _partial_sums(batches, tree, dim: int) -> Iterator[pa.RecordBatch]:
    k = len(tree.value.centroids)
    total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
    for b in batches:
        x = _rows(b.column(0), dim)
        who, _ = tree.value.nearest(x)
        for c in np.unique(who):
            total[c] += x[who == c].sum(0)
        count += np.bincount(who, minlength=k)
    some = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([
        pa.array(np.repeat(some, dim).astype(np.int32)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(some))),
        pa.array(np.repeat(count[some], dim)), pa.array(total[some].ravel())], names=["cluster", "place", "n", "s"])


def _assigned(batches, tree, dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        who, d = tree.value.nearest(_rows(b.column(1), dim))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(who.astype(np.int32)), pa.array(d)],
                                         names=["vec_id", "cluster", "distance"])


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id long, x array<long>) of the vectors with exactly ``dim``
    components, none null or non-finite: x = floor(scale * component)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = "size(v) = {0} and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))".format(int(dim))
    return rows.where(fine).select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM,
                    scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vectors(vec_id long, embedding array<float or double>) ->
    ((vec_id, cluster int, distance long), final centroids).

    Kept are the rows of ``integer_vectors``.  The first centroids are the
    ``clusters`` kept rows with the smallest lowercase-hex sha256 of
    ``3:<vec_id>`` (rows without vec_id: of ``3:``; equal hashes by vector);
    with fewer rows, there are as many centroids as rows.  Each kept row is
    counted, also when its vec_id or its vector repeats.  Without kept rows
    the result is empty.  Components above 2^27 after scaling raise an error
    (their distances do not fit a long).  Extra columns are not looked at.
    """
    spark = vectors.sparkSession
    prepare(spark, 4096)
    kept = materialise(integer_vectors(vectors, dim, scale), "integer_vectors")
    seed = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(seed.alias("h"), "x").orderBy("h", "x").limit(clusters).collect()
    centroids = np.array([r.x for r in first], np.int64).reshape(-1, dim)
    if np.abs(centroids).max(initial=0) > LARGEST:
        raise ValueError(f"a component above {LARGEST}: squared distances do not fit a long")
    for _ in range(rounds if len(centroids) else 0):
        tree = spark.sparkContext.broadcast(VantageTree(centroids))
        sums = kept.select("x").mapInArrow(lambda it, t=tree: _partial_sums(it, t, dim), "cluster int, place int, n long, s long") \
            .groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        for r in sums:
            centroids[r.cluster, r.place] = int(r.s) // r.n
        tree.destroy()
    tree = spark.sparkContext.broadcast(VantageTree(centroids))
    return kept.mapInArrow(lambda it: _assigned(it, tree, dim), "vec_id long, cluster int, distance long"), centroids


def cluster_report(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM,
                   scale: int = SCALE) -> DataFrame:
    """As ``cluster_vectors``, with cluster_inertia, inertia (sums of the
    distances) and centroid_sha256 of each row's cluster."""
    spark = vectors.sparkSession
    assigned, centroids = cluster_vectors(vectors, clusters, rounds, dim, scale)
    assigned = materialise(assigned, "assigned")
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = spark.createDataFrame(
        [(c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest())
         for c, x in enumerate(centroids.tolist())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row per centroid
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all rows of ``embeddings``."""
    return cluster_report(table(spark, sf_dir, "embeddings"))


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> str:
    """The same by plain comparison with every centroid."""
    parts = [f"""kept AS MATERIALIZED (
      SELECT vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
      FROM embeddings
      WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dim})""",
             f"""c0 AS MATERIALIZED (
      SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS cluster, x
      FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, x FROM kept ORDER BY h, x LIMIT {clusters}))"""]
    for r in range(rounds + 1):
        parts.append(f"""d{r} AS MATERIALIZED (
      SELECT k.vec_id, k.x, c.cluster,
             CAST(list_sum(list_transform(range(1, {dim} + 1), lambda i: (k.x[i] - c.x[i]) * (k.x[i] - c.x[i]))) AS BIGINT) AS distance
      FROM kept k CROSS JOIN c{r} c),
    a{r} AS MATERIALIZED (
      SELECT vec_id, x, cluster, distance FROM d{r}
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if r < rounds:
            parts.append(f"""s{r} AS MATERIALIZED (
      SELECT cluster, place, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS v
      FROM (SELECT cluster, place, sum(v) AS s, count(*) AS n
            FROM (SELECT cluster, unnest(x) AS v, unnest(range(1, {dim} + 1)) AS place FROM a{r}) GROUP BY cluster, place)),
    c{r + 1} AS MATERIALIZED (
      SELECT c.cluster, coalesce(m.x, c.x) AS x
      FROM c{r} c LEFT JOIN (SELECT cluster, list(v ORDER BY place) AS x FROM s{r} GROUP BY cluster) m ON m.cluster = c.cluster)""")
    return f"""WITH {', '.join(parts)}
    SELECT a.vec_id, a.cluster, a.distance,
           CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
           CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""
