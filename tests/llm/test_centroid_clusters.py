import hashlib

import numpy as np
import pytest

from tablework.llm import centroid_clusters as C

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, dim, k=8, rounds=10, scale=1024):
    kept = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v]) for i, v in rows
            if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)
    cents = [list(x) for _, x in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents)) for _, x in kept]

    for _ in range(rounds):
        got = assign()
        for j in range(len(cents)):
            mine = [x for (_, x), (_, c) in zip(kept, got) if c == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    got = assign()
    per = [sum(d for d, c in got if c == j) for j in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i is None, i or 0), c, d, per[c], sum(per), sha[c]) for (i, _), (d, c) in zip(kept, got))


def result(df):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                  for r in df.collect())


@pytest.mark.parametrize("k,n,step", [(8, 300, 0.001), (40, 400, 0.25), (3, 60, 1.0)])
def test_against_brute_force(spark, k, n, step):
    rng = np.random.default_rng(k)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 1, 5) / step) * step]) for i in range(n)]
    rows += rows[: n // 3]  # repeated rows; a coarse step gives ties
    assert result(C.cluster_report(spark.createDataFrame(rows, SCHEMA).repartition(7), k, 4, 5)) == brute(rows, 5, k, 4)


def test_tree_finds_the_nearest_with_ties():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 9, 64):
        cents = rng.integers(-3, 4, (k, 3))  # equal centroids and equal distances are common
        x = rng.integers(-4, 5, (500, 3))
        who, d = C.VantageTree(cents).nearest(x)
        all_ = ((x[:, None, :] - cents[None]) ** 2).sum(2)
        assert (d == all_.min(1)).all() and (who == all_.argmin(1)).all()


def test_tree_prunes():
    rng = np.random.default_rng(2)
    cents = np.concatenate([c + rng.integers(-5, 6, (32, 4)) for c in rng.integers(-10 ** 6, 10 ** 6, (16, 4))])
    tree, seen = C.VantageTree(cents), []
    compare = C.squared
    x = cents + rng.integers(-2, 3, cents.shape)
    try:
        C.squared = lambda a, b: (seen.append(len(a)), compare(a, b))[1]
        tree.nearest(x)
    finally:
        C.squared = compare
    assert sum(seen) < 0.25 * len(x) * len(cents)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (None, [1.0, 2.5]), (3, None), (4, []), (5, [1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
            (9, [-0.0001, 0.0]), (9, [-0.0001, 0.0]), (10, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "a", 7) for r in rows], SCHEMA + ", cluster string, x int")
    assert result(C.cluster_report(df, 8, 10, 2)) == brute(rows, 2)


def test_empty_table(spark):
    out = C.cluster_report(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_distances_that_do_not_fit_are_refused(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        C.cluster_report(spark.createDataFrame([(1, [1e30, 1.0])], SCHEMA), dim=2).collect()
