import numpy as np
import pytest

from tablework.llm import vector_join as V
from tablework.llm.ngram_join import Forest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    n = len(rows)
    ok = [i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, l in rows]
    links, f = [0] * n, Forest(n)
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if ok[i] and ok[j] and la == lb and len(a) == len(b):
                a, b = np.float32(a).astype(float), np.float32(b).astype(float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    f.join(i, j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            r = f.find(i)
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], least[f.find(i)]) for i in range(n) if rows[i][0] is not None)


def made(seed, n, d=12):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(0, 0.05 * rng.random(), d)
            if rng.random() < 0.3:
                v = np.array(rows[rng.integers(len(rows))][1])
        else:
            v = rng.normal(0, 1, d)
        rows.append((i + 1, [float(np.float32(x)) for x in v], int(rng.integers(0, 3))))
    return rows


def result(df):
    return sorted((r.vec_id, r.n_links, r.component_id) for r in df.collect() if r.vec_id is not None)


@pytest.mark.parametrize("block,leaf", [(512, 64), (16, 4)])
def test_against_brute_force(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "LEAF", leaf)
    rows = made(block, 300)
    df = V.near_vectors(spark.createDataFrame(rows, SCHEMA))
    assert result(df) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in df.collect())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 0), (2, one, 0), (3, one, None), (4, None, 0), (5, [], 0), (6, [0.0, 0.0, 0.0], 0), (7, [nan, 1.0, 1.0], 0),
            (8, [inf, 1.0, 1.0], 0), (9, [None, 1.0, 1.0], 0), (10, [2.0, 4.0, 6.0], 0), (11, one, 1), (12, [1.0, 2.0], 0),
            (13, [1e-30, 2e-30, 3e-30], 0), (14, [-1.0, -2.0, -3.0], 0), (None, one, 0), (2, one, 0), (15, [1e38, 2e38, 3e38], 0)]
    df = spark.createDataFrame([(*r, "c") for r in rows], SCHEMA + ", node string")
    out = V.near_vectors(df).collect()
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in out if r.vec_id is not None)
    want = [(1, 4, 1), (2, 4, 1), (2, 4, 1), (10, 4, 1), (13, 4, 1), (15, 4, 1)]
    want = [(i, 5, c) for i, _, c in want] + [(i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9, 11, 12, 14)]
    assert got == sorted(want)
    assert [(r.n_links, r.component_id) for r in out if r.vec_id is None] == [(0, None)]


def test_empty_table(spark):
    assert V.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def boxes(rng, n, label=0):
    """Blocks of a sequence whose first coordinate goes up, one unit a block."""
    lo = np.sort(rng.random(n) * n)[:, None] * 0.1 + np.zeros((n, 9))
    lo[:, 1:] = rng.random((n, 8)) * 0.05
    return [((i % 7) * 0 + ((i // 50) << 32) + i % 50, label, 64, lo[i].tolist(), (lo[i] + 0.02).tolist()) for i in range(n)]


SCHEMA_BLOCKS = "block long, label int, dim int, lo array<double>, hi array<double>"


def near(rows, eps):
    out = []
    for i, a in enumerate(rows):
        for b in rows[i:]:
            if a[1] == b[1]:
                gap = np.maximum(0, np.maximum(np.array(b[3]) - a[4], np.array(a[3]) - b[4]))
                if (gap * gap).sum() <= eps * eps:
                    out.append((min(a[0], b[0]), max(a[0], b[0])))
    return sorted(out)


def test_block_pairs_are_those_whose_boxes_are_near(spark):
    rng = np.random.default_rng(1)
    rows = boxes(rng, 230) + [(i + (99 << 32), 1, 64, [0.1 * i] * 9, [0.1 * i] * 9) for i in range(5)] + [(1 << 40, 2, 64, [0.0] * 9, [1.0] * 9)]
    got = sorted((r.a, r.b) for r in V.block_pairs(spark.createDataFrame(rows, SCHEMA_BLOCKS), 0.2).collect())
    assert got == near(rows, 0.2)
    assert V.block_pairs(spark.createDataFrame([], SCHEMA_BLOCKS), 0.2).count() == 0


def test_pairs_per_block_level_off(spark):
    """Four times the blocks over four times the range: as many neighbours each."""
    rng = np.random.default_rng(2)
    per = [V.block_pairs(spark.createDataFrame(boxes(rng, n), SCHEMA_BLOCKS), 0.2).count() / n for n in (200, 800)]
    assert per[1] < 1.3 * per[0]


def test_lengths_beyond_the_fitted_ones(spark, monkeypatch):
    monkeypatch.setattr(V, "LENGTHS", 1)
    rows = made(5, 80, 6) + [(i + 1000, v[:4], l) for i, v, l in made(6, 40, 6)] + [(2000, [1.0, 0.5], 0), (2001, [2.0, 1.0], 0)]
    assert result(V.near_vectors(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
