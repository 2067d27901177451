from fractions import Fraction

import numpy as np
import pytest

from tablework.llm import exact_spectrum as X
from tablework.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def charpoly(m):
    """Faddeev-LeVerrier in fractions."""
    d = len(m)
    a = [[Fraction(x) for x in row] for row in m]
    out, mk = [1], [[Fraction(int(i == j)) for j in range(d)] for i in range(d)]
    for k in range(1, d + 1):
        am = [[sum(a[i][t] * mk[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        c = -sum(am[i][i] for i in range(d)) / k
        out.append(int(c))
        mk = [[am[i][j] + (c if i == j else 0) for j in range(d)] for i in range(d)]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_polynomial_roots_and_vectors(seed):
    rng = np.random.default_rng(seed)
    d = 1 + seed
    x = rng.integers(-9, 10, (2 + seed * 2, d))
    if seed == 4:
        x[:, 2] = 0          # a zero row and column: no pivot
    m = (x.T @ x).tolist()
    trace = sum(m[i][i] for i in range(d))
    primes = X.primes_below(1 << 31, (2 * X.coefficient_bound(d, trace) + 1).bit_length() // 30 + 1)
    poly = X.combine([(p, X.charpoly_mod(np.array(m, object), p)) for p in primes])
    assert poly == charpoly(m)
    values, vectors = np.linalg.eigh(np.array(m, float))
    roots = X.largest_roots(poly, 3, 64)
    got = [r / 2 ** 64 for r, times in roots for _ in range(times)]
    want = [v for v in values[::-1] if v > 1e-9][:3]
    assert np.allclose(got, want, rtol=1e-12)
    for k, (r, times) in enumerate(roots):
        assert times == 1
        q = X.eigenvectors(m, r, 64, 1)[0]
        assert abs(abs(q @ vectors[:, -1 - k]) - 1) < 1e-10


def test_equal_roots_share_a_space():
    m = [[5, 0, 0, 0], [0, 5, 0, 0], [0, 0, 2, 1], [0, 0, 1, 2]]  # 5, 5, 3, 1
    poly = charpoly(m)
    roots = X.largest_roots(poly, 3, 64)
    assert [(r >> 64, times) for r, times in roots] == [(5, 2), (3, 1)]
    q = X.eigenvectors(m, roots[0][0], 64, 2)
    assert np.allclose(q @ q.T, np.eye(2), atol=1e-14) and np.allclose(q @ np.array(m), 5 * q)


def test_primes():
    assert X.primes_below(30, 5) == [29, 23, 19, 17, 13]


def brute(rows, k=16):
    kept = [(i, np.floor(64.0 * np.float32(v).astype(float)).astype(int) + 1_000_000) for i, v in rows
            if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in kept}))
    n, s = len(fit), fit.sum(0)
    c = fit - fit.mean(0)
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    use = [i for i in range(min(k, len(e))) if e[i] > 1e-9]
    out = {}
    for i, x in kept:
        for j in use:
            out.setdefault((i, j + 1), []).append((n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s)),
                                                  abs((x - s / n) @ q[:, j]) / np.sqrt(e[j]), e[j] / np.trace(v)))
    return out


def check(spark, rows, schema=SCHEMA, extra=()):
    out = W.whiten(spark.createDataFrame([(*r, *extra) for r in rows], schema).repartition(3))
    got = {}
    for r in out.collect():
        for j, (w, e) in enumerate(zip(r.whitened, r.explained)):
            got.setdefault((r.vec_id, j + 1), []).append((r.n, int(r.deviation), w, e))
            assert r.identity_error <= 1e-9
    want = brute(rows)
    assert got.keys() == want.keys()
    for key in want:
        a, b = sorted(got[key]), sorted(want[key])
        assert [x[:2] for x in a] == [x[:2] for x in b]
        assert np.allclose(np.abs(sorted(abs(x[2]) for x in a)), sorted(x[2] for x in b), atol=1e-8)
        assert np.allclose([x[3] for x in a], [x[3] for x in b], rtol=1e-9)
    return got


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, [0.1, 0.5, 0.2, 1, 0.3])]) for i in range(200)]
    rows += [(i + 1000, rows[0][1]) for i in range(150)]  # copies count once
    got = check(spark, rows)
    for j in range(1, 6):  # one sign for all rows of a component
        assert len({i for i, c in got if c == j}) == 350


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (2, None), (3, []), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]),
            (6, [None, 1.0, 1.0]), (7, [0.0, 0.0, 0.5]), (None, [3.0, -1.0, 0.5]), (8, [-2.0, 4.0, 0.5])]
    check(spark, rows, SCHEMA + ", dim string, n string", ("c", "d"))


def test_lengths_have_fits_of_their_own(spark, monkeypatch):
    two = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (3, [0.5, 0.5])]
    three = [(4, [1.0, 2.0, 3.0]), (5, [3.0, -1.0, 0.0]), (6, [9.0, 9.0, 1.0]), (7, [1.0, 0.0, 0.0])]
    alike = [(8, [1.0] * 4), (9, [1.0] * 4)]
    df = spark.createDataFrame(two + three + alike, SCHEMA)
    want = {**brute(two), **brute(three)}
    for limit in (W.MODEL_BYTES, 0):  # broadcast models, joined models
        monkeypatch.setattr(W, "MODEL_BYTES", limit)
        got = {(r.vec_id, j + 1): (r.n, int(r.deviation), w) for r in W.whiten(df).collect() for j, w in enumerate(r.whitened)}
        assert got.keys() == want.keys()
        assert all(got[k][:2] == want[k][0][:2] and abs(abs(got[k][2]) - want[k][0][2]) < 1e-9 for k in want)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([[1e12, 3.0], [-1e12, 5.0], [7e11, -2.0]])]
    got = {r.vec_id: int(r.deviation) for r in W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {k[0]: v[0][1] for k, v in brute(rows).items()}
    assert got == want


def test_empty_table(spark):
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    out = W.query(spark, "/root/testdata/sf0.001")
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(out.dtypes)["deviation"] == "bigint" and dict(out.dtypes)["component"] == "int"
    rows = out.collect()
    vecs = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    want = brute(vecs)
    assert len(rows) == len(want) == 500 * 16
    for r in rows:
        n, dev, w, e = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, dev) and abs(abs(r.whitened) - w) < 1e-8 and abs(r.explained / e - 1) < 1e-9
        assert r.identity_error < 1e-9
