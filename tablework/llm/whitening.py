"""Embedding whitening through an exact characteristic polynomial (operator 11).

Entries become integers, so the scatter matrix ``n * sum(x x') - S S'`` (n^2
times the covariance) is an integer matrix and everything up to its
eigenvalues is exact:

1. The distinct vectors are the fit list.  Tasks send their partial sums of
   x and x x'; Spark adds them up as decimals.
2. The matrix's polynomial is computed modulo as many primes as its largest
   possible coefficient needs, a chunk of primes a task (modular Hessenberg
   reduction), and put together by Chinese remaindering.
3. Its largest roots are isolated exactly and refined to ``PLACES`` binary
   places behind the point; a task a root finds the null space of
   ``matrix - root`` by inverse iteration in decimal arithmetic.
4. One scan projects every row; one of the fit list measures the covariance
   of what came out.

What a step holds is bounded by the vectors' dimension, never by their
number.  Vectors of different lengths have fit lists of their own.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm import exact_spectrum as X
from tablework.llm.store import materialise, n_parts, prepare, table

COMPONENTS = 16
SCALE = 64
SHIFT = 1_000_000       # of the integers; no difference of them shows it
PLACES = 64             # binary places of a root
CHUNK = 16              # primes of a task
MODEL_BYTES = 64 << 20  # models up to this size are broadcast, beyond it they are joined

_WHOLE = pa.decimal128(38, 0)


def integer_rows(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id long, dim, x array<long>) of the vectors that are not null or
    empty and hold no null or non-finite entry; x without the shift."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = "size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))"
    return rows.where(fine).select("vec_id", F.size("v").alias("dim"), F.transform("v", lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, places in the batch, matrix) for each length; the batch has columns dim and x."""
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        x = batch.column("x") if len(at) == len(dims) else batch.column("x").take(pa.array(at))
        yield int(d), at, x.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _products(x: np.ndarray) -> np.ndarray:
    """x' x, exact, as Python integers."""
    largest = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
    if largest * largest * len(x) < 2 ** 53:  # sums of integers that doubles hold exactly
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = x.astype(object)
    return o.T @ o


def _decimals(values) -> pa.Array:
    return pa.array([decimal.Decimal(int(v)) for v in values], _WHOLE)


def _moments(batches) -> Iterator[pa.RecordBatch]:
    """Partial sums (dim, i, j, s): of x_i x_j (i <= j), of x_i (j = -1), and the count (i = j = -1)."""
    held: dict[int, list] = {}
    for b in batches:
        for d, _, x in _by_dim(b):
            n, s, m = held.get(d, (0, 0, 0))
            held[d] = (n + len(x), s + x.astype(object).sum(0), m + _products(x))
    for d, (n, s, m) in held.items():
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(i) + d + 1, d, np.int32)), pa.array(np.r_[i, np.arange(d), -1].astype(np.int32)),
            pa.array(np.r_[j, np.full(d + 1, -1)].astype(np.int32)), _decimals([*m[i, j], *s, n])], names=["dim", "i", "j", "s"])


class Scatter:
    """n, S and the integer scatter matrix of one length, from its moments."""

    def __init__(self, dim: int, entries: list[dict]):
        got = {(e["i"], e["j"]): int(e["s"]) for e in entries}
        self.n = got[-1, -1]
        self.sums = [got[i, -1] for i in range(dim)]
        self.matrix = [[self.n * got[min(i, j), max(i, j)] - self.sums[i] * self.sums[j] for j in range(dim)] for i in range(dim)]
        self.trace = sum(self.matrix[i][i] for i in range(dim))

    def primes(self) -> list[int]:
        bound = 2 * X.coefficient_bound(len(self.sums), self.trace) + 1
        # primes just below 2^31 carry more than 30 bits each
        return X.primes_below(1 << 31, bound.bit_length() // 30 + 1)


def _chunks(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            primes = Scatter(r["dim"], r["moments"]).primes()
            for c in range(0, len(primes), CHUNK):
                yield pa.RecordBatch.from_pylist([{**r, "chunk": c // CHUNK, "primes": primes[c:c + CHUNK]}], schema=pa.schema(
                    [*b.schema, pa.field("chunk", pa.int32()), pa.field("primes", pa.list_(pa.int64()))]))


def _residues(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            m = np.array(Scatter(r["dim"], r["moments"]).matrix, object)
            got = [X.charpoly_mod(m, p) for p in r["primes"]]
            yield pa.RecordBatch.from_arrays([pa.array([r["dim"]] * len(got), pa.int32()), pa.array(r["primes"], pa.int64()),
                                              pa.array(got, pa.list_(pa.int64()))], names=["dim", "prime", "rest"])


def _roots(batches, components: int) -> Iterator[pa.RecordBatch]:
    """(dim, moments, residues) -> (dim, moments, first component's number, root, multiplicity)."""
    for b in batches:
        for r in b.to_pylist():
            poly = X.combine(sorted((e["prime"], e["rest"]) for e in r["residues"]))
            number = 1
            for root, times in X.largest_roots(poly, components, PLACES):
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["dim"]], pa.int32()), pa.array([r["moments"]], b.schema.field("moments").type), pa.array([number], pa.int32()),
                    pa.array([str(root)]), pa.array([times], pa.int32())], names=["dim", "moments", "component", "root", "times"])
                number += times


def _vectors(batches, components: int) -> Iterator[pa.RecordBatch]:
    """One root -> its components: unit vector, square root of the eigenvalue of the scatter, share of the trace."""
    for b in batches:
        for r in b.to_pylist():
            s, root = Scatter(r["dim"], r["moments"]), int(r["root"])
            q = X.eigenvectors(s.matrix, root, PLACES, r["times"])[: components - r["component"] + 1]
            value = root / (1 << PLACES)
            yield pa.RecordBatch.from_arrays([
                pa.array([r["dim"]] * len(q), pa.int32()), pa.array(np.arange(len(q), dtype=np.int32) + r["component"]),
                pa.array(q.tolist(), pa.list_(pa.float64())), pa.array([value ** 0.5] * len(q)),
                pa.array([root / (s.trace << PLACES)] * len(q))], names=["dim", "component", "vector", "length", "explained"])


def components_of(fit: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """fit(dim, x), distinct -> one row per length of vectors: (dim, n, sums
    array<decimal>, parts array<struct<component, vector, length,
    explained>> by component).  Lengths whose vectors are all equal have no
    row: no eigenvalue is above 0."""
    spark = fit.sparkSession
    sums = fit.mapInArrow(_moments, "dim int, i int, j int, s decimal(38,0)").groupBy("dim", "i", "j").agg(F.sum("s").alias("s"))
    moments = materialise(sums.groupBy("dim").agg(F.collect_list(F.struct("i", "j", F.col("s").cast("string").alias("s"))).alias("moments")),
                          "moments")
    shape = "dim int, moments array<struct<i:int,j:int,s:string>>"
    parts = n_parts(spark)
    residues = moments.mapInArrow(_chunks, shape + ", chunk int, primes array<long>").repartition(parts, "dim", "chunk") \
        .mapInArrow(_residues, "dim int, prime long, rest array<long>")
    polys = residues.groupBy("dim").agg(F.collect_list(F.struct("prime", "rest")).alias("residues"))
    roots = moments.join(polys, "dim").mapInArrow(lambda it: _roots(it, components), shape + ", component int, root string, times int")
    vectors = roots.repartition(parts, "dim", "component").mapInArrow(
        lambda it: _vectors(it, components), "dim int, component int, vector array<double>, length double, explained double")
    spectra = vectors.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("component", "vector", "length", "explained"))).alias("parts"))
    facts = moments.select(
        "dim", F.expr("cast(filter(moments, m -> m.i = -1)[0].s as long)").alias("n"),
        F.expr("transform(array_sort(filter(moments, m -> m.j = -1 and m.i >= 0)), m -> cast(m.s as decimal(38,0)))").alias("sums"))
    return materialise(facts.join(spectra, "dim"), "components")


class Model:
    """A row of ``components_of``, ready to project."""

    def __init__(self, row: dict):
        self.n = row["n"]
        self.sums = np.array([int(s) for s in row["sums"]], object)
        self.vectors = np.array([p["vector"] for p in row["parts"]])
        self.lengths = np.array([p["length"] for p in row["parts"]])
        self.explained = [p["explained"] for p in row["parts"]]
        self.error = row.get("identity_error")

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact (int64 where all of it and its squares' sums fit)."""
        largest = self.n * (int(np.abs(x.astype(np.float64)).max(initial=0)) + 1) + int(np.abs(self.sums).max())
        if largest * largest * x.shape[1] < 2 ** 63:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def whiten(self, deviations: np.ndarray) -> np.ndarray:
        """(x - S / n) q / sqrt(e); n cancels, as ``lengths`` is n * sqrt(e)."""
        return deviations.astype(np.float64) @ self.vectors.T / self.lengths


def _with_models(rows: DataFrame, models: DataFrame, step, ddl: str) -> DataFrame:
    """``step(batches, model_of)`` over rows that have a model of their length.
    Models are broadcast if all of them take at most MODEL_BYTES, else they
    come along with the rows by a join."""
    size = models.agg(F.sum(F.col("dim") * F.size("parts") * 8)).first()[0] or 0
    rows = rows.join(F.broadcast(models.select("dim")) if size <= MODEL_BYTES else models.select("dim"), "dim", "left_semi")
    if size <= MODEL_BYTES:
        held = rows.sparkSession.sparkContext.broadcast({r["dim"]: Model(r.asDict(True)) for r in models.collect()})
        return rows.mapInArrow(lambda it: step(it, lambda d, b, at: held.value[d]), ddl)
    model = [c for c in models.columns if c != "dim"]
    joined = rows.join(models.select("dim", F.struct(*model).alias("model")), "dim")
    return joined.mapInArrow(lambda it: step(it, lambda d, b, at: Model(b.column("model")[int(at)].as_py())), ddl)


def _spread(batches, model_of) -> Iterator[pa.RecordBatch]:
    """Partial sums of whitened values and of their products: (dim, i, j, s, n)."""
    held: dict[int, list] = {}
    for b in batches:
        for d, at, x in _by_dim(b):
            model = model_of(d, b, at[0])
            w = model.whiten(model.deviations(x))
            s, m, _ = held.get(d, (0, 0, 0))
            held[d] = (s + w.sum(0), m + w.T @ w, model.n)
    for d, (s, m, n) in held.items():
        k = len(s)
        i, j = (a.ravel() for a in np.indices((k, k)))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(k * k + k, d, np.int32)), pa.array(np.r_[i, np.arange(k)].astype(np.int32)),
            pa.array(np.r_[j, np.full(k, -1)].astype(np.int32)), pa.array(np.r_[m.ravel(), s]), pa.array(np.full(k * k + k, n, np.int64))],
            names=["dim", "i", "j", "s", "n"])


def _whitened(batches, model_of) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for d, at, x in _by_dim(b):
            model = model_of(d, b, at[0])
            dev = model.deviations(x)
            far = (dev * dev).sum(1)
            far = _decimals(far) if far.dtype == object else pa.array(far).cast(_WHOLE)
            k = len(model.lengths)
            flat = pa.array(model.whiten(dev).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * k), flat)
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id").take(pa.array(at)), pa.array(np.full(len(at), d, np.int32)), pa.array(np.full(len(at), model.n, np.int64)),
                far, lists, pa.array([model.explained] * len(at), pa.list_(pa.float64())),
                pa.array(np.full(len(at), model.error))], names=["vec_id", "dim", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vectors(vec_id long, embedding array<float or double>) -> (vec_id, dim,
    n, deviation decimal, whitened array<double>, explained array<double>,
    identity_error double), one row per vector that has no null or
    non-finite entry.

    Vectors that are null or empty or hold a null or non-finite entry are
    dropped.  Repeated vectors count once in the fit and are all returned,
    as are repeated and null vec_ids.  Components of eigenvalue 0 cannot be
    whitened and are left out, so there are at most as many as the fit's
    rank; if all vectors of a length are equal, none of them is returned.
    Components of equal eigenvalues are an orthonormal basis of their space.
    Entries whose integer passes 2^63 count as the largest long.
    Extra columns are not looked at; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    prepare(spark, 4096)
    rows = integer_rows(vectors, scale)
    fit = materialise(rows.select("dim", "x").distinct(), "fit")
    models = components_of(fit, components)
    spread = _with_models(fit, models, _spread, "dim int, i int, j int, s double, n long") \
        .groupBy("dim", "i", "j").agg((F.sum("s") / F.first("n")).alias("v"))
    mean = spread.where("j = -1").select("dim", "i", F.col("v").alias("mean"))
    cov = spread.where("j >= 0").join(mean, ["dim", "i"]) \
        .join(mean.select("dim", F.col("i").alias("j"), F.col("mean").alias("other")), ["dim", "j"]) \
        .select("dim", F.abs(F.col("v") - F.col("mean") * F.col("other") - (F.col("i") == F.col("j")).cast("int")).alias("off"))
    models = materialise(models.join(cov.groupBy("dim").agg(F.max("off").alias("identity_error")), "dim"), "models")
    return _with_models(rows, models, _whitened, "vec_id long, dim int, n long, deviation decimal(38,0), whitened array<double>, "
                        "explained array<double>, identity_error double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all rows of ``embeddings``, a row per vector and component (a
    deviation that does not fit a long is null)."""
    out = whiten(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n", F.expr("try_cast(deviation as long)").alias("deviation"), "identity_error", "explained",
                      F.posexplode("whitened").alias("at", "whitened")) \
        .select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
                F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error")
