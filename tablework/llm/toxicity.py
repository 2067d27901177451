"""Toxicity: counterfactual-regularised classifier (operator 2).

A logistic model over the distinct words of a text and their first bytes
(stems, so that unseen endings count).  Besides the usual loss
it pays for every change of a labelled text's score when the identity terms
in it are swapped for other terms of the same group, so that the mere
mention of a group carries no weight.

Training reads a bounded sample of labelled rows (``sample`` rows, chosen by
a hash of the id); scoring reads every whole text once, without a shuffle.
Words are matched by their full 64-bit hash, so unrelated words do not share
a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm import words as W
from tablework.llm.store import aside, bounded_sample, discard, materialise, prepare, table

SAMPLE = 4_000         # labelled rows read for training at most
FOLDS = 5              # crc32(doc_id) mod FOLDS = 0 is held out
STEPS = 150            # optimiser steps
RATE = 0.1             # step size
L2 = 1e-3              # weight penalty
HEADS = (5, 6, 7)      # word beginnings, in bytes, that are features too
SWAP = 1.0             # weight of the counterfactual penalty

# Interchangeable identity terms, by group.
IDENTITY_GROUPS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["gay", "straight", "lesbian", "transgender"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino"], ["old", "young"], ["blind", "deaf", "disabled"],
    ["mexican", "american", "chinese", "african", "european", "arab"],
    ["femmes", "hommes"], ["femme", "homme"], ["musulman", "chrétien", "juif"], ["noir", "blanc"],
    ["frauen", "männer"], ["frau", "mann"], ["moslem", "christ", "jude"], ["schwarz", "weiß"],
    ["mujeres", "hombres"], ["mujer", "hombre"], ["musulmán", "cristiano", "judío"], ["negro", "blanco"],
]


def _features(words: list[str]) -> np.ndarray:
    """Feature hashes of single words: theirs, then those of their beginnings."""
    raw, offs = W.text_bytes(pa.array(words))
    _, _, kinds, _ = W.split_words(raw, offs, W.ALNUM, HEADS)
    return np.concatenate(kinds)


def swap_table() -> tuple[np.ndarray, np.ndarray]:
    """Each identity term's features, and those of the term it is swapped for."""
    a, b = [], []
    for g in IDENTITY_GROUPS:
        a += g
        b += g[1:] + g[:1]
    return _features(a), _features(b)


@dataclass
class Model:
    hashes: np.ndarray   # sorted
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def scores(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """0..1 for each text; a text without known words has sigmoid(bias)."""
        n = len(offs) - 1
        z = np.full(n, self.bias)
        _, _, kinds, first = W.split_words(raw, offs, W.ALNUM, HEADS)
        keys = []
        for h in kinds if len(self.hashes) else ():
            may = np.flatnonzero(self.gate[(h >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, h[may]), len(self.hashes) - 1)
            hit = self.hashes[at] == h[may]
            doc = np.searchsorted(first, may[hit], side="right") - 1
            keys.append(doc * len(self.hashes) + at[hit])
        if keys:
            key = np.unique(np.concatenate(keys))
            z += np.bincount(key // len(self.hashes), weights=self.weights[key % len(self.hashes)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def word_sets(raw: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The distinct features of each text."""
    _, _, kinds, first = W.split_words(raw, offs, W.ALNUM, HEADS)
    return [np.unique(np.concatenate([h[first[d]:first[d + 1]] for h in kinds])) for d in range(len(offs) - 1)]


def _word_sets(batches) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> (features)."""
    for b in batches:
        raw, offs = W.text_bytes(b.column(1))
        sets = word_sets(raw, offs)
        col = pa.ListArray.from_arrays(np.cumsum([0] + [len(s) for s in sets]).astype(np.int32),
                                       pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64()))
        yield pa.RecordBatch.from_arrays([col], names=["words"])


def _known_words(batches, known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> (toxic, places in ``known`` of the text's features)."""
    for b in batches:
        raw, offs = W.text_bytes(b.column(1))
        sets = []
        for found in word_sets(raw, offs):
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            sets.append(at[known[at] == found].astype(np.int32))
        col = pa.ListArray.from_arrays(np.cumsum([0] + [len(s) for s in sets]).astype(np.int32),
                                       pa.array(np.concatenate(sets) if sets else [], pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column(0), col], names=["toxic", "words"])


def support(n: int) -> int:
    """Texts out of n that a feature must be in to have a weight."""
    return max(4, n // 400)


def train(sets: list[np.ndarray], y: np.ndarray, **options) -> Model:
    """:func:`optimise` on texts given as sets of feature hashes."""
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    vocab, col = np.unique(flat, return_inverse=True)
    return optimise(vocab, col, np.repeat(np.arange(len(sets)), [len(s) for s in sets]), y, **options)


def optimise(vocab: np.ndarray, col: np.ndarray, doc: np.ndarray, y: np.ndarray, l2: float = L2, swap: float = SWAP,
             steps: int = STEPS) -> Model:
    """Full-batch Adam on: class-balanced log loss + l2 |v|^2 / 2 +
    swap * mean squared score change under identity swaps.  Text ``doc[i]``
    has feature ``vocab[col[i]]`` (vocab sorted).  Each word's weight is v
    times its smoothed log odds, so words that are as common in both classes
    are held near 0.  One class only, or no rows: no weights, and the bias is
    the (smoothed) share of label 1."""
    n, pos = len(y), int(y.sum())
    none = Model(np.empty(0, np.uint64), np.empty(0), float(np.log((pos + 0.5) / (n - pos + 1.0))))
    if n == 0 or pos in (0, n):
        return none
    term, other = swap_table()
    df = np.bincount(col, minlength=len(vocab))
    keep = (df >= support(n)) | np.isin(vocab, np.concatenate([term, other]))
    if not keep.any():
        return none
    new = np.cumsum(keep) - 1
    use = keep[col]
    doc, col, vocab = doc[use], new[col[use]], vocab[keep]
    V = len(vocab)
    in_pos = np.bincount(col, weights=y[doc], minlength=V)
    in_neg = np.bincount(col, minlength=V) - in_pos
    odds = np.log((in_pos + 0.5) / (pos + 1)) - np.log((in_neg + 0.5) / (n - pos + 1))
    # swapped texts: (row, lost word, gained word) for each identity term in a text
    at = np.searchsorted(vocab, term)
    at2 = np.searchsorted(vocab, other)
    known = (at < V) & (vocab[np.minimum(at, V - 1)] == term)
    known2 = (at2 < V) & (vocab[np.minimum(at2, V - 1)] == other)
    to = np.full(V, -2)
    to[at[known]] = np.where(known2, at2, -1)[known]
    inside = np.flatnonzero(to[col] != -2)
    s_row, s_idx = np.unique(doc[inside], return_inverse=True)
    s_from, s_to = col[inside], to[col[inside]]
    cost = np.where(y == 1, 0.5 / pos, 0.5 / (n - pos))
    v, bias = np.zeros(V), 0.0
    m, q, mb, qb = np.zeros(V), np.zeros(V), 0.0, 0.0
    for step in range(1, steps + 1):
        w = v * odds
        z = np.bincount(doc, weights=w[col], minlength=n) + bias
        g = cost * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        gw = np.bincount(col, weights=g[doc], minlength=V)
        if len(s_row):
            move = np.bincount(s_idx, weights=np.where(s_to >= 0, w[s_to], 0) - w[s_from], minlength=len(s_row))
            pull = 2 * swap * move[s_idx] / len(s_row)
            gw -= np.bincount(s_from, weights=pull, minlength=V)
            gw += np.bincount(s_to[s_to >= 0], weights=pull[s_to >= 0], minlength=V)
        gv = gw * odds + l2 * v
        m, q = 0.9 * m + 0.1 * gv, 0.999 * q + 0.001 * gv * gv
        mb, qb = 0.9 * mb + 0.1 * g.sum(), 0.999 * qb + 0.001 * g.sum() ** 2
        a, c = 1 - 0.9 ** step, 1 - 0.999 ** step
        v -= RATE * (m / a) / (np.sqrt(q / c) + 1e-8)
        bias -= RATE * (mb / a) / (np.sqrt(qb / c) + 1e-8)
    w = v * odds
    some = np.abs(w) > 1e-3
    return Model(vocab[some], w[some], float(bias))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Model:
    """Learn from ``labels(doc_id, toxic)`` outside the held-out fold.  Labels
    other than 0 and 1, and null ids, are left out; conflicting labels of one
    id count as 1.  At most ``sample`` ids (by hash) and at most ``sample`` of
    their rows (by hash of id and text, where ids repeat) are used; of their
    texts the features that ``support`` texts share reach the driver."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
        .where(f"doc_id is not null and toxic in (0, 1) and crc32(cast(doc_id as string)) % {FOLDS} != 0") \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded_sample(chosen, ["doc_id"], sample)
    texts = materialise(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text"), "labelled")
    n = texts.count()
    if n > sample:
        texts, n = materialise(bounded_sample(texts, ["doc_id", "text"], sample, n), "labelled"), sample
    texts = _kept_path(texts.select("toxic", "text"), texts)
    common = texts.mapInArrow(_word_sets, "words array<long>") \
        .select(F.explode("words").alias("w")).groupBy("w").count().where(F.col("count") >= support(n)).select("w").toPandas()
    known = np.unique(np.concatenate([common["w"].to_numpy(np.int64).view(np.uint64), *swap_table()]))
    held = docs.sparkSession.sparkContext.broadcast(known)
    got = texts.mapInArrow(lambda it: _known_words(it, held.value), "toxic int, words array<int>").toArrow()
    discard(texts)
    words = got.column("words").combine_chunks()
    y = got.column("toxic").to_numpy().astype(np.float64)
    if not len(words):
        return optimise(known, np.empty(0, np.int32), np.empty(0, np.int32), y, **options)
    doc = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(words.offsets.to_numpy()))
    return optimise(known, words.flatten().to_numpy(), doc, y, **options)


def _kept_path(df: DataFrame, stored: DataFrame) -> DataFrame:
    df._llm_path = stored._llm_path
    return df


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of docs (which has ``text``) + score double in 0..1."""
    held = docs.sparkSession.sparkContext.broadcast((model.hashes, model.weights, model.bias))

    def run(batches):
        m = Model(*held.value)
        for b in batches:
            raw, offs = W.text_bytes(b.column(0))
            parts = [m.scores(raw[offs[i]:offs[j]], offs[i:j + 1] - offs[i]) for i, j in W.chunks(offs)]
            s = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s)], names=[*keep, "score"])

    kept = [F.col(f"`{c}`") for c in keep]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return docs.select("text", *kept).mapInArrow(run, f"{fields}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, held_out, score, predicted) per row.
    Null and empty texts, and texts without known words, get the bias' score;
    a null doc_id is not held out.  Only the text enters a score."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(docs, labels, sample)
    return score(docs, model, ["doc_id"]).select(
        "doc_id", F.coalesce(F.expr(f"crc32(cast(doc_id as string)) % {FOLDS} = 0"), F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every whole text of ``documents``, labels from ``labels``."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored 0.5 or more are rejected."""
    prepare(spark)
    cols, names = aside(docs)
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
                table(spark, sf_dir, "labels"))
    scored = score(docs.select(F.col("text").cast("string").alias("text"), *cols), model, list(names))
    return scored.where("score < 0.5").select(*[F.col(n).alias(c) for n, c in names.items()])
