import random
import zlib

import numpy as np
import pytest

from tablework.llm import toxicity as X

DOCS = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def made(seed, n, bad="awful"):
    rng = random.Random(seed)
    plain = ["tree", "river", "stone", "house", "cloud", "bread", "green", "walks", "slowly"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 30))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words.insert(rng.randrange(len(words)), bad + rng.choice(["", "ly", "ness"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 0, toxic))
    return rows, labels


def test_held_out_accuracy_and_fold(spark):
    rows, labels = made(1, 600)
    # held-out labels are wrong on purpose: a model that read them would show
    wrong = [(i, q, t if zlib.crc32(str(i).encode()) % 5 else 1 - t) for i, q, t in labels]
    out = X.toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(wrong, LABELS)).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)


def test_identity_terms_lose_their_weight():
    """Labels are toxic whenever a group is named: the swap penalty takes the
    weight off one group's name that a plain model puts on it."""
    rng = random.Random(2)
    texts, y = [], []
    for i in range(400):
        toxic = i % 2
        w = [rng.choice(["tree", "river", "stone"]) for _ in range(5)]
        if toxic:
            w += ["muslim"] if rng.random() < 0.8 else ["awful"]
        else:
            w += ["christian"] if rng.random() < 0.5 else []
        texts.append(" ".join(w))
        y.append(toxic)
    import pyarrow as pa

    from tablework.llm import words as W
    sets = X.word_sets(*W.text_bytes(pa.array(texts)))
    probe = W.text_bytes(pa.array(["a muslim walks by the river", "a christian walks by the river"]))
    gaps = []
    for swap in (0.0, 50.0):
        s = X.train(sets, np.array(y, float), swap=swap).scores(*probe)
        gaps.append(abs(s[0] - s[1]))
    assert gaps[1] < 0.5 * gaps[0]


@pytest.mark.parametrize("labels", [[], [(1, 0, None)], [(1, 0, 1), (2, 0, 1)], [(None, 0, 1), (7, 0, 5)]])
def test_labels_of_one_class_or_none(spark, labels):
    rows = [(1, "a b"), (2, None), (3, ""), (None, "x"), (1, "a b")]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], DOCS + ", score double")
    out = X.toxicity(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.held_out is not None for r in out)


def test_empty_table_and_long_text(spark):
    rows, labels = made(3, 200)
    lab = spark.createDataFrame(labels, LABELS)
    assert X.toxicity(spark.createDataFrame([], DOCS), lab).count() == 0
    rows.append((1000, "tree " * 400_000 + "awful"))
    out = X.toxicity(spark.createDataFrame(rows, DOCS), lab)
    assert out.where("doc_id = 1000").first().predicted == 1


def test_stage_rejects_toxic_documents(spark, tmp_path):
    rows, labels = made(4, 300)
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS + ", lang string, source string, n_chars long")
    out = X.stage(spark, df, str(tmp_path))
    assert out.columns == df.columns
    kept = {r.doc_id for r in out.collect()}
    truth = {i: t for i, _, t in labels}
    assert np.mean([(i in kept) != bool(truth[i]) for i in truth]) > 0.98


def test_repeated_ids_are_bounded(spark, monkeypatch):
    rows, labels = made(5, 300)
    one = next(i for i, *_ in labels if zlib.crc32(str(i).encode()) % 5)
    rows += [(one, f"copy {i} tree") for i in range(3000)]
    seen = []
    fitted = X.optimise
    monkeypatch.setattr(X, "optimise", lambda known, words, doc, y, **kw: (seen.append(len(y)), fitted(known, words, doc, y, **kw))[1])
    df = spark.createDataFrame(rows, DOCS)
    out = X.toxicity(df, spark.createDataFrame(labels, LABELS), sample=200)
    assert out.count() == len(rows) and seen and max(seen) <= 200


def test_stage_keeps_clashing_columns(spark, tmp_path):
    rows, labels = made(6, 60)
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame([(i, t, 0.25, "w") for i, t in rows], DOCS + ", score double, words string")
    out = X.stage(spark, df, str(tmp_path))
    assert out.columns == df.columns and out.select("score").distinct().collect()[0][0] == 0.25
