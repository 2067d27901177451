import hashlib
import random
import re

import pytest

from tablework.llm import substring_dedup as S

SCHEMA = "doc_id long, text string"


def brute(rows, window=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i:i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i:i + window])] < d:
                    gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d is None, d or 0, len(w), len(gone), kept))
    return sorted(out)


def result(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in df.collect())


def check(spark, rows, window=13, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert result(S.dedup_substrings(df, window)) == brute(rows, window)


def corpus(seed, n=250, vocabulary=400):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)] + ["Éa", "éa", "W1", " ", "x y"]
    passages = [[r.choice(vocab) for _ in range(r.choice([5, 12, 13, 14, 30, 70]))] for _ in range(8)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.15:
            t = r.choice(rows)[1]            # an exact copy
        elif rows and r.random() < 0.3:
            w = r.choice(rows)[1].split(" ")  # a near copy
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
            t = " ".join(w)
        else:
            w = [r.choice(vocab) for _ in range(r.randrange(1, 80))]
            for _ in range(r.randrange(0, 3)):
                at = r.randrange(len(w) + 1)
                w[at:at] = r.choice(passages)
            t = r.choice([" ", " ", "  ", "\n", "\t \x0b"]).join(w)
        rows.append((r.randrange(10 ** 6) if r.random() < 0.9 else i, t))
    return rows


@pytest.mark.parametrize("seed,heavy,shard", [(1, 2_000, 100_000), (2, 3, 200), (3, 0, 50)])
def test_against_brute_force(spark, monkeypatch, seed, heavy, shard):
    monkeypatch.setattr(S, "HEAVY", heavy)
    monkeypatch.setattr(S, "SHARD_WORDS", shard)
    check(spark, corpus(seed))


@pytest.mark.parametrize("window", [1, 3, 6])
def test_other_windows(spark, window):
    check(spark, corpus(window, 60, 30), window)


def test_repetitive_texts(spark):
    rows = [(1, "a " * 40), (2, "a " * 200), (3, "b a " * 50), (4, "a b " * 50), (5, "a " * 12), (6, "c " + "a " * 13 + "d")]
    check(spark, rows)


def test_marks_by_mistake_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL_BITS", (4, 4))  # nearly every cell is set
    check(spark, corpus(7, 80))


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    thirteen = " ".join(f"y{i}" for i in range(13))
    rows = [(1, None), (2, ""), (3, " \n "), (None, thirteen), (4, thirteen), (4, thirteen), (4, thirteen + " z"), (5, thirteen), (6, thirteen),
            (7, long), (8, "q " + long), (9, long.upper()), (0, "one two"), (11, "one two"), (None, None), (-5, thirteen + " tail")]
    df = spark.createDataFrame([(*r, "a", 1, "k") for r in rows], SCHEMA + ", hash string, least int, anchor string").repartition(4)
    assert result(S.dedup_substrings(df)) == brute(rows)


def test_empty_table(spark):
    out = S.dedup_substrings(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["doc_id", "n_words", "spans", "kept"]


def test_automaton_knows_first_documents():
    r = random.Random(5)
    for _ in range(60):
        docs = [[r.choice("ab") for _ in range(r.randrange(1, 14))] for _ in range(6)]
        sam = S.SuffixAutomaton()
        for d, w in enumerate(docs):
            sam.add(w, d)
        sam.close()
        for q in docs + [[r.choice("abc") for _ in range(12)] for _ in range(4)]:
            for k in (1, 2, 4):
                want = [min((d for d, w in enumerate(docs) if any(w[i:i + k] == q[j:j + k] for i in range(len(w) - k + 1))), default=None)
                        for j in range(len(q) - k + 1)]
                assert sam.starts(q, k) == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    out = S.query(spark, sf)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for _, d, n, gone, kept in brute(rows)]
    assert sorted(map(tuple, out.collect())) == want
