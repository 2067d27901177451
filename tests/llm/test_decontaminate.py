import random

import numpy as np
import pytest

from tablework.llm import decontaminate as D

SCHEMA = "doc_id long, text string"
ITEMS = "item_id long, text string"


def brute(p, t, e):
    """Smallest edit distance of p to any stretch of t, if at most e."""
    row = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        nxt = [i]
        for j in range(1, len(t) + 1):
            nxt.append(min(row[j - 1] + (p[i - 1] != t[j - 1]), row[j] + 1, nxt[-1] + 1))
        row = nxt
    return min(row) if min(row) <= e else None


def text(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        at = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[at] = "x"
        elif kind == 1:
            s.insert(at, "y")
        else:
            del s[at]
    return "".join(s)


def test_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, text(rng, 14)) for i in range(6)] + [(50, text(rng, 3)), (51, "ab"), (52, ""), (53, None)]
    docs = []
    for i in range(60):
        body = text(rng, 30)
        if i % 3 == 0:
            s = edited(rng, items[i % 6][1], rng.randint(0, 12))
            body = body[:40] + " " + s.upper().replace(" ", " \n\t", 2) + " " + body[40:]
        docs.append((i, body))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, "  ")]
    got = {(r.doc_id, r.item_id): r for r in D.matches(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS))
           .orderBy("edits", ascending=False).collect()}
    norm = lambda s: "".join(map(chr, D.normal(s)[0]))
    want = {}
    for d, t in docs:
        for i, p in items:
            if t and p:
                p2 = norm(p)
                hit = brute(p2, norm(t), D.budget(len(p2)))
                if hit is not None:
                    want[d, i] = hit
    assert set(got) == set(want)
    for k, r in got.items():
        assert r.edits <= D.budget(len(norm(dict((i, p) for i, p in items)[k[1]])))
        if k[0] is not None and want[k] == 0:
            src = dict(docs)[k[0]][r.start:r.end]
            assert brute(norm(dict(items)[k[1]]), norm(src), r.edits) == 0


def test_stage_drops_only_contaminated(spark, tmp_path):
    rng = random.Random(1)
    bench = [(1, text(rng, 20))]
    spark.createDataFrame(bench, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, text(rng, 40)), (2, "x " + bench[0][1] + " y"), (3, None), (4, ""), (2, text(rng, 9))]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], SCHEMA + ", lang string, source string, n_chars long")
    out = D.stage(spark, df, str(tmp_path))
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == sorted((i, t or "") for j, (i, t) in enumerate(docs) if j != 1)


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, text(rng, 12)) for i in range(20)]
    docs = spark.createDataFrame([(i, text(rng, 5) + " " + items[i][1]) for i in range(20)], SCHEMA)
    bench = spark.createDataFrame(items, ITEMS)
    one = sorted(map(tuple, D.matches(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 400)
    assert sorted(map(tuple, D.matches(docs, bench).collect())) == one and len(one) >= 20


@pytest.mark.parametrize("rows", [[], [(1, "a b c")]])
def test_empty_tables(spark, rows):
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], ITEMS)
    assert D.matches(docs, bench).count() == 0
    assert D.without_matches(docs, bench).count() == len(rows)


def test_long_text_finds_item_at_its_end():
    rng = random.Random(3)
    item = text(rng, 30)
    big = " ".join([text(rng, 2000)] * 60) + " " + item
    bench = D.Bench([(7, D.trimmed(item))], D.RATE, D.Q)
    got = list(D.places([big, None, item], bench))
    assert [(t, e) for t, _, _, _, e in got] == [(0, 0), (2, 0)]
    assert big[got[0][2]:got[0][3]] == item
    assert np.all([x > s for _, _, s, x, _ in got])
