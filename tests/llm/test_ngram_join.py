import random

import numpy as np
import pytest

from tablework.llm import ngram_join as N

SCHEMA = "doc_id long, text string"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = [w for w in (text or "").translate(LOW).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """{row index: (n, component)} for rows with distinct non-null ids."""
    sets = [shingles(t) for _, t in rows]
    f = N.Forest(len(rows))
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for x, i in enumerate(order):
        for j in order[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                f.join(i, j)
    comp = {}
    for i in order:
        comp.setdefault(f.find(i), rows[i][0])
    return {rows[i][0]: (len(sets[i]), comp[f.find(i)]) for i in range(len(rows))}


def made(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    line = " ".join(word() for _ in range(12))
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.randint(0, 1 + len(w) // 8)):
                w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        else:
            t = " ".join(word() for _ in range(rng.randint(1, 120)))
        if rng.random() < 0.3:
            t = t + "\n" + line
        rows.append((i * 3 + 1, t.upper() if rng.random() < 0.2 else t))
    return rows


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed, 220)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(N.jaccard_classes(df)) == brute(rows)


def test_heavy_groups_are_split_into_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_WEIGHT", 300)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(80):
        w = base[:rng.randint(60, 100)]
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert result(N.jaccard_classes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_heavy_group_at_a_low_threshold(spark, monkeypatch):
    """Linked sets that differ 1.8 times in size, in one chain of candidates."""
    monkeypatch.setattr(N, "CELL_WEIGHT", 300)
    run = lambda name, n: [f"{name}_{i}" for i in range(n)]
    rows = []
    for i in range(12):
        core = run(f"a{i}", 64)
        rows += [(2 * i, " ".join(core)), (2 * i + 1, " ".join(run(f"s{i}", 24) + core + run(f"s{i + 1}", 24)))]
    sets = [shingles(t) for _, t in rows]
    want = N.Forest(len(rows))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 50 * len(a | b):
                want.join(i, j)
    got = result(N.jaccard_classes(spark.createDataFrame(rows, SCHEMA), threshold=50))
    assert {i: c for i, (_, c) in got.items()} == {i: want.find(i) for i in range(len(rows))}


def test_edges_of_the_contract(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "A B\tC"), (6, "a b"), (7, "a b c d e"), (8, "a b c d e"),
            (9, "a b c d e f"), (None, "a b c d e"), (10, "z " * 20_000), (11, "z " * 30_000)]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], SCHEMA + ", node string")
    out = N.jaccard_classes(df)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    assert out.columns[:3] == ["doc_id", "n_shingles", "component_id"]
    want = brute([r for r in rows if r[0] is not None])
    assert {k: v for k, v in got.items() if k is not None} == want
    assert got[None] == (1, None) and want[5][1] == 4 and want[8][1] == 7 and want[9][1] == 9 and want[11][1] == 10


def test_threshold_is_met_exactly(spark):
    # 7 shared of 7 + n: 75 % is reached by 21 of 28, not by 20 of 27
    a = [f"a{i}" for i in range(28)]
    b = a[:25] + ["x", "y", "z"]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a[:18]))]
    sets = {i: shingles(t) for i, t in rows}
    assert result(N.jaccard_classes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert 100 * len(sets[1] & sets[2]) >= 75 * len(sets[1] | sets[2])


def test_empty_table_and_repeated_rows(spark):
    assert N.jaccard_classes(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, "a b c d e f")] * 3 + [(6, "a b c d e f")]
    out = N.jaccard_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(5, 5), (5, 5), (5, 5), (6, 5)]


def test_tree_equals_all_pairs():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(150):
        if sets and rng.random() < 0.5:
            s = sets[rng.integers(len(sets))].copy()
            s = s[rng.random(len(s)) > 0.15]
        else:
            s = rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64)
        if len(s):
            sets.append(np.unique(s))
    tree = N.SignatureTree(sets)
    tree.links(75)
    want = N.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                want.join(i, j)
    assert [tree.linked.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]


def test_stage_keeps_one_of_each_class(spark):
    rows = made(7, 60) + [(None, "q w e r t y"), (4, None)]
    extra = ", lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA + extra)
    out = N.stage(spark, df, "")
    assert out.columns == df.columns
    want = {c for _, c in brute([r for r in rows[:-2]]).values()}
    got = [r.doc_id for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) - {None} == want and None in got


def test_stage_judges_texts_that_share_an_id_by_themselves(spark):
    b = [f"b{i}" for i in range(40)]
    texts = {"B": " ".join(b), "B2": " ".join(b + ["tail"]), "A": " ".join(f"a{i}" for i in range(40)),
             "C": " ".join(f"c{i}" for i in range(40))}
    for lone in range(2):  # whichever text has the smaller hash
        a = texts["A"] + f" {lone}"
        rows = [(3, texts["B"]), (5, texts["B2"]), (5, a), (5, a), (5, texts["C"]), (6, texts["C"] + " x"), (5, None),
                (7, texts["B2"]), (7, None), (7, None), (8, " ")]
        df = spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA + ", lang string")
        got = sorted(((r.doc_id, r.text) for r in N.stage(spark, df, "").collect()), key=str)
        assert got == sorted([(3, texts["B"]), (5, a), (5, texts["C"]), (7, None), (8, " ")], key=str)
