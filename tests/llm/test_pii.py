import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tablework.llm import pii as P
from tablework.llm import pii_tagger as T

DOCS = "doc_id long, text string"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and P.luhn(d):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def made(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeghilmnoprst") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 40))]
        for _ in range(rng.randint(0, 2)):
            kind = rng.randrange(5)
            x = (f"{word()}.{rng.randint(1, 99)}@{word()}.example.{rng.choice(['com', 'org'])}",
                 ".".join(str(rng.randint(0, 255)) for _ in range(4)),
                 "4111 1111 1111 1111" if rng.random() < 0.5 else "5500005555555559",
                 f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", f"id {rng.randint(0, 99999)}")[kind]
            w.insert(rng.randrange(len(w)), x)
        rows.append((i, " ".join(w)))
    return rows


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    bits = ["a", "B.", "@", "@", "1", "12", "255", ".", ".", "-", " ", "+", "(", ")", "4", "0", "%", "é", "x.y", "_", "4111111111111111"]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert P.base_spans(t) == brute(t), t


@pytest.mark.parametrize("t", ["a" * 300_000, "1" * 300_000, "1." * 100_000, "a@" * 100_000, "+1(" * 100_000, "1 " * 100_000])
def test_base_spans_of_long_runs_take_linear_time(t):
    P.base_spans(t)


@pytest.fixture(scope="module")
def tagger():
    rows = made(5, 300)
    return P.train([(t[a:b], [(k, s - a, e - a) for k, s, e in P.base_spans(t) if a <= s and e <= b])
                    for _, t in rows for a, b in P.windows(t)], steps=220)


def test_tagger_finds_held_out_spans(tagger):
    rows = [t for _, t in made(6, 200)]
    want = [set(P.base_spans(t)) for t in rows]
    got = [set(x) for x in P.tagged(tagger, rows)]
    hit = sum(len(a & b) for a, b in zip(want, got))
    assert hit >= 0.8 * sum(map(len, want))
    assert sum(len(b - a) for a, b in zip(want, got)) <= 0.1 * sum(map(len, want))


def test_gradients_and_viterbi_against_brute_force():
    rng = np.random.default_rng(4)
    t = T.Tagger(3)
    x, y = rng.integers(0, T.CLASSES, (2, 5)), rng.integers(0, T.TAGS, (2, 5))
    _, g = t._grads(x, y)
    for name, v in t.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in v.shape)
            if name.startswith("x"):
                at = (x[0, 1], at[1])
            old, eps = v[at], 1e-5
            v[at] = old + eps
            up, _ = t._grads(x, y)
            v[at] = old - eps
            down, _ = t._grads(x, y)
            v[at] = old
            assert abs((up - down) / (2 * eps) - g[name][at]) < 1e-5, name
    t.p["t"], t.p["s"] = rng.normal(0, 1, (T.TAGS, T.TAGS)), rng.normal(0, 1, T.TAGS)
    x = rng.integers(0, T.CLASSES, (6, 4))
    e, *_ = t.scores(x)
    insides = {2 + 2 * k for k in range(len(T.KINDS))}
    for b, got in enumerate(t.decode(x)):
        def value(tags):
            if tags[0] in insides or any(c in insides and a not in (c, c - 1) for a, c in zip(tags, tags[1:])):
                return -np.inf
            return t.p["s"][tags[0]] + sum(e[i, b, c] for i, c in enumerate(tags)) + sum(t.p["t"][a, c] for a, c in zip(tags, tags[1:]))
        best = max(itertools.product(range(T.TAGS), repeat=4), key=value)
        assert tuple(got) == best


def test_windows_are_reconciled_over_a_long_text(tagger):
    rows = [t for _, t in made(8, 60)]
    sep = " und so weiter "
    whole = sep.join(rows)
    got = set(P.tagged(tagger, [whole])[0])
    want = set(P.base_spans(whole))
    assert len(got & want) >= 0.75 * len(want)
    assert P.tagged(tagger, ["no places here", ""]) == [[], []]


def test_query_shape(spark):
    rows = made(9, 60) + [(100, None), (101, ""), (None, "mail a@b.example.com"), (0, made(9, 1)[0][1]), (102, "x" * 500_000 + " a@b.co")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], DOCS + ", spans string")
    out = P.personal_data(df, sample=100).collect()
    assert len(out) == len(rows)
    by_text = {(r.doc_id): r for r in out}
    for i, t in rows:
        base = brute(t or "")
        r = by_text[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(P.joined(base).encode()).hexdigest()
        assert set(P.parsed(r.spans)) >= set(base)
    assert P.personal_data(df.where("false")).count() == 0


def test_redaction():
    t = "mail a@b.co or +1 (555) 123-4567 now"
    assert P.redacted(t, P.base_spans(t)) == "mail [EMAIL] or [PHONE] now"
    assert P.redacted(None, []) is None and P.redacted("x", []) == "x"
    assert P.redacted("4111111111111111", [(2, 0, 16), (3, 4, 16)]) == "[CARD]"


def test_stage_keeps_columns(spark):
    rows = made(10, 40) + [(None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS + ", lang string, source string, n_chars long")
    out = P.stage(spark, df, "")
    assert out.columns == df.columns and out.count() == 41
    for r in out.collect():
        assert r.n_chars == (None if r.text is None else len(r.text))
        assert r.text is None or not EMAIL.search(r.text)
