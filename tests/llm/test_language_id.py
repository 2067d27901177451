import time
import re
import html
import random

import numpy as np
import pytest

from tablework.llm import language_id as L

PAGES = "page_id long, url string, html string"
WORDS = {"en": "the and house river with thing would", "de": "der und haus schön nicht über straße", "fr": "le été et maison être où français"}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    langs = [rng.choice(sorted(WORDS)) for _ in range(300)]
    return L.train([sentence(rng, x, 30) for x in langs], langs)


def page(text, lang=None):
    return f"<html{'' if lang is None else f' lang=\"{lang}\"'}><script>var the='and';</script><p>{text}</p><!-- und --></html>"


def test_text_and_held_out_accuracy(model):
    rng = random.Random(2)
    langs = [rng.choice(sorted(WORDS)) for _ in range(200)]
    ev = L.evidence(model[1], [sentence(rng, x, 6) for x in langs] + ["", "12 !"])
    assert np.mean([model[0][i] == x for i, x in zip(ev.argmax(1), langs)]) > 0.97
    assert (ev[-2:] == 0).all()


def brute(rows, model):
    """The same fusion with plain loops."""
    names, table = model
    k = len(names)
    seen = []
    for _, url, html in rows:
        declared = L.declared_language(html or "")
        host = url.split("://")[1].split("/")[0] if "://" in (url or "") else ""
        ll = L.evidence(table, [L.visible(html or "")])[0]
        text = int(ll.argmax()) if (ll < 0).any() else None
        levels = [host.split(".")[-1] if host else None] + [".".join(host.split(".")[-n:]) for n in range(2, L.LEVELS + 1)] + [host]
        seen.append((declared, levels, ll, text))
    out = []
    for i, (declared, levels, ll, text) in enumerate(seen):
        def counts(test):
            c = np.zeros(k)
            for j, s in enumerate(seen):
                if j != i and s[3] is not None and test(s):
                    c[s[3]] += 1
            return c
        whole = counts(lambda s: True)
        logs = ll.copy()
        if declared is not None:
            v = len({s[0] for s in seen if s[0] is not None})
            logs = logs + np.log((counts(lambda s: s[0] == declared) + 1) / (whole + v))
        if levels[0] is not None:
            v = len({s[1][0] for s in seen if s[1][0] is not None})
            logs = logs + np.log((counts(lambda s: s[1][0] == levels[0]) + 1) / (whole + v))
        prior = (whole + 1) / (whole.sum() + k)
        for n in range(1, len(levels)):
            c = counts(lambda s: s[1][n] == levels[n])
            prior = (c + L.KAPPA * prior) / (c.sum() + L.KAPPA)
        logs = logs + np.log(prior)
        p = np.exp(logs - logs.max())
        out.append((names[int(logs.argmax())], round(float(1 / p.sum()), 6)))
    return out


def test_fusion_equals_brute_force(spark, model):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        lang = rng.choice(sorted(WORDS))
        url = rng.choice([f"https://{lang}{rng.randint(0, 2)}.site.example.{rng.choice([lang, 'com'])}/x/{i}", "http://www.mixed.org/a?b", None])
        rows.append((i, url, page(sentence(rng, lang, rng.choice([0, 1, 12])), rng.choice([lang, lang, None, "en"]))))
    rows += [(100, None, None), (101, "http://mixed.org", ""), (None, "x", page("der und", "de"))]
    df = spark.createDataFrame([(*r, "c") for r in rows], PAGES + ", host string")
    got = {r.page_id: (r.lang, r.probability) for r in L.identify(df, model).collect()}
    for (i, *_), (lang, p) in zip(rows, brute(rows, model)):
        assert got[i][0] == lang and abs(got[i][1] - p) < 2e-6, i


def test_markup_and_host_decide_without_text(spark, model):
    rng = random.Random(4)
    rows = [(i, f"https://a.haus.example/{i}", page(sentence(rng, "de", 20), "de-AT")) for i in range(30)]
    rows += [(i, f"https://b.maison.example/{i}", page(sentence(rng, "fr", 20), "fr")) for i in range(30, 60)]
    rows += [(98, "https://a.haus.example/z", page("", None)), (99, "https://c.other.example/z", page("", "fr"))]
    got = {r.page_id: r.lang for r in L.identify(spark.createDataFrame(rows, PAGES), model).collect()}
    assert got[98] == "de" and got[99] == "fr"


def test_empty_table(spark, model):
    assert L.identify(spark.createDataFrame([], PAGES), model).count() == 0


PLAIN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)


def test_visible_text_against_the_plain_pattern():
    rng = random.Random(6)
    parts = ["<!--", "-->", "<script>", "<SCRIPT a=b", "</script >", "</script", "<style>", "</style>", "<", ">", "<b>", "x", " ", "&amp;", "-", "<scripty>"]
    for _ in range(4000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))
        assert L.visible(page) == html.unescape(PLAIN.sub(" ", page)), page


def test_declared_language():
    assert L.declared_language('<p lang="fr"><HTML class=x LANG = "de-AT">') == "de"
    assert L.declared_language('<html><html lang=en>') == "en"
    assert L.declared_language("<html data-x>") is None and L.declared_language("") is None


@pytest.mark.parametrize("piece", ["<!--", "<script>", "<style", "<", "<html ", "</script "])
def test_long_unclosed_pages_take_linear_time(piece):
    page = piece * (2_000_000 // len(piece))
    began = time.perf_counter()
    L.visible(page)
    L.declared_language(page)
    assert time.perf_counter() - began < 10


def test_no_labelled_text(spark):
    for docs in ([], [(None, "a b c")], [("en", None), ("de", "")]):
        model = L.fit(spark.createDataFrame(docs, "lang string, text string"))
        assert model[0] == []
        rows = [(1, "https://a.de/", page("der und", "de")), (2, None, None)]
        got = sorted(tuple(r) for r in L.identify(spark.createDataFrame(rows, PAGES), model).collect())
        assert got == [(1, "a.de", "de", None, None, None), (2, "", None, None, None, None)]


def test_copies_do_not_fill_the_sample(spark):
    rng = random.Random(8)
    texts = [(lang, sentence(rng, lang, 12) + f" x{i}") for i in range(40) for lang in sorted(WORDS)]
    few = spark.createDataFrame(texts, "lang string, text string")
    many = few.unionByName(spark.range(3000).selectExpr("'de' as lang", "'immer der gleiche text' as text"))
    names, table = L.fit(many, sample=80)
    assert names == sorted(WORDS)
    probe = [sentence(rng, lang, 12) for lang in names]
    assert L.evidence(table, probe).argmax(1).tolist() == list(range(len(names)))
