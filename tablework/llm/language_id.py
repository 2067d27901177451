"""Language identification by Bayesian evidence fusion (operator 9).

For each page four kinds of evidence are multiplied: how likely its text is
in each language (character trigrams), the language its markup declares,
the suffix of its address, and a prior of its host.  Trigram likelihoods
come from labelled documents; the other tables are grouped counts over all
pages against the language their text suggests.  A host's prior is smoothed
towards that of its parent domain, and so on up to the whole crawl; the
page itself is left out of every count it is judged by.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm import words as W
from tablework.llm.store import bounded_sample, materialise, prepare, table

BUCKETS = 1 << 16   # trigram buckets
SAMPLE = 4_000      # labelled documents the trigrams are counted on
TRUST = 150.0       # trigrams a text's evidence counts as at most
KAPPA = 5.0         # pages' worth of the parent's prior in a host's
LEVELS = 4          # domain levels below the crawl: suffix, domain, ...

_RAW = re.compile(r"<(script|style)\b", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_HTML = re.compile(r"<html\b[^>]*", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def visible(page: str) -> str:
    """Text of a page: no comments, scripts, styles or tags; entities resolved.
    One pass: an end that is not found once is not looked for again, and what
    it should have closed counts as a tag (or, without ``>``, as text)."""
    out, at, missing = [], 0, set()
    while (lt := page.find("<", at)) >= 0:
        out.append(page[at:lt])
        end, kind = -1, None
        if page.startswith("<!--", lt):
            kind = "comment"
            if kind not in missing:
                k = page.find("-->", lt + 4)
                end = k + 3 if k >= 0 else -1
        elif m := _RAW.match(page, lt):
            kind = m[1].lower()
            if kind not in missing:
                c = _CLOSE[kind].search(page, m.end())
                end = c.end() if c else -1
        if end < 0 and kind:
            missing.add(kind)
        if end < 0:
            end = page.find(">", lt) + 1
        if not end:  # no tag ends any more
            at = lt
            break
        out.append(" ")
        at = end
    return _html.unescape("".join(out) + page[at:])


def declared_language(page: str) -> str | None:
    """The language a page's html element declares."""
    for tag in _HTML.finditer(page):
        if m := _LANG.search(tag[0]):
            return m[1].lower()
    return None


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of texts (lower case; anything but letters
    as one space), and the first of each text."""
    raw, offs = W.text_bytes(pa.array([f" {t.lower()} " for t in texts], pa.string()))
    keep = raw >= 128
    keep |= (raw >= 97) & (raw <= 122)
    x = np.where(keep, raw, 32).astype(np.uint64)
    one = np.ones(len(x), bool)
    one[1:] = (x[1:] != 32) | (x[:-1] != 32)
    one[offs[:-1][offs[:-1] < len(x)]] = True
    at = np.flatnonzero(one)
    x, first = x[at], np.searchsorted(at, offs)
    if len(x) < 3:
        return np.empty(0, np.int64), np.zeros(len(first), np.int64)
    g = (W.mix(x[:-2] << np.uint64(16) | x[1:-1] << np.uint64(8) | x[2:]) & np.uint64(BUCKETS - 1)).astype(np.int64)
    # those that run into the next text are left out
    text = np.searchsorted(first, np.arange(len(g)), side="right") - 1
    fine = np.arange(len(g)) + 3 <= first[text + 1]
    return g[fine], np.searchsorted(text[fine], np.arange(len(first)))


def train(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihood of each bucket in each: BUCKETS x languages)."""
    names = sorted(set(langs))
    counts = np.full((BUCKETS, len(names)), 0.5)
    for k, name in enumerate(names):
        g, _ = trigrams([t for t, x in zip(texts, langs) if x == name])
        counts[:, k] += np.bincount(g, minlength=BUCKETS)
    return names, np.log(counts / counts.sum(0)).astype(np.float32)


def evidence(model: np.ndarray, texts: list[str]) -> np.ndarray:
    """Log likelihood of each text in each language, relative to the best,
    with at most TRUST trigrams' worth; 0 everywhere for texts without any."""
    out = np.zeros((len(texts), model.shape[1]))
    if not model.shape[1]:
        return out
    g, first = trigrams(texts)
    n = np.diff(first)
    some = np.flatnonzero(n)
    if len(some):
        sums = np.add.reduceat(model[g].astype(np.float64), first[some], axis=0)
        out[some] = sums / n[some][:, None] * np.minimum(n[some], TRUST)[:, None]
    return out - out.max(1, keepdims=True)


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """From at most ``sample`` distinct (text, language) of documents that have
    both, by hash; no languages without any."""
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")) \
        .where("lang is not null and length(text) > 0")
    total = texts.select(F.xxhash64("text", "lang")).distinct().count()
    if total > 4 * sample:  # a share of the hash range that holds enough: copies are in or out together
        share = int(2.0 ** 64 * 2.0 * sample / total)
        texts = texts.where(F.xxhash64("text", "lang") < F.lit(-(2 ** 63) + share))
    rows = bounded_sample(texts.distinct(), ["text", "lang"], sample, 0).orderBy("lang", "text").toArrow()
    return train(rows.column("text").to_pylist(), rows.column("lang").to_pylist())


def _texts(batches, held) -> Iterator[pa.RecordBatch]:
    model = held.value
    for b in batches:
        pages = [p or "" for p in b.column(1).to_pylist()]
        declared = [declared_language(p) for p in pages]
        ll: list = []
        i = 0
        while i < len(pages):
            j, size = i, 0
            while j < len(pages) and (j == i or size < 1 << 20):
                size += len(pages[j])
                j += 1
            ll += evidence(model, [visible(p) for p in pages[i:j]]).tolist()
            i = j
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(declared, pa.string()), pa.array(ll, pa.list_(pa.float64()))],
                                         names=["page_id", "host", "declared", "ll"])


def host_of(url: Column) -> Column:
    """Lower-case host without port; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _level(host: Column, k: int) -> Column:
    """The last k labels of a host (all of them where it has fewer)."""
    return F.substring_index(host, ".", -k)


def _likelihood(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """(value, counts per language) of a column against the text's language."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.array(*[F.count(F.when(F.col("text_lang") == i, 1)) for i in range(len(names))]).alias(f"{column}_n"))


def _smoothed(counts: Column, parent: Column) -> Column:
    """Counts with KAPPA more that are dealt by the parent's prior, as shares."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, y: s + y) + KAPPA
    return F.zip_with(counts, parent, lambda x, p: (x + KAPPA * p) / total)


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, host, declared, text_lang, lang,
    probability), one row per row.  Null or empty pages are judged by the
    other evidence; without a url the host is '' (its pages share a prior).
    A model without languages (no labelled text) gives null languages and
    probabilities."""
    spark = pages.sparkSession
    prepare(spark, 200)
    names, table_ = model
    L = len(names)
    held = spark.sparkContext.broadcast(table_)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"),
                        host_of(F.col("url").cast("string")).alias("host")) \
        .mapInArrow(lambda it: _texts(it, held), "page_id long, host string, declared string, ll array<double>")
    rows = rows.withColumn("text_lang", F.when(F.expr("exists(ll, x -> x < 0)"), F.array_position("ll", 0.0).cast("int") - 1)) \
        .withColumn("suffix", F.when(F.col("host") != "", _level(F.col("host"), 1)))
    for k in range(2, LEVELS + 1):
        rows = rows.withColumn(f"level{k}", _level(F.col("host"), k))
    rows = materialise(rows, "evidence")
    if not L:
        none = F.lit(None).cast("string")
        return rows.select("page_id", "host", "declared", none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("probability"))
    total = rows.groupBy().agg(*[F.count(F.when(F.col("text_lang") == i, 1)).alias(f"n{i}") for i in range(L)]).first()
    whole = F.array(*[F.lit(int(total[f"n{i}"])) for i in range(L)])
    levels = ["suffix", *[f"level{k}" for k in range(2, LEVELS + 1)], "host"]
    out = rows
    for column in ["declared", *levels]:
        # one row per value; a host with very many pages is split by the adaptive join
        counts = materialise(_likelihood(rows, column, names), "counts")
        out = out.join(counts, column, "left")
    own = F.transform(F.sequence(F.lit(0), F.lit(L - 1)), lambda i: F.coalesce((i == F.col("text_lang")).cast("int"), F.lit(0)))

    def without(n: Column) -> Column:
        return F.zip_with(n, own, lambda x, y: (x - y).cast("double"))

    def of_language(n: Column, values: int) -> Column:
        """log P(value | language), add-one smoothed."""
        return F.zip_with(without(n), without(whole), lambda c, t: F.log((c + 1) / (t + values)))

    kinds = {c: rows.select(c).where(F.col(c).isNotNull()).distinct().count() for c in ("declared", "suffix")}
    none = F.array(*[F.lit(0.0)] * L)
    out = out.withColumn("ev_declared", F.coalesce(of_language(F.col("declared_n"), kinds["declared"]), none)) \
        .withColumn("ev_suffix", F.coalesce(of_language(F.col("suffix_n"), kinds["suffix"]), none))
    prior = F.transform(without(whole), lambda x: (x + 1) / (F.aggregate(without(whole), F.lit(0.0), lambda s, y: s + y) + L))
    out = out.withColumn("prior0", prior)
    for i, column in enumerate(levels[1:]):  # the suffix itself is evidence of its own
        n = without(F.coalesce(F.col(f"{column}_n"), F.array(*[F.lit(0).cast("long")] * L)))
        out = out.withColumn(f"w{i}", n).withColumn(f"prior{i + 1}", _smoothed(F.col(f"w{i}"), F.col(f"prior{i}")))
    last = f"prior{len(levels) - 1}"
    logs = F.zip_with(F.zip_with("ll", "ev_declared", lambda a, b: a + b),
                      F.zip_with("ev_suffix", F.transform(last, lambda p: F.log(p)), lambda a, b: a + b), lambda a, b: a + b)
    out = out.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    name = F.array(*[F.lit(x) for x in names])
    weight = F.aggregate(F.transform("logs", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda s, y: s + y)
    return out.select("page_id", "host", "declared", F.get(name, F.col("text_lang")).alias("text_lang"),
                      F.get(name, F.array_position("logs", F.col("top")).cast("int") - 1).alias("lang"),
                      F.round(1 / weight, 6).alias("probability"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every row of ``pages``; trigrams from ``documents``."""
    prepare(spark)
    return identify(table(spark, sf_dir, "pages"), fit(table(spark, sf_dir, "documents")))
