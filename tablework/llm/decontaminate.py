"""Benchmark decontamination by q-gram lemma filtering (operator 4).

Finds every place of a text within an edit budget of a benchmark item.
Texts and items are compared as lower-cased characters with each run of
white space as one space.  An item of m characters may differ by
``e = floor(rate * m)`` edits, less where the lemma would say nothing.

A place with at most e edits keeps ``m + 1 - q - q*e`` of the item's q-grams
within e diagonals of each other.  Shared q-grams are counted in overlapping
diagonal bands (each band overlaps the next by e); bands that reach the
bound are verified by a banded alignment that is free at the text's ends.

The benchmark is sent to the tasks in blocks of at most ``BLOCK_CHARS``
characters, one scan of the texts per block, so what is broadcast is bounded
for any benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm import words as W
from tablework.llm.store import prepare, table

Q = 10                    # characters of a gram
RATE = 0.08               # edits allowed per item character
SHORT = 25                # items with fewer characters must occur unchanged
BLOCK_CHARS = 4_000_000   # benchmark characters sent at a time
CHUNK = 1 << 19           # text characters scanned at a time

_SPACE = np.zeros(0x3001, bool)
_SPACE[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def lower(text: str) -> str:
    """Lower case, one character for each (others stay as they are)."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points, their places in the text) with white space collapsed."""
    c = np.frombuffer(lower(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    sp = _SPACE[np.minimum(c, 0x3000)] & (c <= 0x3000)
    keep = ~sp
    keep[1:] |= sp[1:] & ~sp[:-1]
    if len(c):
        keep[0] |= sp[0]
    at = np.flatnonzero(keep)
    return np.where(sp, 32, c)[at].astype(np.uint32), at


def trimmed(text: str) -> np.ndarray:
    """An item's characters, without white space at its ends."""
    c, _ = normal(text.strip())
    return c


def budget(m: int, rate: float = RATE, q: int = Q) -> int:
    """Edits allowed in an item of m characters; the lemma's bound stays 1 or more."""
    return 0 if m < SHORT else max(0, min(int(rate * m), (m - q) // q))


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters at each place (len - q + 1 of them)."""
    if len(c) < q:
        return np.empty(0, np.uint64)
    total = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(W.mix(c.astype(np.uint64) + np.uint64(1)) * W._power("p", len(c)), out=total[1:])
    return W.mix((total[q:] - total[:-q]) * W._power("q", len(c) + 1)[:len(c) - q + 1])


class Bench:
    """One block of items with the index of its q-grams."""

    def __init__(self, items: list[tuple[int, np.ndarray]], rate: float, q: int):
        self.q, self.ids, self.chars = q, [i for i, _ in items], [c for _, c in items]
        m = np.array([len(c) for c in self.chars], np.int64)
        self.m = m
        self.e = np.array([budget(int(x), rate, q) for x in m], np.int64)
        self.bound = m + 1 - q - q * self.e
        self.tiny = [i for i in range(len(items)) if 0 < m[i] < q]
        grams = [gram_hashes(c, q) for c in self.chars]
        h = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        off = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.off = h[order], item[order], off[order]
        self.gate = np.zeros(1 << 22, bool)
        self.gate[(self.h >> np.uint64(42)).astype(np.int64)] = True

    def regions(self, c: np.ndarray, edge: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, text, low, high): a band's stretch of the texts laid end to
        end in c (text t is c[edge[t]:edge[t+1]])."""
        g = gram_hashes(c, self.q)
        may = np.flatnonzero(self.gate[(g >> np.uint64(42)).astype(np.int64)])
        lo = np.searchsorted(self.h, g[may])
        n = np.searchsorted(self.h, g[may], side="right") - lo
        text = np.searchsorted(edge, may, side="right") - 1
        n = np.where(may + self.q <= edge[text + 1], n, 0)  # grams across two texts
        pos = np.repeat(may, n)
        if not len(pos):
            return
        entry = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(pos))
        text, item = np.repeat(text, n), self.item[entry]
        diag = pos - self.off[entry] + self.m[item]  # never negative
        wide = self.e[item] + 1                      # a band's own diagonals; it overlaps the next by e
        band = diag // wide
        again = (diag % wide < self.e[item]) & (band > 0)
        text, item, band = (np.concatenate([x, y]) for x, y in ((text, text[again]), (item, item[again]), (band, band[again] - 1)))
        key = np.lexsort((band, item, text))
        text, item, band = text[key], item[key], band[key]
        head = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
        hits = np.diff(np.r_[head, len(text)])
        good = head[hits >= self.bound[item[head]]]
        low = band[good] * wide_of(self.e[item[good]]) - self.m[item[good]] - self.e[item[good]]
        high = low + 4 * self.e[item[good]] + 2 + self.m[item[good]]
        last = None
        for i, t, a, b in zip(item[good].tolist(), text[good].tolist(), low.tolist(), high.tolist()):
            a, b = max(a, int(edge[t])), min(b, int(edge[t + 1]))
            if last and last[:2] == (i, t) and a <= last[3]:  # neighbouring bands are one stretch
                last = (i, t, last[2], max(b, last[3]))
                continue
            if last:
                yield last
            last = (i, t, a, b)
        if last:
            yield last


def wide_of(e):
    return e + 1


def align(p: np.ndarray, t: np.ndarray, e: int) -> list[tuple[int, int, int]]:
    """Places (start, end, edits) of p in t with at most e edits, leftmost
    best first, not overlapping.  Rows of the table are the item's
    characters; a row spans the whole (short) stretch t."""
    out = []
    m, base = len(p), 0
    while m - e <= len(t):
        n = len(t)
        big = np.int64(n + 2)
        step = np.arange(n + 1) * big
        row = np.arange(n + 1, dtype=np.int64)           # cost * big + start: free start
        for i in range(m):
            nxt = row + big                              # item character left out
            np.minimum(nxt[1:], row[:-1] + big * (t != p[i]), out=nxt[1:])
            row = np.minimum.accumulate(nxt - step) + step  # text characters in between
        cost = row // big
        best = int(cost.min())
        if best > e:
            break
        end = int(np.argmin(cost))
        start = int(row[end] % big)
        out.append((base + start, base + end, best))
        cut = max(end, start + 1)
        t, base = t[cut:], base + cut
        if best and len(t) < m - e:
            break
    return out


def exact(p: bytes, t: bytes) -> list[int]:
    out, at = [], t.find(p)
    while at >= 0:
        if at % 4 == 0:
            out.append(at // 4)
        at = t.find(p, at + (len(p) if at % 4 == 0 else 1))
    return out


def places(texts: list[str | None], bench: Bench) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) over a list of texts."""
    raw_items = [c.tobytes() for c in bench.chars]
    i = 0
    while i < len(texts):
        parts, j, size = [], i, 0
        while j < len(texts) and (j == i or size < CHUNK):
            parts.append(normal(texts[j] or ""))
            size += len(parts[-1][0])
            j += 1
        edge = np.cumsum([0] + [len(c) for c, _ in parts])
        c = np.concatenate([c for c, _ in parts])
        found = [(k, t, a, z) for k, t, a, z in bench.regions(c, edge)]
        found += [(k, t, int(edge[t]), int(edge[t + 1])) for k in bench.tiny for t in range(j - i)]
        for k, t, a, z in found:
            spot = c[a:z]
            hits = [(s, s + len(bench.chars[k]), 0) for s in exact(raw_items[k], spot.tobytes())]
            if not hits and bench.e[k]:
                hits = align(bench.chars[k], spot, int(bench.e[k]))
            where = parts[t][1]
            for s, x, cost in hits:
                s, x = a + s - int(edge[t]), a + x - int(edge[t])
                yield i + t, k, int(where[s]), int(where[x - 1]) + 1, cost
        i = j


def _blocks(benchmark: DataFrame) -> Iterator:
    """Broadcasts of [(item_id, characters)], each of about BLOCK_CHARS at most."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .where("length(trim(text)) > 0").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // BLOCK_CHARS))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        block = sorted(((r.item_id, trimmed(r.text)) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].tobytes()))
        yield spark.sparkContext.broadcast([(i, c) for i, c in block if len(c)])


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, q: int = Q) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> (doc_id, item_id,
    start, end, edits): code points of the text, end exclusive.

    Null and empty texts and items (also items of white space only) match
    nothing.  Items of fewer than SHORT characters must occur unchanged.
    Items with equal texts match under each id, repeated rows of docs give
    their matches each, and a null doc_id or item_id is carried through.
    Where unchanged copies of an item lie in a stretch, only these are
    listed for it.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for held in _blocks(benchmark):

        def run(batches, held=held):
            bench = Bench(held.value, rate, q)
            for b in batches:
                ids = b.column(0).to_pylist()
                rows = [(ids[t], bench.ids[k], s, x, e) for t, k, s, x, e in places(b.column(1).to_pylist(), bench)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)],
                                                     names=["doc_id", "item_id", "start", "end", "edits"])

        got = docs.mapInArrow(run, "doc_id long, item_id long, start long, end long, edits long")
        out = got if out is None else out.unionByName(got)
    return out


def without_matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, q: int = Q) -> DataFrame:
    """The rows of docs whose text holds no benchmark item, unchanged and without a shuffle."""
    prepare(docs.sparkSession)
    for held in _blocks(benchmark):

        def run(batches, held=held):
            bench = Bench(held.value, rate, q)
            for b in batches:
                at = b.schema.get_field_index("text")
                bad = {t for t, *_ in places(b.column(at).to_pylist(), bench)}
                yield b.filter(pa.array([t not in bad for t in range(b.num_rows)], pa.bool_())) if bad else b

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every whole text of ``documents`` against all of ``benchmark``; a
    row per (doc_id, item_id) with its best place and how many there are."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_places"), F.min(F.struct("edits", "start", "end")).alias("best")).select(
        "doc_id", "item_id", "n_places", "best.edits", "best.start", "best.end")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item are dropped."""
    return without_matches(docs, table(spark, sf_dir, "benchmark"))
