"""Substring deduplication by suffix automata of reference shards (operator 12).

A window is ``window`` consecutive words of a document; a word is removed
when a window over it also starts in a document with a smaller doc_id.

One automaton of the whole corpus does not fit anywhere, and broadcasting
the automata of its shards one after the other would read the corpus once
for each of them.  So shards are cut by content, and only text that can
match comes to a shard:

1. A window's anchor is the smallest hash of its 5-word sequences.  Equal
   windows have equal anchors, and neighbouring windows mostly share theirs:
   a maximal run of them is a stretch.  Anchors found in two texts or more
   are marked in a bitmap of bounded size, which is broadcast; a second scan
   sends the stretches under marked anchors (a stretch marked by mistake
   only costs its bytes).
2. Equal stretches become one with their smallest doc_id.  Stretches under
   the same anchors are a reference shard: a task builds the suffix
   automaton of its words - every state knows the smallest document among
   its occurrences - and streams the stretches through it.  The state of the
   suffix of ``window`` words says where that window starts first.  An
   anchor with more than ``HEAVY`` distinct stretches (a common line in ever
   other surroundings) is dealt out window by window instead.
3. The first documents go back to the stretches' places, and each document
   removes the maximal spans that started in a smaller one.

Copies of a text need no matching: all but the first lose every window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm import words as W
from tablework.llm.store import discard, materialise, n_parts, prepare, table
from tablework.session import shared_dir

WINDOW = 13
GRAM = 5                # words of an anchor
RUN = 16                # windows of a stretch at most
HEAVY = 2_000           # distinct stretches of an anchor that one shard takes
SHARD_WORDS = 100_000   # words after which a shard is closed
CELL_BITS = (16, 28)    # log2 of the bitmap's smallest and largest number of cells
BUCKET = 32_768         # cells of a bitmap row

_CASED = W.byte_table(b"\x20\x09\x0a\x0b\x0c\x0d", lower=False)


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences.  ``first[s]`` is the
    smallest document among the occurrences of state s (after ``close``)."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [None]

    def add(self, words: list, doc: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:  # known from an earlier sequence
                last = q if length[q] == length[last] + 1 else self._clone(last, w, q)
            else:
                cur = len(link)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                first.append(None)
                p = last
                while p != -1 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p != -1:
                    q = nxt[p][w]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
                last = cur
            if first[last] is None or doc < first[last]:
                first[last] = doc

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(link)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        self.first.append(None)
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        link[q] = c
        return c

    def close(self) -> None:
        """Occurrences of a state are occurrences of its suffix links, too:
        smallest documents move up, from the longest states on."""
        none = np.iinfo(np.int64).max
        first = np.array([none if f is None else f for f in self.first], np.int64)
        length, link = np.array(self.length), np.array(self.link)
        order = np.argsort(-length, kind="stable")[:-1]  # without the root
        for level in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            np.minimum.at(first, link[level], first[level])
        self.first = [None if f == none else f for f in first.tolist()]

    def starts(self, words: list, window: int) -> list:
        """Matching statistics cut at the window: for each window of the
        sequence the smallest document that holds it, None if none does."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        out, s, matched = [], 0, 0
        for i, w in enumerate(words):
            t = nxt[s].get(w)
            while t is None and s:
                s = link[s]
                matched = length[s]
                t = nxt[s].get(w)
            if t is not None:
                s = t
                matched += 1
                while length[link[s]] >= window:  # up to the state of the suffix of `window` words
                    s = link[s]
                    matched = length[s]
            if i + 1 >= window:
                out.append(first[s] if matched >= window else None)
        return out


def _anchors(texts: list[bytes], window: int):
    """texts -> (bytes of all texts with single spaces, word starts, word ends,
    first word of each text, and of each stretch: text, first word in it,
    number of windows, anchor)."""
    plain = [b" ".join(t.split()) for t in texts]
    raw = b" ".join(plain) + b" "
    offs = np.zeros(len(plain) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in plain], out=offs[1:])
    start, end, h, first = W.split_words(np.frombuffer(raw, np.uint8), offs, _CASED)
    k = min(GRAM, window)
    none = np.empty(0, np.int64)
    if len(start) < window:
        return raw, start, end, first, none, none, none, none
    grams = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        grams = W.mix(grams * np.uint64(0x9E3779B97F4A7C15) + h[i: len(h) - k + 1 + i])
    low, have = grams, 1
    while have < window - k + 1:  # sliding minimum of window - k + 1 grams
        step = min(have, window - k + 1 - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    text = np.repeat(np.arange(len(texts)), np.diff(first))[: len(low)]
    at = np.flatnonzero(np.arange(len(low)) + window <= first[1:][text])
    if not len(at):
        return raw, start, end, first, none, none, none, none
    low, text = (low[at] >> np.uint64(1)).astype(np.int64), text[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1]) | (low[1:] != low[:-1])
    head = np.flatnonzero(new)
    within = np.arange(len(at)) - np.repeat(head, np.diff(np.r_[head, len(at)]))
    head = np.flatnonzero(within % RUN == 0)  # long runs (repeated words) in pieces
    return raw, start, end, first, text[head], at[head] - first[text[head]], np.diff(np.r_[head, len(at)]), low[head]


def _blocks(batches, seen_of) -> Iterator[tuple[list[bytes], list]]:
    """(texts, keys) of about W.CHUNK bytes; ``seen_of(hash, doc_id)`` says
    whether a text has been sent by this task already."""
    texts, keys, size = [], [], 0
    for b in batches:
        for d, t, h in zip(*(b.column(i).to_pylist() for i in range(3))):
            if d is None or t is None or seen_of(h, d):
                continue
            t = t.encode()
            texts.append(t)
            keys.append((d, h))
            size += len(t)
            if size >= W.CHUNK:
                yield texts, keys
                texts, keys, size = [], [], 0
    if texts:
        yield texts, keys


def _counted_anchors(batches, window: int) -> Iterator[pa.RecordBatch]:
    """(anchor, texts of this block with it)."""
    seen: set[bytes] = set()
    for texts, _ in _blocks(batches, lambda h, d: h in seen or seen.add(h)):
        *_, text, _, _, anchor = _anchors(texts, window)
        pair = np.unique(np.stack([anchor, text]), axis=1)[0] if len(anchor) else anchor
        value, count = np.unique(pair, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(np.minimum(count, 2).astype(np.int32))], names=["anchor", "n"])


class Gate:
    """Bitmap of marked anchors."""

    def __init__(self, bits: int, rows):
        self.mask = (1 << bits) - 1
        self.map = np.zeros(max(BUCKET, 1 << bits) // 8, np.uint8)
        for r in rows:
            got = np.frombuffer(bytes(r.bitmap), np.uint8)
            at = r.bucket * (BUCKET // 8)
            self.map[at:at + len(got)] = got

    def __call__(self, anchors: np.ndarray) -> np.ndarray:
        cell = anchors & self.mask
        return (self.map[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def _gate(marked: DataFrame) -> Gate:
    """16 cells for each marked anchor, as long as CELL_BITS allows (32 MB)."""
    bits = min(max(CELL_BITS[0], (16 * marked.count()).bit_length()), CELL_BITS[1])
    cell = F.col("anchor").bitwiseAND(F.lit((1 << bits) - 1))
    rows = marked.select((cell / BUCKET).cast("long").alias("bucket"), (cell % BUCKET).alias("bit")) \
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap")).collect()
    return Gate(bits, rows)


_STRETCH = "doc_id long, hash binary, at int, anchor long, words string"


def _stretches(batches, gate, window: int) -> Iterator[pa.RecordBatch]:
    """Stretches under marked anchors.  A task sends a text once, and again
    only for a smaller doc_id."""
    least: dict[bytes, int] = {}

    def sent(h, d):
        if d >= least.get(h, d + 1):
            return True
        least[h] = d
        return False

    for texts, keys in _blocks(batches, sent):
        raw, start, end, first, text, at, n, anchor = _anchors(texts, window)
        if not len(anchor):
            continue
        go = gate.value(anchor)
        text, at, n, anchor = text[go], at[go], n[go], anchor[go]
        lo, hi = start[first[text] + at], end[first[text] + at + n + window - 2]
        yield pa.RecordBatch.from_arrays([
            pa.array([keys[t][0] for t in text], pa.int64()), pa.array([keys[t][1] for t in text], pa.binary()),
            pa.array(at.astype(np.int32)), pa.array(anchor), pa.array([raw[a:b] for a, b in zip(lo.tolist(), hi.tolist())], pa.binary()).cast(pa.string())],
            names=["doc_id", "hash", "at", "anchor", "words"])


def _packed(df: DataFrame, name: str) -> DataFrame:
    """``materialise`` for tables of texts: packed more tightly."""
    path = shared_dir(df.sparkSession, "llm", name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def _key() -> Column:
    return F.unhex(F.md5(F.col("words").cast("binary"))).alias("key")


def _judged(batches, window: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    """(anchor, words, first, last) sorted by anchor -> (words, last, starts):
    the first document of each window, for stretches that some document has
    after another one."""
    shard, size, anchor = [], 0, None

    def close():
        sam, ids = SuffixAutomaton(), {}
        pieces = [[ids.setdefault(w, len(ids)) for w in words.split(" ")] for words, _, _ in shard]
        for p, (_, first, _) in zip(pieces, shard):
            sam.add(p, first)
        sam.close()
        out = [(words, last, starts) for p, (words, _, last) in zip(pieces, shard)
               if min(starts := sam.starts(p, window)) < last]
        return pa.RecordBatch.from_arrays([
            pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()),
            pa.array([o[2] for o in out], pa.list_(pa.int64()))], names=["words", "last", "starts"])

    for b in batches:
        for a, words, first, last in zip(*(b.column(i).to_pylist() for i in range(4))):
            if size >= shard_words and a != anchor:
                yield close()
                shard, size = [], 0
            shard.append((words, first, last))
            size += words.count(" ") + 1
            anchor = a
    if shard:
        yield close()


def _windows(batches, window: int) -> Iterator[pa.RecordBatch]:
    """(words, first, last) -> a row per window: (words, at, window, first, last)."""
    for b in batches:
        rows = []
        for words, first, last in zip(*(b.column(i).to_pylist() for i in range(3))):
            w = words.split(" ")
            rows += [(words, i, " ".join(w[i:i + window]), first, last) for i in range(len(w) - window + 1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (
            pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["whole", "at", "words", "first", "last"])


def _by_shard(distinct: DataFrame, window: int) -> DataFrame:
    """distinct(anchor, words, first, last) -> (words, last, starts)."""
    placed = distinct.select("anchor", "words", "first", "last").repartition(n_parts(distinct.sparkSession), "anchor") \
        .sortWithinPartitions("anchor")
    return placed.mapInArrow(lambda it: _judged(it, window, SHARD_WORDS), "words string, last long, starts array<long>")


def first_starts(stretches: DataFrame, window: int = WINDOW) -> DataFrame:
    """stretches(anchor, words, doc_id) -> (words, starts): the smallest
    document of each window, for stretches whose windows are not all first
    in their only document."""
    distinct = _packed(stretches.groupBy("anchor", "words").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "distinct")
    # stored, so that the joins know how small it is: at most stretches / HEAVY rows
    heavy = materialise(distinct.groupBy("anchor").count().where(F.col("count") > HEAVY).select("anchor"), "heavy")
    light = _by_shard(distinct.join(heavy, "anchor", "left_anti"), window)
    single = distinct.join(heavy, "anchor", "left_semi").select("words", "first", "last") \
        .mapInArrow(lambda it: _windows(it, window), "whole string, at int, words string, first long, last long")
    single = materialise(single, "windows")
    once = single.groupBy("words").agg(F.min("first").alias("first"), F.max("last").alias("last")) \
        .withColumn("anchor", F.xxhash64("words"))
    known = _by_shard(once, window).select("words", F.col("starts")[0].alias("start"))
    # windows that only one document has are not in `known`: they start where they are
    dealt = single.join(known, "words", "left").groupBy("whole").agg(
        F.max("last").alias("last"),
        F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("start", "first").alias("start")))), lambda s: s["start"]).alias("starts"))
    dealt = dealt.where(F.array_min("starts") < F.col("last")).select(F.col("whole").alias("words"), "starts")
    return light.select("words", "starts").unionByName(dealt)


_SPANS = "array<struct<start:int,end:int>>"


def _cut(batches, window: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, copy: an earlier document has the same text, windows:
    first words of the windows to remove) -> the operator's columns."""
    for b in batches:
        n_words, spans, kept = [], [], []
        at = b.column(3).fill_null([]) if b.column(3).null_count else b.column(3)
        first, every = at.offsets.to_numpy(), at.values.to_numpy()
        for i, (d, text, copy) in enumerate(zip(*(b.column(i).to_pylist() for i in range(3)))):
            words = (text or "").encode().split()
            mine = every[first[i]:first[i + 1]] if d is not None and not copy else ()
            n_words.append(len(words))
            if copy and len(words) >= window:
                spans.append([(0, len(words))])
                kept.append(b"")
            elif len(mine):
                gone = np.zeros(len(words) + 1, np.int32)
                np.add.at(gone, mine, 1)
                np.add.at(gone, mine + window, -1)
                cover = np.cumsum(gone) > 0
                edge = np.flatnonzero(cover[1:] != cover[:-1]) + 1
                edge = np.r_[0, edge].tolist() if cover[0] else edge.tolist()
                spans.append(list(zip(edge[::2], edge[1::2])))
                rest, left = [], 0
                for lo, hi in spans[-1]:
                    rest += words[left:lo]
                    left = hi
                kept.append(b" ".join(rest + words[left:]))
            else:
                spans.append([])
                kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([
            b.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "spans", "kept"])


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id long, text string) -> (doc_id, n_words long, spans
    array<struct<start, end>> of removed words, end exclusive, kept string),
    one row per input row; kept words are joined by one space.

    Words are runs of characters other than space and \\x09-\\x0D, unchanged.
    Null and empty texts have no words.  Rows without doc_id are returned
    whole and remove nothing from others.  Rows that share a doc_id remove
    nothing from each other, as neither is smaller; each is judged by its own
    text.  Documents of fewer than ``window`` words keep all.  Extra columns
    are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark, 500)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .withColumn("hash", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    marked = materialise(rows.mapInArrow(lambda it: _counted_anchors(it, window), "anchor long, n int")
                         .groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "anchors")
    gate = spark.sparkContext.broadcast(_gate(marked))
    stretches = _packed(rows.mapInArrow(lambda it: _stretches(it, gate, window), _STRETCH), "stretches")
    starts = first_starts(stretches, window)
    places = stretches.select("hash", "doc_id", "at", _key()).join(starts.select(_key(), "starts"), "key") \
        .where(F.array_min("starts") < F.col("doc_id")) \
        .groupBy("hash").agg(F.collect_set(F.struct("at", "starts")).alias("places"))
    copies = rows.where("doc_id is not null").groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    mine = F.flatten(F.transform("places", lambda p: F.filter(
        F.transform(p["starts"], lambda s, i: F.when(s < F.col("least"), p["at"] + i)), lambda x: x.isNotNull())))
    facts = copies.join(places, "hash", "left").where("least < most or places is not null").select("hash", "least", mine.alias("windows"))
    facts = materialise(facts, "facts")
    discard(marked, stretches)
    copy = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)).alias("copy")
    return rows.join(facts, "hash", "left").select("doc_id", "text", copy, "windows") \
        .mapInArrow(lambda it: _cut(it, window), f"doc_id long, n_words long, spans {_SPANS}, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every whole text of ``documents``."""
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
