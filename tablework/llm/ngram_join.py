"""N-gram Jaccard join by signature trees (operator 1).

Documents are sets of distinct k-word shingles; two documents link when
``100 * |A & B| >= threshold * |A | B|``.  The result is the class (connected
component) of every document.

Plan
1. One scan makes each text's shingle set.  Equal sets have equal node ids.
   A task sends its (shingle, text) postings as packed blocks, one for each
   slice of the shingles' hash range; copies inside a task are sent once.
2. A slice counts its shingles and keeps those of two texts or more - no
   other can make a link - and sends them back to the block of their texts.
   There every text's prefix is taken: the first ``n - ceil(t * n) + 1``
   shingles, rarest first.  Linked sets share a prefix shingle.  Texts of a
   block meet at the block's first text with the shingle, so a hot shingle
   leaves a block as one row; the rest meet after a shuffle by shingle.  The
   components of these star edges bound where links can be.
3. The sets of those candidate groups (and only those) are brought together,
   a group in one block.  A group above ``2 * CELL_WEIGHT`` shingles is cut
   into cells by size band and hash, in three rounds: each cell by itself;
   the heads of the classes found so far; then, completely, all pairs of
   cells of compatible sizes whose members are not known to be one class (a
   class that fills a cell has cells of its own, the small ones share).
   However large a class of near copies is, its rows are copied only for the
   members that have not joined it.
4. In a block a signature tree is built - nodes hold the OR of their
   members' token bitmaps, a size range and the largest bit-collision slack -
   and traversed against itself.  A node pair is dropped when its size
   ranges exclude the threshold, when the largest overlap its bitmaps allow
   is too small, or when all its members are already known to be connected.
   Surviving leaves are compared exactly.  A block returns a spanning forest
   of its links, never all pairs.
5. Components of all blocks' links are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablework.llm import words as W
from tablework.llm.components import components
from tablework.llm.store import aside, discard, materialise, n_parts, prepare

SLICES = 8               # slices of the hash range for each shuffle partition
ROW_BITS = 20            # bits of a text's place in its block
BLOCK_TEXTS = 65_000     # texts in a block at most (their places take 16 bits)
BLOCK = 2_000_000        # shingles after which a block is closed
BITS = 4096              # bits of a signature
FAN = 8                  # children of a tree node
CELL_WEIGHT = 2_000_000  # shingles in a cell of a heavy group (about 16 MB)
GATE = 1 << 20           # cells of the filter on the texts read again


def need(na, nb, threshold: int):
    """Smallest overlap for which 100*i >= threshold*(na+nb-i)."""
    return -((-threshold * (na + nb)) // (100 + threshold))


def prefix_len(n: int, threshold: int) -> int:
    return n - -(-threshold * n // 100) + 1


def text_sets(raw: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    _, _, h, first = W.split_words(raw, offs)
    sh, sf = W.shingle_hashes(h, first, k)
    return [np.unique(sh[sf[d]:sf[d + 1]]) for d in range(len(sf) - 1)]


def node_id(tokens: np.ndarray) -> int:
    """63-bit id of a shingle set."""
    s = np.array([W.mix(tokens).sum() + np.uint64(len(tokens))])
    return int(W.mix(s)[0] >> np.uint64(1))


_POST = pa.schema([("slice", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("node", pa.int64()),
                   ("n", pa.int64()), ("place", pa.int32()), ("tokens", pa.binary()), ("places", pa.binary()),
                   ("df", pa.binary()), ("hash", pa.int64())])
_POST_DDL = ("slice int, block long, doc_id long, node long, n long, place int, tokens binary, places binary, "
             "df binary, hash long")


def _batch(m: int, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(m, f.type) for f in _POST], schema=_POST)


def _planes(x: np.ndarray) -> bytes:
    """Sorted 48-bit values by byte plane: the high planes compress to little."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    p = np.frombuffer(b, np.uint8).reshape(6, -1)
    out = np.zeros((p.shape[1], 8), np.uint8)
    out[:, :6] = p.T
    return out.view("<u8").ravel()


def _postings(batches, k: int, slices: int) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, node, n, place, hash) per text - place is null for a repeated
    set and for a null id - and packed postings per (block, slice).  A
    shingle is sent by 48 bits of its hash: equal shingles stay equal."""
    task = TaskContext.get().partitionId() << ROW_BITS
    seen: set[int] = set()
    block, texts, held, texts_seen = 0, [], 0, 0

    def close():
        tok = np.concatenate(texts) >> np.uint64(16)
        place = np.repeat(np.arange(len(texts), dtype=np.uint16), [len(t) for t in texts])
        order = np.argsort(tok, kind="stable")
        tok, place = tok[order], place[order]
        part = ((tok >> np.uint64(16)) * np.uint64(slices)) >> np.uint64(32)
        cut = np.searchsorted(part, np.arange(slices + 1))
        some = [i for i in range(slices) if cut[i] < cut[i + 1]]
        yield _batch(len(some), slice=some, block=[task + block] * len(some),
                     tokens=[_planes(tok[cut[i]:cut[i + 1]]) for i in some],
                     places=[place[cut[i]:cut[i + 1]].tobytes() for i in some])

    for b in batches:
        ids = b.column(0).to_pylist()
        hashes = b.column(2).to_pylist()
        raw, offs = W.text_bytes(b.column(1))
        out: dict[str, list] = {c: [] for c in ("slice", "block", "doc_id", "node", "n", "place", "hash")}
        for i, j in W.chunks(offs):
            o = offs[i:j + 1]
            for d, t in enumerate(text_sets(raw[o[0]:o[-1]], o - o[0], k), i):
                if len(texts) == BLOCK_TEXTS or held >= BLOCK:
                    yield from close()
                    block, texts, held = block + 1, [], 0
                texts_seen += 1  # rows of texts are spread over the slices
                node = node_id(t) if len(t) else None
                new = node is not None and ids[d] is not None and node not in seen
                for c, v in zip(out, ((texts_seen * 7919 + (task >> ROW_BITS) * 104729) % slices, task + block, ids[d], node, len(t),
                                      len(texts) if new else None, hashes[d])):
                    out[c].append(v)
                if new:
                    seen.add(node)
                    texts.append(t)
                    held += len(t)
        yield _batch(len(out["n"]), **out)
    if texts:
        yield from close()


def _shared(batches) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice.  Postings of shingles with two texts or more, with
    their count, per block; rows of texts pass through."""
    at, held = None, []

    def count():
        tok = np.concatenate([_unplanes(t) for _, t, _ in held])
        place = np.concatenate([np.frombuffer(p, np.uint16) for _, _, p in held])
        who = np.repeat(np.arange(len(held)), [len(p) // 2 for _, _, p in held])
        order = np.argsort(tok, kind="stable")
        tok = tok[order]
        head = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        size = np.diff(np.r_[head, len(tok)])
        df = np.repeat(size, size)
        keep = df > 1
        order, tok, df = order[keep], tok[keep], df[keep]
        back = np.argsort(who[order], kind="stable")
        order, tok, df = order[back], tok[back], df[back]
        cut = np.searchsorted(who[order], np.arange(len(held) + 1))
        some = [i for i in range(len(held)) if cut[i] < cut[i + 1]]
        place = place[order]
        if some:
            yield _batch(len(some), block=[held[i][0] for i in some],
                         tokens=[tok[cut[i]:cut[i + 1]].tobytes() for i in some],
                         places=[place[cut[i]:cut[i + 1]].tobytes() for i in some],
                         df=[df[cut[i]:cut[i + 1]].astype(np.uint32).tobytes() for i in some])

    for b in batches:
        texts = b.filter(b.column(6).is_null())
        if texts.num_rows:
            yield texts
        for r in b.filter(b.column(6).is_valid()).select(["slice", "block", "tokens", "places"]).to_pylist():
            if r["slice"] != at:
                if held:
                    yield from count()
                at, held = r["slice"], []
            held.append((r["block"], r["tokens"], r["places"]))
    if held:
        yield from count()


_SIG = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("place", pa.int64()),
                  ("hash", pa.int64())])


def _sig(kind: int, a, b, n=None, place=None, hashes=None) -> pa.RecordBatch:
    m = len(a)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(m, kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
        pa.array(n, pa.int64()) if n is not None else pa.nulls(m, pa.int64()),
        pa.array(place, pa.int64()) if place is not None else pa.nulls(m, pa.int64()),
        pa.array(hashes, pa.int64()) if hashes is not None else pa.nulls(m, pa.int64())], schema=_SIG)


def _stars(tok: np.ndarray, node: np.ndarray):
    """(tokens, their first node, edges of the other nodes to it)."""
    order = np.lexsort((node, tok))
    tok, node = tok[order], node[order]
    head = np.ones(len(tok), bool)
    head[1:] = tok[1:] != tok[:-1]
    at = np.flatnonzero(head)
    centre = np.repeat(node[at], np.diff(np.append(at, len(tok))))
    far = node != centre
    edges = np.unique(np.stack([node[far], centre[far]], 1), axis=0) if far.any() else np.empty((0, 2), np.int64)
    return tok[at], node[at], edges


def _prefixes(batches, threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block.  kind 0: (doc_id, node, n, row, hash); 1: (prefix
    shingle, its first row in the block); 2: (row, first row that shares a
    prefix shingle).  A row is a text's block and place."""
    at, texts, post = None, [], []

    def solve():
        out = [(d, v, n, None if p is None else (at << ROW_BITS) + p, h) for d, v, n, p, h in texts]
        yield _sig(0, *([r[i] for r in out] for i in range(5)))
        if not post:
            return
        n = np.zeros(BLOCK_TEXTS + 1, np.int64)
        for _, _, size, p, _ in texts:
            if p is not None:
                n[p] = size
        tok = np.concatenate([np.frombuffer(t, np.uint64) for t, _, _ in post])
        place = np.concatenate([np.frombuffer(p, np.uint16) for _, p, _ in post]).astype(np.int64)
        df = np.concatenate([np.frombuffer(f, np.uint32) for _, _, f in post])
        order = np.lexsort((tok, df, place))
        tok, place = tok[order], place[order]
        head = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        size = np.diff(np.r_[head, len(place)])
        rank = np.arange(len(place)) - np.repeat(head, size)
        alone = np.repeat(n[place[head]] - size, size)  # shingles of this text only come first
        keep = rank < n[place] + (-threshold * n[place]) // 100 + 1 - alone
        if keep.any():
            t, v, e = _stars(tok[keep], (at << ROW_BITS) + place[keep])
            yield _sig(1, t.view(np.int64), v)
            if len(e):
                yield _sig(2, e[:, 0], e[:, 1])

    for b in batches:
        for r in b.select(["block", "doc_id", "node", "n", "place", "tokens", "places", "df", "hash"]).to_pylist():
            if r["block"] != at:
                if at is not None:
                    yield from solve()
                at, texts, post = r["block"], [], []
            if r["tokens"] is None:
                texts.append((r["doc_id"], r["node"], r["n"], r["place"], r["hash"]))
            else:
                post.append((r["tokens"], r["places"], r["df"]))
    if at is not None:
        yield from solve()


def _token_edges(batches) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shingle, node): an edge from each node to its shingle's first."""
    tok = centre = None
    for b in batches:
        if b.num_rows == 0:
            continue
        t, v = (b.column(i).to_numpy() for i in (0, 1))
        head = np.ones(len(t), bool)
        head[1:] = t[1:] != t[:-1]
        at = np.flatnonzero(head)
        first = v[at]
        if t[0] == tok:
            first[0] = centre
        c = np.repeat(first, np.diff(np.append(at, len(t))))
        tok, centre = t[-1], c[-1]
        far = v != c
        if far.any():
            e = np.unique(np.stack([v[far], c[far]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])


# --- the tree ---------------------------------------------------------------

class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


class SignatureTree:
    """Members are sorted distinct uint64 arrays, in the order given (similar
    ones next to each other prune best).  ``level[0]`` are the members."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        m = len(sets)
        bits = np.zeros((m, BITS // 8), np.uint8)
        for i, s in enumerate(sets):
            b = np.zeros(BITS, np.uint8)
            b[((s >> np.uint64(20)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
            bits[i] = np.packbits(b)
        size = np.array([len(s) for s in sets], np.int64)
        word = bits.view(np.uint64)
        slack = size - np.bitwise_count(word).sum(1).astype(np.int64)
        self.levels = [(word, size, size, slack)]
        while len(self.levels[-1][0]) > 1:
            w, lo, hi, sl = self.levels[-1]
            at = np.arange(0, len(w), FAN)
            self.levels.append((np.bitwise_or.reduceat(w, at), np.minimum.reduceat(lo, at),
                                np.maximum.reduceat(hi, at), np.maximum.reduceat(sl, at)))
        self.linked = Forest(m)
        self.same = [np.arange(m)] + [np.full(len(x[0]), -1) for x in self.levels[1:]]

    def _one_class(self, lev: int, i: int) -> int:
        """A member of node i if all its members are connected, else -1."""
        if lev == 0:
            return i
        known = self.same[lev][i]
        if known >= 0:
            return known
        root = None
        for c in range(i * FAN, min((i + 1) * FAN, len(self.levels[lev - 1][0]))):
            x = self._one_class(lev - 1, c)
            if x < 0:
                return -1
            x = self.linked.find(x)
            if root is None:
                root = x
            elif root != x:
                return -1
        self.same[lev][i] = root
        return root

    def _connected(self, lev: int, i: int, j: int) -> bool:
        x = self._one_class(lev, i)
        if x < 0:
            return False
        y = self._one_class(lev, j)
        return y >= 0 and self.linked.find(x) == self.linked.find(y)

    def links(self, threshold: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that join classes (a spanning forest of all links).  With
        ``side`` (0/1 per member) pairs on one side are left to other blocks."""
        out: list[tuple[int, int]] = []
        top = len(self.levels) - 1
        stack = [(top, 0, 0)]
        while stack:
            lev, i, j = stack.pop()
            if lev == 0:
                if i != j and (side is None or side[i] != side[j]) and self.linked.find(i) != self.linked.find(j):
                    a, b = self.sets[i], self.sets[j]
                    if len(a) > len(b):
                        a, b = b, a
                    at = np.searchsorted(b, a)
                    at[at == len(b)] = len(b) - 1
                    if np.count_nonzero(b[at] == a) >= need(len(a), len(b), threshold):
                        self.linked.join(i, j)
                        out.append((i, j))
                continue
            if self._connected(lev, i, j):
                continue
            w, lo, hi, sl = self.levels[lev - 1]
            ci = np.arange(i * FAN, min((i + 1) * FAN, len(w)))
            cj = ci if i == j else np.arange(j * FAN, min((j + 1) * FAN, len(w)))
            over = np.bitwise_count(w[ci][:, None] & w[cj][None]).sum(2).astype(np.int64)
            over += np.minimum(sl[ci][:, None], sl[cj][None])
            over = np.minimum(over, np.minimum(hi[ci][:, None], hi[cj][None]))
            low = np.maximum(lo[ci][:, None], lo[cj][None])  # the larger set has at least this size
            ok = (over >= need(lo[ci][:, None], lo[cj][None], threshold)) \
                & (100 * np.minimum(hi[ci][:, None], hi[cj][None]) >= threshold * low)
            if i == j:
                ok &= ci[:, None] <= cj[None]
            x, y = np.nonzero(ok)
            # pairs near the diagonal come off the stack first: they connect neighbours
            for q in np.argsort(-(np.abs(ci[x] - cj[y])), kind="stable"):
                stack.append((lev - 1, int(ci[x[q]]), int(cj[y[q]])))
        return out


def _block_links(batches, threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: (block, cell, node, set) -> (member, smallest
    member of its class in the block); one block is held at a time."""
    key, rows = None, []

    def solve():
        uniq = {}
        for cell, node, s in rows:
            uniq[(cell, node)] = s
        items = sorted(uniq.items(), key=lambda r: (len(r[1]).bit_length(), int(r[1][0]), int(r[1][-1]), r[0]))
        if len(items) < 2:
            return None
        cells = [c for (c, _), _ in items]
        two = len(set(cells)) > 1
        tree = SignatureTree([s for _, s in items])
        if not tree.links(threshold, np.array([c == cells[0] for c in cells]) if two else None):
            return None
        # each class as a star: its members with its smallest node
        head: dict[int, int] = {}
        for i, ((_, node), _) in enumerate(items):
            root = tree.linked.find(i)
            head[root] = min(head.get(root, node), node)
        stars = [(node, head[tree.linked.find(i)]) for i, ((_, node), _) in enumerate(items)]
        a, b = zip(*[e for e in stars if e[0] != e[1]])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for b in batches:
        sets = b.column(3)
        flat = sets.values.to_numpy().view(np.uint64)
        offs = sets.offsets.to_numpy()
        for r, (blk, cell, node) in enumerate(zip(*(b.column(i).to_pylist() for i in (0, 1, 2)))):
            if blk != key:
                if rows and (out := solve()) is not None:
                    yield out
                key, rows = blk, []
            rows.append((cell, node, flat[offs[r]:offs[r + 1]].copy()))
    if rows and (out := solve()) is not None:
        yield out


def _member_sets(batches, k: int) -> Iterator[pa.RecordBatch]:
    """(node, comp, heavy, text) -> (comp, heavy, node, set); a text that does
    not have its node's set (a repeated doc_id) is left out."""
    for b in batches:
        nodes = b.column(0).to_pylist()
        raw, offs = W.text_bytes(b.column(3))
        keep, sets = [], []
        for i, j in W.chunks(offs):
            o = offs[i:j + 1]
            for d, t in enumerate(text_sets(raw[o[0]:o[-1]], o - o[0], k)):
                if len(t) and node_id(t) == nodes[i + d]:
                    keep.append(i + d)
                    sets.append(t)
        if keep:
            col = pa.ListArray.from_arrays(np.cumsum([0] + [len(s) for s in sets]).astype(np.int32),
                                           pa.array(np.concatenate(sets).view(np.int64)))
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(1).take(at), b.column(2).take(at), b.column(0).take(at), col],
                                             names=["comp", "heavy", "node", "tokens"])


def _solved(blocks: DataFrame, threshold: int) -> DataFrame:
    """(block, cell, node, tokens) -> links (a, b)."""
    return blocks.repartition(n_parts(blocks.sparkSession), "block").sortWithinPartitions("block") \
        .select("block", "cell", "node", "tokens").mapInArrow(lambda it: _block_links(it, threshold), "a long, b long")


def _in_cells(members: DataFrame, by: list[str], salt: int) -> DataFrame:
    """members (comp, node, tokens, ...) + cell: for each value of ``by`` as
    many as its weight asks for, members dealt out by a hash."""
    weight = members.groupBy(*by).agg(F.sum(F.size("tokens")).alias("w"))
    counts = weight.select(*[F.col(c).alias(f"_{c}") for c in by], F.ceil(F.col("w") / CELL_WEIGHT).cast("int").alias("_k"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    part = F.pmod(F.xxhash64("node", F.lit(salt)), F.col("_k"))
    return members.join(counts, same).withColumn("cell", F.xxhash64(*by, part)).drop("_k", *[f"_{c}" for c in by])


def _heavy_links(heavy: DataFrame, threshold: int) -> DataFrame:
    """Links of the groups that do not fit in one block."""
    # linked sets differ at most 100 / threshold times in size: they are in one band or in neighbours
    band = F.floor(F.log(F.size("tokens").cast("double")) / math.log(1.005 * 100 / threshold)).cast("int")
    heavy = heavy.withColumn("band", band)
    alone = F.concat_ws("/", "comp", "cell").alias("block")
    first = materialise(_solved(_in_cells(heavy, ["comp", "band"], 1).select(alone, "cell", "node", "tokens"), threshold), "links")
    # cells are disjoint, so a member is in one star: those that are not its centre are done with
    one = first.select(F.col("a").alias("node"), F.col("b").alias("h1"))
    heads = heavy.join(one, "node", "left_anti")
    second = materialise(_solved(_in_cells(heads, ["comp"], 2).select(alone, "cell", "node", "tokens"), threshold), "links")
    links = first.unionByName(second)
    two = second.select(F.col("a").alias("h1"), F.col("b").alias("h2"))
    classed = heavy.join(one, "node", "left").withColumn("h1", F.coalesce("h1", "node")) \
        .join(two, "h1", "left").withColumn("cls", F.coalesce("h2", "h1")).drop("h1", "h2")
    large = classed.groupBy("cls").agg(F.sum(F.size("tokens")).alias("w")).where(F.col("w") >= CELL_WEIGHT / 2) \
        .select("cls", F.col("cls").alias("pure"))
    cells = materialise(_in_cells(classed.join(large, "cls", "left").drop("cls"), ["comp", "pure", "band"], 3), "cells")
    a = cells.select("comp", F.col("cell").alias("x"), F.col("pure").alias("pure_x"), F.col("band").alias("band_x")).distinct() \
        .withColumn("near", F.explode(F.expr("array(band_x - 1, band_x, band_x + 1)")))
    b = cells.select("comp", F.col("cell").alias("y"), F.col("pure").alias("pure_y"), F.col("band").alias("near")).distinct()
    # sizes further than a band apart cannot link; one class has nothing left to join
    pairs = a.join(b, ["comp", "near"]).where("x <= y and not coalesce(pure_x = pure_y, false)") \
        .select("comp", "x", "y", F.concat_ws("/", "comp", "x", "y").alias("block")).distinct()
    ends = pairs.select("comp", F.col("x").alias("cell"), "block").unionByName(
        pairs.where("x != y").select("comp", F.col("y").alias("cell"), "block"))
    third = _solved(cells.join(ends, ["comp", "cell"]).select("block", "cell", "node", "tokens"), threshold)
    return links.unionByName(third)


def _hashed(text):
    return F.xxhash64(F.col(text).cast("string"))


def _classes(docs: DataFrame, k: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> rows (doc_id, node, n, hash), one for each input
    row, and sets (node, component, head, first): ``head`` is one node of the
    class, the same for all of them, ``first`` the smallest (doc_id, hash) of
    the node's rows."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = n_parts(spark)
    slices = SLICES * parts
    posts = docs.withColumn("hash", _hashed("text")).mapInArrow(lambda it: _postings(it, k, slices), _POST_DDL)
    shared = posts.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(_shared, _POST_DDL)
    sig = materialise(
        shared.repartition(parts, "block").sortWithinPartitions("block")
        .mapInArrow(lambda it: _prefixes(it, threshold), "kind int, a long, b long, n long, place long, hash long"),
        "signatures", "kind")
    rows = sig.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("node"), "n", "place", "hash")
    by_token = sig.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("node")) \
        .repartition(parts, "token").sortWithinPartitions("token", "node").mapInArrow(_token_edges, "a long, b long")
    stars = sig.where("kind = 2").select("a", "b").unionByName(by_token).distinct()
    place = rows.where("place is not null").select("place", "node")
    near = components(stars.join(place.toDF("a", "x"), "a").join(place.toDF("b", "y"), "b").select(
        F.col("x").alias("a"), F.col("y").alias("b")))
    reps = rows.where("node is not null and doc_id is not null").groupBy("node").agg(
        F.min(F.struct("doc_id", "hash")).alias("first"), F.max("n").alias("n")).withColumn("rep", F.col("first.doc_id"))
    members = materialise(near.join(reps, "node"), "members")
    weight = members.groupBy("comp").agg(F.sum("n").alias("w")).where(F.col("w") > 2 * CELL_WEIGHT).select(F.col("comp").alias("_c"))
    members_of = members.join(weight, F.col("comp") == F.col("_c"), "left").withColumn("heavy", F.col("_c").isNotNull())
    # only texts whose id falls in a member's cell of a fixed-size filter are shuffled
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(GATE))
    gate = members.select(F.col("rep").alias("doc_id")).select(cell.alias("cell")).distinct()
    again = docs.withColumn("cell", cell).join(F.broadcast(gate), "cell", "left_semi").drop("cell")
    held = members_of.join(again, members["rep"] == again["doc_id"]).select("node", "comp", "heavy", "text")
    sets = held.mapInArrow(lambda it: _member_sets(it, k), "comp long, heavy boolean, node long, tokens array<long>")
    any_heavy = not weight.isEmpty()
    if any_heavy:
        sets = materialise(sets, "sets", "heavy")
    links = _solved(sets.where("not heavy").select(
        F.concat_ws("/", "comp").alias("block"), F.lit(0).cast("long").alias("cell"), "node", "tokens"), threshold)
    if any_heavy:
        links = links.unionByName(_heavy_links(sets.where("heavy").select("comp", "node", "tokens"), threshold))
    found = components(links)
    named = found.join(reps.select("node", "rep"), "node")
    label = named.groupBy("comp").agg(F.min(F.struct("rep", "node")).alias("least"))
    linked = named.join(label, "comp").select("node", "least")
    info = materialise(reps.join(linked, "node", "left").select(
        "node", F.coalesce("least.rep", "rep").alias("component"), F.coalesce("least.node", "node").alias("head"), "first"),
        "classes")
    discard(near, found, members)
    return rows, info

def jaccard_classes(docs: DataFrame, k: int = 5, threshold: int = 75) -> DataFrame:
    """docs(doc_id long, text) -> (doc_id, n_shingles, component_id), one row
    per input row.

    Words are runs of characters other than space and \\x09-\\x0D, with A-Z
    lower-cased.  Null and empty texts, and texts without words, have no
    shingles and link with nothing (their component is their own doc_id).
    A text with fewer than k words has its whole sequence as one shingle.
    A null doc_id takes no part in links; its component is null.  Rows that
    repeat a doc_id with different texts are separate members that share
    their id.  Equal shingle sets are always linked.  ``docs`` must give the
    same rows in the same order when a task is repeated (a table does).
    """
    rows, info = _classes(docs, k, threshold)
    return rows.join(info.select("node", "component"), "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the whole ``documents`` table, 5 words, similarity 0.75."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of near copies one row stays, that with
    the smallest doc_id (then the smallest set id and text hash).  Classes are
    of texts: rows that repeat a doc_id with unlike texts are judged each by
    its own class.  Texts without words stay, each once, where no text with
    words stays under their doc_id; rows without a doc_id stay."""
    rows, info = _classes(docs, 5, 75)
    heads = info.where("node = head").select("first.doc_id", "first.hash")
    wordless = rows.where("node is null and doc_id is not null").select("doc_id", "hash").distinct() \
        .join(heads.select("doc_id"), "doc_id", "left_anti")
    keep = heads.unionByName(wordless).toDF("_keep", "_hash")
    cols, names = aside(docs)
    whole = docs.select(F.col("doc_id").cast("long").alias("_id"), _hashed("text").alias("_text"), *cols)
    first = F.row_number().over(Window.partitionBy("_keep", "_hash").orderBy("_hash"))
    stay = whole.join(keep, (F.col("_id") == F.col("_keep")) & (F.col("_text") == F.col("_hash"))) \
        .withColumn("_first", first).where("_first = 1")
    out = stay.select(*names).unionByName(whole.where("_id is null").select(*names))
    return out.select(*[F.col(n).alias(c) for n, c in names.items()])
