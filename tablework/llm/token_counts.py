"""Token counts by a compiled finite-state tokenizer (operator 5).

The BPE vocabulary is compiled into a deterministic transducer over
characters.  Its state is the longest suffix read that begins some piece
(an Aho-Corasick node) together with the tokens that end at the last
``reach`` places; a transition fixes the token that ends at the new place
and is annotated with the tokens emitted so far.  Which token that is
depends only on the state: the longest piece ending here that may follow
the token ending where it starts.  "May follow" (two pieces merge to just
themselves) is the compiled table; it is filled on demand and kept.

Texts are cut where no piece has the two neighbouring characters side by
side - no merge crosses such a place, so the transducer is in its start
state there.  Equal stretches are counted once.  A stretch longer than
``CHUNK`` is run as chunks in parallel, each entered ``WARM`` characters
early; a chunk's state map holds where its entry state equals the exit
state of the chunk before, which the scan over the chunks checks, and a
chunk for which it does not is run again from the true state.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm import words as W
from tablework.llm.pieces import Merges, Table, Vocabulary, codes_of
from tablework.llm.store import prepare, table

CHUNK = 256            # characters of a long stretch run by one lane
WARM = 64              # characters a chunk is entered early
LANES = 1 << 21        # characters run side by side
KEPT = 500_000         # stretches whose counts a worker remembers
TEXT_CHARS = 1 << 21   # characters of texts handled at a time


class Transducer:
    def __init__(self, v: Vocabulary):
        m = self.m = Merges(v)
        C, S = m.C, m.S
        # trie of the pieces; node 0 is the root, every character is a child
        child: dict[int, int] = {}
        depth, node_sym = [0], [-1]
        for name, sym in sorted(m.symbol.items(), key=lambda x: len(x[0])):
            at = 0
            for ch in name:
                key = at * C + m.symbol[ch]
                nxt = child.get(key)
                if nxt is None:
                    nxt = child[key] = len(depth)
                    depth.append(depth[at] + 1)
                    node_sym.append(-1)
                at = nxt
            node_sym[at] = sym
        child[C - 1] = len(depth)  # any character of no piece
        depth.append(1)
        node_sym.append(C - 1)
        self.goto = Table(np.fromiter(child.keys(), np.int64))
        self.target = np.fromiter(child.values(), np.int64)
        n = len(depth)
        fail = np.zeros(n, np.int64)
        longest = np.array(node_sym, np.int64)   # longest symbol ending at a node
        shorter = np.full(S, -1, np.int64)       # next shorter symbol ending where a symbol ends
        length = self.length = np.ones(S, np.int64)
        for name, sym in m.symbol.items():
            length[sym] = len(name)
        self.reach = int(length.max())
        by_depth: list[list[tuple[int, int, int]]] = [[] for _ in range(self.reach + 1)]
        for key, to in child.items():
            by_depth[depth[to]].append((key // C, key % C, to))
        for level in by_depth[2:]:
            for at, c, to in level:
                f = fail[at]
                while f and f * C + c not in child:
                    f = fail[f]
                fail[to] = child.get(f * C + c, 0)
        for level in by_depth[1:]:
            for _, _, to in level:
                below = longest[fail[to]] if fail[to] else -1
                if longest[to] < 0:
                    longest[to] = below
                else:
                    shorter[longest[to]] = below
        self.fail, self.longest, self.shorter = fail, longest, shorter
        # a piece that its own characters do not merge to is never a token
        sym, size = m.merge(*self._spell(np.arange(S)))
        self.real = (size == 1) & (sym[:, 0] == np.arange(S))
        self.known = Table(np.empty(0, np.int64))   # pair of tokens -> may follow
        self.counts: dict[int, int] = {}            # stretch -> its tokens

    def _spell(self, syms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "letters"):
            self.letters = np.zeros((self.m.S, self.reach), np.int64)
            for k in range(self.m.C):
                self.letters[k, 0] = k
            for name, sym in self.m.symbol.items():
                self.letters[sym, :len(name)] = [self.m.symbol[ch] for ch in name]
        return self.letters[syms], self.length[syms]

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token b may stand right after token a (-1: the start)."""
        key = (a + 1) * self.m.S + b
        at = self.known.find(key)
        new = np.unique(key[at < 0])
        if len(new):
            x, y = new // self.m.S - 1, new % self.m.S
            ok = self.real[y].copy()
            two = np.flatnonzero(ok & (x >= 0))
            if len(two):
                lx, nx = self._spell(x[two])
                ly, ny = self._spell(y[two])
                wide = np.zeros((len(two), 2 * self.reach), np.int64)
                wide[:, :self.reach] = lx
                rows = np.arange(len(two))[:, None]
                place = nx[:, None] + np.arange(self.reach)[None]
                wide[rows, place] = ly
                sym, size = self.m.merge(wide, nx + ny)
                ok[two] = (size == 2) & (sym[:, 0] == x[two]) & (sym[:, 1] == y[two])
            self.known.add(new, ok.astype(np.int64))
            at = self.known.find(key)
        return at == 1

    def step(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.zeros(len(node), np.int64)
        todo = np.arange(len(node))
        while len(todo):
            got = self.goto.find(node[todo] * self.m.C + c[todo])
            hit = got >= 0
            out[todo[hit]] = self.target[got[hit]]
            todo = todo[~hit]
            todo = todo[node[todo] > 0]
            node = node.copy()
            node[todo] = self.fail[node[todo]]
        return out

    def run(self, chars: np.ndarray, n: np.ndarray, seed=None) -> tuple[np.ndarray, np.ndarray]:
        """Lanes in lockstep.  chars: a row per lane, longest first, n used.
        Returns (last, count): for each place i (0..n) the token that ends
        there and the tokens up to it.  ``seed`` gives (last, count) of the
        first reach + 1 places instead of the start state."""
        lanes, width = chars.shape
        last = np.full((lanes, width + 1), -1, np.int64)
        count = np.zeros((lanes, width + 1), np.int64)
        node = np.zeros(lanes, np.int64)
        begin = 0
        if seed is not None:
            begin = self.reach
            last[:, :begin + 1], count[:, :begin + 1] = seed
        for i in range(width):
            live = int(np.searchsorted(-n, -i, side="left"))  # lanes with n > i
            if not live:
                break
            node[:live] = self.step(node[:live], chars[:live, i])
            if i < begin:
                continue
            tok = self.longest[node[:live]]
            todo = np.arange(live)
            while len(todo):
                t = tok[todo]
                if (t < 0).any():
                    raise ValueError("no token can end here: the vocabulary is not a BPE one")
                start = i + 1 - self.length[t]
                before = last[todo, np.maximum(start, 0)]
                fine = (start == 0) | ((start > 0) & (before >= 0))
                fine[fine] = self.follows(before[fine], t[fine])
                todo = todo[~fine]
                tok[todo] = self.shorter[tok[todo]]
            last[:live, i + 1] = tok
            count[:live, i + 1] = count[np.arange(live), i + 1 - self.length[tok]] + self.m.weight[tok]
        return last, count

    def long(self, chars: np.ndarray) -> int:
        """Count of one long stretch: chunks' state maps, composed by a scan."""
        n, r = len(chars), self.reach
        starts = np.arange(0, n, CHUNK)
        total, state = 0, None
        group = max(1, LANES // (CHUNK + WARM))
        for g in range(0, len(starts), group):
            at = starts[g:g + group]
            lo, hi = np.maximum(at - WARM, 0), np.minimum(at + CHUNK, n)
            order = np.argsort(lo - hi, kind="stable")
            size = hi - lo
            mat = chars[np.minimum(lo[order][:, None] + np.arange(size.max())[None], n - 1)]
            last, count = self.run(mat, size[order])
            row = np.argsort(order, kind="stable")
            for k, s in enumerate(at):
                w = int(s - lo[k])
                l, c = last[row[k], :size[k] + 1], count[row[k], :size[k] + 1]
                if s and not (np.array_equal(l[w - r:w + 1], state[0]) and np.array_equal(c[w - r:w + 1] - c[w], state[1])):
                    w = r
                    l, c = self.run(chars[None, s - r:hi[k]], np.array([hi[k] - s + r]), state)
                    l, c = l[0], c[0]
                total += int(c[-1] - c[w])
                state = l[-(r + 1):].copy(), c[-(r + 1):] - c[-1]
        return total

    def stretches(self, c: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, starts of stretches) of texts laid end to end."""
        sym = self.m.char_id[c].astype(np.int64)
        cut = np.ones(len(c), bool)
        cut[1:] = ~self.m.bond[sym[:-1], sym[1:]]
        cut[edge[:-1][edge[:-1] < len(c)]] = True
        return sym, np.flatnonzero(cut)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        c, edge = codes_of(texts)
        if not len(c):
            return np.zeros(len(texts), np.int64)
        sym, start = self.stretches(c, edge)
        size = np.diff(np.r_[start, len(c)])
        total = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(W.mix(c.astype(np.uint64) + np.uint64(1)) * W._power("p", len(c)), out=total[1:])
        h = W.mix((total[start + size] - total[start]) * W._power("q", len(c))[start] + size.astype(np.uint64))
        alone = size == 1
        n = np.empty(len(start), np.int64)
        x = c[start[alone]]
        n[alone] = np.where(sym[start[alone]] == self.m.C - 1, 1 + (x > 0x7F) + (x > 0x7FF) + (x > 0xFFFF),
                            self.m.weight[sym[start[alone]]])
        rest = np.flatnonzero(~alone)
        uniq, first, which = np.unique(h[rest], return_index=True, return_inverse=True)
        got = np.array([self.counts.get(k, -1) for k in uniq.tolist()], np.int64)
        new = np.flatnonzero(got < 0)
        if len(new):
            at = rest[first[new]]
            got[new] = self._counted(sym, start[at], size[at])
            if len(self.counts) + len(new) > KEPT:
                self.counts.clear()
            self.counts.update(zip(uniq[new].tolist(), got[new].tolist()))
        n[rest] = got[which]
        sums = np.r_[0, np.cumsum(n)]
        at = np.searchsorted(start, edge)
        return sums[at[1:]] - sums[at[:-1]]

    def _counted(self, sym: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.int64)
        order = np.argsort(-size, kind="stable")
        k = 0
        while k < len(order) and size[order[k]] > CHUNK:
            s = start[order[k]]
            out[order[k]] = self.long(sym[s:s + size[order[k]]])
            k += 1
        while k < len(order):
            wide = int(size[order[k]])
            take = order[k:k + max(1, LANES // wide)]
            mat = sym[np.minimum(start[take][:, None] + np.arange(wide)[None], len(sym) - 1)]
            _, count = self.run(mat, size[take])
            out[take] = count[np.arange(len(take)), size[take]]
            k += len(take)
        return out


_compiled: dict[int, Transducer] = {}


def compiled(held) -> Transducer:
    """The transducer of a broadcast vocabulary, kept by the Python worker."""
    if held.id not in _compiled:
        _compiled.clear()
        _compiled[held.id] = Transducer(held.value)
    return _compiled[held.id]


class Held:
    """A broadcast vocabulary under a key that workers keep things by."""

    def __init__(self, spark: SparkSession, v: Vocabulary):
        self.id = hash((tuple(v.pieces), tuple(v.scores)))
        self.broadcast = spark.sparkContext.broadcast(v)

    @property
    def value(self) -> Vocabulary:
        return self.broadcast.value


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_tokens, over_limit), one row
    per row.  Null and empty texts have 0 bytes and 0 tokens; ids may be null
    or repeated.  Tokens are as a SentencePiece BPE model without
    normalisation, with a leading space mark and bytes for unknown
    characters; special strings are ordinary text."""
    spark = docs.sparkSession
    prepare(spark)
    held = Held(spark, Vocabulary.load(model_path))

    def run(batches):
        t = compiled(held)
        for b in batches:
            _, offs = W.text_bytes(b.column(1))
            texts = [x or "" for x in b.column(1).to_pylist()]
            parts = [t.count(texts[i:j]) for i, j in W.chunks(offs, TEXT_CHARS)]
            n = np.concatenate(parts) if parts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offs)), pa.array(n)],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    """op5: every whole text of ``documents``."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(model))
