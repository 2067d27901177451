"""The vocabulary of a SentencePiece BPE model, and its merges on arrays.

Only pieces, scores and kinds are read from the model file (on the driver;
they are sent to the tasks: the vocabulary bounds their size).  Segmentation
is done here, not by the library.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tablework.llm import words as W

SPACE = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """pieces by id; ``byte0`` is the id of <0x00>; normal pieces are all ids
    that are neither unknown, control, unused nor bytes."""
    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    byte0: int

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        return cls([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids],
                   [not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i)) for i in ids],
                   next((i for i in ids if sp.is_byte(i)), -1))


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts laid end to end, each with the leading space
    mark the model adds (empty texts have none); and their offsets."""
    marked = [SPACE + t if t else "" for t in texts]
    edge = np.cumsum([0] + [len(t) for t in marked])
    c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c == 32, ord(SPACE), c).astype(np.int64), edge


class Table:
    """Open-addressing table on arrays: non-negative int64 keys -> int64."""

    def __init__(self, keys: np.ndarray, values: np.ndarray | None = None):
        self.size, self.used = 1 << 10, 0
        self._clear()
        self.add(keys, np.arange(len(keys)) if values is None else values)

    def _clear(self) -> None:
        self.keys = np.full(self.size, -1, np.int64)
        self.values = np.full(self.size, -1, np.int64)

    def _slot(self, q: np.ndarray) -> np.ndarray:
        return (W.mix(q.astype(np.uint64)) & np.uint64(self.size - 1)).astype(np.int64)

    def find(self, q: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is absent."""
        slot = self._slot(q)
        held = self.keys[slot]
        out = np.where(held == q, self.values[slot], -1)
        todo = np.flatnonzero((held != q) & (held >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (self.size - 1)
            held = self.keys[slot]
            hit = held == q[todo]
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (held >= 0)
            todo, slot = todo[go], slot[go]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not in the table."""
        self.used += len(keys)
        if 2 * self.used > self.size:
            old = self.keys >= 0
            keys, values = np.r_[self.keys[old], keys], np.r_[self.values[old], values]
            while 2 * self.used > self.size:
                self.size *= 2
            self._clear()
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], (slot[~mine] + 1) & (self.size - 1)


class Merges:
    """Symbols are 0..C-1: single characters of the vocabulary's pieces (the
    last, C-1, stands for any other character), then C + i: multi-character
    piece i (``text``)."""

    def __init__(self, v: Vocabulary):
        self.vocabulary = v
        normal = [i for i, ok in enumerate(v.normal) if ok]
        chars = sorted({ch for i in normal for ch in v.pieces[i]})
        self.char_id = np.full(0x110000, len(chars), np.int32)
        for k, ch in enumerate(chars):
            self.char_id[ord(ch)] = k
        self.chars, self.C = chars, len(chars) + 1
        multi = [i for i in normal if len(v.pieces[i]) > 1]
        self.text = [v.pieces[i] for i in multi]
        self.S = self.C + len(self.text)
        self.score = np.array([v.scores[i] for i in multi])
        single = {v.pieces[i]: i for i in normal if len(v.pieces[i]) == 1}
        #: vocabulary id of a symbol, -1 for characters that become bytes
        self.id = np.array([single.get(ch, -1) for ch in chars] + [-1] + multi)
        #: tokens a symbol stands for (bytes where it is no piece); the unknown character's is by its own bytes
        self.weight = np.ones(self.S, np.int64)
        for k, ch in enumerate(chars):
            if ch not in single:
                self.weight[k] = len(ch.encode("utf-8"))
        sym = {ch: k for k, ch in enumerate(chars)} | {t: self.C + k for k, t in enumerate(self.text)}
        self.symbol = sym
        pairs, made = [], []
        inner = set()
        for k, t in enumerate(self.text):
            for j in range(1, len(t)):
                a, b = sym.get(t[:j]), sym.get(t[j:])
                if a is not None and b is not None:
                    pairs.append(a * self.S + b)
                    made.append(self.C + k)
                inner.add((sym[t[j - 1]], sym[t[j]]))
        self.pair = Table(np.array(pairs, np.int64))
        self.made = np.array(made, np.int64)
        #: whether two characters stand next to each other in some piece; if not, no merge crosses
        self.bond = np.zeros((self.C, self.C), bool)
        if inner:
            x, y = zip(*inner)
            self.bond[list(x), list(y)] = True

    def merge(self, sym: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of symbols (n[i] used in row i) merged to the end: the best
        scored pair first, the leftmost of equals.  (symbols, lengths)"""
        sym, n = sym.copy(), n.copy()
        live = np.flatnonzero(n > 1)
        while len(live):
            s = sym[live]
            width = int(n[live].max())
            s = s[:, :width]
            got = self.pair.find((s[:, :-1] * self.S + s[:, 1:]).ravel()).reshape(len(live), width - 1)
            got[np.arange(1, width)[None] >= n[live][:, None]] = -1
            score = np.where(got >= 0, self.score[self.made[np.maximum(got, 0)] - self.C], -np.inf)
            at = score.argmax(1)
            row = np.arange(len(live))
            some = got[row, at] >= 0
            live, at, s, got = live[some], at[some], s[some], got[row, at][some]
            if not len(live):
                break
            s[np.arange(len(live)), at] = self.made[got]
            shift = np.arange(width)[None] + (np.arange(width)[None] > at[:, None])
            sym[live, :width] = np.take_along_axis(s, np.minimum(shift, width - 1), 1)
            n[live] -= 1
            live = live[n[live] > 1]
        return sym, n
