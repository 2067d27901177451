"""Character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)   # outside, then begin / inside of each kind
HIDDEN = 16

# Characters with a class of their own.  Other ASCII letters
# share one class for each case, other characters one class; 0 is padding.
OWN = "atdo@.-+() \n\t_%:,=\"/[]{}<>;'#&"
_CLASS = np.full(129, len(OWN) + 5, np.int64)
for _c in range(128):
    ch = chr(_c)
    if ch in OWN:
        _CLASS[_c] = 1 + OWN.index(ch)
    elif ch.isdigit():
        _CLASS[_c] = len(OWN) + 1
    elif ch.islower():
        _CLASS[_c] = len(OWN) + 2
    elif ch.isupper():
        _CLASS[_c] = len(OWN) + 3
_CLASS[128] = len(OWN) + 4
CLASSES = len(OWN) + 6


def classes(text: str, width: int) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(width, np.int64)
    out[:len(c)] = _CLASS[np.minimum(c, 128)]
    return out


def tags_of(spans: list[tuple[int, int, int]], width: int) -> np.ndarray:
    """(kind index, start, end) spans of a window -> its tags; where spans
    overlap the first listed stays."""
    out = np.zeros(width, np.int64)
    for k, s, e in spans:
        if s < e and not out[s:e].any():
            out[s] = 1 + 2 * k
            out[s + 1:e] = 2 + 2 * k
    return out


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    out, kind, start = [], -1, 0
    for i, t in enumerate([*tags.tolist(), 0]):
        k = (t - 1) // 2 if t else -1
        if kind >= 0 and (k != kind or t % 2 == 1):
            out.append((kind, start, i))
            kind = -1
        if k >= 0 and kind < 0:
            kind, start = k, i
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _logsum(x, axis):
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


class Tagger:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        H, s = HIDDEN, 0.25
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, s, (CLASSES, 4 * H))
            self.p["h" + d] = rng.normal(0, s, (H, 4 * H))
            b = np.zeros(4 * H)
            b[H:2 * H] = 1.0  # forget gate open at first
            self.p["b" + d] = b
        self.p["o"] = rng.normal(0, s, (2 * H, TAGS))
        self.p["ob"] = np.zeros(TAGS)
        self.p["t"] = np.zeros((TAGS, TAGS))
        self.p["s"] = np.zeros(TAGS)

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """x (batch, length) in reading order -> hidden (length, batch, H), trace."""
        H, (B, L) = HIDDEN, x.shape
        wx, wh, b = self.p["x" + d], self.p["h" + d], self.p["b" + d]
        h, c = np.zeros((B, H)), np.zeros((B, H))
        out, trace = np.empty((L, B, H)), []
        for t in range(L):
            z = wx[x[:, t]] + h @ wh + b
            i, f, o, g = _sigmoid(z[:, :H]), _sigmoid(z[:, H:2 * H]), _sigmoid(z[:, 2 * H:3 * H]), np.tanh(z[:, 3 * H:])
            c0, h0 = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                trace.append((i, f, o, g, c0, h0, tc))
        return out, trace

    def scores(self, x: np.ndarray, keep: bool = False):
        """Emission scores (length, batch, TAGS) of windows of classes."""
        f, tf = self._lstm(x, "f", keep)
        b, tb = self._lstm(x[:, ::-1], "b", keep)
        both = np.concatenate([f, b[::-1]], 2)
        return both @ self.p["o"] + self.p["ob"], both, tf, tb

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags (batch, length) by Viterbi over the CRF transitions.  A
        kind's inside tag only follows its own begin or inside tag."""
        e, *_ = self.scores(x)
        L, B, _ = e.shape
        trans, start = self.p["t"].copy(), self.p["s"].copy()
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            start[inside] = -1e9
            trans[[a for a in range(TAGS) if a not in (inside, inside - 1)], inside] = -1e9
        v = start + e[0]
        back = np.empty((L, B, TAGS), np.int8)
        for t in range(1, L):
            w = v[:, :, None] + trans
            back[t] = w.argmax(1)
            v = w.max(1) + e[t]
        out = np.empty((B, L), np.int64)
        out[:, -1] = v.argmax(1)
        rows = np.arange(B)
        for t in range(L - 1, 0, -1):
            out[:, t - 1] = back[t, rows, out[:, t]]
        return out

    def _grads(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of tags y (batch, length), gradients."""
        p, H = self.p, HIDDEN
        e, both, tf, tb = self.scores(x, True)
        L, B, _ = e.shape
        y = y.T
        rows = np.arange(B)
        alpha = np.empty_like(e)
        alpha[0] = p["s"] + e[0]
        for t in range(1, L):
            alpha[t] = _logsum(alpha[t - 1][:, :, None] + p["t"], 1) + e[t]
        beta = np.zeros_like(e)
        for t in range(L - 2, -1, -1):
            beta[t] = _logsum(p["t"][None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        logz = _logsum(alpha[-1], 1)
        gold = p["s"][y[0]] + e[0, rows, y[0]]
        for t in range(1, L):
            gold = gold + p["t"][y[t - 1], y[t]] + e[t, rows, y[t]]
        de = np.exp(alpha + beta - logz[None, :, None])
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["s"] = de[0].sum(0) - np.bincount(y[0], minlength=TAGS)
        for t in range(1, L):
            both_t = np.exp(alpha[t - 1][:, :, None] + p["t"] + (e[t] + beta[t] - logz[:, None])[:, None, :])
            g["t"] += both_t.sum(0)
            np.add.at(g["t"], (y[t - 1], y[t]), -1)
        for t in range(L):
            de[t, rows, y[t]] -= 1
        g["ob"] = de.sum((0, 1))
        g["o"] = np.einsum("lbh,lbt->ht", both, de)
        dh = de @ p["o"].T
        self._back(x, "f", dh[:, :, :H], tf, g)
        self._back(x[:, ::-1], "b", dh[::-1, :, H:], tb, g)
        return float((logz - gold).mean()), {k: v / B for k, v in g.items()}

    def _back(self, x, d, dh_out, trace, g):
        H, B = HIDDEN, x.shape[0]
        dh, dc = np.zeros((B, H)), np.zeros((B, H))
        for t in range(len(trace) - 1, -1, -1):
            i, f, o, gg, c0, h0, tc = trace[t]
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], 1)
            np.add.at(g["x" + d], x[:, t], dz)
            g["h" + d] += h0.T @ dz
            g["b" + d] += dz.sum(0)
            dh = dz @ self.p["h" + d].T
            dc = dc * f

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 160, batch: int = 64, rate: float = 0.02, seed: int = 2) -> float:
        """Adam over random batches; the last loss."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss = float("nan")
        for step in range(1, steps + 1):
            at = rng.integers(0, len(x), min(batch, len(x)))
            loss, g = self._grads(x[at], y[at])
            size = np.sqrt(sum((v * v).sum() for v in g.values()))
            lr = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k in self.p:
                v = g[k] * min(1.0, 5.0 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * v
                q[k] = 0.99 * q[k] + 0.01 * v * v
                self.p[k] -= lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(q[k] / (1 - 0.99 ** step)) + 1e-8)
        return loss
