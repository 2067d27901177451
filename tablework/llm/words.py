"""Vectorised word splitting and hashing over Arrow string batches (numpy).

A batch's texts are scanned as one UTF-8 byte array; words are maximal runs
of non-separator bytes inside one text.  A word's 64-bit hash is a polynomial
over its bytes, taken from one running sum, then mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21  # bytes scanned at a time; a longer single text is its own chunk

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = np.full(max(n, CHUNK + 1), _P if kind == "p" else _PINV, np.uint64)
        base[0] = 1
        have = _powers[kind] = np.cumprod(base)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_table(separators: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is word byte, code of byte); A-Z share the code of a-z with ``lower``."""
    word = np.ones(256, bool)
    word[list(separators)] = False
    code = _BYTE_CODE.copy()
    if lower:
        code[65:91] = code[97:123]
    return word, code


#: separators of the shingle words: space and \x09-\x0D
WHITESPACE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: every ASCII character that is neither a letter nor a digit separates
ALNUM = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty texts."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    if len(arr) == 0 or offs is None:
        return np.empty(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[o[0]:o[-1]], o - o[0]


def chunks(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of at most ``size`` bytes (one text at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def split_words(raw: np.ndarray, offs: np.ndarray, table=WHITESPACE, heads: tuple[int, ...] = ()):
    """(start, end, hash, first word of each text as an offset array).  With
    ``heads`` the hash is a list: of the words, then of their first k bytes
    for each k (of the whole word where it is not longer, as another value)."""
    word, code = table
    n = len(raw)
    if n == 0:
        e, none = np.empty(0, np.int64), np.empty(0, np.uint64)
        return e, e, [none] * (1 + len(heads)) if heads else none, np.zeros(len(offs), np.int64)
    mask = word[raw]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True  # a text's first byte starts a word, and ends the one before
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    start = np.flatnonzero(mask & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    end = np.flatnonzero(mask & (~after | edge[1:])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(code[raw] * _power("p", n), out=total[1:])
    back = _power("q", n)[start]
    base = total[start]

    def hashed(stop, salt):
        return mix((total[stop] - base) * back + (stop - start + salt).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    h = hashed(end, 0)
    if heads:
        h = [h] + [hashed(np.minimum(start + k, end), 1000 * k) for k in heads]
    return start, end, h, np.searchsorted(start, offs)


def shingle_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-word shingle hashes of each text, in order, and their offsets per text.
    A text of 1..k-1 words has its whole sequence as one shingle."""
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=out_first[1:])
    if out_first[-1] == 0:
        return np.empty(0, np.uint64), out_first
    doc = np.repeat(np.arange(len(n)), counts)
    pos = first[doc] + np.arange(out_first[-1]) - out_first[doc]
    width = np.minimum(n, k)[doc]
    acc = width.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    last = len(h) - 1
    for i in range(k):
        take = h[np.minimum(pos + i, last)]
        nxt = mix(acc * _P + take)
        acc = nxt if (width > i).all() else np.where(width > i, nxt, acc)
    return acc, out_first
