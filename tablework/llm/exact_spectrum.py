"""Spectrum of an integer symmetric matrix through its exact characteristic
polynomial: plain numbers, no Spark.

``charpoly_mod``   polynomial modulo a prime, by Hessenberg reduction
``combine``        the integer coefficients, by Chinese remaindering
``largest_roots``  the largest roots to a chosen number of binary places
``eigenvectors``   null-space inverse iteration in decimal arithmetic

All roots of a symmetric matrix's polynomial are real, so the sign changes in
the coefficients of p(x + a) count its roots above a exactly (Descartes' rule
is sharp then).  That count isolates the roots.
"""

from __future__ import annotations

import decimal
import math

import numpy as np


def primes_below(limit: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``limit`` (at most 2^31)."""
    out, n = [], limit - 1 - limit % 2
    while len(out) < count:
        if _is_prime(n):
            out.append(n)
        n -= 2
    return out


def _is_prime(n: int) -> bool:
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):  # enough below 3.2e9
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def coefficient_bound(d: int, trace: int) -> int:
    """No coefficient of the polynomial of a positive semidefinite matrix is
    larger: e_k <= C(d, k) * (trace / d)^k."""
    return max(math.comb(d, k) * (trace ** k // d ** k + 1) for k in range(d + 1))


def charpoly_mod(m: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - m) modulo the prime p < 2^31, highest first."""
    h = np.array(m % p, np.int64)
    d = len(h)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        i = k + int(below[0])
        if i != k:
            h[[i, k]] = h[[k, i]]
            h[:, [i, k]] = h[:, [k, i]]
        u = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1:] = (h[k + 1:] - u[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1:] * u % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)  # of the leading blocks, lowest power first
    polys[0, 0] = 1
    for k in range(1, d + 1):
        nxt = np.zeros(d + 1, np.int64)
        nxt[1:] = polys[k - 1, :-1]
        nxt = (nxt - h[k - 1, k - 1] * polys[k - 1] % p) % p
        factors, prod = [], 1
        for i in range(k - 2, -1, -1):
            prod = prod * int(h[i + 1, i]) % p
            factors.append(prod * int(h[i, k - 1]) % p)
        if factors:
            f = np.array(factors[::-1], np.int64)
            nxt = (nxt - (f[:, None] * polys[:k - 1] % p).sum(0)) % p
        polys[k] = nxt
    return polys[d, ::-1].tolist()


def combine(residues: list[tuple[int, list[int]]]) -> list[int]:
    """Integers (of either sign) with the given residues modulo the primes."""
    whole = math.prod(p for p, _ in residues)
    out = [0] * len(residues[0][1])
    for p, rest in residues:
        part = whole // p
        unit = part * pow(part % p, -1, p)
        for i, r in enumerate(rest):
            out[i] += r * unit
    out = [x % whole for x in out]
    return [x - whole if 2 * x > whole else x for x in out]


def roots_above(poly: list[int], a: int) -> int:
    """How many roots of a polynomial with real roots only are larger than a."""
    c = list(poly)
    if a:
        for i in range(len(c) - 1):  # c becomes p(x + a)
            for j in range(1, len(c) - i):
                c[j] += a * c[j - 1]
    signs = [x > 0 for x in c if x]
    return sum(s != t for s, t in zip(signs, signs[1:]))


def _value(poly: list[int], x: int) -> int:
    v = 0
    for c in poly:
        v = v * x + c
    return v


def largest_roots(poly: list[int], k: int, bits: int) -> list[tuple[int, int]]:
    """The k largest positive roots (with multiplicity; fewer if there are
    fewer) as (r, multiplicity): the root lies in ((r - 1), r] * 2^-bits.
    Roots of one such interval count as one multiple root."""
    top = -poly[1]  # the trace bounds every root
    scaled = [c << (bits * i) for i, c in enumerate(poly)]  # in units of 2^-bits
    lo, hi = 0, top << bits
    todo, out, have = [(lo, hi, roots_above(scaled, lo))], [], 0
    while todo and have < k:
        lo, hi, n = todo.pop()  # n roots in (lo, hi]; the largest interval is on top
        if not n:
            continue
        if n == 1:
            out.append((_refine(scaled, lo, hi), 1))
            have += 1
        elif hi - lo == 1:
            out.append((hi, n))
            have += n
        else:
            mid = (lo + hi) // 2
            above = roots_above(scaled, mid) - have  # the roots found so far are larger
            todo += [(lo, mid, n - above), (mid, hi, above)]
    return out


def _refine(poly: list[int], lo: int, hi: int) -> int:
    """The one root in (lo, hi], by the sign of the polynomial's values."""
    at_hi = _value(poly, hi)
    if at_hi == 0:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        v = _value(poly, mid)
        if v == 0:
            return mid
        if (v > 0) == (at_hi > 0):
            hi = mid
        else:
            lo = mid
    return hi


def eigenvectors(m: list[list[int]], root: int, bits: int, multiplicity: int) -> np.ndarray:
    """Unit eigenvectors (rows, orthogonal to each other) of the root
    ``root * 2^-bits``: the null space of m - root, by inverse iteration in
    decimal arithmetic.  Starting vectors are fixed, so results repeat."""
    d = len(m)
    size = len(str(max(1, sum(m[i][i] for i in range(d)))))
    with decimal.localcontext() as ctx:
        # the root's own places, and as many again for the solver's rounding
        ctx.prec = 2 * (size + math.ceil(bits * 0.30103)) + 20
        ctx.Emin, ctx.Emax = -10 ** 9, 10 ** 9
        value = decimal.Decimal(root) / (1 << bits)
        a = np.array([[decimal.Decimal(x) for x in row] for row in m], object)
        for i in range(d):
            a[i, i] -= value
        order, tiny = list(range(d)), decimal.Decimal(10) ** (-ctx.prec)
        for k in range(d):  # LU with row exchanges, factors kept below the diagonal
            i = max(range(k, d), key=lambda r: abs(a[r, k]))
            if i != k:
                a[[i, k]] = a[[k, i]]
                order[i], order[k] = order[k], order[i]
            if a[k, k] == 0:
                a[k, k] = tiny
            a[k + 1:, k] = a[k + 1:, k] / a[k, k]
            a[k + 1:, k + 1:] -= a[k + 1:, k:k + 1] * a[k:k + 1, k + 1:]
        found: list[np.ndarray] = []
        for s in range(multiplicity):
            v = np.array([decimal.Decimal(1 + (i * (s + 2) + s) % (d + 1)) / (i + s + 1) for i in range(d)], object)
            v = _unit(_apart(v, found))
            for _ in range(3):
                b = v[order]
                for i in range(1, d):
                    b[i] -= (a[i, :i] * b[:i]).sum()
                for i in range(d - 1, -1, -1):
                    if i < d - 1:
                        b[i] -= (a[i, i + 1:] * b[i + 1:]).sum()
                    b[i] = b[i] / a[i, i]
                v = _unit(_apart(_unit(b), found))
            found.append(v)
        return np.array([[float(x) for x in v] for v in found])


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / max(abs(x) for x in v)
    return v / (v * v).sum().sqrt()


def _apart(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for f in found:
            v = v - f * (f * v).sum()
    return v
