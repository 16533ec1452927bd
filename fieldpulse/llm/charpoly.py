"""Eigenvalues and eigenvectors of a symmetric, positive semi-definite matrix of integers, without rounding errors.

The characteristic polynomial is exact: the matrix is reduced to Hessenberg form modulo many primes at once, and
the coefficients follow by Chinese remaindering.  All its roots are real, so the sign changes of the polynomial
moved by ``a`` (Descartes) are the number of roots above ``a``, with multiplicity: roots are isolated by bisection on
that count and refined by bisection on the sign.  Eigenvectors come from inverse iteration in fixed-point integers,
started in the null space of the shifted matrix.

Work and memory follow the number of dimensions alone, never the number of vectors.
"""

from __future__ import annotations

from math import comb, isqrt

import numpy as np

#: Bits to which roots are found, relative to the trace, and bits of the fixed-point arithmetic.
ROOT_BITS, WORK_BITS = 192, 320


def primes(bits: int) -> list[int]:
    """Primes below ``2**31``, largest first, whose product has more than ``bits`` bits."""
    odd = np.arange(3, 46342, 2)  # up to the root of 2**31
    small = odd[[all(p % q for q in range(3, isqrt(p) + 1, 2)) for p in odd.tolist()]]
    out: list[int] = []
    p = (1 << 31) - 1
    while bits >= 0:
        if (p % small).all():
            out.append(p)
            bits -= 30
        p -= 2
    return out


def hessenberg(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Upper Hessenberg form of the matrices ``h[k]`` modulo ``p[k]``, by similarity steps."""
    h, m, d = h.copy(), p[:, None, None], h.shape[1]
    each = np.arange(len(p))
    for j in range(d - 2):
        pivot = (h[:, j + 1:, j] != 0).argmax(1) + j + 1
        rows, cols = h[each, pivot].copy(), h[each, :, pivot].copy()
        h[each, pivot] = h[:, j + 1]
        h[:, j + 1] = rows
        cols = h[each, :, pivot].copy()
        h[each, :, pivot] = h[:, :, j + 1]
        h[:, :, j + 1] = cols
        lead = h[:, j + 1, j]
        inverse = np.array([pow(int(a), -1, int(q)) if a else 0 for a, q in zip(lead, p)], np.int64)
        factor = h[:, j + 2:, j] * inverse[:, None] % p[:, None]
        h[:, j + 2:] = (h[:, j + 2:] - factor[:, :, None] * h[:, j + 1, None] % m) % m
        h[:, :, j + 1] = (h[:, :, j + 1] + (h[:, :, j + 2:] * factor[:, None] % m).sum(2)) % p[:, None]
    return h


def hessenberg_polynomial(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Coefficients modulo ``p``, lowest first, of the characteristic polynomials of Hessenberg matrices."""
    count, d = h.shape[:2]
    m = p[:, None]
    polys = np.zeros((d + 1, count, d + 1), np.int64)
    polys[0, :, 0] = 1
    for k in range(d):
        last = polys[k]
        polys[k + 1, :, 1:] = last[:, :-1]
        polys[k + 1] = (polys[k + 1] - h[:, k, k, None] * last % m) % m
        run = np.ones(count, np.int64)
        for i in reversed(range(k)):
            run = run * h[:, i + 1, i] % p
            polys[k + 1] = (polys[k + 1] - (run * h[:, i, k] % p)[:, None] * polys[i] % m) % m
    return polys[d]


def characteristic_polynomial(matrix: list[list[int]]) -> list[int]:
    """Coefficients, lowest first, of ``det(x - matrix)`` for a positive semi-definite matrix of integers."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # no coefficient exceeds that of d equal eigenvalues (Maclaurin)
    bound = max(comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1)) if d else 1
    chosen = primes(bound.bit_length() + 2)
    p = np.array(chosen, np.int64)
    rests = np.array([[[x % q for x in row] for row in matrix] for q in chosen], np.int64).reshape(len(chosen), d, d)
    found = hessenberg_polynomial(hessenberg(rests, p), p)
    product = 1
    for q in chosen:
        product *= q
    weights = [product // q * pow(product // q, -1, q) for q in chosen]
    out = []
    for k in range(d + 1):
        value = sum(int(r) * w for r, w in zip(found[:, k], weights)) % product
        out.append(value - product if value > product // 2 else value)
    return out


def roots_above(poly: list[int], a: int, bits: int) -> int:
    """Roots of a polynomial with real roots alone that lie above ``a / 2**bits``, with multiplicity."""
    c = [x << bits * (len(poly) - 1 - k) for k, x in enumerate(poly)]  # roots times 2**bits
    for i in range(len(c) - 1):
        for k in reversed(range(i, len(c) - 1)):
            c[k] += a * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(s != t for s, t in zip(signs, signs[1:]))


def sign_at(poly: list[int], a: int, bits: int) -> int:
    value = 0
    for k, x in enumerate(reversed(poly)):
        value = value * a + (x << bits * k)
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], top: int) -> list[tuple[int, int]]:
    """``(root, multiplicity)`` of the largest positive roots, falling, until ``top`` are counted.

    Roots are whole numbers of ``2**-shift`` as ``fraction_bits`` tells; those that agree in all these bits
    count as one root.
    """
    trace, shift = -poly[-2], fraction_bits(poly)
    positive = roots_above(poly, 0, 0)
    out: list[tuple[int, int]] = []
    high = trace.bit_length()
    open_ranges = [(0, 1, -high, positive, 0)]  # (low, high] in units of 2**-bits, roots above low and above high
    while open_ranges and sum(m for _, m in out) < min(top, positive):
        low, up, bits, above, beyond = open_ranges.pop()
        count = above - beyond
        if not count:
            continue
        if count == 1 and bits < shift:
            out.append((_refined(poly, low, up, bits, shift), 1))
        elif bits >= shift:
            out.append((up, count))
        else:
            low, up, bits = 2 * low, 2 * up, bits + 1
            middle = (low + up) // 2
            over = _count(poly, middle, bits)
            open_ranges.append((low, middle, bits, above, over))
            open_ranges.append((middle, up, bits, over, beyond))  # the higher half comes first
    return out


def _count(poly: list[int], a: int, bits: int) -> int:
    return roots_above(poly, a, bits) if bits >= 0 else roots_above(poly, a << -bits, 0)


def _refined(poly: list[int], low: int, up: int, bits: int, shift: int) -> int:
    """The root alone in ``(low, up]`` to ``2**-shift``: bisection on the sign."""
    low, up = low << shift - bits, up << shift - bits
    sign = lambda a: sign_at(poly, a, shift) if shift >= 0 else sign_at(poly, a << -shift, 0)
    upper = sign(up)
    if not upper:
        return up
    while up - low > 1:
        middle = (low + up) // 2
        s = sign(middle)
        if not s:
            return middle
        if s == upper:
            up = middle
        else:
            low = middle
    return up


def fraction_bits(poly: list[int]) -> int:
    """Binary digits of a root behind the point; negative if roots are that much larger than 1."""
    return ROOT_BITS - (-poly[-2]).bit_length()


def null_vectors(matrix: list[list[int]], root: int, shift: int, count: int) -> list[np.ndarray]:
    """``count`` orthonormal eigenvectors, as fixed-point integers of ``WORK_BITS`` bits, to an eigenvalue ``root / 2**shift``.

    Elimination with complete pivoting leaves ``count`` pivots of about zero.  Solving for unit vectors there is a
    step of inverse iteration from the null space; a further step follows with the same factors.
    """
    d, one = len(matrix), 1 << WORK_BITS
    scale = max(1, sum(matrix[i][i] for i in range(d)))
    fixed = lambda x, bits=0: (x << WORK_BITS) // (scale << bits) if bits >= 0 else (x << WORK_BITS - bits) // scale
    a = np.array([[fixed(x) for x in row] for row in matrix], object)
    value = fixed(root, shift)
    for i in range(d):
        a[i, i] -= value
    whole = a.copy()
    rows, cols = list(range(d)), list(range(d))
    rank = d - count
    for k in range(rank):
        size = np.abs(a[k:, k:])
        at = int(size.argmax())
        i, j = k + at // (d - k), k + at % (d - k)
        a[[k, i]], rows[k], rows[i] = a[[i, k]], rows[i], rows[k]
        a[:, [k, j]] = a[:, [j, k]]
        cols[k], cols[j] = cols[j], cols[k]
        factor = (a[k + 1:, k] << WORK_BITS) // a[k, k]
        a[k + 1:, k + 1:] -= factor[:, None] * a[k, k + 1:][None] >> WORK_BITS
    out: list[np.ndarray] = []
    for free in range(rank, d):
        v = np.array([0] * d, object)
        v[free] = one
        for k in reversed(range(rank)):
            v[k] = -int((a[k, k + 1:] * v[k + 1:]).sum()) // a[k, k]
        placed = np.array([0] * d, object)
        placed[cols] = v
        for other in out + out:  # twice, as the first pass leaves rounding errors of the larger parts
            placed = placed - ((int((placed * other).sum()) >> WORK_BITS) * other >> WORK_BITS)
        length = isqrt(int((placed * placed).sum()))
        out.append((placed << WORK_BITS) // length)
        rest = np.abs([int(x) >> WORK_BITS for x in whole.dot(out[-1])]).max()
        if rest >> WORK_BITS - ROOT_BITS // 2:
            raise ArithmeticError("an eigenvector misses its equation; raise WORK_BITS")
    return out


def eigen(matrix: list[list[int]], top: int) -> tuple[list[float], list[list[float]]]:
    """Shares of the trace, and unit eigenvectors, of the ``top`` largest positive eigenvalues with falling size."""
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    if not trace:
        return [], []
    poly = characteristic_polynomial(matrix)
    shift = fraction_bits(poly)
    shares, vectors = [], []
    for root, count in largest_roots(poly, top):
        share = root / (trace << shift) if shift >= 0 else (root << -shift) / trace
        for v in null_vectors(matrix, root, shift, count):
            shares.append(share)
            vectors.append([int(x) / (1 << WORK_BITS) for x in v])
    return shares[:top], vectors[:top]
