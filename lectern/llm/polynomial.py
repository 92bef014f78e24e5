"""Exact helpers for integer matrices of a bounded size: characteristic polynomials modulo primes, Chinese remaindering, real-root
isolation of real-rooted polynomials, and null-space inverse iteration. All are small functions that run inside tasks or on one matrix."""

from __future__ import annotations

import decimal
from math import comb

import numpy as np


def is_prime(n: int) -> bool:
    """Miller and Rabin's test with bases that decide every n below 2**32."""
    if n < 4:
        return n > 1
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11):
        if n == base:
            return True
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The largest primes below 2**31 (products of residues fit 64 bits) whose product is greater than the bound."""
    found, product, n = [], 1, 2**31 - 1
    while product <= bound:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def coefficient_bound(trace: int, d: int) -> int:
    """No coefficient of the characteristic polynomial of a positive semidefinite d x d matrix exceeds this (Maclaurin's inequality)."""
    return max(comb(d, k) * trace**k // k**k + 1 for k in range(1, d + 1))


def characteristic_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, constant first, of det(x - matrix) modulo p, by reduction to Hessenberg form."""
    h, n = matrix.copy(), len(matrix)
    for m in range(1, n - 1):
        pivots = np.flatnonzero(h[m:, m - 1])
        if not len(pivots):
            continue
        if pivots[0]:
            i = m + int(pivots[0])
            h[[m, i]] = h[[i, m]]
            h[:, [m, i]] = h[:, [i, m]]
        factors = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factors[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factors % p).sum(axis=1)) % p
    # the leading blocks' polynomials, one after the other
    blocks = np.zeros((n + 1, n + 1), np.int64)
    blocks[0, 0] = 1
    for k in range(1, n + 1):
        below, product = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            below[i] = product * int(h[i, k - 1]) % p
            product = product * int(h[i, i - 1]) % p if i else 0
        blocks[k, 1:] = blocks[k - 1, :-1]
        blocks[k] = (blocks[k] - (below[:, None] * blocks[:k] % p).sum(axis=0)) % p
    return blocks[n]


def remaindered(residues: dict[int, list[int]]) -> list[int]:
    """The integers of least absolute value with these residues (one list for each prime)."""
    product = 1
    for p in residues:
        product *= p
    totals = [0] * len(next(iter(residues.values())))
    for p, values in residues.items():
        rest = product // p
        factor = rest * pow(rest, -1, p)
        totals = [t + factor * v for t, v in zip(totals, values, strict=True)]
    return [v - product if (v := t % product) > product // 2 else v for t in totals]


def roots_above(coefficients: list[int], at: int, bits: int = 0) -> int:
    """How many roots of a real-rooted polynomial, with multiplicity, lie above at / 2**bits: the sign changes of the polynomial moved to that place
    (Descartes' rule is exact if all roots are real)."""
    d = len(coefficients) - 1
    c = [v << bits * (d - k) for k, v in enumerate(coefficients)]
    for low in range(d):
        for k in range(d - 1, low - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def largest_roots(coefficients: list[int], wanted: int, bound: int, digits: int = 160, most: int = 1024) -> list[tuple[int, int]]:
    """(numerator, bits) of the `wanted` largest roots with multiplicity, in falling order: numerator / 2**bits is at most 2**-bits below the root.

    Roots lie in [0, bound]. Each has `digits` bits more than its integer part at least, and so many more that it is told from its neighbours; roots nearer than
    2**-most are given as equal.
    """
    found: list[tuple[int, int]] = []

    def narrow(low: int, high: int, above_low: int, above_high: int, bits: int) -> None:
        """Splits (low, high] / 2**bits, which has above_low - above_high roots, until each is told apart."""
        while above_high < above_low and len(found) < wanted:
            if high - low == 1:
                inside = above_low - above_high
                if bits >= most or (inside == 1 and bits >= digits):
                    found.extend([(low, bits)] * inside)
                    return
                low, high, bits = low << 1, high << 1, bits + 1
            middle = (low + high) // 2
            above = roots_above(coefficients, middle, bits)
            if above == above_high:
                high = middle
            elif above == above_low:
                low = middle
            else:
                narrow(middle, high, above, above_high, bits)
                high, above_high = middle, above

    narrow(-1, bound, len(coefficients) - 1, 0, 0)
    return found[:wanted]


def null_vectors(matrix: list[list[int]], root: tuple[int, int], many: int, rounds: int = 4) -> list[list[float]]:
    """Unit vectors of the matrix's null space at a root (numerator, bits), as many as its multiplicity, by inverse iteration in decimal arithmetic."""
    numerator, bits = root
    d = len(matrix)
    size = max(1, *(abs(v) for row in matrix for v in row))
    with decimal.localcontext() as context:
        context.prec = 40 + (bits + size.bit_length()) // 3
        context.Emax, context.Emin = decimal.MAX_EMAX, decimal.MIN_EMIN
        number = decimal.Decimal
        value = number(numerator) / number(2) ** bits
        a = [[number(v) - (value if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
        tiny, order = number(size) * number(10) ** (20 - context.prec), list(range(d))
        for k in range(d):  # elimination with row exchanges; factors stay below the diagonal
            best = max(range(k, d), key=lambda i: abs(a[i][k]))
            a[k], a[best], order[k], order[best] = a[best], a[k], order[best], order[k]
            if abs(a[k][k]) < tiny:
                a[k][k] = tiny
            for i in range(k + 1, d):
                if a[i][k]:
                    factor = a[i][k] = a[i][k] / a[k][k]
                    row = a[k]
                    a[i][k + 1 :] = [x - factor * y for x, y in zip(a[i][k + 1 :], row[k + 1 :], strict=True)]

        def solve(b: list) -> list:
            x = [b[i] for i in order]
            for i in range(d):
                x[i] -= sum((a[i][j] * x[j] for j in range(i)), number(0))
            for i in range(d - 1, -1, -1):
                x[i] = (x[i] - sum((a[i][j] * x[j] for j in range(i + 1, d)), number(0))) / a[i][i]
            return x

        vectors: list[list] = []
        for start in range(many):
            x = [number((start * 31 + j * j * 17 + j * 7) % 101 + 1) for j in range(d)]
            for _ in range(rounds):
                x = solve(x)
                for _ in range(2):
                    for v in vectors:
                        along = sum((p * q for p, q in zip(x, v, strict=True)), number(0))
                        x = [p - along * q for p, q in zip(x, v, strict=True)]
                    length = sum((p * p for p in x), number(0)).sqrt()
                    x = [p / length for p in x]
            vectors.append(x)
        return [[float(p if max(v, key=abs) > 0 else -p) for p in v] for v in vectors]
