"""Systematic Reed-Solomon codes, vectorised over codewords.

A codeword is stored as data then parity; as a polynomial, low degree first, it
is parity then data, and its roots are the powers 1 to n - k of the generator.
Parity is linear in the data, so it is a sum of table rows, one per data byte.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from .gf import EXP, LOG, MUL, product


@cache
def generator_rows(n: int, k: int) -> np.ndarray:
    """k x (n - k): the parity of each unit vector of data."""
    parity = n - k
    g = [1]
    for root in range(1, parity + 1):
        g = product(g, [int(EXP[root % 255]), 1])
    low = np.array(g[:parity], np.uint8)  # x**parity modulo g, as g is monic
    rows, row = np.empty((k, parity), np.uint8), low.copy()
    for i in range(k):
        rows[i] = row
        top = row[-1]
        row = np.concatenate([[np.uint8(0)], row[:-1]]) ^ MUL[top, low]
    return rows


@cache
def _tables(n: int, k: int) -> np.ndarray:
    """k x 256 x words: each data byte's share of the parity, packed in 64-bit words."""
    return _shares(generator_rows(n, k))


@cache
def _all_tables(n: int, k: int) -> np.ndarray:
    """(n * 256) x words: the remainder that each byte leaves at each stored place."""
    whole = np.vstack([generator_rows(n, k), np.eye(n - k, dtype=np.uint8)])
    return _shares(whole).reshape(n * 256, -1)


def _shares(factors: np.ndarray) -> np.ndarray:
    """rows x 256 x words: each byte times each row of factors, packed in 64-bit words."""
    shares = MUL[:, factors].transpose(1, 0, 2)
    return np.ascontiguousarray(np.pad(shares, ((0, 0), (0, 0), (0, -factors.shape[1] % 8)))).view(np.uint64)


def _sums(tables: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Of each row of bytes (given as columns) the sum of their shares, as words."""
    out = np.zeros((columns.shape[1], tables.shape[2]), np.uint64)
    for table, column in zip(tables, columns, strict=True):
        out ^= table.take(column, axis=0)
    return out


@cache
def _root_tables(count: int) -> np.ndarray:
    """Each coefficient's share of a polynomial's values at the roots."""
    return _shares(EXP[np.arange(count)[:, None] * np.arange(1, count + 1)[None, :] % 255])


@cache
def _place_tables(n: int, count: int) -> np.ndarray:
    """Each coefficient's share of a polynomial's values at the inverses of all places."""
    return _shares(EXP[-np.arange(count)[:, None] * np.arange(n)[None, :] % 255])


_FLAT = MUL.reshape(-1)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _FLAT.take((a.astype(np.int64) << 8) + b)


def encode(data: np.ndarray, n: int, k: int) -> np.ndarray:
    """Parity (rows x n - k) of data (rows x k)."""
    out = np.empty((len(data), n - k), np.uint8)
    for first in range(0, len(data), 8192):
        some = slice(first, first + 8192)
        out[some] = _sums(_tables(n, k), np.ascontiguousarray(data[some].T)).view(np.uint8)[:, : n - k]
    return out


def _remainder(words: np.ndarray, n: int, k: int) -> np.ndarray:
    """Stored codewords modulo the generator polynomial, low degree first; all zero: a codeword."""
    return encode(words[:, :k], n, k) ^ words[:, k:]


def _at_roots(rest: np.ndarray) -> np.ndarray:
    """Values at the roots of polynomials given by their remainders."""
    return _sums(_root_tables(rest.shape[1]), np.ascontiguousarray(rest.T)).view(np.uint8)[:, : rest.shape[1]]


def syndromes(words: np.ndarray, n: int, k: int) -> np.ndarray:
    """rows x (n - k) values of stored codewords at the roots; all zero: a codeword."""
    return _at_roots(_remainder(words, n, k))


def dirty(words: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which stored rows are no codewords: their parity differs from their data's."""
    return _remainder(words, n, k).any(axis=1)


FEW = 8  # rows up to which numbers are faster than arrays
_MUL, _EXP, _LOG = MUL.tolist(), EXP.tolist(), LOG.tolist()


def _locator(s: list[int]) -> tuple[list[int], int]:
    """As ``_locators`` for one row of syndromes."""
    most = len(s) // 2
    current, before = [1] + [0] * most, [1] + [0] * most
    length, last, span = 0, 1, 0
    for r in range(len(s)):
        span = min(span + 1, most)
        before = [0, *before[:span], *before[span + 1 :]]
        top, gap = min(length, r, most), 0
        for i in range(top + 1):
            gap ^= _MUL[current[i]][s[r - i]]
        if not gap:
            continue
        times, high = _MUL[_EXP[(_LOG[gap] - _LOG[last]) % 255]], max(span, top)
        grown = [c ^ times[b] for c, b in zip(current[: high + 1], before[: high + 1], strict=True)]
        if 2 * length <= r:
            before[: high + 1] = current[: high + 1]
            length, last, span = r + 1 - length, gap, high
        current[: high + 1] = grown
    return current, length


def _locators(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each column of syndromes the shortest linear recurrence (Berlekamp-Massey on all at once), and its length.

    Terms beyond half the syndromes are left out: they belong to lengths that can't be corrected.
    """
    count, rows = s.shape
    most = count // 2
    if rows <= FEW:
        found = [_locator(column) for column in s.T.tolist()]
        return np.array([c for c, _ in found], np.uint8).T, np.array([n for _, n in found], np.int64)
    current, before = np.zeros((most + 1, rows), np.uint8), np.zeros((most + 1, rows), np.uint8)
    current[0] = before[0] = 1
    length, last, span = np.zeros(rows, np.int64), np.ones(rows, np.uint8), 0
    for r in range(count):
        span = min(span + 1, most)
        before[1 : span + 1] = before[:span].copy()
        before[0] = 0
        top = min(int(length.max()), r, most)
        gap = np.bitwise_xor.reduce(_times(current[: top + 1], s[r - top : r + 1][::-1]), axis=0)
        if not gap.any():
            continue
        scale = np.where(gap > 0, EXP[(LOG[gap] - LOG[last]) % 255], 0).astype(np.uint8)
        longer, high = (gap > 0) & (2 * length <= r), max(span, top)
        grown = current[: high + 1] ^ _times(scale, before[: high + 1])
        if longer.any():
            before[: high + 1] = np.where(longer, current[: high + 1], before[: high + 1])
            last[longer] = gap[longer]
            length[longer] = r + 1 - length[longer]
            span = high
        current[: high + 1] = grown
    return current, length


def _changes(s: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, stored place and change of each error that the syndromes tell, and the errors of each row; 0: it can't be told."""
    most = (n - k) // 2
    s = np.ascontiguousarray(s.T)
    locator, errors = _locators(s)
    tables = _place_tables(n, most + 1)
    odd = _sums(tables[1::2], locator[1::2])
    at = (_sums(tables[::2], locator[::2]) ^ odd).view(np.uint8)[:, :n]
    told = (errors > 0) & (errors <= most) & ((at == 0).sum(axis=1) == errors)
    row, degree = np.nonzero((at == 0) & told[:, None])
    high = int(errors[told].max(initial=0))
    magnitude = np.zeros((high, s.shape[1]), np.uint8)
    for i in range(high):
        magnitude[i:] ^= _times(locator[i], s[: high - i])
    above = _sums(tables[:high], magnitude).view(np.uint8)[row, degree]
    below = odd.view(np.uint8)[row, degree]  # the derivative has the odd terms alone, over the place's inverse
    # the first root is the generator itself, so no power of the place is left over
    change = np.where(below > 0, EXP[(LOG[above] - degree - LOG[below]) % 255], 0)
    change[above == 0] = 0
    place = np.where(degree >= n - k, degree - (n - k), k + degree)
    return row, place, change.astype(np.uint8), np.where(told, errors, 0)


def _still(rest: np.ndarray, row: np.ndarray, place: np.ndarray, change: np.ndarray, n: int, k: int) -> np.ndarray:
    """Remainders of codewords behind their changes (given by row): what each change adds, as a remainder is linear."""
    parity = n - k
    out = np.zeros((len(rest), -(-parity // 8)), np.uint64)
    out.view(np.uint8)[:, :parity] = rest
    if len(row):
        shares = _all_tables(n, k).take(place * 256 + change, axis=0)
        rows = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[rows]] ^= np.bitwise_xor.reduceat(shares, rows, axis=0)
    return out


def decode(words: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Stored codewords, corrected; for each the bytes changed, -1 where it can't be corrected (left as it was)."""
    out, changed = words.copy(), np.zeros(len(words), np.int64)
    rest = _remainder(words, n, k)
    rows = np.flatnonzero(rest.any(axis=1))
    for first in range(0, len(rows), 4096):
        some = rows[first : first + 4096]
        row, place, change, errors = _changes(_at_roots(rest[some]), n, k)
        fixed = out[some]
        fixed[row, place] ^= change
        good = (errors > 0) & ~_still(rest[some], row, place, change, n, k).any(axis=1)
        out[some[good]], changed[some] = fixed[good], np.where(good, errors, -1)
    return out, changed


def protect_many(payloads: list[bytes], level: tuple[int, int] | None) -> list[bytes]:
    """Each payload as codewords of (data, parity) bytes, the last padded with zeros; level None: as they are."""
    if level is None:
        return payloads
    k, parity = level
    counts = np.array([-(-len(p) // k) for p in payloads], np.int64)
    data = np.frombuffer(b"".join(p.ljust(int(c) * k, b"\0") for p, c in zip(payloads, counts, strict=True)), np.uint8).reshape(-1, k)
    raw, ends = np.hstack([data, encode(data, k + parity, k)]).tobytes(), np.cumsum(counts) * (k + parity)
    return [raw[b - c * (k + parity) : b] for b, c in zip(ends.tolist(), counts.tolist(), strict=True)]


def protect(payload: bytes, level: tuple[int, int] | None) -> bytes:
    return protect_many([payload], level)[0]


def unprotect_many(stored: list[bytes], level: tuple[int, int] | None, validate: bool = True) -> list[tuple[bytes, int, int]]:
    """Of each: data of its codewords (with the padding), bytes corrected, codewords beyond repair."""
    if level is None:
        return [(s, 0, 0) for s in stored]
    k, parity = level
    n = k + parity
    counts = np.array([-(-len(s) // n) for s in stored], np.int64)
    words = np.frombuffer(b"".join(s.ljust(int(c) * n, b"\0") for s, c in zip(stored, counts, strict=True)), np.uint8).reshape(-1, n)
    changed = np.zeros(len(words), np.int64)
    if validate:
        words, changed = decode(words, n, k)
    raw, ends = words[:, :k].tobytes(), np.cumsum(counts)
    sums = [np.concatenate([[0], np.cumsum(v)]) for v in (np.maximum(changed, 0), changed < 0)]
    return [(raw[(b - c) * k : b * k], *(int(s[b] - s[b - c]) for s in sums)) for b, c in zip(ends.tolist(), counts.tolist(), strict=True)]


def unprotect(stored: bytes, level: tuple[int, int] | None, validate: bool = True) -> tuple[bytes, int, int]:
    return unprotect_many([stored], level, validate)[0]
