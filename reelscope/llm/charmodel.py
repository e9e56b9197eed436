"""Interpolated Kneser-Ney models over a small alphabet, as sorted arrays of n-gram codes.

Text becomes 6-bit symbols, byte by byte: letters a to z without case, one symbol for all other ASCII, and 37 for the
bytes of other characters (both cases of a Latin-1 letter end alike). An n-gram is a number of 6 n bits, so a model of
order 4 has at most 2^24 entries for a language however large the corpus; real ones have some 10^5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


WIDTH = 6


def _symbol(b: int) -> int:
    c = chr(b).lower()
    if b < 128:
        return ord(c) - 96 if "a" <= c <= "z" else 0
    if b < 0xC0:
        return 27 + (b & 31)
    return 59 + (b == 0xC3) + 2 * (b > 0xC3) + (b > 0xDF)


SYMBOL = np.array([_symbol(b) for b in range(256)], dtype=np.uint32)
GAP = 0


def codes(buf: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(code of the n-gram that ends at each symbol, row of each); runs of the gap symbol count once.

    ``order - 1`` gaps stand before each row, so that its first symbols count too, and the shortest text has n-grams.
    """
    s = SYMBOL[buf]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != GAP) | (s[:-1] != GAP)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    s, row = s[keep], row[keep]
    before = np.arange(len(s)) + row.astype(np.int64) * (order - 1)  # where each n-gram begins
    wide = np.full(len(s) + (len(offsets) - 1) * (order - 1), GAP, dtype=np.uint32)
    wide[before + order - 1] = s
    x = np.zeros(len(s), dtype=np.uint32)
    for j in range(order):
        x = x << np.uint32(WIDTH) | wide[before + j]
    return x, row


def place(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each code in a sorted array, -1 where it is absent."""
    if not len(keys):
        return np.full(len(x), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


def hashed(code: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit codes, so that the sorted arrays are evenly filled."""
    x = code.astype(np.uint32)
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


@dataclass
class Level:
    """n-grams of one order: sorted hashes of codes, natural log-probabilities, and log weights of their contexts."""

    keys: np.ndarray
    logp: np.ndarray  # a column for each language
    contexts: np.ndarray
    weight: np.ndarray


@dataclass
class KneserNey:
    languages: list[str]
    order: int
    levels: list[Level]  # from order 1 up

    def logp(self, x: np.ndarray) -> np.ndarray:
        """Log-probability of the last symbol of each n-gram after the others, for each language."""
        out = np.zeros((len(x), len(self.languages)), dtype=np.float32)
        left = np.arange(len(x))
        for n in range(self.order, 0, -1):
            level = self.levels[n - 1]
            code = x[left] & np.uint32((1 << WIDTH * n) - 1)
            at = place(level.keys, hashed(code))
            seen = at >= 0
            out[left[seen]] += level.logp[at[seen]]
            left, code = left[~seen], code[~seen]
            if not len(left):
                break
            ctx = place(level.contexts, hashed(code >> np.uint32(WIDTH)))
            known = ctx >= 0
            out[left[known]] += level.weight[ctx[known]]
            if n == 1:
                out[left] -= np.float32(WIDTH * np.log(2))
        return out


def kneser_ney(languages: list[str], code: np.ndarray, language: np.ndarray, count: np.ndarray, order: int, modified: bool = False) -> KneserNey:
    """Fit from counts of n-grams of the highest order, with one row for each (code, language).

    Lower orders count the distinct symbols an n-gram follows. With ``modified``, counts of 1, 2 and more have discounts
    of their own. The lowest order is interpolated with the uniform distribution.
    """
    width, size = len(languages), 1 << WIDTH
    tables: list[tuple[np.ndarray, np.ndarray]] = []  # (codes, counts by language), from the highest order down
    keys, at = np.unique(code.astype(np.uint32), return_inverse=True)
    table = np.zeros((len(keys), width))
    np.add.at(table, (at, language), count)
    tables.append((keys, table))
    for n in range(order - 1, 0, -1):
        above, counts = tables[-1]
        keys, at = np.unique(above & np.uint32((1 << WIDTH * n) - 1), return_inverse=True)
        table = np.zeros((len(keys), width))
        np.add.at(table, at, (counts > 0).astype(float))
        tables.append((keys, table))
    levels: list[Level] = []
    for n, (keys, counts) in enumerate(reversed(tables), start=1):
        n1, n2, n3, n4 = ((counts == c).sum(axis=0) for c in (1, 2, 3, 4))
        y = np.where(n1 + 2 * n2 > 0, n1 / np.maximum(n1 + 2 * n2, 1), 0.5)
        y = np.clip(y, 0.05, 0.95)
        if modified:
            d1 = np.clip(1 - 2 * y * n2 / np.maximum(n1, 1), 0.05, 0.95)
            d2 = np.clip(2 - 3 * y * n3 / np.maximum(n2, 1), 0.05, 1.95)
            d3 = np.clip(3 - 4 * y * n4 / np.maximum(n3, 1), 0.05, 2.95)
        else:
            d1 = d2 = d3 = y
        discount = np.select([counts == 0, counts == 1, counts == 2], [np.zeros_like(counts), d1 + 0 * counts, d2 + 0 * counts], d3 + 0 * counts)
        contexts, of = np.unique(keys >> np.uint32(WIDTH), return_inverse=True)
        total, taken = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
        np.add.at(total, of, counts)
        np.add.at(taken, of, discount)
        weight = np.where(total > 0, taken / np.maximum(total, 1), 1.0)
        if n == 1:
            lower = np.full((len(keys), width), 1 / size)
        else:
            below = levels[-1]
            lower = np.exp(below.logp[place(below.keys, hashed(keys & np.uint32((1 << WIDTH * (n - 1)) - 1)))].astype(float))
        p = np.where(total[of] > 0, (counts - discount) / np.maximum(total[of], 1), 0) + weight[of] * lower
        h, hc = hashed(keys), hashed(contexts)
        a, b = np.argsort(h), np.argsort(hc)
        levels.append(Level(h[a], np.log(np.maximum(p[a], 1e-30)).astype(np.float32), hc[b], np.log(np.maximum(weight[b], 1e-30)).astype(np.float32)))
    return KneserNey(languages, order, levels)


def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of sparse counts."""
    keys = np.concatenate([k for k, _ in parts])
    n = np.concatenate([c for _, c in parts])
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)


