"""Vectorised text work: words, shingles and n-grams of many texts at once, as NumPy arrays.

Texts are joined into blocks of code points. Every span gets a 64-bit hash from two prefix
sums, so the cost does not depend on how many spans overlap:
``hash(s, e) = mix((C[e] - C[s]) * p**-s)`` with ``C`` the running sum of
``table[code point] * p**i`` (all modulo 2**64, ``p`` odd and so invertible).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class _Tables:
    def __init__(self) -> None:
        self._powers = (np.ones(1, U), np.ones(1, U))
        self._code: np.ndarray | None = None
        self._letter: np.ndarray | None = None

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._powers[0]) < n + 1:
            out = []
            for base in (_P, _PINV):
                a = np.full(n + 1, base, U)
                a[0] = 1
                out.append(np.multiply.accumulate(a))
            self._powers = tuple(out)
        return self._powers

    def shrink(self) -> None:
        """Forgets powers beyond a block's; a very long text has made them."""
        if len(self._powers[0]) > 2 * BLOCK:
            self._powers = (np.ones(1, U), np.ones(1, U))

    @property
    def code(self) -> np.ndarray:
        if self._code is None:
            self._code = mix(np.arange(0x110000, dtype=U) + U(0x1234567))
        return self._code

    @property
    def letter(self) -> np.ndarray:
        if self._letter is None:
            self._letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        return self._letter


TABLES = _Tables()

#: White space of the word contracts: space and the bytes 9 to 13.
SPACE = np.zeros(0x110000, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
ASCII_LOWER = np.arange(0x80, dtype=np.uint32)
ASCII_LOWER[65:91] += 32


class Block:
    """Some texts as one array of code points; ``off[i]:off[i+1]`` is text i."""

    def __init__(self, texts: Sequence[str], ascii_lower: bool = False) -> None:
        self.texts = texts
        self.off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.off[1:])
        self.cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if ascii_lower:
            self.cp = np.where((self.cp >= 65) & (self.cp <= 90), self.cp + np.uint32(32), self.cp)
        self._sum: np.ndarray | None = None

    def runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of True that stay within a text: starts, ends, text numbers."""
        n = len(mask)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z
        before = np.empty(n, bool)
        before[0], before[1:] = False, mask[:-1]
        inner = self.off[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        before[inner] = False
        starts = np.flatnonzero(mask & ~before)
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, mask[1:]
        after[inner - 1] = False
        ends = np.flatnonzero(mask & ~after) + 1
        return starts, ends, np.searchsorted(self.off, starts, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words ``[^\\x20\\x09-\\x0D]+``."""
        return self.runs(~SPACE[self.cp])

    def letters(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(TABLES.letter[self.cp])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(self.cp)
        power, inverse = TABLES.powers(n)
        with np.errstate(over="ignore"):
            if self._sum is None:
                self._sum = np.zeros(n + 1, U)
                np.cumsum(TABLES.code[self.cp] * power[:n], out=self._sum[1:])
            h = (self._sum[ends] - self._sum[starts]) * inverse[starts]
            return mix(h + (ends - starts).astype(U))


def blocks(texts: Sequence[str | None], ascii_lower: bool = False, size: int = BLOCK) -> Iterator[tuple[int, int, Block]]:
    """The texts (null: empty) in blocks of about ``size`` code points; a longer text is a block of its own."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > size:
            yield lo, i, Block([x or "" for x in texts[lo:i]], ascii_lower)
            lo, held = i, 0
        held += n
    if lo < len(texts):
        yield lo, len(texts), Block([x or "" for x in texts[lo:]], ascii_lower)


def chain(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and the index of each one's first word; shingles stay within a text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    with np.errstate(over="ignore"):
        x = np.zeros(n, U)
        for i in range(k):
            x = x * U(0xD6E8FEB86659FD93) + h[i : i + n]
    return mix(x[at] + U(k)), at


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Lookup:
    """Sorted 64-bit keys to row numbers; -1 for unknown keys.

    A table over the top bits narrows each search, so that it costs a few steps.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.bits = max(1, int(np.ceil(np.log2(max(2, 4 * len(keys))))))
        #: a slot per hash prefix: the first key at or after it
        self.first = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=U) << U(64 - self.bits)).astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        if not len(self.keys) or not len(h):
            return out
        at = self.first[(h >> U(64 - self.bits)).astype(np.int64)].astype(np.int64)
        todo = np.arange(len(h))
        last = len(self.keys) - 1
        while len(todo):
            a = at[todo]
            k = self.keys[np.minimum(a, last)]
            hit = (k == h[todo]) & (a <= last)
            out[todo[hit]] = self.order[a[hit]]
            todo = todo[(k < h[todo]) & (a < last)]
            at[todo] += 1
        return out
