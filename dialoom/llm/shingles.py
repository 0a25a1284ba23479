"""Word shingles of whole texts as 64-bit hashes, computed over the text's bytes with numpy.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. No byte of a
multi-byte character falls in those ranges, so bytes and characters cut the text alike.
"""

from __future__ import annotations

import numpy as np

_PRIME = np.uint64(0x100000001B3)
_ADD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _odd_inverse() -> np.uint64:
    return np.uint64(pow(int(_PRIME), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes words and shingles; keeps its tables of powers between texts."""

    def __init__(self) -> None:
        self._up = powers(_PRIME, 1 << 16)
        self._down = powers(_odd_inverse(), 1 << 16)

    def _tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self._up):
            size = 1 << int(n).bit_length()
            self._up, self._down = powers(_PRIME, size), powers(_odd_inverse(), size)
        return self._up, self._down

    def words(self, text: str | None) -> np.ndarray:
        """One hash per word of the text, in order."""
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        if not len(raw):
            return np.empty(0, np.uint64)
        upper = (raw >= 65) & (raw <= 90)
        raw = raw + (upper.astype(np.uint8) << 5)
        inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        starts, ends = edges[0::2], edges[1::2]
        up, down = self._tables(len(raw))
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        lengths = (ends - starts).astype(np.uint64)
        return mix((sums[ends] - sums[starts]) * down[starts] + lengths * _ADD)

    def all_shingles(self, text: str | None, n: int = 5) -> np.ndarray:
        """The hashes of all runs of n words in order; a shorter text is one run, no words none."""
        words = self.words(text)
        if not len(words):
            return words
        width = min(n, len(words))
        total = np.full(len(words) - width + 1, width, np.uint64)
        for i in range(width):
            total = mix(total * _ADD + words[i : len(words) - width + 1 + i])
        return total

    def shingles(self, text: str | None, n: int = 5) -> np.ndarray:
        """The distinct shingle hashes, sorted."""
        found = np.sort(self.all_shingles(text, n))
        return found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found


def set_key(shingles: np.ndarray) -> bytes | None:
    """16 bytes that name a set of shingles; None for the empty set."""
    if not len(shingles):
        return None
    one = mix(shingles ^ _ADD).sum(dtype=np.uint64)
    two = np.bitwise_xor.reduce(mix(shingles * _PRIME + np.uint64(len(shingles))))
    return int(one).to_bytes(8, "big") + int(two).to_bytes(8, "big")


class MinHash:
    """Signatures of sets of hashes: 32-bit minima under seeded multiply-and-add functions."""

    def __init__(self, size: int, seed: int = 20240611) -> None:
        seeds = mix(np.arange(1, 2 * size + 1, dtype=np.uint64) * _ADD + np.uint64(seed))
        self.a = (seeds[:size] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
        self.b = (seeds[size:] >> np.uint64(32)).astype(np.uint32)[:, None]
        self.size = size

    def signature(self, hashes: np.ndarray, chunk: int = 512) -> np.ndarray:
        folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
        low = np.full(self.size, np.iinfo(np.uint32).max, np.uint32)
        for begin in range(0, len(folded), chunk):
            np.minimum(low, (self.a * folded[None, begin : begin + chunk] + self.b).min(axis=1), out=low)
        return low
