"""Hashes of words, of runs of words, and minwise tokens of sets of them."""

from __future__ import annotations

import numpy as np
import xxhash

#: Minwise tokens of a set.
TOKENS = 64
#: Bits of the odd sketch; a power of two.
ODD = 2048
#: Words whose hashes a worker remembers; then it starts anew.
REMEMBERED = 400_000

P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * P2
    return h ^ (h >> np.uint64(29))


def word_hashes(text: str | None) -> np.ndarray:
    """Words are runs of anything but space and the controls 9 to 13, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """One hash for each k neighbours; k is at most the length."""
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = mixed(out * P1 + h[i:n + i])
    return out


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct shingles of k words, hashed and sorted; with fewer words all of them as one."""
    h = word_hashes(text)
    return np.unique(runs(h, min(k, len(h)))) if len(h) else h


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return (rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64))


_MULTIPLY, _ADD = _seeds()


def tokens(one: np.ndarray) -> np.ndarray:
    """For each of ``TOKENS`` orders, the hash of the set's first member."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(one), 4096):
        each = one[at:at + 4096, None] * _MULTIPLY + _ADD
        least = np.minimum(least, (each ^ (each >> np.uint64(32))).min(axis=0))
    return least


def odd_bits(one: np.ndarray) -> np.ndarray:
    """For each of ``ODD`` bins, by hash, whether an odd number of members is in it, eight bins a byte.

    Where the sketches of two sets differ, one of the shingles that only one of them has is in the
    bin, so the sets differ in at least as many shingles as the sketches in bits.
    """
    place = (mixed(one) >> np.uint64(64 - ODD.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=ODD).astype(np.uint8) & 1)
