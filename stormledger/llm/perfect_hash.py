"""A minimal perfect hash over byte strings, by hash-and-displace, looked up in vectorised form."""

from __future__ import annotations

import numpy as np
import xxhash

#: Keys to a bucket, on average.
LOAD = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def key_hashes(keys: list[bytes], seed: int = 0) -> np.ndarray:
    """XXH64 of each key."""
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(k, seed) for k in keys), np.uint64, len(keys))


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit mix of unsigned integers, another for each seed."""
    x = x + np.uint64(int(_MIX) * seed & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _displaced(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """The slot below ``n`` of hashes under displacements: a multiply-shift mix of both."""
    x = (h ^ (d + np.uint64(1)) * _MIX) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return (((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def slot_of(h: np.ndarray, displaced: np.ndarray, n: int) -> np.ndarray:
    """The slot of each hash in a table of ``n`` keys, given the buckets' displacements."""
    return _displaced(h, displaced[(h % np.uint64(len(displaced))).astype(np.int64)], n)


def displacements(h: np.ndarray, n: int) -> np.ndarray:
    """A displacement for each bucket under which distinct hashes ``h`` get the slots 0 to n-1, each once.

    Buckets are placed from the largest on. Small buckets try displacements in blocks of growing length.
    """
    m = max(1, -(-n // LOAD))
    bucket = (h % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=m)
    ends = np.cumsum(sizes)
    taken, out = np.zeros(n, bool), np.zeros(m, np.uint64)
    for b in np.argsort(-sizes, kind="stable"):
        k = sizes[b]
        if not k:
            break
        own, d, step = h[order[ends[b] - k : ends[b]]], 0, 16
        while True:
            tries = np.arange(d, d + step, dtype=np.uint64)
            slots = _displaced(own[None, :], tries[:, None], n)
            ok = ~taken[slots].any(axis=1)
            if k > 1:
                s = np.sort(slots, axis=1)
                ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if ok.any():
                t = int(ok.argmax())
                taken[slots[t]] = True
                out[b] = tries[t]
                break
            d, step = d + step, min(step * 4, 1 << 16)
    return out


class PerfectHash:
    """Maps each of ``keys`` (distinct) to its own place in the list and other byte strings to -1.

    The hash itself is minimal and perfect: n keys, n slots. Each slot keeps its key's place; a look-up compares the
    key found there with the one asked for, so strings outside the set are told apart for certain.
    """

    def __init__(self, keys: list[bytes]):
        self.keys, self.n = keys, len(keys)
        h, self.seed = key_hashes(keys), 0
        while len(np.unique(h)) < self.n:  # two keys share a hash: draw another
            self.seed += 1
            h = key_hashes(keys, self.seed)
        self.displaced = displacements(h, self.n)
        self.place = np.empty(self.n, np.int64)
        if self.n:
            self.place[self.slots(h)] = np.arange(self.n)

    def slots(self, h: np.ndarray) -> np.ndarray:
        return slot_of(h, self.displaced, self.n)

    def lookup(self, asked: list[bytes]) -> np.ndarray:
        """The place of each asked key, or -1."""
        if not self.n or not asked:
            return np.full(len(asked), -1)
        found = self.place[self.slots(key_hashes(asked, self.seed))]
        keys = self.keys
        return np.fromiter((i if keys[i] == a else -1 for i, a in zip(found.tolist(), asked, strict=True)), np.int64, len(asked))
