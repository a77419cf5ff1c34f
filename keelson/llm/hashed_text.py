"""Hashed word features and FTRL-proximal logistic regression over them."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash

#: Feature space of 2 ** BITS coordinates.
BITS = 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_CACHE_WORDS = 1 << 16


class Hasher:
    """Word n-grams and skip-grams (unigrams, bigrams, pairs that skip one word) as distinct coordinates."""

    def __init__(self):
        self._seen: dict[bytes, int] = {}
        self.n_words = 0  # of the last text

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = _WORD.findall((text or b"").lower())
        self.n_words = len(words)
        if not words:
            return np.empty(0, dtype=np.int64)
        if len(self._seen) > _CACHE_WORDS:
            self._seen.clear()
        seen = self._seen
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))
        grams = [_mix(h), _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]), _mix(h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] + np.uint64(1))]
        at = (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.uint32)
        at.sort()
        return at[np.flatnonzero(np.diff(at, prepend=np.uint32(0xFFFFFFFF)))].astype(np.int64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Ftrl:
    """FTRL-proximal (McMahan et al., 2013): a learning rate for each coordinate, and L1 that leaves few weights."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0
    epochs: int = 5

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Coordinates, their weights, and the bias, from rows of coordinates."""
        z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        bz = bn = bias = 0.0
        order = np.random.default_rng(7)
        for _ in range(self.epochs):
            for i in order.permutation(len(rows)):
                at = rows[i]
                zi, ni = z[at], n[at]
                root = np.sqrt(ni)
                w = self._weights(zi, root)
                bias = -bz / ((self.beta + bn**0.5) / self.alpha + self.l2) if bn else 0.0
                g = float(sigmoid(w.sum() + bias)) - y[i]
                z[at] = zi + g - (np.sqrt(ni + g * g) - root) / self.alpha * w
                n[at] = ni + g * g
                bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / self.alpha * bias
                bn += g * g
        w = self._weights(z, np.sqrt(n))
        at = np.nonzero(w)[0]
        return at, w[at], bias

    def _weights(self, z: np.ndarray, root: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + root) / self.alpha + self.l2))
