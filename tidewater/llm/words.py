"""Digests of the words of many texts at once."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240229)
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


POWERS = np.array([pow(int(ODD), k, 2**64) for k in range(4096)], np.uint64)


def word_codes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digests of all words (runs of no white space, A-Z in lower case), and the row of each."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = offs[:-1][np.diff(offs) > 0]
    begins[first] = solid[first]  # a word ends with its row
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.flatnonzero(begins)
    word = np.cumsum(begins)[at] - 1
    place = at - starts[word]
    codes = BYTE_CODES[LOWER[raw[at]]]
    powers = POWERS[place & 4095]
    if place.max() >= 4096:  # very long words: the block number is mixed in
        powers = powers + mix((place >> 12).astype(np.uint64)) * np.uint64(2)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
    words = mix(np.add.reduceat(codes * powers, edges) + np.diff(np.append(edges, len(at))).astype(np.uint64) * ODD)
    row = np.searchsorted(offs, starts, side="right") - 1
    return words, row
