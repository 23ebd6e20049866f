"""Hashes of words and of runs of words, vectorised over a batch of texts."""

from __future__ import annotations

import numpy as np
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, step in enumerate((_STEP, _BACK)):
            p = np.full(n, step)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Hashes of all words in a row, the number of words of each text, and the words. bytes.split and
    bytes.lower know ASCII white space and letters alone."""
    parts = [(t.lower() if lower else t).split() for t in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    hashes = np.fromiter((h for p in parts for h in map(xxhash.xxh3_64_intdigest, p)), np.uint64, int(counts.sum()))
    return hashes, counts, parts


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the run of `length` words from each place of all words in a row; runs may cross texts."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _grown(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mixed((total[length:] - total[:-length]) * down[:n] + np.uint64(length))


def places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all words in a row: the text of each, and its place there."""
    text = np.repeat(np.arange(len(counts)), counts)
    return text, np.arange(len(text)) - (np.cumsum(counts) - counts)[text]
