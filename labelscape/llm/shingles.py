"""Word shingles as 64-bit numbers, computed for a whole text at once."""

from __future__ import annotations

import hashlib

import numpy as np

from labelscape.llm.order_minhash import MULTIPLIER, mixed

_LETTERS = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
_BACK = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
#: Words of more bytes get a digest: sums modulo 2**64 are alike for some words of 1,024 letters and more.
LONG = 64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's first ``n`` powers and their inverses, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        for i, base in enumerate((MULTIPLIER, _BACK)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[i] = np.multiply.accumulate(row)
    return _powers[0][:n], _powers[1][:n]


def runs_hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each run of bytes, whatever its place."""
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * up[:-1], dtype=np.uint64)])
    numbers = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG):
        numbers[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return numbers


def word_numbers(text: str) -> np.ndarray:
    """A number for each word ``[^\\x20\\x09-\\x0D]+``, the letters A-Z lower-cased."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    blank = np.concatenate([[True], (data == 32) | ((data >= 9) & (data <= 13)), [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    return runs_hashed(data, starts, ends)


def shingle_set(text: str, width: int = 4) -> np.ndarray:
    """The distinct shingles of ``width`` words, sorted; fewer words are one shingle, no words none."""
    words = word_numbers(text)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = words[:n] + np.uint64(width)
    for i in range(1, width):
        out = mixed(out * MULTIPLIER + words[i:i + n])
    return np.unique(out)
