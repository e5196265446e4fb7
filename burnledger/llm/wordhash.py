"""Hashes of words and of runs of words, as numpy arrays.

Words are cut from the UTF-8 bytes at space, tab, line feed, vertical tab, form feed and carriage return, as
`[^\\x20\\x09-\\x0D]+` does. A run's hash is a polynomial of its words' 64-bit hashes modulo 2^64, then mixed.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_PART = 1 << 22  # bytes that are hashed at a time
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(20250501).integers(1, 1 << 63, 256, dtype=np.uint64)  # a number for each byte
_BREAK = re.compile(rb"[\x09-\x0d ]")


def split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hashed(data: bytes) -> np.ndarray:
    """Hash of each word of a UTF-8 text: a polynomial of its bytes modulo 2^64, mixed with its length."""
    out, at = [], 0
    while at < len(data):
        end = len(data)
        if end - at > _PART:
            found = _BREAK.search(data, at + _PART)
            end = found.start() if found else end
        out.append(_hashed(np.frombuffer(data, np.uint8, end - at, at)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _hashed(data: np.ndarray) -> np.ndarray:
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~_BLANK[data]
    turns = np.diff(word)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    size = 1 << max(16, len(data).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(_BASE, size)[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(_INVERSE, size)[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """Hash of each word of a text, with A-Z lower-cased on demand and nothing else changed."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    return hashed(data.lower() if lower else data)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` consecutive words; empty if there are fewer."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if length <= 8:
        h = words[:n].copy()
        for k in range(1, length):
            h = h * np.uint64(_BASE) + words[k : k + n]
        return mix(h)
    size = 1 << max(16, (len(words) - 1).bit_length())
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(_BASE, size)[: len(words)], out=sums[1:], dtype=np.uint64)
    return mix((sums[length:] - sums[:-length]) * _powers(_INVERSE, size)[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` consecutive ones, by doubling."""
    out, span = values, 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[: len(out) - step], out[step:])
        span += step
    return out
