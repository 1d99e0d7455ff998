"""Vectorised word hashing for Python stages.

A word is a run of ASCII letters, ASCII digits and non-ASCII bytes of the lower-cased UTF-8 text. Words are hashed
with a polynomial over a table of random 64-bit values per byte, by prefix sums, so a whole batch costs a few numpy
passes whatever the lengths of its words.
"""

from __future__ import annotations

import functools

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every bit of a 64-bit value over the whole."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + np.uint64((seed * _BASE) & _MASK))


@functools.lru_cache(1)
def _byte_table() -> tuple[np.ndarray, np.ndarray]:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _GAMMA)
    word = np.zeros(256, bool)
    word[128:] = True
    for low, high in (("0", "9"), ("a", "z"), ("A", "Z")):
        word[ord(low) : ord(high) + 1] = True
    return values, word


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(size, np.uint64(base))
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of `buf`."""
    up, down = _powers(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_byte_table()[0][buf] * up[: len(buf)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the offsets at which each text's words begin (one more than texts)."""
    parts = [((t.lower() if lower else t) if t else "").encode("utf-8", "replace") for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    word = np.zeros(len(buf) + 1, bool)
    word[1:] = _byte_table()[1][buf]
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[0::2], edge[1::2]
    firsts = np.concatenate([[0], np.cumsum(sizes + 1)])
    return spans(buf, starts, ends), np.searchsorted(starts, firsts)


def windows(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each text and their offsets.

    A text of fewer than k words has one window, its whole word sequence; a text without words has none.
    """
    counts = np.diff(offsets)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate([[0], np.cumsum(sizes)])
    text = np.repeat(np.arange(len(counts)), sizes)
    at = offsets[:-1][text] + np.arange(out_offsets[-1]) - out_offsets[:-1][text]
    left = np.minimum(counts, k)[text]
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    for i in range(k):
        step = mix(out * np.uint64(3) + padded[at + i] + np.uint64(i + 1))
        out = np.where(i < left, step, out)
    return out, out_offsets
