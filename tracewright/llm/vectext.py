"""Vectorised word hashing: whole batches of texts become arrays of 64-bit word hashes.

Words are maximal runs of characters other than space and U+0009..U+000D, after
A-Z has been lowered; all of these are ASCII, so UTF-8 bytes can be scanned as they
are. A word's hash is a polynomial in an odd base over random per-byte values,
modulo 2**64, read off one running sum per batch.
"""

from __future__ import annotations

import numpy as np

_SPACES = (0x20, *range(0x09, 0x0E))
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_STATE: dict = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _tables(letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Per byte its value and whether it parts words; ``letters``: punctuation parts them too."""
    if letters not in _STATE:
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        values = values[lower]
        space = np.zeros(256, dtype=bool)
        space[list(_SPACES)] = True
        if letters:
            space[:128] |= [not chr(b).isalnum() for b in range(128)]
        values[space] = 0
        _STATE[letters] = values, space
    return _STATE[letters]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    have = _STATE.get("powers")
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)

        def run(base: int) -> np.ndarray:
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            return np.cumprod(steps, dtype=np.uint64)

        have = run(_BASE), run(inverse)
        if size <= 1 << 23:
            _STATE["powers"] = have
    return have


def encode(texts) -> tuple[np.ndarray, np.ndarray]:
    """One byte array for all texts, each ended by a newline, and where each begins."""
    parts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    data = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
    begins = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=begins[1:])
    return data, begins


def word_hashes(texts, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for text i its slice ``bounds[i]:bounds[i + 1]``."""
    data, begins = encode(texts)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(begins), np.int64)
    values, space = _tables(letters)
    power, inverse = powers(len(data) + 1)
    gaps = space[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gaps)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]  # every text ends in a newline, so edges pair up
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * power[: len(data)], out=running[1:])
    hashes = mix((running[ends] - running[starts]) * inverse[starts])
    return hashes, np.searchsorted(starts, begins)


_ORDER = mix(np.arange(11, 31, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def rolled_shingles(words: np.ndarray, width: int, fixed: bool = False) -> np.ndarray:
    """Hashes of the word sequences of ``width``; if there are fewer words, of all of them.

    ``fixed``: sequences of fewer words than a shingle has, hashed as whole short texts are.
    """
    if fixed or len(words) < width:
        n = width if fixed else len(words)
        if not n or len(words) < n:
            return np.empty(0, np.uint64)
        total = np.full(len(words) - n + 1, 0x51ED27 + n, dtype=np.uint64)
        for k in range(n):
            total += words[k : k + len(total)] * _ORDER[5 + k]
        return mix(total)
    rolled = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for k in range(width):
        rolled += words[k : k + len(rolled)] * _ORDER[k]
    return mix(rolled)


def shingle_sets(texts, width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has one shingle, its whole word sequence; one without
    words has none.
    """
    words, bounds = word_hashes(texts)
    return [np.unique(rolled_shingles(words[a:b], width)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
