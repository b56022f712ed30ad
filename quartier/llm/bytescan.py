"""Vectorised scans over UTF-8 bytes: word hashes, window hashes, minimiser anchors.

Every function takes plain bytes and returns numpy arrays; they run inside Spark tasks on one document, or
on a batch of joined documents, at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Longer words are hashed by themselves: polynomials modulo 2**64 are no good for them, and need powers as long as the text.
LONG = 256
SEGMENT = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that their order is as good as random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0..n and their inverses modulo 2**64, kept between calls."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        up, down = np.full(size, _MULT), np.full(size, _INV)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: entry i covers the first i bytes."""
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * powers(len(b))[0][: len(b)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of bytes [start, end), equal for equal content wherever it stands."""
    inv = powers(len(prefix) - 1)[1]
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


def hash_spans(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of bytes or code points, in order of start and apart; equal for equal content."""
    out = np.zeros(len(start), np.uint64)
    short = np.flatnonzero(end - start <= LONG)
    cut = np.flatnonzero(np.diff(start[short] // SEGMENT, prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(short)), strict=False):
        mine = short[a:b]
        low, high = start[mine[0]], end[mine[-1]]
        part = codes[low:high]
        prefix = np.zeros(len(part) + 1, np.uint64)
        value = _BYTE[part] if part.dtype == np.uint8 else mix(part.astype(np.uint64) + np.uint64(1))
        np.cumsum(value * powers(len(part))[0][: len(part)], out=prefix[1:])
        out[mine] = span_hash(prefix, start[mine] - low, end[mine] - low)
    for i in np.flatnonzero(end - start > LONG).tolist():
        digest = hashlib.blake2b(codes[start[i] : end[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash for each word ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, in order."""
    if not text:
        return np.zeros(0, np.uint64)
    b = _LOWER[np.frombuffer(text, np.uint8)]
    solid = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    return hash_spans(b, edge[::2], edge[1::2])


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct n-word shingles; a shorter sequence is one shingle, an empty one has none."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, np.uint64(n))
    for i in range(n):
        h = mix(h * _MULT + words[i : len(words) - n + 1 + i])
    return np.unique(h)


def windows_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors_of(prefix: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are least in some window of ``window`` bytes, from prefix sums.

    Also, for each window, the upper half of its least hash.

    Equal windows choose equal grams at equal places, so each pair of equal windows shares an anchor.
    """
    n = len(prefix) - 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    h = (prefix[gram:] - prefix[:-gram]) * powers(n)[1][: n - gram + 1]
    h = mix(h)
    order = (h >> np.uint64(32)).astype(np.uint32)
    width = window - gram + 1
    low = windows_min(order, width)
    # a gram is an anchor if it equals the minimum of one of the windows that hold it
    pad = np.zeros(width - 1, np.uint32)
    reach = ~windows_min(~np.concatenate([pad, low, pad]), width)
    at = np.flatnonzero(order == reach)
    return at, h[at], low
