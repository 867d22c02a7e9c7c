"""Vectorised words, word hashes, phrases and minimisers over whole Arrow text columns.

Words are runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text. All hashes are
64-bit and depend on the words alone, never on where a batch or partition begins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MOD = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_BASE, _SEGMENT)
_INVERSE_LOW = _powers(_INVERSE, 1 << 16)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Words:
    """Words of a run of texts: byte starts and ends, ``offsets`` (first word of each text, and the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def split_words(column: pa.Array, lower: bool = False, hashed: bool = True) -> Words:
    """Words of each text. Memory beyond the result is bounded by a fixed segment of bytes."""
    data, at = text_buffer(column)
    if lower:
        data = LOWER[data]
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins = solid.copy()
    begins[1:] &= edge[1:-1] | ~solid[:-1]
    finishes = solid.copy()
    finishes[:-1] &= edge[1:-1] | ~solid[1:]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(finishes) + 1
    offsets = np.searchsorted(starts, at).astype(np.int64)
    hashes = _hash_words(data, starts, ends) if hashed else np.zeros(0, np.uint64)
    return Words(data, starts, ends, offsets, hashes)


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each byte range from prefix sums, taken segment by segment."""
    left, right = np.zeros(len(starts), np.uint64), np.zeros(len(ends), np.uint64)
    carry, scale = 0, 1
    for begin in range(0, len(data), _SEGMENT):
        part = data[begin : begin + _SEGMENT]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(part)], out=sums[1:])
        for points, out in ((starts, left), (ends, right)):
            lo, hi = np.searchsorted(points, [begin + (begin > 0), begin + len(part) + 1])
            out[lo:hi] = sums[points[lo:hi] - begin] * np.uint64(scale) + np.uint64(carry)
        carry = (carry + int(sums[-1]) * scale) & _MOD
        scale = scale * pow(_BASE, len(part), 1 << 64) & _MOD
    h = (right - left) * _INVERSE_LOW[starts & 0xFFFF]
    high = starts >> 16
    if len(high) and high[-1]:
        h *= _powers(pow(_INVERSE, 1 << 16, 1 << 64), int(high[-1]) + 1)[high]
    return mix(h)


def phrases(hashes: np.ndarray, length: int, seed: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hash of every run of ``length`` words, at its first word; the last length-1 places hold nothing of use."""
    seed |= 1
    if len(hashes) < length:
        return np.zeros(len(hashes), np.uint64)
    total, have, block, size = None, 0, hashes, 1
    while True:
        if length & size:
            if total is None:
                total, have = block, size
            else:
                n = len(hashes) - have - size + 1
                total = total[:n] * np.uint64(pow(seed, size, 1 << 64)) + block[have : have + n]
                have += size
        if have == length:
            break
        n = len(block) - size
        block = block[:n] * np.uint64(pow(seed, size, 1 << 64)) + block[size:] if n > 0 else block[:0]
        size *= 2
    out = np.zeros(len(hashes), np.uint64)
    out[: len(total)] = mix(total)
    return out


def starts_of_windows(offsets: np.ndarray, length: int) -> np.ndarray:
    """For each word, whether a window of ``length`` words of the same text starts there."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    return np.arange(len(ends)) + length <= ends


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over values[i : i + width], for every i with a whole window."""
    out, size = values, 1
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[: len(out) - (width - size)], out[width - size :]) if size < width else out


def minimisers(words: Words, phrase: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of phrases that are least within some window of ``width`` consecutive phrases, and their hashes.

    Equal runs of phrase + width - 1 words choose the same places, and neighbouring places
    within a text of at least that length lie at most ``width`` words apart.
    """
    h, n = phrases(words.hashes, phrase), len(words.hashes)
    if n < phrase + width - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = starts_of_windows(words.offsets, phrase + width - 1)
    least = np.zeros(n + width - 1, np.uint64)
    lows = _slide(h, width, np.minimum)
    least[width - 1 : width - 1 + len(lows)] = np.where(whole[: len(lows)], lows, 0)
    chosen = np.flatnonzero((_slide(least, width, np.maximum) == h) & (h > 0) & starts_of_windows(words.offsets, phrase))
    return chosen, h[chosen]
