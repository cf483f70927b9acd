"""Hashed word shingles of whole texts, vectorised over batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd

BLOCK = 1 << 18  # bytes hashed at a time; bounds memory, changes no result
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS: list[np.ndarray] = []


def pieces(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """The same rows in batches of `rows` at most, so that what a function makes of a batch stays small beside it."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.iloc[k : k + rows]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * BLOCK)
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, b, dtype=np.uint64)]) for b in (BASE, BASE_INVERSE)]
    return _POWERS[0], _POWERS[1]


def _blanks(buf: np.ndarray) -> np.ndarray:
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


def _hash_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a buffer (A-Z lower-cased), and where they start."""
    edge = np.diff(np.r_[np.int8(0), (~_blanks(buf)).view(np.int8), np.int8(0)])
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lower = np.where((buf >= 65) & (buf <= 90), buf + 32, buf)
    power, inverse = _powers(len(buf) + 1)
    sums = np.r_[np.uint64(0), np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * power[: len(buf)])]
    value = (sums[stop] - sums[start]) * inverse[start]
    return mixed(value + (stop - start).astype(np.uint64) * STEP), start


def word_hashes(texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of words, words per row) for runs of rows, in order; words are `[^\\x20\\x09-\\x0D]+`."""
    at = 0
    while at < len(texts):
        parts, size, end = [], 0, at
        while end < len(texts) and (size == 0 or size < BLOCK):
            parts.append((texts[end] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            end += 1
        if size <= 4 * BLOCK:
            hashes, start = _hash_words(np.frombuffer(b" ".join(parts), dtype=np.uint8))
            begin = np.cumsum([0, *[len(p) + 1 for p in parts]])
            yield at, hashes, np.diff(np.searchsorted(start, begin))
        else:  # the last row is very long: the others first, then it in pieces cut at blanks
            if end - at > 1:
                yield from ((at + i, h, n) for i, h, n in word_hashes(texts[at : end - 1]))
            buf, found, lo = np.frombuffer(parts[-1], dtype=np.uint8), [], 0
            while lo < len(buf):
                hi = min(lo + BLOCK, len(buf))
                while hi < len(buf) and not _blanks(buf[hi : hi + 1])[0]:
                    hi += 1
                found.append(_hash_words(buf[lo:hi])[0])
                lo = hi
            hashes = np.concatenate(found)
            yield end - 1, hashes, np.array([len(hashes)])
        at = end


def shingle_rows(texts: Sequence[str | None], width: int) -> Iterator[np.ndarray]:
    """Per row the hashes of its `width`-word shingles in order, repeats included; a row with fewer words has its whole
    sequence as one, a row without words none."""
    factor = np.uint64(0xC2B2AE3D27D4EB4F)
    for _, hashes, counts in word_hashes(texts):
        combined = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
        for k in range(width):
            combined = combined * factor + hashes[k : k + len(combined)]
        combined = mixed(combined)
        begin = 0
        for n in counts.tolist():
            if n >= width:
                yield combined[begin : begin + n - width + 1]
            elif n:
                value = np.uint64(n)
                for h in hashes[begin : begin + n]:
                    value = np.uint64((int(value) * int(factor) + int(h)) & 0xFFFFFFFFFFFFFFFF)
                yield mixed(np.array([value ^ STEP], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)
            begin += n
