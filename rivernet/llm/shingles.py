"""Word shingles of UTF-8 texts as sorted 64-bit hashes, by whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SEGMENT = 1 << 21
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C17
_BASE_INV = pow(_BASE, -1, 1 << 64)
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[32, *range(9, 14)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i mod 2 ** 64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, SEGMENT + 1), np.uint64)
        have[0] = 1
        have[1:] = np.uint64(base)
        _powers[base] = np.multiply.accumulate(have)
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Pieces of about SEGMENT bytes that end behind a blank (or where the data do)."""
    at = 0
    while at < len(data):
        end = at + SEGMENT
        if end < len(data):
            while end < len(data) and not _IS_WHITE[data[end]]:
                end += 1
        yield at, data[at:end]
        at = end


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word in bytes that are lower-cased already."""
    starts, hashes = [], []
    for at, piece in _segments(data):
        buf = np.frombuffer(piece, np.uint8)
        word = np.concatenate(([False], ~_IS_WHITE[buf], [False])).view(np.int8)
        edge = np.diff(word)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * powers(_BASE, len(buf)), out=total[1:])
        starts.append(start + at)
        hashes.append(mixed((total[end] - total[start]) * powers(_BASE_INV, len(buf) + 1)[start] + (end - start).astype(np.uint64)))
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, np.uint64))


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than texts) and the sorted different shingle hashes of each text.

    Fewer words than ``width`` make one shingle; no words make none.
    """
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.concatenate(([0], np.cumsum(lengths)))
    start, word = word_hashes(b"\n".join(texts).lower())
    bound = np.searchsorted(start, first)  # words of text i: bound[i] to bound[i + 1]
    n = np.diff(bound)
    doc = np.repeat(np.arange(len(texts)), n)
    rest = np.repeat(bound[1:], n) - np.arange(len(word))  # words from here to the text's end
    h = np.zeros(len(word), np.uint64)
    for j in range(min(width, len(word))):
        h[: len(word) - j if j else None] += np.where(rest[: len(word) - j if j else None] > j, word[j:] * _PLACE[j], np.uint64(0))
    short = np.repeat(n, n)
    is_first = np.arange(len(word)) == np.repeat(bound[:-1], n)
    take = (rest >= width) | ((short < width) & is_first)
    h = mixed(h + np.minimum(short, width).astype(np.uint64))[take]
    doc = doc[take]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.searchsorted(doc[new], np.arange(len(texts) + 1)), h[new]
