"""Runs of chosen bytes in UTF-8 texts as 64-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shingles import _BASE, _BASE_INV, _BYTE, mixed, powers

SEGMENT = 1 << 20


def byte_set(*members: int | range) -> np.ndarray:
    """bool[256] of the bytes named."""
    out = np.zeros(256, bool)
    for m in members:
        out[list(m) if isinstance(m, range) else [m]] = True
    return out


def runs_of(data: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every maximal run of bytes that are ``inside``; equal runs hash alike wherever they lie."""
    starts, ends, hashes, at = [], [], [], 0
    while at < len(data):
        end = at + SEGMENT
        while end < len(data) and inside[data[end]]:  # no run is cut
            end += 1
        buf = np.frombuffer(data[at:end], np.uint8)
        edge = np.diff(np.concatenate(([False], inside[buf], [False])).view(np.int8))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * powers(_BASE, len(buf)), out=total[1:])
        starts.append(start + at)
        ends.append(stop + at)
        hashes.append(mixed((total[stop] - total[start]) * powers(_BASE_INV, len(buf) + 1)[start] + (stop - start).astype(np.uint64)))
        at = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def some_texts(batches: Iterator[pa.RecordBatch], column: str, most: int, rows: int = 1 << 16) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, their texts as bytes) of about ``most`` bytes of text; null is empty, a longer text comes alone."""
    held: list[pa.RecordBatch] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        first = 0
        for i, value in enumerate(batch.column(column)):
            data = value.as_buffer().to_pybytes() if value.is_valid else b""
            texts.append(data)
            size += len(data)
            if size >= most or len(texts) >= rows:
                held.append(batch.slice(first, i + 1 - first))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], texts
                held, texts, size, first = [], [], 0, i + 1
        if first < batch.num_rows:
            held.append(batch.slice(first))
    if texts:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], texts
