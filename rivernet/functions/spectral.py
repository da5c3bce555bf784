"""Spectra of kernels, Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import sampling

FLOOR = 1e-8


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _lists(values: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), flat)


def log_of(h: np.ndarray) -> np.ndarray:
    """The logarithm of the real transform of rows, magnitude floored at 1e-8; the phase is its imaginary part."""
    z = np.fft.rfft(h, axis=1)
    return np.log(np.maximum(np.abs(z), FLOOR)) + 1j * np.angle(z)


def weights_of(log: np.ndarray, n: int, substeps: int, mode: str) -> np.ndarray:
    """Weights at the native step of rows of logarithms: inverse transform, negative weights cut, resampled, sum 1 (all 0 where nothing is left)."""
    fine = np.maximum(np.fft.irfft(np.exp(log), n=n, axis=1), 0)
    w = sampling.reduce_kernel(fine, substeps, mode)
    total = w.sum(axis=1, keepdims=True)
    return w / np.where(total > 0, total, 1)


def _mapped(df: DataFrame, source: str, target: str, f) -> DataFrame:
    """Replaces the array column ``source`` by ``target`` = f(matrix)."""
    others = [c for c in df.columns if c != source]
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField(target, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), _lists(f(_matrix(b.column(source))))], names=[*others, target])

    return df.select(*others, source).mapInArrow(run, schema)


def log_spectrum(df: DataFrame, source: str = "irf", target: str = "spectrum") -> DataFrame:
    """Log amplitudes (magnitude floored at 1e-8), then phases, of the real transform of an array column."""

    def f(h: np.ndarray) -> np.ndarray:
        log = log_of(h)
        return np.hstack((log.real, log.imag))

    return _mapped(df, source, target, f)


def from_log_spectrum(df: DataFrame, n: int, source: str = "spectrum", target: str = "irf") -> DataFrame:
    """The array of ``n`` samples whose log spectrum is given."""
    return _mapped(df, source, target, lambda s: np.fft.irfft(np.exp(np.hsplit(s, 2)[0] + 1j * np.hsplit(s, 2)[1]), n=n, axis=1))


def kernel_weights(df: DataFrame, n: int, substeps: int, mode: str, source: str = "spectrum", target: str = "weights") -> DataFrame:
    """Path kernels at the native step: inverse transform, negative weights cut, resampled, sum 1 (all 0 where nothing is left)."""

    def f(s: np.ndarray) -> np.ndarray:
        log, phase = np.hsplit(s, 2)
        return weights_of(log + 1j * phase, n, substeps, mode)

    return _mapped(df, source, target, f)
