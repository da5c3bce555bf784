"""Between the routing step and the native step, ``substeps`` of the one in one of the other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("avg", "sample")


def check_mode(mode: str) -> None:
    if mode not in MODES:
        raise NotImplementedError(f"sampling mode {mode!r}; there are {MODES}")


def reduce_kernel(fine: np.ndarray, substeps: int, mode: str) -> np.ndarray:
    """Rows of fine weights at the native step: triangular filter (avg) or block sums (sample)."""
    check_mode(mode)
    if substeps == 1:
        return fine
    blocks = fine.reshape(len(fine), -1, substeps)
    if mode == "sample":
        return blocks.sum(axis=2)
    later = np.arange(substeps) / substeps
    out = blocks @ (1 - later)
    out[:, 1:] += (blocks @ later)[:, :-1]
    return out


def reduce_kernel_back(coarse: np.ndarray, substeps: int, mode: str) -> np.ndarray:
    """The adjoint of ``reduce_kernel``: a gradient by weights at the native step as one by fine weights."""
    check_mode(mode)
    if substeps == 1:
        return coarse
    if mode == "sample":
        return np.repeat(coarse, substeps, axis=1)
    later = np.arange(substeps) / substeps
    ahead = np.hstack((coarse[:, 1:], np.zeros((len(coarse), 1))))
    return (coarse[:, :, None] * (1 - later) + ahead[:, :, None] * later).reshape(len(coarse), -1)


def upsample(series: DataFrame, substeps: int, value: str = "value") -> DataFrame:
    """Holds each value over ``substeps`` fine steps; the total stays."""
    if substeps == 1:
        return series
    fine = series.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(substeps - 1))))
    return fine.withColumns({"t": F.col("t") * substeps + F.col("_j"), value: F.col(value) / substeps}).drop("_j")


def pool(series: DataFrame, substeps: int, keys: list[str], value: str = "value") -> DataFrame:
    """Sums of blocks of fine steps."""
    return series.groupBy(*keys, F.expr(f"CAST(floor(t / {substeps}) AS INT)").alias("t")).agg(F.sum(value).alias(value))


def take_last(series: DataFrame, substeps: int, value: str = "value") -> DataFrame:
    """The last fine step of each block, scaled to the block."""
    return series.filter(F.col("t") % substeps == substeps - 1).withColumns({"t": F.expr(f"CAST(floor(t / {substeps}) AS INT)"), value: F.col(value) * substeps})


def triangle(series: DataFrame, substeps: int, keys: list[str], window: int, value: str = "value") -> DataFrame:
    """Triangular filter: each fine step gives to its block and, the later the more, to the next one."""
    if substeps == 1:
        return series
    late = (F.col("t") % substeps) / substeps
    shares: Column = F.array(F.struct(F.lit(0).alias("d"), (1 - late).alias("s")), F.struct(F.lit(1).alias("d"), late.alias("s")))
    both = series.withColumn("_p", F.explode(shares))
    both = both.withColumns({"t": (F.floor(F.col("t") / substeps) + F.col("_p.d")).cast("int"), value: F.col(value) * F.col("_p.s")})
    return both.filter(F.col("t") < window).groupBy(*keys, "t").agg(F.sum(value).alias(value))
