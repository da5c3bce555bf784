"""Path kernels: the weights with which runoff at src comes to dst, and other views of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import settled
from ..functions import sampling, spectral
from ..functions.irf import Irf, get_irf
from .closure import closure, downstream_sum, running_total
from .network import RiverNetwork


def responses(network: RiverNetwork, window: int, substeps: int = 1) -> DataFrame:
    """reach_id, downstream_id, irf: each reach's own weights, ``window * substeps`` of them."""
    if window < 1 or substeps < 1:
        raise ValueError("window and substeps are positive integers")
    irf = get_irf(network.irf)
    n, dt = window * substeps, 1 / substeps
    if irf.vectorised:
        return _vectorised(network.reaches.select("reach_id", "downstream_id", *(F.col(p).cast("double").alias(p) for p in irf.params)), irf, n, dt)
    weights = irf.build({p: F.col(p) for p in irf.params}, n, dt)
    return network.reaches.select("reach_id", "downstream_id", weights.alias("irf"))


def _vectorised(rows: DataFrame, irf: Irf, n: int, dt: float) -> DataFrame:
    weigh, params, name = irf.vectorised, irf.params, irf.name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            weights = np.asarray(weigh({p: np.asarray(b.column(p)) for p in params}, n, dt), np.float64)
            if weights.shape != (b.num_rows, n):
                raise ValueError(f"{name} gave weights of shape {weights.shape} for {b.num_rows} reaches of {n} samples")
            yield pa.RecordBatch.from_arrays([b.column("reach_id"), b.column("downstream_id"), spectral._lists(weights)], names=["reach_id", "downstream_id", "irf"])

    return rows.mapInArrow(run, "reach_id long, downstream_id long, irf array<double>")


def path_spectra(network: RiverNetwork, window: int, substeps: int = 1, pairs: DataFrame | None = None) -> DataFrame:
    """dst, src, spectrum: log spectrum of the product over the path, as a difference of two sums to the outlet."""
    spectra = spectral.log_spectrum(responses(network, window, substeps))
    sums = downstream_sum(spectra, "spectrum")
    pairs = closure(network.reaches, network.include_self) if pairs is None else pairs
    below = network.edges().join(sums.select(F.col("reach_id").alias("downstream_id"), F.col("spectrum").alias("below")), "downstream_id").select(F.col("reach_id").alias("dst"), "below")
    joined = pairs.join(sums.select(F.col("reach_id").alias("src"), "spectrum"), "src").join(below, "dst", "left")
    path = F.when(F.col("below").isNull(), F.col("spectrum")).otherwise(F.zip_with("spectrum", "below", lambda a, b: a - b))
    return joined.select("dst", "src", path.alias("spectrum"))


def build_kernel(network: RiverNetwork, window: int, substeps: int = 1, mode: str = "avg", pairs: DataFrame | None = None) -> DataFrame:
    """dst, src, weights (lag 0 first), each row summing to 1.

    The product over a path is circular with period ``window * substeps``; it is
    cut at 0 and brought to the native step before it is normalised.
    """
    sampling.check_mode(mode)
    return spectral.kernel_weights(path_spectra(network, window, substeps, pairs), window * substeps, substeps, mode)


def long_kernel(kernel: DataFrame) -> DataFrame:
    """dst, src, lag, weight."""
    return kernel.select("dst", "src", F.posexplode("weights").alias("lag", "weight"))


def drop_zero_rows(kernel: DataFrame) -> DataFrame:
    return kernel.filter(F.exists("weights", lambda w: w != 0))


def to_blocks(kernel: DataFrame, block: int, flip: bool = False) -> DataFrame:
    """block_row, block_col, row, col, weights of ids that count from 0; of cells given twice one stays."""
    w = F.reverse("weights") if flip else F.col("weights")
    cells = kernel.select(F.expr(f"dst div {block}").alias("block_row"), F.expr(f"src div {block}").alias("block_col"), F.expr(f"CAST(dst % {block} AS INT)").alias("row"), F.expr(f"CAST(src % {block} AS INT)").alias("col"), w.alias("weights"))
    return cells.dropDuplicates(["block_row", "block_col", "row", "col"])


def block_index(blocks: DataFrame) -> DataFrame:
    """block, block_row, block_col, cells: the blocks that hold anything, numbered by row and column."""
    counts = settled(blocks.groupBy("block_row", "block_col").agg(F.count("*").alias("cells")))
    rows = settled(counts.groupBy("block_row").agg(F.count("*").alias("n")))
    base = running_total(rows, "block_row", "n", "total").select("block_row", (F.col("total") - F.col("n")).alias("base"))
    nth = F.row_number().over(W.partitionBy("block_row").orderBy("block_col"))
    return counts.withColumn("nth", nth).join(base, "block_row").select((F.col("base") + F.col("nth") - 1).alias("block"), "block_row", "block_col", "cells")


def from_blocks(blocks: DataFrame, block: int, height: int | None = None, width: int | None = None, drop_zeros: bool = True) -> DataFrame:
    """dst, src, weights of the cells inside ``height`` x ``width``."""
    kernel = blocks.select((F.col("block_row") * block + F.col("row")).alias("dst"), (F.col("block_col") * block + F.col("col")).alias("src"), "weights")
    for name, most in (("dst", height), ("src", width)):
        kernel = kernel if most is None else kernel.filter(F.col(name) < most)
    return drop_zero_rows(kernel) if drop_zeros else kernel


def from_responses(responses: DataFrame, window: int) -> DataFrame:
    """dst, src, weights of given responses(dst, src, lag, weight): lags without a row are 0, rows given twice add up."""
    rows = responses.filter(F.col("lag").between(0, window - 1)).groupBy("dst", "src", "lag").agg(F.sum("weight").alias("weight"))
    at = rows.groupBy("dst", "src").agg(F.map_from_entries(F.collect_list(F.struct("lag", "weight"))).alias("at"))
    lags = F.sequence(F.lit(0), F.lit(window - 1))
    return at.select("dst", "src", F.transform(lags, lambda lag: F.coalesce(F.try_element_at("at", lag), F.lit(0.0))).alias("weights"))


def blocks_to_dense(blocks: DataFrame, block: int, window: int, height: int | None = None, width: int | None = None) -> DataFrame:
    """dst, src, lag, weight of every cell of the blocks that hold anything, inside ``height`` x ``width``."""
    side = F.sequence(F.lit(0), F.lit(block - 1))
    cells = blocks.select("block_row", "block_col").distinct().withColumn("row", F.explode(side)).withColumn("col", F.explode(side))
    held = cells.join(blocks, ["block_row", "block_col", "row", "col"], "left")
    weights = F.coalesce("weights", F.array_repeat(F.lit(0.0), window))
    return long_kernel(from_blocks(held.withColumn("weights", weights), block, height, width, drop_zeros=False))


def to_dense(kernel: DataFrame, of: DataFrame, window: int) -> DataFrame:
    """dst, src, lag, weight of every cell among the reaches of the small table ``of(reach_id)``; weights given twice add up."""
    ids = of.select("reach_id").distinct()
    names = [r.reach_id for r in ids.limit(1_001).collect()]
    if len(names) > 1_000:
        raise ValueError("a dense kernel is for at most 1,000 reaches")
    lags = F.explode(F.sequence(F.lit(0), F.lit(window - 1)))
    every = F.explode(F.array(*map(F.lit, names)).cast("array<bigint>"))
    grid = ids.select(F.col("reach_id").alias("dst"), every.alias("src")).select("dst", "src", lags.alias("lag"))
    cells = long_kernel(kernel).groupBy("dst", "src", "lag").agg(F.sum("weight").alias("weight"))
    return grid.join(cells, ["dst", "src", "lag"], "left").select("dst", "src", "lag", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def to_dense_groups(kernel: DataFrame, of: DataFrame, window: int) -> DataFrame:
    """dst, src, lag, weight of every cell among reaches of one group of ``of(reach_id, grp)``; weights given twice add up.

    A matrix for each group, as large as the square of its reaches: for groups of
    a bounded size, such as the pieces of a schedule, of which there may be any
    number.
    """
    rows, columns = (of.select("grp", F.col("reach_id").alias(c)) for c in ("dst", "src"))
    held = kernel.join(rows, "dst").join(columns, ["grp", "src"]).groupBy("dst", "src", "grp").agg(F.collect_list("weights").alias("all"))  # a kernel has a row a pair, unless it was put together by hand
    zeros = F.array_repeat(F.lit(0.0), window)
    total = F.aggregate(F.col("all"), zeros, lambda a, w: F.zip_with(a, w, lambda x, y: x + y))
    grid = rows.join(columns, "grp").join(held, ["grp", "dst", "src"], "left")
    return grid.select("dst", "src", F.posexplode(F.when(F.col("all").isNull(), zeros).otherwise(total)).alias("lag", "weight"))
