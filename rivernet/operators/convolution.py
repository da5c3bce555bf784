"""Causal convolution of sparse series with path kernels, and its adjoints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closure import upstream_fold
from .kernel import to_blocks

STRATEGIES = ("long", "packed", "blocks")
PACKED_CELLS = 1 << 20
TILE, BLOCK = 1024, 16  # steps of a tile, reaches of a block
DIRECT = 4  # products of a step and a lag that cost as much as one step of a transform's butterflies


def convolve(runoff: DataFrame, kernel: DataFrame, steps: int, strategy: str = "long", tile: int = TILE) -> DataFrame:
    """batch, reach_id, t, value: y[dst, t] = sum of weight[lag] * x[src, t - lag] for 0 <= t < steps.

    Rows exist where flow arrives; none means 0.  "long" joins single steps and
    lags.  "packed" joins tiles of ``tile`` steps of a series with the weights of
    a pair, "blocks" tiles of BLOCK reaches with the weights of BLOCK x BLOCK
    pairs (ids that lie close should drain close, as those of ``intervals`` do).
    What a tile gives beyond its end is added to the next ones, so that no row
    grows with the number of steps.  All give the same rows.
    """
    if strategy not in STRATEGIES:
        raise NotImplementedError(f"strategy {strategy!r}; there are {STRATEGIES}")
    if strategy == "long":
        return _long(runoff, kernel, steps)
    return (_packed if strategy == "packed" else _blocks)(runoff, kernel, steps, tile)


def _long(runoff: DataFrame, kernel: DataFrame, steps: int) -> DataFrame:
    x = runoff.select("batch", F.col("reach_id").alias("src"), F.col("t").alias("t_in"), "value")
    both = x.join(kernel.select("src", "dst", "weights"), "src").select("batch", "dst", "t_in", "value", F.posexplode("weights").alias("lag", "weight"))
    flow = both.select("batch", F.col("dst").alias("reach_id"), (F.col("t_in") + F.col("lag")).alias("t"), (F.col("value") * F.col("weight")).alias("value"))
    return flow.filter((F.col("t") >= 0) & (F.col("t") < steps)).groupBy("batch", "reach_id", "t").agg(F.sum("value").alias("value"))


def _tiles(rows: DataFrame, keys: dict[str, str], tile: int, *more: str) -> DataFrame:
    """keys (new name: column), tile, x: the (more, at, value) of each tile."""
    of = F.floor(F.col("t") / tile).cast("int")
    entry = F.struct(*more, (F.col("t") - of * tile).cast("int").alias("at"), "value")
    return rows.groupBy(*(F.col(c).alias(n) for n, c in keys.items()), of.alias("tile")).agg(F.collect_list(entry).alias("x"))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(n, -1)


def _series(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """For each row the place of its (batch, reach_id, tile) among the different ones, and a row of each."""
    names = batch.column("batch").dictionary_encode()
    name = np.asarray(names.indices.fill_null(len(names.dictionary))).astype(np.int64)
    key = np.stack((name, np.asarray(batch.column("reach_id")), np.asarray(batch.column("tile")).astype(np.int64)))
    _, first, member = np.unique(key, axis=1, return_index=True, return_inverse=True)
    return member.reshape(-1), first


def _arrived(batch: pa.RecordBatch, first: np.ndarray, total: np.ndarray, hits: np.ndarray, tile: int, steps: int) -> pa.RecordBatch:
    """Long rows of ``total`` [series, steps from the tile's start] where anything arrives."""
    of, at = np.nonzero(hits)
    t = np.asarray(batch.column("tile")).astype(np.int64)[first][of] * tile + at
    inside = t < steps
    of, at, t = of[inside], at[inside], t[inside]
    row = pa.array(first[of])
    return pa.RecordBatch.from_arrays([batch.column("batch").take(row), batch.column("reach_id").take(row), pa.array(t.astype(np.int32)), pa.array(total[of, at])], names=["batch", "reach_id", "t", "value"])


def _packed(runoff: DataFrame, kernel: DataFrame, steps: int, tile: int) -> DataFrame:
    x = _tiles(runoff.filter(F.col("t").between(0, steps - 1)), {"batch": "batch", "src": "reach_id"}, tile)
    both = x.join(kernel.select("src", "dst", "weights"), "src").select("batch", F.col("dst").alias("reach_id"), "tile", "x", "weights")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            width = len(whole.column("weights")[0]) if whole.num_rows else 1
            span = tile + width - 1
            for start in range(0, whole.num_rows, max(1, PACKED_CELLS // span)):
                b = whole.slice(start, max(1, PACKED_CELLS // span))
                n = b.num_rows
                x, w = b.column("x"), _matrix(b.column("weights"), n)
                row = np.repeat(np.arange(n), np.diff(np.asarray(x.offsets)))
                at, value = (np.asarray(x.flatten().field(i)) for i in (0, 1))
                member, first = _series(b)  # what meets at a reach is added up here already; the groupBy adds what other batches bring
                shape = len(first), span
                if len(row) * width <= DIRECT * n * span * np.log2(2 * span):
                    cell = member[row][:, None] * span + at[:, None] + np.arange(width)
                    total = np.bincount(cell.reshape(-1), (value[:, None] * w[row]).reshape(-1), len(first) * span).reshape(shape)
                else:
                    size = 1 << (span - 1).bit_length()
                    dense = np.bincount(row * tile + at, value, n * tile).reshape(n, tile)
                    z = np.fft.rfft(dense, size, axis=1) * np.fft.rfft(w, size, axis=1)
                    total = np.zeros((len(first), z.shape[1]), complex)
                    np.add.at(total, member, z)
                    total = np.fft.irfft(total, size, axis=1)[:, :span]
                begun = np.bincount(member[row] * (span + 1) + at, minlength=len(first) * (span + 1)) - np.bincount(member[row] * (span + 1) + at + width, minlength=len(first) * (span + 1))[: len(first) * (span + 1)]
                yield _arrived(b, first, total, np.cumsum(begun.reshape(len(first), span + 1), axis=1)[:, :span] > 0, tile, steps)

    return _added(both, runoff, run)


def _added(both: DataFrame, runoff: DataFrame, run) -> DataFrame:
    kind = runoff.schema["batch"].dataType.simpleString()
    flow = both.mapInArrow(run, f"batch {kind}, reach_id long, t int, value double")
    return flow.groupBy("batch", "reach_id", "t").agg(F.sum("value").alias("value"))


def _blocks(runoff: DataFrame, kernel: DataFrame, steps: int, tile: int, block: int = BLOCK) -> DataFrame:
    own = runoff.filter(F.col("t").between(0, steps - 1)).select("batch", "t", "value", F.expr(f"reach_id div {block}").alias("block_col"), F.pmod("reach_id", F.lit(block)).cast("int").alias("col"))
    x = _tiles(own, {"batch": "batch", "block_col": "block_col"}, tile, "col")
    cells = to_blocks(kernel, block).groupBy("block_row", "block_col").agg(F.collect_list(F.struct("row", "col", "weights")).alias("cells"))  # block * block of them at most
    both = x.join(cells, "block_col").select("batch", F.col("block_row").alias("reach_id"), "tile", "x", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                b = whole.slice(i, 1)
                cells, x = b.column("cells").flatten(), b.column("x").flatten()
                weights = _matrix(cells.field(2), len(cells))
                width = weights.shape[1]
                span = tile + width - 1
                col, at, value = (np.asarray(x.field(k)) for k in range(3))
                series = np.zeros((block, span + width - 1))  # a window's length of zeros first
                np.add.at(series, (col, at + width - 1), value)
                matrix, held = np.zeros((block, block, width)), np.zeros((block, block), bool)
                row, column = np.asarray(cells.field(0)), np.asarray(cells.field(1))
                matrix[row, column], held[row, column] = weights, True
                shifted = np.lib.stride_tricks.sliding_window_view(series, width, axis=1)[:, :, ::-1]  # [col, t, lag]
                total = np.tensordot(matrix, shifted, ([1, 2], [0, 2]))
                there = np.zeros((block, span + 1), np.int64)
                np.add.at(there, (col, at), 1)
                np.add.at(there, (col, at + width), -1)
                hits = held.astype(np.int64) @ (np.cumsum(there, axis=1)[:, :span] > 0) > 0
                of, t = np.nonzero(hits)
                inside = (step := b.column("tile")[0].as_py() * tile + t) < steps
                n = int(inside.sum())
                reach = b.column("reach_id")[0].as_py() * block + of[inside]
                yield pa.RecordBatch.from_arrays([b.column("batch").take(pa.array(np.zeros(n, np.int64))), pa.array(reach), pa.array(step[inside].astype(np.int32)), pa.array(total[of[inside], t[inside]])], names=["batch", "reach_id", "t", "value"])

    return _added(both, runoff, run)


def densify(flow: DataFrame, reaches: DataFrame, batches: list, steps: int) -> DataFrame:
    """A row for every one of the named batches, every reach and step; 0 where nothing flows."""
    grid = reaches.select(F.explode(F.array(*map(F.lit, batches))).alias("batch"), "reach_id").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return grid.join(flow, ["batch", "reach_id", "t"], "left").select("batch", "reach_id", "t", F.coalesce("value", F.lit(0.0)).alias("value"))


def adjoint_runoff(gradient: DataFrame, kernel: DataFrame) -> DataFrame:
    """dx[src, t - lag] += weight * dy[dst, t]."""
    dy = gradient.select("batch", F.col("reach_id").alias("dst"), F.col("t").alias("t_out"), "value")
    both = dy.join(kernel.select("src", "dst", "weights"), "dst").select("batch", "src", "t_out", "value", F.posexplode("weights").alias("lag", "weight"))
    dx = both.select("batch", F.col("src").alias("reach_id"), (F.col("t_out") - F.col("lag")).alias("t"), (F.col("value") * F.col("weight")).alias("value"))
    return dx.filter("t >= 0").groupBy("batch", "reach_id", "t").agg(F.sum("value").alias("value"))


def adjoint_kernel(gradient: DataFrame, runoff: DataFrame, pairs: DataFrame, window: int, tile: int = TILE) -> DataFrame:
    """dst, src, lag, value: sum over batches and steps of dy[dst, t] * x[src, t - lag].

    Tiles of both series meet at each pair; a tile of the gradient holds the
    ``window`` - 1 steps behind it too.  A pair's lags are summed in its batch of
    rows before they are shuffled.
    """
    x = _tiles(runoff, {"batch": "batch", "src": "reach_id"}, tile).withColumnRenamed("x", "x_in")
    last, back = F.floor(F.col("t") / tile).cast("int"), F.floor((F.col("t") - (window - 1)) / tile).cast("int")
    ahead = gradient.select("batch", F.col("reach_id").alias("dst"), "t", "value", F.explode(F.sequence(back, last)).alias("tile"))
    dy = ahead.groupBy("batch", "dst", "tile").agg(F.collect_list(F.struct((F.col("t") - F.col("tile") * tile).cast("int").alias("at"), "value")).alias("x_out"))
    both = x.join(pairs.select("dst", "src"), "src").join(dy, ["batch", "dst", "tile"]).select("dst", "src", "x_in", "x_out")
    span = tile + window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = max(1, PACKED_CELLS // span)
            for start in range(0, whole.num_rows, size):
                b = whole.slice(start, size)
                n = b.num_rows

                def dense(name: str, width: int, b=b, n=n) -> tuple[np.ndarray, np.ndarray]:
                    rows = b.column(name)
                    cell = np.repeat(np.arange(n), np.diff(np.asarray(rows.offsets))) * width + np.asarray(rows.flatten().field(0))
                    return np.bincount(cell, np.asarray(rows.flatten().field(1)), n * width).reshape(n, width), (np.bincount(cell, minlength=n * width) > 0).reshape(n, width)

                (x, has_x), (y, has_y) = dense("x_in", tile), dense("x_out", span)
                value = np.stack([np.einsum("ij,ij->i", x, y[:, lag : lag + tile]) for lag in range(window)], axis=1)
                hits = np.stack([(has_x & has_y[:, lag : lag + tile]).any(axis=1) for lag in range(window)], axis=1)
                _, first, member = np.unique(np.stack((np.asarray(b.column("dst")), np.asarray(b.column("src")))), axis=1, return_index=True, return_inverse=True)
                total, met = np.zeros((len(first), window)), np.zeros((len(first), window), bool)
                np.add.at(total, member.reshape(-1), value)
                np.logical_or.at(met, member.reshape(-1), hits)
                of, lag = np.nonzero(met)
                row = pa.array(first[of])
                yield pa.RecordBatch.from_arrays([b.column("dst").take(row), b.column("src").take(row), pa.array(lag.astype(np.int32)), pa.array(total[of, lag])], names=["dst", "src", "lag", "value"])

    found = both.mapInArrow(run, "dst long, src long, lag int, value double")
    return found.groupBy("dst", "src", "lag").agg(F.sum("value").alias("value"))


def adjoint_closure(gradient: DataFrame, reaches: DataFrame) -> DataFrame:
    """reach_id, value: of path values prefix[src] - prefix[downstream of dst], what falls to each prefix."""
    plus = gradient.select(F.col("src").alias("reach_id"), "value")
    down = reaches.filter("downstream_id IS NOT NULL").select(F.col("reach_id").alias("dst"), "downstream_id")
    minus = gradient.join(down, "dst").select(F.col("downstream_id").alias("reach_id"), (-F.col("value")).alias("value"))
    return plus.unionByName(minus).groupBy("reach_id").agg(F.sum("value").alias("value"))


def adjoint_downstream_sum(gradient: DataFrame, reaches: DataFrame) -> DataFrame:
    """reach_id, value: the sum over all reaches upstream, itself included (flow accumulation); no row counts as 0."""
    given = reaches.select("reach_id", "downstream_id").join(gradient.select("reach_id", "value"), "reach_id", "left")
    return upstream_fold(given, {"value": F.coalesce("value", F.lit(0.0))}).select("reach_id", "value")
