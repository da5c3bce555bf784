"""Gradients of a loss by channel parameters, backwards through routing.

Routing goes from parameters to responses, their log spectra, sums to the outlet,
path spectra, weights and discharge.  The gradient goes back the same way, each
step as the adjoint of its own: what the loss says of discharge falls to the
weights of every pair, to their spectra, as sums to the reaches that paths start
and end at, upstream to all reaches on the paths, and to each response; there it
meets the response's slope by each parameter.  One pass gives all reaches and
parameters; networks are walked by pairs, never by the reaches of each path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import settled
from ..functions import sampling
from ..functions.irf import get_irf
from ..functions.spectral import FLOOR, _lists, log_of
from . import tour
from .network import RiverNetwork
from .routing import Router

Slope = Callable[[np.ndarray], np.ndarray]
COLUMNS = 256  # elements of an array that are summed as columns of one row; longer ones as rows


def weights_back(spectrum: np.ndarray, gradient: np.ndarray, n: int, substeps: int, mode: str) -> np.ndarray:
    """What a gradient by path weights says of log amplitudes and phases: back through normalising, resampling, cutting at 0 and the inverse transform."""
    log, phase = np.hsplit(spectrum, 2)
    z = np.exp(log + 1j * phase)
    fine = np.fft.irfft(z, n=n, axis=1)
    coarse = sampling.reduce_kernel(np.maximum(fine, 0), substeps, mode)
    total = coarse.sum(axis=1, keepdims=True)
    safe = np.where(total > 0, total, 1)
    by_coarse = np.where(total > 0, (gradient - (gradient * coarse / safe).sum(axis=1, keepdims=True)) / safe, 0)
    by_fine = sampling.reduce_kernel_back(by_coarse, substeps, mode) * (fine > 0)
    twice = np.full(z.shape[1], 2.0)
    twice[0] = 1
    if n % 2 == 0:
        twice[-1] = 1
    by_z = np.fft.rfft(by_fine, axis=1) * twice / n  # by the real part, and by the imaginary one
    return np.hstack((by_z.real * z.real + by_z.imag * z.imag, by_z.imag * z.real - by_z.real * z.imag))


def spectrum_back(response: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """What a gradient by log amplitudes and phases says of the response: back through the log spectrum with its floor."""
    n = response.shape[1]
    z = np.fft.rfft(response, axis=1)
    by_log, by_phase = np.hsplit(gradient, 2)
    size = np.abs(z)
    by_log = np.where(size > FLOOR, by_log, 0)
    square = np.where(size > 0, size * size, 1)
    by_z = ((by_log * z.real - by_phase * z.imag) + 1j * (by_log * z.imag + by_phase * z.real)) / square
    padded = np.zeros((len(z), n), complex)
    padded[:, : z.shape[1]] = by_z
    return n * np.fft.ifft(padded, axis=1).real


def summed(rows: DataFrame, keys: list[str], array: str, size: int) -> DataFrame:
    """keys and the sum of arrays of ``size`` numbers, element by element; partial sums come before the shuffle."""
    if size <= COLUMNS:
        sums = rows.groupBy(*keys).agg(*(F.sum(F.get(array, F.lit(i))).alias(f"_{i}") for i in range(size)))
        return sums.select(*keys, F.array(*(f"_{i}" for i in range(size))).alias(array))
    long = rows.select(*keys, F.posexplode(array).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"))
    whole = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_all"))
    return whole.select(*keys, F.col("_all._v").alias(array))


def _by_response(how: tour.Convolution, params: list[str], given: Slope | None, steps: int | None) -> Callable:
    """Work of a block: reach_id, whether other blocks have a part of its gradient too, parameters and the gradient by its response.

    Discharge that drains through the block alone is made here where ``given``
    makes the loss's derivative of it.
    """
    n, window, back = how.window * how.substeps, how.window, how.window - 1
    lags = np.arange(window)

    def slopes(local: tour.Local, kernels: Callable, part: tour.Entries, y: tour.Entries, low: int, high: int) -> np.ndarray:
        """[reach, step]: what the loss says of discharge in the steps from ``low`` - ``back`` on, ``back`` more than up to ``high``."""
        dy = np.zeros((local.n, high - low + 2 * back))
        on = (y.at >= low) & (y.at < high)
        np.add.at(dy, (y.of[on], y.at[on] - low + back), y.value[on] if given is None else given(y.value[on]))
        ends = np.flatnonzero(~local.shared)
        if given is not None and len(ends):
            width = high - low + back
            of, at = np.nonzero(how.hits(local, part, ends, width)[:, back:])
            dy[ends[of], back + at] = given(how.arrived(local, kernels(0), part, ends, width)[:, back:][of, at])
        return dy

    def work(local: tour.Local, nodes: pa.Table, series: Iterator) -> Iterator[pa.RecordBatch]:
        kernels, spectra = how.kernels(local, False), log_of(local.irfs[0])
        by_path = np.zeros((local.n, 2 * spectra.shape[1]))
        for _, tile, rows in series:
            kind = np.asarray(rows.column("kind"))
            x, y = (tour.Entries.read(rows.filter(pa.array(kind == k)), local).only_known() for k in (tour.IN, tour.OUT))
            last = how.tile if steps is None else min(how.tile, steps - tile * how.tile)
            for low, high in tour.spans(how, x, 0, back, last, local.n):
                part = x.part(low - back, high)
                dy = slopes(local, kernels, part, y, low, high)
                for start, end, path in local.paths(spectra, how.include_self):
                    nth = np.full(local.own, -1)
                    nth[start] = np.arange(len(start))
                    by_weights = np.zeros(len(start) * window)
                    for i in range(0, len(part.of), max(1, how.cells // window)):
                        cut = slice(i, i + max(1, how.cells // window))
                        to = nth[part.of[cut] - local.stem]
                        on = to >= 0
                        to, at = to[on], part.at[cut][on][:, None] + lags
                        products = part.value[cut][on][:, None] * dy[end[to][:, None], at]
                        by_weights += np.bincount((to[:, None] * window + lags).reshape(-1), products.reshape(-1), len(by_weights))
                    by = weights_back(np.hstack((path.real, path.imag)), by_weights.reshape(-1, window), n, how.substeps, how.mode)
                    # A path's spectrum is the sum to the outlet at its start less that below its end.
                    by_path[local.stem + start] += by
                    down = local.down[end]
                    np.subtract.at(by_path, down[down >= 0], by[down >= 0])
        by_irf = spectrum_back(local.irfs[0], local.accumulated(by_path))
        columns = [pa.array(local.reach), pa.array(local.shared), *(nodes.column(f"_0_{p}").combine_chunks().take(pa.array(local.order)) for p in params), _lists(by_irf)]
        yield pa.RecordBatch.from_arrays(columns, names=["reach_id", "shared", *params, "by_irf"])

    return work


def _of_rows(slope: Slope, flow: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(b.schema.get_field_index("value"), "value", pa.array(slope(np.asarray(b.column("value")))))

    return flow.filter("value IS NOT NULL").mapInArrow(run, flow.schema)


def response_gradient(router: Router, gradient: DataFrame | Slope, runoff: DataFrame, network: RiverNetwork, steps: int | None = None) -> DataFrame:
    """reach_id, the response's parameters, by_irf: a gradient by discharge as one by the samples of each reach's response.

    By blocks of a tour: a block has all paths that start in it, so what they say
    of the reaches along them is summed there, and over blocks for the few reaches
    that others drain through too.
    """
    how, params = router.convolution(network), list(get_irf(network.irf).params)
    if callable(gradient) and steps is None:
        raise ValueError("the number of steps is needed where discharge is made")
    if callable(gradient) and not network.include_self:  # discharge has a reach's own runoff besides what paths bring
        gradient = _of_rows(gradient, router.route(runoff, network, steps))
    places = tour.tour(network.reaches)
    x = tour.series(runoff, places, how.window, tour.IN, callable(gradient), how.tile)
    ends = tour.shared_flow(how, x, places, runoff, network, steps) if callable(gradient) else gradient
    blocks = tour.Blocks(network, places, how, [x, tour.series(ends, places, 1, tour.OUT, tile=how.tile)], stems=[False, True])
    work = _by_response(how, params, gradient if callable(gradient) else None, steps)
    parts = settled(blocks.run(work, "reach_id long, shared boolean, " + "".join(f"{p} double, " for p in params) + "by_irf array<double>"))
    sums = summed(parts.filter("shared"), ["reach_id", *params], "by_irf", how.window * how.substeps)
    return parts.filter("NOT shared").drop("shared").unionByName(sums)


def loss_gradient(router: Router, gradient: DataFrame | Slope, runoff: DataFrame, network: RiverNetwork, steps: int | None = None) -> DataFrame:
    """reach_id, param, value: the derivative of a loss by every parameter of every reach.

    ``gradient(batch, reach_id, t, value)`` is the loss's derivative by
    discharge, or a function that makes it of an array of discharges; then the
    discharge for 0 <= t < ``steps`` is made where it is used.  Where weights are cut at 0 or a magnitude lies at its floor the
    derivative is that of the side which is taken.
    """
    irf = get_irf(network.irf)
    n, dt = router.window * router.substeps, 1 / router.substeps
    rows = response_gradient(router, gradient, runoff, network, steps)
    slopes = irf.slopes({p: F.col(p) for p in irf.params}, n, dt)
    dot = lambda slope: F.aggregate(F.zip_with("by_irf", slope, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    per_param: list[Column] = [F.struct(F.lit(p).alias("param"), dot(slope).alias("value")) for p, slope in slopes.items()]
    return rows.select("reach_id", F.explode(F.array(*per_param)).alias("g")).select("reach_id", "g.param", "g.value")
