"""Routing by blocks of a tour against routing over a table of kernels, and what it shuffles."""

import time

import numpy as np
import pytest

from rivernet.jobs import queries
from rivernet.operators import convolution as V
from rivernet.operators import kernel as K
from rivernet.operators import tour
from rivernet.operators.gradients import loss_gradient
from rivernet.operators.network import NetworkError, RiverNetwork
from rivernet.operators.routing import Router, parameter_gradient, parameter_sweep

SF = "/root/testdata/sf0.01"
SIZES = [(1024, 1024, 1 << 21), (4, 7, 1 << 21), (3, 16, 30), (1, 3, 1)]  # block, tile, cells


def forest(spark, n=40, seed=3):
    """Ids at random, several outlets, long and short branches."""
    rng = np.random.default_rng(seed)
    ids = rng.permutation(n * 3)[:n].tolist()
    rows = [(ids[i], ids[rng.integers(max(0, i - 6), i)] if i % 11 else None, 0.5 + 0.5 * (i % 5)) for i in range(n)]
    return spark.createDataFrame(rows, "reach_id long, downstream_id long, tau double"), ids


def odd_series(spark, ids, seed=5, steps=40):
    """Sparse, with nulls as batch and value, and steps before and behind those asked for."""
    rng = np.random.default_rng(seed)
    rows = [(b, i, int(t), None if rng.random() < 0.1 else float(rng.random())) for b in ("a", None, "c") for i in ids if rng.random() < 0.5 for t in rng.choice(np.arange(-4, steps + 6), 3, replace=False)]
    rows += [("a", ids[0], None, 1.0), ("nulls", ids[1], 3, None)]
    return spark.createDataFrame(rows, "batch string, reach_id long, t int, value double")


def rows_of(df):
    return {(r.batch, r.reach_id, r.t): r.value for r in df.collect()}


def same(got, want):
    assert set(got) == set(want)
    assert all((v is None and got[k] is None) or got[k] == pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in want.items())


def shuffled(spark, df):
    """Bytes written to shuffles by a query, from the making of its plan on."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        time.sleep(0.3)  # what the store shows is brought up to date every 0.1 s
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    df().write.format("noop").mode("overwrite").save()
    return written() - before


@pytest.mark.parametrize("include_self", [True, False])
@pytest.mark.parametrize(("block", "tile", "cells"), SIZES)
def test_blocks_of_any_size_route_alike(spark, block, tile, cells, include_self):
    reaches, ids = forest(spark)
    network, runoff = RiverNetwork(reaches, include_self=include_self), odd_series(spark, ids)
    how = tour.Convolution(5, 2, "avg", include_self, block, tile, cells)
    want = V.convolve(runoff, K.build_kernel(network, 5, 2), 40)
    same(rows_of(tour.route(how, runoff, network, 40).withColumnRenamed("value_0", "value")), rows_of(want))


@pytest.mark.parametrize("include_self", [True, False])
@pytest.mark.parametrize(("block", "tile", "cells"), SIZES)
def test_blocks_of_any_size_go_back_alike(spark, block, tile, cells, include_self):
    reaches, ids = forest(spark)
    network, gradient = RiverNetwork(reaches, include_self=include_self), odd_series(spark, ids)
    how = tour.Convolution(5, 2, "avg", include_self, block, tile, cells)
    same(rows_of(tour.adjoint(how, gradient, network)), rows_of(V.adjoint_runoff(gradient, K.build_kernel(network, 5, 2))))


def test_sweep_by_blocks(spark):
    reaches, ids = forest(spark)
    network, runoff = RiverNetwork(reaches), odd_series(spark, ids)
    factors = {"low": 0.5, "high": 1.5}
    sweeps = [{(r.param_set, r.batch, r.reach_id, r.t): r.value for r in parameter_sweep(Router(6, strategy=s), runoff, network, "tau", factors, 40).collect()} for s in ("tour", "long")]
    same(*sweeps)


def test_gradient_of_discharge_by_blocks(spark):
    reaches, ids = forest(spark)
    network, runoff = RiverNetwork(reaches), odd_series(spark, ids)
    found = [rows_of(parameter_gradient(Router(6, strategy=s), runoff, network, "tau", 40, 0.1).withColumnRenamed("gradient", "value")) for s in ("tour", "long")]
    same(*found)


@pytest.mark.parametrize("include_self", [True, False])
def test_gradient_of_a_loss_by_blocks(spark, include_self):
    """Blocks of any size, and the loss's derivative given as rows or as a function of discharge that is made on the way."""
    reaches, ids = forest(spark)
    network, runoff = RiverNetwork(reaches, include_self=include_self), odd_series(spark, ids)
    found = []
    for block, tile, cells in SIZES[::2]:
        router = Router(5, 2)
        how = tour.Convolution(5, 2, "avg", include_self, block, tile, cells)
        object.__setattr__(router, "convolution", lambda _, how=how: how)
        flow = Router(5, 2, strategy="long").route(runoff.filter("t IS NOT NULL"), network, 40)
        slope = flow.withColumn("value", 3 * flow["value"] + 1)
        for given, steps in ((slope, None), (lambda flow: 3 * flow + 1, 40)):
            found.append({(r.reach_id, r.param): r.value for r in loss_gradient(router, given, runoff, network, steps).collect()})
    assert len(found[0]) == len(ids)
    for one in found[1:]:
        assert set(one) == set(found[0]) and all(one[k] == pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in found[0].items())
    with pytest.raises(ValueError, match="number of steps"):
        loss_gradient(Router(5), lambda flow: flow, runoff, network)


def test_runoff_on_an_unknown_reach(spark):
    reaches, ids = forest(spark)
    runoff = spark.createDataFrame([("a", max(ids) + 1, 3, 1.0)], "batch string, reach_id long, t int, value double")
    with pytest.raises(NetworkError, match="not in the network"):
        Router(6).route(runoff, RiverNetwork(reaches), 40)
    assert Router(6).route(runoff, RiverNetwork(reaches), 40, check=False).count() == 0
    with pytest.raises(NetworkError, match="no column value"):
        Router(6).route(runoff.drop("value"), RiverNetwork(reaches), 40)


@pytest.fixture(scope="module")
def most(spark):
    """100 bytes for each row of runoff."""
    return 100 * queries.data.monthly_runoff(spark, SF).count()


def test_the_sweep_shuffles_no_pairs(spark, most):
    """every pair's kernel and its products went through shuffles, once for each set (337 bytes a row of runoff)."""
    assert shuffled(spark, lambda: queries.param_sweep(spark, SF)) < most


def test_the_adjoint_shuffles_no_pairs(spark, most):
    """as F1, and series met kernels a step at a time (203 bytes a row)."""
    assert shuffled(spark, lambda: queries.adjoint_dx(spark, SF)) < most


def test_the_gradient_of_discharge_shuffles_no_pairs(spark, most):
    """as F1, and both sides of the difference met in another shuffle (556 bytes a row)."""
    assert shuffled(spark, lambda: queries.param_gradient(spark, SF)) < most


def test_routing_of_batches_shuffles_no_pairs(spark, most):
    """as F1, and products were made for each batch (284 bytes a row)."""
    assert shuffled(spark, lambda: queries.queries()["route_batched"](spark, SF)) < most


def test_routing_by_substeps_shuffles_no_pairs(spark, most):
    """as F1, with spectra of every substep in the shuffles (160 bytes a row)."""
    assert shuffled(spark, lambda: queries.queries()["route_subres"](spark, SF)) < most


def test_the_gradient_of_a_loss_shuffles_no_pairs(spark, most):
    """as F1, and pairs met their gradients, discharge was written, sums went upstream as arrays (673 bytes a row)."""
    assert shuffled(spark, lambda: queries.loss_gradient(spark, SF)) < most
