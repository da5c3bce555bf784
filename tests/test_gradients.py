"""Gradients by parameters, backwards, against differences of whole routings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivernet.functions import irf, sampling
from rivernet.operators import gradients as A
from rivernet.operators.network import RiverNetwork
from rivernet.operators.routing import Router

from .test_routing import COLUMNS, reaches_of, runoff_of

# Five reaches; parameters away from kinks.
ROWS = [(1, None, 1.3, 0.15, 1.1, 1.35, 5.0, 0.5, 1.5, 1.6, 3.0, 0.2), (2, 1, 2.1, 0.2, 1.6, 2.3, 8.0, 0.8, 1.2, 1.2, 1.5, 0.4), (3, 1, 0.8, 0.1, 1.2, 0.6, 6.0, 0.7, 1.1, 2.1, 2.0, 0.3), (4, 2, 1.7, 0.25, 1.9, 1.7, 7.0, 1.0, 1.3, 1.4, 2.5, 0.6), (5, 2, 0.6, 0.12, 1.4, 0.9, 9.0, 0.9, 1.6, 1.8, 1.2, 0.7)]
STEPS = 12


def loss(router, rows, name, runoff, weights, spark, include_self):
    flow = router.route(runoff, RiverNetwork(reaches_of(spark, rows), name, include_self), STEPS, check=False)
    return sum(r.value * weights[r.batch, r.reach_id][r.t] for r in flow.collect())


@pytest.mark.parametrize(("name", "window", "substeps", "mode", "include_self"), [("linear_storage", 6, 1, "avg", True), ("muskingum", 7, 2, "avg", True), ("weibull", 6, 2, "sample", True), ("hayami", 6, 1, "avg", False), ("pure_lag", 9, 1, "avg", True), ("nash_cascade", 5, 3, "avg", True)])
def test_against_differences(spark, name, window, substeps, mode, include_self):
    router = Router(window, substeps, mode)
    runoff, _ = runoff_of(spark, range(1, 6), STEPS, ("a", "b"))
    dy, weights = runoff_of(spark, range(1, 6), STEPS, ("a", "b"), seed=9)
    found = {(r.reach_id, r.param): r.value for r in A.loss_gradient(router, dy, runoff, RiverNetwork(reaches_of(spark, ROWS), name, include_self)).collect()}
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    params = irf.get_irf(name).params
    assert {p for _, p in found} == set(params)
    step = 1e-5
    for reach, param in [(1, params[0]), (2, params[-1])][name != "muskingum" :]:
        sides = []
        for sign in (1, -1):
            rows = [tuple(v + sign * step if r[0] == reach and n == param else v for n, v in zip(names, r, strict=True)) for r in ROWS]
            sides.append(loss(router, rows, name, runoff, weights, spark, include_self))
        assert found[reach, param] == pytest.approx((sides[0] - sides[1]) / (2 * step), rel=1e-4, abs=1e-5)


@pytest.mark.parametrize(("substeps", "mode"), [(1, "avg"), (4, "avg"), (3, "sample")])
def test_adjoint_of_resampling(substeps, mode):
    rng = np.random.default_rng(1)
    fine, coarse = rng.random((5, 6 * substeps)), rng.random((5, 6))
    assert (sampling.reduce_kernel(fine, substeps, mode) * coarse).sum() == pytest.approx((fine * sampling.reduce_kernel_back(coarse, substeps, mode)).sum())


@pytest.mark.parametrize("name", sorted(irf.REGISTRY))
def test_slopes_of_responses(spark, name):
    """Own slopes against those from two responses close by."""
    of = irf.get_irf(name)
    rows = reaches_of(spark, ROWS)
    by_difference = irf.Irf(of.name, of.params, of.build)
    for n, dt in ((8, 1.0), (9, 0.5)):
        p = {c: F.col(c) for c in of.params}
        columns = [c.alias(f"{kind}_{k}") for kind, f in (("own", of), ("near", by_difference)) for k, c in f.slopes(p, n, dt).items()]
        for r in rows.select(*columns).collect():
            for k in of.params:
                assert r[f"own_{k}"] == pytest.approx(r[f"near_{k}"], rel=1e-4, abs=1e-7)


def test_long_arrays_are_summed_alike(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (1, [10.0, 0.5, 0.0]), (2, [7.0, 8.0, 9.0])], "k long, v array<double>")
    found = [sorted(tuple(r) for r in A.summed(rows, ["k"], "v", 3).collect())]
    monkeypatch.setattr(A, "COLUMNS", 2)
    found.append(sorted(tuple(r) for r in A.summed(rows, ["k"], "v", 3).collect()))
    assert found[0] == found[1] == [(1, [11.0, 2.5, 3.0]), (2, [7.0, 8.0, 9.0])]


def test_response_given_as_a_function_of_arrays(spark):
    """A Weibull response on Arrow batches gives the rows of the registered one, in every step that follows."""

    def weigh(p, n, dt):
        z = np.maximum((np.arange(n) + 1) * dt - p["onset"][:, None], 0) / p["scale"][:, None]
        s = p["shape"][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            v = np.where(z > 0, s / p["scale"][:, None] * z ** (s - 1) * np.exp(-(z**s)), 0)
        return v / v.sum(axis=1, keepdims=True)

    irf.register_irf("weibull_arrays", None, ("shape", "scale", "onset"), vectorised=weigh)
    try:
        reaches, (runoff, _) = reaches_of(spark, ROWS), runoff_of(spark, range(1, 6), STEPS)
        flows = [{(r.reach_id, r.t): r.value for r in Router(6, 2).route(runoff, RiverNetwork(reaches, name), STEPS).collect()} for name in ("weibull", "weibull_arrays")]
        assert set(flows[0]) == set(flows[1]) and all(flows[1][k] == pytest.approx(v, rel=1e-9) for k, v in flows[0].items())
        with pytest.raises(NotImplementedError, match="slopes"):
            irf.get_irf("weibull_arrays").slopes({}, 3, 1.0)
        irf.register_irf("weibull_arrays", None, ("shape", "scale", "onset"), vectorised=lambda p, n, dt: np.ones((1, n + 1)))
        with pytest.raises(Exception, match="gave weights of shape"):
            Router(6).route(runoff, RiverNetwork(reaches, "weibull_arrays"), STEPS).collect()
        with pytest.raises(ValueError, match="either"):
            irf.register_irf("neither", None, ())
    finally:
        irf.REGISTRY.pop("weibull_arrays")
