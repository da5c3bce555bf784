"""Routing: runoff and a network give discharge at every reach."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sampling
from . import tour
from .closure import closure
from .convolution import adjoint_runoff, convolve
from .kernel import build_kernel
from .network import RiverNetwork, check_runoff


@dataclass(frozen=True)
class Router:
    """window: lags kept; substeps: routing steps in a native step; mode: how kernels come to the native step.

    strategy: one of ``convolve``'s, over a table of kernels, or "tour", which
    makes them where they are used and gives the same rows.
    """

    window: int = 100
    substeps: int = 1
    mode: str = "avg"
    strategy: str = "tour"

    def __post_init__(self):
        sampling.check_mode(self.mode)

    @property
    def over_kernels(self) -> str:
        """The strategy where kernels are a table: those that are pruned, given or kept in stages."""
        return "long" if self.strategy == "tour" else self.strategy

    def convolution(self, network: RiverNetwork) -> tour.Convolution:
        return tour.Convolution(self.window, self.substeps, self.mode, network.include_self)

    def kernel(self, network: RiverNetwork, targets: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
        """With ``targets(reach_id)`` only rows that end there: the closure is pruned to what drains to them.

        ``pairs`` is the network's closure where it is known.
        """
        pairs = closure(network.reaches, network.include_self) if pairs is None else pairs
        if targets is not None:
            pairs = pairs.join(targets.select(F.col("reach_id").alias("dst")).distinct(), "dst", "left_semi")
        return build_kernel(network, self.window, self.substeps, self.mode, pairs)

    def route(self, runoff: DataFrame, network: RiverNetwork, steps: int, params: DataFrame | None = None, targets: DataFrame | None = None, check: bool = True, pairs: DataFrame | None = None) -> DataFrame:
        """batch, reach_id, t, value: discharge for 0 <= t < steps.

        ``params`` replaces the network's parameters.  Where a reach does not
        route its own runoff, that runoff is added as it is.
        """
        by_tour = self.strategy == "tour" and targets is None and pairs is None
        if check:
            check_runoff(runoff, None if by_tour else network.reaches)
        network = network if params is None else network.with_params(params)
        if by_tour:
            flow = tour.route(self.convolution(network), runoff, network, steps, check=check).withColumnRenamed("value_0", "value")
        else:
            flow = convolve(runoff, self.kernel(network, targets, pairs), steps, self.over_kernels)
        if network.include_self:
            return flow
        own = runoff.filter(F.col("t").between(0, steps - 1)).select("batch", "reach_id", "t", "value")
        if targets is not None:
            own = own.join(targets.select("reach_id"), "reach_id", "left_semi")
        return flow.unionByName(own).groupBy("batch", "reach_id", "t").agg(F.sum("value").alias("value"))

    def adjoint(self, gradient: DataFrame, network: RiverNetwork) -> DataFrame:
        """batch, reach_id, t, value: a gradient by discharge as one by the runoff that is routed."""
        if self.strategy == "tour":
            return tour.adjoint(self.convolution(network), gradient, network)
        return adjoint_runoff(gradient, self.kernel(network))


def parameter_sweep(router: Router, runoff: DataFrame, network: RiverNetwork, param: str, factors: dict[str, float], steps: int) -> DataFrame:
    """param_set, batch, reach_id, t, value: the same runoff routed with scaled copies of one parameter, as one job over one closure."""
    if router.strategy == "tour" and network.include_self:
        sets = [{param: F.col(param) * factor} for factor in factors.values()]
        flow = tour.route(router.convolution(network), runoff, network, steps, sets)
        named = (F.struct(F.lit(name).alias("param_set"), F.col(f"value_{k}").alias("value")) for k, name in enumerate(factors))
        return flow.select("batch", "reach_id", "t", F.explode(F.array(*named)).alias("_s")).select("_s.param_set", "batch", "reach_id", "t", "_s.value")
    out = []
    pairs = closure(network.reaches, network.include_self)
    for name, factor in factors.items():
        scaled = RiverNetwork(network.reaches.withColumn(param, F.col(param) * factor), network.irf, network.include_self)
        out.append(router.route(runoff, scaled, steps, check=False, pairs=pairs).select(F.lit(name).alias("param_set"), "batch", "reach_id", "t", "value"))
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first


def parameter_gradient(router: Router, runoff: DataFrame, network: RiverNetwork, param: str, steps: int, step: float = 0.01) -> DataFrame:
    """batch, reach_id, t, gradient: how discharge changes with the factor of one parameter at 1, by a central difference."""
    sides = {"low": 1 - step, "high": 1 + step}
    if router.strategy == "tour" and network.include_self:  # both sides lie in one row
        flow = tour.route(router.convolution(network), runoff, network, steps, [{param: F.col(param) * factor} for factor in sides.values()])
        return flow.select("batch", "reach_id", "t", ((F.col("value_1") - F.col("value_0")) / (2 * step)).alias("gradient"))
    sweep = parameter_sweep(router, runoff, network, param, sides, steps)
    signed = F.when(F.col("param_set") == "high", F.col("value")).otherwise(-F.col("value"))
    return sweep.groupBy("batch", "reach_id", "t").agg((F.sum(signed) / (2 * step)).alias("gradient"))
