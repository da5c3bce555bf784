"""Registered queries of the routing operators, on networks derived from the order and event tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import ensure_checkpoint_dir, settled
from ..functions import sampling, spectral
from ..functions.irf import REGISTRY
from ..operators import closure as G
from ..operators import convolution as V
from ..operators import kernel as K
from ..operators import segmentation as C
from ..operators.gradients import loss_gradient as reverse_gradient
from ..operators.network import RiverNetwork
from ..operators.routing import Router, parameter_gradient, parameter_sweep
from ..operators.staged import StagedRouter
from ..sources import rapid
from ..sources import river_tables as data
from ..sources.series_files import read_series, write_series

WINDOW, STEPS, SUBSTEPS, PIECE = 8, data.MONTHS, 4, 8
FLOW_UNIT = 997.0

Query = Callable[[SparkSession, str], DataFrame]


def rounded(c: str | Column, digits: int = 6, scale: float = 1.0) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c / scale, digits) + F.lit(0.0)


def flow(df: DataFrame, *keys: str) -> DataFrame:
    """Flows over a prime number: no sum of cents then lies half-way between two roundings."""
    return df.select(*keys, "batch", "reach_id", "t", rounded("value", 2, FLOW_UNIT).alias("value"))


def irf_rows(name: str, substeps: int = 1) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = K.responses(RiverNetwork(data.heap(spark, sf_dir), name), WINDOW, substeps)
        return rows.select("reach_id", F.posexplode("irf").alias("t", "w")).select("reach_id", "t", rounded("w").alias("w"))

    return query


def closure_pairs(spark, sf_dir):
    return G.closure(data.heap(spark, sf_dir))


def prefix_sum(spark, sf_dir):
    return G.downstream_sum(data.heap(spark, sf_dir), "tau").select("reach_id", rounded("tau").alias("tau"))


def _complex_rows(df: DataFrame, *keys: str) -> DataFrame:
    half = F.size("spectrum") / 2
    parts = F.arrays_zip(F.slice("spectrum", F.lit(1), half.cast("int")).alias("a"), F.slice("spectrum", (half + 1).cast("int"), half.cast("int")).alias("p"))
    rows = df.select(*keys, F.posexplode(parts).alias("k", "z"))
    return rows.select(*keys, "k", rounded(F.exp("z.a") * F.cos("z.p")).alias("re"), rounded(F.exp("z.a") * F.sin("z.p")).alias("im"))


def path_log_product(spark, sf_dir):
    return _complex_rows(K.path_spectra(RiverNetwork(data.heap(spark, sf_dir), "hayami"), WINDOW), "dst", "src")


def spectrum(spark, sf_dir):
    return _complex_rows(spectral.log_spectrum(K.responses(RiverNetwork(data.heap(spark, sf_dir), "nash_cascade"), WINDOW)), "reach_id")


def spectrum_inverse(spark, sf_dir):
    rows = spectral.log_spectrum(K.responses(RiverNetwork(data.heap(spark, sf_dir), "hayami"), WINDOW))
    back = spectral.from_log_spectrum(rows, WINDOW)
    return back.select("reach_id", F.posexplode("irf").alias("t", "w")).select("reach_id", "t", rounded("w").alias("w"))


def path_counts(spark, sf_dir):
    return G.path_counts(data.heap(spark, sf_dir))


def path_cumsum(spark, sf_dir):
    counts = G.path_counts(data.heap(spark, sf_dir))
    return G.running_total(counts, "reach_id", "n_paths", "total").select("reach_id", "n_paths", "total")


def topo_level(spark, sf_dir):
    return G.levels(data.heap(spark, sf_dir))


def components(spark, sf_dir):
    return G.outlets(data.chain32(spark, sf_dir))


def ancestors(spark, sf_dir):
    reaches = data.admin(spark, sf_dir)
    return G.upstream_sets(reaches, reaches.filter("reach_id < 1000").select("reach_id"))


def tour_intervals(spark, sf_dir):
    return G.intervals(data.heap(spark, sf_dir))


def upstream_count(spark, sf_dir):
    return G.upstream_counts(data.admin(spark, sf_dir))


def _series(spark, sf_dir):
    return data.monthly_runoff(spark, sf_dir)


def _series_rows(df: DataFrame) -> DataFrame:
    return df.select("batch", "reach_id", "t", rounded("value", 4).alias("value"))


def resample_phi(spark, sf_dir):
    return _series_rows(sampling.upsample(_series(spark, sf_dir), SUBSTEPS))


def resample_pool(spark, sf_dir):
    return _series_rows(sampling.pool(_series(spark, sf_dir), SUBSTEPS, ["batch", "reach_id"]))


def resample_last(spark, sf_dir):
    return _series_rows(sampling.take_last(_series(spark, sf_dir), SUBSTEPS))


def resample_tri(spark, sf_dir):
    return _series_rows(sampling.triangle(_series(spark, sf_dir), SUBSTEPS, ["batch", "reach_id"], STEPS // SUBSTEPS))


def kernel_rows(irf: str, substeps: int = 1, mode: str = "avg") -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        kernel = K.build_kernel(RiverNetwork(data.heap(spark, sf_dir), irf), WINDOW, substeps, mode)
        return K.long_kernel(kernel).select("dst", "src", "lag", rounded("weight").alias("weight"))

    return query


def _chain_kernel(spark, sf_dir):
    return K.build_kernel(RiverNetwork(data.chain32(spark, sf_dir)), WINDOW)


def kernel_block(spark, sf_dir):
    return K.block_index(K.to_blocks(_chain_kernel(spark, sf_dir), 16)).withColumn("block", F.col("block").cast("long"))


def kernel_block_roundtrip(spark, sf_dir):
    back = K.from_blocks(K.to_blocks(_chain_kernel(spark, sf_dir), 16), 16, height=1 << 40, width=1 << 40)
    return K.long_kernel(back).select("dst", "src", "lag", rounded("weight").alias("weight"))


def kernel_block_dense(spark, sf_dir):
    dense = K.blocks_to_dense(K.to_blocks(_chain_kernel(spark, sf_dir), 16), 16, WINDOW)
    return dense.select("dst", "src", "lag", rounded("weight").alias("weight"))


def kernel_given(spark, sf_dir):
    given = K.long_kernel(_chain_kernel(spark, sf_dir)).filter("weight > 1e-3")
    return K.long_kernel(K.from_responses(given, WINDOW)).select("dst", "src", "lag", rounded("weight").alias("weight"))


def kernel_dense(spark, sf_dir):
    """A dense matrix for each chain of 32 reaches."""
    chains = data.chain32(spark, sf_dir).select("reach_id", F.expr("(reach_id - 1) div 32").alias("grp"))
    dense = K.to_dense_groups(_chain_kernel(spark, sf_dir), chains, WINDOW)
    return dense.select("dst", "src", "lag", rounded("weight").alias("weight"))


def route(irf: str, router: Router | None = None, include_self: bool = True, batch: str | None = None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        network = RiverNetwork(data.heap(spark, sf_dir), irf, include_self)
        return flow((router or Router(WINDOW)).route(data.monthly_runoff(spark, sf_dir, batch), network, STEPS))

    return query


def route_param_override(spark, sf_dir):
    reaches = data.heap(spark, sf_dir)
    params = reaches.select("reach_id", (F.col("tau") * 2).alias("tau"))
    return flow(Router(WINDOW).route(_series(spark, sf_dir), RiverNetwork(reaches), STEPS, params=params))


def route_targets(spark, sf_dir):
    reaches = data.heap(spark, sf_dir)
    return flow(Router(WINDOW).route(_series(spark, sf_dir), RiverNetwork(reaches), STEPS, targets=reaches.filter("reach_id < 8").select("reach_id")))


def route_daily(spark, sf_dir):
    flows = Router(WINDOW).route(data.daily_runoff(spark, sf_dir), RiverNetwork(data.event_network(spark, sf_dir)), data.DAYS)
    return flows.select("batch", "reach_id", "t", rounded("value", 6, FLOW_UNIT).alias("value"))


def param_sweep(spark, sf_dir):
    network = RiverNetwork(data.heap(spark, sf_dir))
    return flow(parameter_sweep(Router(WINDOW), _series(spark, sf_dir), network, "tau", {"low": 0.9, "high": 1.1}, STEPS), "param_set")


def param_gradient(spark, sf_dir):
    found = parameter_gradient(Router(WINDOW), _series(spark, sf_dir), RiverNetwork(data.heap(spark, sf_dir)), "tau", STEPS, 0.1)
    return found.select("batch", "reach_id", "t", rounded("gradient", 2, FLOW_UNIT).alias("gradient"))


def loss_gradient(spark, sf_dir):
    """Of half the sum of squared discharges, by every parameter of every reach."""
    found = reverse_gradient(Router(WINDOW), lambda flow: flow, _series(spark, sf_dir), RiverNetwork(data.heap(spark, sf_dir)), STEPS)
    return found.select("reach_id", "param", rounded("value", 4, 1e12).alias("value"))


def series_files(spark, sf_dir):
    """Runoff written as series files and read again, the winter months of a range of reaches of each file."""
    folder = f"{ensure_checkpoint_dir(spark)}/series-{uuid.uuid4().hex}"
    x = _series(spark, sf_dir)
    write_series(x, folder, STEPS, files=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _series_rows(read_series(spark, folder, values=1 << 16).filter("t >= 12 AND t < 60 AND reach_id > 10"))


def chain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chain32 cut after every eighth reach; the stage is the place in the chain."""
    reaches = data.chain32(spark, sf_dir).select("reach_id", "downstream_id")
    nth = F.expr(f"(reach_id - 1) div {PIECE}")
    return reaches.select("*", nth.alias("piece"), nth.cast("int").alias("cluster"), (nth % (32 // PIECE)).cast("int").alias("stage"))


def transfers(spark, sf_dir):
    return C.transfers(chain_plan(spark, sf_dir), "cluster")


def transfer_tables(spark, sf_dir):
    return C.transfer_tables(transfers(spark, sf_dir))


def cluster_ranges(spark, sf_dir):
    return C.cluster_ranges(chain_plan(spark, sf_dir))


def stage_layers(spark, sf_dir):
    plan = chain_plan(spark, sf_dir)
    return C.stages(C.transfers(plan, "cluster"), plan.select("cluster").distinct())


def segment_breakpoints(spark, sf_dir):
    return C.breakpoints(data.heap(spark, sf_dir), 200)


def schedule(spark, sf_dir):
    return C.schedule(data.heap(spark, sf_dir), path_limit=200, node_limit=100)


def schedule_blocks(spark, sf_dir):
    return C.schedule(data.heap(spark, sf_dir), strategy="blocks", block=16, node_limit=100)


def block_pieces(spark, sf_dir):
    return C.block_breakpoints(data.heap(spark, sf_dir), 16)


def route_staged(spark, sf_dir):
    network = RiverNetwork(data.chain32(spark, sf_dir))
    return flow(StagedRouter(Router(WINDOW)).route(_series(spark, sf_dir), network, settled(chain_plan(spark, sf_dir)), STEPS))


def staged_warm_start(spark, sf_dir):
    network = RiverNetwork(data.chain32(spark, sf_dir))
    return flow(StagedRouter(Router(WINDOW)).boundary_before(_series(spark, sf_dir), network, settled(chain_plan(spark, sf_dir)), STEPS, 2))


def adjoint_dx(spark, sf_dir):
    return flow(Router(WINDOW).adjoint(_series(spark, sf_dir), RiverNetwork(data.heap(spark, sf_dir))))


def adjoint_dw(spark, sf_dir):
    x = _series(spark, sf_dir)
    found = V.adjoint_kernel(x, x, G.closure(data.heap(spark, sf_dir)), WINDOW)
    return found.select("dst", "src", "lag", rounded("value", 3, 1e9).alias("value"))


def adjoint_closure(spark, sf_dir):
    reaches = data.heap(spark, sf_dir)
    gradient = G.closure(reaches).select("src", "dst", (F.col("dist") + 1 + F.col("src") % 3).cast("double").alias("value"))
    return V.adjoint_closure(gradient, reaches)


def adjoint_prefix(spark, sf_dir):
    reaches = data.heap(spark, sf_dir)
    return V.adjoint_downstream_sum(reaches.select("reach_id", F.col("tau").alias("value")), reaches).select("reach_id", rounded("value").alias("value"))


def _project(spark: SparkSession, reaches: DataFrame) -> str:
    folder = f"{ensure_checkpoint_dir(spark)}/rapid-{uuid.uuid4().hex}"
    rapid.write_rapid(reaches, folder)
    return folder


def _rapid_rows(network: RiverNetwork) -> DataFrame:
    return network.reaches.select("reach_id", "downstream_id", rounded("k").alias("k"), rounded("x").alias("x"))


def rapid_ingest(spark, sf_dir):
    return _rapid_rows(rapid.read_rapid(spark, _project(spark, data.heap(spark, sf_dir))))


def rapid_segmented(spark, sf_dir):
    return rapid.read_rapid_segmented(spark, _project(spark, data.heap(spark, sf_dir)), path_limit=400, node_limit=100)[1]


def rapid_union(spark, sf_dir):
    reaches = data.heap(spark, sf_dir)
    half = [reaches.filter("reach_id % 3 < 2"), reaches.filter("reach_id % 3 > 0")]
    return _rapid_rows(rapid.read_rapid(spark, [_project(spark, r) for r in half]))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        f.__name__: f
        for f in (
            closure_pairs, prefix_sum, path_log_product, spectrum, spectrum_inverse, path_counts, path_cumsum, topo_level, components, ancestors, tour_intervals, upstream_count,
            resample_phi, resample_pool, resample_last, resample_tri, kernel_block, kernel_block_roundtrip, kernel_block_dense, kernel_given, kernel_dense, route_param_override, route_targets, route_daily, param_sweep, param_gradient, loss_gradient, series_files,
            transfers, transfer_tables, cluster_ranges, stage_layers, segment_breakpoints, schedule, schedule_blocks, block_pieces, route_staged, staged_warm_start,
            adjoint_dx, adjoint_dw, adjoint_closure, adjoint_prefix, rapid_ingest, rapid_union, rapid_segmented,
        )
    }
    out |= {f"irf_{name}": irf_rows(name) for name in REGISTRY}
    out |= {f"kernel_{name}": kernel_rows(name) for name in ("linear_storage", "muskingum", "nash_cascade", "hayami", "pure_lag")}
    out |= {f"route_{name}": route(name) for name in ("linear_storage", "muskingum", "nash_cascade", "hayami", "pure_lag")}
    out |= {
        "kernel_subres_avg": kernel_rows("muskingum", SUBSTEPS, "avg"), "kernel_subres_sample": kernel_rows("linear_storage", SUBSTEPS, "sample"),
        "route_diag_off": route("linear_storage", include_self=False), "route_batched": route("linear_storage", batch="o_orderstatus"),
        "route_subres": route("linear_storage", Router(WINDOW, SUBSTEPS, "avg")), "conv_packed": route("linear_storage", Router(WINDOW, strategy="packed")), "conv_blocks": route("linear_storage", Router(WINDOW, strategy="blocks")),
    }
    return out
