"""Staged routing: clusters of one stage are routed at once, their outflow at cut edges is runoff of later stages.

Kernel and inflow lie in tables of the shared checkpoint folder, in parts by
stage and in buckets by the reach at which they meet.  A stage reads its own
parts only, and its inflow is summed and joined with its kernel bucket by bucket,
without an exchange of either; what comes out is dealt by the reach it comes to.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import ensure_checkpoint_dir, settled
from .convolution import convolve
from .network import RiverNetwork
from .routing import Router
from .segmentation import transfers

SERIES = ("batch", "reach_id", "t", "value")


class StageStore:
    """Tables in parts by ``stage`` and buckets by a key, the same number for each table."""

    def __init__(self, like: DataFrame):
        self.spark = like.sparkSession
        self.name = f"staged_{uuid.uuid4().hex}"
        self.folder = f"{ensure_checkpoint_dir(self.spark)}/{self.name}"
        self.buckets = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def put(self, name: str, rows: DataFrame, key: str) -> None:
        """Adds ``rows``: they are dealt as buckets are, so that a task writes one bucket, a file for each stage of it."""
        table = f"{self.name}_{name}"
        dealt = rows.repartition(self.buckets, key).sortWithinPartitions("stage", key)
        dealt.write.format("parquet").mode("append").partitionBy("stage").bucketBy(self.buckets, key).option("path", f"{self.folder}/{name}").saveAsTable(table)

    def get(self, name: str, stage: int | None = None, after: int | None = None) -> DataFrame:
        rows = self.spark.table(f"{self.name}_{name}")
        rows = rows if stage is None else rows.filter(F.col("stage") == stage)
        return rows if after is None else rows.filter(F.col("stage") > after)


@dataclass(frozen=True)
class StagedRouter:
    router: Router

    def _inner(self, network: RiverNetwork, plan: DataFrame) -> RiverNetwork:
        """The network without the edges between clusters."""
        of = plan.select("reach_id", "cluster")
        down = of.select(F.col("reach_id").alias("downstream_id"), F.col("cluster").alias("_down"))
        rows = network.reaches.join(of, "reach_id").join(down, "downstream_id", "left")
        return RiverNetwork(rows.withColumn("downstream_id", F.when(F.col("_down") == F.col("cluster"), F.col("downstream_id"))).drop("_down", "cluster"), network.irf, network.include_self)

    def stages(self, runoff: DataFrame | Callable[[int], DataFrame], network: RiverNetwork, plan: DataFrame, steps: int, boundary: DataFrame | None = None, first: int = 0) -> Iterator[tuple[int, DataFrame, DataFrame]]:
        """(stage, discharge, boundary) of one stage after another, from ``first`` on.

        ``plan`` has reach_id, downstream_id, cluster and stage.  ``runoff`` is a
        table or a function that gives a stage's.  The boundary holds what has
        come to later stages so far, as runoff of the reaches it enters.
        """
        last = plan.agg(F.max("stage")).first()[0]
        if last is None:
            return
        of = plan.select("reach_id", "stage")
        moves = transfers(plan, "cluster").select("src_reach", "dst_reach").join(of.withColumnRenamed("reach_id", "dst_reach"), "dst_reach")
        moves = settled(moves.join(of.select(F.col("reach_id").alias("src_reach"), F.col("stage").alias("src_stage")), "src_reach"))
        inner = self._inner(network, plan)
        inner = RiverNetwork(settled(inner.reaches), inner.irf, inner.include_self)
        store = StageStore(plan)
        store.put("kernel", self.router.kernel(inner).join(of.withColumnRenamed("reach_id", "dst"), "dst").filter(F.col("stage") >= first), "src")
        lazily = callable(runoff)
        given = runoff(first).limit(0) if lazily else runoff
        inflow = given.select(*SERIES).withColumn("from_above", F.lit(False))
        if boundary is not None:
            inflow = inflow.unionByName(boundary.select(*SERIES).withColumn("from_above", F.lit(True)))
        store.put("inflow", inflow.join(of, "reach_id").filter(F.col("stage") >= first), "reach_id")
        for k in range(first, last + 1):
            if lazily:
                own = runoff(k).select(*SERIES).join(plan.filter(F.col("stage") == k).select("reach_id", "stage"), "reach_id")
                store.put("inflow", own.withColumn("from_above", F.lit(False)), "reach_id")
            into = store.get("inflow", k).groupBy("batch", "reach_id", "t").agg(F.sum("value").alias("value"))
            flow = settled(self._route(into, inner, store.get("kernel", k).drop("stage"), steps))
            if k < last:
                out = moves.filter(F.col("src_stage") == k)
                below = flow.join(out, F.col("reach_id") == F.col("src_reach")).select("batch", F.col("dst_reach").alias("reach_id"), "t", "value", F.lit(True).alias("from_above"), "stage")
                store.put("inflow", below, "reach_id")
            yield k, flow, store.get("inflow", after=k).filter("from_above").select(*SERIES)

    def _route(self, own: DataFrame, inner: RiverNetwork, kernel: DataFrame, steps: int) -> DataFrame:
        flow = convolve(own, kernel, steps, self.router.over_kernels)
        if inner.include_self:
            return flow
        return flow.unionByName(own.filter(F.col("t").between(0, steps - 1))).groupBy("batch", "reach_id", "t").agg(F.sum("value").alias("value"))

    def route(self, runoff: DataFrame, network: RiverNetwork, plan: DataFrame, steps: int) -> DataFrame:
        """Discharge of all stages."""
        out = None
        for _, flow, _ in self.stages(runoff, network, plan, steps):
            out = flow if out is None else out.unionByName(flow)
        return runoff.select(*SERIES).limit(0) if out is None else out

    def boundary_before(self, runoff: DataFrame, network: RiverNetwork, plan: DataFrame, steps: int, stage: int) -> DataFrame:
        """What comes to ``stage`` and later ones from those before it: a start for ``stages(..., first=stage)``."""
        out = runoff.select(*SERIES).limit(0)
        for k, _, boundary in self.stages(runoff, network, plan, steps):
            if k < stage:
                out = boundary
            if k + 1 >= stage:
                break
        return out.join(plan.filter(F.col("stage") >= stage).select("reach_id"), "reach_id", "left_semi").groupBy("batch", "reach_id", "t").agg(F.sum("value").alias("value"))
