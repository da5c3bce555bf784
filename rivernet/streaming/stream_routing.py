"""Routing as a stream: a causal response of finite memory needs no state but the sums still open."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.kernel import long_kernel


def route_stream(runoff: DataFrame, kernel: DataFrame, step_seconds: int, late: str) -> DataFrame:
    """reach_id, window, value of a stream ``runoff(reach_id, ts, value)``.

    Every row spreads over the steps its water arrives in; a step's sum is final
    once the watermark of ``late`` has passed it.  The kernel is a static table.
    """
    x = runoff.withWatermark("ts", late).select(F.col("reach_id").alias("src"), "ts", "value")
    flow = x.join(long_kernel(kernel), "src").select(F.col("dst").alias("reach_id"), F.expr(f"ts + make_dt_interval(0, 0, 0, lag * {step_seconds})").alias("ts"), (F.col("value") * F.col("weight")).alias("value"))
    return flow.groupBy("reach_id", F.window("ts", f"{step_seconds} seconds")).agg(F.sum("value").alias("value"))


PENDING = "first BIGINT, sums ARRAY<DOUBLE>, held ARRAY<BOOLEAN>"
FLOW = "reach_id BIGINT, ts TIMESTAMP, value DOUBLE"


class PendingFlow(StatefulProcessor):
    """The sums of one reach's steps that are still open, as a buffer from the first of them on.

    A row of runoff adds to as many steps as its weights are long, so the buffer
    spans the watermark's delay, what one trigger brings, and the window.  Once
    the watermark has passed a step's end its sum is final: it goes out, and the
    buffer moves on.
    """

    def __init__(self, step_ms: int):
        self.step_ms = step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", PENDING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, sums, held = self._load()
        for part in rows:
            if not len(part):
                continue
            step = part["ts"].to_numpy().astype("datetime64[ms]").astype(np.int64) // self.step_ms
            weights = np.stack(part["weights"].to_numpy())
            if not len(sums):
                first = int(step.min())
            if step.min() < first:  # earlier than all so far, but not too late
                ahead = first - int(step.min())
                first, sums, held = int(step.min()), np.concatenate((np.zeros(ahead), sums)), np.concatenate((np.zeros(ahead, bool), held))
            more = int(step.max()) + weights.shape[1] - first - len(sums)
            if more > 0:
                sums, held = np.concatenate((sums, np.zeros(more))), np.concatenate((held, np.zeros(more, bool)))
            at = (step - first)[:, None] + np.arange(weights.shape[1])
            np.add.at(sums, at, part["value"].to_numpy()[:, None] * weights)
            held[at] = True
        yield from self._move_on(key, first, sums, held, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._move_on(key, *self._load(), timerValues)

    def close(self) -> None:
        pass

    def _load(self) -> tuple[int, np.ndarray, np.ndarray]:
        if not self.pending.exists():
            return 0, np.zeros(0), np.zeros(0, bool)
        first, sums, held = self.pending.get()
        return first, np.array(sums, float), np.array(held, bool)

    def _move_on(self, key, first: int, sums: np.ndarray, held: np.ndarray, timer_values) -> Iterator[pd.DataFrame]:
        final = min(len(sums), max(0, timer_values.getCurrentWatermarkInMs() // self.step_ms - first))
        out = np.flatnonzero(held[:final])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if final < len(sums):
            self.pending.update((first + final, sums[final:].tolist(), held[final:].tolist()))
            self.handle.registerTimer((first + final + 1) * self.step_ms)
        else:
            self.pending.clear()
        if len(out):
            yield pd.DataFrame({"reach_id": np.full(len(out), key[0], np.int64), "ts": pd.to_datetime((first + out) * self.step_ms, unit="ms"), "value": sums[out]})


def route_stateful(runoff: DataFrame, kernel: DataFrame, step_seconds: int, late: str) -> DataFrame:
    """reach_id, ts (a step's start), value of a stream ``runoff(reach_id, ts, value)``, each step once, for append mode.

    Rows later than the watermark of ``late`` are dropped.  State is a buffer a
    reach; it and the watermark lie in the query's checkpoint, so that a query
    that is stopped goes on where it was.  The session must use the RocksDB state
    store (``use_rocksdb``).
    """
    x = runoff.withWatermark("ts", late).select(F.col("reach_id").alias("src"), "ts", F.col("value").cast("double").alias("value"))
    met = x.join(kernel.select("src", F.col("dst").alias("reach_id"), "weights"), "src").select("reach_id", "ts", "value", "weights")
    return met.groupBy("reach_id").transformWithStateInPandas(statefulProcessor=PendingFlow(step_seconds * 1000), outputStructType=FLOW, outputMode="Append", timeMode="EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """State of any kind that streams keep goes to RocksDB, which ``route_stateful`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
