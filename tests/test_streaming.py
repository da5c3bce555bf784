"""Stateful routing of a stream against batch routing: append mode, several triggers, late rows, a restart."""

import os

import pytest
from pyspark.sql import functions as F

from rivernet.operators import convolution as V
from rivernet.operators import kernel as K
from rivernet.operators.network import RiverNetwork
from rivernet.streaming.stream_routing import route_stateful, use_rocksdb

from .test_routing import tree

SCHEMA = "reach_id long, ts timestamp, value double"


def test_stateful_routing(spark, tmp_path):
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    use_rocksdb(spark)
    kernel = K.build_kernel(RiverNetwork(tree(spark, 3)), 3)
    day = lambda d: f"2024-01-{d:02d} 06:00:00"
    parts = [
        [(2, day(1), 1.0), (3, day(2), 2.0), (1, day(2), 4.0)],
        [(2, day(2), 8.0), (3, day(1), 16.0), (2, day(5), 32.0)],  # a day late at most: in time
        [(2, day(4), 64.0), (3, day(1), 1000.0), (1, day(9), 128.0)],  # day 1 is too late by now
        [(3, day(10), 256.0), (3, day(3), 1000.0)],  # so is day 3
        [(99, day(25), 0.0)],  # no reach of the network; moves the watermark on
        [(99, day(26), 0.0)],
    ]
    os.makedirs(tmp_path / "in")

    def add(k):
        spark.createDataFrame(parts[k], "reach_id long, ts string, value double").select("reach_id", F.col("ts").cast("timestamp").alias("ts"), "value").coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        (name,) = [n for n in os.listdir(tmp_path / f"part{k}") if n.endswith(".parquet")]
        os.rename(tmp_path / f"part{k}" / name, tmp_path / "in" / f"{k}.parquet")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        flow = route_stateful(stream, kernel, 86_400, "30 hours")
        flow.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    try:
        for k in (0, 1, 2):
            add(k)
            run()  # each is a restart from the checkpoint
        some = spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).count()
        for k in (3, 4, 5):
            add(k)
        run()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    rows = spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect()
    got = {(r.reach_id, (r.ts.month - 1) * 31 + r.ts.day): r.value for r in rows}
    assert len(got) == len(rows) and 0 < some < len(rows)
    inside = [("a", i, int(ts[8:10]), v) for part in parts for i, ts, v in part if v != 1000.0 and i != 99]
    want = {(r.reach_id, r.t): r.value for r in V.convolve(spark.createDataFrame(inside, "batch string, reach_id long, t int, value double"), kernel, 40).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
