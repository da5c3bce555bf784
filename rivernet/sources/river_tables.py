"""River networks and runoff derived from the order and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONTHS, DAYS = 80, 30


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parameters(r: Column) -> list[Column]:
    return [
        (0.5 + 0.5 * (r % 5)).alias("tau"), (0.2 * (1 + r % 7)).alias("delay"), (1 + 0.25 * (r % 4)).alias("k"), (0.1 + 0.05 * (r % 4)).alias("x"),
        (5.0 + r % 6).alias("L"), (0.5 + 0.1 * (r % 6)).alias("D"), (1 + 0.1 * (r % 5)).alias("c"), (1 + 0.5 * (r % 3)).alias("shape"), (1.0 + r % 4).alias("scale"), (0.3 * (r % 3)).alias("onset"),
    ]


def _network(ids: DataFrame, downstream: Column) -> DataFrame:
    return ids.select("reach_id", downstream.cast("long").alias("downstream_id"), *parameters(F.col("reach_id")))


def heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _read(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).cast("long").alias("reach_id"))
    return _network(ids, F.expr("nullif(reach_id div 2, 0)"))


def chain32(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _read(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).cast("long").alias("reach_id"))
    last = ids.agg(F.max("reach_id")).first()[0]
    return _network(ids, F.when((F.col("reach_id") % 32 != 0) & (F.col("reach_id") != last), F.col("reach_id") + 1))


def admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).cast("long").alias("reach_id"), (F.col("c_nationkey") + 100).cast("long").alias("down"))
    n = _read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("reach_id"), (F.col("n_regionkey") + 1).cast("long").alias("down"))
    r = _read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("reach_id"), F.lit(None).cast("long").alias("down"))
    return _network(c.unionByName(n).unionByName(r), F.col("down"))


def event_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _read(spark, sf_dir, "events").select((F.col("user_id") + 1).cast("long").alias("reach_id")).distinct()
    return _network(ids, F.expr("nullif(reach_id div 2, 0)"))


def monthly_runoff(spark: SparkSession, sf_dir: str, batch: str | None = None) -> DataFrame:
    t = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    name = F.lit("all") if batch is None else F.col(batch)
    return _read(spark, sf_dir, "orders").groupBy(name.alias("batch"), (F.col("o_custkey") + 1).cast("long").alias("reach_id"), t.cast("int").alias("t")).agg(F.sum("o_totalprice").cast("double").alias("value"))


def daily_runoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("batch"), (F.col("user_id") + 1).cast("long").alias("reach_id"), (F.dayofmonth("ts") - 1).alias("t")).agg(F.sum("value").cast("double").alias("value"))
