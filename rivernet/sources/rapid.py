"""RAPID projects: connectivity, reach ids and Muskingum parameters as CSV files without headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import settled
from ..operators.network import NetworkError, RiverNetwork
from ..operators.segmentation import schedule

SECONDS_A_DAY = 86_400


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, value: the rows of a text file in order, numbered from 0 by split, then within each split."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("id"))
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    base = counts.select("file", "block", F.coalesce(F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row a split
    nth = F.row_number().over(W.partitionBy("file", "block").orderBy("id"))
    return lines.withColumn("nth", nth).join(base, ["file", "block"]).select((F.col("base") + F.col("nth") - 1).alias("line"), "value")


def _number(column: str) -> F.Column:
    return F.trim(F.element_at(F.split(column, ","), 1)).cast("double")


def read_rapid_reaches(spark: SparkSession, folder: str, connect: str = "rapid_connect.csv", ids: str = "riv_bas_id.csv", k: str = "k.csv", x: str = "x.csv") -> DataFrame:
    """reach_id, downstream_id, k (days), x.  -1 downstream means none; columns after the second are ignored."""
    edges = spark.read.text(f"{folder}/{connect}").select(F.split("value", ",").alias("c"))
    edges = edges.select(F.trim(F.col("c")[0]).cast("long").alias("reach_id"), F.nullif(F.trim(F.col("c")[1]).cast("long"), F.lit(-1)).alias("downstream_id"))
    rows = numbered_lines(spark, f"{folder}/{ids}").select("line", _number("value").cast("long").alias("reach_id"))
    for name, file in (("k", k), ("x", x)):
        rows = rows.join(numbered_lines(spark, f"{folder}/{file}").select("line", _number("value").alias(name)), "line", "full")
    if not rows.filter("reach_id IS NULL OR k IS NULL OR x IS NULL").isEmpty():
        raise NetworkError("the files of ids, k and x don't have the same rows")
    reaches = edges.join(rows.select("reach_id", (F.col("k") / SECONDS_A_DAY).alias("k"), "x"), "reach_id", "left")
    if not reaches.filter("k IS NULL OR x IS NULL").isEmpty():
        raise NetworkError("a reach of the connectivity file has no parameters")
    return reaches


def union_reaches(tables: Sequence[DataFrame]) -> DataFrame:
    """All reaches once; raises where two projects say different things of one."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    first = first.distinct()
    if not first.groupBy("reach_id").count().filter("count > 1").isEmpty():
        raise NetworkError("projects disagree on a reach")
    return first


def read_rapid(spark: SparkSession, folder: str | Sequence[str], **files: str) -> RiverNetwork:
    """A Muskingum network of one project or of several together."""
    folders = [folder] if isinstance(folder, str) else list(folder)
    return RiverNetwork(union_reaches([read_rapid_reaches(spark, f, **files) for f in folders]), "muskingum").validate()


def read_rapid_segmented(spark: SparkSession, folder: str | Sequence[str], path_limit: int, node_limit: int, **files: str) -> tuple[RiverNetwork, DataFrame]:
    """The network and its schedule (reach_id, downstream_id, piece, cluster, stage) for ``StagedRouter``."""
    network = read_rapid(spark, folder, **files)
    return network, schedule(network.reaches, path_limit, node_limit)


def write_rapid(reaches: DataFrame, folder: str) -> None:
    """The four files of a project (each a folder of parts in the order of reaches) of ``reaches(reach_id, downstream_id, k, x)``."""
    rows = reaches.select("reach_id", F.coalesce("downstream_id", F.lit(-1)).alias("down"), (F.col("k") * SECONDS_A_DAY).alias("k"), "x")
    rows = settled(rows)
    for name, columns in (("rapid_connect", ["reach_id", "down"]), ("riv_bas_id", ["reach_id"]), ("k", ["reach_id", "k"]), ("x", ["reach_id", "x"])):
        rows.select(*columns).repartitionByRange("reach_id").sortWithinPartitions("reach_id").select(*columns[-1:] if name in ("k", "x") else columns).write.csv(f"{folder}/{name}.csv")
