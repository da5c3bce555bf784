"""Networks of great depth or width, and blocks that are filled exactly."""

import time

import pytest
from pyspark.sql import functions as F

from rivernet.operators import closure as G
from rivernet.operators import segmentation as C

MANY = 100_000


def network(spark, kind):
    ids = spark.range(1, MANY + 1).withColumnRenamed("id", "reach_id")
    down = F.when(F.col("reach_id") < MANY, F.col("reach_id") + 1) if kind == "chain" else F.when(F.col("reach_id") > 1, F.lit(1).cast("long"))
    return ids.withColumn("downstream_id", down)


@pytest.mark.parametrize("kind", ["chain", "star"])
def test_a_hundred_thousand_reaches_are_segmented(spark, kind):
    began = time.time()
    reaches = network(spark, kind)
    plan = C.schedule(reaches, path_limit=5_050, node_limit=10_000).cache()
    rows = plan.agg(F.count("*"), F.count_distinct("reach_id"), F.max("stage")).first()
    pieces = plan.groupBy("piece").agg(F.count("*").alias("n"), F.min("reach_id").alias("low"), F.max("reach_id").alias("high")).agg(F.max("n"), F.bool_and(F.col("high") - F.col("low") + 1 == F.col("n")), F.count("*")).first()
    assert tuple(rows)[:2] == (MANY, MANY)
    if kind == "chain":  # the first 100 reaches have 5,050 steps of paths; chains of 100 below
        assert tuple(pieces) == (100, True, MANY // 100) and rows[2] == MANY // 100 - 1
    else:  # all reaches but the outlet drain into it
        assert pieces[0] == 1 and rows[2] == 1
    assert plan.groupBy("cluster").count().agg(F.max("count")).first()[0] <= 10_000
    plan.unpersist()
    assert time.time() - began < 300


def test_sums_over_a_deep_chain(spark):
    reaches = network(spark, "chain").withColumn("one", F.lit(1.0))
    down = G.downstream_sum(reaches, "one").agg(F.sum("one"), F.max("one")).first()
    assert tuple(down) == (MANY * (MANY + 1) / 2, MANY)
    assert G.upstream_counts(reaches).agg(F.sum("n_upstream")).first()[0] == MANY * (MANY + 1) // 2
    assert G.outlets(reaches).filter(F.col("outlet") != MANY).isEmpty()


def test_stages_of_a_deep_forest_and_of_clusters_with_several_ways_on(spark):
    chain = spark.range(0, 3_000).select(F.col("id").alias("src_cluster"), (F.col("id") + 1).alias("dst_cluster"))
    nodes = spark.range(0, 3_001).withColumnRenamed("id", "cluster")
    assert C.stages(chain, nodes).filter("cluster <> stage").isEmpty()
    links = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (3, 2), (2, 4), (0, 4)], "src_cluster long, dst_cluster long")
    found = C.stages(links, spark.range(0, 6).withColumnRenamed("id", "cluster"))
    assert {r.cluster: r.stage for r in found.collect()} == {0: 0, 1: 1, 2: 3, 3: 2, 4: 4, 5: 0}
    with pytest.raises(ValueError, match="cycle"):
        C.stages(links.unionByName(spark.createDataFrame([(4, 1)], "src_cluster long, dst_cluster long")), spark.range(0, 6).withColumnRenamed("id", "cluster"))


def test_patterns():
    found = C.exact_patterns(6)
    assert found == ((5, 1), (4, 2), (3, 3), (4, 1, 1), (3, 2, 1), (2, 2, 2), (3, 1, 1, 1), (2, 2, 1, 1))
    assert C.exact_patterns(1) == () and C.exact_patterns(2) == ((1, 1),)
    assert all(sum(p) == 16 for p in C.exact_patterns(16)) and len(set(C.exact_patterns(16))) == len(C.exact_patterns(16))


def test_blocks_of_three_and_more_fill_the_limit(spark):
    # layer 0: 5 + 3 twice, then 4 + 3 + 1, then 3 + 2 + 2 + 1; layer 1 fills nothing
    sizes = {0: [5, 5, 3, 3, 3, 3, 2, 2, 4, 1, 1], 1: [7, 7, 6, 8]}
    rows = [(100 * layer + i, n, layer) for layer, ns in sizes.items() for i, n in enumerate(ns)]
    pieces = spark.createDataFrame(rows, "piece long, n long, layer int")
    of = {r.piece: r.bin for r in C.exact_blocks(pieces, 8).collect()}
    load = {}
    for piece, n, _ in rows:
        if piece in of:
            load.setdefault(of[piece], []).append(n)
    assert sorted(map(sorted, load.values())) == [[1, 2, 2, 3], [1, 3, 4], [3, 5], [3, 5]]
    packed = {r.piece: r.bin for r in C.packed_blocks(pieces, 8).collect()}
    assert len(packed) == len(rows) and all(packed[p] == b for p, b in of.items())


@pytest.mark.parametrize("limit", [5, 12])
def test_no_pattern_is_left_open(spark, limit):
    """After packing no pattern of sizes can be filled from the pieces that are left."""
    rows = [(i, 1 + (i * i + 3 * i) % (limit + 1), i % 3) for i in range(300)]
    pieces = spark.createDataFrame(rows, "piece long, n long, layer int")
    full = {r.piece for r in C.exact_blocks(pieces, limit).collect()}
    for layer in range(3):
        left = [n for p, n, at in rows if at == layer and p not in full]
        assert not [p for p in C.exact_patterns(limit) if all(left.count(n) >= p.count(n) for n in p)]
