"""Cutting a network into clusters that are routed one after the other.

What a piece is follows from sums over what lies upstream of each reach, and
which cluster it goes to from ranks within its layer, so that any network is cut
by joins, grouped sums and windows: neither the closure of the whole network nor
a tree or the pieces in one place are needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import Rounds, settled
from .closure import downstream_sum, levels, outlets, running_total, upstream_fold

MEASURES = ("paths", "reaches")
RANGES = 256
PARTS = 4  # pieces of a block that is filled exactly


def chain_length(limit: int, measure: str) -> int:
    """Reaches of the longest chain within ``limit``: d (d + 1) / 2 is the length of all paths in one of d."""
    return max(1, (math.isqrt(8 * limit + 1) - 1) // 2 if measure == "paths" else limit)


def cut_plan(reaches: DataFrame, limit: int, measure: str = "paths") -> DataFrame:
    """reach_id, downstream_id, cut: whether a reach's outflow is cut, so that no piece's measure exceeds ``limit``.

    The measure is the length of all paths within a piece ("paths"), or its
    reaches.  Parts of the network whose whole upstream is within the limit stay
    together.  Of the reaches below, each takes on the one above it that drains
    most (the lower id, if several do); the trunks that this makes are cut into
    chains of the longest length allowed, counted from their lower end.  A way
    to the outlet changes trunks log2(reaches) times at most.
    """
    if measure not in MEASURES:
        raise NotImplementedError(f"measure {measure!r}; there are {MEASURES}")
    one = F.lit(1).cast("long")
    stats = upstream_fold(reaches, {"n": one, "length": one}, {"length": "n"})
    of = reaches.select("reach_id", "downstream_id").join(stats.select("reach_id", F.col("length" if measure == "paths" else "n").alias("size")), "reach_id")
    of = settled(of.withColumn("large", F.col("size") > limit))
    heaviest = of.filter("large AND downstream_id IS NOT NULL").groupBy(F.col("downstream_id").alias("reach_id")).agg(F.max_by("reach_id", F.struct("size", -F.col("reach_id"))).alias("above"))
    trunk = of.join(heaviest.select(F.col("above").alias("reach_id"), F.lit(True).alias("goes_on")), "reach_id", "left")
    trunk = settled(trunk.withColumn("goes_on", F.col("goes_on").isNotNull()))
    steps = trunk.filter("large").select("reach_id", F.when(F.col("goes_on"), F.col("downstream_id")).alias("downstream_id"), F.col("goes_on").cast("long").alias("place"))
    place = downstream_sum(steps, "place")  # steps to the trunk's lower end
    d = chain_length(limit, measure)
    ends = place.select("reach_id", (F.col("place") % d == 0).alias("at_end"))
    down = of.select(F.col("reach_id").alias("downstream_id"), F.col("large").alias("into_large"))
    rows = trunk.join(ends, "reach_id", "left").join(down, "downstream_id", "left")
    is_cut = F.when(F.col("large"), ~F.col("goes_on") | F.col("at_end")).otherwise(F.col("into_large"))
    return rows.select("reach_id", "downstream_id", (F.col("downstream_id").isNotNull() & is_cut).alias("cut"))


def breakpoints(reaches: DataFrame, path_limit: int) -> DataFrame:
    """reach_id of every reach whose outflow is cut, so that the paths of no piece are longer in all than ``path_limit``."""
    return cut_plan(reaches, path_limit).filter("cut").select("reach_id")


def block_breakpoints(reaches: DataFrame, size: int) -> DataFrame:
    """reach_id, piece: connected pieces of at most ``size`` reaches, each named by its last reach."""
    return pieces_of(reaches, cut_plan(reaches, size, "reaches").filter("cut")).select("reach_id", "piece")


def pieces_of(reaches: DataFrame, cuts: DataFrame) -> DataFrame:
    """reach_id, downstream_id, piece: after cutting the outflow of ``cuts``; a piece is named by its last reach."""
    marked = reaches.select("reach_id", "downstream_id").join(cuts.select("reach_id", F.lit(True).alias("cut")), "reach_id", "left")
    inner = marked.select("reach_id", F.when(F.col("cut").isNull(), F.col("downstream_id")).alias("downstream_id"))
    return marked.drop("cut").join(outlets(inner).withColumnRenamed("outlet", "piece"), "reach_id")


def transfers(assigned: DataFrame, cluster: str) -> DataFrame:
    """src_cluster, dst_cluster, src_reach, dst_reach: the edges whose ends lie in different clusters."""
    down = assigned.select(F.col("reach_id").alias("downstream_id"), F.col(cluster).alias("dst_cluster"))
    edges = assigned.filter("downstream_id IS NOT NULL").join(down, "downstream_id").filter(F.col(cluster) != F.col("dst_cluster"))
    return edges.select(F.col(cluster).alias("src_cluster"), "dst_cluster", F.col("reach_id").alias("src_reach"), F.col("downstream_id").alias("dst_reach"))


def transfer_tables(moves: DataFrame) -> DataFrame:
    """Adds transfer_id, counted from 0 within each sending cluster and then over them."""
    moves = settled(moves)
    counts = settled(moves.groupBy("src_cluster").agg(F.count("*").alias("n")))
    base = running_total(counts, "src_cluster", "n", "total").select("src_cluster", (F.col("total") - F.col("n")).alias("base"))
    nth = F.row_number().over(W.partitionBy("src_cluster").orderBy("src_reach"))
    return moves.withColumn("nth", nth).join(base, "src_cluster").select((F.col("base") + F.col("nth") - 1).alias("transfer_id"), "src_cluster", "dst_cluster", "src_reach", "dst_reach")


def cluster_ranges(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """cluster, start, end: the place of each cluster's reaches when all lie in a row."""
    counts = settled(assigned.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n")))
    return running_total(counts, "cluster", "n", "end").select("cluster", (F.col("end") - F.col("n")).alias("start"), "end")


def stages(moves: DataFrame, nodes: DataFrame) -> DataFrame:
    """cluster, stage for ``nodes(cluster)``: 0 without upstream clusters, else one more than the latest of them; raises on a cycle.

    Where every cluster drains to one other at most they are levels of a forest,
    found in log2(stages) rounds; else a round a stage.
    """
    links = settled(moves.select("src_cluster", "dst_cluster").distinct())
    if links.groupBy("src_cluster").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        forest = nodes.select("cluster").distinct().join(links, F.col("cluster") == F.col("src_cluster"), "left").select(F.col("cluster").alias("reach_id"), F.col("dst_cluster").alias("downstream_id"))
        return levels(forest).select(F.col("reach_id").alias("cluster"), F.col("level").alias("stage"))
    reached, latest = Rounds(nodes.select("cluster", F.lit(0).alias("stage"))), None
    most, k = None, 0
    while True:
        k += 1
        here = reached.table if latest is None else latest.table
        later = here.join(links, F.col("cluster") == F.col("src_cluster")).select(F.col("dst_cluster").alias("cluster"), F.lit(k).alias("stage")).distinct()
        latest = Rounds(later)
        if latest.table.isEmpty():
            return reached.table
        most = most or nodes.count()
        if k > most:
            raise ValueError("clusters depend on each other in a cycle")
        reached.put(reached.table.unionByName(latest.table).groupBy("cluster").agg(F.max("stage").alias("stage")))


def ranked(rows: DataFrame, keys: list[str], id_: str, name: str = "rank") -> DataFrame:
    """Adds the place of each row by ``id_`` among those of the same ``keys``, from 0.

    Rows are counted within ranges of the id, then over the ranges: no task holds a whole group.
    """
    low, high = rows.agg(F.min(id_), F.max(id_)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // RANGES))
    rows = rows.withColumn("_part", F.expr(f"({id_} - {low or 0}L) div {width}L"))
    counts = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = rows.withColumn("_in", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(id_)))
    return inside.join(base, [*keys, "_part"]).withColumn(name, F.col("_base") + F.col("_in") - 1).drop("_part", "_in", "_base")


def _named(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds ``name``, a number for each (small) group of ``keys``: the lowest piece in it."""
    return rows.withColumn(name, F.min("piece").over(W.partitionBy(*keys)))


@cache
def exact_patterns(limit: int, parts: int = PARTS) -> tuple[tuple[int, ...], ...]:
    """All ways to write ``limit`` as 2 to ``parts`` sizes, fewer parts first, then the larger sizes first."""

    def ways(left: int, n: int, most: int) -> Iterator[tuple[int, ...]]:
        if n == 1:
            if left <= most:
                yield (left,)
            return
        for first in range(min(most, left - n + 1), -(-left // n) - 1, -1):
            yield from ((first, *rest) for rest in ways(left - first, n - 1, first))

    return tuple(p for n in range(2, parts + 1) for p in ways(limit, n, limit - 1))


def _fill(sizes: pd.DataFrame, limit: int, parts: int) -> pd.DataFrame:
    """layer, n, pattern, each, low, high: which ranks of a layer's pieces of n reaches go to a pattern, ``each`` to a block.

    ``sizes(layer, n, count)`` has a row for each size in one layer.  Every
    pattern in turn is taken as often as what is left allows.
    """
    left = dict(zip(sizes["n"].tolist(), sizes["count"].tolist(), strict=True))
    used, rows, layer = dict.fromkeys(left, 0), [], sizes["layer"].iloc[0]
    for k, pattern in enumerate(exact_patterns(limit, parts)):
        each = {n: pattern.count(n) for n in pattern}
        times = min(left.get(n, 0) // m for n, m in each.items())
        for n, m in each.items() if times else ():
            rows.append((layer, n, k, m, used[n], used[n] + times * m))
            left[n] -= times * m
            used[n] += times * m
    return pd.DataFrame(rows, columns=["layer", "n", "pattern", "each", "low", "high"])


def exact_blocks(pieces: DataFrame, limit: int, parts: int = PARTS) -> DataFrame:
    """piece, n, layer, bin of those pieces that fill blocks of ``limit`` exactly, two to ``parts`` of a layer to a block.

    Sizes are counted by layer, patterns of sizes are laid over the counts, and
    pieces go to them by their rank in layer and size: no task sees the pieces
    of a layer, only its counts, ``limit`` rows at most.
    """
    rows = settled(ranked(pieces.select("piece", "n", "layer"), ["layer", "n"], "piece"))
    counts = rows.filter(F.col("n") < limit).groupBy("layer", "n").agg(F.count("*").alias("count"))
    fills = counts.groupBy("layer").applyInPandas(lambda sizes: _fill(sizes, limit, parts), "layer int, n long, pattern int, each long, low long, high long")
    by_size = settled(fills.groupBy("layer", "n").agg(F.collect_list(F.struct("low", "high", "pattern", "each")).alias("fills")))
    met = rows.join(by_size, ["layer", "n"]).withColumn("f", F.get(F.filter("fills", lambda f: (f["low"] <= F.col("rank")) & (F.col("rank") < f["high"])), F.lit(0)))
    met = met.filter("f IS NOT NULL").select("piece", "n", "layer", F.col("f.pattern").alias("_pattern"), F.expr("(rank - f.low) div f.each").alias("_nth"))
    return _named(met, ["layer", "_pattern", "_nth"], "bin").select("piece", "n", "layer", "bin")


def by_size_class(pieces: DataFrame, limit: int) -> DataFrame:
    """piece, n, layer, bin: of the pieces of a layer with limit / 2 ** (j + 1) < n <= limit / 2 ** j each 2 ** j share a bin.

    So a bin holds at most ``limit`` reaches and, but for the last of a class,
    over half of it.  A larger piece has a bin of its own.
    """
    j = F.greatest(F.floor(F.log2(F.lit(float(limit)) / F.col("n") + 1e-9)), F.lit(0)).cast("int")
    rows = ranked(pieces.withColumn("_j", j), ["layer", "_j"], "piece")
    rows = rows.withColumn("_nth", F.expr("shiftright(rank, _j)"))
    return _named(rows, ["layer", "_j", "_nth"], "bin").select("piece", "n", "layer", "bin")


def packed_blocks(pieces: DataFrame, block: int) -> DataFrame:
    """piece, n, layer, bin of at most ``block`` reaches: exactly filled ones first, what is left by size class."""
    full = settled(exact_blocks(pieces, block))
    rest = by_size_class(pieces.join(full.select("piece"), "piece", "left_anti").select("piece", "n", "layer"), block)
    return full.unionByName(rest)


def schedule(reaches: DataFrame, path_limit: int = 100_000, node_limit: int = 10_000, strategy: str = "paths", block: int = 16) -> DataFrame:
    """reach_id, downstream_id, piece, cluster, stage.

    ``strategy="paths"`` cuts by total path length, ``"blocks"`` into pieces of
    at most ``block`` reaches, which are packed into blocks that count as full.
    A piece's layer is the number of pieces on the longest way to it.  Clusters
    hold pieces of one layer, of at most ``node_limit`` reaches in all (a larger
    piece has one of its own), and are named by their lowest piece; the stage is
    the layer.
    """
    if strategy not in ("paths", "blocks"):
        raise NotImplementedError(f"strategy {strategy!r}")
    plan = cut_plan(reaches, path_limit) if strategy == "paths" else cut_plan(reaches, block, "reaches")
    assigned = settled(pieces_of(reaches, plan.filter("cut")))
    last = assigned.filter("reach_id = piece").select("piece", "downstream_id")
    of = assigned.select(F.col("reach_id").alias("downstream_id"), F.col("piece").alias("_down"))
    links = last.join(of, "downstream_id", "left").select(F.col("piece").alias("reach_id"), F.col("_down").alias("downstream_id"))
    layer = levels(settled(links)).select(F.col("reach_id").alias("piece"), F.col("level").alias("layer"))
    pieces = settled(assigned.groupBy("piece").agg(F.count("*").alias("n")).join(layer, "piece"))
    if strategy == "blocks":
        bins = settled(packed_blocks(pieces, block))
        blocks = bins.groupBy("bin", "layer").agg(F.min("piece").alias("piece"))
        nth = F.expr(f"rank div {max(1, node_limit // block)}L")
        whole = _named(ranked(blocks, ["layer"], "piece").withColumn("_nth", nth), ["layer", "_nth"], "cluster").select("bin", "cluster")
        places = bins.join(whole, "bin").select("piece", "cluster", F.col("layer").alias("stage"))
    else:
        places = by_size_class(pieces, node_limit).select("piece", F.col("bin").alias("cluster"), F.col("layer").alias("stage"))
    return assigned.join(places, "piece").select("reach_id", "downstream_id", "piece", "cluster", "stage")
