"""Convolution in tiles of time and blocks of reaches, tour intervals, bucketed stages, and series files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivernet.operators import closure as G
from rivernet.operators import convolution as V
from rivernet.operators import kernel as K
from rivernet.operators.network import RiverNetwork
from rivernet.operators.staged import StageStore
from rivernet.sources import series_files as S

from .test_routing import runoff_of, tree

BATCH = "batch string, reach_id long, t int, value double"


def rows_of(flow):
    return {(r.batch, r.reach_id, r.t): r.value for r in flow.collect()}


def same(a, b, rel=1e-9):
    assert set(a) == set(b) and all(a[k] == pytest.approx(v, rel=rel, abs=1e-9) for k, v in b.items())


@pytest.mark.parametrize("strategy", ["packed", "blocks"])
@pytest.mark.parametrize("tile", [3, 8, 64])
def test_tiles_give_the_rows_of_single_steps(spark, strategy, tile):
    """Windows longer and shorter than a tile, dense and sparse series, several and no names of a batch."""
    kernel = K.build_kernel(RiverNetwork(tree(spark, 21)), 7)
    dense, _ = runoff_of(spark, range(1, 22), 30, ("a", "b"))
    sparse = dense.filter(F.xxhash64("batch", "reach_id", "t") % 11 == 0).withColumn("batch", F.when(F.col("batch") == "a", "a"))
    for runoff in (dense, sparse, dense.limit(0)):
        same(rows_of(V.convolve(runoff, kernel, 30, strategy, tile)), rows_of(V.convolve(runoff, kernel, 30)))


@pytest.mark.parametrize("direct", [V.DIRECT, 0])
def test_transforms_and_sums_agree(spark, monkeypatch, direct):
    monkeypatch.setattr(V, "DIRECT", direct)
    kernel = K.build_kernel(RiverNetwork(tree(spark, 9)), 20)
    runoff, _ = runoff_of(spark, range(1, 10), 50)
    same(rows_of(V.convolve(runoff, kernel, 50, "packed", 16)), rows_of(V.convolve(runoff, kernel, 50)))


def test_a_million_steps(spark):
    """No row holds a series: 1,000,000 steps in tiles of 1,024."""
    n = 1_000_000
    kernel = K.build_kernel(RiverNetwork(tree(spark, 2)), 4)
    runoff = spark.range(n).select(F.lit("a").alias("batch"), F.lit(2).cast("long").alias("reach_id"), F.col("id").cast("int").alias("t"), (F.col("id") % 17 + 0.5).alias("value"))
    tiled, long = V.convolve(runoff, kernel, n, "packed"), V.convolve(runoff, kernel, n)
    off = tiled.join(long.withColumnRenamed("value", "want"), ["batch", "reach_id", "t"], "full").filter("value IS NULL OR want IS NULL OR abs(value - want) > 1e-9 * want")
    assert tiled.count() == 2 * n and off.isEmpty()


@pytest.mark.parametrize("tile", [4, 1024])
def test_gradient_by_weights_in_tiles(spark, tile):
    pairs = G.closure(tree(spark, 9))
    x, xs = runoff_of(spark, range(1, 10), 20, ("a", "b"))
    dy, ys = runoff_of(spark, range(1, 8), 20, ("a", "b"), seed=4)
    got = {(r.dst, r.src, r.lag): r.value for r in V.adjoint_kernel(dy, x, pairs, 6, tile).collect()}
    want = {}
    for p in pairs.collect():
        for lag in range(6):
            if p.dst < 8:
                want[p.dst, p.src, lag] = sum(ys[b, p.dst][t] * xs[b, p.src][t - lag] for b in "ab" for t in range(lag, 20))
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())


@pytest.mark.parametrize("run", [G.RUN, 2])
def test_upstream_sets_are_intervals(spark, monkeypatch, run):
    monkeypatch.setattr(G, "RUN", run)
    rows = [(i, i // 3 if i > 2 else None) for i in range(1, 60)] + [(-5, None), (-7, -5), (-6, -5), (1 << 40, -7)]
    reaches = spark.createDataFrame(rows, "reach_id long, downstream_id long")
    at = {r.reach_id: r for r in G.intervals(reaches).collect()}
    assert sorted(r.place for r in at.values()) == list(range(len(rows)))
    want = {(p.dst, p.src) for p in G.closure(reaches).filter("dist > 0").collect()}
    assert {(u, v) for u in at for v in at if at[u].place < at[v].place < at[u].place + at[u].size} == want
    assert {tuple(r) for r in G.upstream_sets(reaches).collect()} == want
    of = spark.createDataFrame([(2,), (-5,), (59,)], "reach_id long")
    assert {tuple(r) for r in G.upstream_sets(reaches, of).collect()} == {p for p in want if p[0] in (2, -5)}
    assert G.upstream_sets(reaches.limit(0)).count() == 0


def test_kernel_and_inflow_of_a_stage_meet_without_an_exchange(spark):
    kernel = K.build_kernel(RiverNetwork(tree(spark, 9)), 4).withColumn("stage", F.col("dst").cast("int") % 2)
    runoff, _ = runoff_of(spark, range(1, 10), 5)
    store = StageStore(kernel)
    store.put("kernel", kernel, "src")
    store.put("inflow", runoff.withColumn("stage", F.lit(1)), "reach_id")
    store.put("inflow", runoff.withColumn("stage", F.lit(1)), "reach_id")
    into = store.get("inflow", 1).groupBy("batch", "reach_id", "t").agg(F.sum("value").alias("value"))
    joined = into.withColumnRenamed("reach_id", "src").join(store.get("kernel", 1).hint("merge"), "src")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
    assert joined.count() == kernel.filter("stage = 1").count() * 5 and into.agg(F.sum("value")).first()[0] == pytest.approx(2 * runoff.agg(F.sum("value")).first()[0])


def test_dense_matrices_of_groups(spark):
    kernel = spark.createDataFrame([(1, 1, [1.0, 2.0]), (1, 2, [3.0, 0.0]), (1, 2, [1.0, 1.0]), (3, 1, [9.0, 9.0])], "dst long, src long, weights array<double>")
    of = spark.createDataFrame([(1, 0), (2, 0), (3, 7)], "reach_id long, grp int")
    got = {(r.dst, r.src, r.lag): r.weight for r in K.to_dense_groups(kernel, of, 2).collect()}
    assert len(got) == 2 * 2 * 2 + 2 and {k: v for k, v in got.items() if v} == {(1, 1, 0): 1.0, (1, 1, 1): 2.0, (1, 2, 0): 4.0, (1, 2, 1): 1.0}


# --- series files ---


def test_series_come_back(spark, tmp_path):
    runoff, _ = runoff_of(spark, [5, 6, 70, 1 << 40], 9, ("a", "b"))
    some = runoff.filter("NOT (reach_id = 6 AND t IN (0, 3))").unionByName(spark.createDataFrame([("a", 5, 0, 0.0), ("a", 5, 11, 3.0)], BATCH))
    S.write_series(some, str(tmp_path / "s"), 9, files=3)
    back = S.read_series(spark, str(tmp_path / "s"), values=4)
    same(rows_of(back), rows_of(some.filter("t < 9").groupBy("batch", "reach_id", "t").agg(F.sum("value").alias("value"))))
    picked = back.filter("reach_id IN (6, 70, 71) AND reach_id >= 6 AND t > 2 AND t <= 5 AND value > 0")
    same(rows_of(picked), rows_of(some.filter("reach_id IN (6, 70) AND t BETWEEN 3 AND 5")))
    assert back.filter("reach_id = 5 AND t = 4").count() == 2 and back.filter("reach_id < 5").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        S.read_series(spark, str(tmp_path / "nowhere")).count()


def test_conditions_choose_splits(tmp_path):
    from pyspark.sql import datasource as ds

    values = np.arange(40.0).reshape(8, 5)
    (tmp_path / "x.nc").write_bytes(S.file_bytes(np.array([3, 4, 9, 10, 12]), values, ("time", "rivid", "rivid", "runoff"), "day"))

    def reader(*filters):
        r = S.SeriesReader({"path": str(tmp_path), "values": "6"})
        return r, list(r.pushFilters(list(filters)))

    r, left = reader()
    assert len(r.partitions()) == 8 and not left
    r, left = reader(ds.GreaterThan(("reach_id",), 4), ds.LessThanOrEqual(("reach_id",), 10), ds.GreaterThanOrEqual(("t",), 2), ds.LessThan(("t",), 5), ds.IsNotNull(("t",)), ds.GreaterThan(("value",), 1.0))
    assert left == [ds.GreaterThan(("value",), 1.0)]
    parts = r.partitions()
    assert [(p.low, p.high, p.first, p.last) for p in parts] == [(2, 4, 2, 5)]
    got = [tuple(x.values()) for p in parts for b in r.read(p) for x in b.to_pylist()]
    assert got == [("day", i, t, float(5 * t + c)) for t in (2, 3, 4) for i, c in ((9, 2), (10, 3))]
    assert not reader(ds.In(("reach_id",), (1, 2)))[0].partitions()


def test_other_layouts_of_files(spark, tmp_path):
    """Version 1, records, values by reach, a fill value, whole numbers; and what is no such file."""
    import struct

    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    none = struct.pack(">ii", 0, 0)
    ids = np.array([7, 8, 9], ">i4")
    fill = name("_FillValue") + struct.pack(">iif", 5, 1, -1.0)
    dims = struct.pack(">ii", 10, 2) + name("time") + struct.pack(">i", 0) + name("rivid") + struct.pack(">i", 3)

    def head(at):
        one = name("rivid") + struct.pack(">ii", 1, 1) + none + struct.pack(">iii", 4, 12, at)
        two = name("Qout") + struct.pack(">iii", 2, 0, 1) + struct.pack(">ii", 12, 1) + fill + struct.pack(">iii", 5, 12, at + 12)
        other = name("other") + struct.pack(">ii", 1, 0) + none + struct.pack(">iii", 6, 8, at + 24)
        return b"CDF\x01" + struct.pack(">i", 2) + dims + none + struct.pack(">ii", 11, 3) + one + two + other

    start = len(head(0))
    records = b"".join(np.array(v, ">f4").tobytes() + struct.pack(">d", 5.0) for v in ([1, -1, 3], [4, 5, 6]))
    (tmp_path / "q.nc").write_bytes(head(start) + ids.tobytes() + records)
    found = S.read_series(spark, str(tmp_path / "q.nc"), variable="Qout", batch="run", values=2)
    assert rows_of(found) == {("run", 7, 0): 1.0, ("run", 9, 0): 3.0, ("run", 7, 1): 4.0, ("run", 8, 1): 5.0, ("run", 9, 1): 6.0}
    assert rows_of(found.filter("reach_id > 7")) == {("run", 9, 0): 3.0, ("run", 8, 1): 5.0, ("run", 9, 1): 6.0}
    (tmp_path / "bad.nc").write_bytes(b"HDF whatever")
    with pytest.raises(Exception, match="not a NetCDF classic file"):
        S.read_series(spark, str(tmp_path / "bad.nc")).count()
