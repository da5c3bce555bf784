"""The routing operators against NumPy, and the properties they must have."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivernet.functions import irf, sampling
from rivernet.operators import closure as G
from rivernet.operators import convolution as V
from rivernet.operators import kernel as K
from rivernet.operators import segmentation as C
from rivernet.operators.network import NetworkError, RiverNetwork, check_runoff, from_edges
from rivernet.operators.routing import Router, parameter_gradient, parameter_sweep
from rivernet.operators.staged import StagedRouter
from rivernet.sources import rapid

COLUMNS = "reach_id long, downstream_id long, tau double, x double, k double, delay double, L double, D double, c double, shape double, scale double, onset double"
MINI = [(0, 1, 2.0, 0.2, 2.0, 2.0, 10.0, 1.0, 1.0, 1.5, 2.0, 0.5), (1, 2, 1.5, 0.3, 1.5, 1.5, 8.0, 0.8, 1.2, 1.0, 1.0, 0.0), (2, None, 1.0, 0.4, 1.0, 1.0, 5.0, 0.5, 1.5, 2.0, 3.0, 0.0)]
T = 80


def reaches_of(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def tree(spark, n, tau=lambda i: 0.5 + 0.5 * (i % 5)):
    return spark.createDataFrame([(i, i // 2 or None, tau(i)) for i in range(1, n + 1)], "reach_id long, downstream_id long, tau double")


def runoff_of(spark, ids, steps=T, batches=("a",), seed=0):
    rng = np.random.default_rng(seed)
    x = {(b, i): rng.random(steps) for b in batches for i in ids}
    return spark.createDataFrame([(b, i, t, float(v)) for (b, i), s in x.items() for t, v in enumerate(s)], "batch string, reach_id long, t int, value double"), x


def response(name, row, n, dt):
    p = dict(zip([c.split()[0] for c in COLUMNS.split(", ")], row))
    i = np.arange(n, dtype=float)
    if name == "pure_lag":
        return np.maximum(0, 1 - np.abs(i - p["delay"] / dt))
    if name in ("linear_storage", "nash_cascade"):
        x = 1 / (1 + p["tau"] / dt)
        return x * (1 - x) ** i if name == "linear_storage" else (i + 1) * (i + 2) / 2 * x**3 * (1 - x) ** i
    if name == "muskingum":
        d = p["k"] * (1 - p["x"]) + dt / 2
        c0, c1, c2 = (dt / 2 - p["k"] * p["x"]) / d, (dt / 2 + p["k"] * p["x"]) / d, (p["k"] * (1 - p["x"]) - dt / 2) / d
        return np.array([c0 if t == 0 else (c1 + c2 * c0) * c2 ** (t - 1) for t in range(n)])
    t = (i + 1) * dt
    h = p["L"] / (2 * np.sqrt(np.pi * p["D"] * t**3)) * np.exp(-((p["L"] - p["c"] * (t - dt)) ** 2) / (4 * p["D"] * t))
    return h / h.sum()


def numpy_kernels(rows, name, window, f, mode):
    n, down, of = window * f, {r[0]: r[1] for r in rows}, {r[0]: r for r in rows}
    out = {}
    for src in down:
        z, dst = np.ones(n // 2 + 1, complex), src
        while dst is not None:
            s = np.fft.rfft(response(name, of[dst], n, 1 / f))
            z = z * np.where(np.abs(s) < 1e-8, 1e-8 * np.exp(1j * np.angle(s)), s)
            w = sampling.reduce_kernel(np.maximum(np.fft.irfft(z, n), 0)[None], f, mode)[0]
            out[dst, src] = w / w.sum()
            dst = down[dst]
    return out


@pytest.mark.parametrize("name", ["pure_lag", "linear_storage", "nash_cascade", "muskingum", "hayami"])
@pytest.mark.parametrize(("f", "mode"), [(1, "avg"), (10, "avg"), (4, "sample")])
def test_kernel_and_routing_against_numpy(spark, name, f, mode):
    net = RiverNetwork(reaches_of(spark, MINI), name)
    want = numpy_kernels(MINI, name, 30, f, mode)
    kernel = K.build_kernel(net, 30, f, mode)
    got = {(r.dst, r.src): np.array(r.weights) for r in kernel.collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-10) for k in want)
    assert all(abs(w.sum() - 1) < 1e-9 for w in got.values())
    runoff, x = runoff_of(spark, [0, 1, 2])
    y = {(r.reach_id, r.t): r.value for r in Router(30, f, mode).route(runoff, net, T).collect()}
    for dst in range(3):
        full = sum(np.convolve(x["a", s], w)[:T] for (d, s), w in want.items() if d == dst)
        assert np.allclose([y[dst, t] for t in range(T)], full, rtol=1e-9)


def test_kernel_beyond_the_window_and_floor(spark):
    rows = [(1, None, 1.0, 0.1, 1.0, 30.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0), (2, 3, 1.0, 0.1, 1.0, 12.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0), (3, None, 1.0, 0.1, 1.0, 12.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0)]
    got = {(r.dst, r.src): r.weights for r in K.build_kernel(RiverNetwork(reaches_of(spark, rows), "pure_lag"), 20).collect()}
    assert np.argmax(got[1, 1]) == 0 and got[1, 1][0] == pytest.approx(1)
    assert np.argmax(got[3, 2]) == 4  # two lags of 12 in a window of 20 wrap round


def test_sampler_identity(spark):
    rng = np.random.default_rng(1)
    f, n = 4, 20
    fine = rng.random((1, n * f))
    x = rng.random(n)
    for mode in sampling.MODES:
        coarse = sampling.reduce_kernel(fine, f, mode)[0]
        series = spark.createDataFrame([("a", 1, t, float(v)) for t, v in enumerate(x)], "batch string, reach_id long, t int, value double")
        up = np.array([r.value for r in sampling.upsample(series, f).orderBy("t").collect()])
        y = np.convolve(up, fine[0])[: n * f]
        rows = spark.createDataFrame([("a", 1, t, float(v)) for t, v in enumerate(y)], series.schema)
        down = sampling.pool(rows, f, ["batch", "reach_id"]) if mode == "avg" else sampling.take_last(rows, f)
        got = np.array([r.value for r in down.orderBy("t").collect()])
        assert np.allclose(got, np.convolve(x, coarse)[:n])
    ones = sampling.reduce_kernel(np.ones((1, 24)), 4, "avg")[0]
    assert ones.tolist() == [2.5, 4, 4, 4, 4, 4]
    tri = sampling.triangle(spark.createDataFrame([("a", 1, t, 1.0) for t in range(24)], "batch string, reach_id long, t int, value double"), 4, ["batch", "reach_id"], 6)
    assert [r.value for r in tri.orderBy("t").collect()] == ones.tolist()
    with pytest.raises(NotImplementedError):
        Router(8, mode="median")


def test_long_and_packed_agree_and_batches_are_apart(spark):
    net = RiverNetwork(tree(spark, 20))
    runoff, _ = runoff_of(spark, range(1, 21), 40, ("a", "b"))
    sparse = runoff.filter("(reach_id + t) % 3 = 0")
    flows = [sorted((r.batch, r.reach_id, r.t, round(r.value, 9)) for r in Router(12, strategy=s).route(sparse, net, 40).collect()) for s in V.STRATEGIES]
    assert flows[0] == flows[1]
    alone = Router(12).route(sparse.filter("batch = 'b'"), net, 40)
    assert sorted((r.batch, r.reach_id, r.t, round(r.value, 9)) for r in alone.collect()) == [r for r in flows[0] if r[0] == "b"]
    dense = V.densify(alone, net.reaches, ["b"], 40)
    assert dense.count() == 20 * 40


def test_own_runoff_left_out(spark):
    net = RiverNetwork(reaches_of(spark, MINI), "linear_storage", include_self=False)
    runoff, x = runoff_of(spark, [0, 1, 2])
    w = numpy_kernels(MINI, "linear_storage", 20, 1, "avg")
    y = {(r.reach_id, r.t): r.value for r in Router(20).route(runoff, net, T).collect()}
    full = x["a", 2] + sum(np.convolve(x["a", s], w[2, s])[:T] for s in (0, 1))
    assert np.allclose([y[2, t] for t in range(T)], full)


def test_adjoints(spark):
    net = RiverNetwork(tree(spark, 15))
    kernel = K.build_kernel(net, 6)
    runoff, x = runoff_of(spark, range(1, 16), 25, seed=1)
    g, y = runoff_of(spark, range(1, 16), 25, seed=2)
    dot = lambda a, b: a.alias("a").join(b.alias("b"), ["batch", "reach_id", "t"]).agg(F.sum(F.col("a.value") * F.col("b.value"))).first()[0]
    assert dot(V.convolve(runoff, kernel, 25), g) == pytest.approx(dot(runoff, V.adjoint_runoff(g, kernel)))
    dw = {(r.dst, r.src, r.lag): r.value for r in V.adjoint_kernel(g, runoff, G.closure(net.reaches), 6).collect()}
    for (d, s, lag), v in list(dw.items())[::7]:
        assert v == pytest.approx(float(y["a", d][lag:] @ x["a", s][: 25 - lag]))
    values = {r.src: 0.0 for r in G.closure(net.reaches).collect()}
    grad = G.closure(net.reaches).withColumn("value", F.col("dist") + 1.0)
    for r in grad.collect():
        values[r.src] += r.value
        if r.dst > 1:
            values[r.dst // 2] -= r.value
    assert {r.reach_id: r.value for r in V.adjoint_closure(grad, net.reaches).collect()} == pytest.approx(values)


def test_closure_and_statistics(spark):
    reaches = tree(spark, 31)
    pairs = G.closure(reaches)
    assert pairs.count() == sum(i.bit_length() for i in range(1, 32)) and G.closure(reaches, False).count() == pairs.count() - 31
    assert {r.reach_id: r.n_upstream for r in G.upstream_counts(reaches).collect()}[1] == 31
    counts = {r.reach_id: (r.n_paths, r.sum_lengths) for r in G.path_counts(reaches).collect()}
    assert counts[31] == (5, 15) and {r.reach_id: (r.n_paths, r.sum_lengths) for r in G.path_counts(reaches, False).collect()}[31] == (4, 10)
    assert {r.reach_id: r.level for r in G.levels(reaches).collect()}[1] == 4
    assert {r.outlet for r in G.outlets(reaches).collect()} == {1}
    sums = {r.reach_id: r.tau for r in G.downstream_sum(reaches, "tau").collect()}
    assert sums[9] == pytest.approx(sum(0.5 + 0.5 * (i % 5) for i in (9, 4, 2, 1)))
    total = G.running_total(G.path_counts(reaches), "reach_id", "n_paths", "s", parts=4).orderBy("reach_id").collect()
    assert [r.s for r in total] == np.cumsum([r.n_paths for r in total]).tolist()


def test_hazards(spark):
    one = RiverNetwork(reaches_of(spark, [(7, None, *MINI[0][2:])]), "linear_storage").validate()
    assert K.build_kernel(one, 1).first().weights == [1.0]
    with pytest.raises(NetworkError, match="cycle"):
        G.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "reach_id long, downstream_id long"))
    with pytest.raises(NetworkError, match="twice"):
        RiverNetwork(reaches_of(spark, [MINI[0], (0, 2, *MINI[0][2:]), *MINI[1:]])).validate()
    with pytest.raises(NetworkError, match="not in the network"):
        RiverNetwork(reaches_of(spark, MINI[:1])).validate()
    with pytest.raises(NetworkError, match="parameter column"):
        RiverNetwork(tree(spark, 3), "hayami").validate()
    with pytest.raises(NetworkError):
        check_runoff(runoff_of(spark, [9], 2)[0], tree(spark, 3))
    lenient = RiverNetwork(tree(spark, 3), "muskingum").with_params(spark.createDataFrame([(1, 2.0)], "reach_id long, k double"), "zero")
    assert sorted((r.reach_id, r.k, r.x) for r in lenient.reaches.collect()) == [(1, 2.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)]
    with pytest.raises(NetworkError):
        RiverNetwork(tree(spark, 3)).with_params(spark.createDataFrame([(1, 2.0)], "reach_id long, tau double"))
    with pytest.raises(KeyError):
        irf.get_irf("nothing")
    nodes = from_edges(tree(spark, 3).drop("downstream_id"), tree(spark, 3).filter("downstream_id IS NOT NULL"), ["tau"])
    assert nodes.filter("downstream_id IS NULL").count() == 1


def test_registered_response(spark):
    irf.register_irf("steps", lambda p, n, dt: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda t: F.when(t <= p["tau"], 1 / p["tau"]).otherwise(0.0)), ("tau",))
    try:
        net = RiverNetwork(spark.createDataFrame([(1, None, 4.0)], "reach_id long, downstream_id long, tau double"), "steps").validate()
        assert K.build_kernel(net, 8).first().weights == pytest.approx([0.25] * 4 + [0] * 4, abs=1e-6)
    finally:
        del irf.REGISTRY["steps"]


def test_blocks(spark):
    small = spark.createDataFrame([(0, 0, [1.0, 2.0, 3.0]), (1, 2, [4.0, 5.0, 6.0]), (4, 4, [7.0, 0.0, 0.0]), (4, 5, [0.0, 8.0, 0.0]), (3, 3, [0.0, 0.0, 0.0])], "dst long, src long, weights array<double>")
    blocks = K.to_blocks(small, 4)
    back = sorted((r.dst, r.src, r.weights) for r in K.from_blocks(blocks, 4, 5, 6).collect())
    assert back == sorted((r.dst, r.src, r.weights) for r in small.filter("dst <> 3").collect())
    assert K.from_blocks(blocks, 4, 5, 5).count() == 3
    assert [(r.block, r.block_row, r.block_col, r.cells) for r in K.block_index(blocks).orderBy("block").collect()] == [(0, 0, 0, 3), (1, 1, 1, 2)]
    ids = spark.createDataFrame([(i,) for i in range(6)], "reach_id long")
    dense = K.to_dense(small, ids, 3)
    assert dense.count() == 6 * 6 * 3 and dense.filter("dst = 4 AND src = 5 AND lag = 1").first().weight == 8


def paths_within(down):
    """Length of all paths of one piece, given as reach -> the reach below within the piece."""
    total = 0
    for r in down:
        while r is not None:
            total, r = total + 1, down[r]
    return total


def check_plan(reaches, plan, path_limit=None, block=None, node_limit=10):
    rows = plan.collect()
    down = {r.reach_id: r.downstream_id for r in reaches.collect()}
    assert sorted(r.reach_id for r in rows) == sorted(down)
    at = {r.reach_id: r for r in rows}
    for u, v in down.items():
        assert v is None or (at[u].cluster == at[v].cluster and at[u].piece == at[v].piece) or at[u].stage < at[v].stage
    pieces, clusters = {}, {}
    for r in rows:
        pieces.setdefault(r.piece, []).append(r.reach_id)
        clusters.setdefault(r.cluster, []).append(r)
    for name, members in pieces.items():
        inner = {r: down[r] if down[r] is not None and at[down[r]].piece == name else None for r in members}
        assert [r for r, v in inner.items() if v is None] == [name]
        assert path_limit is None or paths_within(inner) <= path_limit
        assert block is None or len(members) <= block
    for members in clusters.values():
        assert len(members) <= node_limit or len({r.piece for r in members}) == 1
        assert len({r.stage for r in members}) == 1
    return at


def test_schedule(spark):
    odd = spark.createDataFrame([(i, i // 2 if i > 1 else None) for i in range(1, 128)] + [(i, i + 1 if i < 160 else 40) for i in range(130, 161)] + [(500, None), (501, None)], "reach_id long, downstream_id long")
    check_plan(odd, C.schedule(odd, path_limit=40, node_limit=25), path_limit=40, node_limit=25)
    check_plan(odd, C.schedule(odd, strategy="blocks", block=6, node_limit=30), block=6, node_limit=30)
    chain = spark.createDataFrame([(i, i + 1 if i < 20 else None) for i in range(1, 21)], "reach_id long, downstream_id long")
    # The first four reaches have ten steps of paths together; the other 16 make chains of four from the outlet.
    assert sorted(r.reach_id for r in C.breakpoints(chain, 10).collect()) == [4, 8, 12, 16]
    with pytest.raises(NotImplementedError):
        C.schedule(chain, strategy="other")
    assert C.schedule(chain.limit(0)).count() == 0


def test_packing(spark):
    pieces = spark.createDataFrame([(1, 5, 0), (2, 3, 0), (3, 3, 0), (4, 4, 0), (5, 4, 0), (6, 4, 0), (7, 8, 0), (8, 5, 1), (9, 1, 0), (10, 1, 0)], "piece long, n long, layer int")
    bins = {r.piece: r.bin for r in C.packed_blocks(pieces, 8).collect()}
    assert bins == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 3, 7: 7, 8: 8, 9: 9, 10: 9} or bins[1] == bins[2] and bins[4] == bins[5] and bins[7] == 7 and bins[8] == 8
    load = {}
    for r in pieces.collect():
        load[bins[r.piece]] = load.get(bins[r.piece], 0) + r.n
    assert max(load.values()) <= 8 and len(bins) == 10


def test_kernels_from_given_responses_and_dense_blocks(spark):
    given = spark.createDataFrame([(0, 0, 0, 1.0), (1, 2, 1, 4.0), (1, 2, 1, 1.0), (4, 5, 2, 8.0), (4, 5, 9, 7.0)], "dst long, src long, lag int, weight double")
    kernel = K.from_responses(given, 3)
    assert sorted((r.dst, r.src, r.weights) for r in kernel.collect()) == [(0, 0, [1.0, 0.0, 0.0]), (1, 2, [0.0, 5.0, 0.0]), (4, 5, [0.0, 0.0, 8.0])]
    dense = K.blocks_to_dense(K.to_blocks(kernel, 4), 4, 3, height=5, width=6).collect()
    assert len(dense) == (4 * 4 + 1 * 2) * 3
    assert {(r.dst, r.src, r.lag): r.weight for r in dense if r.weight} == {(0, 0, 0): 1.0, (1, 2, 1): 5.0, (4, 5, 2): 8.0}


def test_staged_routing(spark):
    reaches = tree(spark, 31, tau=lambda i: 0.3)
    net = RiverNetwork(reaches)
    plan = C.schedule(reaches, path_limit=12, node_limit=8).cache()
    runoff, _ = runoff_of(spark, range(1, 32), 30)
    whole = {(r.reach_id, r.t): r.value for r in Router(40).route(runoff, net, 30).collect()}
    staged = StagedRouter(Router(40))
    cut = {(r.reach_id, r.t): r.value for r in staged.route(runoff, net, plan, 30).collect()}
    assert set(cut) == set(whole) and all(cut[k] == pytest.approx(whole[k], rel=1e-6) for k in whole)
    last = plan.agg(F.max("stage")).first()[0]
    assert last >= 1
    start = staged.boundary_before(runoff, net, plan, 30, last)
    k, flow, _ = next(staged.stages(lambda k: runoff, net, plan, 30, boundary=start, first=last))
    assert k == last and all(r.value == pytest.approx(cut[r.reach_id, r.t]) for r in flow.collect())


def test_targets_and_sweep(spark):
    net = RiverNetwork(tree(spark, 15))
    runoff, _ = runoff_of(spark, range(1, 16), 10)
    full = {(r.reach_id, r.t): r.value for r in Router(6).route(runoff, net, 10).collect()}
    some = Router(6).route(runoff, net, 10, targets=net.reaches.filter("reach_id IN (1, 5)")).collect()
    assert {r.reach_id for r in some} == {1, 5} and all(r.value == pytest.approx(full[r.reach_id, r.t]) for r in some)
    sweep = parameter_sweep(Router(6), runoff, net, "tau", {"same": 1.0, "more": 1.5}, 10)
    assert all(r.value == pytest.approx(full[r.reach_id, r.t]) for r in sweep.filter("param_set = 'same'").collect())


def test_rapid(spark, tmp_path):
    rows = [(10, 30, 3600.0, 0.1), (20, 30, 7200.0, 0.2), (30, -1, 86400.0, 0.3)]
    for name, pick in (("rapid_connect", lambda r: f"{r[0]},{r[1]},2,{r[0]}"), ("riv_bas_id", lambda r: f"{r[0]}"), ("k", lambda r: f"{r[2]}"), ("x", lambda r: f"{r[3]}")):
        (tmp_path / f"{name}.csv").write_text("".join(f"{pick(r)}\n" for r in rows))
    net = rapid.read_rapid(spark, str(tmp_path))
    assert sorted(tuple(r) for r in net.reaches.collect()) == [(10, 30, 3600 / 86400, 0.1), (20, 30, 7200 / 86400, 0.2), (30, None, 1.0, 0.3)]
    assert net.irf == "muskingum" and rapid.read_rapid(spark, [str(tmp_path)] * 2).reaches.count() == 3
    (tmp_path / "k.csv").write_text("1\n2\n")
    with pytest.raises(NetworkError):
        rapid.read_rapid(spark, str(tmp_path))
    for name, column in (("riv_bas_id", "10\n20\n"), ("k", "1\n2\n"), ("x", "0.1\n0.2\n")):
        (tmp_path / f"{name}.csv").write_text(column)
    with pytest.raises(NetworkError, match="no parameters"):
        rapid.read_rapid(spark, str(tmp_path))


def test_segmented_project(spark, tmp_path):
    reaches = tree(spark, 40).select("reach_id", "downstream_id", F.lit(1.5).alias("k"), F.lit(0.1).alias("x"))
    rapid.write_rapid(reaches, str(tmp_path))
    network, plan = rapid.read_rapid_segmented(spark, str(tmp_path), 30, 10)
    at = check_plan(network.reaches, plan, path_limit=30, node_limit=10)
    runoff, _ = runoff_of(spark, range(1, 41), 12)
    whole = {(r.reach_id, r.t): r.value for r in Router(80).route(runoff, network, 12).collect()}
    staged = {(r.reach_id, r.t): r.value for r in StagedRouter(Router(80)).route(runoff, network, plan, 12).collect()}
    assert len(at) == 40 and set(staged) == set(whole) and all(staged[k] == pytest.approx(whole[k], rel=1e-3) for k in whole)


def test_gradient(spark):
    net = RiverNetwork(tree(spark, 7))
    runoff, _ = runoff_of(spark, range(1, 8), 10)
    router = Router(6)
    found = {(r.reach_id, r.t): r.gradient for r in parameter_gradient(router, runoff, net, "tau", 10, 0.05).collect()}
    sides = [{(r.reach_id, r.t): r.value for r in router.route(runoff, RiverNetwork(net.reaches.withColumn("tau", F.col("tau") * f)), 10).collect()} for f in (0.95, 1.05)]
    assert found and all(g == pytest.approx((sides[1][k] - sides[0][k]) / 0.1, abs=1e-6) for k, g in found.items())


def test_shared_folder_is_asked_for(monkeypatch):
    from rivernet import checkpoints

    class Context:
        master, folder = "spark://host:7077", None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="share"):
        checkpoints.ensure_checkpoint_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://there"}
    assert checkpoints.ensure_checkpoint_dir(Session()) == "hdfs://there"


def test_stream(spark, tmp_path):
    from rivernet.streaming.stream_routing import route_stream

    kernel = K.build_kernel(RiverNetwork(tree(spark, 3)), 3)
    rows = [(i, f"2024-01-{d:02d} 00:00:00", float(i + d)) for i in (1, 2, 3) for d in range(1, 6)]
    spark.createDataFrame(rows, "reach_id long, ts string, value double").selectExpr("reach_id", "CAST(ts AS TIMESTAMP) AS ts", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("reach_id long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    query = route_stream(stream, kernel, 86_400, "1 day").writeStream.outputMode("complete").format("memory").queryName("flows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.reach_id, r.window.start.day): r.value for r in spark.sql("SELECT * FROM flows").collect()}
    runoff = spark.createDataFrame([("a", i, int(ts[8:10]) - 1, v) for i, ts, v in rows], "batch string, reach_id long, t int, value double")
    want = {(r.reach_id, r.t + 1): r.value for r in V.convolve(runoff, kernel, 7).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
