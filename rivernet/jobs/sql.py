"""DuckDB SQL of the registered queries: common table expressions put together by name."""

from __future__ import annotations

from ..operators.segmentation import exact_patterns
from .queries import FLOW_UNIT, PIECE, STEPS, SUBSTEPS, WINDOW

PI2 = "6.283185307179586::DOUBLE"
PARAMS = """(0.5::DOUBLE + 0.5::DOUBLE * (r % 5)) AS tau, (0.2::DOUBLE * (1 + r % 7)) AS delay, (1 + 0.25::DOUBLE * (r % 4)) AS k, (0.1::DOUBLE + 0.05::DOUBLE * (r % 4)) AS x,
  (5 + r % 6)::DOUBLE AS L, (0.5::DOUBLE + 0.1::DOUBLE * (r % 6)) AS D, (1 + 0.1::DOUBLE * (r % 5)) AS c, (1 + 0.5::DOUBLE * (r % 3)) AS shape, (1 + r % 4)::DOUBLE AS scale, (0.3::DOUBLE * (r % 3)) AS onset"""
NETWORKS = {
    "heap": "SELECT (c_custkey + 1)::BIGINT AS r, nullif((c_custkey + 1) // 2, 0)::BIGINT AS down FROM customer",
    "chain32": "SELECT (c_custkey + 1)::BIGINT AS r, CASE WHEN (c_custkey + 1) % 32 <> 0 AND c_custkey <> (SELECT max(c_custkey) FROM customer) THEN (c_custkey + 2)::BIGINT END AS down FROM customer",
    "admin": "SELECT (c_custkey + 1000)::BIGINT AS r, (c_nationkey + 100)::BIGINT AS down FROM customer UNION ALL SELECT n_nationkey + 100, n_regionkey + 1 FROM nation UNION ALL SELECT r_regionkey + 1, NULL FROM region",
    "events": "SELECT DISTINCT (user_id + 1)::BIGINT AS r, nullif((user_id + 1) // 2, 0)::BIGINT AS down FROM events",
}
PAIRS = "pairs(src, dst, dist) AS (SELECT reach_id, reach_id, 0 FROM reaches UNION ALL SELECT p.src, r.downstream_id, p.dist + 1 FROM pairs p JOIN reaches r ON r.reach_id = p.dst WHERE r.downstream_id IS NOT NULL)"
MONTHLY = "SELECT {batch} AS batch, (o_custkey + 1)::BIGINT AS reach_id, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::INT AS t, sum(o_totalprice)::DOUBLE AS value FROM orders GROUP BY ALL"


def reaches(network: str = "heap", tau: str = "tau") -> str:
    return f"reaches AS (SELECT * REPLACE ({tau} AS tau) FROM (SELECT r AS reach_id, down AS downstream_id, {PARAMS} FROM ({NETWORKS[network]})))"


def irf(name: str, n: int = WINDOW, f: int = 1) -> str:
    """w(reach_id, t, w)"""
    dt = f"(1.0::DOUBLE / {f})"
    s = f"((t + 1) * {dt})"
    x = f"(1 / (1 + tau / {dt}))"
    den = f"(k * (1 - x) + {dt} / 2)"
    c0, c1, c2 = (f"(({a}) / {den})" for a in (f"{dt} / 2 - k * x", f"{dt} / 2 + k * x", f"k * (1 - x) - {dt} / 2"))
    wave = f"-power(L - c * ({s} - {dt}), 2) / (4 * D * {s})"
    z = f"(greatest({s} - onset, 0) / scale)"
    rows = f"(SELECT * FROM reaches, (SELECT unnest(range({n})) AS t))"
    plain = {
        "pure_lag": f"greatest(0, 1 - abs(t - delay / {dt}))",
        "linear_storage": f"{x} * power(1 - {x}, t)",
        "nash_cascade": f"(t + 1) * (t + 2) / 2.0::DOUBLE * power({x}, 3) * power(1 - {x}, t)",
        "muskingum": f"CASE WHEN t = 0 THEN {c0} ELSE ({c1} + {c2} * {c0}) * power({c2}, t - 1) END",
        "hayami": f"L / (2 * sqrt(pi() * D * power({s}, 3))) * exp({wave})",
        "hayami_rescaled": f"L / (2 * sqrt(pi() * D * power({s}, 3))) * exp({wave})",
        "weibull": f"CASE WHEN {z} > 0 THEN shape / scale * power({z}, shape - 1) * exp(-power({z}, shape)) ELSE 0 END",
    }[name]
    if name in ("hayami", "hayami_rescaled", "weibull"):
        return f"w AS (SELECT reach_id, t, v / sum(v) OVER (PARTITION BY reach_id) AS w FROM (SELECT reach_id, t, ({plain})::DOUBLE AS v FROM {rows}))"
    return f"w AS (SELECT reach_id, t, ({plain})::DOUBLE AS w FROM {rows})"


def spectra(n: int = WINDOW) -> str:
    return f"""spec AS (SELECT reach_id, k, ln(greatest(sqrt(re * re + im * im), 1e-8)) AS la, atan2(im, re) AS ph FROM
  (SELECT reach_id, k, sum(w * cos({PI2} * k * t / {n})) AS re, -sum(w * sin({PI2} * k * t / {n})) AS im FROM w, (SELECT unnest(range({n})) AS k) GROUP BY ALL)),
pre AS (SELECT p.src AS reach_id, k, sum(la) AS la, sum(ph) AS ph FROM pairs p JOIN spec s ON s.reach_id = p.dst GROUP BY ALL),
path AS (SELECT p.dst, p.src, a.k, a.la - coalesce(b.la, 0) AS la, a.ph - coalesce(b.ph, 0) AS ph FROM pairs p JOIN pre a ON a.reach_id = p.src
  JOIN reaches r ON r.reach_id = p.dst LEFT JOIN pre b ON b.reach_id = r.downstream_id AND b.k = a.k)"""


def kernel(name: str, network: str = "heap", f: int = 1, mode: str = "avg", tau: str = "tau", diag: bool = True, window: int = WINDOW) -> str:
    """kernel(dst, src, lag, weight) and all it needs"""
    n = window * f
    coarse = {
        1: "SELECT dst, src, t AS lag, w FROM fine",
        (4, "sample"): f"SELECT dst, src, t // {f} AS lag, sum(w) AS w FROM fine GROUP BY ALL",
        (4, "avg"): f"""SELECT dst, src, lag, sum(w) AS w FROM (SELECT dst, src, t // {f} AS lag, w * ({f} - t % {f}) / {f} AS w FROM fine
    UNION ALL SELECT dst, src, t // {f} + 1, w * (t % {f}) / {f} FROM fine) WHERE lag < {window} GROUP BY ALL""",
    }[1 if f == 1 else (f, mode)]
    only = "" if diag else " WHERE dst <> src"
    return f"""{reaches(network, tau)}, {PAIRS}, {irf(name, n, f)}, {spectra(n)},
fine AS (SELECT dst, src, t, greatest(sum(exp(la) * cos(ph + {PI2} * k * t / {n})) / {n}, 0) AS w FROM path, (SELECT unnest(range({n})) AS t) GROUP BY ALL),
coarse AS ({coarse}),
kernel AS (SELECT dst, src, lag::INT AS lag, w / sum(w) OVER (PARTITION BY dst, src) AS weight FROM coarse{only})"""


def conv(runoff: str = "runoff", kernel_: str = "kernel", where: str = "", steps: int = STEPS) -> str:
    return f"SELECT batch, dst AS reach_id, (t + lag)::INT AS t, sum(value * weight) AS value FROM {runoff} x JOIN {kernel_} q ON q.src = x.reach_id WHERE t + lag < {steps}{where} GROUP BY ALL"


def rounded(c: str, digits: int = 6, scale: str = "1") -> str:
    return f"round({c} / {scale}, {digits}) + 0.0::DOUBLE"


def flow(rows: str, keys: str = "") -> str:
    return f"SELECT {keys}batch, reach_id, t, {rounded('value', 2, str(FLOW_UNIT))} AS value FROM ({rows})"


def runoff(batch: str = "'all'") -> str:
    return f"runoff AS ({MONTHLY.format(batch=batch)})"


def routed(name: str, batch: str = "'all'", where: str = "", **how) -> str:
    return f"WITH RECURSIVE {kernel(name, **how)}, {runoff(batch)} {flow(conv(where=where))}"


def staged(stage_rows: str) -> str:
    """flow0 .. flow3: chain32 routed eight reaches at a time; in0 .. in3 what each stage takes in."""
    stages = 32 // PIECE
    cuts = f"(CASE WHEN (c_custkey + 1) % {PIECE} <> 0 AND c_custkey <> (SELECT max(c_custkey) FROM customer) THEN (c_custkey + 2)::BIGINT END)"
    inner = kernel("linear_storage", "chain32").replace(NETWORKS["chain32"], f"SELECT (c_custkey + 1)::BIGINT AS r, {cuts} AS down FROM customer")
    parts = [f"WITH RECURSIVE {inner}", runoff()]
    for k in range(stages):
        own = f"SELECT batch, reach_id, t, value FROM runoff WHERE (reach_id - 1) // {PIECE} % {stages} = {k}"
        if k:
            own += f" UNION ALL SELECT batch, reach_id + 1, t, value FROM flow{k - 1} WHERE reach_id % {PIECE} = 0 AND reach_id < (SELECT max(reach_id) FROM reaches)"
        parts += [f"in{k} AS (SELECT batch, reach_id, t, sum(value) AS value FROM ({own}) GROUP BY ALL)", f"flow{k} AS ({conv(f'in{k}')})"]
    return ", ".join(parts) + " " + flow(stage_rows)


def cuts(limit: int, measure: str = "paths") -> str:
    """plan(reach_id, downstream_id, cut), assigned(reach_id, downstream_id, piece), pieces(piece, n, layer); needs pairs"""
    size, chain = {"paths": ("length", max(d for d in range(1, limit + 1) if d * (d + 1) // 2 <= limit)), "reaches": ("n", limit)}[measure]
    return f"""sizes AS (SELECT reach_id, downstream_id, {size} AS size, {size} > {limit} AS large FROM reaches JOIN (SELECT dst AS reach_id, count(*) AS n, sum(dist + 1)::BIGINT AS length FROM pairs GROUP BY dst) USING (reach_id)),
chosen AS (SELECT reach_id FROM (SELECT reach_id, row_number() OVER (PARTITION BY downstream_id ORDER BY size DESC, reach_id) AS nth FROM sizes WHERE large AND downstream_id IS NOT NULL) WHERE nth = 1),
trunk AS (SELECT *, reach_id IN (SELECT reach_id FROM chosen) AS goes_on FROM sizes),
walk(reach_id, now, steps) AS (SELECT reach_id, reach_id, 0 FROM trunk WHERE large UNION ALL SELECT w.reach_id, t.downstream_id, w.steps + 1 FROM walk w JOIN trunk t ON t.reach_id = w.now AND t.goes_on),
places AS (SELECT reach_id, max(steps) AS place FROM walk GROUP BY reach_id),
plan AS (SELECT t.reach_id, t.downstream_id, t.downstream_id IS NOT NULL AND CASE WHEN t.large THEN NOT t.goes_on OR place % {chain} = 0 ELSE d.large END AS cut
  FROM trunk t LEFT JOIN places USING (reach_id) LEFT JOIN sizes d ON d.reach_id = t.downstream_id),
stay(reach_id, piece) AS (SELECT reach_id, reach_id FROM plan WHERE cut OR downstream_id IS NULL UNION ALL SELECT p.reach_id, s.piece FROM stay s JOIN plan p ON p.downstream_id = s.reach_id AND NOT p.cut),
assigned AS (SELECT plan.reach_id, plan.downstream_id, piece FROM plan JOIN stay USING (reach_id)),
links AS (SELECT a.piece, b.piece AS down FROM assigned a JOIN assigned b ON b.reach_id = a.downstream_id WHERE a.reach_id = a.piece),
deep(piece, layer) AS (SELECT DISTINCT piece, 0 FROM assigned UNION SELECT l.down, d.layer + 1 FROM deep d JOIN links l ON l.piece = d.piece),
pieces AS (SELECT piece, n, layer FROM (SELECT piece, count(*) AS n FROM assigned GROUP BY piece) JOIN (SELECT piece, max(layer)::INT AS layer FROM deep GROUP BY piece) USING (piece))"""


def size_class(pieces: str, limit: int, name: str) -> str:
    """name(piece, layer, bin)"""
    return f"""{name} AS (SELECT piece, layer, min(piece) OVER (PARTITION BY layer, j, rank >> j) AS bin FROM (SELECT *, row_number() OVER (PARTITION BY layer, j ORDER BY piece) - 1 AS rank FROM
  (SELECT *, greatest(floor(log2({limit}::DOUBLE / n + 1e-9)), 0)::INT AS j FROM {pieces})))"""


def scheduled(path_limit: int, node_limit: int) -> str:
    return f"WITH RECURSIVE {reaches()}, {PAIRS}, {cuts(path_limit)}, {size_class('pieces', node_limit, 'bins')} SELECT reach_id, downstream_id, piece, bin AS cluster, layer AS stage FROM assigned JOIN bins USING (piece)"


def scheduled_blocks(block: int, node_limit: int) -> str:
    patterns = ", ".join(f"({k + 1}, {[p.count(n) for n in range(1, block)]})" for k, p in enumerate(exact_patterns(block)))
    sizes = f"range(1, {block})"
    return f"""WITH RECURSIVE {reaches()}, {PAIRS}, {cuts(block, "reaches")},
nth AS (SELECT *, row_number() OVER (PARTITION BY layer, n ORDER BY piece) - 1 AS rank FROM pieces),
counts AS (SELECT layer, n, count(*) AS c FROM pieces GROUP BY layer, n),
patterns(step, needs) AS (VALUES {patterns}),
fill(layer, step, had, times, needs) AS (SELECT layer, 0, list(coalesce(c, 0) ORDER BY n), 0::BIGINT, NULL::INT[] FROM (SELECT layer, unnest({sizes}) AS n FROM (SELECT DISTINCT layer FROM pieces)) LEFT JOIN counts USING (layer, n) GROUP BY layer
  UNION ALL SELECT layer, step, had, list_min(list_transform(list_filter({sizes}, lambda i: needs[i] > 0), lambda i: had[i] // needs[i])), needs
  FROM (SELECT f.layer, p.step, list_transform({sizes}, lambda i: f.had[i] - f.times * coalesce(f.needs[i], 0)) AS had, p.needs FROM fill f JOIN patterns p ON p.step = f.step + 1)),
fills AS (SELECT f.layer, c.n, f.step, f.needs[c.n] AS each, c.c - f.had[c.n] AS low, c.c - f.had[c.n] + f.times * f.needs[c.n] AS high FROM fill f JOIN counts c ON c.layer = f.layer AND c.n < {block} WHERE f.times > 0 AND f.needs[c.n] > 0),
met AS (SELECT a.piece, a.layer, f.step, (a.rank - f.low) // f.each AS place FROM nth a JOIN fills f ON f.layer = a.layer AND f.n = a.n AND a.rank >= f.low AND a.rank < f.high),
lone AS (SELECT piece, n, layer FROM pieces WHERE piece NOT IN (SELECT piece FROM met)),
{size_class("lone", block, "rest")},
bins AS (SELECT piece, layer, min(piece) OVER (PARTITION BY layer, step, place) AS bin FROM met UNION ALL SELECT piece, layer, bin FROM rest),
blocks AS (SELECT bin, layer, min(bin) OVER (PARTITION BY layer, nth) AS cluster FROM (SELECT bin, layer, (row_number() OVER (PARTITION BY layer ORDER BY bin) - 1) // {node_limit // block} AS nth FROM (SELECT DISTINCT bin, layer FROM bins)))
SELECT reach_id, downstream_id, piece, cluster, b.layer AS stage FROM assigned JOIN bins b USING (piece) JOIN blocks USING (bin)"""


def loss_gradient() -> str:
    """Forwards: how each pair's weights change with the parameter of each reach on its path, against what the loss says of the weights."""
    n = WINDOW
    slope = "(power(1 - x, t) - CASE WHEN t > 0 THEN x * t * power(1 - x, t - 1) ELSE 0 END) * -x * x"
    return f"""WITH RECURSIVE {kernel("linear_storage")}, {runoff()}, flow AS ({conv()}),
by_weight AS (SELECT p.dst, p.src, (y.t - x.t) AS lag, sum(x.value * y.value) AS g FROM pairs p JOIN runoff x ON x.reach_id = p.src JOIN flow y ON y.reach_id = p.dst AND y.batch = x.batch AND y.t - x.t BETWEEN 0 AND {n - 1} GROUP BY ALL),
moved AS (SELECT reach_id, k, sum(s * cos({PI2} * k * t / {n})) AS re, -sum(s * sin({PI2} * k * t / {n})) AS im FROM (SELECT reach_id, t, {slope} AS s FROM (SELECT reach_id, t, 1 / (1 + tau) AS x FROM reaches, (SELECT unnest(range({n})) AS t))), (SELECT unnest(range({n})) AS k) GROUP BY ALL),
own AS (SELECT reach_id, k, sum(w * cos({PI2} * k * t / {n})) AS re, -sum(w * sin({PI2} * k * t / {n})) AS im FROM w, (SELECT unnest(range({n})) AS k) GROUP BY ALL),
ratio AS (SELECT reach_id, k, (m.re * o.re + m.im * o.im) / (o.re * o.re + o.im * o.im) AS re, (m.im * o.re - m.re * o.im) / (o.re * o.re + o.im * o.im) AS im FROM moved m JOIN own o USING (reach_id, k)),
on_path AS (SELECT a.src, a.dst, b.dst AS reach_id FROM pairs a JOIN pairs b ON b.src = a.src AND b.dist <= a.dist WHERE EXISTS (SELECT 1 FROM by_weight g WHERE g.src = a.src AND g.dst = a.dst)),
by_freq AS (SELECT o.src, o.dst, o.reach_id, p.k, exp(la) * (cos(ph) * re - sin(ph) * im) AS re, exp(la) * (cos(ph) * im + sin(ph) * re) AS im FROM on_path o JOIN path p ON p.src = o.src AND p.dst = o.dst JOIN ratio r ON r.reach_id = o.reach_id AND r.k = p.k),
change AS (SELECT b.src, b.dst, b.reach_id, t AS lag, sum(re * cos({PI2} * b.k * t / {n}) - im * sin({PI2} * b.k * t / {n})) / {n} AS v FROM by_freq b, (SELECT unnest(range({n})) AS t) GROUP BY ALL),
cut AS (SELECT c.src, c.dst, c.reach_id, c.lag, CASE WHEN f.w > 0 THEN v ELSE 0 END AS v, f.w AS fine FROM change c JOIN fine f ON f.src = c.src AND f.dst = c.dst AND f.t = c.lag),
whole AS (SELECT *, sum(v) OVER (PARTITION BY src, dst, reach_id) AS v_sum, sum(fine) OVER (PARTITION BY src, dst, reach_id) AS s FROM cut)
SELECT reach_id, 'tau' AS param, {rounded("sum(g * (v - fine / s * v_sum) / s)", 4, "1e12")} AS value FROM whole JOIN by_weight g USING (src, dst, lag) GROUP BY reach_id"""


def oracle_sql() -> dict[str, str]:
    with_pairs = lambda network, sql: f"WITH RECURSIVE {reaches(network)}, {PAIRS} {sql}"
    weights = f"SELECT dst, src, lag, {rounded('weight')} AS weight FROM kernel"
    series = lambda sql: f"WITH {runoff()} SELECT batch, reach_id, t, {rounded('value', 4)} AS value FROM ({sql})"
    counts = "SELECT src AS reach_id, count(*)::BIGINT AS n_paths FROM pairs GROUP BY src"
    complex_ = f"{rounded('exp(la) * cos(ph)')} AS re, {rounded('exp(la) * sin(ph)')} AS im"
    plan = f"plan AS (SELECT reach_id, downstream_id, ((reach_id - 1) // {PIECE})::INT AS cluster, ((reach_id - 1) // {PIECE} % {32 // PIECE})::INT AS stage FROM reaches)"
    moves = "moves AS (SELECT a.cluster AS src_cluster, b.cluster AS dst_cluster, a.reach_id AS src_reach, b.reach_id AS dst_reach FROM plan a JOIN plan b ON b.reach_id = a.downstream_id WHERE a.cluster <> b.cluster)"
    planned = lambda sql: f"WITH {reaches('chain32')}, {plan}, {moves} {sql}"
    s = SUBSTEPS
    rapid = f"WITH {reaches()} SELECT reach_id, downstream_id, {rounded('k')} AS k, {rounded('x')} AS x FROM reaches"
    out = {
        "closure_pairs": with_pairs("heap", "SELECT src, dst, dist FROM pairs"),
        "prefix_sum": with_pairs("heap", f"SELECT src AS reach_id, {rounded('sum(tau)')} AS tau FROM pairs JOIN reaches ON reach_id = dst GROUP BY src"),
        "path_log_product": f"WITH RECURSIVE {reaches()}, {PAIRS}, {irf('hayami')}, {spectra()} SELECT dst, src, k::INT AS k, {complex_} FROM path WHERE k <= {WINDOW // 2}",
        "spectrum": f"WITH RECURSIVE {reaches()}, {PAIRS}, {irf('nash_cascade')}, {spectra()} SELECT reach_id, k::INT AS k, {complex_} FROM spec WHERE k <= {WINDOW // 2}",
        "spectrum_inverse": f"WITH {reaches()}, {irf('hayami')} SELECT reach_id, t::INT AS t, {rounded('w')} AS w FROM w",
        "path_counts": with_pairs("heap", f"SELECT reach_id, n_paths, n_paths * (n_paths + 1) // 2 AS sum_lengths FROM ({counts})"),
        "path_cumsum": with_pairs("heap", f"SELECT reach_id, n_paths, (sum(n_paths) OVER (ORDER BY reach_id))::BIGINT AS total FROM ({counts})"),
        "topo_level": with_pairs("heap", "SELECT dst AS reach_id, max(dist) AS level FROM pairs GROUP BY dst"),
        "components": with_pairs("chain32", "SELECT src AS reach_id, max_by(dst, dist) AS outlet FROM pairs GROUP BY src"),
        "ancestors": with_pairs("admin", "SELECT dst, src FROM pairs WHERE dist > 0 AND dst < 1000"),
        "upstream_count": with_pairs("admin", "SELECT dst AS reach_id, count(*) AS n_upstream FROM pairs GROUP BY dst"),
        "resample_phi": series(f"SELECT batch, reach_id, (t * {s} + j)::INT AS t, value / {s} AS value FROM runoff, (SELECT unnest(range({s})) AS j)"),
        "resample_pool": series(f"SELECT batch, reach_id, (t // {s})::INT AS t, sum(value) AS value FROM runoff GROUP BY ALL"),
        "resample_last": series(f"SELECT batch, reach_id, (t // {s})::INT AS t, value * {s} AS value FROM runoff WHERE t % {s} = {s - 1}"),
        "resample_tri": series(
            f"SELECT batch, reach_id, t::INT AS t, sum(value) AS value FROM (SELECT batch, reach_id, t // {s} AS t, value * ({s} - t % {s}) / {s} AS value FROM runoff UNION ALL SELECT batch, reach_id, t // {s} + 1, value * (t % {s}) / {s} FROM runoff) WHERE t < {STEPS // s} GROUP BY ALL"
        ),
        "kernel_block": with_pairs("chain32", "SELECT row_number() OVER (ORDER BY block_row, block_col) - 1 AS block, block_row, block_col, cells FROM (SELECT dst // 16 AS block_row, src // 16 AS block_col, count(*) AS cells FROM pairs GROUP BY ALL)"),
        "kernel_block_roundtrip": f"WITH RECURSIVE {kernel('linear_storage', 'chain32')} {weights}",
        "kernel_block_dense": f"""WITH RECURSIVE {kernel("linear_storage", "chain32")}, sides AS (SELECT unnest(range(16)) AS i)
SELECT b.r * 16 + x.i AS dst, b.c * 16 + y.i AS src, l.lag::INT AS lag, {rounded("coalesce(weight, 0)")} AS weight FROM (SELECT DISTINCT dst // 16 AS r, src // 16 AS c FROM kernel) b, sides x, sides y,
  (SELECT unnest(range({WINDOW})) AS lag) l LEFT JOIN kernel k ON k.dst = b.r * 16 + x.i AND k.src = b.c * 16 + y.i AND k.lag = l.lag""",
        "kernel_given": f"""WITH RECURSIVE {kernel("linear_storage", "chain32")}, given AS (SELECT * FROM kernel WHERE weight > 1e-3)
SELECT p.dst, p.src, l.lag::INT AS lag, {rounded("coalesce(weight, 0)")} AS weight FROM (SELECT DISTINCT dst, src FROM given) p, (SELECT unnest(range({WINDOW})) AS lag) l LEFT JOIN given g ON g.dst = p.dst AND g.src = p.src AND g.lag = l.lag""",
        "kernel_dense": f"""WITH RECURSIVE {kernel("linear_storage", "chain32")} SELECT a.reach_id AS dst, b.reach_id AS src, l.lag::INT AS lag, {rounded("coalesce(weight, 0)")} AS weight
FROM reaches a JOIN reaches b ON (a.reach_id - 1) // 32 = (b.reach_id - 1) // 32, (SELECT unnest(range({WINDOW})) AS lag) l LEFT JOIN kernel k ON k.dst = a.reach_id AND k.src = b.reach_id AND k.lag = l.lag""",
        "route_param_override": routed("linear_storage", tau="tau * 2"),
        "route_targets": routed("linear_storage", where=" AND dst < 8"),
        "route_daily": f"""WITH RECURSIVE {kernel("linear_storage", "events")}, runoff AS (SELECT event_type AS batch, user_id + 1 AS reach_id, day(ts) - 1 AS t, sum(value)::DOUBLE AS value FROM events GROUP BY ALL)
SELECT batch, reach_id, t, {rounded("value", 6, str(FLOW_UNIT))} AS value FROM ({conv(steps=30)})""",
        "param_sweep": " UNION ALL ".join(f"SELECT '{name}' AS param_set, * FROM ({routed('linear_storage', tau=f'tau * {by}::DOUBLE')})" for name, by in (("low", 0.9), ("high", 1.1))),
        "param_gradient": "SELECT batch, reach_id, t, " + rounded("sum(CASE WHEN param_set = 'high' THEN value ELSE -value END) / 0.2", 2, str(FLOW_UNIT)) + " AS gradient FROM ("
        + " UNION ALL ".join(f"SELECT '{name}' AS param_set, * FROM (WITH RECURSIVE {kernel('linear_storage', tau=f'tau * {by}::DOUBLE')}, {runoff()} {conv()})" for name, by in (("low", 0.9), ("high", 1.1)))
        + ") GROUP BY ALL",
        "tour_intervals": with_pairs("heap", """SELECT p.src AS reach_id, sum(CASE WHEN r.downstream_id IS NULL THEN 0 ELSE 1 + coalesce(earlier, 0) END)::BIGINT AS place, any_value(own.size) AS size
FROM pairs p JOIN reaches r ON r.reach_id = p.dst JOIN (SELECT dst, count(*) AS size FROM pairs GROUP BY dst) own ON own.dst = p.src
LEFT JOIN (SELECT reach_id, sum(size) OVER (PARTITION BY downstream_id ORDER BY reach_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
  FROM reaches JOIN (SELECT dst AS reach_id, count(*) AS size FROM pairs GROUP BY dst) USING (reach_id)) e ON e.reach_id = p.dst GROUP BY p.src"""),
        "series_files": series("SELECT * FROM runoff WHERE t >= 12 AND t < 60 AND reach_id > 10"),
        "loss_gradient": loss_gradient(),
        "transfers": planned("SELECT * FROM moves"),
        "transfer_tables": planned("SELECT row_number() OVER (ORDER BY src_cluster, src_reach) - 1 AS transfer_id, * FROM moves"),
        "cluster_ranges": planned('SELECT cluster, (sum(n) OVER (ORDER BY cluster) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY cluster))::BIGINT AS "end" FROM (SELECT cluster, count(*) AS n FROM plan GROUP BY cluster)'),
        "stage_layers": planned("SELECT DISTINCT cluster, stage FROM plan"),
        "segment_breakpoints": with_pairs("heap", f"{cuts(200)} SELECT reach_id FROM plan WHERE cut").replace(f"{PAIRS} ", f"{PAIRS}, "),
        "block_pieces": with_pairs("heap", f"{cuts(16, 'reaches')} SELECT reach_id, piece FROM assigned").replace(f"{PAIRS} ", f"{PAIRS}, "),
        "schedule": scheduled(200, 100),
        "schedule_blocks": scheduled_blocks(16, 100),
        "rapid_segmented": scheduled(400, 100),
        "route_staged": staged(" UNION ALL ".join(f"SELECT * FROM flow{k}" for k in range(32 // PIECE))),
        "staged_warm_start": staged(f"SELECT batch, reach_id + 1 AS reach_id, t, value FROM flow1 WHERE reach_id % {PIECE} = 0 AND reach_id < (SELECT max(reach_id) FROM reaches)"),
        "adjoint_dx": f"WITH RECURSIVE {kernel('linear_storage')}, {runoff()} {flow('SELECT batch, src AS reach_id, (t - lag)::INT AS t, sum(value * weight) AS value FROM runoff y JOIN kernel q ON q.dst = y.reach_id WHERE t - lag >= 0 GROUP BY ALL')}",
        "adjoint_dw": f"""WITH RECURSIVE {reaches()}, {PAIRS}, {runoff()} SELECT p.dst, p.src, (y.t - x.t)::INT AS lag, {rounded("sum(x.value * y.value)", 3, "1e9")} AS value
FROM pairs p JOIN runoff x ON x.reach_id = p.src JOIN runoff y ON y.reach_id = p.dst AND y.batch = x.batch AND y.t - x.t BETWEEN 0 AND {WINDOW - 1} GROUP BY ALL""",
        "adjoint_closure": with_pairs("heap", """SELECT reach_id, sum(v) AS value FROM (SELECT src AS reach_id, (dist + 1 + src % 3)::DOUBLE AS v FROM pairs
UNION ALL SELECT r.downstream_id, -(dist + 1 + src % 3)::DOUBLE FROM pairs JOIN reaches r ON r.reach_id = dst WHERE r.downstream_id IS NOT NULL) GROUP BY reach_id"""),
        "adjoint_prefix": with_pairs("heap", f"SELECT dst AS reach_id, {rounded('sum(tau)')} AS value FROM pairs JOIN reaches ON reach_id = src GROUP BY dst"),
        "rapid_ingest": rapid,
        "rapid_union": rapid,
        "kernel_subres_avg": f"WITH RECURSIVE {kernel('muskingum', f=s)} {weights}",
        "kernel_subres_sample": f"WITH RECURSIVE {kernel('linear_storage', f=s, mode='sample')} {weights}",
        "route_diag_off": f"WITH RECURSIVE {kernel('linear_storage', diag=False)}, {runoff()} {flow(f'SELECT batch, reach_id, t, sum(value) AS value FROM (SELECT * FROM ({conv()}) UNION ALL SELECT batch, reach_id, t, value FROM runoff) GROUP BY ALL')}",
        "route_batched": routed("linear_storage", batch="o_orderstatus"),
        "route_subres": routed("linear_storage", f=s),
        "conv_packed": routed("linear_storage"),
        "conv_blocks": routed("linear_storage"),
    }
    for name in ("linear_storage", "muskingum", "nash_cascade", "hayami", "pure_lag"):
        out[f"kernel_{name}"] = f"WITH RECURSIVE {kernel(name)} {weights}"
        out[f"route_{name}"] = routed(name)
    for name in ("pure_lag", "linear_storage", "nash_cascade", "muskingum", "hayami", "hayami_rescaled", "weibull"):
        out[f"irf_{name}"] = f"WITH {reaches()}, {irf(name)} SELECT reach_id, t::INT AS t, {rounded('w')} AS w FROM w"
    return out
