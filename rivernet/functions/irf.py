"""Impulse response functions.

A builder gets the parameter columns by name, the number of samples ``n`` and
the step ``dt``, and returns an ``array<double>`` of ``n`` weights, lag 0 first.
Slopes are the same for the derivative by each parameter.  A response may also
be given as a function of NumPy arrays, which runs on Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Params = Mapping[str, Column]
Builder = Callable[[Params, int, float], Column]
Slopes = Callable[[Params, int, float], dict[str, Column]]
Vectorised = Callable[[Mapping[str, np.ndarray], int, float], np.ndarray]
STEP = 1e-6  # of a parameter, where a response has no slopes of its own


@dataclass(frozen=True)
class Irf:
    """``build`` makes weights of columns, ``vectorised`` of arrays (one of the two is given)."""

    name: str
    params: tuple[str, ...]
    build: Builder | None = None
    own_slopes: Slopes | None = None
    vectorised: Vectorised | None = None

    def slopes(self, p: Params, n: int, dt: float) -> dict[str, Column]:
        """The derivative of the weights by each parameter; without ``own_slopes`` from two responses close by."""
        if self.own_slopes:
            return self.own_slopes(p, n, dt)
        if self.build is None:
            raise NotImplementedError(f"{self.name} has no slopes: give ``slopes`` when it is registered")
        out = {}
        for name in self.params:
            step = STEP * F.greatest(F.abs(p[name]), F.lit(1.0))
            up, down = (self.build({**p, name: p[name] + side * step}, n, dt) for side in (1, -1))
            out[name] = F.zip_with(up, down, lambda a, b: (a - b) / (2 * step))  # noqa: B023
        return out


def _samples(n: int, weight: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: weight(t.cast("double")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that isn't computed again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)


def _normalised(weights: Column) -> Column:
    return _once(weights, lambda ws: _once(_total(ws), lambda total: F.transform(ws, lambda w: w / total)))


def _normalised_slopes(weights: Column, log_slopes: Mapping[str, Column]) -> dict[str, Column]:
    """Slopes of weights that sum to 1, from those of their logarithms before they were made to."""

    def centred(ws: Column, slopes: Column) -> Column:
        return _once(_total(F.zip_with(ws, slopes, lambda w, s: w * s)), lambda mean: F.zip_with(ws, slopes, lambda w, s: w * (s - mean)))

    def of(slope: Column) -> Column:
        return _once(weights, lambda ws: _once(slope, lambda slopes: centred(ws, slopes)))

    return {name: of(slope) for name, slope in log_slopes.items()}


def pure_lag(p: Params, n: int, dt: float) -> Column:
    return _samples(n, lambda t: F.greatest(F.lit(0.0), 1 - F.abs(t - p["delay"] / dt)))


def pure_lag_slopes(p: Params, n: int, dt: float) -> dict[str, Column]:
    gap = lambda t: t - p["delay"] / dt
    return {"delay": _samples(n, lambda t: F.when(F.abs(gap(t)) < 1, F.signum(gap(t)) / dt).otherwise(0.0))}


def _outflow(p: Params, dt: float) -> Column:
    """Share of a reservoir that leaves it in a step."""
    return 1 / (1 + p["tau"] / dt)


def _ways(t: Column, reservoirs: int) -> Column:
    ways = F.lit(1.0)
    for j in range(1, reservoirs):
        ways = ways * (t + j) / j
    return ways


def nash_cascade(p: Params, n: int, dt: float, reservoirs: int = 3) -> Column:
    x = _outflow(p, dt)
    return _samples(n, lambda t: _ways(t, reservoirs) * F.pow(x, F.lit(float(reservoirs))) * F.pow(1 - x, t))


def _cascade_slopes(p: Params, n: int, dt: float, reservoirs: int) -> dict[str, Column]:
    x, r = _outflow(p, dt), float(reservoirs)
    by_x = lambda t: _ways(t, reservoirs) * F.pow(x, F.lit(r - 1)) * (r * F.pow(1 - x, t) - F.when(t > 0, x * t * F.pow(1 - x, t - 1)).otherwise(0.0))
    return {"tau": _samples(n, lambda t: by_x(t) * -x * x / dt)}


def nash_cascade_slopes(p: Params, n: int, dt: float) -> dict[str, Column]:
    return _cascade_slopes(p, n, dt, 3)


def linear_storage(p: Params, n: int, dt: float) -> Column:
    x = _outflow(p, dt)
    return _samples(n, lambda t: x * F.pow(1 - x, t))


def linear_storage_slopes(p: Params, n: int, dt: float) -> dict[str, Column]:
    return _cascade_slopes(p, n, dt, 1)


def _coefficients(p: Params, dt: float) -> tuple[Column, Column, Column, Column]:
    k, x, half = p["k"], p["x"], dt / 2
    d = k * (1 - x) + half
    return (half - k * x) / d, (half + k * x) / d, (k * (1 - x) - half) / d, d


def muskingum(p: Params, n: int, dt: float) -> Column:
    c0, c1, c2, _ = _coefficients(p, dt)
    return _samples(n, lambda t: F.when(t == 0, c0).otherwise((c1 + c2 * c0) * F.pow(c2, t - 1)))


def muskingum_slopes(p: Params, n: int, dt: float) -> dict[str, Column]:
    c0, c1, c2, d = _coefficients(p, dt)
    k, x = p["k"], p["x"]
    # Each coefficient is a quotient over d: its slope is (that of the upper part - coefficient * that of d) / d.
    by = {"x": ((-k + c0 * k) / d, (k + c1 * k) / d, (-k + c2 * k) / d), "k": ((-x - c0 * (1 - x)) / d, (x - c1 * (1 - x)) / d, (1 - x) * (1 - c2) / d)}

    def slope(s0: Column, s1: Column, s2: Column) -> Column:
        tail = lambda t: (s1 + s2 * c0 + c2 * s0) * F.pow(c2, t - 1) + F.when(t > 1, (c1 + c2 * c0) * (t - 1) * F.pow(c2, t - 2) * s2).otherwise(0.0)
        return _samples(n, lambda t: F.when(t == 0, s0).otherwise(tail(t)))

    return {name: slope(*s) for name, s in by.items()}


def _wave(p: Params, i: Column, dt: float) -> tuple[Column, Column]:
    """Time at the end of a step, and how far from the reach's end the wave then is."""
    return (i + 1) * dt, p["L"] - p["c"] * i * dt


def hayami(p: Params, n: int, dt: float) -> Column:
    """Advection-diffusion response, normalised in log space."""

    def log_weight(i: Column) -> Column:
        t, gap = _wave(p, i, dt)
        return F.ln(p["L"]) - math.log(2) - 0.5 * (math.log(math.pi) + F.ln(p["D"]) + 3 * F.ln(t)) - gap * gap / (4 * p["D"] * t)

    return _normalised(_once(_samples(n, log_weight), lambda logs: _once(F.array_max(logs), lambda most: F.transform(logs, lambda v: F.exp(v - most)))))


def hayami_slopes(p: Params, n: int, dt: float) -> dict[str, Column]:
    def by_distance(i: Column) -> Column:
        t, gap = _wave(p, i, dt)
        return -gap / (2 * p["D"] * t)

    def by_diffusion(i: Column) -> Column:
        t, gap = _wave(p, i, dt)
        return gap * gap / (4 * p["D"] * p["D"] * t)

    # What depends on a parameter alone is the same at every step and falls out of normalised weights.
    return _normalised_slopes(hayami(p, n, dt), {"L": _samples(n, by_distance), "D": _samples(n, by_diffusion), "c": _samples(n, lambda i: by_distance(i) * -i * dt)})


def hayami_rescaled(p: Params, n: int, dt: float) -> Column:
    """The same as each step's weight over that of the step with the least travel cost, whose own is 1."""

    def cost(i: Column) -> Column:
        t, gap = _wave(p, i, dt)
        return gap * gap / (4 * p["D"] * t)

    thinned = _samples(n, lambda i: F.pow(i + 1, F.lit(-1.5)))
    return _normalised(_once(_samples(n, cost), lambda costs: _once(F.array_min(costs), lambda least: F.zip_with(costs, thinned, lambda c, w: w * F.exp(least - c)))))


def _since(p: Params, i: Column, dt: float) -> Column:
    return F.greatest((i + 1) * dt - p["onset"], F.lit(0.0)) / p["scale"]


def weibull(p: Params, n: int, dt: float) -> Column:
    def weight(i: Column) -> Column:
        z = _since(p, i, dt)
        return F.when(z > 0, p["shape"] / p["scale"] * F.pow(z, p["shape"] - 1) * F.exp(-F.pow(z, p["shape"]))).otherwise(0.0)

    return _normalised(_samples(n, weight))


def weibull_slopes(p: Params, n: int, dt: float) -> dict[str, Column]:
    s = p["shape"]

    def where_begun(slope: Callable[[Column], Column]) -> Column:
        return _samples(n, lambda i: F.when(_since(p, i, dt) > 0, slope(_since(p, i, dt))).otherwise(0.0))

    return _normalised_slopes(weibull(p, n, dt), {
        "shape": where_begun(lambda z: F.ln(z) * (1 - F.pow(z, s))),
        "scale": where_begun(lambda z: s * F.pow(z, s) / p["scale"]),
        "onset": where_begun(lambda z: (s * F.pow(z, s) - (s - 1)) / (z * p["scale"])),
    })


REGISTRY: dict[str, Irf] = {}


def register_irf(name: str, build: Builder | None, params: tuple[str, ...], slopes: Slopes | None = None, vectorised: Vectorised | None = None) -> None:
    """Makes a response function known by name; an earlier one of that name is replaced.

    Either ``build`` (columns) or ``vectorised``: a function of arrays by
    parameter name, n and dt that gives a matrix [reaches, n], a batch of
    reaches at a time.
    """
    if (build is None) == (vectorised is None):
        raise ValueError("give either a builder of columns or a function of arrays")
    REGISTRY[name] = Irf(name, tuple(params), build, slopes, vectorised)


def get_irf(name: str) -> Irf:
    if name not in REGISTRY:
        raise KeyError(f"no response function {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name]


for _name, _build, _params, _slopes in (
    ("pure_lag", pure_lag, ("delay",), pure_lag_slopes), ("linear_storage", linear_storage, ("tau",), linear_storage_slopes), ("nash_cascade", nash_cascade, ("tau",), nash_cascade_slopes),
    ("muskingum", muskingum, ("x", "k"), muskingum_slopes), ("hayami", hayami, ("L", "D", "c"), hayami_slopes), ("hayami_rescaled", hayami_rescaled, ("L", "D", "c"), hayami_slopes), ("weibull", weibull, ("shape", "scale", "onset"), weibull_slopes),
):
    register_irf(_name, _build, _params, _slopes)
