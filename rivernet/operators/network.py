"""River networks: one row a reach, its downstream reach or null, and channel parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.irf import get_irf


class NetworkError(ValueError):
    pass


@dataclass(frozen=True)
class RiverNetwork:
    """``reaches(reach_id, downstream_id, <parameters>)``, the response function, and whether a reach routes its own runoff."""

    reaches: DataFrame
    irf: str = "linear_storage"
    include_self: bool = True

    def params(self) -> DataFrame:
        return self.reaches.select("reach_id", *get_irf(self.irf).params)

    def edges(self) -> DataFrame:
        """reach_id, downstream_id of every reach that has one downstream."""
        return self.reaches.select("reach_id", "downstream_id").filter("downstream_id IS NOT NULL")

    def with_params(self, params: DataFrame, on_missing: str = "error") -> RiverNetwork:
        """Takes the response function's parameters from ``params(reach_id, ...)``.

        A missing column or reach raises, or counts as 0 with ``on_missing="zero"``.
        """
        names = get_irf(self.irf).params
        absent = [n for n in names if n not in params.columns]
        if absent and on_missing != "zero":
            raise NetworkError(f"no parameter column {', '.join(absent)}")
        given = params.select("reach_id", *(F.col(n) if n in params.columns else F.lit(0.0).alias(n) for n in names))
        rows = self.reaches.drop(*names).join(given, "reach_id", "left")
        if on_missing == "zero":
            rows = rows.fillna(0.0, list(names))
        elif not rows.filter(" OR ".join(f"{n} IS NULL" for n in names)).isEmpty():
            raise NetworkError("a reach has no parameters")
        return replace(self, reaches=rows)

    def validate(self) -> RiverNetwork:
        """Raises where a reach is null or repeated, or drains to one that isn't there; cycles are found by the closure."""
        r = self.reaches
        if not r.filter("reach_id IS NULL").isEmpty():
            raise NetworkError("a reach has no id")
        if not r.groupBy("reach_id").count().filter("count > 1").isEmpty():
            raise NetworkError("a reach is there twice: every reach has one downstream reach at most")
        if not self.edges().join(r.select(F.col("reach_id").alias("downstream_id")), "downstream_id", "left_anti").isEmpty():
            raise NetworkError("a downstream reach is not in the network")
        missing = [c for c in get_irf(self.irf).params if c not in r.columns]
        if missing:
            raise NetworkError(f"no parameter column {', '.join(missing)}")
        return self


def from_edges(nodes: DataFrame, edges: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """``reaches`` of nodes(reach_id, ...) and edges(reach_id, downstream_id)."""
    return nodes.select("reach_id", *columns).join(edges.select("reach_id", "downstream_id"), "reach_id", "left").select("reach_id", "downstream_id", *columns)


def check_runoff(runoff: DataFrame, reaches: DataFrame | None = None) -> None:
    """Raises where the columns are wrong or, with ``reaches``, runoff falls on a reach that isn't in the network."""
    absent = {"batch", "reach_id", "t", "value"} - set(runoff.columns)
    if absent:
        raise NetworkError(f"runoff has no column {', '.join(sorted(absent))}")
    if reaches is not None and not runoff.select("reach_id").join(reaches, "reach_id", "left_anti").isEmpty():
        raise NetworkError("runoff on a reach that is not in the network")
