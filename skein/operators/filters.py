"""Edge predicates that compose with every read operator, and adjacency by direction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EdgeFilter:
    """All that are given must hold. An empty ``contributors`` matches nothing; prefix "" and 0 match everything."""

    contributors: Sequence[str] | None = None
    prefix: str | None = None
    min_corroboration: int | None = None

    def column(self) -> Column | None:
        c = []
        if self.contributors is not None:
            ids = F.array(*map(F.lit, self.contributors)) if self.contributors else F.array().cast("array<string>")
            c.append(F.arrays_overlap(F.map_keys("contributions"), ids))
        if self.prefix is not None:
            c.append(F.col("relationship").startswith(self.prefix))
        if self.min_corroboration is not None:
            c.append(F.size("contributions") >= self.min_corroboration)
        return every(c)


def every(conds: Sequence[Column | None]) -> Column | None:
    out = None
    for c in conds:
        if c is not None:
            out = c if out is None else out & c
    return out


def edge_cond(relationship: str | None = None, min_weight: float | None = None, edge_filter: EdgeFilter | None = None) -> Column | None:
    return every([None if relationship is None else F.col("relationship") == relationship, None if min_weight is None else F.col("raw_weight") >= min_weight, edge_filter and edge_filter.column()])


def adjacency(edges: DataFrame, direction: str = "outgoing") -> DataFrame:
    """The edges with columns ``here`` and ``there``: which end is expanded, which is reached."""
    out = edges.withColumns({"here": F.col("source"), "there": F.col("target")})
    back = edges.withColumns({"here": F.col("target"), "there": F.col("source")})
    if direction == "both":
        return out.unionByName(back)
    if direction not in ("outgoing", "incoming"):
        raise ValueError(f"direction: {direction}")
    return out if direction == "outgoing" else back
