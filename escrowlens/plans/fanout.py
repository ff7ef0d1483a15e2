"""Closed form of a fan-out join.

When k one-to-many sides are left-joined onto one key and then aggregated,
every row of side s is repeated prod_{o != s} max(n_o, 1) times, where n_o is
the row count of side o for that key.  So a count or sum over side s equals
its per-key aggregate times that product; averages are unchanged.  Computing
the per-side aggregates (partial aggregation, one shuffle each) and
multiplying avoids materialising the sum over keys of n_1 * ... * n_k rows,
which grows with the cube of per-key activity.

Products are taken in ``decimal(38,0)`` and cast back to ``bigint``; under
ANSI mode a value past 2^63 raises instead of wrapping.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def fanout_closed_form(side_counts: dict[str, str]) -> Callable[[str, Column], Column]:
    """``side_counts`` maps side name -> column with that side's row count."""

    def multiplier(side: str) -> Column:
        m = F.lit(1).cast("decimal(38,0)")
        for other, n in side_counts.items():
            if other != side:
                m = m * F.greatest(F.coalesce(F.col(n), F.lit(0)), F.lit(1)).cast(
                    "decimal(38,0)")
        return m

    def apply(side: str, agg: Column) -> Column:
        return (agg.cast("decimal(38,0)") * multiplier(side)).cast("bigint")

    return apply
