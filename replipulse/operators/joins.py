"""Joins between configured parents and landed children."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def join_keeping_childless(
    parents: DataFrame, children: DataFrame, on: Sequence[str]
) -> DataFrame:
    """``parents`` left join ``children`` for few parents with very many children.

    Spark can neither broadcast the left side of a left join nor split a hot key
    on its right side. An inner join allows both; parents without children are
    added by an anti join against the distinct keys, which combine before the
    shuffle.
    """
    on = list(on)
    matched = parents.join(children, on)
    childless = parents.join(children.select(*on).distinct(), on, "left_anti")
    return matched.unionByName(childless, allowMissingColumns=True)
