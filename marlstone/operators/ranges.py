"""Joins of places with the ranges that hold them, without pairing all of both.

A range of length n belongs to the level k of the least power of two not below n and lies in at most two cells of 2^k there;
a place lies in one cell of every level. The join is an equality on (scope, level, cell), so a pair is made only of a range
and a place within twice its length, and a scope with many of both makes no product. A place meets the levels that occur in
its scope only. A range that ends before it begins, or has a null end, holds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def places_in_ranges(places: DataFrame, ranges: DataFrame, scope: list[str], at: str, lo: str, hi: str) -> DataFrame:
    """Rows of both where the scopes are equal and lo <= at <= hi; the other columns must differ in name."""
    level = F.expr(f"cast(ceil(log2(cast({hi} as bigint) - {lo} + 1)) as int)")
    held = ranges.where(f"{lo} <= {hi}").withColumn("_level", level)
    cells = held.withColumn("_cell", F.explode(F.expr(f"array_distinct(array(shiftright(cast({lo} as bigint), _level), shiftright(cast({hi} as bigint), _level)))")))
    levels = held.select(*scope, "_level").distinct()
    found = places.join(levels, scope).withColumn("_cell", F.expr(f"shiftright(cast({at} as bigint), _level)")).join(cells, [*scope, "_level", "_cell"])
    return found.where(f"{at} between {lo} and {hi}").drop("_level", "_cell")


def overlapping_ranges(left: DataFrame, right: DataFrame, scope: list[str], a: str, b: str, lo: str, hi: str) -> DataFrame:
    """Rows of both with a <= hi and lo <= b: either the left range begins in the right one, or the right one begins later in the left."""
    begins = places_in_ranges(left, right, scope, a, lo, hi).where(f"{lo} <= {b}")
    after = places_in_ranges(right, left.withColumn("_next", F.col(a) + 1), scope, lo, "_next", b).where(f"{a} <= {hi}").drop("_next")
    return begins.unionByName(after)
