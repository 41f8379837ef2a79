"""What changed between consecutive full snapshots of a table.

Method: number the snapshots of each owner by time; window every key over its snapshot indexes. The lagged digest shows
changes, a gap in the indexes shows a removal and a later addition, the end before the last snapshot a removal.
One shuffle over (owner, key); no snapshot is joined with another. The window of one key holds at most one row per
snapshot, so a hot owner spreads over its keys.

Nulls: a null owner, commit or key takes part in nothing; a null digest equals null and differs from any value.
Repeated rows and ties on the delivery time: the row with the greatest digest holds, so the result is the same in every
order. Empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_snapshots(snapshots: DataFrame, owner: str, version: str, at: str) -> DataFrame:
    """(owner, version, idx, prev, nxt, n): distinct versions of each owner in order of their earliest time."""
    s = (
        snapshots.select(F.col(owner).alias("owner"), F.col(version).alias("version"), F.col(at).alias("at"))
        .where("owner is not null and version is not null")
        .groupBy("owner", "version")
        .agg(F.min("at").alias("at"))
    )
    w = Window.partitionBy("owner").orderBy(F.col("at").asc_nulls_last(), "version")
    return s.select(
        "owner",
        "version",
        F.row_number().over(w).alias("idx"),
        F.lag("version").over(w).alias("prev"),
        F.lead("version").over(w).alias("nxt"),
        F.count(F.lit(1)).over(Window.partitionBy("owner")).alias("n"),
    )


def snapshot_changes(rows: DataFrame, snapshots: DataFrame, *, owner: str, version: str, key: Column, digest: Column,
                     delivered: str, snap_owner: str, snap_version: str, snap_at: str) -> DataFrame:
    """(owner, prev_version, version, key, change) with change added, removed or changed."""
    numbered = number_snapshots(snapshots, snap_owner, snap_version, snap_at)
    held = (
        rows.select(F.col(owner).alias("owner"), F.col(version).alias("version"), key.alias("key"), digest.alias("digest"), F.col(delivered).alias("delivered"))
        .where("owner is not null and version is not null and key is not null")
        .groupBy("owner", "version", "key")
        .agg(F.max(F.struct("delivered", "digest"))["digest"].alias("digest"))
    )
    w = Window.partitionBy("owner", "key").orderBy("idx")
    seen = held.join(numbered, ["owner", "version"]).select(
        "*",
        F.lag("idx").over(w).alias("idx_before"),
        F.lag("digest").over(w).alias("digest_before"),
        F.lead("idx").over(w).alias("idx_after"),
    )
    event = lambda prev, cur, what: F.struct(prev.alias("prev_version"), cur.alias("version"), F.lit(what).alias("change"))
    here, before, after = F.col("idx"), F.col("idx_before"), F.col("idx_after")
    joined_on = before == here - 1
    came = F.when((here > 1) & ~F.coalesce(joined_on, F.lit(False)), event(F.col("prev"), F.col("version"), "added"))
    changed = F.when(joined_on & ~F.col("digest").eqNullSafe(F.col("digest_before")), event(F.col("prev"), F.col("version"), "changed"))
    went = F.when((here < F.col("n")) & ~F.coalesce(after == here + 1, F.lit(False)), event(F.col("version"), F.col("nxt"), "removed"))
    return (
        seen.select("owner", "key", F.explode(F.array_compact(F.array(came, changed, went))).alias("e"))
        .select("owner", "e.prev_version", "e.version", "key", "e.change")
    )
