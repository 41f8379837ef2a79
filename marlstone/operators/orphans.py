"""References to records that are missing, deleted or late, kept as an incremental keyed state.

The state is keyed by the reference key and lives in append-only tables, one delta per step:

* ``live``: until when a key is live, as far as its parents are known (the latest delta of a key holds);
* ``made``: how many references each table has made to a key so far;
* ``flips``: the moments at which a key became live or ceased to be;
* ``seen``: the references, each with the verdict of its own time;
* ``moves``: what happened to references: ``opened`` (nothing live when made), ``resolved`` (a parent arrived),
  ``reopened`` (the parent was deleted), with the number of references moved.

A step takes the rows delivered in one span of time. It reads the state of the keys it touches only: those of its new
references and parents, and those whose deletion, known before, falls into the span. New references probe the key's
liveness at their own time; every arrival of a parent resolves the references waiting for it, every deletion opens the
references made so far again. Nothing of an earlier step is written anew. Deltas are folded when there are many.

References of one key are counted before anything is joined with its flips, and a reference row meets one row of its key,
so a key that holds a third of all references is a skewed probe side (split by adaptive execution) and no group.

Nulls and empty keys are no references. Repeated rows of a reference count once, at their earliest time. A parent row
without a time is never live; one deleted before it was recorded neither. Empty tables give no rows.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import Workspace

FOREVER = dt.datetime(9999, 12, 31)
BEFORE = dt.datetime(1, 1, 2)


def live_intervals(events: DataFrame) -> DataFrame:
    """(key, live_from, live_to) from parent rows (key, recorded_at, deleted_at): overlapping spans of a key merged."""
    span = events.where("key is not null and recorded_at is not null").select("key", F.col("recorded_at").alias("live_from"), F.coalesce("deleted_at", _time(FOREVER)).alias("live_to"))
    # Rows of one key that end together are one span; the many that never end become one row before the shuffle.
    span = span.where("live_to > live_from").groupBy("key", "live_to").agg(F.min("live_from").alias("live_from"))
    w = Window.partitionBy("key").orderBy("live_from", "live_to")
    cover = F.max("live_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = span.withColumn("new", F.when(cover >= F.col("live_from"), 0).otherwise(1)).withColumn("g", F.sum("new").over(w))
    return island.groupBy("key", "g").agg(F.min("live_from").alias("live_from"), F.max("live_to").alias("live_to")).drop("g")


def _time(t: dt.datetime) -> Column:
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f").rjust(26, "0")).cast("timestamp")


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class OrphanTracker:
    """Feed spans of parent rows and references in order of time; ``orphans``, ``open_at`` and ``open_counts`` read the state."""

    FOLD = 16

    def __init__(self, spark, name: str = "orphans"):
        self.ws = Workspace(spark, name)
        self.live: list[DataFrame] = []
        self.made: list[DataFrame] = []
        self.seen: list[DataFrame] = []
        self.moves: list[DataFrame] = []
        self.steps = 0

    def _current(self, keys: DataFrame | None = None) -> DataFrame | None:
        """(key, live_until): the state of the keys, of all without any given."""
        if not self.live:
            return None
        rows = _all([d.select("key", "live_until", "step") for d in self.live])
        if keys is not None:
            rows = rows.join(keys, "key", "left_semi")
        return rows.groupBy("key").agg(F.max(F.struct("step", "live_until"))["live_until"].alias("live_until"))

    def step(self, parents: DataFrame, refs: DataFrame, span: tuple) -> DataFrame:
        """parents (key, recorded_at, deleted_at), refs (ref_table, ref_field, ref_id, key, shown, at) of one span; returns its new orphans."""
        lo, hi = _time(span[0] or BEFORE), _time(span[1] or FOREVER)
        self.steps += 1
        rows = parents.select("key", "recorded_at", "deleted_at")
        before = None
        if self.live:
            # Deletions that fall due now touch their keys too.
            due = _all(self.live).where((F.col("live_until") >= lo) & (F.col("live_until") < hi)).select("key")
            before = self._current(_all([rows.select("key"), refs.select("key"), due]).distinct()).where(F.col("live_until") >= lo)
            rows = rows.unionByName(before.select("key", _time(BEFORE).alias("recorded_at"), F.col("live_until").alias("deleted_at")))
        held = live_intervals(rows)
        moments = F.array_compact(F.array(F.when(F.col("live_from") > _time(BEFORE), F.col("live_from")), F.when(F.col("live_to") < hi, F.col("live_to"))))
        keys = held.groupBy("key").agg(
            F.max(F.col("live_from") <= _time(BEFORE)).alias("first"), F.sort_array(F.flatten(F.collect_list(moments))).alias("flips"), F.max(F.when(F.col("live_to") >= hi, F.col("live_to"))).alias("live_until"))
        keys = self.ws.write(keys.withColumn("step", F.lit(self.steps)), "live")
        # A reference meets one row of its key: how many flips lie behind it, and whether the key is live.
        state = keys.select(F.col("key").alias("k"), "first", "flips")
        probe = refs.join(state, refs.key == state.k, "left").select("ref_table", "ref_field", "ref_id", "key", "shown", "at", F.coalesce("first", F.lit(False)).alias("first"),
                                                                    F.expr("coalesce(size(filter(flips, t -> t <= at)), 0)").alias("gap"))
        seen = self.ws.write(probe.withColumn("live", F.col("first") != (F.col("gap") % 2 == 1)).drop("first"), "seen")
        made = self.ws.write(seen.groupBy("ref_table", "key", "gap").agg(F.count(F.lit(1)).alias("n")), "made")
        self.moves.append(self.ws.write(self._moved(keys, seen, made), "moves"))
        self.live.append(keys)
        self.made.append(made)
        self.seen.append(seen)
        if len(self.live) > self.FOLD:
            self._fold()
        return seen.where("not live")

    def _moved(self, keys: DataFrame, seen: DataFrame, made: DataFrame) -> DataFrame:
        """(ref_table, key, at, kind, n): references opened, resolved and reopened in the step."""
        opened = seen.where("not live").groupBy("ref_table", "key", "at").agg(F.count(F.lit(1)).alias("n")).select("ref_table", "key", "at", F.lit("opened").alias("kind"), "n")
        flips = keys.select("key", "first", F.posexplode("flips").alias("pos", "at"))
        # References made before the step count from the first flip on, those of the step from the flip after them.
        counts = made.select("ref_table", "key", "gap", "n")
        if self.made:
            counts = counts.unionByName(_all(self.made).join(flips.select("key").distinct(), "key", "left_semi").groupBy("ref_table", "key").agg(F.sum("n").alias("n")).select("ref_table", "key", F.lit(0).alias("gap"), "n"))
        hit = flips.join(counts, "key").where("gap <= pos").groupBy("ref_table", "key", "at", "pos", "first").agg(F.sum("n").alias("n"))
        kind = F.when(F.col("first") == (F.col("pos") % 2 == 0), "reopened").otherwise("resolved")
        return opened.unionByName(hit.select("ref_table", "key", "at", kind.alias("kind"), "n"))

    def _fold(self) -> None:
        flips = self.flips()
        live = self._current().join(flips.groupBy("key").agg(F.sort_array(F.collect_list("at")).alias("flips")), "key", "left")
        old = [*self.live, *self.made]
        self.live = [self.ws.write(live.select("key", F.lit(False).alias("first"), F.coalesce("flips", F.array().cast("array<timestamp>")).alias("flips"), "live_until", F.lit(self.steps).alias("step")), "live")]
        self.made = [self.ws.write(_all(self.made).groupBy("ref_table", "key").agg(F.sum("n").alias("n")).select("ref_table", "key", F.lit(0).alias("gap"), "n"), "made")]
        self.ws.drop(*old)

    def flips(self) -> DataFrame:
        """(key, at): every moment at which a key became live or ceased to be; a key is dead before the first."""
        return _all([d.select("key", F.explode("flips").alias("at")) for d in self.live])

    def orphans(self) -> DataFrame:
        """Every reference that found nothing live at its own time."""
        return _all(self.seen).where("not live").drop("gap", "live")

    def references(self) -> DataFrame:
        return _all(self.seen).drop("gap", "live")

    def open_at(self, moment) -> DataFrame:
        """The references made by ``moment`` whose key is not live then: resolved ones gone, reopened ones back."""
        refs = self.references().where(F.col("at") <= F.lit(moment))
        live = self.flips().where(F.col("at") <= F.lit(moment)).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("key")
        return refs.join(live, "key", "left_anti")

    def open_counts(self) -> DataFrame:
        """(ref_table, period, refs, open): at the end of every month, the references made so far and those open then, from the moves."""
        month = F.trunc(F.col("at"), "month")
        made = self.references().groupBy("ref_table", month.alias("m")).agg(F.count(F.lit(1)).alias("made"))
        change = F.when(F.col("kind") == "resolved", -F.col("n")).otherwise(F.col("n"))
        moved = _all(self.moves).groupBy("ref_table", month.alias("m")).agg(F.sum(change).alias("moved"))
        # One row per table and month: small enough for a window per table.
        made = self.ws.write(made, "months")
        months = made.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
        grid = made.select("ref_table").distinct().crossJoin(months).select("ref_table", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("m"))
        # Moves before the first month of the grid count from it on.
        moved = moved.crossJoin(months).select("ref_table", F.greatest("m", "lo").alias("m"), "moved").groupBy("ref_table", "m").agg(F.sum("moved").alias("moved"))
        so_far = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(Window.partitionBy("ref_table").orderBy("m"))
        out = grid.join(made, ["ref_table", "m"], "left").join(moved, ["ref_table", "m"], "left")
        return out.select("ref_table", F.date_format("m", "yyyy-MM").alias("period"), so_far("made").alias("refs"), so_far("moved").alias("open"))


def spans(*frames: DataFrame, at: str, n: int) -> list[tuple]:
    """n half-open spans of equal length over the times of the frames; the first and the last are open-ended."""
    bounds = reduce(DataFrame.unionByName, [f.select(F.col(at).alias("at")) for f in frames]).agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    if bounds.a is None:
        return [(None, None)]
    cuts = [bounds.a + (bounds.b - bounds.a) * k / n for k in range(1, n)]
    return list(zip([None, *cuts], [*cuts, None]))


def span_number(at: str, cuts: list[tuple]) -> Column:
    """Which of the spans a time lies in."""
    out = F.lit(0)
    for k, (lo, _) in enumerate(cuts):
        if lo is not None:
            out = F.when(F.col(at) >= _time(lo), k).otherwise(out)
    return out
