"""Size-bounded packs: shards balanced by weight, splits by budget, scopes expanded to child paths, greedy evidence packs.

These are order-dependent by definition. Each runs per project on that project's modules or scopes, aggregates that are
orders of magnitude fewer than its files; the files themselves are counted before, with map-side combine.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import Workspace


def balance_shards(units: DataFrame, group: str, unit: str, weight: str, shards: int) -> DataFrame:
    """(group, unit, weight, shard): heaviest unit first to the lightest shard, the lower number on ties; few units are a shard each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        load = [0] * min(shards, len(pdf))
        out = []
        if len(pdf) <= shards:
            out = [(g, u, w, i) for i, (g, u, w) in enumerate(sorted(pdf[[group, unit, weight]].itertuples(index=False), key=lambda r: r[1]))]
        else:
            for g, u, w in sorted(pdf[[group, unit, weight]].itertuples(index=False), key=lambda r: (-r[2], r[1])):
                i = min(range(len(load)), key=lambda k: (load[k], k))
                load[i] += w
                out.append((g, u, w, i))
        return pd.DataFrame(out, columns=[group, unit, weight, "shard"])

    return units.groupBy(group).applyInPandas(run, f"{group} string, {unit} string, {weight} bigint, shard int")


def split_by_budget(units: DataFrame, group: str, unit: str, size: str, budget: int) -> DataFrame:
    """(group, unit, shard, shard_bytes, fits): units in order, halved until a half fits; a lone unit that does not fit is told, never dropped."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf[[group, unit, size]].itertuples(index=False), key=lambda r: r[1])
        todo, out, n = [rows], [], 0
        while todo:
            part = todo.pop(0)
            total = sum(r[2] for r in part)
            if total <= budget and math.ceil(total / 4) <= budget or len(part) == 1:
                out += [(g, u, n, total, total <= budget) for g, u, _ in part]
                n += 1
            else:
                half = (len(part) + 1) // 2
                todo[:0] = [part[:half], part[half:]]
        return pd.DataFrame(out, columns=[group, unit, "shard", "shard_bytes", "fits"])

    return units.groupBy(group).applyInPandas(run, f"{group} string, {unit} string, shard int, shard_bytes bigint, fits boolean")


def expand_scopes(files: DataFrame, budget: int) -> DataFrame:
    """(project, scope, owner, bytes, fits): top directories, replaced by their children while they are over the budget.

    Level by level: every file counts for its prefix of that depth; a prefix that fits, or is a file, is accepted, the
    others go one level down, however deep the tree is. Sums are aggregations, no project is collected.
    """
    ws = Workspace(files.sparkSession, "scopes")
    f = ws.write(files.select("project", F.split("path", "/").alias("p"), "bytes"), "files")
    out, depth = None, 0
    while True:
        depth += 1
        scope = F.array_join(F.slice("p", 1, depth), "/")
        s = f.groupBy("project", scope.alias("scope")).agg(F.sum("bytes").alias("bytes"), F.max(F.size("p")).alias("deep"), F.min(F.element_at("p", 1)).alias("owner"))
        s = ws.write(s.withColumn("fits", F.col("bytes") <= budget), "level")
        done = s.where(F.col("fits") | (F.col("deep") <= depth)).select("project", "scope", "owner", "bytes", "fits")
        out = done if out is None else out.unionByName(done)
        rest = s.where(~F.col("fits") & (F.col("deep") > depth)).select("project", "scope")
        if rest.isEmpty():
            return out
        f = ws.write(f.withColumn("scope", scope).join(rest, ["project", "scope"], "left_semi").drop("scope"), "files")


def greedy_pack(hints: DataFrame, group: str, order: str, items: str, capacity: int) -> DataFrame:
    """(group, order, accepted, new_items): hints in order; one whose new items do not fit is passed over, later ones may still fit.

    One group's hints and the at most ``capacity`` items taken are held at a time.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        out = []
        for r in pdf.sort_values(order).itertuples(index=False):
            row = r._asdict()
            new = {i for i in (row[items] if row[items] is not None else []) if i is not None} - taken
            ok = len(taken) + len(new) <= capacity
            if ok:
                taken |= new
            out.append((row[group], row[order], ok, len(new)))
        return pd.DataFrame(out, columns=[group, order, "accepted", "new_items"])

    return hints.groupBy(group).applyInPandas(run, f"{group} string, {order} string, accepted boolean, new_items int")
