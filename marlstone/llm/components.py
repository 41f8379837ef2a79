"""Pairwise matches to groups: large-star and small-star rewrites through joins.

Names are numbered by a 64-bit hash first (names that share one get others, told by a check of the written names), so all
rounds aggregate and join numbers. Edges point from the greater end ``hi`` to the lesser ``lo``. Large-star hands every
edge on to the least neighbour of its lesser end, small-star links all lesser ends of a node, and the node itself, to the
least of them; as a greater neighbour never lowers a minimum, both need only the minimum over ``hi``: an aggregation with
map-side combine, so a hub is reduced before it is shuffled, and one equi join, whose skewed side adaptive execution
splits. No neighbourhood is ever collected. The edges end as stars around one node of each component after about log2(n)
rounds; the rounds stop when neither rewrite changes the edge set, told by its count and checksum. At the end each group
takes its least name.

Null or empty ends make no link. A self-link makes a group of one. Repeated and reversed pairs count once. Empty input
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.session import Workspace


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """edges (hi, lo) with hi > lo -> each linked to the least neighbour of its lesser end."""
    least = _least(edges)
    return edges.join(least, edges.lo == least.u, "left").select("hi", F.coalesce("m", "lo").alias("lo"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    moved = edges.join(least, edges.hi == least.u).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()


def stars(ws: Workspace, edges: DataFrame) -> DataFrame:
    """edges (hi, lo) of numbers, distinct, hi > lo -> the same components as stars around their least number."""
    mark = old = None
    while True:
        # Count and checksum are taken while the edges are written.
        seen = Observation()
        edges = ws.write(_small_star(_large_star(edges)).observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("h")), "edges")
        ws.drop(old)
        old = edges
        new = (seen.get["n"], seen.get["h"])
        if new == mark:
            return edges
        mark = new


def _links(p: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(edges between different numbers, numbers of self-links)."""
    return p.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), p.where(F.col(a) == F.col(b)).select(F.col(a).alias("lo"))


def _spread(edges: DataFrame, loops: DataFrame) -> DataFrame:
    """Stars to (node, group), one row per number."""
    rows = edges.select(F.col("hi").alias("node"), F.col("lo").alias("group")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("group"))).unionByName(
        loops.select(F.col("lo").alias("node"), F.col("lo").alias("group")))
    return rows.groupBy("node").agg(F.min("group").alias("group"))


def _numbered(ws: Workspace, names: DataFrame, number: Callable[[Column], Column]) -> tuple[DataFrame, bool]:
    """names (name), distinct -> (name, id) with an id for each name alone, and whether it is its plain number everywhere."""
    nodes, turn = ws.write(names.select("name", number(F.col("name")).alias("id")), "nodes"), 0
    while True:
        twice = ws.write(nodes.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id"), "twice")
        if twice.isEmpty():
            return nodes, turn == 0
        turn += 1
        # The least name keeps the number, the others draw again.
        keeps = nodes.join(twice, "id", "left_semi").groupBy("id").agg(F.min("name").alias("keeps"))
        nodes = ws.write(nodes.join(keeps, "id", "left").select("name", F.when(F.coalesce(F.col("name") == F.col("keeps"), F.lit(True)), F.col("id")).otherwise(F.xxhash64(F.lit(turn), "name")).alias("id")), "nodes")


def connected_groups(pairs: DataFrame, a: str, b: str, number: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(node, group): group is the least id linked with node directly or through others; ids are strings or bigints."""
    ws = Workspace(pairs.sparkSession, "groups")
    p = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    if dict(p.dtypes)["a"] == "bigint":
        edges, loops = _links(p, "a", "b")
        return _spread(stars(ws, ws.write(edges, "pairs")), loops)
    p = ws.write(p.where("a <> '' and b <> ''").distinct(), "named")
    nodes, plain = _numbered(ws, p.select(F.explode(F.array("a", "b")).alias("name")).distinct(), number)
    if plain:
        p = p.select(number(F.col("a")).alias("x"), number(F.col("b")).alias("y"))
    else:
        of = lambda c, n: nodes.select(F.col("name").alias(c), F.col("id").alias(n))
        p = p.join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")
    edges, loops = _links(p, "x", "y")
    found = _spread(stars(ws, ws.write(edges, "pairs")), loops).join(nodes, F.col("node") == F.col("id")).select("name", "group")
    found = ws.write(found, "found")
    least = found.groupBy("group").agg(F.min("name").alias("least"))
    return found.join(least, "group").select(F.col("name").alias("node"), F.col("least").alias("group"))
