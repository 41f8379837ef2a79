"""Graph operators on edge tables: degrees, components, bounded traversal, slices, layers.

A graph is edges (id, source_id, target_id, kind, ...) whose ends exist. Traversals run level by level: the frontier
joins the adjacency, an anti join removes what was visited, and where a limit binds, rows are ranked exactly as a queue
would meet them (depth, rank of the parent, neighbour), so truncation is deterministic. Every round is written to the
shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import Workspace
from .digest import group_digest
from .prefix import running

CALL_KINDS = ["calls", "route-handler"]
IMPACT_KINDS = ["calls", "route-handler", "references"]


def neighbours(edges: DataFrame, direction: str, kinds: list[str] | None = None) -> DataFrame:
    """Distinct (u, v) pairs to step along."""
    if direction not in ("forward", "reverse", "both"):
        raise ValueError("direction must be forward, reverse or both")
    e = edges if not kinds else edges.where(F.col("kind").isin(kinds))
    fwd = e.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"))
    rev = e.select(F.col("target_id").alias("u"), F.col("source_id").alias("v"))
    return {"forward": fwd, "reverse": rev, "both": fwd.unionByName(rev)}[direction].distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree): distinct neighbours, not edges."""
    ends = edges.select("source_id", "target_id").distinct()
    d = ends.select(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(ends.select(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return d.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def components(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """(id, component): least node reachable without regard to direction.

    Contraction: every node points to the least node of its neighbourhood, pointers are followed twice, and the graph
    shrinks to the nodes pointed at. Each round at least halves what still has neighbours, so the rounds are few and the
    later ones small; the pointer tables are chained at the end. Minima are aggregated before the shuffle, and a hub is a
    skewed probe side, never a group.
    """
    ws = Workspace(edges.sparkSession, "components")
    ordered = lambda d, x, y: d.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).distinct()
    pairs = ws.write(ordered(edges, "source_id", "target_id"), "pairs")
    ends = edges.select(F.col("source_id").alias("id")).unionByName(edges.select(F.col("target_id").alias("id")))
    maps: list[DataFrame] = []
    while pairs.limit(1).count():
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = ws.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")), "up")
        for _ in range(2):
            hop = up.select(F.col("u").alias("q"), F.col("p").alias("pp"))
            up = ws.write(up.join(hop, up.p == hop.q).select("u", F.col("pp").alias("p")), "up")
        maps.append(up)
        a, b = up.select("u", F.col("p").alias("pu")), up.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        new = ws.write(ordered(pairs.join(a, "u").join(b, "v"), "pu", "pv"), "pairs")
        ws.drop(pairs)
        pairs = new
    out = (ends if isolated is None else ends.unionByName(isolated.select("id"))).distinct().withColumn("component", F.col("id"))
    for m in maps:
        out = out.join(m, out.component == m.u, "left").select("id", F.coalesce("p", "component").alias("component"))
    return out


def component_records(edges: DataFrame, comp: DataFrame, limit: int | None = None) -> DataFrame:
    """(component, component_id, node_count, edge_count, position): largest first, then least id.

    component_id is a two-level digest of the node ids, so that the largest component is no single task. With a limit
    only the leading components are ranked; without, positions come from a range-partitioned pass.
    """
    nodes = group_digest(comp, ["component"], F.col("id"), "digest").withColumnRenamed("rows", "node_count")
    inner = edges.join(comp.withColumnRenamed("id", "source_id"), "source_id").groupBy("component").agg(F.count(F.lit(1)).alias("edge_count"))
    ident = F.concat(F.lit("graph-component_"), F.substring("digest", 1, 16))
    out = nodes.join(inner, "component", "left").select("component", ident.alias("component_id"), "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"))
    if limit:
        return first(out, [F.desc("node_count"), F.asc("component")], limit)
    return running(out.withColumns({"_all": F.lit("all"), "_size": -F.col("node_count")}), "_all", ["_size", "component"]).drop("_all", "_size")


def first(df: DataFrame, order: list, n: int, name: str = "position") -> DataFrame:
    """The n leading rows of the whole table with their rank: every partition sends its n best, nothing is sorted as a whole."""
    return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def traverse(edges: DataFrame, seeds: DataFrame, *, direction: str = "both", depth: int = 2, limit: int | None = 80, kinds: list[str] | None = None, group: str = "seed") -> DataFrame:
    """(group, id, distance, rank): nodes within depth of each group's seeds, at most limit per group; rank is 0 without a limit.

    seeds (group, id[, pos]); a group is one traversal with one queue. With limit, a group's visits are ranked in queue
    order and cut exactly there.
    """
    if depth < 0:
        raise ValueError("depth must be zero or greater")
    if limit is not None and limit <= 0:
        raise ValueError("limit must be greater than zero")
    ws = Workspace(edges.sparkSession, "traverse")
    step = neighbours(edges, direction, kinds)
    start = seeds if "pos" in seeds.columns else seeds.withColumn("pos", F.lit(0))
    lead = F.row_number().over(Window.partitionBy(group).orderBy("pos", "id"))
    seen = start.groupBy(group, "id").agg(F.min("pos").alias("pos")).select(group, "id", F.lit(0).alias("distance"), (lead if limit is not None else F.lit(0)).alias("rank"))
    if limit is not None:
        seen = seen.where(F.col("rank") <= limit)
    seen = frontier = ws.write(seen, "seen")
    for d in range(1, depth + 1):
        reached = frontier.join(step, frontier.id == step.u).select(group, F.col("v").alias("id"), F.col("rank").alias("via"))
        fresh = reached.join(seen.select(group, "id"), [group, "id"], "left_anti").groupBy(group, "id").agg(F.min("via").alias("via"))
        if limit is None:
            ranked = fresh.select(group, "id", F.lit(d).alias("distance"), F.lit(0).alias("rank"))
        else:
            # The bound on the order lets every partition drop all but its first rows before the shuffle.
            sizes = seen.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
            near = fresh.withColumn("o", F.row_number().over(Window.partitionBy(group).orderBy("via", "id"))).where(F.col("o") <= limit)
            ranked = near.join(sizes, group).select(group, "id", F.lit(d).alias("distance"), (F.col("n") + F.col("o")).cast("int").alias("rank")).where(F.col("rank") <= limit)
        frontier = ws.write(ranked, "front")
        if frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier)
    return seen


def induced(edges: DataFrame, visited: DataFrame, kinds: list[str] | None = None, group: str = "seed") -> DataFrame:
    """(group, edge id): edges both of whose ends were visited by the same group."""
    e = edges if not kinds else edges.where(F.col("kind").isin(kinds))
    a = visited.select(group, F.col("id").alias("source_id"))
    b = visited.select(F.col(group).alias("g2"), F.col("id").alias("t2"))
    return e.join(a, "source_id").join(b, (F.col(group) == F.col("g2")) & (F.col("target_id") == F.col("t2"))).select(group, "id", "source_id", "target_id", "kind")


def central_nodes(members: DataFrame, deg: DataFrame, nodes: DataFrame, limit: int = 8, group: str = "component") -> DataFrame:
    """members (group, id): the limit nodes with the greatest 2 * in + out, then by qualified name and id."""
    j = members.join(deg, "id").join(nodes.select("id", "qualified_name", "path", "line"), "id")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(2 * F.col("in_degree") + F.col("out_degree")), F.coalesce("qualified_name", F.lit("")), "id"))
    return j.withColumn("position", rank).where(F.col("position") <= limit).select(group, "position", "id", "qualified_name", "in_degree", "out_degree")


def layers(edges: DataFrame) -> DataFrame:
    """(id, layer, cyclic): longest-path layers; what lies on or behind a cycle is cyclic.

    Peeling by counts: a node is in the next layer when as many of its predecessors are placed as it has. A round reads
    the edges of the nodes placed in the last one and the counts of the nodes they lead to; rounds end when nothing is
    free, so the number of layers is not bounded and nothing acyclic is called cyclic.

    Layers of cyclic nodes are the highest layer plus their rank by id.
    """
    ws = Workspace(edges.sparkSession, "layers")
    e = ws.write(edges.where("source_id <> target_id").select(F.col("source_id").alias("u"), F.col("target_id").alias("v")).distinct(), "edges")
    nodes = e.select(F.col("u").alias("id")).unionByName(e.select(F.col("v").alias("id"))).distinct()
    # Kahn's peeling with counts: a node is free when as many predecessors were freed as it has.
    need = ws.write(e.groupBy("v").agg(F.count(F.lit(1)).alias("need")), "need")
    front = ws.write(nodes.join(need.select(F.col("v").alias("id")), "id", "left_anti").select("id", F.lit(0).alias("layer")), "front")
    done, freed, layer = front, None, 0
    while not front.isEmpty():
        layer += 1
        hit = front.select(F.col("id").alias("u")).join(e, "u").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        # Counts of the nodes touched only; those that reach their need are the next layer.
        old = hit if freed is None else hit.unionByName(freed.join(hit.select("v"), "v", "left_semi").select("v", "n")).groupBy("v").agg(F.sum("n").alias("n"))
        now = ws.write(old.join(need, "v"), "now")
        front = now.where("n >= need").select(F.col("v").alias("id"), F.lit(layer).alias("layer"))
        part = now.where("n < need").select("v", "n")
        freed = ws.write(part if freed is None else freed.join(now.select("v"), "v", "left_anti").unionByName(part), "freed")
        done = done.unionByName(front)
    done = ws.write(done, "done")
    remaining = nodes.join(done.select("id"), "id", "left_anti")
    top = done.agg(F.coalesce(F.max("layer"), F.lit(-1)).alias("top"))
    numbered = running(remaining.withColumn("_all", F.lit("all")), "_all", ["id"])
    rest = numbered.crossJoin(top).select("id", (F.col("top") + F.col("position")).cast("int").alias("layer"), F.lit(True).alias("cyclic"))
    return done.withColumn("cyclic", F.lit(False)).unionByName(rest)
