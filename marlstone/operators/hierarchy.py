"""Parent-child rows to full hierarchies: path, depth, root and descendants of every node, with cycles found.

Method: deterministic hash splitters cut the forest into short runs. Every node walks to its next splitter by pointer
doubling inside its run; the splitters form a reduced pointer graph about 1/k of the size, which is solved the same way
(roots absorb); node and splitter results are then put together. A walk that makes no more progress sits on or below a
cycle: among ordinary nodes a cycle without splitters, among splitters a cycle that holds some. Each round is one equi
join of the unfinished nodes with the pointers they stand on, so the work shrinks with every round and the number of
rounds is the logarithm of the longest run, whatever the depth. Hot parents are a skewed probe side, which adaptive
execution splits.

Nulls: rows with a null or empty id are ignored; a parent that is null, empty or unknown makes a root. Several rows of
one id: the latest by ``at`` holds, ties go to the greatest parent. Empty input gives no rows. A node that is its own
parent is a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import clean_key
from ..plans.session import Workspace

SPLITTER_EVERY = 8
CYCLE = "cycle"


def latest_parents(ws: Workspace, rows: DataFrame, node: str, parent: str, at: str) -> DataFrame:
    """(id, parent): one row per id, parent null where it names no id of the table."""
    held = (
        rows.select(clean_key(node).alias("id"), clean_key(parent).alias("parent"), F.col(at).alias("at"))
        .where("id is not null")
        .groupBy("id")
        .agg(F.max(F.struct("at", "parent"))["parent"].alias("parent"))
    )
    held = ws.write(held, "held")
    known = held.select(F.col("id").alias("known"))
    return held.join(known, held.parent == known.known, "left").select("id", F.col("known").alias("parent"))


def _walk(ws: Workspace, links: DataFrame, with_path: bool) -> tuple[DataFrame, DataFrame]:
    """links (id, ptr, dist, stop[, seg]): jump until ptr is a stop. Returns (done, stuck).

    A finished row is kept in the way of the walkers only while one of them stands before it: what a walker reaches later
    is pointed at by another walker now, so the rest can never be met again.
    """
    cols = ["id", "ptr", "dist"] + (["seg"] if with_path else [])
    links = ws.write(links.withColumnRenamed("stop", "halt").select(*cols, "halt"), "links", by="halt")
    done = [links.where("halt").select(*cols)]
    ahead, active = done[0], links.where("not halt").select(*cols)
    n = active.count()
    while n:
        # A pointer target that has stopped hands on its stop; an active one hands on where it stands itself.
        ahead = ws.write(ahead.join(active.select("ptr").distinct().withColumnRenamed("ptr", "id"), "id", "left_semi"), "ahead")
        hop = ahead.withColumn("stopped", F.lit(True)).unionByName(active.withColumn("stopped", F.lit(False))).select(
            F.col("id").alias("h_id"), F.col("ptr").alias("h_ptr"), F.col("dist").alias("h_dist"), "stopped", *([F.col("seg").alias("h_seg")] if with_path else [])
        )
        step = active.join(hop, active.ptr == hop.h_id).select(
            "id",
            F.col("h_ptr").alias("ptr"),
            (F.col("dist") + F.col("h_dist")).alias("dist"),
            *([F.concat("h_seg", "seg").alias("seg")] if with_path else []),
            F.col("stopped").alias("halt"),
        )
        step = ws.write(step, "walk", by="halt")
        fresh, active = step.where("halt").select(*cols), step.where("not halt").select(*cols)
        done.append(fresh)
        ahead = ahead.unionByName(fresh)
        left = active.count()
        if left == n:
            break
        n = left
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, active


def resolve_hierarchy(rows: DataFrame, *, node: str, parent: str, at: str, with_path: bool = False,
                      splitter_every: int = SPLITTER_EVERY) -> DataFrame:
    """(id, root, depth[, path]): root ``cycle`` and depth -1 on a circle or below one (path null).

    path lists the ids from the root to the node, both included.
    """
    spark = rows.sparkSession
    ws = Workspace(spark, "hierarchy")
    base = ws.write(latest_parents(ws, rows, node, parent, at), "base")
    is_root = F.col("parent").isNull()
    cut = lambda c: F.pmod(F.xxhash64(c), F.lit(splitter_every)) == 0
    roots = base.where(is_root).select(F.col("id").alias("root_id"))
    # A node whose parent is a splitter or a root stands at its splitter at once.
    linked = base.where(~is_root).join(roots, F.col("parent") == F.col("root_id"), "left").select(
        "id",
        F.col("parent").alias("ptr"),
        F.lit(1).cast("bigint").alias("dist"),
        (cut(F.col("parent")) | F.col("root_id").isNotNull()).alias("stop"),
        *([F.array("id").alias("seg")] if with_path else []),
    )
    linked = ws.write(linked, "linked")
    to_splitter, _ = _walk(ws, linked, with_path)
    # The reduced graph: the splitters, each pointing at its next splitter; a root absorbs.
    root_rows = roots.select(F.col("root_id"), F.lit(True).alias("is_root"))
    reduced = to_splitter.where(cut(F.col("id"))).join(root_rows, F.col("ptr") == F.col("root_id"), "left").select(
        "id", "ptr", "dist", F.coalesce("is_root", F.lit(False)).alias("stop"), *(["seg"] if with_path else [])
    )
    solved, _ = _walk(ws, reduced, with_path)
    tops = solved.select(F.col("id").alias("s_id"), F.col("ptr").alias("s_root"), F.col("dist").alias("s_depth"), *([F.col("seg").alias("s_seg")] if with_path else []))
    tops = tops.unionByName(roots.select(F.col("root_id").alias("s_id"), F.col("root_id").alias("s_root"), F.lit(0).cast("bigint").alias("s_depth"),
                                         *([F.array("root_id").alias("s_seg")] if with_path else [])))
    if with_path:
        # A solved splitter's own segments begin below its root.
        tops = tops.withColumn("s_seg", F.when(F.col("s_depth") == 0, F.col("s_seg")).otherwise(F.concat(F.array("s_root"), F.col("s_seg"))))
    placed = to_splitter.join(tops, to_splitter.ptr == tops.s_id).select(
        "id", F.col("s_root").alias("root"), (F.col("s_depth") + F.col("dist")).cast("int").alias("depth"),
        *([F.concat("s_seg", "seg").alias("path")] if with_path else []),
    )
    placed = placed.unionByName(roots.select(F.col("root_id").alias("id"), F.col("root_id").alias("root"), F.lit(0).alias("depth"),
                                             *([F.array("root_id").alias("path")] if with_path else [])))
    rest = base.select("id").join(placed.withColumnRenamed("id", "p_id"), F.col("id") == F.col("p_id"), "left")
    return rest.select(
        "id",
        F.coalesce("root", F.lit(CYCLE)).alias("root"),
        F.coalesce("depth", F.lit(-1)).cast("int").alias("depth"),
        *(["path"] if with_path else []),
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) from the paths of ``resolve_hierarchy(with_path=True)``; cycles have none."""
    return (
        resolved.where("path is not null")
        .select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("pos", "ancestor"))
        .where("ancestor <> descendant")
        .select("ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
    )
