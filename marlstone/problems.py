"""The general corpus problems (hierarchies, orphan references, snapshot changes) as queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.keys import clean_key, clean_path
from .operators.hierarchy import descendants, resolve_hierarchy
from .operators.orphans import OrphanTracker, span_number, spans
from .operators.snapshots import snapshot_changes
from .plans.session import table

#: Spans in which p3 feeds its state.
ORPHAN_SPANS = 3


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolve_hierarchy(table(spark, sf_dir, "symbols"), node="id", parent="parent_id", at="recorded_at")
    return r.select(F.col("id").alias("symbol_id"), F.col("root").alias("root_id"), "depth")


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolve_hierarchy(table(spark, sf_dir, "symbols"), node="id", parent="parent_id", at="recorded_at", with_path=True)
    return r.select(F.col("id").alias("symbol_id"), F.col("root").alias("root_id"), "depth", F.array_join("path", "/").alias("full_path"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolve_hierarchy(table(spark, sf_dir, "symbols"), node="id", parent="parent_id", at="recorded_at", with_path=True)
    return descendants(r)


def reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference of the tables: (ref_table, ref_field, ref_id, key, shown, at); key carries the name of its parent index."""
    ext = table(spark, sf_dir, "known_externals").select(clean_key("name").alias("ext")).where("ext is not null").distinct()
    rel = table(spark, sf_dir, "relationships").select(clean_key("id").alias("ref_id"), clean_key("target_id").alias("tid"), clean_key("target_name").alias("tname"), clean_key("project").alias("project"), "recorded_at")
    ev = table(spark, sf_dir, "evidence_items").select(clean_key("id").alias("ref_id"), clean_key("feature_id").alias("k"), "recorded_at")
    # Without an element there is no reference, but the row still tells a time.
    cap = table(spark, sf_dir, "capabilities").select(clean_key("id").alias("ref_id"), F.explode_outer("evidence_ids").alias("e"), "recorded_at").withColumn("k", clean_key("e"))
    key = lambda kind, *c: F.concat_ws("\u001f", F.lit(kind), *c)
    by_id = F.col("tid").isNotNull()
    name = F.when(~by_id, F.col("tname"))
    parts = [
        rel.select("ref_id", F.lit("relationships").alias("ref_table"), F.when(by_id, "target_id").otherwise("target_name").alias("ref_field"), F.coalesce("tid", name).alias("shown"),
                   F.when(by_id, key("id", "tid")).otherwise(key("name", "project", name)).alias("key"), "recorded_at"),
        ev.select("ref_id", F.lit("evidence_items").alias("ref_table"), F.lit("feature_id").alias("ref_field"), F.col("k").alias("shown"), key("feature", "k").alias("key"), "recorded_at"),
        cap.select("ref_id", F.lit("capabilities").alias("ref_table"), F.lit("evidence_ids").alias("ref_field"), F.col("k").alias("shown"), key("evidence", "k").alias("key"), "recorded_at"),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("ref_id is not null")
    # Repeated rows meet before the second shuffle; the time of a reference is the earliest row of its ref_id, whatever that row refers to.
    rows = rows.groupBy("ref_table", "ref_field", "ref_id", "key", "shown").agg(F.min("recorded_at").alias("t"))
    at = F.min("t").over(Window.partitionBy("ref_table", "ref_id"))
    rows = rows.withColumn("at", at).where("shown is not null and at is not null").drop("t")
    known = ext.select(F.lit("target_name").alias("ref_field"), F.col("ext").alias("shown"))
    return rows.join(known, ["ref_field", "shown"], "left_anti").select("ref_table", "ref_field", "ref_id", "key", "shown", "at")


def parent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every parent row: (key, recorded_at, deleted_at)."""
    key = lambda kind, *c: F.concat_ws("\u001f", F.lit(kind), *c)
    sym = table(spark, sf_dir, "symbols")
    sid, qn = clean_key("id"), clean_key("qualified_name")
    never = F.lit(None).cast("timestamp").alias("deleted_at")
    return (
        sym.where(sid.isNotNull()).select(key("id", sid).alias("key"), "recorded_at", "deleted_at")
        .unionByName(table(spark, sf_dir, "file_records").where(clean_key("id").isNotNull()).select(key("id", clean_key("id")).alias("key"), "recorded_at", never))
        .unionByName(sym.where(qn.isNotNull()).select(key("name", clean_key("project"), qn).alias("key"), "recorded_at", "deleted_at"))
        .unionByName(table(spark, sf_dir, "features").where(clean_key("id").isNotNull()).select(key("feature", clean_key("id")).alias("key"), "recorded_at", "deleted_at"))
        .unionByName(table(spark, sf_dir, "evidence_items").where(clean_key("id").isNotNull()).select(key("evidence", clean_key("id")).alias("key"), "recorded_at", "deleted_at"))
    )


def track(spark: SparkSession, sf_dir: str, n_spans: int = ORPHAN_SPANS) -> OrphanTracker:
    """The tables delivered to the state in spans of time; each step reads its own rows."""
    tracker = OrphanTracker(spark)
    refs = reference_rows(spark, sf_dir)
    cuts = spans(*[table(spark, sf_dir, t).select("recorded_at") for t in ("relationships", "evidence_items", "capabilities")], at="recorded_at", n=n_spans)
    refs = tracker.ws.write(refs.withColumn("span", span_number("at", cuts)), "refs", by="span")
    parents = tracker.ws.write(parent_rows(spark, sf_dir).where("recorded_at is not null").withColumn("span", span_number("recorded_at", cuts)), "parents", by="span")
    for k, span in enumerate(cuts):
        tracker.step(parents.where(F.col("span") == k).drop("span"), refs.where(F.col("span") == k).drop("span"), span)
    return tracker


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = track(spark, sf_dir).orphans()
    return found.select("ref_table", "ref_field", "ref_id", F.col("shown").alias("ref_key"), F.date_format("at", "yyyy-MM").alias("period")).distinct()


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans and all references per table, field and month."""
    t = track(spark, sf_dir)
    month = F.date_format("at", "yyyy-MM").alias("period")
    n = F.count(F.lit(1))
    orphans = t.orphans().groupBy("ref_table", "ref_field", month).agg(n.alias("orphans"))
    refs = t.references()
    return refs.groupBy("ref_table", "ref_field", month).agg(n.alias("refs")).join(orphans, ["ref_table", "ref_field", "period"], "left").select(
        "ref_table", "ref_field", "period", "refs", F.coalesce("orphans", F.lit(0)).cast("bigint").alias("orphans"))


def p3_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the end of every month: references made so far and those open then, per table."""
    return track(spark, sf_dir).open_counts()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = snapshot_changes(
        table(spark, sf_dir, "file_records").withColumns({"project": clean_key("project"), "commit": clean_key("commit")}),
        table(spark, sf_dir, "project_snapshots").withColumns({"name": clean_key("name"), "commit": clean_key("commit")}),
        owner="project", version="commit", key=clean_path("path"), digest=F.lower(F.trim("sha256")), delivered="recorded_at",
        snap_owner="name", snap_version="commit", snap_at="analyzed_at",
    )
    return c.select(F.col("owner").alias("project"), F.col("prev_version").alias("prev_commit"), F.col("version").alias("commit"), F.col("key").alias("path"), "change")


QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants, "p3_found": p3_found, "p3_counts": p3_counts, "p3_snapshots": p3_snapshots, "p6_found": p6_found}

_HELD = r"""
WITH RECURSIVE held AS (
  SELECT id, CASE WHEN parent IN (SELECT regexp_replace(id, '^\s+|\s+$', '', 'g') FROM symbols) THEN parent END AS parent FROM (
    SELECT regexp_replace(id, '^\s+|\s+$', '', 'g') AS id, nullif(regexp_replace(parent_id, '^\s+|\s+$', '', 'g'), '') AS parent,
           row_number() OVER (PARTITION BY regexp_replace(id, '^\s+|\s+$', '', 'g') ORDER BY recorded_at DESC, parent_id DESC NULLS LAST) AS rn
    FROM symbols WHERE regexp_replace(id, '^\s+|\s+$', '', 'g') <> '') WHERE rn = 1),
tree AS (
  SELECT id, id AS root, 0 AS depth, id AS path FROM held WHERE parent IS NULL
  UNION ALL
  SELECT h.id, t.root, t.depth + 1, t.path || '/' || h.id FROM held h JOIN tree t ON h.parent = t.id)
"""

_REFS = r"""
WITH rel AS (SELECT regexp_replace(id, '^\s+|\s+$', '', 'g') AS ref_id, nullif(regexp_replace(target_id, '^\s+|\s+$', '', 'g'), '') AS tid, nullif(regexp_replace(target_name, '^\s+|\s+$', '', 'g'), '') AS tname, project, recorded_at FROM relationships),
refs AS (
  SELECT 'relationships' AS ref_table, 'target_id' AS ref_field, ref_id, tid AS ref_key, NULL AS project FROM rel WHERE tid IS NOT NULL
  UNION SELECT 'relationships', 'target_name', ref_id, tname, project FROM rel WHERE tid IS NULL AND tname IS NOT NULL
    AND tname NOT IN (SELECT regexp_replace(name, '^\s+|\s+$', '', 'g') FROM known_externals WHERE name IS NOT NULL)
  UNION SELECT 'evidence_items', 'feature_id', regexp_replace(id, '^\s+|\s+$', '', 'g'), nullif(regexp_replace(feature_id, '^\s+|\s+$', '', 'g'), ''), NULL FROM evidence_items WHERE regexp_replace(feature_id, '^\s+|\s+$', '', 'g') <> ''
  UNION SELECT 'capabilities', 'evidence_ids', id, regexp_replace(e, '^\s+|\s+$', '', 'g'), NULL FROM (SELECT regexp_replace(id, '^\s+|\s+$', '', 'g') AS id, unnest(evidence_ids) AS e FROM capabilities) WHERE regexp_replace(e, '^\s+|\s+$', '', 'g') <> ''),
born AS (
  SELECT 'relationships' AS ref_table, ref_id, min(recorded_at) AS born_at FROM rel GROUP BY ref_id
  UNION ALL SELECT 'evidence_items', regexp_replace(id, '^\s+|\s+$', '', 'g'), min(recorded_at) FROM evidence_items GROUP BY 2
  UNION ALL SELECT 'capabilities', regexp_replace(id, '^\s+|\s+$', '', 'g'), min(recorded_at) FROM capabilities GROUP BY 2),
parents AS (
  SELECT 'target_id' AS ref_field, regexp_replace(id, '^\s+|\s+$', '', 'g') AS k, NULL AS project, recorded_at AS a, deleted_at AS b FROM symbols
  UNION SELECT 'target_id', regexp_replace(id, '^\s+|\s+$', '', 'g'), NULL, recorded_at, NULL FROM file_records
  UNION SELECT 'target_name', regexp_replace(qualified_name, '^\s+|\s+$', '', 'g'), project, recorded_at, deleted_at FROM symbols
  UNION SELECT 'feature_id', regexp_replace(id, '^\s+|\s+$', '', 'g'), NULL, recorded_at, deleted_at FROM features
  UNION SELECT 'evidence_ids', regexp_replace(id, '^\s+|\s+$', '', 'g'), NULL, recorded_at, deleted_at FROM evidence_items),
timed AS (SELECT r.*, b.born_at FROM refs r JOIN born b USING (ref_table, ref_id)),
orphan AS (
  SELECT t.* FROM timed t WHERE NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.ref_field = t.ref_field AND p.k = t.ref_key AND coalesce(p.project, '') = coalesce(t.project, '')
      AND p.a <= t.born_at AND (p.b IS NULL OR p.b > t.born_at)))
"""

SQL = {
    "p2_found": _HELD + "SELECT h.id AS symbol_id, coalesce(t.root, 'cycle') AS root_id, coalesce(t.depth, -1)::INT AS depth FROM held h LEFT JOIN tree t ON h.id = t.id",
    "p2_paths": _HELD + "SELECT h.id AS symbol_id, coalesce(t.root, 'cycle') AS root_id, coalesce(t.depth, -1)::INT AS depth, t.path AS full_path FROM held h LEFT JOIN tree t ON h.id = t.id",
    "p2_descendants": _HELD + r""", up AS (
  SELECT id AS descendant, parent AS ancestor, 1 AS distance FROM held WHERE parent IS NOT NULL AND id IN (SELECT id FROM tree)
  UNION ALL SELECT u.descendant, h.parent, u.distance + 1 FROM up u JOIN held h ON u.ancestor = h.id WHERE h.parent IS NOT NULL)
SELECT ancestor, descendant, distance FROM up""",
    "p3_found": _REFS + "SELECT DISTINCT ref_table, ref_field, ref_id, ref_key, strftime(born_at, '%Y-%m') AS period FROM orphan",
    "p3_counts": _REFS + r"""SELECT ref_table, ref_field, period, count(*) AS refs, count(*) FILTER (o) AS orphans FROM (
  SELECT t.ref_table, t.ref_field, strftime(t.born_at, '%Y-%m') AS period, (t.ref_table, t.ref_field, t.ref_id, t.ref_key) IN (SELECT (ref_table, ref_field, ref_id, ref_key) FROM orphan) AS o
  FROM timed t) GROUP BY ALL""",
    "p3_snapshots": _REFS + r""", mo AS (SELECT unnest(generate_series((SELECT date_trunc('month', min(born_at)) FROM timed), (SELECT date_trunc('month', max(born_at)) FROM timed), INTERVAL 1 MONTH))::TIMESTAMP AS m),
tab AS (SELECT DISTINCT ref_table FROM timed)
SELECT tab.ref_table, strftime(mo.m, '%Y-%m') AS period, count(t.ref_id) AS refs, count(t.ref_id) FILTER (NOT EXISTS (SELECT 1 FROM parents p WHERE p.ref_field = t.ref_field AND p.k = t.ref_key AND coalesce(p.project, '') = coalesce(t.project, '')
  AND p.a < mo.m + INTERVAL 1 MONTH AND (p.b IS NULL OR p.b >= mo.m + INTERVAL 1 MONTH))) AS open
FROM tab CROSS JOIN mo LEFT JOIN timed t ON t.ref_table = tab.ref_table AND t.born_at < mo.m + INTERVAL 1 MONTH GROUP BY ALL""",
    "p6_found": r"""
WITH snap AS (SELECT name AS project, commit, row_number() OVER (PARTITION BY name ORDER BY a, commit) AS i
  FROM (SELECT name, commit, min(analyzed_at) AS a FROM project_snapshots GROUP BY ALL)),
pairs AS (SELECT a.project, a.commit AS prev_commit, b.commit FROM snap a JOIN snap b ON a.project = b.project AND b.i = a.i + 1),
held AS (
  SELECT project, commit, path, sha FROM (
    SELECT project, commit, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS path, lower(regexp_replace(sha256, '^\s+|\s+$', '', 'g')) AS sha,
           row_number() OVER (PARTITION BY project, commit, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') ORDER BY recorded_at DESC, lower(regexp_replace(sha256, '^\s+|\s+$', '', 'g')) DESC NULLS LAST) AS rn
    FROM file_records) WHERE rn = 1),
old AS (SELECT p.*, h.path, h.sha FROM pairs p JOIN held h ON h.project = p.project AND h.commit = p.prev_commit),
new AS (SELECT p.*, h.path, h.sha FROM pairs p JOIN held h ON h.project = p.project AND h.commit = p.commit)
SELECT coalesce(n.project, o.project) AS project, coalesce(n.prev_commit, o.prev_commit) AS prev_commit, coalesce(n.commit, o.commit) AS commit,
       coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM old o FULL JOIN new n ON o.project = n.project AND o.prev_commit = n.prev_commit AND o.commit = n.commit AND o.path = n.path
WHERE o.path IS NULL OR n.path IS NULL OR o.sha IS DISTINCT FROM n.sha""",
}
