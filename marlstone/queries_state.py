"""Queries of validation, contracts and pipeline state."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import Index, sql
from .functions.text import canonical_digest
from .operators.digest import group_digest, group_digest_sql
from .operators.validate import RELATIONSHIP_KINDS, SYMBOL_KINDS, rejection, validate_index
from .queries_functions import _list, _sid
from .queries_index import LAST, N, change_sets
from .streaming.incremental import stage_journal

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, d: f(Index(spark, d))
        if check is not None:
            SQL[name] = check
        return f

    return add


_ISSUES = {
    "unsafe-path": "SELECT id FROM fil WHERE path IS NULL OR path LIKE '/%' OR list_contains(string_split(path, '/'), '..')",
    "unstable-file-id": f"SELECT id FROM fil WHERE id <> {_sid('file', 'path')}",
    "malformed-symbol-id": "SELECT id FROM sym WHERE NOT regexp_full_match(id, 'symbol_[0-9a-f]{16}')",
    "unsupported-symbol-analyzer": "SELECT id FROM sym WHERE NOT coalesce(analyzer IN ('python-ast', 'javascript-regex') OR analyzer LIKE 'go-%', false)",
    "unsupported-symbol-kind": f"SELECT id FROM sym WHERE NOT coalesce(kind IN {_list(SYMBOL_KINDS)}, false)",
    "dangling-file-ref": "SELECT s.id FROM sym s WHERE NOT EXISTS (SELECT 1 FROM fil f WHERE f.id = s.file_id AND f.path = s.path)",
    "invalid-symbol-range": "SELECT s.id FROM sym s JOIN fil f ON f.id = s.file_id WHERE s.line IS NULL OR s.end_line IS NULL OR s.line < 1 OR s.end_line < s.line OR s.end_line > coalesce(f.lines, 0)",
    "dangling-parent-ref": "SELECT s.id FROM sym s WHERE s.parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sym p WHERE p.id = s.parent_id AND p.path = s.path)",
    "malformed-relationship-id": "SELECT id FROM rel WHERE NOT regexp_full_match(id, 'rel_[0-9a-f]{16}')",
    "unsupported-relationship-kind": f"SELECT id FROM rel WHERE NOT coalesce(kind IN {_list(RELATIONSHIP_KINDS)}, false)",
    "dangling-source-ref": "SELECT id FROM rel r WHERE NOT EXISTS (SELECT 1 FROM node n WHERE n.id = r.source_id)",
    "relationship-path-mismatch": "SELECT r.id FROM rel r JOIN node n ON n.id = r.source_id WHERE r.path IS DISTINCT FROM n.path",
    "dangling-target-ref": "SELECT id FROM rel r WHERE target_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM node n WHERE n.id = r.target_id)",
    "missing-relationship-target": "SELECT id FROM rel WHERE coalesce(target_name, '') = ''",
    "invalid-relationship-range": "SELECT r.id FROM rel r LEFT JOIN fil f ON f.project = r.project AND f.path = r.path WHERE f.lines IS NULL OR r.line IS NULL OR r.line < 1 OR r.line > f.lines",
    "relationship-target-kind-mismatch": "SELECT r.id FROM rel r JOIN node n ON n.id = r.target_id AND n.kind = 'file' WHERE r.kind IN ('calls', 'contains', 'receiver-type')",
    "evidence-digest-malformed": "SELECT id FROM ev WHERE NOT coalesce(regexp_full_match(lower(sha256), '[0-9a-f]{64}'), false)",
    "invalid-evidence-range": "SELECT id FROM ev WHERE line_start IS NULL OR line_end IS NULL OR line_start < 1 OR line_end < line_start",
    "dangling-evidence-feature": "SELECT id FROM ev WHERE feature_id IS NOT NULL AND feature_id NOT IN (SELECT id FROM feat)",
    "dangling-entry-symbol": "SELECT id FROM feat WHERE entry_symbol_id IS NOT NULL AND entry_symbol_id NOT IN (SELECT id FROM sym)",
    "feature-without-evidence": "SELECT id FROM feat f WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.feature_id = f.id)",
    "empty-capability": "SELECT id FROM cap WHERE coalesce(len(source_feature_ids), 0) <= 0",
}
_WARN = {"dangling-evidence-feature", "dangling-entry-symbol", "feature-without-evidence", "empty-capability"}
ISSUES_SQL = "issues AS (" + "\n UNION ALL ".join(f"SELECT '{'warning' if c in _WARN else 'error'}' AS severity, '{c}' AS code, id AS entity_id FROM ({q})" for c, q in _ISSUES.items()) + ")"


@query("val01_issues", sql(ISSUES_SQL + " SELECT * FROM issues"))
def _(x):
    return validate_index(x)


@query("val02_issue_counts", sql(ISSUES_SQL + " SELECT severity, code, count(*) AS n FROM issues GROUP BY ALL"))
def _(x):
    return validate_index(x).groupBy("severity", "code").agg(N().alias("n"))


CLAIM_ROW = """sha256('{"kind":"' || kind || '","line":' || line::VARCHAR || ',"name":"' || name || '"}')"""


@query("val03_claim_digest", sql(group_digest_sql("sym", ["project"], CLAIM_ROW)))
def _(x):
    return group_digest(x.symbols, ["project"], canonical_digest("kind", "line", "name"))


@query("val04_reuse_rejection", sql(ISSUES_SQL + """, own AS (SELECT id, project FROM fil UNION SELECT id, project FROM sym UNION SELECT id, project FROM rel),
o(code, o) AS (VALUES """ + ", ".join(f"('{c}', {i})" for i, c in enumerate(_ISSUES)) + """)
SELECT project, min_by(i.code, o.o) AS reason FROM issues i JOIN own ON own.id = i.entity_id JOIN o ON o.code = i.code WHERE severity = 'error' GROUP BY project"""))
def _(x):
    return rejection(x)


@query("val05_static_claims", sql("SELECT f.id FROM feat f JOIN sym s ON s.id = f.entry_symbol_id WHERE f.entrypoint IS DISTINCT FROM s.qualified_name"))
def _(x):
    s = x.symbols.select(F.col("id").alias("entry_symbol_id"), "qualified_name")
    return x.features.join(s, "entry_symbol_id").where("entrypoint is distinct from qualified_name").select("id")


@query("val06_export_closure", sql("SELECT 'missing' AS problem, s.file_id AS id FROM sym s WHERE s.file_id IS NOT NULL AND s.file_id NOT IN (SELECT id FROM fil) GROUP BY 2 UNION ALL SELECT 'unreferenced', f.id FROM fil f WHERE NOT EXISTS (SELECT 1 FROM sym s WHERE s.file_id = f.id)"))
def _(x):
    used = x.symbols.where("file_id is not null").select(F.col("file_id").alias("id")).distinct()
    files = x.files.select("id")
    return used.join(files, "id", "left_anti").select(F.lit("missing").alias("problem"), "id").unionByName(files.join(used, "id", "left_anti").select(F.lit("unreferenced").alias("problem"), "id"))


@query("val07_inventory_contract", sql("""SELECT id, 'missing-title' AS problem FROM cap WHERE coalesce(trim(title), '') = '' UNION ALL SELECT id, 'unknown-importance' FROM cap WHERE NOT coalesce(importance IN ('core-journey', 'supporting', 'foundational'), false)
UNION ALL SELECT id, 'no-evidence' FROM cap WHERE coalesce(len(list_filter(evidence_ids, lambda e: e IS NOT NULL AND trim(e) <> '')), 0) = 0"""))
def _(x):
    c = x.capabilities
    real = F.filter("evidence_ids", lambda e: e.isNotNull() & (F.trim(e) != ""))
    p = lambda cond, name: c.where(cond).select("id", F.lit(name).alias("problem"))
    return p(F.coalesce(F.trim("title"), F.lit("")) == "", "missing-title").unionByName(p(~F.coalesce(F.col("importance").isin("core-journey", "supporting", "foundational"), F.lit(False)), "unknown-importance")).unionByName(
        p(F.col("evidence_ids").isNull() | (F.size(real) == 0), "no-evidence"))


@query("val08_source_quality", sql("SELECT feature_id, count(*) AS refs, count(*) FILTER (NOT (path LIKE '%.md' OR path LIKE '%.rst')) AS code_refs, count(*) >= 3 AND count(*) FILTER (NOT (path LIKE '%.md' OR path LIKE '%.rst')) >= 1 AS ok FROM ev WHERE feature_id IS NOT NULL AND path IS NOT NULL GROUP BY feature_id"))
def _(x):
    code = F.count_if(~F.col("path").rlike(r"\.(md|rst)$"))
    return x.evidence.where("feature_id is not null and path is not null").groupBy("feature_id").agg(N().alias("refs"), code.alias("code_refs"), ((N() >= 3) & (code >= 1)).alias("ok"))


@query("val09_catalog_schema", "SELECT source, count(*) AS rows, count(*) FILTER (target_share > 0 AND target_share <= 1 AND max_repeats >= 1) AS valid FROM mix_targets GROUP BY source")
def _(x):
    return x.raw("mix_targets").groupBy("source").agg(N().alias("rows"), F.count_if((F.col("target_share") > 0) & (F.col("target_share") <= 1) & (F.col("max_repeats") >= 1)).alias("valid"))


@query("val10_review_consistency", sql("SELECT c.id, count(*) AS members, count(f.id) AS known, count(*) = count(f.id) AS complete FROM (SELECT id, unnest(source_feature_ids) AS m FROM cap) c LEFT JOIN feat f ON f.id = c.m GROUP BY c.id"))
def _(x):
    c = x.capabilities.select("id", F.explode("source_feature_ids").alias("m")).join(x.features.select(F.col("id").alias("m"), F.lit(1).alias("hit")), "m", "left")
    return c.groupBy("id").agg(N().alias("members"), F.count("hit").alias("known"), (N() == F.count("hit")).alias("complete"))


@query("val11_confidence_supported", sql("SELECT f.id, coalesce(bool_or(e.id IS NOT NULL AND e.symbol IS NOT NULL), false) AS supported FROM feat f LEFT JOIN ev e ON e.feature_id = f.id GROUP BY f.id"))
def _(x):
    e = x.evidence.where("feature_id is not null").groupBy(F.col("feature_id").alias("id")).agg(F.bool_or(F.col("symbol").isNotNull()).alias("s"))
    return x.features.select("id").join(e, "id", "left").select("id", F.coalesce("s", F.lit(False)).alias("supported"))


@query("val12_module_index", sql("SELECT project, path FROM (SELECT DISTINCT c.project, m.path FROM (SELECT project, unnest(implementation_modules) AS m FROM cap) c) u WHERE path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fil f WHERE f.project = u.project AND (f.path = u.path OR starts_with(f.path, u.path || '/')))"))
def _(x):
    from .operators.resolve import prefixes

    m = x.capabilities.select("project", F.explode("implementation_modules").alias("m")).where("m.path is not null").select("project", F.col("m.path").alias("path")).distinct()
    there = x.files.select("project", F.explode(prefixes(F.col("path"), "/")).alias("path")).distinct()
    return m.join(there, ["project", "path"], "left_anti")


@query("inc01_reuse_plan", sql(LAST + " SELECT project, path, status = 'unchanged' AS reuse FROM diffs WHERE status <> 'deleted'"))
def _(x):
    return change_sets(x).where("status <> 'deleted'").select("project", "path", (F.col("status") == "unchanged").alias("reuse"))


@query("inc02_cleared_targets", sql("SELECT id, CASE WHEN kind IN ('calls', 'import') THEN NULL ELSE target_id END AS target_id FROM rel"))
def _(x):
    return x.relationships.select("id", F.when(~F.coalesce(F.col("kind").isin("calls", "import"), F.lit(False)), F.col("target_id")).alias("target_id"))


@query("inc05_journal", "SELECT user_id AS run, event_type AS stage, count(*) AS attempts, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1, 2")
def _(x):
    e = x.raw("events").select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), F.lit("done").alias("status"), F.col("ts").alias("at"))
    return stage_journal(e).drop("status")


@query("inc06_stage_ledger", "WITH s AS (SELECT user_id AS run, event_type AS stage, max(ts) AS at FROM events GROUP BY 1, 2), st AS (SELECT DISTINCT event_type AS stage FROM events), r AS (SELECT DISTINCT user_id AS run FROM events) SELECT r.run, st.stage, CASE WHEN s.at IS NULL THEN 'pending' ELSE 'complete' END AS status FROM r CROSS JOIN st LEFT JOIN s ON s.run = r.run AND s.stage = st.stage")
def _(x):
    e = x.raw("events").select(F.col("user_id").alias("run"), F.col("event_type").alias("stage")).distinct()
    # The stages of a pipeline are a handful: they are folded into one array and exploded beside every run.
    stages = e.select("stage").distinct().agg(F.collect_set("stage").alias("stages"))
    runs = e.groupBy("run").agg(F.collect_set("stage").alias("done"))
    return runs.join(F.broadcast(stages)).select("run", "done", F.explode("stages").alias("stage")).select("run", "stage", F.when(F.array_contains("done", F.col("stage")), "complete").otherwise("pending").alias("status"))


@query("inc07_stability", "SELECT name, count(DISTINCT (branch, dirty, remote)) = 1 AS stable FROM project_snapshots GROUP BY name")
def _(x):
    key = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("~")).alias(c) for c in ("branch", "dirty", "remote")])
    return x.raw("project_snapshots").groupBy("name").agg((F.count_distinct(key) == 1).alias("stable"))


@query("snk05_stable_json", sql("""SELECT '{"id":"' || id || '","kind":"' || kind || '","line":' || line::VARCHAR || '}' AS json FROM sym"""))
def _(x):
    from .sources.sinks import json_lines

    return json_lines(x.symbols.select("line", "kind", "id"))
