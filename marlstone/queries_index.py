"""Queries over the index: aggregations, joins, rankings, set operations, evidence, validation and pipeline state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import K, P, Index, sql
from .functions import paths as fp
from .functions import text as ft
from .operators.digest import group_digest, group_digest_sql
from .operators.prefix import running
from .plans.session import Workspace
from .queries_functions import NAME, _arr, _list, _sid

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, d: f(Index(spark, d))
        if check is not None:
            SQL[name] = check
        return f

    return add


def top(df: DataFrame, group: list[str], order: list, n: int, name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)




def N():
    """Rows of a group."""
    return F.count(F.lit(1))


# -- scans --------------------------------------------------------------------------------------------------------------

#: Bytes of the largest file that is indexed.
MAX_FILE = 1_000_000
SKIP = f"CASE WHEN text IS NULL THEN 'unreadable' WHEN list_has_any(string_split(path, '/'), {_arr(fp.EXCLUDED_DIRS)}) THEN 'excluded_directory' WHEN strlen(text) > {MAX_FILE} THEN 'too_large' WHEN contains(text, chr(0)) THEN 'binary' WHEN lower(regexp_extract(path, '[^/]*$')) LIKE '%.min.%' THEN 'unsupported' ELSE 'indexed' END"


def skip_reason():
    parts = F.split("path", "/")
    return (
        F.when(F.col("text").isNull(), "unreadable").when(F.arrays_overlap(parts, F.array(*[F.lit(d) for d in fp.EXCLUDED_DIRS])), "excluded_directory")
        .when(F.octet_length("text") > MAX_FILE, "too_large").when(F.instr("text", "\0") > 0, "binary").when(F.lower(fp.base_name("path")).contains(".min."), "unsupported").otherwise("indexed")
    )


@query("src01_scan_counters", sql(f"SELECT project, {SKIP} AS reason, count(*) AS files FROM txt GROUP BY ALL"))
def _(x):
    return x.texts.groupBy("project", skip_reason().alias("reason")).agg(N().alias("files"))


#: Files and bytes at which a scan stops.
BUDGET_FILES, BUDGET_BYTES = 100_000, 1_000_000_000


@query("src02_scan_budget", sql(f"""r AS (SELECT project, path, id, size, row_number() OVER w AS position, sum(coalesce(size, 0)) OVER w AS running FROM fil WHERE project IS NOT NULL WINDOW w AS (PARTITION BY project ORDER BY path, id ROWS UNBOUNDED PRECEDING)),
stop AS (SELECT project, min(position) AS at FROM r WHERE position > {BUDGET_FILES} OR running > {BUDGET_BYTES} GROUP BY project)
SELECT r.id, r.position, r.running::BIGINT AS running_bytes FROM r LEFT JOIN stop s ON s.project = r.project WHERE s.at IS NULL OR r.position < s.at"""))
def _(x):
    f = x.files.where("project is not null").select("project", "path", "id", "size")
    r = running(f, "project", ["path", "id"], bytes=F.coalesce("size", F.lit(0)))
    stop = r.where((F.col("position") > BUDGET_FILES) | (F.col("running_bytes") > BUDGET_BYTES)).groupBy("project").agg(F.min("position").alias("at"))
    return r.join(stop, "project", "left").where("at is null or position < at").select("id", "position", F.col("running_bytes").cast("bigint").alias("running_bytes"))


MANIFEST_ROW = "path || chr(31) || id || chr(31) || coalesce(size, -1)::VARCHAR || chr(31) || coalesce(sha256, '')"


@query("src05_tree_manifest", sql(group_digest_sql("fil WHERE project IS NOT NULL", ["project"], MANIFEST_ROW, "manifest")))
def _(x):
    row = F.concat_ws("\u001f", "path", "id", F.coalesce("size", F.lit(-1)).cast("string"), F.coalesce("sha256", F.lit("")))
    return group_digest(x.files.where("project is not null"), ["project"], row, "manifest")


@query("src09_ordered_nodes", sql("SELECT id, row_number() OVER (PARTITION BY project ORDER BY path, line, id) AS position FROM node"))
def _(x):
    return running(x.nodes.select("project", "path", "line", "id"), "project", ["path", "line", "id"]).select("id", "position")


@query("ext17_declaration_overlap", sql("""a AS (SELECT project, name, count(*) AS n FROM sym WHERE analyzer LIKE 'python%' GROUP BY ALL), b AS (SELECT project, name, count(*) AS n FROM sym WHERE analyzer NOT LIKE 'python%' GROUP BY ALL)
SELECT project, coalesce(sum(least(a.n, b.n)), 0)::BIGINT AS common FROM a JOIN b USING (project, name) GROUP BY project"""))
def _(x):
    cols = ["project", "name"]
    py = x.symbols.where("analyzer like 'python%'").select(*cols)
    other = x.symbols.where("analyzer not like 'python%'").select(*cols)
    return py.intersectAll(other).groupBy("project").agg(N().alias("common"))


@query("ext18_spread_sample", sql("""o AS (SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY path) - 1 AS i, count(*) OVER (PARTITION BY project) AS n FROM (SELECT DISTINCT project, path FROM fil WHERE project IS NOT NULL))
SELECT DISTINCT project, path FROM o WHERE n <= 5 OR i IN (SELECT round_even(k * (o.n - 1) / 4.0, 0)::BIGINT FROM range(5) t(k))"""))
def _(x):
    d = running(x.files.where("project is not null").select("project", "path").distinct(), "project", ["path"])
    n = d.groupBy("project").agg(N().alias("n"))
    picks = n.select("project", "n", F.explode(F.array(*[F.bround(F.lit(k) * (F.col("n") - 1) / 4.0, 0).cast("bigint") for k in range(5)])).alias("pick")).distinct()
    few = d.join(n.where("n <= 5"), "project").select("project", "path")
    return d.join(picks.where("n > 5"), "project").where("position = pick + 1").select("project", "path").unionByName(few).distinct()


# -- aggregations -------------------------------------------------------------------------------------------------------

ENTRY = f"lower({NAME}) IN {_list(fp.ENTRYPOINT_NAMES)}"


@query("agg01_modules", sql(f"""s AS (SELECT file_id, count(*) AS n FROM sym GROUP BY 1)
SELECT f.project, f.module, {_sid('module', 'f.module')} AS id, count(*) AS file_count, coalesce(sum(s.n), 0)::BIGINT AS symbol_count, coalesce(string_agg(path, ',' ORDER BY path) FILTER (WHERE {ENTRY}), '') AS entrypoints,
  row_number() OVER (PARTITION BY f.project ORDER BY (f.module <> 'root'), coalesce(sum(s.n), 0) DESC, f.module) AS position
FROM fil f LEFT JOIN s ON s.file_id = f.id WHERE f.module IS NOT NULL GROUP BY f.project, f.module"""))
def modules(x):
    per = x.symbols.groupBy("file_id").agg(N().alias("n"))
    entry = F.lower(fp.base_name("path")).isin(fp.ENTRYPOINT_NAMES)
    m = x.files.where("module is not null").join(per, F.col("id") == F.col("file_id"), "left").groupBy("project", "module").agg(
        N().alias("file_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbol_count"), F.array_join(F.sort_array(F.collect_list(F.when(entry, F.col("path")))), ",").alias("entrypoints"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.col("module") != "root", F.desc("symbol_count"), "module"))
    return m.select("project", "module", ft.stable_id("module", "module").alias("id"), "file_count", "symbol_count", "entrypoints", rank.alias("position"))


@query("agg02_language_counts", sql("SELECT project, language, count(*) AS n, row_number() OVER (PARTITION BY project ORDER BY count(*) DESC, language) AS position FROM fil WHERE language IS NOT NULL GROUP BY project, language"))
def _(x):
    c = x.files.where("language is not null").groupBy("project", "language").agg(N().alias("n"))
    return c.withColumn("position", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("n"), "language")))


@query("agg03_confidence_histogram", sql("SELECT confidence, count(*) AS n FROM (SELECT confidence FROM sym UNION ALL SELECT confidence FROM rel) GROUP BY ALL"))
def _(x):
    return x.symbols.select("confidence").unionByName(x.relationships.select("confidence")).groupBy("confidence").agg(N().alias("n"))


@query("agg04_index_stats", sql("""SELECT (SELECT count(*) FROM fil) AS files, (SELECT sum(lines)::BIGINT FROM fil) AS lines, (SELECT sum(size)::BIGINT FROM fil) AS bytes, (SELECT count(*) FROM sym) AS symbols,
  (SELECT count(*) FROM rel) AS relationships, (SELECT count(*) FROM rel WHERE target_id IS NULL) AS unresolved, (SELECT count(*) FROM feat) AS features, (SELECT count(*) FROM ev) AS evidence"""))
def _(x):
    f = x.files.agg(N().alias("files"), F.sum("lines").alias("lines"), F.sum("size").alias("bytes"))
    r = x.relationships.agg(N().alias("relationships"), F.count_if(F.col("target_id").isNull()).alias("unresolved"))
    return f.join(x.symbols.agg(N().alias("symbols"))).join(r).join(x.features.agg(N().alias("features"))).join(x.evidence.agg(N().alias("evidence")))


LAST = """snaps AS (SELECT project, commit, row_number() OVER (PARTITION BY project ORDER BY a DESC, commit DESC) AS age FROM (SELECT name AS project, commit, min(analyzed_at) AS a FROM project_snapshots GROUP BY ALL)),
held AS (SELECT * EXCLUDE rn FROM (SELECT project, commit, """ + P("path") + """ AS path, lower(sha256) AS sha256, language, has_structural_analysis AS hs, structural_sha256 AS ss, row_number() OVER (PARTITION BY project, commit, """ + P("path") + """ ORDER BY recorded_at DESC, lower(sha256) DESC NULLS LAST) AS rn FROM file_records) WHERE rn = 1),
cur AS (SELECT h.* FROM held h JOIN snaps s USING (project, commit) WHERE age = 1), old AS (SELECT h.* FROM held h JOIN snaps s USING (project, commit) WHERE age = 2),
diffs AS (SELECT coalesce(c.project, o.project) AS project, coalesce(c.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN c.sha256 IS DISTINCT FROM o.sha256 THEN 'changed' ELSE 'unchanged' END AS status,
  c.language AS language, o.language AS old_language, c.hs AS hs, o.hs AS old_hs, c.ss AS ss, o.ss AS old_ss FROM cur c FULL JOIN old o ON c.project = o.project AND c.path = o.path
  WHERE coalesce(c.project, o.project) IN (SELECT project FROM old))"""


def last_two(x: Index) -> tuple[DataFrame, DataFrame]:
    """Rows of the last and of the last but one snapshot of every project."""
    snaps = x.raw("project_snapshots").groupBy(F.col("name").alias("project"), "commit").agg(F.min("analyzed_at").alias("a"))
    age = snaps.withColumn("age", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("a"), F.desc("commit")))).where("age <= 2").select("project", "commit", "age")
    path = F.regexp_replace(F.translate("path", "\\", "/"), r"^(\./)+", "")
    held = x.raw("file_records").join(age, ["project", "commit"]).groupBy("project", "age", path.alias("path")).agg(
        F.max(F.struct("recorded_at", F.lower("sha256").alias("sha256"), "language", F.col("has_structural_analysis").alias("hs"), F.col("structural_sha256").alias("ss"))).alias("r")).select("project", "age", "path", "r.sha256", "r.language", "r.hs", "r.ss")
    return held.where("age = 1").drop("age"), held.where("age = 2").drop("age")


def change_sets(x: Index) -> DataFrame:
    cur, old = last_two(x)
    old = Workspace(x.spark, "changes").write(old, "old")
    o = old.select(F.col("project").alias("op"), F.col("path").alias("opath"), F.col("sha256").alias("osha"), F.col("language").alias("old_language"), F.col("hs").alias("old_hs"), F.col("ss").alias("old_ss"))
    j = cur.join(o, (cur.project == o.op) & (cur.path == o.opath), "full").withColumns({"pj": F.coalesce("project", "op"), "pt": F.coalesce("path", "opath")})
    status = F.when(F.col("opath").isNull(), "added").when(F.col("path").isNull(), "deleted").when(~F.col("sha256").eqNullSafe(F.col("osha")), "changed").otherwise("unchanged")
    both = j.select(F.col("pj").alias("project"), F.col("pt").alias("path"), status.alias("status"), "language", "old_language", "hs", "old_hs", "ss", "old_ss")
    return both.join(old.select("project").distinct(), "project", "left_semi")


@query("agg09_change_sets", sql(LAST + " SELECT project, path, status FROM diffs"))
def _(x):
    return change_sets(x).select("project", "path", "status")


STRUCT_SQL = "status IN ('added', 'deleted') OR (status = 'changed' AND NOT (coalesce(language IN ('Python','JavaScript','TypeScript','Go'), false) AND language IS NOT DISTINCT FROM old_language AND coalesce(hs, false) AND coalesce(old_hs, false) AND ss IS NOT NULL AND old_ss IS NOT NULL AND ss = old_ss))"


@query("agg10_change_action", sql(LAST + f""", s AS (SELECT project, count(*) FILTER ({STRUCT_SQL}) AS structural, count(*) FILTER (status <> 'added') AS previous,
  list_sort(list(DISTINCT string_split(path, '/')[1]) FILTER (path LIKE '%/%' AND status <> 'added')) AS old_tops, list_sort(list(DISTINCT string_split(path, '/')[1]) FILTER (path LIKE '%/%' AND status <> 'deleted')) AS new_tops FROM diffs GROUP BY project)
SELECT project, structural, CASE WHEN structural = 0 THEN 'SKIP_GRAPH_UPDATE' WHEN structural > 30 OR (previous > 0 AND structural / previous > 0.5) THEN 'FULL_REINDEX' WHEN coalesce(old_tops, []) <> coalesce(new_tops, []) OR structural > 10 THEN 'REBUILD_ARCHITECTURE' ELSE 'PARTIAL_REINDEX' END AS action FROM s"""))
def _(x):
    proven = F.col("language").isin(fp.PRODUCT_LANGUAGES) & F.col("language").eqNullSafe(F.col("old_language")) & F.col("hs") & F.col("old_hs") & (F.col("ss") == F.col("old_ss"))
    structural = F.col("status").isin("added", "deleted") | ((F.col("status") == "changed") & ~F.coalesce(proven, F.lit(False)))
    tops = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1))
    s = change_sets(x).groupBy("project").agg(F.count_if(structural).alias("structural"), F.count_if(F.col("status") != "added").alias("previous"),
                                              F.sort_array(F.collect_set(F.when(F.col("status") != "added", tops))).alias("old_tops"), F.sort_array(F.collect_set(F.when(F.col("status") != "deleted", tops))).alias("new_tops"))
    n = F.col("structural")
    action = F.when(n == 0, "SKIP_GRAPH_UPDATE").when((n > 30) | ((F.col("previous") > 0) & (n / F.col("previous") > 0.5)), "FULL_REINDEX").when((F.col("old_tops") != F.col("new_tops")) | (n > 10), "REBUILD_ARCHITECTURE").otherwise("PARTIAL_REINDEX")
    return s.select("project", "structural", action.alias("action"))


@query("agg11_structural_signature", sql("""sg AS (SELECT project, path, string_agg(coalesce(qualified_name, '') || '|' || coalesce(kind, '') || '|' || coalesce(signature, '') || '|' || coalesce(exported, false)::VARCHAR, chr(30) ORDER BY coalesce(qualified_name, '') || '|' || coalesce(kind, '') || '|' || coalesce(signature, '') || '|' || coalesce(exported, false)::VARCHAR) AS s FROM sym GROUP BY ALL),
rg AS (SELECT r.project, r.path, string_agg(coalesce(s.qualified_name, '<file>') || '|' || r.kind || '|' || coalesce(r.target_name, ''), chr(30) ORDER BY coalesce(s.qualified_name, '<file>') || '|' || r.kind || '|' || coalesce(r.target_name, '')) AS s
  FROM rel r LEFT JOIN sym s ON s.id = r.source_id WHERE r.kind IN ('calls', 'import', 'contains') GROUP BY ALL)
SELECT project, path, sha256(coalesce(sg.s, '') || chr(29) || coalesce(rg.s, '')) AS signature FROM sg FULL JOIN rg USING (project, path)"""))
def _(x):
    line = F.concat_ws("|", F.coalesce("qualified_name", F.lit("")), F.coalesce("kind", F.lit("")), F.coalesce("signature", F.lit("")), F.coalesce("exported", F.lit(False)).cast("string"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_list(c)), "\u001e")
    s = x.symbols.groupBy("project", "path").agg(joined(line).alias("a"))
    names = x.symbols.select(F.col("id").alias("sid"), "qualified_name")
    r = x.relationships.where("kind in ('calls', 'import', 'contains')").join(names, F.col("source_id") == F.col("sid"), "left")
    r = r.groupBy("project", "path").agg(joined(F.concat_ws("|", F.coalesce("qualified_name", F.lit("<file>")), "kind", F.coalesce("target_name", F.lit("")))).alias("b"))
    return s.join(r, ["project", "path"], "full").select("project", "path", F.sha2(F.concat(F.coalesce("a", F.lit("")), F.lit("\u001d"), F.coalesce("b", F.lit(""))), 256).alias("signature"))


COVER = """e AS (SELECT feature_id, count(*) AS evidence, count(*) FILTER (path LIKE '%test%') AS tests FROM ev WHERE feature_id IS NOT NULL GROUP BY 1),
r AS (SELECT f.id, count(*) AS resolved FROM feat f JOIN rel x ON x.source_id = f.entry_symbol_id JOIN sym t ON t.id = x.target_id GROUP BY 1),
c AS (SELECT f.id, 20 * ((coalesce(f.entrypoint, '') <> '')::INT + (s.id IS NOT NULL)::INT + (coalesce(e.evidence, 0) > 0)::INT + (coalesce(e.tests, 0) > 0)::INT + (coalesce(r.resolved, 0) > 0)::INT) AS score
  FROM feat f LEFT JOIN sym s ON s.id = f.entry_symbol_id LEFT JOIN e ON e.feature_id = f.id LEFT JOIN r ON r.id = f.id)"""


def coverage(x: Index) -> DataFrame:
    e = x.evidence.where("feature_id is not null").groupBy(F.col("feature_id").alias("eid")).agg(N().alias("evidence"), F.count_if(F.col("path").contains("test")).alias("tests"))
    sid = x.symbols.select(F.col("id").alias("sid"))
    hits = x.relationships.join(sid, F.col("target_id") == F.col("sid"), "left_semi").groupBy(F.col("source_id").alias("rid")).agg(N().alias("resolved"))
    f = x.features.join(e, F.col("id") == F.col("eid"), "left").join(sid, F.col("entry_symbol_id") == F.col("sid"), "left").join(hits, F.col("entry_symbol_id") == F.col("rid"), "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    score = 20 * (flag(F.col("entrypoint") != "") + flag(F.col("sid").isNotNull()) + flag(F.col("evidence") > 0) + flag(F.col("tests") > 0) + flag(F.col("resolved") > 0))
    return f.select("id", "project", score.alias("score"))


@query("agg12_coverage", sql(COVER + " SELECT id, score, CASE WHEN score >= 80 THEN 'signals-present' WHEN score >= 40 THEN 'partial-signals' ELSE 'minimal-signals' END AS status FROM c"))
def _(x):
    return coverage(x).select("id", "score", F.when(F.col("score") >= 80, "signals-present").when(F.col("score") >= 40, "partial-signals").otherwise("minimal-signals").alias("status"))


@query("agg13_coverage_average", sql(COVER + " SELECT round_even(avg(score), 1) AS average FROM c"))
def _(x):
    return coverage(x).agg(F.bround(F.avg("score"), 1).alias("average"))


#: Keyword rules by which paths are matched (fixed values).
RULES = {
    "code-parsing": ("parser", "analyzer", "tree-sitter", "treesitter", "lsp", "scip", "indexer", "symbol"),
    "code-graph": ("graph_builder", "graph-builder", "call_graph", "call-graph", "knowledge_graph", "relation_edge"),
    "component-discovery": ("abstraction", "component", "cluster", "architecture", "feature_discovery", "identifyabstractions"),
    "tutorial-generation": ("tutorial", "write_chapters", "writechapters", "wiki", "chapter", "learning_path", "learning-path", "cliff_notes"),
    "evidence-grounding": ("evidence", "citation", "ground_citation", "source_reference", "sourcecodereference", "snippet"),
    "incremental-update": ("fingerprint", "incremental", "change_detector", "change-detector", "fingerprint_diff", "index-sync"),
    "codemap-visualization": ("codemap", "code_map", "code_tour", "code-tour", "tour_generator", "tour-generator", "diagram", "mermaid"),
    "agent-workflow": ("skill", "agent", "workflow", "orchestration", "task_registry", "taskregistry"),
}
RULE_VALUES = ", ".join(f"('{s}', '{w}')" for s, ws in RULES.items() for w in ws)
SCORED = f"""w(slug, kw) AS (VALUES {RULE_VALUES}),
hit AS (SELECT f.project, f.path, w.slug, 3 AS p, NULL AS sid FROM fil f JOIN w ON contains(replace(lower(f.path), ' ', '_'), kw) WHERE f.project IS NOT NULL
  UNION ALL SELECT s.project, s.path, w.slug, 5, s.id FROM sym s JOIN w ON contains(replace(lower(s.path), ' ', '_') || ' ' || replace(lower(s.name), ' ', '_') || ' ' || replace(lower(s.qualified_name), ' ', '_'), kw) WHERE s.project IS NOT NULL),
sc AS (SELECT project, slug, path, sum(p)::BIGINT AS score, row_number() OVER (PARTITION BY project, slug ORDER BY sum(p) DESC, path) AS position FROM hit GROUP BY project, slug, path)"""


def keyword_hits(x: Index) -> DataFrame:
    """(project, path, slug, points): three points a keyword in a path, five in a symbol's path and names."""

    def points(text, each):
        per = [F.struct(F.lit(s).alias("slug"), (sum((F.when(F.contains(text, F.lit(w)), each).otherwise(0) for w in ws), F.lit(0))).alias("points")) for s, ws in RULES.items()]
        return F.filter(F.array(*per), lambda r: r["points"] > 0)

    low = lambda c: F.translate(F.lower(c), " ", "_")
    f = x.files.where("project is not null").select("project", "path", F.explode(points(low("path"), 3)).alias("r"))
    s = x.symbols.where("project is not null").select("project", "path", F.explode(points(F.concat_ws(" ", low("path"), low("name"), low("qualified_name")), 5)).alias("r"))
    return f.unionByName(s).select("project", "path", "r.slug", "r.points")


def keyword_paths(x: Index) -> DataFrame:
    sc = keyword_hits(x).groupBy("project", "slug", "path").agg(F.sum("points").alias("score"))
    return top(sc, ["project", "slug"], [F.desc("score"), "path"], 8)


@query("agg14_keyword_paths", sql(SCORED + " SELECT project, slug, path, score, position FROM sc WHERE position <= 8"))
def _(x):
    return keyword_paths(x)


DIMS = ["semantic_precision", "evidence_traceability", "tutorial_quality", "incremental_efficiency", "visualization", "production_readiness", "reuse_value"]
#: Weights of the dimensions by capability and by scenario (fixed values).
WEIGHTS = {
    "code-parsing": [0.32, 0.20, 0, 0.10, 0, 0.20, 0.18], "code-graph": [0.25, 0.25, 0, 0.05, 0.10, 0.15, 0.20], "component-discovery": [0.25, 0.20, 0.15, 0.05, 0, 0.15, 0.20],
    "tutorial-generation": [0, 0.25, 0.30, 0, 0.10, 0.15, 0.20], "evidence-grounding": [0.20, 0.40, 0, 0, 0, 0.20, 0.20], "incremental-update": [0.05, 0.15, 0, 0.40, 0, 0.20, 0.20],
    "codemap-visualization": [0, 0.20, 0.15, 0, 0.40, 0.10, 0.15], "agent-workflow": [0.15, 0.15, 0.10, 0.10, 0, 0.25, 0.25],
}
SCENARIOS = {
    "precise-static-analysis": [0.30, 0.25, 0, 0.15, 0.05, 0.15, 0.10], "local-first-product": [0.10, 0.10, 0.05, 0.20, 0.05, 0.25, 0.25],
    "teaching-experience": [0.10, 0.25, 0.30, 0, 0.20, 0.05, 0.10], "dynamic-agent-runtime": [0.10, 0.20, 0.10, 0.10, 0, 0.25, 0.25],
}
OPTION_SQL = SCORED + f""", best AS (SELECT * FROM sc WHERE position <= 8),
ex AS (SELECT b.project, b.slug, count(*) AS n FROM best b JOIN sym s ON s.project = b.project AND s.path = b.path WHERE s.confidence = 'exact' GROUP BY ALL),
pt AS (SELECT project, slug, count(*) AS p, count(*) FILTER (lower(path) LIKE '%test%') AS t FROM best GROUP BY ALL),
o AS (SELECT project, slug, p, t, coalesce(n, 0) AS s, least(100, 35 + least(30, p * 4) + least(25, coalesce(n, 0) * 3) + least(10, t * 5)) AS score, least(75, 30 + coalesce(n, 0) * 5) AS semantic_precision, least(75, 30 + coalesce(n, 0) * 4 + p * 2) AS evidence_traceability,
  35 AS tutorial_quality, 30 AS incremental_efficiency, 35 AS visualization, least(70, 35 + t * 8) AS production_readiness, least(70, 35 + p * 3) AS reuse_value FROM pt LEFT JOIN ex USING (project, slug))"""


def options(x: Index) -> DataFrame:
    """(project, slug, p, t, s, score, the seven dimensions): one option per project and capability with any path."""
    best = Workspace(x.spark, "options").write(keyword_paths(x), "best")
    ex = best.join(x.symbols.where("confidence = 'exact'").select("project", "path"), ["project", "path"]).groupBy("project", "slug").agg(N().alias("s"))
    o = best.groupBy("project", "slug").agg(N().alias("p"), F.count_if(F.lower("path").contains("test")).alias("t")).join(ex, ["project", "slug"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    c, cap = F.col, lambda top_, e: F.least(F.lit(top_), e)
    return o.withColumns({
        "score": cap(100, 35 + cap(30, c("p") * 4) + cap(25, c("s") * 3) + cap(10, c("t") * 5)), "semantic_precision": cap(75, 30 + c("s") * 5), "evidence_traceability": cap(75, 30 + c("s") * 4 + c("p") * 2),
        "tutorial_quality": F.lit(35), "incremental_efficiency": F.lit(30), "visualization": F.lit(35), "production_readiness": cap(70, 35 + c("t") * 8), "reuse_value": cap(70, 35 + c("p") * 3)})


def weighted(weights: list[float]):
    return F.bround(sum((F.col(d) * F.lit(w) for d, w in zip(DIMS, weights) if w), F.lit(0.0)), 0).cast("int")


def _weighted_sql(weights: list[float]) -> str:
    return "round_even(" + " + ".join(["0.0::DOUBLE", *[f"{d}::DOUBLE * {w}::DOUBLE" for d, w in zip(DIMS, weights) if w]]) + ", 0)::INT"


@query("agg15_weighted_score", sql(OPTION_SQL + " SELECT project, slug, CASE slug " + " ".join(f"WHEN '{s}' THEN {_weighted_sql(w)}" for s, w in WEIGHTS.items()) + " END AS weighted FROM o"))
def _(x):
    e = F.lit(None).cast("int")
    for s, w in WEIGHTS.items():
        e = F.when(F.col("slug") == s, weighted(w)).otherwise(e)
    return options(x).select("project", "slug", e.alias("weighted"))


@query("agg16_scenario_scores", sql(OPTION_SQL + " SELECT project, slug, " + ", ".join(f"{_weighted_sql(w)} AS {s.replace('-', '_')}" for s, w in SCENARIOS.items()) + " FROM o"))
def _(x):
    return options(x).select("project", "slug", *[weighted(w).alias(s.replace("-", "_")) for s, w in SCENARIOS.items()])


@query("agg17_option_score", sql(OPTION_SQL + " SELECT project, slug, p::BIGINT AS paths, s::BIGINT AS exact_symbols, t::BIGINT AS tests, score::BIGINT AS score FROM o"))
def _(x):
    return options(x).select("project", "slug", F.col("p").alias("paths"), F.col("s").alias("exact_symbols"), F.col("t").alias("tests"), F.col("score").cast("bigint").alias("score"))


@query("agg18_rubric_level", sql(OPTION_SQL + " SELECT project, slug, (SELECT l FROM (VALUES (0), (25), (50), (75), (100)) v(l) ORDER BY abs(l - score), -l LIMIT 1) AS level FROM o"))
def _(x):
    levels = F.array(*[F.struct(F.abs(F.lit(v) - F.col("score")).alias("d"), F.lit(-v).alias("n")) for v in (0, 25, 50, 75, 100)])
    return options(x).select("project", "slug", (-F.array_min(levels)["n"]).alias("level"))


@query("rank07_co_winners", sql(OPTION_SQL + " SELECT slug, project, score::BIGINT AS score FROM (SELECT *, max(score) OVER (PARTITION BY slug) AS best FROM o) WHERE best - score <= 15"))
def _(x):
    o = Workspace(x.spark, "options").write(options(x), "options")
    best = o.groupBy("slug").agg(F.max("score").alias("best"))
    return o.join(best, "slug").where("best - score <= 15").select("slug", "project", F.col("score").cast("bigint").alias("score"))


@query("rank08_scenario_choice", sql(OPTION_SQL + f" SELECT slug, project, v FROM (SELECT slug, project, {_weighted_sql(SCENARIOS['local-first-product'])} AS v, row_number() OVER (PARTITION BY slug ORDER BY {_weighted_sql(SCENARIOS['local-first-product'])} DESC, project) AS rn FROM o) WHERE rn <= 2"))
def _(x):
    o = options(x).select("slug", "project", weighted(SCENARIOS["local-first-product"]).alias("v"))
    return top(o, ["slug"], [F.desc("v"), "project"], 2).select("slug", "project", "v")


@query("agg19_relationship_quality", sql("SELECT project, count(target_id) AS resolved, count(*) - count(target_id) AS unresolved, round_even(count(target_id) / count(*), 3) AS ratio FROM rel GROUP BY project"))
def _(x):
    r, n = F.count("target_id"), N()
    return x.relationships.groupBy("project").agg(r.alias("resolved"), (n - r).alias("unresolved"), F.bround(r / n, 3).alias("ratio"))


@query("agg20_record_digest", sql("""SELECT project, path, sha256(string_agg(line, chr(30) ORDER BY line)) AS digest, count(*) AS records FROM (
  SELECT project, path, 's' || id || '|' || coalesce(qualified_name, '') || '|' || coalesce(kind, '') || '|' || coalesce(line, 0)::VARCHAR AS line FROM sym UNION ALL
  SELECT project, path, 'r' || id || '|' || coalesce(target_name, '') || '|' || coalesce(kind, '') || '|' || coalesce(line, 0)::VARCHAR FROM rel) GROUP BY project, path"""))
def _(x):
    row = lambda p, n: F.concat(F.lit(p), F.concat_ws("|", "id", F.coalesce(n, F.lit("")), F.coalesce("kind", F.lit("")), F.coalesce("line", F.lit(0)).cast("string"))).alias("line")
    rows = x.symbols.select("project", "path", row("s", "qualified_name")).unionByName(x.relationships.select("project", "path", row("r", "target_name")))
    return rows.groupBy("project", "path").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\u001e"), 256).alias("digest"), N().alias("records"))


@query("agg21_resolution_stats", sql("SELECT analyzer, count(*) FILTER (kind = 'calls' AND target_id IS NOT NULL) AS calls_resolved, count(*) FILTER (kind = 'calls' AND target_id IS NULL) AS calls_unresolved, count(*) FILTER (kind = 'import' AND target_id IS NOT NULL) AS imports_resolved, count(*) FILTER (kind = 'import' AND target_id IS NULL) AS imports_unresolved FROM rel GROUP BY ALL"))
def _(x):
    c = lambda k, hit: F.count_if((F.col("kind") == k) & (F.col("target_id").isNotNull() if hit else F.col("target_id").isNull()))
    return x.relationships.groupBy("analyzer").agg(c("calls", True).alias("calls_resolved"), c("calls", False).alias("calls_unresolved"), c("import", True).alias("imports_resolved"), c("import", False).alias("imports_unresolved"))


@query("agg22_duplicate_ids", f"SELECT 'symbols' AS source, {K('id')} AS id, count(*) AS n FROM symbols GROUP BY 2 HAVING count(*) > 1 AND {K('id')} IS NOT NULL UNION ALL SELECT 'relationships', {K('id')}, count(*) FROM relationships GROUP BY 2 HAVING count(*) > 1 AND {K('id')} IS NOT NULL")
def _(x):
    from .functions.keys import clean_key

    d = lambda t: x.raw(t).groupBy(clean_key("id").alias("id")).agg(N().alias("n")).where("n > 1 and id is not null").select(F.lit(t).alias("source"), "id", "n")
    return d("symbols").unionByName(d("relationships"))


@query("agg23_stage_durations", """SELECT user_id, event_type, count(*) AS attempts, round(epoch(max(ts)) - epoch(min(ts)), 6) AS seconds, row_number() OVER (PARTITION BY user_id ORDER BY round(epoch(max(ts)) - epoch(min(ts)), 6) DESC, event_type) AS rank FROM events GROUP BY user_id, event_type""")
def _(x):
    e = x.raw("events").withColumn("u", F.unix_micros(F.col("ts").cast("timestamp"))).groupBy("user_id", "event_type").agg(N().alias("attempts"), F.round((F.max("u") - F.min("u")) / 1e6, 6).alias("seconds"))
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("seconds"), "event_type")))


@query("agg24_call_rollup", "SELECT event_type, count(*) AS calls, count(*) FILTER (value IS NOT NULL AND value > 0) AS positive, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def _(x):
    return x.raw("events").groupBy("event_type").agg(N().alias("calls"), F.count_if(F.col("value") > 0).alias("positive"), F.round(F.sum("value"), 4).alias("total"))


@query("agg25_dispositions", sql("""m AS (SELECT id, unnest(implementation_modules) AS m FROM cap), p AS (SELECT m.path AS path, id, CASE m.classification WHEN 'core' THEN 2 WHEN 'supporting' THEN 1 ELSE 0 END AS prio FROM m WHERE m.path IS NOT NULL)
SELECT path, max(prio) AS priority, string_agg(DISTINCT id, ',' ORDER BY id) AS members FROM p GROUP BY path"""))
def _(x):
    m = x.capabilities.select("id", F.explode("implementation_modules").alias("m")).where("m.path is not null")
    prio = F.when(F.col("m.classification") == "core", 2).when(F.col("m.classification") == "supporting", 1).otherwise(0)
    return m.groupBy(F.col("m.path").alias("path")).agg(F.max(prio).alias("priority"), F.array_join(F.sort_array(F.collect_set("id")), ",").alias("members"))


@query("agg26_bundle_hash", sql(group_digest_sql("fil WHERE module IS NOT NULL AND project IS NOT NULL", ["project", "module"], "path || chr(0) || coalesce(sha256, '') || chr(0) || id", "bundle")))
def _(x):
    return group_digest(x.files.where("module is not null and project is not null"), ["project", "module"], F.concat_ws("\0", "path", F.coalesce("sha256", F.lit("")), "id"), "bundle")
