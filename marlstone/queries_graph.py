"""Queries of the graph operators and the joins and rankings around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import Index, sql
from .functions.paths import preferred_label, view_category
from .functions.text import split_tokens
from .operators import graph as g
from .operators.digest import group_digest_sql
from .plans.session import Workspace
from .queries_functions import CATEGORY, LABEL, TOKENS

QUERIES: dict = {}
SQL: dict[str, str] = {}
STATE_TOKENS = ["state", "store", "storage", "repo", "repository", "db", "database", "cache", "memory", "session", "queue", "index", "record"]
SEED_KINDS = ["http-route", "cli-command", "entrypoint", "entrypoint-candidate", "capability-source-audited", "capability-role-slice"]
#: Budget of a feature slice.
SLICE_DEPTH, SLICE_NODES = 4, 180


def query(name: str, check: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, d: f(Index(spark, d))
        if check is not None:
            SQL[name] = check
        return f

    return add


def _lit_list(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def top(df: DataFrame, group: list[str], order: list, n: int, name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)


CC = """two AS (SELECT source_id AS a, target_id AS b FROM edge UNION SELECT target_id, source_id FROM edge),
cc(id, component) USING KEY (id) AS (
  SELECT a, a FROM two UNION
  SELECT two.a, min(cc.component) FROM cc JOIN two ON cc.id = two.b JOIN recurring.cc AS r ON r.id = two.a WHERE cc.component < r.component GROUP BY two.a)
"""
DEG = "deg AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT source_id AS id, 0 AS i, 1 AS o FROM (SELECT DISTINCT source_id, target_id FROM edge) UNION ALL SELECT target_id, 1, 0 FROM (SELECT DISTINCT source_id, target_id FROM edge)) GROUP BY id)"
SEEDS = "seeds AS (SELECT f.id AS seed, f.entry_symbol_id AS id FROM feat f WHERE f.entry_symbol_id IN (SELECT source_id FROM edge UNION SELECT target_id FROM edge))"


#: Nodes a traversal visits at most, for one seed.
VISITS = 80


def queue(pairs: str, depth: int, limit: int = VISITS, name: str = "seen") -> str:
    """SQL: a bounded breadth-first visit of every seed in queue order, level by level; ``name`` (seed, id, distance, rank)."""
    p = f"{name}_"
    out = f"""{p}step AS (SELECT DISTINCT * FROM ({pairs})),
{p}s0 AS (SELECT * FROM (SELECT seed, id, 0 AS distance, row_number() OVER (PARTITION BY seed ORDER BY id) AS rank FROM (SELECT DISTINCT seed, id FROM seeds)) WHERE rank <= {limit}), {p}r0 AS (SELECT * FROM {p}s0)"""
    for d in range(1, depth + 1):
        out += f""",
{p}f{d} AS (SELECT w.seed, t.v AS id, min(w.rank) AS via FROM {p}r{d - 1} w JOIN {p}step t ON w.id = t.u WHERE (w.seed, t.v) NOT IN (SELECT (seed, id) FROM {p}s{d - 1}) GROUP BY ALL),
{p}r{d} AS (SELECT * FROM (SELECT f.seed, f.id, {d} AS distance, n.n + row_number() OVER (PARTITION BY f.seed ORDER BY via, f.id) AS rank FROM {p}f{d} f JOIN (SELECT seed, count(*) AS n FROM {p}s{d - 1} GROUP BY seed) n ON n.seed = f.seed) WHERE rank <= {limit}),
{p}s{d} AS (SELECT * FROM {p}s{d - 1} UNION ALL SELECT * FROM {p}r{d})"""
    return out + f""",
{name} AS (SELECT seed, id, distance, rank::INT AS rank FROM {p}s{depth})
"""


FWD = "SELECT source_id AS u, target_id AS v FROM edge"
REV = "SELECT target_id AS u, source_id AS v FROM edge"
CALLS = f" WHERE kind IN {_lit_list(g.CALL_KINDS)}"


def _entry_seeds(x: Index, edges: DataFrame) -> DataFrame:
    """Features and the node each starts from, where it is a node of the graph (its written edges)."""
    ends = edges.select(F.col("source_id").alias("id")).unionByName(edges.select(F.col("target_id").alias("id"))).distinct()
    return x.features.select(F.col("id").alias("seed"), F.col("entry_symbol_id").alias("id")).join(ends, "id", "left_semi").select("seed", "id")


def _graph(x: Index) -> tuple[DataFrame, Workspace]:
    """The resolved edges, written once for the rounds that read them."""
    ws = Workspace(x.spark, "graph")
    return ws.write(x.edges, "edges"), ws


@query("join08_resolved_edges", sql("SELECT id, source_id, target_id, kind, path, line, confidence FROM edge"))
def _(x):
    return x.edges.select("id", "source_id", "target_id", "kind", "path", "line", "confidence")


@query("join08_unresolved_edges", sql("SELECT id, source_id, target_name, kind, path, line, confidence FROM rel WHERE target_id IS NULL AND source_id IS NOT NULL"))
def _(x):
    return x.relationships.where("target_id is null and source_id is not null").select("id", "source_id", "target_name", "kind", "path", "line", "confidence")


@query("join08_dangling_edges", sql("SELECT id FROM rel WHERE target_id IS NOT NULL AND source_id IS NOT NULL AND id NOT IN (SELECT id FROM edge)"))
def _(x):
    return x.relationships.where("target_id is not null and source_id is not null").join(x.edges.select("id"), "id", "left_anti").select("id")


@query("agg05_module_dependencies", sql("""m AS (SELECT n.id, coalesce(f.module, 'root') AS module FROM node n LEFT JOIN fil f ON n.file_id = f.id)
SELECT a.module AS source, b.module AS target, e.kind, count(*) AS n FROM edge e JOIN m a ON e.source_id = a.id JOIN m b ON e.target_id = b.id WHERE a.module <> b.module GROUP BY ALL"""))
def module_dependencies(x):
    m = x.nodes.select("id", "file_id").join(x.files.select(F.col("id").alias("f"), "module"), F.col("file_id") == F.col("f"), "left").select("id", F.coalesce("module", F.lit("root")).alias("module"))
    e = x.edges.join(m.select(F.col("id").alias("source_id"), F.col("module").alias("source")), "source_id").join(m.select(F.col("id").alias("target_id"), F.col("module").alias("target")), "target_id")
    return e.where("source <> target").groupBy("source", "target", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("agg06_degrees", sql(DEG + " SELECT * FROM deg"))
def _(x):
    return g.degrees(x.edges)


@query("graph01_summary", sql(CC + """SELECT (SELECT count(DISTINCT id) FROM cc) AS nodes, (SELECT count(*) FROM edge) AS resolved_edges,
  (SELECT count(*) FROM rel WHERE target_id IS NULL AND source_id IS NOT NULL) AS unresolved_edges, (SELECT count(DISTINCT component) FROM cc) AS components"""))
def _(x):
    edges, _ = _graph(x)
    comp = g.components(edges)
    return (
        comp.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("component").alias("components"))
        .join(edges.agg(F.count(F.lit(1)).alias("resolved_edges")))
        .join(x.relationships.where("target_id is null and source_id is not null").agg(F.count(F.lit(1)).alias("unresolved_edges")))
    )


@query("graph02_components", sql(CC + "SELECT id, component FROM cc"))
def _(x):
    return g.components(_graph(x)[0])


@query("graph02_component_records", sql(CC + """, dg AS (""" + group_digest_sql('cc', ['component'], 'id') + """)
SELECT component, 'graph-component_' || substr(digest, 1, 16) AS component_id, rows AS node_count, (SELECT count(*) FROM edge e JOIN cc c2 ON e.source_id = c2.id WHERE c2.component = dg.component) AS edge_count,
  row_number() OVER (ORDER BY rows DESC, component) AS position FROM dg QUALIFY position <= 120"""))
def _(x):
    edges, _ = _graph(x)
    return g.component_records(edges, g.components(edges), 120)


@query("agg07_primary_areas", sql(CC + """SELECT component, position, area FROM (
  SELECT component, string_split(coalesce(n.path, ''), '/')[1] AS area, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, min(cc.id)) AS position
  FROM cc JOIN node n ON n.id = cc.id GROUP BY component, area) WHERE position <= 5 AND area <> ''"""))
def _(x):
    comp = g.components(_graph(x)[0])
    areas = comp.join(x.nodes.select("id", F.substring_index(F.coalesce("path", F.lit("")), "/", 1).alias("area")), "id").groupBy("component", "area").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return top(areas, ["component"], [F.desc("n"), "first"], 5).where("area <> ''").select("component", "position", "area")


@query("rank01_central_nodes", sql(CC + ", " + DEG + """ SELECT component, position, id, qualified_name, in_degree, out_degree FROM (
  SELECT cc.component, cc.id, n.qualified_name, d.in_degree, d.out_degree, row_number() OVER (PARTITION BY component ORDER BY 2 * d.in_degree + d.out_degree DESC, coalesce(n.qualified_name, ''), cc.id) AS position
  FROM cc JOIN deg d ON d.id = cc.id JOIN node n ON n.id = cc.id) WHERE position <= 8"""))
def _(x):
    edges, _ = _graph(x)
    return g.central_nodes(g.components(edges), g.degrees(edges), x.nodes)


def _visit(x: Index, direction: str, kinds: list[str] | None = None) -> DataFrame:
    edges, _ = _graph(x)
    return g.traverse(edges, _entry_seeds(x, edges), direction=direction, depth=2, limit=VISITS, kinds=kinds).select("seed", "id", "distance", "rank")


@query("graph03_traverse_both", sql(SEEDS + ", " + queue(FWD + " UNION ALL " + REV, 2) + "SELECT seed, id, distance, rank FROM seen"))
def _(x):
    return _visit(x, "both")


@query("graph03_induced_edges", sql(SEEDS + ", " + queue(FWD + " UNION ALL " + REV, 1) + "SELECT a.seed, e.id, e.source_id, e.target_id, e.kind FROM edge e JOIN seen a ON a.id = e.source_id JOIN seen b ON b.id = e.target_id AND b.seed = a.seed"))
def _(x):
    edges, _ = _graph(x)
    return g.induced(edges, g.traverse(edges, _entry_seeds(x, edges), direction="both", depth=1, limit=VISITS))


@query("graph05_callers", sql(SEEDS + ", " + queue(REV + CALLS, 2) + "SELECT seed, id, distance, rank FROM seen WHERE distance > 0"))
def _(x):
    return _visit(x, "reverse", g.CALL_KINDS).where("distance > 0")


@query("graph06_callees", sql(SEEDS + ", " + queue(FWD + CALLS, 2) + "SELECT seed, id, distance, rank FROM seen WHERE distance > 0"))
def _(x):
    return _visit(x, "forward", g.CALL_KINDS).where("distance > 0")


IMPACT_SQL = (SEEDS + ", " + queue(FWD, 2, name="down") + ", " + queue(REV, 2, name="up") + f"""
SELECT s.seed, e.source_id AS id, 'direct-caller' AS impact FROM seeds s JOIN edge e ON e.target_id = s.id WHERE e.kind IN {_lit_list(g.IMPACT_KINDS)}
UNION SELECT s.seed, e.target_id, 'direct-callee' FROM seeds s JOIN edge e ON e.source_id = s.id WHERE e.kind IN {_lit_list(g.IMPACT_KINDS)}
UNION SELECT seed, id, 'indirect' FROM (SELECT * FROM down UNION ALL SELECT * FROM up) WHERE distance > 1 AND (seed, id) NOT IN (SELECT (seed, id) FROM seeds)""")


@query("graph07_impact", sql(IMPACT_SQL))
def _(x):
    edges, ws = _graph(x)
    seeds = ws.write(_entry_seeds(x, edges), "seeds")
    calls = edges.where(F.col("kind").isin(g.IMPACT_KINDS))
    callers = seeds.join(calls, seeds.id == calls.target_id).select("seed", F.col("source_id").alias("id"), F.lit("direct-caller").alias("impact"))
    callees = seeds.join(calls, seeds.id == calls.source_id).select("seed", F.col("target_id").alias("id"), F.lit("direct-callee").alias("impact"))
    far = [g.traverse(edges, seeds, direction=d, depth=2, limit=VISITS).where("distance > 1").select("seed", "id") for d in ("forward", "reverse")]
    indirect = far[0].unionByName(far[1]).join(seeds, ["seed", "id"], "left_anti").withColumn("impact", F.lit("indirect"))
    return callers.unionByName(callees).unionByName(indirect).distinct()


@query("graph08_dependency_view", sql("""m AS (SELECT n.id, coalesce(f.module, 'root') AS module FROM node n LEFT JOIN fil f ON n.file_id = f.id)
SELECT * FROM (SELECT a.module AS source, b.module AS target, e.kind, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, a.module, b.module, e.kind) AS position
FROM edge e JOIN m a ON e.source_id = a.id JOIN m b ON e.target_id = b.id WHERE a.module <> b.module AND (a.module IN ('src', 'tests') OR b.module IN ('src', 'tests')) GROUP BY a.module, b.module, e.kind) WHERE position <= 120"""))
def _(x):
    d = module_dependencies(x).where("source in ('src', 'tests') or target in ('src', 'tests')")
    return g.first(d, [F.desc("n"), F.asc("source"), F.asc("target"), F.asc("kind")], 120)


EXPLORE = "ledger"


@query("graph09_explore", sql(f"""seeds AS (SELECT 'q' AS seed, id FROM node WHERE id IN (SELECT source_id FROM edge UNION SELECT target_id FROM edge)
  AND (lower(name) LIKE '%{EXPLORE}%' OR lower(qualified_name) LIKE '%{EXPLORE}%' OR lower(path) LIKE '%{EXPLORE}%') ORDER BY id LIMIT 20),
""" + queue(FWD + " UNION ALL " + REV, 1) + "SELECT s.id, s.distance, n.qualified_name, n.path FROM seen s JOIN node n ON n.id = s.id"))
def _(x):
    edges, _ = _graph(x)
    ends = edges.select(F.col("source_id").alias("id")).unionByName(edges.select(F.col("target_id").alias("id"))).distinct()
    hit = x.nodes.where(F.lower("name").contains(EXPLORE) | F.lower("qualified_name").contains(EXPLORE) | F.lower("path").contains(EXPLORE)).join(ends, "id", "left_semi")
    seeds = hit.select("id").orderBy("id").limit(20).withColumn("seed", F.lit("q"))
    seen = g.traverse(edges, seeds, direction="both", depth=1, limit=VISITS)
    return seen.join(x.nodes.select("id", "qualified_name", "path"), "id").select("id", "distance", "qualified_name", "path")


DOMAIN_SQL = f"""scoped AS (SELECT * FROM node WHERE (path = 'src' OR path LIKE 'src/%' OR path = 'packages' OR path LIKE 'packages/%') AND {CATEGORY} = 'product-implementation'),
inner_edges AS (SELECT * FROM edge WHERE source_id IN (SELECT id FROM scoped) AND target_id IN (SELECT id FROM scoped)),
d AS (SELECT s.id, s.path, s.line, s.qualified_name, (SELECT count(*) FROM inner_edges e WHERE e.source_id = s.id) + (SELECT count(*) FROM inner_edges e WHERE e.target_id = s.id) AS degree FROM scoped s),
tp AS (SELECT path FROM (SELECT path, row_number() OVER (ORDER BY sum(degree) DESC, path) AS rn FROM d GROUP BY path) WHERE rn <= 40),
tn AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY degree DESC, path, line, id) AS position FROM d WHERE path IN (SELECT path FROM tp)) WHERE position <= 160)"""


def domain_slice(x: Index) -> tuple[DataFrame, DataFrame]:
    """Top nodes by edge count on the top paths of a scope, and the edges inside the scope."""
    scoped = x.nodes.where((F.col("path").startswith("src/") | F.col("path").startswith("packages/")) & (view_category("path") == "product-implementation"))
    ids = scoped.select("id")
    inner = x.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    deg = inner.select(F.col("source_id").alias("id")).unionByName(inner.select(F.col("target_id").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    d = scoped.join(deg, "id", "left").select("id", "path", "line", "qualified_name", F.coalesce("degree", F.lit(0)).alias("degree"))
    paths = d.groupBy("path").agg(F.sum("degree").alias("w")).orderBy(F.desc("w"), "path").limit(40).select("path")
    nodes = g.first(d.join(paths, "path", "left_semi"), [F.desc("degree"), F.asc("path"), F.asc("line"), F.asc("id")], 160)
    return nodes, inner


@query("graph10_domain_nodes", sql(DOMAIN_SQL + " SELECT position, id, qualified_name, path, degree FROM tn"))
def _(x):
    return domain_slice(x)[0].select("position", "id", "qualified_name", "path", "degree")


@query("graph10_domain_edges", sql(DOMAIN_SQL + """ SELECT * FROM (SELECT e.id, e.kind, a.qualified_name AS source, b.qualified_name AS target, row_number() OVER (ORDER BY a.degree + b.degree DESC, e.id) AS position
  FROM inner_edges e JOIN tn a ON a.id = e.source_id JOIN tn b ON b.id = e.target_id) WHERE position <= 240"""))
def _(x):
    nodes, inner = domain_slice(x)
    nodes = Workspace(x.spark, "domain").write(nodes, "nodes")
    a = nodes.select(F.col("id").alias("source_id"), F.col("qualified_name").alias("source"), F.col("degree").alias("da"))
    b = nodes.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("target"), F.col("degree").alias("db"))
    e = inner.join(a, "source_id").join(b, "target_id")
    return g.first(e.withColumn("d", F.col("da") + F.col("db")), [F.desc("d"), F.asc("id")], 240).select("id", "kind", "source", "target", "position")


@query("graph11_scope_filter", sql("SELECT e.id FROM edge e JOIN node a ON a.id = e.source_id JOIN node b ON b.id = e.target_id WHERE a.path LIKE 'src/%' AND b.path LIKE 'src/%'"))
def _(x):
    inside = x.nodes.where(F.col("path").startswith("src/")).select("id")
    return x.edges.join(inside.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(inside.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("id")


@query("graph12_graph_only_paths", sql("""used AS (SELECT source_id AS id FROM edge UNION SELECT target_id FROM edge)
SELECT n.project, n.path, min(n.line) AS line_start, max(n.end_line) AS line_end FROM node n JOIN used u ON u.id = n.id
WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.project = n.project AND ev.path = n.path) AND n.path IS NOT NULL AND n.project IS NOT NULL GROUP BY n.project, n.path"""))
def _(x):
    ends = x.edges.select(F.col("source_id").alias("id")).unionByName(x.edges.select(F.col("target_id").alias("id"))).distinct()
    n = x.nodes.join(ends, "id", "left_semi").where("path is not null and project is not null").join(x.evidence.select("project", "path").distinct(), ["project", "path"], "left_anti")
    return n.groupBy("project", "path").agg(F.min("line").alias("line_start"), F.max("end_line").alias("line_end"))


def _path_edges(x: Index) -> DataFrame:
    """File-to-file edges by project and path."""
    at = x.nodes.select("id", F.concat_ws(":", "project", "path").alias("p"))
    e = x.edges.where("kind in ('calls', 'import', 'references', 'inherits', 'implements')")
    return e.join(at.select(F.col("id").alias("source_id"), F.col("p").alias("sp")), "source_id").join(at.select(F.col("id").alias("target_id"), F.col("p").alias("tp")), "target_id").select(
        F.col("sp").alias("source_id"), F.col("tp").alias("target_id")).distinct()


@query("graph13_layers")
def _(x):
    return g.layers(_path_edges(x))


@query("graph14_surface_components", sql("""surface AS (SELECT DISTINCT project || ':' || path AS id FROM fil WHERE path LIKE '%/graph/%' AND project IS NOT NULL),
pe AS (SELECT DISTINCT a.project || ':' || a.path AS u, b.project || ':' || b.path AS v FROM edge e JOIN node a ON a.id = e.source_id JOIN node b ON b.id = e.target_id
  WHERE e.kind IN ('calls', 'import', 'references', 'inherits', 'implements')),
two AS (SELECT u AS a, v AS b FROM pe WHERE u IN (SELECT id FROM surface) AND v IN (SELECT id FROM surface) UNION SELECT v, u FROM pe WHERE u IN (SELECT id FROM surface) AND v IN (SELECT id FROM surface)
  UNION SELECT id, id FROM surface),
cc(id, component) USING KEY (id) AS (SELECT a, a FROM two UNION
  SELECT two.a, min(cc.component) FROM cc JOIN two ON cc.id = two.b JOIN recurring.cc AS r ON r.id = two.a WHERE cc.component < r.component GROUP BY two.a)
SELECT id, component FROM cc"""))
def _(x):
    ws = Workspace(x.spark, "surface")
    surface = ws.write(x.files.where("path like '%/graph/%' and project is not null").select(F.concat_ws(":", "project", "path").alias("id")).distinct(), "paths")
    e = _path_edges(x).join(surface.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(surface.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return g.components(e.where("source_id <> target_id"), surface)


@query("graph15_direct_path", sql("""starts AS (SELECT f.id AS feature, s.id AS start FROM feat f JOIN sym s ON s.id = f.entry_symbol_id),
hops AS (SELECT feature, target_id AS id, min(struct_pack(a := r.line, b := r.target_name, c := r.id)) AS k FROM starts JOIN rel r ON r.source_id = start AND r.kind = 'calls' JOIN sym t ON t.id = r.target_id WHERE t.id <> start GROUP BY feature, target_id)
SELECT feature, 1 AS step, start AS symbol_id FROM starts UNION ALL SELECT * FROM (SELECT feature, 1 + row_number() OVER (PARTITION BY feature ORDER BY k.a, k.b, k.c) AS step, id FROM hops) WHERE step <= 8"""))
def _(x):
    ids = x.symbols.select(F.col("id").alias("sid"))
    starts = x.features.join(ids, F.col("entry_symbol_id") == F.col("sid")).select(F.col("id").alias("feature"), F.col("sid").alias("start"))
    calls = x.relationships.where("kind = 'calls'").join(ids.withColumnRenamed("sid", "target_id"), "target_id", "left_semi").select("source_id", "target_id", "line", "target_name", F.col("id").alias("rid"))
    hops = starts.join(calls, (F.col("start") == F.col("source_id")) & (F.col("target_id") != F.col("start"))).groupBy("feature", "target_id").agg(F.min(F.struct("line", "target_name", "rid")).alias("k"))
    later = top(hops, ["feature"], ["k.line", "k.target_name", "k.rid"], 7, "n").select("feature", (F.col("n") + 1).alias("step"), F.col("target_id").alias("symbol_id"))
    return starts.select("feature", F.lit(1).alias("step"), F.col("start").alias("symbol_id")).unionByName(later)


def slices(x: Index, edges: DataFrame) -> DataFrame:
    """(seed, id, distance, rank): the slice of every feature within its depth and node budget."""
    return g.traverse(edges, _entry_seeds(x, edges), direction="both", depth=SLICE_DEPTH, limit=SLICE_NODES)


@query("graph04_feature_slices", sql(SEEDS + ", " + queue(FWD + " UNION ALL " + REV, SLICE_DEPTH, SLICE_NODES) + "SELECT seed, id, distance, rank FROM seen"))
def _(x):
    return slices(x, _graph(x)[0]).select("seed", "id", "distance", "rank")


SLICE = SEEDS + ", " + queue(FWD + " UNION ALL " + REV, SLICE_DEPTH, SLICE_NODES)
STATE = f"len(list_filter({TOKENS('''coalesce(n.qualified_name, '') || ' ' || coalesce(n.path, '') || ' ' || coalesce(n.symbol_kind, '')''')}, lambda x: x IN {_lit_list(STATE_TOKENS)}))"


def state_nodes(x: Index, seen: DataFrame, n: int) -> DataFrame:
    """(seed, id, score, position): the n visited nodes of a seed that speak most of state."""
    score = x.nodes.select("id", F.size(F.filter(split_tokens(F.concat_ws(" ", "qualified_name", "path", "symbol_kind")), lambda t: t.isin(STATE_TOKENS))).alias("score")).where("score > 0")
    return top(seen.select("seed", "id").join(score, "id"), ["seed"], [F.desc("score"), "id"], n)


def prompt_projection(x: Index, seen: DataFrame) -> DataFrame:
    n = Workspace(x.spark, "shown").write(seen.select("seed", "id", "distance").join(x.nodes.select("id", preferred_label("path").alias("label")), "id"), "nodes")
    ordered = top(n, ["seed"], ["distance", "id"], 12).groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("position", "id", "label"))).alias("l"))
    return ordered.join(n.groupBy("seed").agg(F.count(F.lit(1)).alias("nodes")), "seed").select("seed", "nodes", F.array_join("l.id", ",").alias("first_nodes"), F.array_join("l.label", ",").alias("labels"))


def candidate_steps(x: Index, seen: DataFrame) -> DataFrame:
    seen = Workspace(x.spark, "steps").write(seen, "seen")
    first = top(seen, ["seed"], ["distance", "id"], 3)
    state = state_nodes(x, seen, 2).join(first.select("seed", "id"), ["seed", "id"], "left_anti")
    return first.select("seed", F.when(F.col("position") == 1, "trigger").otherwise("core").alias("role"), "id").unionByName(state.select("seed", F.lit("state").alias("role"), "id"))


@query("rank02_state_nodes", sql(SLICE + f"SELECT seed, position, id, score FROM (SELECT s.seed, n.id, {STATE} AS score, row_number() OVER (PARTITION BY seed ORDER BY {STATE} DESC, n.id) AS position FROM seen s JOIN node n ON n.id = s.id WHERE {STATE} > 0) WHERE position <= 4"))
def slice_state_nodes(x):
    return state_nodes(x, slices(x, _graph(x)[0]), 4).select("seed", "position", "id", "score")


@query("rank03_key_edges", sql(SLICE + f"SELECT seed, position, id FROM (SELECT a.seed, e.id, row_number() OVER (PARTITION BY a.seed ORDER BY e.id) AS position FROM edge e JOIN seen a ON a.id = e.source_id JOIN seen b ON b.id = e.target_id AND b.seed = a.seed WHERE e.kind IN {_lit_list(g.IMPACT_KINDS)}) WHERE position <= 4"))
def slice_key_edges(x):
    edges, _ = _graph(x)
    return top(g.induced(edges, slices(x, edges), g.IMPACT_KINDS), ["seed"], ["id"], 4).select("seed", "position", "id")


@query("graph16_prompt_projection", sql(SLICE + f""", ranked AS (SELECT s.seed, n.id, {LABEL.replace('path', 'n.path')} AS label, row_number() OVER (PARTITION BY s.seed ORDER BY s.distance, n.id) AS position, count(*) OVER (PARTITION BY s.seed) AS nodes FROM seen s JOIN node n ON n.id = s.id)
SELECT seed, any_value(nodes) AS nodes, string_agg(id, ',' ORDER BY position) AS first_nodes, string_agg(label, ',' ORDER BY position) AS labels FROM ranked WHERE position <= 12 GROUP BY seed"""))
def slice_projection(x):
    return prompt_projection(x, slices(x, _graph(x)[0]))


@query("graph17_candidate_steps", sql(SLICE + f""", ordered AS (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY distance, id) AS pos FROM seen),
st AS (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY score DESC, id) AS r FROM (SELECT s.seed, n.id, {STATE} AS score FROM seen s JOIN node n ON n.id = s.id) WHERE score > 0)
SELECT seed, CASE WHEN pos = 1 THEN 'trigger' ELSE 'core' END AS role, id FROM ordered WHERE pos <= 3
UNION ALL SELECT st.seed, 'state', st.id FROM st WHERE r <= 2 AND NOT EXISTS (SELECT 1 FROM ordered o WHERE o.seed = st.seed AND o.id = st.id AND o.pos <= 3)"""))
def slice_steps(x):
    return candidate_steps(x, slices(x, _graph(x)[0]))


@query("graph18_scope_feedback", sql("""item AS (SELECT f.id, s.path FROM feat f LEFT JOIN sym s ON s.id = f.entry_symbol_id),
direct AS (SELECT id FROM item WHERE path LIKE 'src/%'), more AS (SELECT DISTINCT unnest(source_feature_ids) AS id FROM cap WHERE len(list_intersect(source_feature_ids, (SELECT list(id) FROM direct))) > 0)
SELECT id FROM item WHERE id IN (SELECT id FROM direct) OR id IN (SELECT id FROM more)"""))
def _(x):
    item = x.features.join(x.symbols.select(F.col("id").alias("sid"), "path"), F.col("entry_symbol_id") == F.col("sid"), "left").select("id", "path")
    direct = item.where("path like 'src/%'").select("id")
    refs = x.capabilities.select("id", F.explode("source_feature_ids").alias("f"))
    hit = refs.join(direct, refs.f == direct.id, "left_semi").select("id").distinct()
    more = refs.join(hit, "id", "left_semi").select(F.col("f").alias("id"))
    return item.select("id").join(direct.unionByName(more).distinct(), "id", "left_semi")


@query("agg08_module_views", sql(f"""v AS (SELECT project, CASE WHEN len(p) >= 2 THEN array_to_string(list_slice(p, 1, least(len(p) - 1, CASE WHEN lower(p[1]) IN ('packages','apps','services') THEN 2 ELSE 3 END)), '/') END AS view
  FROM (SELECT project, list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.') AS p FROM fil))
SELECT project, view, {CATEGORY.replace('path', 'view')} AS category, count(*) AS files FROM v WHERE view IS NOT NULL GROUP BY project, view"""))
def _(x):
    from .functions.paths import module_view

    v = x.files.select("project", module_view("path").alias("view")).where("view is not null").groupBy("project", "view").agg(F.count(F.lit(1)).alias("files"))
    return v.select("project", "view", view_category("view").alias("category"), "files")
