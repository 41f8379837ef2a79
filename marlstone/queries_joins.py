"""Queries of extraction, resolution joins, rankings, set operations and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import Index, sql
from .functions import paths as fp
from .functions import redact as fr
from .functions import text as ft
from .functions.keys import clean_key
from .operators.ranges import overlapping_ranges, places_in_ranges
from .operators.prefix import running
from .operators.resolve import first_match, import_candidates, prefixes, unique_match
from .plans.session import Workspace
from .queries_functions import AUX, NAME, ROLE, TEST, TOKENSET, _list, _sid
from .queries_index import OPTION_SQL, N, options, top
from .sources import extract as ex

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, d: f(Index(spark, d))
        if check is not None:
            SQL[name] = check
        return f

    return add


# -- extraction ---------------------------------------------------------------------------------------------------------


def facts(x: Index) -> DataFrame:
    """Facts of every text, extracted once and written."""
    return Workspace(x.spark, "facts").write(ex.extract(x.texts), "facts")


@query("ext01_facts")
def _(x):
    return ex.extract(x.texts).select("tag", "file_id", "id", "kind", "qualified_name", "target_name", "line", "analyzer", "confidence")


@query("ext02_symbols")
def _(x):
    return ex.extract(x.texts).where("tag = 'symbol'").select("file_id", "id", "name", "qualified_name", "kind", "line", "end_line", "parent_id", "signature", "exported")


@query("ext04_go_calls")
def _(x):
    return ex.extract(x.texts.where("path like '%.go'")).where("tag = 'edge' and kind = 'calls'").select("file_id", "source_id", "target_id", "target_name", "line", "confidence")


@query("ext11_boundaries")
def _(x):
    f = x.texts.where("text is not null")
    s = "file_id string, kind string, entrypoint string, line int"
    return ex.per_file(f.where("path like '%.py'"), ex.python_boundaries, s).unionByName(ex.per_file(f.where("path rlike '\\\\.(js|ts|jsx|tsx)$'"), ex.javascript_boundaries, s))


@query("ext13_entry_lines")
def _(x):
    return ex.per_file(x.texts, lambda p, t: [(n,)] if (n := ex.entry_line(p, t)) else [], "file_id string, line int")


@query("ext16_python_structure")
def _(x):
    return ex.per_file(x.texts.where("path like '%.py'"), lambda p, t: [(ex.python_structure_digest(t),)], "file_id string, digest string")


# -- resolution ---------------------------------------------------------------------------------------------------------


@query("join01_relative_imports")
def _(x):
    f = facts(x).where("tag = 'edge' and kind = 'import' and target_name like '.%'")
    files = x.files.select("id", "project", "path", "language").where("path is not null")
    here = f.select(F.concat_ws(":", "file_id", "id").alias("ref_id"), "file_id", "path", "target_name").join(files.select(F.col("id").alias("file_id"), "project", fp.language_of("path").alias("language")), "file_id")
    known = files.select(F.col("path").alias("key"), F.col("id").alias("cand_id"), "project")
    return first_match(here, import_candidates(F.col("path"), F.col("target_name"), F.col("language")), known, scope=["project"])


@query("join01_dotted_imports", sql("""mods AS (SELECT project, key, max_by(id, path) AS id FROM (
  SELECT project, id, path, replace(regexp_replace(path, '(.)\\.[^./]+$', '\\1'), '/', '.') AS key FROM fil UNION ALL SELECT project, id, path, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]+$', '\\1') FROM fil) WHERE project IS NOT NULL GROUP BY project, key),
p AS (SELECT id, project, target_name, unnest(range(len(string_split(target_name, '.')), 0, -1)) AS n FROM rel WHERE kind = 'import' AND target_id IS NULL AND target_name IS NOT NULL AND target_name NOT LIKE '.%')
SELECT ref_id, target FROM (SELECT p.id AS ref_id, m.id AS target, row_number() OVER (PARTITION BY p.id ORDER BY n DESC) AS rn FROM p JOIN mods m ON m.project = p.project AND m.key = array_to_string(list_slice(string_split(p.target_name, '.'), 1, n), '.')) WHERE rn = 1"""))
def _(x):
    f = x.files.where("project is not null").select("project", "id", "path")
    dotted = F.translate(F.regexp_replace("path", r"(?<=[^/])\.[^./]+$", ""), "/", ".")
    mods = f.select("project", dotted.alias("key"), "id", "path").unionByName(f.select("project", fp.stem("path").alias("key"), "id", "path")).groupBy("project", "key").agg(F.max_by("id", "path").alias("cand_id"))
    refs = x.relationships.where("kind = 'import' and target_id is null and target_name is not null and target_name not like '.%'").select(F.col("id").alias("ref_id"), "project", "target_name")
    return first_match(refs, prefixes(F.col("target_name"), "."), mods, scope=["project"])


NAMES_SQL = "nm AS (SELECT project, name AS key, id FROM sym UNION SELECT project, qualified_name, id FROM sym)"


def known_names(x: Index) -> DataFrame:
    """Symbols under their name and their qualified name."""
    s = x.symbols.select("project", "name", "qualified_name", F.col("id").alias("cand_id"), "file_id", "parent_id")
    return s.select("project", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("key"), "cand_id", "file_id", "parent_id").where("key is not null")


def open_calls(x):
    """Calls without a target that names may resolve; Go resolves by packages."""
    r = x.relationships.where("kind = 'calls' and target_id is null and coalesce(analyzer, '') not like 'go-%'")
    return r.select(F.col("id").alias("ref_id"), "project", "path", "source_id", "target_name", F.coalesce("analyzer", F.lit("")).alias("analyzer"))


def import_bindings(x):
    """(project, path, binding, target): the file a Python import binds a local name to, the last import of a name."""
    b = x.relationships.where("analyzer = 'python-ast' and kind = 'import' and target_id is not null and receiver_type_hint like 'binding:%'")
    return b.groupBy("project", "path", F.expr("substring(receiver_type_hint, 9)").alias("binding")).agg(F.max_by("target_id", F.struct("line", "id")).alias("target"))


@query("join02_unique_calls", sql(NAMES_SQL + """ SELECT r.id AS ref_id, min(n.id) AS target FROM rel r JOIN nm n ON n.project = r.project AND n.key = r.target_name WHERE r.kind = 'calls' AND r.target_id IS NULL AND r.analyzer NOT LIKE 'go-%'
  AND (r.analyzer <> 'python-ast' OR r.target_name NOT LIKE '%.%' AND NOT EXISTS (SELECT 1 FROM rel b WHERE b.analyzer = 'python-ast' AND b.kind = 'import' AND b.target_id IS NOT NULL AND b.project = r.project AND b.path = r.path AND b.receiver_type_hint = 'binding:' || r.target_name))
  GROUP BY r.id HAVING count(DISTINCT n.id) = 1"""))
def _(x):
    """Calls by the whole name: of scripts, and of Python where the name is no import's; Go resolves by packages."""
    refs = open_calls(x).where("analyzer <> 'python-ast' or target_name not like '%.%'").withColumn("key", F.col("target_name"))
    own = import_bindings(x).select("project", "path", F.col("binding").alias("key")).withColumn("analyzer", F.lit("python-ast"))
    return unique_match(refs.join(own, ["project", "path", "key", "analyzer"], "left_anti"), known_names(x).select("project", "key", "cand_id"), ["project", "key"])


@query("join02_last_part_calls", sql(NAMES_SQL + """ SELECT r.id AS ref_id, min(n.id) AS target FROM rel r JOIN nm n ON n.project = r.project AND n.key = regexp_extract(r.target_name, '[^.]*$') WHERE r.kind = 'calls' AND r.target_id IS NULL AND r.target_name LIKE '%.%' AND r.analyzer NOT LIKE 'go-%' AND r.analyzer <> 'python-ast'
  AND NOT EXISTS (SELECT 1 FROM nm w WHERE w.project = r.project AND w.key = r.target_name) GROUP BY r.id HAVING count(DISTINCT n.id) = 1"""))
def _(x):
    """Calls of scripts whose whole name is unknown, by its last part."""
    names = known_names(x).select("project", "key", "cand_id")
    refs = open_calls(x).where("analyzer <> 'python-ast' and target_name like '%.%'").join(names.select("project", F.col("key").alias("target_name")).distinct(), ["project", "target_name"], "left_anti")
    return unique_match(refs.withColumn("key", F.substring_index("target_name", ".", -1)), names, ["project", "key"])


@query("join03_bound_calls", sql("""b AS (SELECT project, path, binding, target FROM (SELECT project, path, substr(receiver_type_hint, 9) AS binding, target_id AS target, row_number() OVER (PARTITION BY project, path, receiver_type_hint ORDER BY line DESC, id DESC) AS rn
  FROM rel WHERE analyzer = 'python-ast' AND kind = 'import' AND target_id IS NOT NULL AND receiver_type_hint LIKE 'binding:%') WHERE rn = 1),
c AS (SELECT id, project, path, string_split(target_name, '.') AS p FROM rel WHERE kind = 'calls' AND target_id IS NULL AND analyzer = 'python-ast' AND len(string_split(target_name, '.')) <= 2)
SELECT c.id AS ref_id, min(s.id) AS target FROM c JOIN b ON b.project = c.project AND b.path = c.path AND b.binding = c.p[1] JOIN sym s ON s.file_id = b.target AND s.name = c.p[-1]
WHERE len(c.p) = 1 OR c.p[1] NOT IN ('self', 'cls') GROUP BY c.id HAVING count(DISTINCT s.id) = 1"""))
def _(x):
    """Python calls through an import: a bound name, or a member of it, in the file the import leads to."""
    part = F.split("target_name", r"\.")
    refs = open_calls(x).where("analyzer = 'python-ast'").withColumns({"binding": F.element_at(part, 1), "name": F.element_at(part, -1), "parts": F.size(part)})
    refs = refs.where("parts = 1 or parts = 2 and binding not in ('self', 'cls')")
    bound = refs.join(import_bindings(x), ["project", "path", "binding"]).withColumnRenamed("target", "file_id")
    return unique_match(bound, x.symbols.select("file_id", "name", F.col("id").alias("cand_id")), ["file_id", "name"])


@query("join03_import_bindings", sql("SELECT path, project, binding, target FROM (SELECT project, path, substr(receiver_type_hint, 9) AS binding, target_id AS target, row_number() OVER (PARTITION BY project, path, receiver_type_hint ORDER BY line DESC, id DESC) AS rn FROM rel WHERE analyzer = 'python-ast' AND kind = 'import' AND target_id IS NOT NULL AND receiver_type_hint LIKE 'binding:%') WHERE rn = 1"))
def _(x):
    return import_bindings(x)


@query("join04_self_calls", sql("""c AS (SELECT r.id, r.project, regexp_extract(r.target_name, '[^.]*$') AS name, s.parent_id FROM rel r JOIN sym s ON s.id = r.source_id
  WHERE r.kind = 'calls' AND r.target_id IS NULL AND r.analyzer = 'python-ast' AND r.target_name SIMILAR TO '(self|cls)[.][^.]+' AND s.parent_id IS NOT NULL)
SELECT c.id AS ref_id, min(t.id) AS target FROM c JOIN sym t ON t.parent_id = c.parent_id AND t.name = c.name GROUP BY c.id HAVING count(DISTINCT t.id) = 1"""))
def _(x):
    s = x.symbols.where("parent_id is not null").select(F.col("id").alias("source_id"), "parent_id")
    calls = open_calls(x).where("analyzer = 'python-ast'").where(F.col("target_name").rlike(r"^(self|cls)\.[^.]+$"))
    refs = calls.join(s, "source_id").select("ref_id", F.substring_index("target_name", ".", -1).alias("name"), "parent_id")
    return unique_match(refs, x.symbols.select("parent_id", "name", F.col("id").alias("cand_id")), ["parent_id", "name"])


@query("join05_package_functions", sql("""d AS (SELECT project, regexp_replace(path, '/?[^/]*$', '') AS dir, name, id FROM sym WHERE analyzer LIKE 'go%' AND path NOT LIKE '%_test.go'),
r AS (SELECT id, project, regexp_replace(path, '/?[^/]*$', '') AS dir, target_name FROM rel WHERE analyzer LIKE 'go%' AND kind = 'calls' AND target_id IS NULL)
SELECT r.id AS ref_id, min(d.id) AS target FROM r JOIN d ON d.project = r.project AND d.dir = r.dir AND d.name = r.target_name GROUP BY r.id HAVING count(DISTINCT d.id) = 1"""))
def _(x):
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    defs = x.symbols.where("analyzer like 'go%' and path not like '%\\_test.go'").select("project", folder.alias("dir"), "name", F.col("id").alias("cand_id"))
    refs = x.relationships.where("analyzer like 'go%' and kind = 'calls' and target_id is null").select(F.col("id").alias("ref_id"), "project", folder.alias("dir"), F.col("target_name").alias("name"))
    return unique_match(refs, defs, ["project", "dir", "name"])


@query("join06_longest_prefix_module", sql("""m AS (SELECT DISTINCT project, module FROM fil WHERE module IS NOT NULL)
SELECT f.id, max(m.module) AS root FROM fil f JOIN m ON m.project = f.project AND (f.path = m.module OR starts_with(f.path, m.module || '/')) GROUP BY f.id"""))
def _(x):
    roots = x.files.where("module is not null").select("project", F.col("module").alias("key"), F.col("module").alias("cand_id")).distinct()
    return first_match(x.files.select(F.col("id").alias("ref_id"), "project", "path"), prefixes(F.col("path"), "/"), roots, scope=["project"]).select(F.col("ref_id").alias("id"), F.col("target").alias("root"))


@query("join07_receiver_types", sql("""t AS (SELECT project, name, min(id) AS id FROM sym WHERE kind IN ('class', 'struct', 'type', 'interface') GROUP BY 1, 2 HAVING count(DISTINCT id) = 1)
SELECT s.id, t.id AS receiver FROM sym s JOIN t ON t.project = s.project AND t.name = string_split(s.qualified_name, '.')[-2] WHERE s.kind = 'method'"""))
def _(x):
    t = x.symbols.where("kind in ('class', 'struct', 'type', 'interface')").groupBy("project", "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("receiver")).where("n = 1")
    m = x.symbols.where("kind = 'method'").select("id", "project", F.try_element_at(F.split("qualified_name", "\\."), F.lit(-2)).alias("name"))
    return m.join(t, ["project", "name"]).select("id", "receiver")


@query("join09_symbol_at_line", sql("SELECT r.id, s.id AS symbol_id FROM rel r JOIN sym s ON s.project = r.project AND s.path = r.path AND r.line BETWEEN s.line AND s.end_line QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY s.line DESC, s.id DESC) = 1"))
def _(x):
    s = x.symbols.select("project", "path", F.col("line").alias("a"), F.col("end_line").alias("b"), F.col("id").alias("symbol_id"))
    j = places_in_ranges(x.relationships.select("id", "project", "path", "line"), s, ["project", "path"], "line", "a", "b")
    return j.groupBy("id").agg(F.max(F.struct("a", "symbol_id"))["symbol_id"].alias("symbol_id"))


@query("join10_smallest_enclosing", sql("SELECT e.id, s.id AS symbol_id FROM ev e JOIN sym s ON s.project = e.project AND s.path = e.path AND s.line <= e.line_start AND s.end_line >= e.line_end QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY s.end_line - s.line, s.qualified_name, s.id) = 1"))
def _(x):
    s = x.symbols.select("project", "path", F.col("line").alias("a"), F.col("end_line").alias("b"), "qualified_name", F.col("id").alias("symbol_id"))
    e = x.evidence.select("id", "project", "path", "line_start", "line_end")
    j = places_in_ranges(e.where("line_start <= line_end"), s, ["project", "path"], "line_start", "a", "b").where("b >= line_end")
    # A range the wrong way round lies between what begins before its start and ends behind its end.
    j = j.unionByName(overlapping_ranges(e.where("line_start > line_end"), s, ["project", "path"], "line_end", "line_start", "a", "b"))
    return j.groupBy("id").agg(F.min(F.struct(F.col("b") - F.col("a"), "qualified_name", "symbol_id"))["symbol_id"].alias("symbol_id"))


@query("join11_typed_slice_edges", sql("""b AS (SELECT e.id AS slice, s.id AS symbol_id, e.feature_id FROM ev e JOIN sym s ON s.project = e.project AND s.path = e.path AND s.line <= e.line_end AND s.end_line >= e.line_start WHERE e.feature_id IS NOT NULL)
SELECT DISTINCT a.slice AS source_slice, c.slice AS target_slice, x.id AS edge_id FROM edge x JOIN b a ON a.symbol_id = x.source_id JOIN b c ON c.symbol_id = x.target_id AND c.feature_id = a.feature_id WHERE a.slice <> c.slice"""))
def _(x):
    s = x.symbols.select("project", "path", F.col("line").alias("a"), F.col("end_line").alias("b"), F.col("id").alias("symbol_id"))
    e = x.evidence.where("feature_id is not null").select("id", "project", "path", "feature_id", "line_start", "line_end")
    b = overlapping_ranges(e, s, ["project", "path"], "line_start", "line_end", "a", "b").select(F.col("id").alias("slice"), "symbol_id", "feature_id")
    l = b.select(F.col("slice").alias("source_slice"), F.col("symbol_id").alias("source_id"), "feature_id")
    r = b.select(F.col("slice").alias("target_slice"), F.col("symbol_id").alias("target_id"), F.col("feature_id").alias("f2"))
    return x.edges.join(l, "source_id").join(r, "target_id").where("feature_id = f2 and source_slice <> target_slice").select("source_slice", "target_slice", F.col("id").alias("edge_id")).distinct()


@query("join12_range_overlap", sql("SELECT e.id AS evidence_id, count(*) AS symbols FROM ev e JOIN sym s ON s.project = e.project AND s.path = e.path AND e.line_start <= s.end_line AND s.line <= e.line_end GROUP BY e.id"))
def _(x):
    s = x.symbols.select("project", "path", "line", "end_line")
    return overlapping_ranges(x.evidence.select("id", "project", "path", "line_start", "line_end"), s, ["project", "path"], "line_start", "line_end", "line", "end_line").groupBy(F.col("id").alias("evidence_id")).agg(N().alias("symbols"))


@query("join13_capability_evidence", sql("""a AS (SELECT id, regexp_replace(unnest(evidence_ids), '^\\s+|\\s+$', '', 'g') AS e FROM cap), b AS (SELECT id, unnest(source_feature_ids) AS f FROM cap)
SELECT DISTINCT * FROM (SELECT a.id, ev.id AS evidence_id FROM a JOIN ev ON ev.id = a.e UNION ALL SELECT b.id, ev.id FROM b JOIN ev ON ev.feature_id = b.f)"""))
def _(x):
    e = x.evidence.select(F.col("id").alias("evidence_id"), "feature_id")
    direct = x.capabilities.select("id", F.explode(F.transform("evidence_ids", lambda e: clean_key(e))).alias("evidence_id")).join(e.select("evidence_id"), "evidence_id", "left_semi").select("id", "evidence_id")
    via = x.capabilities.select("id", F.explode("source_feature_ids").alias("feature_id")).join(e, "feature_id").select("id", "evidence_id")
    return direct.unionByName(via).distinct()


@query("join14_manifest_refs", sql("""m AS (SELECT id, project, unnest(implementation_modules) AS m FROM cap)
SELECT m.id, m.m.path AS path, count(DISTINCT f.id) AS files FROM m LEFT JOIN fil f ON f.project = m.project AND (f.path = m.m.path OR starts_with(f.path, m.m.path || '/')) WHERE m.m.path IS NOT NULL GROUP BY 1, 2"""))
def _(x):
    m = x.capabilities.select("id", "project", F.explode("implementation_modules").alias("m")).where("m.path is not null").select("id", "project", F.col("m.path").alias("path")).distinct()
    up = x.files.select("project", F.explode(F.array_distinct(prefixes(F.col("path"), "/"))).alias("path")).groupBy("project", "path").agg(N().alias("files"))
    return m.join(up, ["project", "path"], "left").select("id", "path", F.coalesce("files", F.lit(0)).alias("files"))


@query("join15_command_handlers", sql("""k AS (SELECT f.id, f.project, s.path, lower(replace(f.entrypoint, '-', '_')) AS cmd FROM feat f JOIN sym s ON s.id = f.entry_symbol_id)
SELECT k.id, s.id AS symbol_id FROM k JOIN sym s ON s.project = k.project AND s.path = k.path AND (ltrim(lower(s.name), '_') = regexp_extract(k.cmd, '[^.]*$') OR ltrim(lower(s.name), '_') = regexp_extract(k.cmd, '[^.]*$') || '_command') QUALIFY row_number() OVER (PARTITION BY k.id ORDER BY s.line, s.name, s.id) = 1"""))
def _(x):
    s = x.symbols.select("project", "path", "name", "line", F.col("id").alias("symbol_id"), F.regexp_replace(F.lower("name"), "^_+", "").alias("key"))
    k = x.features.join(x.symbols.select(F.col("id").alias("entry_symbol_id"), "path"), "entry_symbol_id").select("id", "project", "path", F.substring_index(F.lower(F.translate("entrypoint", "-", "_")), ".", -1).alias("cmd"))
    either = k.select("id", "project", "path", F.explode(F.array("cmd", F.concat("cmd", F.lit("_command")))).alias("key"))
    return either.join(s, ["project", "path", "key"]).groupBy("id").agg(F.min(F.struct("line", "name", "symbol_id"))["symbol_id"].alias("symbol_id"))


IS_TEST = f"(regexp_matches(lower(coalesce(s.path, r.path)), '(^|/)(test|tests|testing|eval|evals)/'))"


@query("join16_test_evidence", sql(f"SELECT target_id AS symbol_id, position, id FROM (SELECT r.target_id, r.id, row_number() OVER (PARTITION BY r.target_id ORDER BY r.id) AS position FROM rel r LEFT JOIN sym s ON s.id = r.source_id JOIN sym t ON t.id = r.target_id WHERE r.kind IN ('calls', 'references') AND {IS_TEST}) WHERE position <= 4"))
def _(x):
    src = x.symbols.select(F.col("id").alias("source_id"), F.col("path").alias("spath"))
    r = x.relationships.where("kind in ('calls', 'references')").join(src, "source_id", "left").join(x.symbols.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    r = r.where(F.lower(F.coalesce("spath", "path")).rlike(r"(^|/)(test|tests|testing|eval|evals)/"))
    return top(r, ["target_id"], ["id"], 4).select(F.col("target_id").alias("symbol_id"), "position", "id")


@query("join17_source_references", sql("SELECT project, path, id FROM ev WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project, path ORDER BY line_start, line_end, id) = 1"))
def _(x):
    return x.evidence.where("path is not null").groupBy("project", "path").agg(F.min(F.struct("line_start", "line_end", "id"))["id"].alias("id"))


SURFACE = "path LIKE '%/storage/%'"
BUCKET_SQL = f"""inside AS (SELECT id FROM node WHERE {SURFACE}),
v AS (SELECT r.id, r.source_id, r.target_id, ({SURFACE.replace('path', 'r.path')}) AS a, r.target_id IN (SELECT id FROM inside) AS b, r.target_id IN (SELECT id FROM node) AS known FROM rel r)"""


def surface_buckets(x: Index) -> DataFrame:
    """Relationships of a path set: internal, inbound, outbound or unresolved."""
    nodes = x.nodes.select(F.col("id").alias("target_id"), F.col("path").like("%/storage/%").alias("b"))
    r = x.relationships.join(nodes, "target_id", "left").withColumn("a", F.coalesce(F.col("path").like("%/storage/%"), F.lit(False)))
    hit = F.coalesce("b", F.lit(False))
    bucket = F.when(F.col("b").isNull(), "unresolved").when(F.col("a") & hit, "resolved_internal").when(hit, "resolved_inbound").otherwise("resolved_outbound")
    return r.where(F.col("a") | hit).select("id", "project", "path", "line", "source_id", "target_id", "kind", "a", hit.alias("b"), bucket.alias("bucket"))


@query("join18_surface_buckets", sql(BUCKET_SQL + " SELECT id, CASE WHEN NOT coalesce(known, false) THEN 'unresolved' WHEN a AND b THEN 'resolved_internal' WHEN b THEN 'resolved_inbound' ELSE 'resolved_outbound' END AS bucket FROM v WHERE coalesce(a, false) OR coalesce(b, false)"))
def _(x):
    return surface_buckets(x).select("id", "bucket")


@query("join19_endpoint_view", sql("SELECT r.id, coalesce(a.path, r.path) AS source_path, coalesce(r.line, a.line) AS source_line, b.path AS target_path, b.line AS target_line, coalesce(b.qualified_name, r.target_name) AS target FROM rel r LEFT JOIN node a ON a.id = r.source_id LEFT JOIN node b ON b.id = r.target_id"))
def _(x):
    a = x.nodes.select(F.col("id").alias("source_id"), F.col("path").alias("ap"), F.col("line").alias("al"))
    b = x.nodes.select(F.col("id").alias("target_id"), F.col("path").alias("target_path"), F.col("line").alias("target_line"), "qualified_name")
    r = x.relationships.select("id", "source_id", "target_id", "path", "line", "target_name").join(a, "source_id", "left").join(b, "target_id", "left")
    return r.select("id", F.coalesce("ap", "path").alias("source_path"), F.coalesce("line", "al").alias("source_line"), "target_path", "target_line", F.coalesce("qualified_name", "target_name").alias("target"))


@query("join20_scope_match", sql("SELECT f.id FROM feat f LEFT JOIN sym s ON s.id = f.entry_symbol_id WHERE s.path LIKE 'src/%' OR f.id IN (SELECT unnest(source_feature_ids) FROM cap WHERE importance = 'supporting')"))
def _(x):
    wanted = x.capabilities.where("importance = 'supporting'").select(F.explode("source_feature_ids").alias("id"))
    near = x.features.join(x.symbols.where("path like 'src/%'").select(F.col("id").alias("entry_symbol_id")), "entry_symbol_id", "left_semi").select("id")
    return x.features.select("id").join(wanted.unionByName(near).distinct(), "id", "left_semi")


@query("join21_mirrored_tests", sql("""t AS (SELECT project, path, regexp_replace(regexp_extract(path, '(?:^|/)tests?/(.*)$', 1), '\\.[^./]+$', '') AS tail FROM fil WHERE regexp_matches(path, '(^|/)tests?/')),
s AS (SELECT project, path, regexp_replace(path, '\\.[^./]+$', '') AS body FROM fil WHERE NOT regexp_matches(path, '(^|/)tests?/'))
SELECT DISTINCT t.project, t.path AS test_path, s.path AS source_path FROM t JOIN s ON s.project = t.project AND t.tail <> '' AND (s.body = t.tail OR s.body = 'src/' || t.tail OR s.body = 'packages/' || t.tail)"""))
def _(x):
    strip = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    t = x.files.where("path rlike '(^|/)tests?/'").select("project", F.col("path").alias("test_path"), strip(F.regexp_extract("path", r"(?:^|/)tests?/(.*)$", 1)).alias("tail")).where("tail <> ''")
    wanted = t.select("project", "test_path", F.explode(F.array("tail", F.concat(F.lit("src/"), "tail"), F.concat(F.lit("packages/"), "tail"))).alias("body"))
    s = x.files.where("not path rlike '(^|/)tests?/'").select("project", F.col("path").alias("source_path"), strip(F.col("path")).alias("body"))
    return wanted.join(s, ["project", "body"]).select("project", "test_path", "source_path").distinct()


@query("join22_scope_escapes", sql("SELECT id, f AS ref FROM (SELECT id, unnest(source_feature_ids) AS f FROM cap) WHERE f NOT IN (SELECT id FROM feat) UNION SELECT id, regexp_replace(e, '^\\s+|\\s+$', '', 'g') FROM (SELECT id, unnest(evidence_ids) AS e FROM cap) WHERE regexp_replace(e, '^\\s+|\\s+$', '', 'g') <> '' AND regexp_replace(e, '^\\s+|\\s+$', '', 'g') NOT IN (SELECT id FROM ev)"))
def _(x):
    f = x.capabilities.select("id", F.explode("source_feature_ids").alias("ref")).join(x.features.select(F.col("id").alias("ref")), "ref", "left_anti")
    e = x.capabilities.select("id", F.explode(F.transform("evidence_ids", lambda e: clean_key(e))).alias("ref")).where("ref <> ''").join(x.evidence.select(F.col("id").alias("ref")), "ref", "left_anti")
    return f.select("id", "ref").unionByName(e.select("id", "ref")).distinct()


def closure_up(ws: Workspace, sym: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id): the seeds that are symbols and all their ancestors, by pointer doubling: rounds are the logarithm of the longest chain.

    After a round ``seen`` holds the ancestors less than 2^k away; a round that adds none has reached the end, on cycles too.
    """
    known = sym.select(F.col("id").alias("up"))
    jump = ws.write(sym.select("id", F.col("parent_id").alias("up")).join(known, "up", "left_semi").select("id", "up"), "jump")
    seen = ws.write(sym.join(seeds, "id", "left_semi").select("id").distinct(), "up")
    n = seen.count()
    while True:
        more = ws.write(seen.unionByName(jump.join(seen, "id", "left_semi").select(F.col("up").alias("id"))).distinct(), "up")
        ws.drop(seen)
        seen, old, n = more, n, more.count()
        if n == old:
            return seen
        far = ws.write(jump.join(jump.select(F.col("id").alias("via"), F.col("up").alias("top")), F.col("up") == F.col("via")).select("id", F.col("top").alias("up")), "jump")
        ws.drop(jump)
        jump = far


@query("join23_export_closure", sql("""up(id) AS (SELECT entry_symbol_id FROM feat WHERE entry_symbol_id IN (SELECT id FROM sym) UNION SELECT s.parent_id FROM up JOIN sym s ON s.id = up.id WHERE s.parent_id IN (SELECT id FROM sym))
SELECT id, 'symbol' AS kind FROM up UNION SELECT f.id, 'file' FROM up JOIN sym s ON s.id = up.id JOIN fil f ON f.id = s.file_id UNION SELECT id, 'evidence' FROM ev WHERE feature_id IN (SELECT id FROM feat)"""))
def export_closure(x):
    ws = Workspace(x.spark, "closure")
    sym = ws.write(x.symbols.select("id", "parent_id", "file_id"), "symbols")
    seen = closure_up(ws, sym, x.features.select(F.col("entry_symbol_id").alias("id")))
    files = sym.join(seen, "id", "left_semi").select(F.col("file_id").alias("id")).join(x.files.select("id"), "id", "left_semi").distinct()
    ev = x.evidence.join(x.features.select(F.col("id").alias("feature_id")), "feature_id", "left_semi").select("id")
    tag = lambda d, k: d.select("id", F.lit(k).alias("kind"))
    return tag(seen, "symbol").unionByName(tag(files, "file")).unionByName(tag(ev, "evidence")).distinct()


# -- rankings -----------------------------------------------------------------------------------------------------------

READ_SQL = f"""c AS (SELECT file_id, count(*) AS n FROM sym GROUP BY 1),
t AS (SELECT f.project, f.path, coalesce(c.n, 0) AS n, f.lines, f.module, CASE WHEN lower({NAME}) LIKE 'readme%' THEN 1 WHEN lower({NAME}) IN {_list(fp.MANIFEST_NAMES)} THEN 2 WHEN lower({NAME}) IN {_list(fp.ENTRYPOINT_NAMES)} THEN 3 ELSE 4 END AS tier FROM fil f LEFT JOIN c ON c.file_id = f.id WHERE f.project IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY project, tier ORDER BY CASE WHEN tier IN (1, 3) THEN len(path) - len(replace(path, '/', '')) ELSE 0 END, path) AS rn FROM t),
head AS (SELECT * FROM ranked WHERE (tier = 1 AND rn <= 1) OR (tier = 2 AND rn <= 2) OR (tier = 3 AND rn <= 4)),
rest AS (SELECT t.*, sum(t.n) OVER (PARTITION BY t.project, t.module) AS mn, row_number() OVER (PARTITION BY t.project, t.module ORDER BY t.n DESC, t.lines, t.path DESC) AS pick FROM t WHERE NOT EXISTS (SELECT 1 FROM head h WHERE h.project = t.project AND h.path = t.path)),
steps AS (SELECT project, path, tier AS a, rn AS b, 0 AS m, '' AS mod FROM head UNION ALL SELECT project, path, 4, 0, -mn, coalesce(module, '') FROM rest WHERE pick = 1)"""


@query("rank04_reading_path", sql(READ_SQL + " SELECT project, path, position FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY a, b, m, mod) AS position FROM steps) WHERE position <= 12"))
def _(x):
    c = x.symbols.groupBy("file_id").agg(N().alias("n"))
    name = F.lower(fp.base_name("path"))
    tier = F.when(name.startswith("readme"), 1).when(name.isin(fp.MANIFEST_NAMES), 2).when(name.isin(fp.ENTRYPOINT_NAMES), 3).otherwise(4)
    t = x.files.where("project is not null").join(c, F.col("id") == F.col("file_id"), "left").select("project", "path", F.coalesce("n", F.lit(0)).alias("n"), "lines", "module", tier.alias("tier"))
    depth = F.when(F.col("tier").isin(1, 3), F.size(F.split("path", "/"))).otherwise(0)
    head = t.where("tier < 4").withColumn("rn", F.row_number().over(Window.partitionBy("project", "tier").orderBy(depth, "path"))).where("rn <= case tier when 1 then 1 when 2 then 2 else 4 end")
    rest = t.join(head.select("project", "path"), ["project", "path"], "left_anti")
    sums = rest.groupBy("project", F.coalesce("module", F.lit("")).alias("mod")).agg(F.sum("n").alias("mn"))
    rest = rest.withColumn("mod", F.coalesce("module", F.lit(""))).join(sums, ["project", "mod"])
    rep = top(rest, ["project", "module"], [F.desc("n"), "lines", F.desc("path")], 1)
    steps = head.select("project", "path", F.col("tier").alias("a"), F.col("rn").alias("b"), F.lit(0).cast("bigint").alias("m"), F.lit("").alias("mod")).unionByName(
        rep.select("project", "path", F.lit(4).alias("a"), F.lit(0).alias("b"), (-F.col("mn")).alias("m"), F.coalesce("module", F.lit("")).alias("mod")))
    return top(steps, ["project"], ["a", "b", "m", "mod"], 12).select("project", "path", "position")


RANK_CASE = "CASE role " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(fp.ROLE_ORDER)) + " ELSE 99 END"


@query("rank05_core_symbols", sql(BUCKET_SQL + f""", d AS (SELECT id, count(*) AS deg FROM (SELECT source_id AS id FROM v WHERE coalesce(a, false) UNION ALL SELECT target_id FROM v WHERE coalesce(b, false)) GROUP BY 1),
s AS (SELECT s.*, {ROLE.replace('path', 's.path')} AS role, coalesce(d.deg, 0) AS deg FROM sym s LEFT JOIN d ON d.id = s.id WHERE {SURFACE.replace('path', 's.path')})
SELECT project, id, position FROM (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY {RANK_CASE}, deg DESC, NOT coalesce(exported, false), line, qualified_name, id) AS position FROM s) WHERE position <= 24"""))
def _(x):
    b = surface_buckets(x)
    deg = b.where("a").select(F.col("source_id").alias("id")).unionByName(b.where("b").select(F.col("target_id").alias("id"))).groupBy("id").agg(N().alias("deg"))
    s = x.symbols.where("path like '%/storage/%'").join(deg, "id", "left").withColumns({"rank": fp.role_rank(fp.file_role("path")), "deg": F.coalesce("deg", F.lit(0)), "hidden": ~F.coalesce("exported", F.lit(False))})
    return top(s, ["project"], ["rank", F.desc("deg"), "hidden", "line", "qualified_name", "id"], 24).select("project", "id", "position")


@query("rank06_reading_order", sql(f"""c AS (SELECT file_id, count(*) AS n FROM sym GROUP BY 1), f AS (SELECT f.project, f.path, {ROLE.replace('path', 'f.path')} AS role, coalesce(c.n, 0) AS n FROM fil f LEFT JOIN c ON c.file_id = f.id)
SELECT project, role, path, position FROM (SELECT *, row_number() OVER (PARTITION BY project, role ORDER BY n DESC, path) AS position FROM f) WHERE position <= 6"""))
def _(x):
    c = x.symbols.groupBy("file_id").agg(N().alias("n"))
    f = x.files.join(c, F.col("id") == F.col("file_id"), "left").select("project", "path", fp.file_role("path").alias("role"), F.coalesce("n", F.lit(0)).alias("n"))
    return top(f, ["project", "role"], [F.desc("n"), "path"], 6).select("project", "role", "path", "position")


HINT_LIMIT = 40


@query("rank09_dual_budget", sql(f"""h AS (SELECT f.id, f.project, CASE WHEN f.kind IN ('http-route', 'cli-command', 'entrypoint') THEN 0 ELSE 1 END AS cls, f.title FROM feat f),
r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY title, id) AS rn, count(*) FILTER (cls = 0) OVER () AS prim FROM h)
SELECT id, cls, rn AS position FROM r WHERE (cls = 0 AND rn <= {HINT_LIMIT}) OR (cls = 1 AND rn <= least(24, greatest(8, {HINT_LIMIT} // 6), greatest(0, {HINT_LIMIT} - least(prim, {HINT_LIMIT}))))"""))
def _(x):
    h = x.features.select("id", F.when(F.col("kind").isin("http-route", "cli-command", "entrypoint"), 0).otherwise(1).alias("cls"), "title")
    # A class never holds more than the whole budget: every partition sends that many rows of each at most.
    r = top(h, ["cls"], ["title", "id"], HINT_LIMIT, "rn")
    prim = h.agg(F.count_if(F.col("cls") == 0).alias("prim"))
    room = F.least(F.lit(min(24, max(8, HINT_LIMIT // 6))), F.greatest(F.lit(0), HINT_LIMIT - F.least("prim", F.lit(HINT_LIMIT))))
    return r.join(prim).where(((F.col("cls") == 0) & (F.col("rn") <= HINT_LIMIT)) | ((F.col("cls") == 1) & (F.col("rn") <= room))).select("id", "cls", F.col("rn").alias("position"))


@query("rank10_shard_pack", sql("""e AS (SELECT id, source_id AS n FROM edge UNION ALL SELECT id, target_id FROM edge), d AS (SELECT n AS id, count(*) AS deg FROM e GROUP BY 1),
s AS (SELECT s.project, s.id, coalesce(d.deg, 0) AS deg, s.qualified_name FROM sym s LEFT JOIN d ON d.id = s.id),
r AS (SELECT *, row_number() OVER (PARTITION BY project, deg > 0 ORDER BY deg DESC, qualified_name, id) AS rn FROM s)
SELECT project, id, deg > 0 AS connected, rn AS position FROM r WHERE (deg > 0 AND rn <= 96) OR (deg = 0 AND rn <= 24)"""))
def _(x):
    e = x.edges
    deg = e.select(F.col("source_id").alias("id")).unionByName(e.select(F.col("target_id").alias("id"))).groupBy("id").agg(N().alias("deg"))
    s = x.symbols.join(deg, "id", "left").select("project", "id", F.coalesce("deg", F.lit(0)).alias("deg"), "qualified_name").withColumn("connected", F.col("deg") > 0)
    return top(s, ["project", "connected"], [F.desc("deg"), "qualified_name", "id"], 96).where("connected or position <= 24").select("project", "id", "connected", "position")


@query("rank11_compact_lists", sql("SELECT id, array_to_string(list_slice(list_sort(list_distinct(list_filter(evidence_ids, lambda e: e IS NOT NULL AND regexp_replace(e, '^\\s+|\\s+$', '', 'g') <> ''))), 1, 3), ',') AS first_ids FROM cap WHERE evidence_ids IS NOT NULL"))
def _(x):
    return x.capabilities.where("evidence_ids is not null").select("id", F.array_join(F.slice(F.array_sort(F.array_distinct(F.filter("evidence_ids", lambda e: e.isNotNull() & (F.trim(e) != "")))), 1, 3), ",").alias("first_ids"))


WINDOW_SQL = """l AS (SELECT e.project, e.path, greatest(1, e.line_start - 8) AS a, least(f.lines, greatest(e.line_end, e.line_start) + 12, e.line_start + 159) AS b FROM ev e JOIN fil f ON f.project = e.project AND f.path = e.path WHERE e.line_start <= f.lines GROUP BY ALL),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY project, path ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM l),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY project, path ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)"""


@query("rank13_excerpt_windows", sql(WINDOW_SQL + " SELECT project, path, island::BIGINT AS position, min(a)::INT AS line_start, max(b)::INT AS line_end FROM g WHERE island <= 6 GROUP BY project, path, island"))
def _(x):
    f = x.files.select("project", "path", "lines")
    a = F.greatest(F.lit(1), F.col("line_start") - 8).alias("a")
    b = F.least("lines", F.greatest("line_end", "line_start") + 12, F.col("line_start") + 159).alias("b")
    spans = x.evidence.join(f, ["project", "path"]).where("line_start <= lines").select("project", "path", a, b).distinct()
    w = Window.partitionBy("project", "path").orderBy("a", "b")
    m = spans.withColumn("fresh", F.when(F.col("a") <= F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return m.where("island <= 6").groupBy("project", "path", F.col("island").alias("position")).agg(F.min("a").alias("line_start"), F.max("b").alias("line_end"))


@query("rank15_direct_graph", sql("""touch AS (SELECT DISTINCT entry_symbol_id AS id FROM feat WHERE entry_symbol_id IS NOT NULL)
SELECT project, id, near, position FROM (SELECT e.project, e.id, (e.source_id IN (SELECT id FROM touch) OR e.target_id IN (SELECT id FROM touch)) AS near, row_number() OVER (PARTITION BY e.project ORDER BY (e.source_id IN (SELECT id FROM touch) OR e.target_id IN (SELECT id FROM touch)) DESC, e.id) AS position FROM edge e) WHERE position <= 64"""))
def _(x):
    touch = x.features.where("entry_symbol_id is not null").select(F.col("entry_symbol_id").alias("t")).distinct()
    e = x.edges.select("project", "id", "source_id", "target_id").join(touch.select(F.col("t").alias("source_id"), F.lit(True).alias("s")), "source_id", "left").join(touch.select(F.col("t").alias("target_id"), F.lit(True).alias("g")), "target_id", "left")
    e = e.select("project", "id", F.coalesce("s", "g", F.lit(False)).alias("near"))
    return top(e, ["project"], [F.desc("near"), "id"], 64)


@query("rank12_greedy_pack")
def _(x):
    from .operators.packs import greedy_pack

    h = x.capabilities.select("project", "id", "evidence_ids").where("project is not null")
    return greedy_pack(h, "project", "id", "evidence_ids", 2_000)


# -- sets ---------------------------------------------------------------------------------------------------------------


@query("set01_unique_relationships", "SELECT id, dense_rank() OVER (PARTITION BY id ORDER BY kind, source_id, coalesce(target_id, ''), target_name, path, line) AS variant, source_id, target_name, kind, path, line FROM (SELECT DISTINCT id, kind, source_id, target_id, target_name, path, line FROM relationships)")
def _(x):
    d = x.raw("relationships").select("id", "kind", "source_id", "target_id", "target_name", "path", "line").distinct()
    return d.withColumn("variant", F.dense_rank().over(Window.partitionBy("id").orderBy("kind", "source_id", F.coalesce("target_id", F.lit("")), "target_name", "path", "line"))).select("id", "variant", "source_id", "target_name", "kind", "path", "line")


@query("set02_partition_check", sql("""given AS (SELECT id FROM feat), seen AS (SELECT f AS id, count(*) AS n FROM (SELECT unnest(source_feature_ids) AS f FROM cap) GROUP BY 1)
SELECT coalesce(g.id, s.id) AS id, CASE WHEN s.id IS NULL THEN 'missing' WHEN g.id IS NULL THEN 'unknown' ELSE 'duplicate' END AS problem FROM given g FULL JOIN seen s ON s.id = g.id WHERE s.id IS NULL OR g.id IS NULL OR s.n > 1"""))
def _(x):
    seen = x.capabilities.select(F.explode("source_feature_ids").alias("sid")).groupBy("sid").agg(N().alias("n"))
    j = x.features.select("id").join(seen, F.col("id") == F.col("sid"), "full")
    return j.where("sid is null or id is null or n > 1").select(F.coalesce("id", "sid").alias("id"), F.when(F.col("sid").isNull(), "missing").when(F.col("id").isNull(), "unknown").otherwise("duplicate").alias("problem"))


@query("set03_review_set", sql("SELECT id, 'unreviewed' AS problem FROM (SELECT id FROM feat EXCEPT SELECT feature_id FROM ev) UNION ALL SELECT id, 'unexpected' FROM (SELECT feature_id AS id FROM ev WHERE feature_id IS NOT NULL EXCEPT SELECT id FROM feat)"))
def _(x):
    f, e = x.features.select("id"), x.evidence.where("feature_id is not null").select(F.col("feature_id").alias("id"))
    return f.subtract(e).withColumn("problem", F.lit("unreviewed")).unionByName(e.subtract(f).withColumn("problem", F.lit("unexpected")))


@query("set04_domain_shards")
def _(x):
    """Domains of each project to at most six shards, heaviest first to the lightest; one project's domains are few."""
    from .operators.packs import balance_shards

    parts = fp.path_parts("path")
    domain = F.when(F.lower(F.try_element_at(parts, F.lit(1))).isin("apps", "packages", "services") & (F.size(parts) > 2), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.try_element_at(parts, F.lit(1)))
    d = x.files.where((fp.view_category("path") == "product-implementation") & (F.size(parts) > 1) & F.col("project").isNotNull()).groupBy("project", domain.alias("domain")).agg(N().alias("weight"))
    return balance_shards(d, "project", "domain", "weight", 6)


@query("set05_budget_split")
def _(x):
    from .operators.packs import split_by_budget

    m = x.files.where("project is not null and module is not null").groupBy("project", "module").agg(F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))
    return split_by_budget(m, "project", "module", "bytes", 200_000)


@query("set06_expand_scopes")
def _(x):
    from .operators.packs import expand_scopes

    return expand_scopes(x.files.where("project is not null").select("project", "path", F.coalesce("size", F.lit(0)).alias("bytes")), 100_000)


@query("set07_packet_budget", sql("SELECT project, path, strlen(text)::BIGINT AS packet_bytes, ceil(strlen(text) / 4.0)::BIGINT AS estimated_tokens, strlen(text) <= 4000 AND ceil(strlen(text) / 4.0) <= 1000 AS fits FROM txt WHERE text IS NOT NULL"))
def _(x):
    b = F.octet_length("text").cast("bigint")
    return x.texts.where("text is not null").select("project", "path", b.alias("packet_bytes"), ft.estimated_tokens(b).cast("bigint").alias("estimated_tokens"), ((b <= 4000) & (ft.estimated_tokens(b) <= 1000)).alias("fits"))


@query("set08_chunks", sql("SELECT id, (row_number() OVER (PARTITION BY project ORDER BY id) - 1) // 7 AS chunk FROM cap"))
def _(x):
    return running(x.capabilities.select("project", "id"), "project", ["id"]).select("id", F.floor((F.col("position") - 1) / 7).cast("bigint").alias("chunk"))


# -- evidence -----------------------------------------------------------------------------------------------------------

SLICE = "array_to_string(list_slice(l, line_start, line_end), chr(10))"
LINES = "lines AS (SELECT project, path, string_split(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n$', ''), chr(10)) AS l FROM txt WHERE text IS NOT NULL AND text <> '')"


def evidence_slices(x: Index) -> DataFrame:
    """Evidence whose range lies in its file, with the lines it names."""
    t = x.texts.where("text is not null and text <> ''").select("project", "path", F.split(F.regexp_replace(F.regexp_replace("text", "\r\n|\r", "\n"), r"\n\z", ""), "\n").alias("l"))
    e = x.evidence.where("line_start >= 1 and line_end >= line_start").join(t, ["project", "path"]).where(F.col("line_end") <= F.size("l"))
    return e.withColumn("source", F.array_join(F.slice("l", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n"))


@query("ev01_create", sql(LINES + f""" SELECT e.id AS item, sha256(s) AS snippet_sha256, {_sid('evidence', 'path', 'line_start', 'line_end', "'source'", "'exact'", "'source-lines'", "''", 'sha256(s)')} AS evidence_id
FROM (SELECT ev.id, ev.path, line_start, line_end, {SLICE} AS s FROM ev JOIN lines USING (project, path) WHERE line_start >= 1 AND line_end >= line_start AND line_end <= len(l)) e"""))
def _(x):
    e = evidence_slices(x).withColumn("snippet_sha256", F.sha2("source", 256))
    return e.select(F.col("id").alias("item"), "snippet_sha256", ft.stable_id("evidence", "path", "line_start", "line_end", F.lit("source"), F.lit("exact"), F.lit("source-lines"), F.lit(""), "snippet_sha256").alias("evidence_id"))


@query("ev01_redacted_snippets")
def _(x):
    return evidence_slices(x).select("id", fr.redact_evidence("source").alias("snippet"))


@query("ev02_revalidated", sql(LINES + f""" SELECT id FROM (SELECT ev.id, lower(ev.sha256) AS want, {SLICE} AS s FROM ev JOIN lines USING (project, path) WHERE line_start >= 1 AND line_end >= line_start AND line_end <= len(l)) WHERE sha256(s) = want GROUP BY id HAVING count(*) = 1"""))
def _(x):
    return evidence_slices(x).where(F.sha2("source", 256) == F.lower("sha256")).groupBy("id").agg(N().alias("n")).where("n = 1").select("id")


@query("ev03_claim_references", sql("SELECT c.id, regexp_replace(c.e, '^\\s+|\\s+$', '', 'g') AS evidence_id, ev.path, ev.line_start, ev.line_end FROM (SELECT id, unnest(evidence_ids) AS e FROM cap) c LEFT JOIN ev ON ev.id = regexp_replace(c.e, '^\\s+|\\s+$', '', 'g') WHERE regexp_replace(c.e, '^\\s+|\\s+$', '', 'g') <> ''"))
def _(x):
    c = x.capabilities.select("id", F.explode(F.transform("evidence_ids", lambda e: clean_key(e))).alias("evidence_id")).where("evidence_id <> ''")
    return c.join(x.evidence.select(F.col("id").alias("evidence_id"), "path", "line_start", "line_end"), "evidence_id", "left").select("id", "evidence_id", "path", "line_start", "line_end")


@query("ev04_fresh_excerpts")
def _(x):
    t = x.texts.where("text is not null").select("file_id", "path", F.sha2("text", 256).alias("now"), F.split("text", "\n").alias("l"))
    f = x.files.select(F.col("id").alias("file_id"), "sha256")
    return t.join(f, "file_id").select("file_id", "path", (F.col("now") == F.col("sha256")).alias("fresh"), F.array_join(F.slice("l", 1, 20), "\n").alias("excerpt"))


@query("ev05_feature_entries")
def _(x):
    """Boundaries first, then entry files, then candidates: the first kind that claims a (file, line) holds it."""
    f = x.texts.where("text is not null")
    s = "file_id string, kind string, entrypoint string, line int"
    found = ex.per_file(f.where("path like '%.py'"), ex.python_boundaries, s).unionByName(ex.per_file(f.where("path rlike '\\\\.(js|ts)$'"), ex.javascript_boundaries, s)).withColumn("prio", F.lit(1))
    entry = ex.per_file(f, lambda p, t: [("entrypoint", p, n)] if (n := ex.entry_line(p, t)) else [], s).withColumn("prio", F.lit(2))
    guess = x.files.where(F.lower(fp.base_name("path")).isin(fp.ENTRYPOINT_NAMES)).select(F.col("id").alias("file_id"), F.lit("entrypoint-candidate").alias("kind"), F.col("path").alias("entrypoint"), F.lit(1).alias("line"), F.lit(3).alias("prio"))
    return found.unionByName(entry).unionByName(guess).groupBy("file_id", "line").agg(F.min(F.struct("prio", "kind", "entrypoint")).alias("r")).select("file_id", "line", "r.kind", "r.entrypoint")


@query("ev06_feature_assembly", sql("SELECT f.id, f.title, s.path, s.line, (SELECT count(*) FROM ev WHERE ev.feature_id = f.id) AS evidence, (SELECT count(*) FROM rel r WHERE r.source_id = f.entry_symbol_id AND r.kind = 'calls') AS calls FROM feat f LEFT JOIN sym s ON s.id = f.entry_symbol_id"))
def _(x):
    ev = x.evidence.groupBy(F.col("feature_id").alias("id")).agg(N().alias("e"))
    calls = x.relationships.where("kind = 'calls'").groupBy(F.col("source_id").alias("entry_symbol_id")).agg(N().alias("c"))
    f = x.features.join(x.symbols.select(F.col("id").alias("entry_symbol_id"), "path", "line"), "entry_symbol_id", "left").join(ev, "id", "left").join(calls, "entry_symbol_id", "left")
    return f.select("id", "title", "path", "line", F.coalesce("e", F.lit(0)).alias("evidence"), F.coalesce("c", F.lit(0)).alias("calls"))


@query("ev08_audited_gate", sql("""m AS (SELECT c.id, c.project, ev.path, lower(ev.sha256) AS want FROM (SELECT id, project, unnest(evidence_ids) AS e FROM cap) c JOIN ev ON ev.id = regexp_replace(c.e, '^\\s+|\\s+$', '', 'g'))
SELECT m.id, bool_and(coalesce(f.path IS NOT NULL, false)) AS holds FROM m LEFT JOIN (SELECT DISTINCT project, path FROM fil) f ON f.project = m.project AND f.path = m.path GROUP BY m.id"""))
def _(x):
    m = x.capabilities.select("id", "project", F.explode(F.transform("evidence_ids", lambda e: clean_key(e))).alias("e")).join(x.evidence.select(F.col("id").alias("e"), "path"), "e")
    f = x.files.select("project", "path", F.lit(True).alias("there")).distinct()
    return m.join(f, ["project", "path"], "left").groupBy("id").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("holds"))


@query("ev10_reading_edges", sql("""o AS (SELECT feature_id, id, path, row_number() OVER (PARTITION BY feature_id ORDER BY path, line_start, id) AS n FROM ev WHERE feature_id IS NOT NULL)
SELECT a.feature_id, a.id AS source, b.id AS target FROM o a JOIN o b ON b.feature_id = a.feature_id AND b.n = a.n + 1 WHERE a.path <> b.path"""))
def _(x):
    w = Window.partitionBy("feature_id").orderBy("path", "line_start", "id")
    e = x.evidence.where("feature_id is not null").select("feature_id", "id", "path", F.lead("id").over(w).alias("target"), F.lead("path").over(w).alias("next_path"))
    return e.where("target is not null and path <> next_path").select("feature_id", F.col("id").alias("source"), "target")


DIFFICULTIES = {"concurrency": "async|await|lock|queue", "persistence": "store|cache|session|database", "parsing": "parse|token|grammar", "security": "auth|secret|redact|token"}


@query("ev11_difficulty_map", sql("SELECT e.feature_id, d.slug, count(*) AS hits, min(e.id) AS first_evidence FROM ev e, (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in DIFFICULTIES.items()) + ") d(slug, marks) WHERE e.feature_id IS NOT NULL AND e.snippet IS NOT NULL AND regexp_matches(lower(e.snippet), marks) GROUP BY ALL"))
def _(x):
    hit = F.array_compact(F.array(*[F.when(F.lower("snippet").rlike(v), F.lit(k)) for k, v in DIFFICULTIES.items()]))
    return x.evidence.where("feature_id is not null and snippet is not null").select("feature_id", "id", F.explode(hit).alias("slug")).groupBy("feature_id", "slug").agg(N().alias("hits"), F.min("id").alias("first_evidence"))


@query("ev12_identity_status", "SELECT name, commit, CASE WHEN coalesce(remote, '') = '' THEN 'unverified' WHEN age = 1 THEN 'verified' ELSE 'stale' END AS status FROM (SELECT name, commit, max(remote) AS remote, row_number() OVER (PARTITION BY name ORDER BY min(analyzed_at) DESC, commit DESC) AS age FROM project_snapshots GROUP BY name, commit)")
def _(x):
    s = x.raw("project_snapshots").groupBy("name", "commit").agg(F.max("remote").alias("remote"), F.min("analyzed_at").alias("a"))
    s = s.withColumn("age", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("a"), F.desc("commit"))))
    return s.select("name", "commit", F.when(F.coalesce("remote", F.lit("")) == "", "unverified").when(F.col("age") == 1, "verified").otherwise("stale").alias("status"))


LOCATE = "ledger"
PROD = f"(NOT {AUX} AND NOT {TEST} AND {ROLE} <> 'documentation')"
LOCATE_SQL = f"""tok AS (SELECT project, path, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]+$', '\\1') AS stem FROM fil WHERE {PROD} AND project IS NOT NULL),
bystem AS (SELECT project, path FROM tok WHERE list_contains({TOKENSET('stem')}, '{LOCATE}') OR list_has_any(list_transform(string_split(path, '/'), lambda s: regexp_replace(lower(s), '[^a-z0-9]', '', 'g')), ['{LOCATE}'])),
bysym AS (SELECT s.project, s.path FROM sym s JOIN fil f ON f.project = s.project AND f.path = s.path WHERE {PROD.replace('path', 'f.path')} AND list_contains({TOKENSET('s.qualified_name')}, '{LOCATE}')),
matched AS (SELECT project, path FROM bystem UNION SELECT project, path FROM bysym)"""


def located(x: Index) -> DataFrame:
    """Product files that match the query by their name, a directory or a symbol."""
    f = x.files.where("project is not null").select("project", "path").where(fp.locator_product("path"))
    by_part = F.exists(F.split("path", "/"), lambda s: ft.compact_key(s) == LOCATE)
    stems = f.where(fp.matches_query(fp.stem("path"), LOCATE) | by_part).select("project", "path")
    syms = x.symbols.where(fp.matches_query(F.col("qualified_name"), LOCATE)).select("project", "path").join(f, ["project", "path"], "left_semi")
    return stems.unionByName(syms).distinct()


@query("ev14_module_search", sql(LOCATE_SQL + f" SELECT m.project, m.path, {ROLE.replace('path', 'm.path')} AS role FROM matched m"))
def _(x):
    return located(x).select("project", "path", fp.file_role("path").alias("role"))


@query("ev15_locate", sql(LOCATE_SQL + " SELECT project, count(*) AS slices, CASE WHEN count(*) > 1 THEN 'composite_candidate' ELSE 'candidate' END AS status, least(0.82, round_even(0.52 + 0.05 * count(*), 3))::DOUBLE AS score FROM matched GROUP BY project"))
def _(x):
    return located(x).groupBy("project").agg(N().alias("slices")).select("project", "slices", F.when(F.col("slices") > 1, "composite_candidate").otherwise("candidate").alias("status"), F.least(F.lit(0.82), F.bround(0.52 + 0.05 * F.col("slices"), 3)).alias("score"))


@query("ev16_surface_division", sql("SELECT m.id FROM (SELECT id, project, unnest(implementation_modules) AS m FROM cap) m LEFT JOIN (SELECT DISTINCT project, regexp_replace(path, '/[^/]*$', '') AS dir FROM fil) f ON f.project = m.project AND (f.dir = m.m.path OR starts_with(f.dir, m.m.path || '/')) GROUP BY m.id HAVING count(DISTINCT m.m.path) = count(DISTINCT m.m.path) FILTER (f.dir IS NOT NULL) AND count(DISTINCT m.m.path) > 0"))
def _(x):
    m = x.capabilities.select("id", "project", F.explode("implementation_modules").alias("m")).where("m.path is not null").select("id", "project", F.col("m.path").alias("dir")).distinct()
    there = x.files.select("project", F.explode(prefixes(F.regexp_replace("path", "/[^/]*$", ""), "/")).alias("dir")).distinct().withColumn("there", F.lit(1))
    return m.join(there, ["project", "dir"], "left").groupBy("id").agg(N().alias("n"), F.count("there").alias("k")).where("n = k").select("id")


@query("ev17_chapter_closure", sql("SELECT e.id, f.id AS file_id, greatest(1, least(e.line_start, f.lines)) AS line_start, least(f.lines, greatest(e.line_end, e.line_start)) AS line_end FROM ev e JOIN fil f ON f.project = e.project AND f.path = e.path"))
def _(x):
    f = x.files.select("project", "path", F.col("id").alias("file_id"), "lines")
    return x.evidence.join(f, ["project", "path"]).select("id", "file_id", F.greatest(F.lit(1), F.least("line_start", "lines")).alias("line_start"), F.least("lines", F.greatest("line_end", "line_start")).alias("line_end"))


@query("ev18_chapter_ids", sql("SELECT id, substr(sha256(array_to_string(list_append(list_sort(list_distinct(list_filter(evidence_ids, lambda e: e IS NOT NULL))), coalesce(title, '')), chr(0))), 1, 16) AS chapter_id FROM cap WHERE evidence_ids IS NOT NULL"))
def _(x):
    anchors = F.array_sort(F.array_distinct(F.filter("evidence_ids", lambda e: e.isNotNull())))
    return x.capabilities.where("evidence_ids is not null").select("id", F.substring(F.sha2(F.array_join(F.array_append(anchors, F.coalesce("title", F.lit(""))), "\0"), 256), 1, 16).alias("chapter_id"))


@query("ev19_narrative_citations", sql("SELECT id, count(*) AS citations, count(*) FILTER (e IN (SELECT id FROM ev)) AS resolved FROM (SELECT id, regexp_replace(unnest(evidence_ids), '^\\s+|\\s+$', '', 'g') AS e FROM cap) WHERE e <> '' GROUP BY id"))
def _(x):
    c = x.capabilities.select("id", F.explode(F.transform("evidence_ids", lambda e: clean_key(e))).alias("e")).where("e <> ''").join(x.evidence.select(F.col("id").alias("e"), F.lit(1).alias("hit")), "e", "left")
    return c.groupBy("id").agg(N().alias("citations"), F.count("hit").alias("resolved"))


@query("ev20_bundle_modules", sql("SELECT feature_id, CASE WHEN path LIKE '%/%' THEN array_to_string(list_slice(string_split(path, '/'), 1, least(len(string_split(path, '/')) - 1, 2)), '/') ELSE 'repository-root' END AS module_path, count(*) AS sources, min(line_start) AS first_line FROM ev WHERE feature_id IS NOT NULL AND path IS NOT NULL GROUP BY ALL"))
def _(x):
    return x.evidence.where("feature_id is not null and path is not null").groupBy("feature_id", fp.bundle_module("path").alias("module_path")).agg(N().alias("sources"), F.min("line_start").alias("first_line"))


@query("ev09_tutorial_steps", sql("SELECT f.id AS feature_id, e.id AS evidence_id, row_number() OVER (PARTITION BY f.id ORDER BY e.path, e.line_start, e.id) AS step FROM feat f JOIN ev e ON e.feature_id = f.id QUALIFY step <= 8"))
def _(x):
    e = x.evidence.where("feature_id is not null").join(x.features.select(F.col("id").alias("feature_id")), "feature_id", "left_semi")
    return top(e, ["feature_id"], ["path", "line_start", "id"], 8, "step").select("feature_id", F.col("id").alias("evidence_id"), "step")


@query("ev13_comparison", sql(OPTION_SQL + """ SELECT slug, project, score::BIGINT AS score, max(score) OVER (PARTITION BY slug)::BIGINT AS best, max(score) OVER (PARTITION BY slug) - score <= 15 AS co_winner,
  CASE WHEN s > 0 THEN 'heuristic-with-exact-symbols' ELSE 'heuristic' END AS confidence FROM o"""))
def _(x):
    o = options(x)
    best = o.groupBy("slug").agg(F.max("score").cast("bigint").alias("best"))
    return o.join(best, "slug").select("slug", "project", F.col("score").cast("bigint").alias("score"), "best", (F.col("best") - F.col("score") <= 15).alias("co_winner"), F.when(F.col("s") > 0, "heuristic-with-exact-symbols").otherwise("heuristic").alias("confidence"))


#: Limits a packet is tried with, largest first, and the bytes it may have.
LADDER, PACKET_BYTES = [64, 32, 16, 8, 4], 640_000


@query("rank14_packet_ladder", sql(f"""r AS (SELECT project, row_number() OVER w AS n, sum(strlen(coalesce(snippet, ''))) OVER w AS bytes FROM ev WINDOW w AS (PARTITION BY project ORDER BY id ROWS UNBOUNDED PRECEDING)),
t AS (SELECT r.project, l.lim, max(bytes) FILTER (n <= l.lim) AS bytes FROM r, (VALUES {', '.join(f'({v})' for v in LADDER)}) l(lim) GROUP BY ALL)
SELECT project, coalesce(max(lim) FILTER (bytes <= {PACKET_BYTES}), {LADDER[-1]})::INT AS chosen FROM t GROUP BY project"""))
def _(x):
    lead = top(x.evidence.select("project", "id", F.octet_length(F.coalesce("snippet", F.lit(""))).alias("b")), ["project"], ["id"], LADDER[0], "n")
    tried = lead.groupBy("project").agg(*[F.sum(F.when(F.col("n") <= v, F.col("b"))).alias(f"b{v}") for v in LADDER])
    choice = F.lit(LADDER[-1])
    for v in reversed(LADDER):
        choice = F.when(F.col(f"b{v}") <= PACKET_BYTES, v).otherwise(choice)
    return tried.select("project", choice.cast("int").alias("chosen"))
