"""Queries of the scalar functions, one per function of the inventory, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import K, P, Index, sql
from .functions import paths as fp
from .functions import redact as fr
from .functions import text as ft

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, d: f(Index(spark, d))
        if check is not None:
            SQL[name] = check
        return f

    return add


def _list(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _arr(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


NAME = "regexp_extract(path, '[^/]*$')"
END = f"lower(regexp_extract({NAME}, '^.+(\\.[^.]+)$', 1))"
STEM = f"lower(regexp_replace({NAME}, '(.)\\.[^.]+$', '\\1'))"
LANG = (f"CASE WHEN {NAME} IN {_list(fp.SPECIAL_NAMES)} THEN CASE {NAME} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fp.SPECIAL_NAMES.items()) + " END "
        f"WHEN lower({NAME}) LIKE 'license%' THEN 'License' WHEN lower({NAME}) LIKE 'readme%' THEN 'Markdown' ELSE CASE {END} "
        + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fp.LANGUAGES.items()) + " END END")
PARTS = "CASE WHEN path LIKE '/%' OR list_contains(string_split(path, '/'), '..') THEN []::VARCHAR[] ELSE list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.') END"
LOW = f"list_transform({PARTS}, lambda x: lower(x))"
TEST = f"(list_has_any(string_split(lower(path), '/'), {_arr(fp.TEST_PARTS)}) OR regexp_matches(lower({NAME}), '(^|[._-])(test|spec)([._-]|$)'))"
AUX = f"list_has_any(string_split(lower(path), '/'), {_arr(fp.AUXILIARY_PARTS)})"
ROLE = (f"CASE WHEN {TEST} THEN 'test' WHEN lower({NAME}) IN {_list(fp.ENTRYPOINT_NAMES)} THEN 'entrypoint' WHEN lower({NAME}) IN {_list(fp.LOCATOR_MANIFESTS)} OR {END} IN ('.toml', '.yaml', '.yml') THEN 'configuration' "
        f"WHEN lower({NAME}) LIKE 'readme%' OR {END} IN ('.md', '.mdx', '.rst') THEN 'documentation' "
        f"WHEN regexp_matches({STEM}, 'route|handler|controller|endpoint|api') THEN 'boundary' WHEN regexp_matches({STEM}, 'orchestrat|service|manager|workflow|engine|flow') THEN 'orchestration' "
        f"WHEN regexp_matches({STEM}, 'model|schema|type|entity|protocol') THEN 'model' WHEN regexp_matches({STEM}, 'repository|storage|store|database|persistence') THEN 'persistence' "
        f"WHEN regexp_matches({STEM}, 'adapter|client|transport|gateway|provider|socket') THEN 'adapter' WHEN regexp_matches({STEM}, 'view|component|page|screen|ui') THEN 'presentation' ELSE 'core' END")
TOKENS = lambda c: f"list_filter(string_split(lower(regexp_replace(regexp_replace({c}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"
TOKENSET = lambda c: f"list_distinct(list_filter(string_split(lower(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))"
LABEL = f"CASE WHEN len({PARTS}) = 0 THEN 'root' WHEN ({PARTS})[1] IN {_list(fp.COMMON_TOP_PARTS)} AND len({PARTS}) >= 2 THEN ({PARTS})[2] ELSE ({PARTS})[1] END"
CATEGORY = (f"CASE WHEN len(list_filter({LOW}, lambda x: x LIKE '.%')) > 0 THEN 'engineering-support' WHEN list_has_any({LOW}, ['artifacts','artifact','generated','generated-source','reverse-source','decompiled','unpacked','dist','coverage','cache','caches']) THEN 'generated-or-reference' "
            f"WHEN list_has_any({LOW}, ['test','tests','fixtures']) OR ({LOW})[-1] LIKE '%.test.%' OR suffix(({LOW})[-1], '_test.go') OR suffix(({LOW})[-1], '_test.py') THEN 'testing' "
            f"WHEN list_has_any({LOW}, ['example','examples','demo','demos','sample','samples','assets','sandbox-projects']) OR len(list_filter({LOW}, lambda x: suffix(x, '-assets') OR suffix(x, '_assets'))) > 0 THEN 'examples' "
            f"WHEN list_has_any({LOW}, ['doc','docs','spec','specs','changelog','changes']) THEN 'documentation' WHEN list_has_any({LOW}, ['script','scripts','.github','build','tools']) THEN 'engineering-support' ELSE 'product-implementation' END")
VIEW = f"CASE WHEN len({PARTS}) >= 2 THEN array_to_string(list_slice({PARTS}, 1, least(len({PARTS}) - 1, CASE WHEN lower(({PARTS})[1]) IN ('packages','apps','services') THEN 2 ELSE 3 END)), '/') END"
DIRS = "list_slice(string_split(lower(path), '/'), 1, len(string_split(path, '/')) - 1)"
PRIORITY = (f"CASE WHEN len({LOW}) = 0 THEN 5 WHEN list_has_any({LOW}, ['test','tests','fixtures']) THEN 4 WHEN list_has_any({LOW}, ['docs','doc','spec','specs']) THEN 3 "
            f"WHEN list_has_any({LOW}, ['example','examples','demo','demos','sample','samples']) THEN 2 WHEN ({LOW})[1] IN ('src','lib','libs','packages','apps','server','client') THEN 0 ELSE 1 END")


def _sid(ns: str, *parts: str) -> str:
    joined = " || chr(31) || ".join([f"'{ns}'", *[f"coalesce(({p})::VARCHAR, 'None')" for p in parts]])
    return f"'{ns}_' || substr(sha1({joined}), 1, 16)"


@query("src03_language", sql(f"SELECT id, path, {LANG} AS detected FROM fil"))
def _(x):
    return x.files.select("id", "path", fp.language_of("path").alias("detected"))


@query("src04_module", sql("SELECT id, CASE WHEN path LIKE '%/%' THEN string_split(path, '/')[1] ELSE 'root' END AS module_key FROM fil"))
def _(x):
    return x.files.select("id", fp.module_of("path").alias("module_key"))


@query("src07_clean_remote")
def _(x):
    return x.raw("project_snapshots").select("name", "remote", fp.clean_remote("remote").alias("clean")).distinct()


#: The checks spell the patterns out for themselves; what a back reference says there is written as one case per quote.
_FRAMES = [
    (r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "[REDACTED PRIVATE KEY]"),
    (r"(?i)\b([a-z][a-z0-9+.-]*://)[^\s/@:]+:[^\s/@]+@", r"\1[REDACTED]@"),
    (r"(?i)(\b(?:authorization\s*:\s*)?bearer\s+)[^\s,;]+", r"\1[REDACTED]"),
]
_CLOUD, _HUB, _FINE, _LAB = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b", r"(?i)\bgithub_pat_[A-Za-z0-9_]{20,}\b", r"(?i)\bglpat-[A-Za-z0-9_-]{12,}\b"
_CHAT, _ANT, _STAGE, _PLAIN, _JWT = (r"(?i)\bxox[baprs]-[A-Za-z0-9_-]{12,}\b", r"(?i)\bsk-ant-[A-Za-z0-9_-]{12,}\b", r"\b(?:sk|rk)-(?:live|test|proj)-[A-Za-z0-9_-]{12,}\b", r"\bsk-[A-Za-z0-9_-]{20,}\b",
                                     r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b")
_WIDE = [(t, "[REDACTED]") for t in (_CLOUD, _HUB, _FINE, _LAB, _CHAT, _ANT, _STAGE, _PLAIN, _JWT)]
_FEW = [(t, "[REDACTED]") for t in (_CLOUD, _HUB, _FINE, _STAGE, _JWT)]
_VALUE = r"""\b\s*[:=]\s*)(?:"[^\r\n,;#"']+"|'[^\r\n,;#"']+'|[^\r\n,;#"']+)"""
_NAMED = (r"(?i)(\b(?:[A-Za-z][A-Za-z0-9]*[_-])*(?:api[_-]?key|client[_-]?secret|secret(?:[_-]access)?[_-]?key|access[_-]?token|auth[_-]?token|refresh[_-]?token|token|database[_-]?url|connection[_-]?string|"
          r"password|passwd|private[_-]?key|credential)s?" + _VALUE, r"\1[REDACTED]")
_NAMED_FEW = (r"(?i)(\b(?:api[_-]?key|client[_-]?secret|access[_-]?token|auth[_-]?token|refresh[_-]?token|github[_-]?token|database[_-]?url|connection[_-]?string|secret|password|passwd|private[_-]?key|credential)s?" + _VALUE, r"\1[REDACTED]")


def _replaced(c: str, steps: list[tuple[str, str]]) -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    for pattern, by in steps:
        c = f"regexp_replace({c}, {quote(pattern)}, {quote(by)}, 'g')"
    return c


@query("fn01_redact_opaque", sql(f"SELECT id, {_replaced('snippet', [*_FRAMES, *_WIDE])} AS redacted FROM ev"))
def _(x):
    return x.evidence.select("id", fr.redact_opaque("snippet").alias("redacted"))


@query("fn02_redact_text", sql(f"SELECT id, {_replaced('snippet', [*_FRAMES, *_WIDE, _NAMED, *_WIDE])} AS redacted FROM ev"))
def _(x):
    return x.evidence.select("id", fr.redact_text("snippet").alias("redacted"))


@query("fn03_redact_evidence", sql(f"SELECT id, {_replaced('snippet', [*_FRAMES, _NAMED_FEW, *_FEW])} AS redacted FROM ev"))
def _(x):
    return x.evidence.select("id", fr.redact_evidence("snippet").alias("redacted"))


@query("fn04_redact_record")
def _(x):
    caps = x.raw("capabilities")
    return caps.select(*[fr.redact_record(F.col(f.name), f.dataType, f.name).alias(f.name) for f in caps.schema.fields])


@query("fn05_stable_id", sql(f"SELECT id, {_sid('file', 'path')} AS file_id, {_sid('symbol', 'path', 'kind', 'qualified_name', 'line')} AS symbol_id FROM sym"))
def _(x):
    return x.symbols.select("id", ft.stable_id("file", "path").alias("file_id"), ft.stable_id("symbol", "path", "kind", "qualified_name", "line").alias("symbol_id"))


@query("fn06_canonical_digest", sql("""SELECT id, sha256('{"kind":"' || kind || '","line":' || line::VARCHAR || ',"name":"' || name || '"}') AS digest FROM sym"""))
def _(x):
    return x.symbols.select("id", ft.canonical_digest("kind", "line", "name").alias("digest"))


@query("fn07_tokens", sql(f"SELECT id, array_to_string({TOKENS('qualified_name')}, ' ') AS tokens FROM sym"))
def _(x):
    return x.symbols.select("id", F.array_join(ft.split_tokens("qualified_name"), " ").alias("tokens"))


@query("fn08_path_label", sql(f"SELECT id, {LABEL} AS label FROM fil"))
def _(x):
    return x.files.select("id", fp.preferred_label("path").alias("label"))


@query("fn09_compact_key", sql("SELECT id, regexp_replace(lower(qualified_name), '[^a-z0-9]', '', 'g') AS key FROM sym"))
def _(x):
    return x.symbols.select("id", ft.compact_key("qualified_name").alias("key"))


@query("fn10_token_set", sql(f"SELECT id, array_to_string(list_sort({TOKENSET('qualified_name')}), ' ') AS tokens FROM sym"))
def _(x):
    return x.symbols.select("id", F.array_join(F.array_sort(ft.token_set("qualified_name")), " ").alias("tokens"))


@query("fn11_safe_path", f"SELECT DISTINCT path AS raw, CASE WHEN len(p) > 0 THEN array_to_string(p, '/') END AS safe FROM (SELECT path, {PARTS.replace('path', 'q')} AS p FROM (SELECT path, replace(trim(path), '\\', '/') AS q FROM file_records))")
def _(x):
    return x.raw("file_records").select(F.col("path").alias("raw"), fp.safe_path("path").alias("safe")).distinct()


@query("fn12_path_parts", sql(f"SELECT id, len({PARTS}) AS n, array_to_string({PARTS}, '|') AS parts FROM fil"))
def _(x):
    return x.files.select("id", F.size(fp.path_parts("path")).alias("n"), F.array_join(fp.path_parts("path"), "|").alias("parts"))


@query("fn13_within_modules", sql("SELECT DISTINCT f.id FROM fil f JOIN (SELECT DISTINCT m.path FROM (SELECT unnest(implementation_modules) AS m FROM cap) WHERE m.path IS NOT NULL) c ON f.path = c.path OR starts_with(f.path, c.path || '/')"))
def _(x):
    # Every ancestor of a file is probed by equality, so the prefix join is an equi join.
    mods = x.capabilities.select(F.explode("implementation_modules").alias("m")).select(fp.safe_path("m.path").alias("mod")).where("mod is not null").distinct()
    parts = fp.path_parts("path")
    up = x.files.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("mod"))
    return up.join(mods, "mod", "left_semi").select("id").distinct()


@query("fn14_slice_path", sql("SELECT path, path AS recovered FROM fil GROUP BY path"))
def _(x):
    known = x.files.select("path").distinct()
    return known.select("path", fp.slice_path(F.concat(F.lit("/tmp/w/source-slice/./"), F.col("path"))).alias("recovered")).join(known.withColumnRenamed("path", "recovered"), "recovered", "left_semi").select("path", "recovered")


@query("fn15_module_view", sql(f"SELECT id, {VIEW} AS view FROM fil"))
def _(x):
    return x.files.select("id", fp.module_view("path").alias("view"))


@query("fn16_category", sql(f"SELECT id, {CATEGORY} AS category FROM fil"))
def _(x):
    return x.files.select("id", fp.view_category("path").alias("category"))


@query("fn17_file_role", sql(f"SELECT id, {ROLE} AS role FROM fil"))
def _(x):
    return x.files.select("id", fp.file_role("path").alias("role"))


@query("fn18_test_path", sql(f"SELECT id FROM fil WHERE {TEST}"))
def _(x):
    return x.files.where(fp.is_test_path("path")).select("id")


@query("fn19_product_source", sql(f"SELECT id FROM fil WHERE language IN {_list(fp.PRODUCT_LANGUAGES)} AND NOT list_has_any({DIRS}, {_arr(fp.NON_PRODUCT_PARTS)}) AND NOT regexp_matches(lower({NAME}), '^(test_|spec_)') AND NOT regexp_matches(lower({NAME}), '\\.test\\.|\\.spec\\.|_test\\.go')"))
def _(x):
    return x.files.where(fp.is_product_source("path", F.col("language"))).select("id")


@query("fn20_test_source", sql(f"SELECT id FROM fil WHERE list_has_any({DIRS}, ['test','tests','testing','eval','evals']) OR regexp_matches(lower({NAME}), '^(test_|spec_)') OR regexp_matches(lower({NAME}), '\\.test\\.|\\.spec\\.|_test\\.go')"))
def _(x):
    return x.files.where(fp.is_test_source("path")).select("id")


@query("fn21_source_priority", sql(f"SELECT id, {PRIORITY} AS priority FROM fil"))
def _(x):
    return x.files.select("id", fp.source_priority("path").alias("priority"))


@query("fn22_nodes", sql("SELECT id, kind, name, qualified_name, symbol_kind, path, line, end_line, confidence, exported FROM node"))
def _(x):
    return x.nodes.select("id", "kind", "name", "qualified_name", "symbol_kind", "path", "line", "end_line", "confidence", "exported")


@query("fn23_token_estimate", sql("SELECT file_id, strlen(text)::BIGINT AS bytes, ceil(strlen(text) / 4.0)::BIGINT AS tokens FROM txt WHERE text IS NOT NULL"))
def _(x):
    return x.texts.where("text is not null").select("file_id", F.octet_length("text").cast("bigint").alias("bytes"), ft.estimated_tokens(F.octet_length("text")).cast("bigint").alias("tokens"))


@query("fn24_head_and_tail")
def _(x):
    return x.texts.where("text is not null").select("file_id", ft.head_and_tail("text", F.lit(600)).alias("excerpt"))


@query("fn25_diagram_label", sql("""SELECT id, replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(title, '[\r\n]+', ' ', 'g'), '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;'), '[', '('), ']', ')'), '{', '('), '}', ')'), '|', '/') AS label FROM feat"""))
def _(x):
    return x.features.select("id", ft.diagram_label("title").alias("label"))


ROUTE = "coalesce(list_filter(string_split(CASE WHEN entrypoint LIKE '% %' THEN regexp_extract(entrypoint, '^\\S+\\s+(.*)$', 1) ELSE '' END, '/'), lambda x: x <> '' AND NOT x LIKE '{%' AND lower(x) NOT IN ('api','v1','v2','v3'))[1], 'root') || ' API ' || coalesce(nullif(regexp_extract(entrypoint, '^\\S+'), ''), 'HTTP')"


@query("fn26_feature_title", sql(f"SELECT id, CASE WHEN kind = 'http-route' THEN {ROUTE} WHEN kind = 'cli-command' THEN coalesce(nullif(entrypoint, ''), 'root') || ' command flow' WHEN kind = 'entrypoint-candidate' THEN 'candidate execution flow' WHEN kind = 'entrypoint' THEN 'execution flow' ELSE 'collaboration flow' END AS label FROM feat"))
def _(x):
    e = F.trim(F.col("entrypoint"))
    segments = F.filter(F.split(F.regexp_extract(e, r"^\S+\s+(.*)$", 1), "/"), lambda s: (s != "") & ~s.startswith("{") & ~F.lower(s).isin("api", "v1", "v2", "v3"))
    method = F.regexp_extract(e, r"^\S+", 0)
    route = F.concat(F.coalesce(F.try_element_at(segments, F.lit(1)), F.lit("root")), F.lit(" API "), F.coalesce(F.when(method != "", method), F.lit("HTTP")))
    return x.features.select("id", F.when(F.col("kind") == "http-route", route).when(F.col("kind") == "cli-command", F.concat(F.coalesce(F.when(e != "", e), F.lit("root")), F.lit(" command flow")))
                             .when(F.col("kind") == "entrypoint-candidate", "candidate execution flow").when(F.col("kind") == "entrypoint", "execution flow").otherwise("collaboration flow").alias("label"))


@query("fn27_export_projection", sql("SELECT id, path, kind, line, end_line, confidence FROM sym"))
def _(x):
    return x.symbols.select("id", "path", "kind", "line", "end_line", "confidence")


@query("fn28_remote_identity", "SELECT DISTINCT name, regexp_replace(regexp_replace(lower(regexp_extract(remote, '^https://([^@?#]*)$', 1)), '/+$', ''), '\\.git$', '') AS identity FROM project_snapshots WHERE remote LIKE 'https://%'")
def _(x):
    return x.raw("project_snapshots").where("remote like 'https://%'").select("name", fp.remote_identity("remote").alias("identity")).distinct()


@query("fn29_report_slug", sql("SELECT id, substr(CASE WHEN s = '' THEN 'query' ELSE s END, 1, 80) AS slug FROM (SELECT id, regexp_replace(regexp_replace(lower(trim(title)), '[^\\p{L}\\p{N}_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM feat)"))
def _(x):
    return x.features.select("id", ft.report_slug("title").alias("slug"))


TAGS = {"Tree-sitter": ("tree-sitter", "treesitter"), "LSP": ("lsp", "language_server"), "SCIP": ("scip",), "Mermaid": ("mermaid",), "Git fingerprint": ("fingerprint", "change_detector", "incremental")}


@query("fn30_technology_tags", sql("SELECT project, t.tag FROM fil, (VALUES " + ", ".join(f"('{t}', '{'|'.join(n)}')" for t, n in TAGS.items()) + ") t(tag, needle) WHERE regexp_matches(lower(path), needle) GROUP BY ALL UNION "
       "SELECT project, language FROM (SELECT project, language, row_number() OVER (PARTITION BY project ORDER BY count(*) DESC, language) AS rn FROM fil WHERE language IS NOT NULL GROUP BY project, language) WHERE rn <= 4"))
def _(x):
    from pyspark.sql import Window

    counts = x.files.where("language is not null").groupBy("project", "language").count()
    top = counts.withColumn("rn", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("count"), "language"))).where("rn <= 4").select("project", F.col("language").alias("tag"))
    special = F.array_compact(F.array(*[F.when(F.lower("path").rlike("|".join(n)), F.lit(t)) for t, n in TAGS.items()]))
    return x.files.select("project", F.explode(special).alias("tag")).unionByName(top).distinct()


@query("fn31_bundle_module", sql(f"SELECT id, CASE WHEN len({PARTS}) < 2 THEN 'repository-root' ELSE array_to_string(list_slice({PARTS}, 1, least(len({PARTS}) - 1, 2)), '/') END AS module_path FROM fil"))
def _(x):
    return x.files.select("id", fp.bundle_module("path").alias("module_path"))


@query("fn32_single_json_object")
def _(x):
    return x.texts.where("path like '%.json'").select("file_id", ft.single_json_object("text").alias("object"))


@query("set09_ordered_distinct", sql("SELECT id, array_to_string(u, ',') AS ids FROM (SELECT id, list_transform(list_sort(list(struct_pack(p := p, e := e))), lambda y: y.e) AS u FROM (SELECT id, e, min(p) AS p FROM (SELECT id, unnest(evidence_ids) AS e, generate_subscripts(evidence_ids, 1) AS p FROM cap) WHERE e IS NOT NULL AND e <> '' GROUP BY id, e) GROUP BY id)"))
def _(x):
    return x.capabilities.select("id", F.array_join(ft.ordered_distinct("evidence_ids"), ",").alias("ids")).where("ids is not null and ids <> ''")
