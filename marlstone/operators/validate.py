"""Validation as check queries: every check is a filter or an anti join that emits (severity, code, entity_id) rows.

Checks are registered by name and united; one that finds nothing adds nothing. None collects: an index of any size is
checked in as many joins as it has references.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Index
from ..functions.text import stable_id

SYMBOL_KINDS = ["async-function", "class", "function", "interface", "interface-method", "method", "struct", "type"]
RELATIONSHIP_KINDS = ["calls", "contains", "import", "receiver-type", "go-import-alias"]
CHECKS: dict = {}


def check(code: str, severity: str = "error"):
    def add(f):
        CHECKS[code] = lambda x: f(x).select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col("id").alias("entity_id"))
        return f

    return add


@check("unsafe-path")
def _(x: Index) -> DataFrame:
    return x.files.where("path is null or path like '/%' or array_contains(split(path, '/'), '..')")


@check("unstable-file-id")
def _(x):
    return x.files.where(F.col("id") != stable_id("file", "path"))


@check("malformed-symbol-id")
def _(x):
    return x.symbols.where("not id rlike '^symbol_[0-9a-f]{16}$'")


@check("unsupported-symbol-analyzer")
def _(x):
    return x.symbols.where("not coalesce(analyzer in ('python-ast', 'javascript-regex') or analyzer like 'go-%', false)")


@check("unsupported-symbol-kind")
def _(x):
    return x.symbols.where(~F.coalesce(F.col("kind").isin(SYMBOL_KINDS), F.lit(False)))


@check("dangling-file-ref")
def _(x):
    f = x.files.select(F.col("id").alias("file_id"), "path")
    return x.symbols.join(f, ["file_id", "path"], "left_anti")


@check("invalid-symbol-range")
def _(x):
    f = x.files.select(F.col("id").alias("file_id"), "lines")
    return x.symbols.join(f, "file_id").where("line is null or end_line is null or line < 1 or end_line < line or end_line > coalesce(lines, 0)")


@check("dangling-parent-ref")
def _(x):
    p = x.symbols.select(F.col("id").alias("parent_id"), "path")
    return x.symbols.where("parent_id is not null").join(p, ["parent_id", "path"], "left_anti")


@check("malformed-relationship-id")
def _(x):
    return x.relationships.where("not id rlike '^rel_[0-9a-f]{16}$'")


@check("unsupported-relationship-kind")
def _(x):
    return x.relationships.where(~F.coalesce(F.col("kind").isin(RELATIONSHIP_KINDS), F.lit(False)))


@check("dangling-source-ref")
def _(x):
    return x.relationships.join(x.nodes.select(F.col("id").alias("source_id")), "source_id", "left_anti")


@check("relationship-path-mismatch")
def _(x):
    n = x.nodes.select(F.col("id").alias("source_id"), F.col("path").alias("npath"))
    return x.relationships.join(n, "source_id").where("path is distinct from npath")


@check("dangling-target-ref")
def _(x):
    return x.relationships.where("target_id is not null").join(x.nodes.select(F.col("id").alias("target_id")), "target_id", "left_anti")


@check("missing-relationship-target")
def _(x):
    return x.relationships.where("coalesce(target_name, '') = ''")


@check("invalid-relationship-range")
def _(x):
    f = x.files.select("project", "path", "lines")
    return x.relationships.join(f, ["project", "path"], "left").where("lines is null or line is null or line < 1 or line > lines")


@check("relationship-target-kind-mismatch")
def _(x):
    files = x.nodes.where("kind = 'file'").select(F.col("id").alias("target_id"))
    return x.relationships.where("kind in ('calls', 'contains', 'receiver-type')").join(files, "target_id", "left_semi")


@check("evidence-digest-malformed")
def _(x):
    return x.evidence.where("not coalesce(lower(sha256) rlike '^[0-9a-f]{64}$', false)")


@check("invalid-evidence-range")
def _(x):
    return x.evidence.where("line_start is null or line_end is null or line_start < 1 or line_end < line_start")


@check("dangling-evidence-feature", "warning")
def _(x):
    return x.evidence.where("feature_id is not null").join(x.features.select(F.col("id").alias("feature_id")), "feature_id", "left_anti")


@check("dangling-entry-symbol", "warning")
def _(x):
    return x.features.where("entry_symbol_id is not null").join(x.symbols.select(F.col("id").alias("entry_symbol_id")), "entry_symbol_id", "left_anti")


@check("feature-without-evidence", "warning")
def _(x):
    return x.features.join(x.evidence.select(F.col("feature_id").alias("id")), "id", "left_anti")


@check("empty-capability", "warning")
def _(x):
    return x.capabilities.where("coalesce(size(source_feature_ids), 0) <= 0")


def validate_index(x: Index, codes: list[str] | None = None) -> DataFrame:
    """Issues of all checks, or of those named."""
    return reduce(DataFrame.unionByName, [CHECKS[c](x) for c in (codes or list(CHECKS))])


def rejection(x: Index) -> DataFrame:
    """(project, reason): the first reason, in the order of the checks, for which a project's index can't be reused."""
    order = {c: i for i, c in enumerate(CHECKS)}
    owners = x.files.select("id", "project").unionByName(x.symbols.select("id", "project")).unionByName(x.relationships.select("id", "project")).distinct()
    rank = F.create_map(*[F.lit(v) for c, i in order.items() for v in (c, i)])
    issues = validate_index(x).where("severity = 'error'").join(owners, F.col("entity_id") == F.col("id"))
    return issues.groupBy("project").agg(F.min(F.struct(rank[F.col("code")].alias("o"), "code"))["code"].alias("reason"))
