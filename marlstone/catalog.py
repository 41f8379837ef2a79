"""The index views every operator reads: the latest row of each record, keys cleaned, and the resolved graph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import clean_key, clean_path
from .functions.paths import safe_path
from .plans.session import table


def latest(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """One row per key: the greatest (order, cols); an aggregation, so it combines before the shuffle."""
    held = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *cols)).alias("r"))
    return held.select(key, *[F.col(f"r.{c}").alias(c) for c in [order, *cols]])


@dataclass
class Index:
    """Lazy views over one folder of tables."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def files(self) -> DataFrame:
        f = self.raw("file_records").withColumns({"id": clean_key("id"), "path": clean_path("path"), "sha256": F.lower("sha256"), "project": clean_key("project")})
        return latest(f, "id", "recorded_at", ["commit", "path", "project", "language", "size", "lines", "sha256", "module", "structural_sha256", "has_structural_analysis"])

    @cached_property
    def symbols(self) -> DataFrame:
        s = self.raw("symbols").withColumns({"id": clean_key("id"), "parent_id": clean_key("parent_id"), "file_id": clean_key("file_id"), "project": clean_key("project"), "path": clean_path("path")})
        cols = ["deleted_at", "project", "file_id", "path", "name", "qualified_name", "kind", "line", "end_line", "analyzer", "confidence", "parent_id", "signature", "exported"]
        return latest(s, "id", "recorded_at", cols).where("deleted_at is null").drop("deleted_at")

    @cached_property
    def relationships(self) -> DataFrame:
        r = self.raw("relationships").withColumns({"id": clean_key("id"), "source_id": clean_key("source_id"), "target_id": clean_key("target_id"), "project": clean_key("project"), "path": clean_path("path")})
        return latest(r, "id", "recorded_at", ["project", "source_id", "target_id", "target_name", "kind", "path", "line", "analyzer", "confidence", "receiver_type_hint"])

    @cached_property
    def features(self) -> DataFrame:
        f = self.raw("features").withColumns({"id": clean_key("id"), "entry_symbol_id": clean_key("entry_symbol_id"), "project": clean_key("project")})
        return latest(f, "id", "recorded_at", ["deleted_at", "project", "title", "kind", "entrypoint", "confidence", "source", "entry_symbol_id"]).where("deleted_at is null").drop("deleted_at")

    @cached_property
    def evidence(self) -> DataFrame:
        e = self.raw("evidence_items").withColumns({"id": clean_key("id"), "feature_id": clean_key("feature_id"), "project": clean_key("project"), "path": clean_path("path")})
        return latest(e, "id", "recorded_at", ["deleted_at", "project", "feature_id", "path", "symbol", "line_start", "line_end", "reason", "sha256", "snippet"]).where("deleted_at is null").drop("deleted_at")

    @cached_property
    def capabilities(self) -> DataFrame:
        c = self.raw("capabilities").withColumn("id", clean_key("id"))
        return latest(c, "id", "recorded_at", ["project", "title", "summary", "importance", "source_feature_ids", "evidence_ids", "implementation_modules"])

    @cached_property
    def texts(self) -> DataFrame:
        """One row per file. Texts of files that come once, nearly all, are not shuffled for it; of several the greatest row holds (the table tells no times)."""
        t = self.raw("source_texts").withColumns({"file_id": clean_key("file_id"), "path": clean_path("path")}).where("file_id is not null").select("file_id", "path", "project", "text")
        more = t.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("file_id")
        several = t.join(more, "file_id", "left_semi").groupBy("file_id").agg(F.max(F.struct("path", "project", "text")).alias("r")).select("file_id", "r.path", "r.project", "r.text")
        return t.join(more, "file_id", "left_anti").unionByName(several)

    @cached_property
    def nodes(self) -> DataFrame:
        """Symbols and files as graph nodes; a symbol wins over a file of the same id."""
        s = self.symbols.select("id", F.lit("symbol").alias("kind"), "name", "qualified_name", F.col("kind").alias("symbol_kind"), "path", "line", "end_line", "confidence",
                                F.coalesce("exported", F.lit(False)).alias("exported"), "project", "file_id")
        f = self.files.select("id", F.lit("file").alias("kind"), F.col("path").alias("name"), F.col("path").alias("qualified_name"), F.lit("file").alias("symbol_kind"), "path", F.lit(1).alias("line"),
                              F.col("lines").alias("end_line"), F.lit("exact").alias("confidence"), F.lit(False).alias("exported"), "project", F.col("id").alias("file_id"))
        return s.unionByName(f.join(s.select("id"), "id", "left_anti"))

    @cached_property
    def edges(self) -> DataFrame:
        """Relationships whose ends both exist."""
        ids = self.symbols.select("id").unionByName(self.files.select("id")).distinct()
        r = self.relationships.where("source_id is not null and target_id is not null")
        return (
            r.join(ids.withColumnRenamed("id", "s"), F.col("source_id") == F.col("s"), "left_semi")
            .join(ids.withColumnRenamed("id", "t"), F.col("target_id") == F.col("t"), "left_semi")
            .select("id", "project", "source_id", "target_id", "target_name", "kind", "path", "line", "confidence", "analyzer")
        )

    @cached_property
    def safe_paths(self) -> DataFrame:
        return self.files.select("id", safe_path("path").alias("path"))


def K(c: str) -> str:
    """SQL: a cleaned key."""
    return f"nullif(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '')"


def P(c: str) -> str:
    """SQL: a cleaned path."""
    return f"regexp_replace(replace({c}, '\\', '/'), '^(\\./)+', '')"


def _latest_sql(name: str, source: str, cols: dict[str, str], extra: str = "") -> str:
    picks = ", ".join(f"{e} AS {c}" for c, e in cols.items())
    order = ", ".join(f"{c} DESC NULLS LAST" for c in cols if c != "id")
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC NULLS LAST, {order}) AS rn FROM (SELECT {picks}, recorded_at FROM {source}) WHERE id IS NOT NULL) WHERE rn = 1{extra})"


_PLAIN = lambda *names: {n: n for n in names}

#: SQL views of the same names for the checks.
VIEWS = ",\n".join([
    _latest_sql("fil", "file_records", {"id": K("id"), "commit": "commit", "path": P("path"), "project": K("project"), **_PLAIN("language", "size", "lines"), "sha256": "lower(sha256)", **_PLAIN("module", "structural_sha256", "has_structural_analysis")}),
    _latest_sql("sym", "symbols", {"id": K("id"), "deleted_at": "deleted_at", "project": K("project"), "file_id": K("file_id"), "path": P("path"), **_PLAIN("name", "qualified_name", "kind", "line", "end_line", "analyzer", "confidence"),
                                   "parent_id": K("parent_id"), **_PLAIN("signature", "exported")}, " AND deleted_at IS NULL"),
    _latest_sql("rel", "relationships", {"id": K("id"), "project": K("project"), "source_id": K("source_id"), "target_id": K("target_id"), **_PLAIN("target_name", "kind"), "path": P("path"),
                                         **_PLAIN("line", "analyzer", "confidence", "receiver_type_hint")}),
    _latest_sql("feat", "features", {"id": K("id"), "deleted_at": "deleted_at", "project": K("project"), **_PLAIN("title", "kind", "entrypoint", "confidence", "source"), "entry_symbol_id": K("entry_symbol_id")}, " AND deleted_at IS NULL"),
    _latest_sql("ev", "evidence_items", {"id": K("id"), "deleted_at": "deleted_at", "project": K("project"), "feature_id": K("feature_id"), "path": P("path"), **_PLAIN("symbol", "line_start", "line_end", "reason", "sha256", "snippet")}, " AND deleted_at IS NULL"),
    _latest_sql("cap", "capabilities", {"id": K("id"), **_PLAIN("project", "title", "summary", "importance", "source_feature_ids", "evidence_ids", "implementation_modules")}),
    f"txt AS (SELECT * EXCLUDE rn FROM (SELECT {K('file_id')} AS file_id, {P('path')} AS path, project, text, row_number() OVER (PARTITION BY {K('file_id')} ORDER BY {P('path')} DESC NULLS LAST, project DESC NULLS LAST, text DESC NULLS LAST) AS rn FROM source_texts) WHERE rn = 1 AND file_id IS NOT NULL)",
    """node AS (SELECT id, 'symbol' AS kind, name, qualified_name, kind AS symbol_kind, path, line, end_line, confidence, coalesce(exported, false) AS exported, project, file_id FROM sym
  UNION ALL SELECT id, 'file', path, path, 'file', path, 1, lines, 'exact', false, project, id FROM fil WHERE id NOT IN (SELECT id FROM sym))""",
    "edge AS (SELECT id, project, source_id, target_id, target_name, kind, path, line, confidence, analyzer FROM rel WHERE source_id IN (SELECT id FROM node) AND target_id IN (SELECT id FROM node))",
])


def sql(body: str) -> str:
    """A check over the views; the body may begin with further views and a comma."""
    return "WITH RECURSIVE " + VIEWS + (",\n" if not body.lstrip().upper().startswith("SELECT") else "\n") + body
