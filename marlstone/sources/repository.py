"""Sources: repository trees, index JSON, code graphs, reviewed profiles; all with explicit schemas."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import EXCLUDED_DIRS, clean_remote, language_of, module_of
from ..functions.text import line_count, stable_id

FILE_SCHEMA = "id string, path string, language string, size bigint, lines int, sha256 string, module string, symbols array<string>, structural_sha256 string, has_structural_analysis boolean, analysis_sha256 string"
SYMBOL_SCHEMA = "id string, file_id string, path string, name string, qualified_name string, kind string, line int, end_line int, analyzer string, confidence string, parent_id string, signature string, exported boolean"
RELATIONSHIP_SCHEMA = "id string, source_id string, target_id string, target_name string, kind string, path string, line int, analyzer string, confidence string, receiver_type_hint string"
INDEX_SCHEMA = f"project struct<name:string, path:string, commit:string, remote:string, license:string>, files array<struct<{FILE_SCHEMA}>>, symbols array<struct<{SYMBOL_SCHEMA}>>, relationships array<struct<{RELATIONSHIP_SCHEMA}>>"
PROFILE_SCHEMA = "name string, summary string, features array<struct<id:string, title:string, sources:array<struct<path:string, line_start:int, line_end:int, sha256:string>>>>, _corrupt string"


def scan_tree(spark: SparkSession, root: str, max_file_size: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(files with text, counters by reason) of a directory, read in parallel as binary files.

    Excluded directories, unsupported names, oversized, binary and undecodable files are counted by reason.
    """
    root = os.path.abspath(root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.expr(f"substring(regexp_replace(path, '^file:/+', '/'), {len(root) + 2})")
    d = raw.select(path.alias("path"), F.col("length").alias("size"), "content", F.col("modificationTime").alias("modified"))
    text = F.try_validate_utf8(F.col("content").cast("string")) if hasattr(F, "try_validate_utf8") else F.col("content").cast("string")
    d = d.withColumns({"language": language_of("path"), "dirs": F.split("path", "/"), "text": text})
    reason = (
        F.when(F.arrays_overlap("dirs", F.array(*[F.lit(x) for x in EXCLUDED_DIRS])), "excluded_directory")
        .when(F.col("language").isNull(), "unsupported").when(F.col("size") > max_file_size, "too_large")
        .when(F.instr(F.hex(F.substring("content", 1, 8192)), "00") % 2 == 1, "binary").when(F.col("text").isNull(), "not_utf8").otherwise("indexed")
    )
    d = d.withColumn("reason", reason)
    files = d.where("reason = 'indexed'").select(stable_id("file", "path").alias("id"), "path", "language", "size", line_count("text").alias("lines"), F.sha2("content", 256).alias("sha256"), module_of("path").alias("module"), "text")
    return files, d.groupBy("reason").agg(F.count(F.lit(1)).alias("files"))


def tree_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified): what must be equal before and after a run for the tree to have been stable."""
    root = os.path.abspath(root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select(F.expr(f"substring(regexp_replace(path, '^file:/+', '/'), {len(root) + 2})").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def is_stable(before: DataFrame, after: DataFrame) -> bool:
    return before.exceptAll(after).limit(1).count() == 0 and after.exceptAll(before).limit(1).count() == 0


def repository_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """One row of version-control facts; null where the folder is no working copy. A driver-side step."""

    def git(*a: str) -> str | None:
        try:
            r = subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, timeout=20)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return r.stdout.strip() if r.returncode == 0 else None

    commit = git("rev-parse", "HEAD")
    status = git("status", "--porcelain") if commit else None
    schema = T.StructType([T.StructField(n, T.BooleanType() if n in ("is_git", "dirty") else T.StringType()) for n in ("name", "path", "commit", "branch", "remote", "is_git", "dirty")])
    row = (os.path.basename(os.path.abspath(root)), os.path.abspath(root), commit, git("rev-parse", "--abbrev-ref", "HEAD") if commit else None, git("remote", "get-url", "origin") if commit else None, commit is not None, None if status is None else bool(status))
    return spark.createDataFrame([row], schema).withColumn("remote", clean_remote("remote"))


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Collections of an index JSON; unknown fields are dropped by the schema."""
    doc = spark.read.schema(INDEX_SCHEMA).option("multiLine", "true").json(path)
    return {"project": doc.select("project.*"), **{c: doc.select(F.explode(c).alias("r")).select("r.*") for c in ("files", "symbols", "relationships")}}


def read_graph(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of an external code graph kept as Parquet, ordered keys checked by schema."""
    n = spark.read.parquet(nodes).select("id", "kind", "qualified_name", "file_path", "start_line", "end_line")
    e = spark.read.parquet(edges).select("id", "kind", "source", "target", "line")
    return n, e


def load_profile(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Sources of a reviewed profile bound to the files they name; a malformed document raises, an unsafe path is dropped by the join."""
    doc = spark.read.schema(PROFILE_SCHEMA).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    s = doc.select(F.explode("features").alias("f")).select("f.id", "f.title", F.explode("f.sources").alias("s")).select("id", "title", "s.*")
    lines = files.select("path", F.split("text", "\n").alias("l"))
    j = s.join(lines, "path", "left")
    now = F.sha2(F.array_join(F.slice("l", F.col("line_start"), F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(1))), "\n"), 256)
    return j.select("id", "title", "path", "line_start", "line_end", F.coalesce(now == F.col("sha256"), F.lit(False)).alias("holds"))
