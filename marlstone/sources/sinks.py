"""Sinks: immutable generations with a verified manifest, and stable JSON.

A generation is written to its own folder, every part is hashed by the executors, the manifest follows, and one small
pointer file is replaced at the end: readers see the old or the new generation, never a mixture. A writer that dies
leaves a folder nobody points at. Existing generations are never overwritten.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _write_small(path: str, text: str) -> None:
    tmp = f"{path}.{uuid.uuid4().hex}"
    with open(tmp, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


@contextmanager
def output_lock(output: str) -> Iterator[None]:
    """One writer at a time in a folder: a second one fails at once. The file stays; the lock ends with its holder, however that ends."""
    os.makedirs(output, exist_ok=True)
    with open(f"{output}/.writer.lock", "w", encoding="utf-8") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as e:
            raise RuntimeError(f"another writer holds {output}") from e
        yield


def _hashes(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    rel = F.expr(f"substring(regexp_replace(path, '^file:/+', '/'), {len(folder) + 2})")
    return raw.select(rel.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def publish(output: str, tables: dict[str, DataFrame]) -> str:
    """Writes a generation of named tables and points at it, alone in its folder; returns its id."""
    output = os.path.abspath(output)
    with output_lock(output):
        return _publish(output, tables)


def _publish(output: str, tables: dict[str, DataFrame]) -> str:
    spark = next(iter(tables.values())).sparkSession
    stage = f"{output}/stage-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{stage}/{name}")
    rows = sorted((r.path, r.size, r.sha256) for r in _hashes(spark, stage).collect())
    ident = hashlib.sha256("".join(f"{p}\0{s}\n" for p, _, s in rows).encode()).hexdigest()[:32]
    final = f"{output}/generation_id={ident}"
    _write_small(f"{stage}/manifest.json", json.dumps({"generation_id": ident, "parts": [{"path": p, "size": n, "sha256": s} for p, n, s in rows]}, sort_keys=True, separators=(",", ":")))
    if os.path.exists(final):
        raise FileExistsError(final)
    os.rename(stage, final)
    _write_small(f"{output}/current", ident)
    return ident


def verify(spark: SparkSession, output: str) -> DataFrame:
    """(path, problem) of the current generation: missing, unlisted or changed parts; empty where all holds."""
    output = os.path.abspath(output)
    with open(f"{output}/current", encoding="utf-8") as f:
        folder = f"{output}/generation_id={f.read().strip()}"
    listed = spark.read.option("multiLine", "true").schema("generation_id string, parts array<struct<path:string,size:bigint,sha256:string>>").json(f"{folder}/manifest.json").select(F.explode("parts").alias("p")).select("p.*")
    there = _hashes(spark, folder).select(F.col("path").alias("p2"), F.col("size").alias("n2"), F.col("sha256").alias("s2"))
    j = listed.join(there, F.col("path") == F.col("p2"), "full")
    problem = F.when(F.col("p2").isNull(), "missing").when(F.col("path").isNull(), "unlisted").when((F.col("sha256") != F.col("s2")) | (F.col("size") != F.col("n2")), "changed")
    return j.select(F.coalesce("path", "p2").alias("path"), problem.alias("problem")).where("problem is not null")


def read_current(spark: SparkSession, output: str, name: str, check: bool = True) -> DataFrame:
    """A table of the current generation, checked against its manifest first."""
    if check and (bad := verify(spark, output).limit(1).collect()):
        raise ValueError(f"{bad[0].path} is {bad[0].problem}")
    with open(f"{output}/current", encoding="utf-8") as f:
        return spark.read.parquet(f"{output}/generation_id={f.read().strip()}/{name}")


def json_lines(df: DataFrame) -> DataFrame:
    """One stable JSON text a row: fields in the order of their names, nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("json"))
