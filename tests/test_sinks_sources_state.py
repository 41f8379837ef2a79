import datetime as dt
import os

import pytest

from marlstone.operators import packs
from marlstone.operators.resolve import first_match, import_candidates, unique_match
from marlstone.sources import repository as rp
from marlstone.sources import sinks
from marlstone.streaming.incremental import IncrementalIndex
from pyspark.sql import functions as F


def test_generations(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.range(20).withColumn("x", F.col("id") * 2)
    ident = sinks.publish(out, {"t": df})
    assert sinks.verify(spark, out).count() == 0
    assert sinks.read_current(spark, out, "t").count() == 20
    part = next(f for f in os.listdir(f"{out}/generation_id={ident}/t") if f.startswith("part"))
    os.remove(f"{out}/generation_id={ident}/t/.{part}.crc")
    with open(f"{out}/generation_id={ident}/t/{part}", "ab") as f:
        f.write(b"x")
    assert [r.problem for r in sinks.verify(spark, out).collect()] == ["changed"]
    with pytest.raises(ValueError):
        sinks.read_current(spark, out, "t")


def test_one_writer_at_a_time(spark, tmp_path):
    out = str(tmp_path / "locked")
    with sinks.output_lock(out):
        with pytest.raises(RuntimeError):
            sinks.publish(out, {"t": spark.range(1)})
    assert sinks.publish(out, {"t": spark.range(1)})


def test_scan_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.py").write_bytes(b"\x00\x01")
    (tmp_path / "src/c.bin").write_text("x")
    (tmp_path / "src/d.md").write_text("y" * 50)
    (tmp_path / "node_modules/e.js").write_text("z")
    files, counters = rp.scan_tree(spark, str(tmp_path), max_file_size=40)
    assert [r.path for r in files.collect()] == ["src/a.py"]
    assert {r.reason: r.files for r in counters.collect()} == {"indexed": 1, "binary": 1, "unsupported": 1, "too_large": 1, "excluded_directory": 1}
    before = rp.tree_manifest(spark, str(tmp_path))
    assert rp.is_stable(before, rp.tree_manifest(spark, str(tmp_path)))
    assert rp.repository_snapshot(spark, str(tmp_path)).first().is_git is False


def test_index_json_and_profile(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"project": {"name": "p"}, "unknown": 1, "files": [{"id": "f", "path": "a.py", "lines": 2, "extra": 3}], "symbols": [], "relationships": [{"id": "r", "source_id": "f"}]}')
    got = rp.read_index(spark, str(tmp_path / "i.json"))
    assert got["files"].first().path == "a.py" and got["symbols"].count() == 0 and got["relationships"].first().target_id is None
    import hashlib

    good = hashlib.sha256(b"b\nc").hexdigest()
    (tmp_path / "p.json").write_text('{"name": "n", "features": [{"id": "x", "title": "t", "sources": [{"path": "a.py", "line_start": 2, "line_end": 3, "sha256": "%s"}, {"path": "../z", "line_start": 1, "line_end": 1, "sha256": ""}]}]}' % good)
    files = spark.createDataFrame([("a.py", "a\nb\nc\nd")], "path string, text string")
    assert {r.path: r.holds for r in rp.load_profile(spark, str(tmp_path / "p.json"), files).collect()} == {"a.py": True, "../z": False}


def test_resolution(spark):
    refs = spark.createDataFrame([("r1", "a"), ("r2", "b"), ("r3", "c")], "ref_id string, name string")
    cand = spark.createDataFrame([("a", "s1"), ("a", "s1"), ("b", "s2"), ("b", "s3")], "name string, cand_id string")
    assert [tuple(r) for r in unique_match(refs, cand, ["name"]).collect()] == [("r1", "s1")]
    imports = spark.createDataFrame([("i1", "src/x/a.ts", "../y/b.js", "TypeScript"), ("i2", "src/a.ts", "./logo.svg", "TypeScript"), ("i3", "src/a.ts", "./dir", "TypeScript")], "ref_id string, path string, target string, language string")
    files = spark.createDataFrame([("src/y/b.ts", "B"), ("src/logo.ts", "L"), ("src/dir/index.ts", "D")], "key string, cand_id string")
    got = first_match(imports, import_candidates(F.col("path"), F.col("target"), F.col("language")), files)
    assert {r.ref_id: r.target for r in got.collect()} == {"i1": "B", "i3": "D"}


def test_packs(spark):
    units = spark.createDataFrame([("p", f"u{i}", w) for i, w in enumerate([9, 7, 5, 3, 1, 1, 1, 1])], "project string, unit string, weight bigint")
    loads = {}
    for r in packs.balance_shards(units, "project", "unit", "weight", 3).collect():
        loads[r.shard] = loads.get(r.shard, 0) + r.weight
    assert sorted(loads.values()) == [9, 9, 10]
    split = packs.split_by_budget(units, "project", "unit", "weight", 10).collect()
    assert len(split) == 8 and all(r.shard_bytes <= 10 for r in split)
    files = spark.createDataFrame([("p", "a/b/x.py", 60), ("p", "a/c/y.py", 60), ("p", "d/z.py", 10)], "project string, path string, bytes bigint")
    assert {(r.scope, r.owner, r.fits) for r in packs.expand_scopes(files, 100).collect()} == {("a/b", "a", True), ("a/c", "a", True), ("d", "d", True)}
    hints = spark.createDataFrame([("p", "1", ["a", "b"]), ("p", "2", ["c", "d", "e"]), ("p", "3", ["a", None]), ("p", "4", None)], "project string, id string, items array<string>")
    assert [r.accepted for r in sorted(packs.greedy_pack(hints, "project", "id", "items", 3).collect(), key=lambda r: r.id)] == [True, False, True, True]


def test_incremental_stream(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    t = dt.datetime(2025, 1, 1)
    s = "file_id string, path string, text string, recorded_at timestamp"
    spark.createDataFrame([("1", "a.py", "def f(): pass", t), ("2", "b.py", "def g(): pass", t)], s).coalesce(1).write.parquet(src)
    ix = IncrementalIndex(spark, state)
    ix.run(src, str(tmp_path / "cp"))
    assert {r.name for r in ix.table("facts").where("tag = 'symbol'").collect()} == {"f", "g"}
    spark.createDataFrame([("1", "a.py", "def h(): pass", t)], s).coalesce(1).write.mode("append").parquet(src)
    ix.run(src, str(tmp_path / "cp"))
    assert {r.name for r in ix.table("facts").where("tag = 'symbol'").collect()} == {"g", "h"}
    v = ix.version
    ix.apply(spark.createDataFrame([], s), v)
    assert ix.version == v
