import datetime as dt
import random

from pyspark.sql import functions as F

from marlstone.operators.snapshots import snapshot_changes

T0 = dt.datetime(2025, 1, 1)


def changes(spark, files, snaps):
    f = spark.createDataFrame(files, "project string, commit string, path string, sha string, at timestamp, idx int, n string")
    s = spark.createDataFrame(snaps, "name string, commit string, analyzed timestamp, idx int")
    out = snapshot_changes(f, s, owner="project", version="commit", key=F.col("path"), digest=F.lower("sha"), delivered="at", snap_owner="name", snap_version="commit", snap_at="analyzed")
    return {tuple(r) for r in out.collect()}


def test_random_history(spark):
    rng = random.Random(1)
    snaps, files, want = [], [], set()
    for p in ("a", "b"):
        prev = None
        for i in range(8):
            c = f"{p}{i}"
            snaps += [(p, c, T0 + dt.timedelta(days=i), 0)] * 2
            cur = {f"f{k}": rng.choice(["x", "X", "y", None]) for k in range(12) if rng.random() < 0.6}
            files += [(p, c, k, v, T0, 1, None) for k, v in cur.items()]
            if prev is not None:
                low = lambda d: {k: v and v.lower() for k, v in d.items()}
                a, b = low(prev[1]), low(cur)
                want |= {(p, prev[0], c, k, "added") for k in b.keys() - a.keys()} | {(p, prev[0], c, k, "removed") for k in a.keys() - b.keys()} | {(p, prev[0], c, k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
            prev = (c, cur)
    rng.shuffle(files)
    assert changes(spark, files, snaps) == want


def test_latest_delivery_nulls_and_empty(spark):
    snaps = [("a", "1", T0, 0), ("a", "2", T0 + dt.timedelta(1), 0), (None, "3", T0, 0)]
    files = [("a", "1", "f", "x", T0, 0, None), ("a", "2", "f", "x", T0, 0, None), ("a", "2", "f", "y", T0 + dt.timedelta(1), 0, None), ("a", "1", None, "x", T0, 0, None), (None, "1", "f", "x", T0, 0, None), ("a", "9", "g", "x", T0, 0, None)]
    assert changes(spark, files, snaps) == {("a", "1", "2", "f", "changed")}
    assert changes(spark, [], snaps) == set() and changes(spark, files, []) == set()
