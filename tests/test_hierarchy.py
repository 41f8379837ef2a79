import datetime as dt
import random

from marlstone.operators.hierarchy import descendants, resolve_hierarchy

T0 = dt.datetime(2025, 1, 1)


def brute(parent):
    out = {}
    for n in parent:
        path, seen, cur = [n], {n}, n
        while True:
            p = parent[cur]
            if not p or p not in parent:
                out[n] = (cur, len(path) - 1)
                break
            if p in seen:
                out[n] = ("cycle", -1)
                break
            seen.add(p)
            path.append(p)
            cur = p
    return out


def run(spark, rows, **k):
    df = spark.createDataFrame(rows, "id string, parent string, at timestamp, root string, depth string")
    return {r.id: r for r in resolve_hierarchy(df, node="id", parent="parent", at="at", **k).collect()}


def rows_of(parent):
    return [(a, b, T0, "clash", "clash") for a, b in parent.items()]


def test_random_forests_with_cycles_and_chains(spark):
    rng = random.Random(5)
    parent = {f"n{i}": (f"n{rng.randrange(i)}" if i and rng.random() < 0.9 else rng.choice([None, "", "gone"])) for i in range(300)}
    parent |= {f"c{i}": f"c{(i + 1) % 17}" for i in range(17)} | {"below": "c3", "self": "self", "under": "below"}
    parent |= {f"k{i}": f"k{i - 1}" if i else None for i in range(150)}
    parent |= {f"hub{i}": "n0" for i in range(200)}
    want = brute(parent)
    got = run(spark, rows_of(parent), with_path=True)
    assert {k: (r.root, r.depth) for k, r in got.items()} == want
    for k, r in got.items():
        if r.depth >= 0:
            assert len(r.path) == r.depth + 1 and r.path[0] == r.root and r.path[-1] == k
            assert all(parent[b] == a for a, b in zip(r.path, r.path[1:]))


def test_short_cycles_without_splitters(spark):
    parent = {f"a{i}{s}": f"a{i}{'yx'[s == 'y']}" for i in range(40) for s in "xy"}
    assert all(r.root == "cycle" and r.depth == -1 for r in run(spark, rows_of(parent)).values())


def test_latest_row_holds_and_nulls_and_padding(spark):
    rows = [("a", None, T0, "", ""), ("b", "a", T0, "", ""), ("b", " a ", T0 + dt.timedelta(1), "", ""), (" b", None, T0 - dt.timedelta(1), "", ""), (None, "a", T0, "", ""), ("  ", "a", T0, "", ""), ("a", None, T0, "", "")]
    got = run(spark, rows)
    assert {k: (r.root, r.depth) for k, r in got.items()} == {"a": ("a", 0), "b": ("a", 1)}


def test_empty(spark):
    assert run(spark, []) == {}


def test_descendants(spark):
    df = spark.createDataFrame(rows_of({"a": None, "b": "a", "c": "b"}), "id string, parent string, at timestamp, root string, depth string")
    d = descendants(resolve_hierarchy(df, node="id", parent="parent", at="at", with_path=True))
    assert {(r.ancestor, r.descendant, r.distance) for r in d.collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
