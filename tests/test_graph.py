import random
from collections import deque

import pytest

from marlstone.operators import graph as g
from marlstone.operators.prefix import running

E = "id string, source_id string, target_id string, kind string"


def edges(spark, pairs, kind="calls"):
    return spark.createDataFrame([(f"e{i}", a, b, kind) for i, (a, b) in enumerate(pairs)], E)


def queue_order(pairs, seeds, depth, limit):
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    seen, q = dict.fromkeys(seeds[:limit], 0), deque(seeds[:limit])
    while q and len(seen) < limit:
        c = q.popleft()
        if seen[c] >= depth:
            continue
        for v in sorted(adj.get(c, ())):
            if v not in seen:
                seen[v] = seen[c] + 1
                q.append(v)
                if len(seen) >= limit:
                    break
    return seen


def test_literal_graph(spark):
    e = edges(spark, [("sym_route", "sym_service"), ("sym_service", "sym_store")])
    seeds = spark.createDataFrame([("q", "sym_service")], "seed string, id string")
    up = g.traverse(e, seeds, direction="reverse", depth=1, limit=None, kinds=g.CALL_KINDS).where("distance = 1")
    down = g.traverse(e, seeds, direction="forward", depth=1, limit=None, kinds=g.CALL_KINDS).where("distance = 1")
    assert [r.id for r in up.collect()] == ["sym_route"] and [r.id for r in down.collect()] == ["sym_store"]
    assert g.traverse(edges(spark, [("a", "b")], "contains"), seeds, direction="reverse", kinds=g.CALL_KINDS).where("distance > 0").count() == 0


def test_limit_binds_in_queue_order(spark):
    rng = random.Random(2)
    pairs = [(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(90)]
    for limit in (5, 17, 33):
        want = queue_order(pairs, ["n00"], 3, limit)
        got = g.traverse(edges(spark, pairs), spark.createDataFrame([("q", "n00")], "seed string, id string"), direction="both", depth=3, limit=limit)
        assert {r.id: r.distance for r in got.collect()} == want


def test_bad_arguments(spark):
    e, s = edges(spark, [("a", "b")]), spark.createDataFrame([("q", "a")], "seed string, id string")
    for bad in ({"direction": "up"}, {"depth": -1}, {"limit": 0}):
        with pytest.raises(ValueError):
            g.traverse(e, s, **bad)


def test_components_and_degrees(spark):
    rng = random.Random(4)
    pairs = [(f"x{rng.randrange(80)}", f"x{rng.randrange(80)}") for _ in range(60)] + [(f"y{i}", f"y{i + 1}") for i in range(60)] + [("hub", f"h{i}") for i in range(100)] + [("s", "s")]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {n: find(n) for n in root}
    assert {r.id: r.component for r in g.components(edges(spark, pairs)).collect()} == want
    d = {r.id: (r.in_degree, r.out_degree) for r in g.degrees(edges(spark, [("a", "b"), ("a", "b"), ("c", "b")])).collect()}
    assert d == {"a": (0, 1), "b": (2, 0), "c": (0, 1)}


def test_layers(spark):
    got = {r.id: (r.layer, r.cyclic) for r in g.layers(edges(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("p", "q"), ("q", "p")])).collect()}
    assert {k: got[k] for k in "abcd"} == {"a": (0, False), "b": (1, False), "c": (2, False), "d": (3, False)}
    assert got["p"][1] and got["q"][1] and got["p"][0] < got["q"][0]


def test_layers_of_a_long_chain(spark):
    """More layers than any fixed number of rounds, and a cycle behind them."""
    n = 70
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(n)] + [("n000", f"n{n:03}"), ("p", "q"), ("q", "p"), ("q", "r")]
    got = {r.id: (r.layer, r.cyclic) for r in g.layers(edges(spark, pairs)).collect()}
    assert all(got[f"n{i:03}"] == (i, False) for i in range(n + 1))
    assert [got[k] for k in "pqr"] == [(n + 1, True), (n + 2, True), (n + 3, True)]


def test_scopes_of_a_deep_tree(spark):
    from marlstone.operators.packs import expand_scopes

    deep = "/".join(f"d{i}" for i in range(40))
    rows = [("p", f"{deep}/a.py", 60), ("p", f"{deep}/b.py", 60), ("p", "d0/c.py", 5)]
    got = {r.scope: (r.bytes, r.fits) for r in expand_scopes(spark.createDataFrame(rows, "project string, path string, bytes bigint"), 100).collect()}
    assert got == {f"{deep}/a.py": (60, True), f"{deep}/b.py": (60, True), "d0/c.py": (5, True)}


def test_running_totals_over_parts(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), i, rng.randrange(9)) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = {(r.g, r.o): (r.position, r.running_t) for r in running(df, "g", ["o"], t=df.v).collect()}
    for key in "ab":
        total = 0
        for n, (_, o, v) in enumerate(sorted(r for r in rows if r[0] == key), 1):
            total += v
            assert got[(key, o)] == (n, total)
