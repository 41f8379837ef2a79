from types import SimpleNamespace

from marlstone import queries_graph as q

from test_graph import edges, queue_order

STATE = ("store", "cache", "queue")


def test_rankings_over_the_whole_slice(spark):
    # Seed one: state nodes and edges 2 to 5 away; seed two: a hub whose 180 nodes leave the last ones out.
    chain = [("a0", "a1"), ("a1", "a2"), ("a3_cache", "a2"), ("a3_cache", "a4_store"), ("a4_store", "a5_store")]
    hub = [("h", f"l{i:03}_queue") for i in range(200)] + [("h", "z_store")]
    pairs = chain + hub
    names = sorted({n for p in pairs for n in p})
    nodes = spark.createDataFrame([(n, n, "src/x.py", "function") for n in names], "id string, qualified_name string, path string, symbol_kind string")
    features = spark.createDataFrame([("one", "a0"), ("two", "h")], "id string, entry_symbol_id string")
    x = SimpleNamespace(spark=spark, edges=edges(spark, pairs), nodes=nodes, features=features)

    seen = {"one": queue_order(pairs, ["a0"], q.SLICE_DEPTH, q.SLICE_NODES), "two": queue_order(pairs, ["h"], q.SLICE_DEPTH, q.SLICE_NODES)}
    assert "a4_store" in seen["one"] and "a5_store" not in seen["one"] and "z_store" not in seen["two"] and len(seen["two"]) == 180
    state, keyed, steps, shown = set(), set(), set(), {}
    for f, d in seen.items():
        ranked = sorted(n for n in d if n.endswith(STATE))
        state |= {(f, i + 1, n, 1) for i, n in enumerate(ranked[:4])}
        keyed |= {(f, i + 1, e) for i, e in enumerate(sorted(f"e{i}" for i, (a, b) in enumerate(pairs) if a in d and b in d)[:4])}
        order = sorted(d, key=lambda n: (d[n], n))
        steps |= {(f, "core" if i else "trigger", n) for i, n in enumerate(order[:3])} | {(f, "state", n) for n in ranked[:2] if n not in order[:3]}
        shown[f] = (len(d), ",".join(order[:12]))
    rows = lambda d: {tuple(r) for r in d.collect()}
    assert rows(q.slice_state_nodes(x).select("seed", "position", "id", "score")) == state
    assert rows(q.slice_key_edges(x).select("seed", "position", "id")) == keyed
    assert rows(q.slice_steps(x).select("seed", "role", "id")) == steps
    assert {r.seed: (r.nodes, r.first_nodes) for r in q.slice_projection(x).collect()} == shown
