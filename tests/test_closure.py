from marlstone.plans.session import Workspace
from marlstone.queries_joins import closure_up


def test_closure_of_long_chains_and_cycles(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}" if i < 150 else None) for i in range(151)]
    rows = [*chain, ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("self", "self"), ("lost", "unknown"), ("below", "c100"), ("apart", "c000")]
    sym = spark.createDataFrame(rows, "id string, parent_id string")
    seeds = spark.createDataFrame([("c000",), ("r2",), ("self",), ("lost",), ("nowhere",), (None,), ("c000",)], "id string")
    got = [r.id for r in closure_up(Workspace(spark, "closure"), sym, seeds).collect()]
    assert sorted(got) == sorted([c for c, _ in chain] + ["r1", "r2", "r3", "self", "lost"])


def test_export_closure_has_ancestors_beyond_64_steps(spark, tmp_path):
    import marlstone.queries_joins as q
    from marlstone.catalog import Index

    class Fixture(Index):
        symbols = spark.createDataFrame([(f"c{i:03}", f"c{i + 1:03}" if i < 90 else None, f"f{i:03}") for i in range(91)], "id string, parent_id string, file_id string")
        features = spark.createDataFrame([("feat", "c000")], "id string, entry_symbol_id string")
        files = spark.createDataFrame([(f"f{i:03}",) for i in range(91)], "id string")
        evidence = spark.createDataFrame([("e", "feat")], "id string, feature_id string")

    rows = q.export_closure(Fixture(spark, str(tmp_path))).collect()
    assert sorted((r.id, r.kind) for r in rows) == sorted([(f"c{i:03}", "symbol") for i in range(91)] + [(f"f{i:03}", "file") for i in range(91)] + [("e", "evidence")])
