import datetime as dt
import random

from marlstone.operators.orphans import OrphanTracker, live_intervals, span_number, spans

T0 = dt.datetime(2025, 1, 1)
P = "key string, recorded_at timestamp, deleted_at timestamp"
R = "ref_table string, ref_field string, ref_id string, key string, shown string, at timestamp"


def day(n):
    return T0 + dt.timedelta(days=n)


def feed(spark, parents, refs, n, fold=None):
    p, r = spark.createDataFrame(parents, P), spark.createDataFrame(refs, R)
    tr = OrphanTracker(spark)
    if fold:
        tr.FOLD = fold
    cuts = spans(r.select("at"), at="at", n=n)
    for k, s in enumerate(cuts):
        tr.step(p.where(span_number("recorded_at", cuts) == k), r.where(span_number("at", cuts) == k), s)
    return tr


def alive(parents, key, t):
    return any(p[0] == key and p[1] is not None and p[1] <= t and (p[2] is None or p[2] > t) for p in parents)


def test_against_brute_force_in_spans(spark):
    rng = random.Random(3)
    parents = [(f"k{rng.randrange(30)}", day(rng.randrange(90)), rng.choice([None, day(rng.randrange(120))])) for _ in range(200)]
    refs = [(rng.choice("tu"), "f", f"r{i}", f"k{rng.choice([0, 0, 0, rng.randrange(45)])}", "k", day(rng.randrange(90))) for i in range(300)]
    want = {r[2] for r in refs if not alive(parents, r[3], r[5])}
    for n, fold in ((1, None), (4, None), (5, 2)):
        tr = feed(spark, parents, refs, n, fold)
        assert {x.ref_id for x in tr.orphans().collect()} == want
        for at in (day(30), day(60)):
            assert {x.ref_id for x in tr.open_at(at).collect()} == {x[2] for x in refs if x[5] <= at and not alive(parents, x[3], at)}
        got = {(x.ref_table, x.period): (x.refs, x.open) for x in tr.open_counts().collect()}
        for m, end in (("2025-01", day(31)), ("2025-02", day(59)), ("2025-03", day(90))):
            last = end - dt.timedelta(microseconds=1)
            for t in "tu":
                made = [x for x in refs if x[0] == t and x[5] < end]
                assert got[t, m] == (len(made), sum(not alive(parents, x[3], last) for x in made)), (n, t, m)


def moves(tr):
    import functools

    rows = functools.reduce(lambda a, b: a.unionByName(b), tr.moves).orderBy("at").collect()
    return [(r.key, (r.at - T0).days, r.kind, r.n) for r in rows]


def test_arrivals_resolve_and_deletions_reopen_in_later_steps(spark):
    """The deletion is known from the first step, and takes effect in the third; the parent comes back in the fourth."""
    parents = [("k", day(5), day(65)), ("k", day(80), None), ("other", day(1), None)]
    refs = [("t", "f", "early", "k", "k", day(0)), ("t", "f", "twice", "k", "k", day(2)), ("t", "f", "live", "k", "k", day(30)), ("t", "f", "gone", "k", "k", day(70)), ("t", "f", "end", "x", "x", day(100))]
    tr = feed(spark, parents, refs, 4)
    assert {r.ref_id for r in tr.orphans().collect()} == {"early", "twice", "gone", "end"}
    assert moves(tr) == [("k", 0, "opened", 1), ("k", 2, "opened", 1), ("k", 5, "resolved", 2), ("k", 65, "reopened", 3), ("k", 70, "opened", 1), ("k", 80, "resolved", 4), ("x", 100, "opened", 1)]
    assert {r.ref_id for r in tr.open_at(day(40)).collect()} == set() and {r.ref_id for r in tr.open_at(day(72)).collect()} == {"early", "twice", "live", "gone"}


def test_a_step_touches_its_own_keys(spark):
    """A step of three rows writes the state of their keys, however many keys the state holds."""
    parents = [(f"k{i}", day(1), None) for i in range(500)] + [("k1", day(60), day(61))]
    refs = [("t", "f", f"r{i}", f"k{i}", "k", day(2)) for i in range(500)] + [("t", "f", "late", "k1", "k", day(90))]
    tr = feed(spark, parents, refs, 2)
    assert tr.live[0].count() == 500 and tr.live[1].count() == 1 and tr.made[1].count() == 1 and tr.moves[1].count() == 0


def test_intervals_merge(spark):
    rows = [("a", day(0), day(5)), ("a", day(3), day(8)), ("a", day(9), None), ("a", day(20), None), ("b", None, None), (None, day(1), None), ("c", day(5), day(4))]
    got = {(r.key, r.live_from) for r in live_intervals(spark.createDataFrame(rows, P)).collect()}
    assert got == {("a", day(0)), ("a", day(9))}


def test_empty_tables(spark):
    tr = feed(spark, [], [], 3)
    assert tr.orphans().count() == 0 and tr.open_counts().count() == 0 and tr.open_at(day(1)).count() == 0
