import random

from marlstone.operators.ranges import overlapping_ranges, places_in_ranges


def test_against_all_pairs(spark):
    rng = random.Random(4)
    ranges = [(i, rng.choice("pq"), a := rng.randrange(1, 400), a + rng.choice([-3, 0, 1, 7, 40, 300, 2_000_000_000 - a])) for i in range(150)] + [(900, "p", None, 3), (901, None, 1, 9)]
    spans = [(i, rng.choice("pq"), a := rng.randrange(1, 400), a + rng.choice([-6, 0, 2, 90])) for i in range(200)] + [(900, "p", 4, None), (901, None, 1, 9)]
    r = spark.createDataFrame(ranges, "r int, scope string, lo int, hi int")
    p = spark.createDataFrame(spans, "p int, scope string, a int, b int")
    same = lambda x, y: x[1] is not None and x[1] == y[1] and None not in x + y
    got = sorted((x.p, x.r) for x in places_in_ranges(p, r, ["scope"], "a", "lo", "hi").collect())
    assert got == sorted((x[0], y[0]) for x in spans + [] for y in ranges if x[1] is not None and x[1] == y[1] and x[2] is not None and y[2] is not None and y[2] <= x[2] <= y[3])
    got = sorted((x.p, x.r) for x in overlapping_ranges(p, r, ["scope"], "a", "b", "lo", "hi").collect())
    assert got == sorted((x[0], y[0]) for x in spans for y in ranges if same(x, y) and x[2] <= y[3] and y[2] <= x[3] and not (y[3] < y[2] and not x[2] < y[2] <= x[3]))


def test_a_file_of_many_calls_and_symbols_makes_no_product(spark):
    n = 3000
    places = spark.range(n).selectExpr("id", "'f' as path", "id * 10 + 5 as line")
    ranges = spark.range(n).selectExpr("id as symbol", "'f' as path", "id * 10 as a", "id * 10 + 9 as b")
    assert places_in_ranges(places, ranges, ["path"], "line", "a", "b").where("id = symbol").count() == n
