"""Mixing sources to target weights by subset-sum budget fitting over exact token lengths.

The budget of the mixture is the largest total at which every source present can hold its share within its repeats,
unless one is given. A source first takes all its documents as often as the budget holds them; what remains is fitted
with single further uses: documents are counted by exact token length, a seeded share of every length is taken, and a
bounded-knapsack program over the lengths, of whatever size they are, fills the last part, so that the share is met to the
token where the lengths allow it. Which documents of a length are taken is decided by their seeded hash: lengths are cut
into parts of about ``PART`` documents by that hash, whole parts are taken or left by their counts, and only the one part
in which a quota ends is ranked.

Bounds: one source's program runs in one task over its distinct lengths (not its documents). To the driver come as many
rows as there are targets. Nothing is broadcast by hint.

Cases: shares are normalised over the sources present in both tables; null, unknown or repeated sources, texts without
tokens and targets without documents take no part; source names are compared in lower case, without white space around,
``-`` as ``_``. Empty tables give an empty mixture.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import Workspace

#: Documents of one length that are ranked at once.
PART = 20_000


def clean_source(c: str) -> Column:
    s = F.translate(F.lower(F.trim(F.col(c))), "- ", "__")
    return F.when(s != "", s)


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that the lengths add up to the budget, or as near below as they can.

    counts: length -> documents. A share of every length first, then the greedy remainder by length until the rest is
    small, then an exact bounded knapsack as shifts of a bit set, one binary part of a count at a time.
    """
    total = sum(n * c for n, c in counts.items())
    if budget >= total:
        return dict(counts)
    # Leave enough for the program to be exact, fill the surplus from the long end.
    room = max(4 * max((n for n in counts if n <= budget), default=0), 4096)
    take = {n: c * max(0, budget - room) // total for n, c in counts.items()}
    rest = budget - sum(n * k for n, k in take.items())
    for n in sorted(counts, reverse=True):
        if rest <= room:
            break
        k = min(counts[n] - take[n], (rest - room) // n)
        if k > 0:
            take[n] += k
            rest -= n * k
    mask = (1 << (rest + 1)) - 1
    seen = 1
    layers: list[tuple[int, int, int]] = []
    for n in sorted(counts):
        free = min(counts[n] - take[n], rest // n)
        part = 1
        while free > 0 and not seen >> rest & 1:
            k = min(part, free)
            new = (seen | seen << n * k) & mask
            if new != seen:
                layers.append((n, k, seen))
                seen = new
            free -= k
            part *= 2
        if seen >> rest & 1:
            break
    at = seen.bit_length() - 1
    for n, k, before in reversed(layers):
        if not before >> at & 1:
            take[n] += k
            at -= n * k
    return take


def plan_mixture(ws: Workspace, sized: DataFrame, targets: DataFrame, total: int | None) -> DataFrame:
    """sized (doc_id, source, n_tokens), targets (source, target_share, max_repeats) -> (source, n_tokens, docs, base, quota).

    Every document of a length is used ``base`` times, ``quota`` of them once more.
    """
    t = targets.select(clean_source("source").alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0")
    t = t.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    lengths = ws.write(sized.where("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("docs")).join(t.select("source"), "source", "left_semi"), "lengths")
    held = lengths.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("tokens")).join(t, "source").collect()
    whole = sum(r.target_share for r in held)
    if total is None:
        total = int(min((r.max_repeats * r.tokens * whole / r.target_share for r in held), default=0))
    wants = {r.source: divmod(min(int(r.target_share / whole * total + 0.5), r.max_repeats * r.tokens), r.tokens) for r in held}

    def solve(group: pa.Table) -> pa.Table:
        source = group.column("source")[0].as_py()
        base, rest = wants[source]
        counts = dict(zip(group.column("n_tokens").to_pylist(), group.column("docs").to_pylist()))
        take = fit(counts, rest)
        n = len(counts)
        return pa.table({"source": [source] * n, "n_tokens": list(counts), "docs": list(counts.values()), "base": pa.array([base] * n, pa.int32()), "quota": [take[k] for k in counts]})

    return ws.write(lengths.groupBy("source").applyInArrow(solve, "source string, n_tokens bigint, docs bigint, base int, quota bigint").where("base > 0 or quota > 0"), "plan")


def mix_sources(sized: DataFrame, targets: DataFrame, *, total: int | None = None, seed: int = 17) -> DataFrame:
    """(source, doc_id, n_tokens, repeats) of the documents used."""
    ws = Workspace(sized.sparkSession, "mix")
    sized = sized.select("doc_id", clean_source("source").alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens"))
    plan = plan_mixture(ws, sized, targets, total)
    key = ["source", "n_tokens", "part"]
    h = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    docs = sized.join(plan, ["source", "n_tokens"]).withColumn("h", h)
    docs = docs.withColumn("part", F.expr(f"cast(h * (1 + docs div {PART}) div {1 << 30} as int)"))
    # Parts before the quota's end are taken whole, those behind it left; positions count parts, not documents.
    sizes = docs.groupBy(*key).agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("source", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("ahead", before)
    placed = docs.join(sizes, key)
    ends = (F.col("ahead") < F.col("quota")) & (F.col("ahead") + F.col("c") > F.col("quota"))
    whole = placed.where(~ends).withColumn("extra", F.when(F.col("ahead") < F.col("quota"), 1).otherwise(0))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("h", "doc_id"))
    split = placed.where(ends).withColumn("extra", F.when(F.col("ahead") + rank <= F.col("quota"), 1).otherwise(0))
    used = whole.unionByName(split).withColumn("repeats", (F.col("base") + F.col("extra")).cast("int"))
    return used.where("repeats > 0").select("source", "doc_id", "n_tokens", "repeats")


def mixture_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents): one row per target, 0 where it has no documents."""
    used = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"))
    t = targets.select(clean_source("source").alias("source"), "target_share").where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    all_ = used.agg(F.sum("tokens").alias("all_tokens"))
    return t.join(used, "source", "left").crossJoin(all_).select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"))
