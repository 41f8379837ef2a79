"""Resolution of references: unique-match joins, candidate-order joins, longest-prefix joins.

A reference resolves only where exactly one candidate remains; candidates come by equality on composite keys and are
counted by distinct identity, so a symbol known under two names is still one. Order matters where the reference tries
candidates in turn: positions are exploded beside them and the least position that joins wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_match(refs: DataFrame, candidates: DataFrame, on: list[str], ref: str = "ref_id", cand: str = "cand_id") -> DataFrame:
    """(ref, target): references with exactly one distinct candidate on equal keys."""
    j = refs.join(candidates, on).groupBy(ref).agg(F.count_distinct(cand).alias("n"), F.min(cand).alias("target"))
    return j.where("n = 1").select(ref, "target")


def first_match(refs: DataFrame, candidates: Column, known: DataFrame, ref: str = "ref_id", key: str = "key", cand: str = "cand_id", scope: list[str] | None = None) -> DataFrame:
    """(ref, target): the first of an array of candidate keys that is known, within equal scope columns."""
    scope = scope or []
    tried = refs.select(ref, *scope, F.posexplode(candidates).alias("pos", key))
    return tried.join(known.select(key, cand, *scope), [key, *scope]).groupBy(ref).agg(F.min_by(cand, F.struct("pos", cand)).alias("target"))


def prefixes(c: Column, sep: str) -> Column:
    """All leading runs of parts, longest first."""
    parts = F.split(c, f"\\Q{sep}\\E")
    n = F.size(parts)
    return F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), sep))


def normal_path(c: Column) -> Column:
    """a/b/../c and ./a -> a/c and a, as far as the path does not climb above its root."""
    parts = F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))), "/")


def import_candidates(path: Column, target: Column, language: Column) -> Column:
    """Paths a relative import may mean, in the order of trying."""
    base = normal_path(F.concat_ws("/", F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")), target))
    ends = F.lower(F.regexp_extract(base, r"[^/](\.[^./]+)$", 1))
    stem = F.regexp_replace(base, r"(?<=[^/])\.[^./]+$", "")
    with_ends = lambda b, *e: [F.concat(b, F.lit(x)) for x in e]
    bare = F.array(base, *with_ends(stem, ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), *with_ends(stem, *[f"/index{e}" for e in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")]))
    emitted = F.array(base, *with_ends(stem, ".ts", ".tsx"))
    script = F.when(ends == "", bare).when(ends.isin(".js", ".jsx", ".mjs", ".cjs"), emitted).otherwise(F.array(base))
    return F.when(language.isin("JavaScript", "TypeScript"), script).otherwise(F.array(base, *with_ends(stem, ".py", "/__init__.py")))
