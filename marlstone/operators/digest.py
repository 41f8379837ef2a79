"""Digests over groups of any size, in two levels.

A digest over all rows of a group in order would put the group into one task. Here rows fall into 256 buckets by their
own hash; a bucket's rows are sorted and hashed, then the buckets' digests are hashed in order. The result depends on the
set of rows only, and the largest task holds a 256th of the largest group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_digest(df: DataFrame, group: list[str], row: Column, name: str = "digest") -> DataFrame:
    """(group..., name, rows)."""
    d = df.select(*group, row.alias("_row")).withColumn("_b", F.substring(F.sha1("_row"), 1, 2))
    inner = d.groupBy(*group, "_b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_row")), "\u001e"), 256).alias("_d"), F.count(F.lit(1)).alias("_n"))
    return inner.groupBy(*group).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_b", "_d"))), lambda x: x["_d"]), ""), 256).alias(name), F.sum("_n").alias("rows"))


def group_digest_sql(source: str, group: list[str], row: str, name: str = "digest") -> str:
    """The same as SQL over a relation."""
    g = ", ".join(group)
    return (f"SELECT {g}, sha256(string_agg(d, '' ORDER BY b)) AS {name}, sum(n)::BIGINT AS rows FROM (SELECT {g}, substr(sha1(r), 1, 2) AS b, sha256(string_agg(r, chr(30) ORDER BY r)) AS d, count(*) AS n "
            f"FROM (SELECT {g}, {row} AS r FROM {source}) GROUP BY {g}, b) GROUP BY {g}")
