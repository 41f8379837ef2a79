"""Running totals and positions over groups of any size.

A window over a group puts it into one task. Here the rows are range-partitioned by (group, order) and written; each part
is numbered by itself, the parts' totals (one row per part and group) are summed up ahead, and every row adds what came
before its part. One range shuffle, whatever one group holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import Workspace


def running(df: DataFrame, group: str, order: list[str], **values: Column) -> DataFrame:
    """df with position (from 1) and running_<name> (inclusive) of every value within the group in the given order."""
    ws = Workspace(df.sparkSession, "running")
    named = df.withColumns({f"_{k}": v for k, v in values.items()})
    parts = ws.write(named.repartitionByRange(F.col(group), *[F.col(o) for o in order]).withColumn("_part", F.spark_partition_id()), "parts")
    w = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = parts.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_{k}").alias(f"_t_{k}") for k in values])
    ahead = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(group, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_bn"), *[F.coalesce(F.sum(f"_t_{k}").over(ahead), F.lit(0)).alias(f"_b_{k}") for k in values])
    out = parts.join(before, [group, "_part"])
    return out.select(*df.columns, (F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) + F.col("_bn")).alias("position"),
                      *[(F.sum(f"_{k}").over(w) + F.col(f"_b_{k}")).alias(f"running_{k}") for k in values])
