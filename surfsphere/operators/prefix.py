"""Running sums that don't gather a long sequence into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions per part.
PART = 50_000


def running_sum(df: DataFrame, scope: Sequence[str], position: str, value: str, name: str, part: int = PART) -> DataFrame:
    """Adds the sum of ``value`` over the scope's rows up to each row's integer ``position``, itself included.

    Sums of parts of ``part`` positions are summed up first (a row per part), then the rows within a part.
    Rows of equal position all count for each other. Null values count as 0.
    """
    d = df.withColumn("_part", F.floor(F.col(position) / part))
    sums = d.groupBy(*scope, "_part").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_sum")
    inside = F.sum(value).over(Window.partitionBy(*scope, "_part").orderBy(position).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(sums, [*scope, "_part"])
    return d.withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside")
