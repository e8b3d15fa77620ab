"""Joins of tables whose keys are very unevenly filled: aggregate first, join compact states, roll up.

Problem 1. A join of raw rows sends every row of a hot key to one task. Both inputs are aggregated by the
join key with map-side combine, so a hot key costs one state per map task; the join then meets at most one
row per key on either side, and what the raw join would have produced follows algebraically: its row count
is the product of the two counts, a sum over one side is that side's sum times the other side's count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_states(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column] | None = None, prefix: str = "l") -> DataFrame:
    """One row per key: ``<prefix>_rows`` and a sum and non-null count per measure.

    Rows with a null key are dropped, they can't join. An empty table gives no row. A measure without any
    non-null value has the sum null.
    """
    aggs = [F.count(F.lit(1)).alias(f"{prefix}_rows")]
    aggs += [F.sum(c).alias(name) for name, c in (sums or {}).items()]
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*aggs)


def eager_join_sums(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_sums: Mapping[str, Column] | None = None,
    right_sums: Mapping[str, Column] | None = None,
    rollup: Sequence[str] = (),
) -> DataFrame:
    """What ``left.join(right, keys).groupBy(rollup).agg(count, sums...)`` gives, without joining raw rows.

    ``rollup`` is a part of ``keys`` (empty: one total row). Columns: rollup, ``join_rows``, then the sums
    under their names. Null keys join nothing; repeated rows multiply as in the raw join; other columns of
    the inputs never meet, so equal names do no harm. With no matching key there is no row, unless
    ``rollup`` is empty: then one row with join_rows 0 and null sums.
    """
    a, b = key_states(left, keys, left_sums, "l"), key_states(right, keys, right_sums, "r")
    joined = a.join(b, list(keys))
    sums = [F.sum(F.col(n) * F.col("r_rows")).alias(n) for n in left_sums or {}]
    sums += [F.sum(F.col(n) * F.col("l_rows")).alias(n) for n in right_sums or {}]
    rows = F.coalesce(F.sum(F.col("l_rows") * F.col("r_rows")), F.lit(0)).alias("join_rows")
    return joined.groupBy(*rollup).agg(rows, *sums)


def distinct_counts(df: DataFrame, keys: Sequence[str], item: str, name: str) -> DataFrame:
    """Number of different non-null ``item`` of each non-null key, without gathering a hot key's items.

    The items are made different by (key, item), which spreads a hot key over all tasks; only counts are
    then combined by key.
    """
    cols = [*keys, item]
    return df.select(*cols).dropna(subset=cols).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def stated_against_counted(poses: DataFrame, clusters: DataFrame) -> DataFrame:
    """run_id, cluster_id, n_stated_min, n_stated_max, n_counted of every pair that either table has.

    A pair without a summary, or with null figures only, has null n_stated_*; a pair without poses has
    n_counted 0. Repeated summaries collapse; were they to differ, the two bounds would show it.
    """
    keys = ["run_id", "cluster_id"]
    counted = distinct_counts(poses, keys, "pose_id", "n_counted")
    stated = (
        clusters.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.min("n_poses").alias("n_stated_min"), F.max("n_poses").alias("n_stated_max"))
    )
    return stated.join(counted, keys, "full").withColumn("n_counted", F.coalesce("n_counted", F.lit(0)))


def miscounted_clusters(poses: DataFrame, clusters: DataFrame) -> DataFrame:
    """run_id, cluster_id of the summaries whose non-null n_poses isn't the number of different poses."""
    both = stated_against_counted(poses, clusters)
    wrong = (F.col("n_stated_min") != F.col("n_counted")) | (F.col("n_stated_max") != F.col("n_counted"))
    return both.where(wrong).select("run_id", "cluster_id")
