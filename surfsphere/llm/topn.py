"""The N best items of every group, whatever the groups' sizes (problem 4).

A score histogram per group, combined on the map side, gives a threshold bin that at least N different
items reach. Rows beyond it are dropped before anything is shuffled. What is left is made one row an item,
which spreads a group over all tasks, and ranked exactly, with the tie key: in parts first, the parts' best
again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Thresholds are sent to all tasks for that many of the largest groups; any other group has at most
#: rows / LARGEST rows and is ranked whole. Every group is ranked in PARTS first.
LARGEST, PARTS = 20_000, 16
#: Items that a mask of 64 bits is to tell apart.
ITEMS = 24
#: Bins of a group's histogram on either side of zero; scores beyond fall into the outermost bins.
BINS = 512


def score_bin(score: Column, width: float) -> Column:
    return F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(score / width))).cast("int")


def thresholds(valid: DataFrame, groups: Sequence[str], item: str, score: str, n: int, width: float) -> DataFrame:
    """groups, n_rows, last_bin: no item beyond last_bin can be among the n lowest (null: no such bin).

    A bin's state are its row count and bits, of which each item sets one by its hash. Repeated rows set the
    same bit, so the number of bits set over the bins up to some bin never exceeds that of different items in
    them; where it reaches n, they hold n items at least. There are as many masks of 64 bits as n asks for.
    """
    masks = -(-n // ITEMS)
    code = F.xxhash64(item)
    mask = F.pmod(F.shiftright(code, 6), F.lit(masks)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(code, F.lit(64)).cast("int"))
    bins = valid.groupBy(*groups, score_bin(F.col(score), width).alias("bin"), mask.alias("mask")).agg(F.count(F.lit(1)).alias("rows"), F.bit_or(bit).alias("bits"))
    up_to = Window.partitionBy(*groups, "mask").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*groups, "mask").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.bit_count(F.bit_or("bits").over(up_to)) - F.bit_count(F.coalesce(F.bit_or("bits").over(before), F.lit(0)))
    by_bin = bins.withColumn("fresh", fresh).groupBy(*groups, "bin").agg(F.sum("rows").alias("rows"), F.sum("fresh").alias("fresh"))
    items = F.sum("fresh").over(Window.partitionBy(*groups).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    safe = by_bin.withColumn("items", items)
    return safe.groupBy(*groups).agg(F.sum("rows").alias("n_rows"), F.min(F.when(F.col("items") >= n, F.col("bin"))).alias("last_bin"))


def top_n(df: DataFrame, groups: Sequence[str], item: str, score: str, n: int = 3, width: float = 0.25) -> DataFrame:
    """groups, item, score, rank of the n different items with the lowest score; equal scores: lower item.

    Rows with a null group, item or score, or a NaN or infinite score, don't count. An item that comes
    several times counts once, with its lowest score. A group with fewer items gives all of them, an empty
    table nothing. Other columns are ignored.
    """
    cols = [*groups, item, score]
    valid = df.select(*cols).dropna(subset=cols).where(F.abs(F.col(score)) < float("inf"))
    limits = thresholds(valid, groups, item, score, n, width).where(F.col("last_bin").isNotNull() & (F.col("n_rows") > 16 * n))
    large = F.broadcast(limits.orderBy(F.desc("n_rows")).limit(LARGEST).drop("n_rows"))
    kept = valid.join(large, list(groups), "left").where(F.col("last_bin").isNull() | (score_bin(F.col(score), width) <= F.col("last_bin")))
    # One row an item: a group's items are spread over all tasks, and copies are combined before the shuffle.
    kept = kept.groupBy(*groups, item).agg(F.min(score).alias(score))
    # Many equal scores can keep a large group large: it's ranked in parts, the parts' best again.
    order = [F.col(score).asc(), F.col(item).asc()]
    part = Window.partitionBy(*groups, "part").orderBy(*order)
    best = kept.withColumn("part", F.pmod(F.xxhash64(item), F.lit(PARTS)).cast("int")).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= n)
    whole = Window.partitionBy(*groups).orderBy(*order)
    return best.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= n).drop("part")


def best_poses(poses: DataFrame, n: int = 3) -> DataFrame:
    return top_n(poses, ["run_id", "cluster_id"], "pose_id", "vina_score", n)
