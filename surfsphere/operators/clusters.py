"""Statistics of clusters of poses: ranks, centroids, spreads and Welch's test against the best cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.angles import clip, unit
from ..functions.stats import t_two_sided, welch_moments


def moments(poses: DataFrame, scope: Sequence[str], label: str) -> DataFrame:
    """Mergeable statistics of each cluster; ties for the best pose go to the lowest pose_idx.

    A mean direction of length zero falls back to the first member's angles. Poses without a score count as
    members only; ``n_scored`` is the number of the others.
    """
    by_score = F.when(F.col("score").isNotNull(), F.struct("score", "pose_idx"))
    u = unit(F.col("theta"), F.col("phi"))
    out = poses.groupBy(*scope, label).agg(
        F.count(F.lit(1)).alias("n_poses"), F.count("score").alias("n_scored"), F.min_by("pose_id", by_score).alias("best_pose_id"), F.min("score").alias("score_min"), F.max("score").alias("score_max"),
        F.avg("score").alias("score_avg"), F.stddev_pop("score").alias("score_stddev"), F.var_samp("score").alias("score_var"),
        *(F.avg(c).alias(f"m{a}") for c, a in zip(u, "xyz")), F.min_by(F.struct("theta", "phi"), "pose_idx").alias("head"),
    )
    r = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz"))
    none = r == 0
    theta = F.when(none, F.col("head.theta")).otherwise(F.atan2("my", "mx"))
    phi = F.when(none, F.col("head.phi")).otherwise(F.acos(clip(F.try_divide("mz", r), -1.0, 1.0)))
    return out.withColumns({"theta_centroid": theta, "phi_centroid": phi}).drop("mx", "my", "mz", "head")


def ranked(stats: DataFrame, scope: Sequence[str], label: str) -> DataFrame:
    """Adds ``rank``: from 1 by size, then best score, then label. A window over clusters, not poses."""
    order = Window.partitionBy(*scope).orderBy(F.desc("n_poses"), F.asc_nulls_last("score_min"), label)
    return stats.withColumn("rank", F.row_number().over(order))


def tested(stats: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Adds t, dof and p_value of each cluster's scores against those of the cluster of lowest mean (ties: lowest rank)."""
    first = Window.partitionBy(*scope).orderBy(F.asc_nulls_last("score_avg"), "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = stats.withColumn("ref", F.first(F.struct("n_scored", "score_avg", "score_var")).over(first))
    t, dof, known = welch_moments(F.col("ref.n_scored"), F.col("ref.score_avg"), F.col("ref.score_var"), F.col("n_scored"), F.col("score_avg"), F.col("score_var"))
    out = out.withColumns({"t": t, "dof": dof})
    return out.withColumn("p_value", F.coalesce(known, t_two_sided("t", "dof"))).drop("ref")


def summary(poses: DataFrame, scope: Sequence[str], label: str) -> DataFrame:
    """The clusters' table: ids by rank, statistics, p-value against the best cluster, centroid."""
    s = tested(ranked(moments(poses, scope, label), scope, label), scope)
    return s.select(
        *scope, F.col("rank").alias("cluster_id"), "n_poses", "best_pose_id", F.col("score_min").alias("best_vina_score"), F.col("score_min").alias("vina_score_min"),
        F.col("score_max").alias("vina_score_max"), F.col("score_avg").alias("vina_score_avg"), F.col("score_stddev").alias("vina_score_stddev"), "p_value", "theta_centroid", "phi_centroid", label,
    )


def order_poses(poses: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Adds ``position`` from 1 in the output order: cluster, score, pose_id as text."""
    return poses.withColumn("position", F.row_number().over(Window.partitionBy(*scope).orderBy("cluster_id", "score", "pose_id")))


def trace_poses(poses: DataFrame, scope: Sequence[str], mode: str) -> DataFrame:
    """Poses to trace: first, best, or the N best; equal scores by pose_idx. Ranks from 1 as ``trace_rank``."""
    m = mode.strip().lower()
    order = ["pose_idx"] if m == "first" else ["score", "pose_idx"]
    if m not in ("first", "best") and not (m.isdigit() and int(m) >= 1):
        raise ValueError(f"Invalid trace pose: {mode!r} (best, first or a number)")
    k = int(m) if m.isdigit() else 1
    return poses.withColumn("trace_rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).where(F.col("trace_rank") <= k)


def outline(p_value, average, best):
    """Colour of a centroid's outline: red if its mean is close to the best one's, lime if it differs significantly, else white."""
    close = F.abs(average - best) <= 1e-8 + 1e-5 * F.abs(best)
    return F.when(close, "red").when(p_value < 0.05, "lime").otherwise("white")
