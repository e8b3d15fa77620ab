"""Render-ready layer tables: labels, seams, graticules, centroids."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import angles, chem
from ..operators.clusters import outline
from ..operators.components import components
from ..sources.writers import fixed

#: Fixed order of the pose layers, from the top.
POSE_LAYERS = ("centroid", "scatter", "trace", "hexbin", "density")


def labelled(poses: DataFrame, threshold: float) -> DataFrame:
    """Adds raw_label: a scope's components from 0 by their lowest pose_idx (a window over components, not poses)."""
    found = components(poses.select("scope", F.col("pose_idx").alias("pid"), "theta", "phi"), threshold)
    heads = found.select("scope", "first_pid").distinct().withColumn("raw_label", F.row_number().over(Window.partitionBy("scope").orderBy("first_pid")) - 1)
    return poses.join(found.withColumnRenamed("pid", "pose_idx").dropDuplicates(["scope", "pose_idx"]), ["scope", "pose_idx"]).join(heads, ["scope", "first_pid"]).drop("first_pid")


def angular_pairs(points: DataFrame, threshold: float) -> DataFrame:
    """scope, pid, other (pid < other), angle of points at most ``threshold`` radians apart.

    Points meet over cubes of the sphere of the threshold's chord, each point in its own and its neighbours.
    """
    size = 2 * math.sin(min(threshold, math.pi) / 2) * (1 + 1e-9)
    u = angles.unit(F.col("theta"), F.col("phi"))
    p = points.select("scope", "pid", *(c.alias(f"u{a}") for c, a in zip(u, "xyz"))).withColumns({f"c{a}": F.floor(F.col(f"u{a}") / size) for a in "xyz"})
    q = p.select("scope", F.col("pid").alias("other"), *(F.col(f"u{a}").alias(f"w{a}") for a in "xyz"), *(F.col(f"c{a}") for a in "xyz"))
    for a in "xyz":
        q = q.withColumn(f"c{a}", F.explode(F.array(*(F.col(f"c{a}") + i for i in (-1, 0, 1)))))
    met = p.join(q, ["scope", "cx", "cy", "cz"]).where("pid < other")
    angle = angles.angle_between(tuple(F.col(f"u{a}") for a in "xyz"), tuple(F.col(f"w{a}") for a in "xyz"))
    return met.withColumn("angle", angle).where(F.col("angle") <= threshold).select("scope", "pid", "other", "angle")


def auto_seam(theta: Column, weight: Column | None = None) -> Column:
    """Rotation (an aggregate) that turns the mean direction to longitude 0."""
    w = F.lit(1.0) if weight is None else weight
    return -F.atan2(F.sum(w * F.sin(theta)), F.sum(w * F.cos(theta)))


def pose_labels(poses: DataFrame, scope: Sequence[str], mode: str, top: int = 5) -> DataFrame:
    """Adds label: the ligand's for the chosen poses, else empty. Modes none, first, best, topN."""
    if mode not in ("none", "first", "best", "topN"):
        raise ValueError(f"Unknown pose label mode: {mode}")
    order = ["pose_idx"] if mode == "first" else ["score", "pose_idx"]
    k = {"none": 0, "first": 1, "best": 1, "topN": max(1, top)}[mode]
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    return poses.withColumn("_k", rank).withColumn("label", F.when(F.col("_k") <= k, chem.ligand_label(F.col("pose_id"))).otherwise("")).drop("_k")


def centroid_layer(stats: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Adds text and outline to ranked clusters with score_avg and p_value."""
    best = F.min("score_avg").over(Window.partitionBy(*scope))
    two = fixed(".2f")
    text = F.concat(F.col("rank").cast("string"), F.lit(":"), F.col("n_poses").cast("string"), F.lit("\n<"), F.coalesce(two("score_avg"), F.lit("nan")), F.lit(">"))
    return stats.withColumn("best", best).withColumn("outline", outline(F.col("p_value"), F.col("score_avg"), F.col("best"))).withColumn("text", text)


def palette(rank: Column, last: Column) -> Column:
    """Position of the cluster of a rank on a diverging colour map: from 1 for the first to 0 for the last one."""
    return F.when(last == 1, 1.0).otherwise(1.0 - F.try_divide(rank - 1, last - 1))


def graticule(spark: SparkSession, name: str) -> DataFrame:
    """kind, degrees, k, x, y: reference lines of the map, meridians every 60 and parallels every 30 degrees."""
    lines = spark.createDataFrame(
        [("theta", g, 220) for g in (-120, -60, 0, 60, 120)] + [("phi", g, 300) for g in (30, 60, 90, 120, 150)], "kind string, degrees int, n int"
    ).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    share = F.col("k") / (F.col("n") - 1)
    meridian = F.col("kind") == "theta"
    fixed_angle = F.radians(F.col("degrees"))
    theta = F.when(meridian, fixed_angle).otherwise(-math.pi + share * 2 * math.pi)
    phi = F.when(meridian, 1e-3 + share * (math.pi - 2e-3)).otherwise(fixed_angle)
    x, y = angles.project(theta, phi, name)
    return lines.select("kind", "degrees", "k", x.alias("x"), y.alias("y"))


def normal_layers(chosen: Sequence[str] | None) -> list[str]:
    """Chosen pose layers (each may be a comma list) without repeats, in the fixed order; density by default."""
    parts = [p.strip().lower() for c in chosen or [] for p in str(c).split(",") if p.strip()] or ["density"]
    bad = [p for p in parts if p not in POSE_LAYERS]
    if bad:
        raise SystemExit(f"Invalid pose layer(s): {', '.join(bad)}. Valid: {', '.join(POSE_LAYERS)}")
    return [p for p in POSE_LAYERS if p in parts]
