"""Meshes as tables: neighbours, curvature proxy, smoothing, normals.

``vertices``: scope, vid, x, y, z. ``faces``: scope, fid, a, b, c (vids).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def neighbours(faces: DataFrame) -> DataFrame:
    """scope, vid, other: both directions of every edge, each once."""
    pairs = [(p, q) for p in "abc" for q in "abc" if p != q]
    both = F.explode(F.array(*(F.struct(F.col(p).alias("vid"), F.col(q).alias("other")) for p, q in pairs)))
    return faces.select("scope", both.alias("e")).select("scope", "e.vid", "e.other").where("vid <> other").distinct()


def laplacian(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """scope, vid, curvature: distance from the mean of the neighbours; 0 for a vertex without any."""
    other = vertices.select("scope", F.col("vid").alias("other"), *(F.col(c).alias(f"n{c}") for c in "xyz"))
    mean = neighbours(faces).join(other, ["scope", "other"]).groupBy("scope", "vid").agg(*(F.avg(f"n{c}").alias(f"m{c}") for c in "xyz"))
    d = F.sqrt(sum(((F.col(f"m{c}") - F.col(c)) ** 2 for c in "xyz"), F.lit(0.0)))
    return vertices.join(mean, ["scope", "vid"], "left").select("scope", "vid", F.coalesce(d, F.lit(0.0)).alias("curvature"))


def smooth(scalar: DataFrame, faces: DataFrame, rounds: int = 1) -> DataFrame:
    """scope, vid, value, replaced ``rounds`` times by the neighbours' mean; vertices without any keep theirs."""
    edges = neighbours(faces) if rounds > 0 else None
    for _ in range(rounds):
        mean = edges.join(scalar.select("scope", F.col("vid").alias("other"), "value"), ["scope", "other"]).groupBy("scope", "vid").agg(F.avg("value").alias("mean"))
        scalar = scalar.join(mean, ["scope", "vid"], "left").select("scope", "vid", F.coalesce("mean", "value").alias("value"))
    return scalar


def soup_curvature() -> Column:
    """Curvature proxy of the first corner of a triangle (ax .. cz) that shares no vertex: its two others are the neighbours."""
    return F.sqrt(sum((((F.col(f"b{c}") + F.col(f"c{c}")) / 2 - F.col(f"a{c}")) ** 2 for c in "xyz"), F.lit(0.0)))


def normal() -> list[Column]:
    """Unit normal (b - a) x (c - a) of a triangle ax .. cz; zeros for one without area."""
    u, v = ({c: F.col(f"{k}{c}") - F.col(f"a{c}") for c in "xyz"} for k in "bc")
    n = [u[q] * v[r] - u[r] * v[q] for q, r in (("y", "z"), ("z", "x"), ("x", "y"))]
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return [F.when(length < 1e-12, F.lit(0.0)).otherwise(F.try_divide(c, length)) for c in n]


def min_max(df: DataFrame, column: str, scope: list[str]) -> DataFrame:
    """``column`` stretched to 0..1 within its scope, NaN left aside and kept; ranges below 1e-12 give 0."""
    real = F.nanvl(F.col(column), F.lit(None).cast("double"))
    span = df.groupBy(*scope).agg(F.min(real).alias("lo"), F.max(real).alias("hi"))
    both = df.join(span, scope)
    return both.withColumn(column, F.when(F.col("hi") - F.col("lo") < 1e-12, F.lit(0.0)).otherwise(F.try_divide(F.col(column) - F.col("lo"), F.col("hi") - F.col("lo")))).drop("lo", "hi")
