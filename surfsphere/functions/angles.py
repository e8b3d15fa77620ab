"""Column expressions on angles, map projections and weights."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi
MAPS = ("equirect", "equirectangular", "hammer", "mollweide")


def clip(x: Column, lo: float, hi: float) -> Column:
    """As numpy's clip: NaN stays NaN (greatest and least would take it for the largest value)."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def wrap_angle(theta: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(theta + PI, F.lit(2 * PI)) - PI


def rotate(theta: Column, by: Column | float) -> Column:
    return wrap_angle(theta + by)


def spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(theta, phi) of a vector from the centre: longitude and colatitude; (0, pi/2) at the centre itself."""
    r = F.sqrt(x * x + y * y + z * z)
    near = r < 1e-12
    return F.when(near, F.lit(0.0)).otherwise(F.atan2(y, x)), F.when(near, F.lit(PI / 2)).otherwise(F.acos(clip(F.try_divide(z, r), -1.0, 1.0)))


def unit(theta: Column, phi: Column) -> tuple[Column, Column, Column]:
    return F.sin(phi) * F.cos(theta), F.sin(phi) * F.sin(theta), F.cos(phi)


def lonlat(theta: Column, phi: Column) -> tuple[Column, Column]:
    return theta, PI / 2 - phi


def project(theta: Column, phi: Column, name: str) -> tuple[Column, Column]:
    """Map coordinates; an unknown name is refused when the plan is made."""
    name = name.lower()
    if name not in MAPS:
        raise ValueError(f"Unknown map projection: {name}")
    lon, lat = lonlat(theta, phi)
    if name.startswith("equirect"):
        return lon, lat
    if name == "hammer":
        z = F.sqrt(1 + F.cos(lat) * F.cos(lon / 2))
        return F.try_divide(2 * math.sqrt(2) * F.cos(lat) * F.sin(lon / 2), z), F.try_divide(math.sqrt(2) * F.sin(lat), z)
    edge = PI / 2 - 1e-9
    lat = clip(lat, -edge, edge)
    rhs = PI * F.sin(lat)
    # Ten Newton steps, whatever they reach, as a fold over the step numbers; a flat spot, as at the poles, stands.
    t = F.aggregate(F.sequence(F.lit(1), F.lit(10)), lat, lambda t, _: t - F.coalesce(F.try_divide(2 * t + F.sin(2 * t) - rhs, 2 + 2 * F.cos(2 * t)), F.lit(0.0)))
    return (2 * math.sqrt(2) / PI) * lon * F.cos(t), math.sqrt(2) * F.sin(t)


def score_weight(score: Column, mode: str, worst: Column | None = None) -> Column | None:
    """Weight of a score (lower is better): none gives None; linear needs ``worst``, the greatest score of the set."""
    mode = mode.lower()
    if mode == "none":
        return None
    if mode == "exp":
        return F.exp(-score)
    if mode == "linear":
        return worst - score + 1e-6
    raise ValueError(f"Unknown weight mode: {mode}")


def distance(*pairs: tuple[Column, Column]) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in pairs[1:]), (pairs[0][0] - pairs[0][1]) * (pairs[0][0] - pairs[0][1])))


def angle_between(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.acos(clip(a[0] * b[0] + a[1] * b[1] + a[2] * b[2], -1.0, 1.0))
