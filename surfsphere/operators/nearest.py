"""Nearest targets and first hits of rays.

Vertices: the points and vertices of a scope meet in a task, where blocks of points skip the blocks of vertices
that lie too far away. Scopes of many rows are cut into cells first, which get the vertices of a margin around
them too; points that may have a closer one outside it go on to larger cells, in the end to the whole scope.

Triangles are gathered into boxes of two tiers. A point keeps the boxes of a tier whose nearest corner isn't
farther than the farthest corner of its best box, and only meets the targets in the boxes that are left. Each
step is an equi join on the tier's key; no point meets all targets of a large structure. The formulas are SQL
text, so that the brute-force twins can state the same metric.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import durable
from .runs import in_runs

#: Edges of the boxes of the two tiers, in the unit of the coordinates.
TIERS = (64.0, 8.0)
#: Coarse boxes that are sent to all tasks; more of them are joined by a shuffle, in which AQE splits large scopes.
SENT = 200_000
#: Rows up to which a scope, and points and vertices of a cell each, are one group of a task.
GROUP = 50_000
#: Edges of the cells of larger scopes, and their margins; so many points or less go on to the whole scope at once.
CELLS = ((64.0, 8.0), (512.0, 64.0), (4096.0, 512.0))
FEW = 10_000
#: Points and vertices of a block, and pairs that are always compared at once.
BLOCK, PAIRS = (64, 32), 300_000

Stages = Sequence[dict[str, str]]


def _dot(a: str, b: str) -> str:
    return f"({a}x * {b}x + {a}y * {b}y + {a}z * {b}z)"


def _minus(name: str, a: str, b: str) -> dict[str, str]:
    return {f"{name}{c}": f"({a}{c} - {b}{c})" for c in "xyz"}


def _cross(name: str, a: str, b: str) -> dict[str, str]:
    return {f"{name}{p}": f"({a}{q} * {b}{r} - {a}{r} * {b}{q})" for p, q, r in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))}


def _share(num: str, den: str) -> str:
    return f"CASE WHEN {den} = 0 THEN 0.0e0 ELSE {num} / {den} END"


def _unit(e: str) -> str:
    return f"greatest(0.0e0, least(1.0e0, {e}))"


#: Closest point (qx, qy, qz) of triangle (ax .. cz) to (px, py, pz) and its squared distance d2: the foot of
#: the perpendicular if it lies inside, else the closest point of the three sides.
TRIANGLE: Stages = (
    {**_minus("u", "b", "a"), **_minus("v", "c", "a"), **_minus("s", "c", "b"), **_minus("w", "p", "a"), **_minus("o", "p", "b")},
    {"uu": _dot("u", "u"), "uv": _dot("u", "v"), "vv": _dot("v", "v"), "wu": _dot("w", "u"), "wv": _dot("w", "v"), "ss": _dot("s", "s"), "os": _dot("o", "s")},
    {"det": "(uu * vv - uv * uv)"},
    {"fb": _share("(vv * wu - uv * wv)", "det"), "fc": _share("(uu * wv - uv * wu)", "det"), "t1": _unit(_share("wu", "uu")), "t2": _unit(_share("wv", "vv")), "t3": _unit(_share("os", "ss"))},
    {
        **{f"k{c}": f"(a{c} + fb * u{c} + fc * v{c})" for c in "xyz"}, **{f"l{c}": f"(a{c} + t1 * u{c})" for c in "xyz"},
        **{f"m{c}": f"(a{c} + t2 * v{c})" for c in "xyz"}, **{f"n{c}": f"(b{c} + t3 * s{c})" for c in "xyz"},
    },
    {f"d{c}": " + ".join(f"(p{a} - {c}{a}) * (p{a} - {c}{a})" for a in "xyz") for c in "klmn"},
    {"inside": "(det > 0 AND fb >= 0 AND fc >= 0 AND fb + fc <= 1)"},
    {"side": "CASE WHEN inside THEN 0 WHEN dl <= dm AND dl <= dn THEN 1 WHEN dm <= dn THEN 2 ELSE 3 END"},
    {"d2": "CASE side WHEN 0 THEN dk WHEN 1 THEN dl WHEN 2 THEN dm ELSE dn END", **{f"q{c}": f"CASE side WHEN 0 THEN k{c} WHEN 1 THEN l{c} WHEN 2 THEN m{c} ELSE n{c} END" for c in "xyz"}},
)
#: Squared distance to a vertex (ax, ay, az), which is its own closest point.
VERTEX: Stages = ({"d2": " + ".join(f"(p{c} - a{c}) * (p{c} - a{c})" for c in "xyz"), **{f"q{c}": f"a{c}" for c in "xyz"}},)
#: Ray from (ox, oy, oz) along the unit vector (gx, gy, gz): distance t of its hit, null without one.
RAY: Stages = (
    {**_minus("u", "b", "a"), **_minus("v", "c", "a"), **_minus("w", "o", "a")},
    {**_cross("h", "g", "v"), **_cross("k", "w", "u")},
    {"det": _dot("u", "h")},
    {"fb": _share(_dot("w", "h"), "det"), "fc": _share(_dot("g", "k"), "det"), "along": _share(_dot("v", "k"), "det")},
    {"t": "CASE WHEN abs(det) > 1e-14 AND fb >= 0 AND fc >= 0 AND fb + fc <= 1 AND along > 1e-9 THEN along END"},
)


def staged(df: DataFrame, stages: Stages) -> DataFrame:
    for stage in stages:
        df = df.selectExpr("*", *(f"{e} AS {n}" for n, e in stage.items()))
    return df


def staged_sql(source: str, stages: Stages) -> str:
    for i, stage in enumerate(stages):
        source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM {source} s{i})"
    return source


def _boxed(targets: DataFrame) -> DataFrame:
    """Adds the target's bounding box and its keys in both tiers."""
    corners = [c for c in ("a", "b", "c") if f"{c}x" in targets.columns]
    for axis in "xyz":
        cols = [F.col(f"{c}{axis}") for c in corners]
        lo, hi = (F.least(*cols), F.greatest(*cols)) if len(cols) > 1 else (cols[0], cols[0])
        targets = targets.withColumns({f"lo{axis}": lo, f"hi{axis}": hi})
    for i, size in enumerate(TIERS):
        targets = targets.withColumn(f"box{i}", F.struct(*(F.floor((F.col(f"lo{a}") + F.col(f"hi{a}")) / (2 * size)).alias(a) for a in "xyz")))
    return targets


class Boxes(NamedTuple):
    """Targets with their boxes, and the boxes of both tiers, made once for all joins with them."""

    targets: DataFrame
    coarse: DataFrame
    fine: DataFrame


def boxes(targets: DataFrame) -> Boxes:
    span = [f(f"{m}{a}").alias(f"{m}{a}") for a in "xyz" for m, f in (("lo", F.min), ("hi", F.max))]
    boxed = durable(_boxed(targets))
    fine = durable(boxed.groupBy("scope", "box0", "box1").agg(*span))
    coarse = durable(fine.groupBy("scope", "box0").agg(*span))
    # A scope of very many points would be one task if the points were shuffled by it.
    return Boxes(boxed, F.broadcast(coarse) if coarse.count() <= SENT else coarse, fine)


def nearest(points: DataFrame, targets: DataFrame | Boxes, metric: Stages = TRIANGLE) -> DataFrame:
    """scope, pid, tid, distance, qx, qy, qz: the closest target of each point's scope; ties go to the lowest tid.

    ``points``: scope, pid, px, py, pz. ``targets``: scope, tid and corners a (b, c). Points of a scope
    without targets have no row. Coordinates are not null.
    """
    if metric is VERTEX:
        return nearest_vertex(points, targets.targets if isinstance(targets, Boxes) else targets)
    targets, coarse, fine = targets if isinstance(targets, Boxes) else boxes(targets)
    kept = points.select("scope", "pid", "px", "py", "pz")
    box = [f"{m}{a}" for a in "xyz" for m in ("lo", "hi")]
    for on, tier in zip((["scope"], ["scope", "box0"]), (coarse, fine)):
        near = sum((F.greatest(F.col(f"lo{a}") - F.col(f"p{a}"), F.lit(0.0), F.col(f"p{a}") - F.col(f"hi{a}")) ** 2 for a in "xyz"), F.lit(0.0))
        far = sum((F.greatest(F.abs(F.col(f"p{a}") - F.col(f"lo{a}")), F.abs(F.col(f"p{a}") - F.col(f"hi{a}"))) ** 2 for a in "xyz"), F.lit(0.0))
        met = kept.join(tier, on).withColumns({"near": near, "far": far})
        best = F.min("far").over(Window.partitionBy("scope", "pid"))
        kept = met.withColumn("best", best).where(F.col("near") <= F.col("best") * (1 + 1e-9)).drop("near", "far", "best", *box)
    met = staged(kept.join(targets.drop(*box), ["scope", "box0", "box1"]), metric)
    won = met.groupBy("scope", "pid").agg(F.min(F.struct("d2", "tid", "qx", "qy", "qz")).alias("m"))
    return won.select("scope", "pid", "m.tid", F.sqrt("m.d2").alias("distance"), "m.qx", "m.qy", "m.qz")


def _blocks(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of ``x`` in blocks of neighbours, by halving along the longest edge."""
    out, left = [], [np.arange(len(x))]
    while left:
        i = left.pop()
        if len(i) <= size:
            out.append(i)
            continue
        own = x[i]
        o = np.argpartition(own[:, (own.max(0) - own.min(0)).argmax()], len(i) // 2)
        left += [i[o[: len(i) // 2]], i[o[len(i) // 2 :]]]
    return out


def _d2(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Squared distances, summed up as in VERTEX."""
    d = [p[:, None, a] - t[None, :, a] for a in range(3)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _all_pairs(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The first of the closest ``t`` for every ``p``; what isn't a number is farther than infinity, as in Spark."""
    at = np.zeros(len(p), np.int64)
    step = max(1, PAIRS // len(t))
    for k in range(0, len(p), step):
        d2 = _d2(p[k : k + step], t)
        at[k : k + step] = np.where(np.isnan(d2), np.inf, d2).argmin(1)
        for i in np.flatnonzero(~np.isfinite(d2[np.arange(len(d2)), at[k : k + step]])):
            at[k + i] = np.isnan(d2[i]).argmin()
    return at


def _closest(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """As ``_all_pairs``, skipping blocks of ``t``."""
    if len(p) * len(t) <= PAIRS:
        return _all_pairs(p, t)
    fine, some = np.isfinite(t).all(1), np.isfinite(p).all(1)
    at = np.zeros(len(p), np.int64)
    if not some.all() or not fine.any():
        at[~some] = _all_pairs(p[~some], t)
        if fine.any() and some.any():
            at[some] = _closest(p[some], t)
        elif some.any():
            at[some] = _all_pairs(p[some], t)
        return at
    if not fine.all():
        return np.flatnonzero(fine)[_closest(p, t[fine])]
    blocks = _blocks(t, BLOCK[1])
    lo, hi = (np.array([f(t[b], axis=0) for b in blocks]) for f in (np.min, np.max))
    for b in _blocks(p, BLOCK[0]):
        own = p[b]
        gap = np.maximum(np.maximum(lo - own.max(0), own.min(0) - hi), 0.0)
        near = (gap * gap).sum(1)
        middle = (lo + hi - own.max(0) - own.min(0)) / 2
        first = np.argsort((middle * middle).sum(1))[:4]
        bound = _d2(own, t[np.concatenate([blocks[i] for i in first])]).min(1).max()
        met = np.sort(np.concatenate([blocks[i] for i in np.flatnonzero(~(near > bound * (1 + 1e-9)))]))
        at[b] = met[_d2(own, t[met]).argmin(1)]
    return at


def _vertex_kernel(rows: pa.Table) -> pa.Table:
    """The closest vertex of every point of a group; of points with one pid, only that of the closest."""
    point = rows["point"].to_numpy()
    at = np.stack([rows[a].to_numpy() for a in "xyz"], 1)
    p, t, tid = at[point], at[~point], rows["tid"].to_numpy()[~point]
    own = rows.filter(pa.array(point)).select(["scope", "pid", "x", "y", "z"])
    if len(p) and len(t):
        order = np.argsort(tid, kind="stable")
        t, tid = t[order], tid[order]
        won = _closest(p, t)
    else:
        own, p, won = own.slice(0, 0), p[:0], np.zeros(0, np.int64)
    q = t[won]
    d = p - q
    for name, c in (("d2", d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]), ("tid", tid[won]), *((f"q{a}", q[:, k]) for k, a in enumerate("xyz"))):
        own = own.append_column(name, pa.array(c))
    code = own["pid"].combine_chunks().dictionary_encode().indices.to_numpy()
    if len(code) and code.max() + 1 < len(code):
        order = np.lexsort((own["tid"].to_numpy(), own["d2"].to_numpy(), code))
        own = own.take(pa.array(order[np.append(True, np.diff(code[order]) > 0)]))
    return own


def _met(points: DataFrame, vertices: DataFrame, keys: list[str], schema: str) -> DataFrame:
    side = [*keys, "point", "pid", "tid", "x", "y", "z"]
    p = points.withColumns({"point": F.lit(True), "tid": F.lit(0).cast("bigint")}).select(*side)
    v = vertices.withColumns({"point": F.lit(False), "pid": F.lit(None).cast(dict(points.dtypes)["pid"])}).select(*side)
    return in_runs(p.unionByName(v), keys, _vertex_kernel, schema)


def _celled(df: DataFrame, edge: float | None, margin: float) -> DataFrame:
    """Rows in every cell in whose margin they lie; without an edge all are in one."""
    for a in "xyz":
        c = F.array(F.lit(0).cast("bigint")) if edge is None else F.sequence(F.floor((F.col(a) - margin) / edge), F.floor((F.col(a) + margin) / edge))
        df = df.withColumn(f"c{a}", F.explode(c))
    return df


def _parted(points: DataFrame, targets: DataFrame, cell: list[str], point: list[str], target: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Crowded cells as a grid of parts, points by targets, each spread by the columns named last."""
    both = points.select(*cell, F.lit(1).alias("n"), F.lit(0).alias("m")).unionByName(targets.select(*cell, F.lit(0).alias("n"), F.lit(1).alias("m")))
    parts = [F.ceil(F.sum(c) / GROUP).cast("int").alias(f"{c}s") for c in "nm"]
    crowded = F.broadcast(both.groupBy(*cell).agg(*parts).where("ns > 1 OR ms > 1"))  # at most two for GROUP rows
    count = {c: F.greatest(F.coalesce(f"{c}s", F.lit(1)), F.lit(1)) for c in "nm"}

    def cut(df: DataFrame, own: str, other: str, *by: str) -> DataFrame:
        df = df.join(crowded, cell, "left").withColumn(f"{own}_part", F.pmod(F.xxhash64(*by), count[own]).cast("int"))
        return df.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), count[other] - 1))).drop("ns", "ms")

    return cut(points, "n", "m", *point), cut(targets, "m", "n", *target), [*cell, "n_part", "m_part"]


def nearest_vertex(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """``nearest`` of vertices (scope, tid, ax, ay, az)."""
    pts = durable(points.select("scope", "pid", *(F.col(f"p{a}").cast("double").alias(a) for a in "xyz")))
    vs = durable(vertices.select("scope", F.col("tid").cast("bigint").alias("tid"), *(F.col(f"a{a}").cast("double").alias(a) for a in "xyz")))
    kind = dict(pts.dtypes)
    schema = f"scope {kind['scope']}, pid {kind['pid']}, x double, y double, z double, d2 double, tid bigint, qx double, qy double, qz double"
    large = durable(pts.select("scope").unionByName(vs.select("scope")).groupBy("scope").count().where(F.col("count") > GROUP).select("scope"))
    large = F.broadcast(large)  # at most one for GROUP rows
    best = _met(pts.join(large, "scope", "left_anti"), vs.join(large, "scope", "left_anti"), ["scope"], schema)
    left, vs = pts.join(large, "scope", "left_semi"), vs.join(large, "scope", "left_semi")
    found, levels, n = [], [*CELLS, (None, 0.0)], left.count()
    place = ["scope", "pid", "x", "y", "z"]
    while n:
        edge, margin = levels.pop(0) if n > FEW else levels[-1]
        m = _met(*_parted(_celled(left, edge, 0.0), _celled(vs, edge, margin), ["scope", "cx", "cy", "cz"], place[1:], ["tid", "x", "y", "z"]), schema).groupBy(*place).agg(F.min(F.struct("d2", "tid", "qx", "qy", "qz")).alias("m"))
        # A tenth of the margin covers what rounding moves over a cell's border.
        m = durable(m if edge is None else m.where(F.col("m.d2") <= (0.9 * margin) ** 2))
        found.append(m)
        if edge is None:
            break
        left = durable(left.join(m.select(*place), place, "left_anti"))
        n = left.count()
    best = best.select("scope", "pid", "d2", "tid", "qx", "qy", "qz")
    if found:
        more = reduce(DataFrame.unionByName, found).groupBy("scope", "pid").agg(F.min("m").alias("m"))  # a pid can have several points
        best = best.unionByName(more.select("scope", "pid", "m.*"))
    return best.select("scope", "pid", "tid", F.sqrt("d2").alias("distance"), "qx", "qy", "qz")


#: Directions are cut into FACE x FACE cells on each side of a cube.
FACE = 4
#: Triangles that a block of rays meets at once, the nearest first.
MEETS = 128
_CORNERS = [f"{c}{a}" for c in "abc" for a in "xyz"]


def _unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1))
    return x / np.where(n > 0, n, 1.0)[:, None]


def _cell_caps() -> tuple[np.ndarray, np.ndarray]:
    """Middle and angular radius of every cell of directions."""
    e = np.linspace(-1, 1, FACE + 1)
    middles, radii = [], []
    for face in range(6):
        for i in range(FACE):
            for j in range(FACE):
                uv = np.array([(e[i + k], e[j + n]) for k in (0, 1) for n in (0, 1)])
                corner = _unit_rows(np.insert(uv, face % 3, -1.0 if face < 3 else 1.0, axis=1))
                middle = _unit_rows(corner.sum(0, keepdims=True))[0]
                middles.append(middle)
                radii.append(np.arccos(np.clip(corner @ middle, -1, 1)).max() + 1e-6)
    return np.array(middles), np.array(radii)


def _cell_of(g: np.ndarray) -> np.ndarray:
    axis = np.abs(g).argmax(1)
    rows = np.arange(len(g))
    rest = np.array([[1, 2], [0, 2], [0, 1]])[axis]
    uv = g[rows[:, None], rest] / np.abs(g[rows, axis])[:, None]
    i = np.clip(np.nan_to_num((uv + 1) / 2 * FACE), 0, FACE - 1).astype(np.int64)
    return ((axis + 3 * (g[rows, axis] > 0)) * FACE + i[:, 0]) * FACE + i[:, 1]


def _caps(tri: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of triangles seen from ``o``: middle and angular radius of a cap of directions around each, and a distance none is nearer than.

    Flat ones and those seen edge on, whose hits are a matter of rounding, may be in any direction and at any distance.
    """
    with np.errstate(all="ignore"):
        at = tri - o
        u, v = at[:, 1] - at[:, 0], at[:, 2] - at[:, 0]
        normal = np.cross(u, v)
        area, sides = np.sqrt((normal * normal).sum(1)), np.sqrt((u * u).sum(1) * (v * v).sum(1))
        height = np.abs((normal * at[:, 0]).sum(1)) / area
        far = np.sqrt((at * at).sum(2)).max(1)
        to = np.stack([_unit_rows(at[:, k]) for k in range(3)], 1)
        middle = _unit_rows(to.sum(1))
        radius = np.arccos(np.clip((to * middle[:, None]).sum(2), -1, 1)).max(1) + 1e-6
        box = np.maximum(np.maximum(at.min(1), -at.max(1)), 0.0)
        near = np.maximum(height, np.sqrt((box * box).sum(1))) * (1 - 1e-6) - 1e-6
        sure = (area > 1e-6 * sides) & (height > 1e-6 * far) & (radius < 1.5) & np.isfinite(near)
    middle = np.where(sure[:, None], middle, [1.0, 0.0, 0.0])
    return middle, np.where(sure, radius, np.pi), np.where(sure, near, -np.inf)


def _hit(p_o: np.ndarray, g: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Distances of hits along rays from the one origin, as in RAY; infinite without one."""
    a, u, v = tri[:, 0], tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0]
    w = p_o - a

    def cross(p: Sequence[np.ndarray], q: Sequence[np.ndarray]) -> list[np.ndarray]:
        return [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]

    def dot(p: Sequence[np.ndarray], q: Sequence[np.ndarray]) -> np.ndarray:
        return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]

    with np.errstate(all="ignore"):
        gs, us, vs, ws = [g[:, None, k] for k in range(3)], u.T, v.T, w.T
        h, k = cross(gs, vs), cross(ws, us)
        det = dot(us, h)
        fb, fc, along = dot(ws, h) / det, dot(gs, k) / det, dot(vs, k) / det
        return np.where((np.abs(det) > 1e-14) & (fb >= 0) & (fc >= 0) & (fb + fc <= 1) & (along > 1e-9), along, np.inf)


def _first(o: np.ndarray, g: np.ndarray, tri: np.ndarray, tid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and id of the first hit of rays from the one origin; ties go to the lowest id, no hit is infinite."""
    best, won = np.full(len(g), np.inf), np.full(len(g), -1, np.int64)
    middle, radius, near = _caps(tri, o)
    order = np.argsort(near, kind="stable")
    middle, radius, near, tri, tid = middle[order], radius[order], near[order], tri[order], tid[order]
    cos, sin = np.cos(radius), np.sin(radius)
    for b in _blocks(g, BLOCK[0]):
        own = _unit_rows(g[b].sum(0, keepdims=True))[0]
        r = np.arccos(np.clip(g[b] @ own, -1, 1)).max() + 1e-6
        seen = np.flatnonzero((radius + r >= np.pi) | (middle @ own >= cos * np.cos(r) - sin * np.sin(r) - 1e-9))
        for k in range(0, len(seen), MEETS):
            some = seen[k : k + MEETS]
            b = b[best[b] >= near[some[0]]]
            if not len(b):
                break
            t = _hit(o, g[b], tri[some])
            least = t.min(1)
            first = np.where(t == least[:, None], tid[some], np.iinfo(np.int64).max).min(1)
            take = (least < best[b]) | (least == best[b]) & (least < np.inf) & (first < won[b])
            best[b[take]], won[b[take]] = least[take], first[take]
    return best, won


def _ray_kernel(rows: pa.Table) -> pa.Table:
    """The first hits of a group's rays, whose point is in the first corner's and origin in the second corner's columns."""
    ray = rows["point"].to_numpy()
    at = np.stack([rows[c].to_numpy() for c in _CORNERS], 1)
    p, o, tri, tid = at[ray, :3], at[ray, 3:6], at[~ray].reshape(-1, 3, 3), rows["tid"].to_numpy()[~ray]
    d = p - o
    g = d / np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])[:, None]
    t, won = np.full(len(p), np.inf), np.full(len(p), -1, np.int64)
    sound = np.flatnonzero(np.isfinite(g).all(1))
    if len(sound) and len(tri):
        origins, which = np.unique(o[sound], axis=0, return_inverse=True)
        for k, origin in enumerate(origins):
            own = sound[which.ravel() == k]
            t[own], won[own] = _first(origin, g[own], tri, tid)
    met = np.isfinite(t)
    out = rows.filter(pa.array(ray)).filter(pa.array(met)).select(["scope", "pid"])
    cols = [("t", t), ("tid", won), *((f"{n}{a}", x[:, k]) for n, x in (("p", p), ("o", o), ("g", g)) for k, a in enumerate("xyz"))]
    for name, c in cols:
        out = out.append_column(name, pa.array(c[met]))
    return out


def _in_directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rays with the cell of their direction, triangles with every cell in which they may be seen from (ox, oy, oz)."""
    middles, radii = _cell_caps()
    for batch in batches:
        at = np.stack([batch[c].to_numpy() for c in _CORNERS], 1)
        ray = batch["point"].to_numpy(zero_copy_only=False)
        row, cell = np.flatnonzero(ray), _cell_of(at[ray, :3] - at[ray, 3:6])
        tri = np.flatnonzero(~ray)
        if len(tri):
            middle, radius, _ = _caps(at[tri].reshape(-1, 3, 3), np.stack([batch[f"o{a}"].to_numpy() for a in "xyz"], 1)[tri][:, None])
            apart = np.arccos(np.clip(middle @ middles.T, -1, 1))
            i, c = np.nonzero(apart <= radius[:, None] + radii + 1e-6)
            row, cell = np.append(row, tri[i]), np.append(cell, c)
        yield batch.take(pa.array(row)).append_column("cell", pa.array(cell))


def first_hits(points: DataFrame, triangles: DataFrame | Boxes) -> DataFrame:
    """scope, pid, tid, distance, qx, qy, qz of the first triangle hit by the ray from (ox, oy, oz) towards (px, py, pz).

    Rays without a hit, or whose point is the origin itself, have no row. Rays and triangles of a scope meet in
    a task, where blocks of rays skip the triangles that they don't see and those beyond their hits; scopes of
    many rows are cut into cells of directions first. Rays of a scope should have few origins, as triangles are
    sorted by direction once for each.
    """
    return _first_hits(durable(points), triangles.targets if isinstance(triangles, Boxes) else durable(triangles))


def _first_hits(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Reads both several times."""
    length = F.sqrt(sum(((F.col(f"p{a}") - F.col(f"o{a}")) ** 2 for a in "xyz"), F.lit(0.0)))
    zero = F.lit(0.0)
    side = ["scope", "point", "pid", "tid", *_CORNERS]
    rays = points.where(length >= 1e-12).select(
        "scope", F.lit(True).alias("point"), "pid", F.lit(0).cast("bigint").alias("tid"),
        *((F.col(f"p{a}") if c == "a" else F.col(f"o{a}") if c == "b" else zero).cast("double").alias(f"{c}{a}") for c in "abc" for a in "xyz"),
    )
    kind = dict(rays.dtypes)
    tris = triangles.withColumns({"point": F.lit(False), "pid": F.lit(None).cast(kind["pid"]), "tid": F.col("tid").cast("bigint")}).select(*side)
    both = rays.unionByName(tris)
    large = F.broadcast(durable(both.groupBy("scope").count().where(F.col("count") > GROUP).select("scope")))  # at most one for GROUP rows
    schema = f"scope {kind['scope']}, pid {kind['pid']}, t double, tid bigint, " + ", ".join(f"{n}{a} double" for n in "pog" for a in "xyz")
    hits = in_runs(both.join(large, "scope", "left_anti"), ["scope"], _ray_kernel, schema)
    many = both.join(large, "scope", "left_semi")
    origin = {f"o{a}": F.col(f"b{a}") + 0.0 for a in "xyz"}  # one zero
    origins = durable(many.where("point").withColumns(origin).select("scope", *origin).distinct())
    n = origins.count()
    if n:
        seen = many.where("NOT point").join(F.broadcast(origins) if n <= SENT else origins, "scope").unionByName(many.where("point").withColumns(origin))
        kinds = {**kind, **{k: "double" for k in origin}}
        celled = seen.mapInArrow(_in_directions, ", ".join(f"{c} {kinds[c]}" for c in [*seen.columns]) + ", cell bigint")
        cell = ["scope", *origin, "cell"]
        r, t, keys = _parted(celled.where("point"), celled.where("NOT point"), cell, ["pid", *_CORNERS], ["tid", *_CORNERS])
        hits = hits.unionByName(in_runs(r.unionByName(t), keys, _ray_kernel, schema))
    won = hits.groupBy("scope", "pid").agg(F.min(F.struct("t", "tid", *(f"{c}{a}" for c in "pog" for a in "xyz"))).alias("m"))
    q = {f"q{a}": F.col(f"m.o{a}") + F.col("m.t") * F.col(f"m.g{a}") for a in "xyz"}
    out = won.withColumns(q)
    gap = F.sqrt(sum(((F.col(f"m.p{a}") - F.col(f"q{a}")) ** 2 for a in "xyz"), F.lit(0.0)))
    return out.select("scope", "pid", "m.tid", gap.alias("distance"), "qx", "qy", "qz")


def raycast(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """The first hit where there is one, else the closest surface point; ``hit`` tells which."""
    points, triangles = durable(points), durable(triangles)
    hit = durable(_first_hits(points, triangles))
    rest = durable(points.join(hit.select("scope", "pid"), ["scope", "pid"], "left_anti"))
    near = nearest(rest, triangles.join(rest.select("scope").distinct(), "scope", "left_semi"))
    return hit.withColumn("hit", F.lit(True)).unionByName(near.withColumn("hit", F.lit(False)))
