"""Points inside regions and points near points (problem 3).

Regions are prisms: a simple polygon in the x-y plane between two heights. Polygons are cut into triangles
by ear clipping; the triangles are handed out over a bounding-volume hierarchy whose upper tier are cubic
nodes in space, spread over the cluster by hash, and below which every node has its own hierarchy of
bounding boxes, built of the triangles that lie in it and walked by the kernel of a task. Every candidate is
then tested exactly, and a point on an edge that two triangles of a region share is assigned to that region
once.

A point belongs to exactly one node of each tier level, a triangle to all nodes that its box touches. A count
by node comes first: it gives the number of tasks, and nodes with very many points or triangles are split
into a grid of parts, points by rows and regions by columns. Tasks read their nodes sorted, one after the
other, and hold a few at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Boxes of the largest triangles along an edge of a node; boxes below a box in a node's hierarchy.
FANOUT, BRANCH = 4, 8
#: Points and triangles above which a node is split, and the most candidate pairs tested at once in a task.
HOT_POINTS, HOT_TRIANGLES, CHUNK = 200_000, 100_000, 4_000_000
#: Rows of a task on average, rows held at once, and split nodes that are sent to all tasks (more of them are joined by a shuffle).
TASK, HELD, SENT = 250_000, 400_000, 100_000


def ear_clip(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ear clipping of m simple polygons of n corners each, all at once: (m, n) -> (m, n - 2, 6).

    Corners may run either way round. Each step cuts the first ear, a convex corner whose triangle holds no
    other corner; if rounding leaves none, the first convex corner, else the first corner.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    area = np.sum(x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y, axis=1)
    flip = area < 0
    x, y = np.where(flip[:, None], x[:, ::-1], x), np.where(flip[:, None], y[:, ::-1], y)
    out = []
    while x.shape[1] > 3:
        m, n = x.shape
        before, after = (np.arange(n) - 1) % n, (np.arange(n) + 1) % n
        ax, ay, bx, by = x[:, before], y[:, before], x[:, after], y[:, after]
        convex = (x - ax) * (by - ay) - (y - ay) * (bx - ax) > 0
        inside = np.ones((m, n, n), bool)  # corner k in the triangle of corner i
        for px, py, qx, qy in ((ax, ay, x, y), (x, y, bx, by), (bx, by, ax, ay)):
            side = (qx - px)[:, :, None] * (y[:, None, :] - py[:, :, None]) - (qy - py)[:, :, None] * (x[:, None, :] - px[:, :, None])
            inside &= side >= 0
        own = np.zeros((n, n), bool)
        own[np.arange(n), np.arange(n)] = own[np.arange(n), before] = own[np.arange(n), after] = True
        # A corner that only repeats one of the triangle's own doesn't spoil the ear.
        same = ((x[:, None, :] == ax[:, :, None]) & (y[:, None, :] == ay[:, :, None])) | ((x[:, None, :] == bx[:, :, None]) & (y[:, None, :] == by[:, :, None]))
        ear = convex & ~(inside & ~own[None] & ~same).any(2)
        pick = np.where(ear.any(1), ear.argmax(1), convex.argmax(1))
        row = np.arange(m)
        out.append(np.stack([ax[row, pick], ay[row, pick], x[row, pick], y[row, pick], bx[row, pick], by[row, pick]], 1))
        keep = np.arange(n)[None, :] != pick[:, None]
        x, y = x[keep].reshape(m, n - 1), y[keep].reshape(m, n - 1)
    out.append(np.stack([x[:, 0], y[:, 0], x[:, 1], y[:, 1], x[:, 2], y[:, 2]], 1))
    return np.stack(out, 1)


def _finite(v: Column) -> Column:
    return F.coalesce(F.abs(v) < float("inf"), F.lit(False))


def triangulate(regions: DataFrame) -> DataFrame:
    """(scope, region_id, ring_x, ring_y, z_lo, z_hi, centre) -> one row per triangle with its geometry ``g``.

    g = ax ay bx by cx cy z_lo z_hi, then the centre's x y z (NaN without one). Rings with a null or infinite coordinate, with
    fewer than three corners or of unequal lengths have no area and give no triangle.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rx, ry, centre = b["ring_x"], b["ring_y"], b["centre"]
            n = pc.list_value_length(rx).to_numpy(zero_copy_only=False)
            flat = [np.asarray(c.flatten()) for c in (rx, ry, centre)]
            start = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
            z = np.stack([b["z_lo"].to_numpy(zero_copy_only=False), b["z_hi"].to_numpy(zero_copy_only=False)], 1)
            centre3 = flat[2].reshape(-1, 3)
            rows, geo = [], []
            for size in np.unique(n):
                at = np.flatnonzero(n == size)
                for part in np.array_split(at, max(1, len(at) * int(size) ** 2 // CHUNK + 1)):
                    idx = start[part][:, None] + np.arange(size)
                    tri = ear_clip(flat[0][idx], flat[1][idx])
                    k = tri.shape[1]
                    rows.append(np.repeat(part, k))
                    geo.append(np.concatenate([tri.reshape(-1, 6), np.repeat(z[part], k, 0), np.repeat(centre3[part], k, 0)], 1))
            rows, geo = np.concatenate(rows), np.concatenate(geo)
            take = pa.array(rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * 11), pa.array(geo.ravel()))
            yield pa.RecordBatch.from_arrays([b["scope"].take(take), b["region_id"].take(take), lists], ["scope", "region_id", "g"])

    ok = (
        (F.size("ring_x") >= 3) & (F.size("ring_x") == F.size("ring_y")) & F.forall("ring_x", _finite) & F.forall("ring_y", _finite)
        & F.col("scope").isNotNull() & _finite(F.col("z_lo")) & _finite(F.col("z_hi"))
    )
    rid = dict(regions.dtypes)["region_id"]
    return regions.where(ok).select("scope", "region_id", "ring_x", "ring_y", "z_lo", "z_hi", "centre").mapInArrow(kernel, f"scope string, region_id {rid}, g array<double>")


def _node(scope: Column, level: Column, x: Column, y: Column, z: Column) -> Column:
    return F.xxhash64(scope, level, x, y, z)


def _hierarchy(lo: np.ndarray, hi: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """(order of the triangles, tiers) of the box hierarchies of all nodes; ``node`` numbers the nodes, each has triangles.

    Triangles of a node are ordered along a Morton curve of their middles; BRANCH boxes in a row go under one box, tier by
    tier, until a node has one. A tier is (lo, hi, first box below, boxes below); the last one has one box per node.
    """
    starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    middle = (lo + hi) / 2
    low, high = np.minimum.reduceat(middle, starts), np.maximum.reduceat(middle, starts)
    at = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(node))))
    cell = ((middle - low[at]) / np.maximum(high - low, 1e-300)[at] * 1023).astype(np.int64)
    code = np.zeros(len(node), np.int64)
    for bit in range(10):
        for axis in range(3):
            code |= ((cell[:, axis] >> bit) & 1) << (3 * bit + axis)
    order = np.lexsort((code, at))
    lo, hi = lo[order], hi[order]
    tiers = [(lo, hi, None, None)]
    while True:
        size = np.bincount(at)
        first = np.cumsum(size) - size
        inside = np.arange(len(at)) - first[at]
        begin = np.flatnonzero(inside % BRANCH == 0)
        count = np.diff(np.append(begin, len(at)))
        lo, hi, at = np.minimum.reduceat(lo, begin), np.maximum.reduceat(hi, begin), at[begin]
        tiers.append((lo, hi, begin, count))
        if len(at) == len(starts):
            return order, tiers


def _met(xyz: np.ndarray, p: np.ndarray, root: np.ndarray, g: np.ndarray, tiers: list[tuple[np.ndarray, ...]], radius: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(points, triangles) where the point is in the triangle's prism: points ``p`` go down from the boxes ``root``."""
    found_p, found_t = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    open_pairs = [(len(tiers) - 1, p, root)]
    while open_pairs:
        tier, p, box = open_pairs.pop()
        lo, hi, begin, count = tiers[tier]
        q = xyz[p]
        hit = ((q >= lo[box]) & (q <= hi[box])).all(1)
        p, box = p[hit], box[hit]
        if not len(p):
            continue
        if tier:
            n = count[box]
            if n.sum() > CHUNK and len(p) > 1:
                half = len(p) // 2
                open_pairs += [(tier, p[:half], box[:half]), (tier, p[half:], box[half:])]
                continue
            below = np.repeat(begin[box] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            open_pairs.append((tier - 1, np.repeat(p, n), below))
            continue
        q, h = xyz[p], g[box]
        hit = (q[:, 2] >= h[:, 6]) & (q[:, 2] <= h[:, 7])
        for i, j in ((0, 2), (2, 4), (4, 0)):  # triangles run counter-clockwise; edges belong to them
            hit &= (h[:, j] - h[:, i]) * (q[:, 1] - h[:, i + 1]) - (h[:, j + 1] - h[:, i + 1]) * (q[:, 0] - h[:, i]) >= 0
        if radius is not None:
            hit &= ((q - h[:, 8:11]) ** 2).sum(1) <= radius * radius
        found_p.append(p[hit])
        found_t.append(box[hit])
    return np.concatenate(found_p), np.concatenate(found_t)


def _node_kernel(radius: float | None):
    """Joins the points and triangles of nodes that come sorted by (leaf, salt)."""

    def join(rows: pa.Table) -> pa.Table | None:
        is_point = rows["is_point"].to_numpy()
        point_at, tri_at = np.flatnonzero(is_point), np.flatnonzero(~is_point)
        if not len(point_at) or not len(tri_at):
            return None
        leaf, salt = rows["leaf"].to_numpy(), rows["salt"].to_numpy()
        node = np.cumsum(np.append(0, (leaf[1:] != leaf[:-1]) | (salt[1:] != salt[:-1])))
        xyz = rows["g"].filter(rows["is_point"]).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
        g = rows["g"].filter(pc.invert(rows["is_point"])).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 11)
        lo = np.stack([g[:, [0, 2, 4]].min(1), g[:, [1, 3, 5]].min(1), g[:, 6]], 1)
        hi = np.stack([g[:, [0, 2, 4]].max(1), g[:, [1, 3, 5]].max(1), g[:, 7]], 1)
        order, tiers = _hierarchy(lo - 1e-9 * (1 + np.abs(lo)), hi + 1e-9 * (1 + np.abs(hi)), node[tri_at])
        filled = np.unique(node[tri_at])
        root = np.searchsorted(filled, node[point_at]).clip(max=len(filled) - 1)
        live = np.flatnonzero(filled[root] == node[point_at])
        p, t = _met(xyz, live, root[live], g[order], tiers, radius)
        if not len(p):
            return None
        p, t = pa.array(point_at[p]), pa.array(tri_at[order[t]])
        out = pa.Table.from_arrays([rows["scope"].take(p), rows["point_id"].take(p), rows["region_id"].take(t)], ["scope", "point_id", "region_id"])
        out = out.filter(pc.equal(out["scope"], rows["scope"].take(t)))  # should two nodes share a hash
        return out.group_by(out.column_names).aggregate([])  # a shared edge, a repeated point or a repeated region counts once

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size >= HELD:
                rows = pa.Table.from_batches(held)
                leaf, salt = rows["leaf"].to_numpy(), rows["salt"].to_numpy()
                ended = int(np.flatnonzero((leaf != leaf[-1]) | (salt != salt[-1])).max(initial=-1)) + 1  # the last node may go on
                if ended:
                    met = join(rows.slice(0, ended))
                    if met is not None:
                        yield from met.to_batches()
                    held = rows.slice(ended).to_batches()
                    size = rows.num_rows - ended
        met = join(pa.Table.from_batches(held)) if held else None
        if met is not None:
            yield from met.to_batches()

    return kernel


def region_join(points: DataFrame, regions: DataFrame, edge: float, radius: float | None = None, levels: list[int] | None = None) -> DataFrame:
    """(scope, point_id, region_id) of each point inside or on the border of a region of the same scope.

    ``points``: scope string, point_id, x, y, z. ``regions``: scope, region_id, ring_x, ring_y (arrays),
    z_lo, z_hi, centre (array of 3, NaN where there's none). ``radius`` also asks for that distance from
    the centre at most. ``edge`` is the edge of a node at level 0; a triangle lives at the first level
    whose child box is no smaller than its own box. ``levels`` may be given where they are known, else one
    small job collects the different ones (at most some 60, the doublings of a double's useful range).

    Points with a null, NaN or infinite coordinate or a null scope take no part. Repeated points or regions give each pair
    once. Empty inputs give an empty result. Other columns of the inputs are ignored.
    """
    spark = points.sparkSession
    tri = triangulate(regions)
    box = {
        "x0": F.least(*(F.col("g")[i] for i in (0, 2, 4))), "x1": F.greatest(*(F.col("g")[i] for i in (0, 2, 4))),
        "y0": F.least(*(F.col("g")[i] for i in (1, 3, 5))), "y1": F.greatest(*(F.col("g")[i] for i in (1, 3, 5))),
        "z0": F.col("g")[6], "z1": F.col("g")[7],
    }
    tri = tri.withColumns(box)
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("z1") - F.col("z0"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(1e-300)) / (edge / FANOUT))).cast("int"))
    tri = tri.withColumn("level", F.lit(levels[0]) if levels and len(levels) == 1 else level)
    if levels is None:
        levels = sorted(r[0] for r in tri.select("level").distinct().collect()) or [0]
    size = F.lit(float(edge)) * F.pow(F.lit(2.0), F.col("level"))
    slack = F.lit(1e-9)
    for axis in "xyz":
        lo, hi = F.col(f"{axis}0") / size, F.col(f"{axis}1") / size
        cells = F.sequence(F.floor(lo - slack * (1 + F.abs(lo))), F.floor(hi + slack * (1 + F.abs(hi))))
        tri = tri.withColumn(f"n{axis}", F.explode(cells))
    n = [F.col(f"n{a}") for a in "xyz"]
    tri = tri.select("scope", "region_id", "g", _node(F.col("scope"), F.col("level"), *n).alias("leaf"))

    pts = points.select("scope", "point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z"))
    finite = [F.abs(c) < float("inf") for c in "xyz"]  # false for NaN, null for null
    pts = pts.where(F.col("scope").isNotNull() & finite[0] & finite[1] & finite[2])
    pts = pts.withColumn("level", F.lit(levels[0]) if len(levels) == 1 else F.explode(F.array(*map(F.lit, levels))))
    at = [F.floor(F.col(a) / size) for a in "xyz"]
    pts = pts.select("scope", "point_id", F.array("x", "y", "z").alias("p"), _node(F.col("scope"), F.col("level"), *at).alias("leaf"))
    counts = pts.select("leaf", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(tri.select("leaf", F.lit(0).alias("p"), F.lit(1).alias("t")))
    counts = durable(counts.groupBy("leaf").agg(F.sum("p").alias("p"), F.sum("t").alias("t")))
    many = (F.col("p") > HOT_POINTS) | (F.col("t") > HOT_TRIANGLES)
    total, n_hot = counts.agg(F.coalesce(F.sum(F.col("p") + F.col("t")), F.lit(0)), F.count_if(many)).first()
    hot = counts.where(many).select("leaf", *(F.ceil(F.col(c) / most).cast("int").alias(f"{c}_parts") for c, most in (("p", HOT_POINTS), ("t", HOT_TRIANGLES))))
    hot = F.broadcast(hot) if n_hot <= SENT else hot
    null = {c: F.lit(None).cast(t) for c, t in (("point_id", dict(pts.dtypes)["point_id"]), ("region_id", dict(tri.dtypes)["region_id"]))}
    pts = pts.select("scope", "point_id", null["region_id"].alias("region_id"), F.col("p").alias("g"), F.lit(True).alias("is_point"), "leaf")
    tri = tri.select("scope", null["point_id"].alias("point_id"), "region_id", "g", F.lit(False).alias("is_point"), "leaf")
    if n_hot:
        # Copies of a point or region go to one part, so in split nodes there must be one of each.
        row, column = F.pmod(F.xxhash64("point_id", "g"), F.col("p_parts")), F.pmod(F.xxhash64("region_id"), F.col("t_parts"))
        every_row, every_column = (F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("p_parts", "t_parts"))
        rows = []
        for side, r, c in ((pts, row, every_column), (tri, every_row, column)):
            marked = side.join(hot, "leaf", "left").select(*side.columns, "p_parts", "t_parts")
            rows.append(marked.where("p_parts IS NULL").select(*side.columns, F.lit(0).alias("salt")))
            split = marked.where("p_parts IS NOT NULL").distinct().withColumn("r", r).withColumn("c", c)
            rows.append(split.select(*side.columns, (F.col("r") * F.col("t_parts") + F.col("c")).cast("int").alias("salt")))
        both = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    else:
        both = pts.unionByName(tri).withColumn("salt", F.lit(0))
    tasks = max(2 * spark.sparkContext.defaultParallelism, total // TASK)
    sorted_nodes = both.repartition(tasks, "leaf", "salt").sortWithinPartitions("leaf", "salt")
    pairs = sorted_nodes.mapInArrow(_node_kernel(radius), ", ".join(f"{c} {dict(both.dtypes)[c]}" for c in ("scope", "point_id", "region_id")))
    return pairs.distinct()


def footprints(centres: DataFrame, radius: float, corners: int = 4) -> DataFrame:
    """Regions around points (scope, region_id, x, y, z): prisms that just hold the ball of ``radius``."""
    turn = [2 * np.pi * (i + 0.5) / corners for i in range(corners)]
    out = radius * (1 + 1e-6) / np.cos(np.pi / corners)
    r = radius * (1 + 1e-6)
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    inf = float("inf")
    ok = (F.abs(x) < inf) & (F.abs(y) < inf) & (F.abs(z) < inf)
    return centres.where(ok).select(
        "scope", "region_id", F.array(*(x + float(out * np.cos(t)) for t in turn)).alias("ring_x"), F.array(*(y + float(out * np.sin(t)) for t in turn)).alias("ring_y"),
        (z - r).alias("z_lo"), (z + r).alias("z_hi"), F.array(x, y, z).alias("centre"),
    )


def near_pairs(points: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """(scope, point_id, region_id) of each point at most ``radius`` from a centre of the same scope.

    All footprints are of one size, so they live at one level whose child boxes are as wide as they are.
    """
    return region_join(points, footprints(centres, radius), edge=2.0 * radius * FANOUT * (1 + 1e-5), radius=radius, levels=[0])


def contacts(atoms: DataFrame, vertices: DataFrame, radius: float = 1.5) -> DataFrame:
    """structure_id, atom_idx, vid of each atom and mesh vertex of a structure in contact."""
    a = atoms.select(F.col("structure_id").alias("scope"), F.col("atom_idx").alias("point_id"), "x", "y", "z")
    v = vertices.select(F.col("structure_id").alias("scope"), F.col("vid").alias("region_id"), F.col("vx").alias("x"), F.col("vy").alias("y"), F.col("vz").alias("z"))
    near = near_pairs(a, v, radius)
    return near.select(F.col("scope").alias("structure_id"), F.col("point_id").alias("atom_idx"), F.col("region_id").alias("vid"))
