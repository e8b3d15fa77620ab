"""Connected components of the threshold graph on the sphere.

Points are gathered into patches so small that all points of one are neighbours; patches are the nodes. Two
patches are joined if points of them are: first one point of each patch is tried, then one of each of their
cells, then cells that could hold a closer pair are cut into parts again and again until a pair of points or
their size decides. The patches of a scope are bounded by the size of the sphere, whatever the number of
points: where they are few, a task joins those of whole scopes, and only cells that could still join two
parts go on to their points. With a very small threshold all near patches go to their cells by joins, and
labels spread over the links in rounds.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import angle_between, unit
from ..session import durable
from .runs import in_runs

#: Cells along a patch's edge, parts along a cell's edge each time it's halved, and how often that's done: the last parts
#: are some 1e-9 of a cell, and what they leave open counts as beyond the threshold.
FINE, PARTS, LEVELS = 6, 8, 10
#: Most patches of a scope that a task joins.
PATCHES = 20_000


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels 0, 1, ... of the connected parts of n nodes with the links (a, b), numbered from their first members."""
    label = np.arange(n)
    while True:
        new = label.copy()
        for x, y in ((a, b), (b, a)):
            np.minimum.at(new, x, label[y])
            np.minimum.at(new, label[x], label[y])
        while True:
            short = new[new]
            if (short == new).all():
                break
            new = short
        if (new == label).all():
            return np.unique(label, return_inverse=True)[1]
        label = new


def _angle(a: str, b: str) -> Column:
    return angle_between(tuple(F.col(f"{a}.u{c}") for c in "xyz"), tuple(F.col(f"{b}.u{c}") for c in "xyz"))


def linked_cells(points: DataFrame, doubt: DataFrame, threshold: float, edge: float) -> DataFrame:
    """scope, cell_a, cell_b of those pairs of ``doubt`` that hold points at most ``threshold`` radians apart.

    ``points``: scope, cell, ux, uy, uz, of cells with that edge at most. Cells are cut into parts with one
    point to stand for each; a pair of points decides for, the parts' size against a pair. However many points
    a cell has, a pair of parts is cut into at most PARTS^6 pairs at a time, in fact some PARTS^4 on a sphere.
    """
    wanted = doubt.select("scope", F.col("cell_a").alias("cell")).unionByName(doubt.select("scope", F.col("cell_b").alias("cell"))).distinct()
    mine = durable(points.join(wanted, ["scope", "cell"], "left_semi").select("scope", "cell", "ux", "uy", "uz").distinct())
    none = F.struct(*(F.lit(0).cast("bigint").alias(c) for c in "xyz"))
    open_pairs, linked = doubt.select("scope", "cell_a", "cell_b", none.alias("in_a"), none.alias("in_b")), None
    for level in range(1, LEVELS + 1):
        size = edge / PARTS**level
        part = F.struct(*(F.floor(F.col(f"u{c}") / size).alias(c) for c in "xyz"))
        up = F.struct(*(F.floor(F.col(f"part.{c}") / PARTS).alias(c) for c in "xyz")) if level > 1 else none
        one = mine.groupBy("scope", "cell", part.alias("part")).agg(F.min(F.struct("ux", "uy", "uz")).alias("u")).withColumn("up", up)
        side = {s: one.select("scope", F.col("cell").alias(f"cell_{s}"), F.col("up").alias(f"in_{s}"), F.col("part").alias(f"part_{s}"), F.col("u").alias(s)) for s in "ab"}
        met = open_pairs.join(side["a"], ["scope", "cell_a", "in_a"]).join(side["b"], ["scope", "cell_b", "in_b"])
        slack = 2 * 2 * math.asin(min(1.0, size * math.sqrt(3) / 2))
        met = durable(met.withColumn("apart", _angle("a", "b")).where(F.col("apart") <= threshold + slack).drop("a", "b"))
        sure = met.where(F.col("apart") <= threshold).select("scope", "cell_a", "cell_b").distinct()
        linked = sure if linked is None else linked.unionByName(sure)
        open_pairs = met.join(sure, ["scope", "cell_a", "cell_b"], "left_anti").select("scope", "cell_a", "cell_b", F.col("part_a").alias("in_a"), F.col("part_b").alias("in_b"))
        if level < LEVELS and open_pairs.isEmpty():
            break
    return linked


def _cell(threshold: float) -> tuple[float, float]:
    """A cell's edge, and the most that two cells' points are farther apart than other two points of theirs."""
    edge = 2 * math.sin(threshold / 2) / math.sqrt(3) / FINE
    return edge, 2 * 2 * math.asin(min(1.0, edge * math.sqrt(3) / 2))


def _key(patch: str, cell: str) -> Column:
    return F.struct(F.col(patch).alias("patch"), F.col(cell).alias("cell"))


def _cells(points: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """scope, patch, other of those of ``pairs`` of patches with points at most ``threshold`` radians apart."""
    cell, slack = _cell(threshold)
    rep = points.groupBy("scope", "patch", "cell").agg(F.min_by(F.struct("ux", "uy", "uz"), "pid").alias("r"))
    a = rep.select("scope", "patch", F.col("cell").alias("cell_a"), F.col("r").alias("ra"))
    b = rep.select("scope", F.col("patch").alias("other"), F.col("cell").alias("cell_b"), F.col("r").alias("rb"))
    met = pairs.join(a, ["scope", "patch"]).join(b, ["scope", "other"]).withColumn("apart", _angle("ra", "rb")).where(F.col("apart") <= threshold + slack)
    seen = durable(met.groupBy("scope", "patch", "other").agg(F.min("apart").alias("best")))
    sure = seen.where(F.col("best") <= threshold).select("scope", "patch", "other")
    still = seen.where(F.col("best") > threshold).select("scope", "patch", "other")
    if still.isEmpty():
        return sure
    doubt = durable(met.join(still, ["scope", "patch", "other"], "left_semi").select("scope", _key("patch", "cell_a").alias("cell_a"), _key("other", "cell_b").alias("cell_b")))
    late = linked_cells(points.select("scope", _key("patch", "cell").alias("cell"), "ux", "uy", "uz"), doubt, threshold, cell)
    return sure.unionByName(late.select("scope", F.col("cell_a.patch").alias("patch"), F.col("cell_b.patch").alias("other")).distinct())


def _near_patches(patches: DataFrame) -> DataFrame:
    """scope, patch, other (patch < other): patches near enough to hold neighbours."""
    reach = math.ceil(math.sqrt(3)) + 1
    steps = [(i, j, k) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) for k in range(-reach, reach + 1) if (i, j, k) > (0, 0, 0)]
    around = F.explode(F.array(*(F.struct(*(F.lit(o).alias(a) for o, a in zip(s, "xyz"))) for s in steps))).alias("s")
    shifted = patches.select("scope", "patch", around).select("scope", "patch", F.struct(*((F.col(f"patch.{a}") + F.col(f"s.{a}")).alias(a) for a in "xyz")).alias("other"))
    return shifted.join(patches.select("scope", F.col("patch").alias("other")), ["scope", "other"])


def _first_parts(cells: DataFrame, threshold: float, slack: float) -> DataFrame:
    """Patches joined by one point of each of their cells: (scope, patch, part), and with ``other`` the cells that may still join two parts.

    ``cells``: scope, patch, cell, r. Two points of a cell and the cell's own are at most ``slack`` farther apart than those are.
    """
    kind = dict(cells.dtypes)

    def kernel(table: pa.Table) -> pa.Table:
        u = np.stack([table[f"u{c}"].to_numpy() for c in "xyz"], 1)
        patch = np.stack([table[f"p{c}"].to_numpy() for c in "xyz"], 1)
        patch = np.unique(patch, axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(patch, kind="stable")
        begin = np.searchsorted(patch[order], np.arange(patch.max() + 2))
        head, size = order[begin[:-1]], np.diff(begin)
        m, step = len(head), max(1, 4_000_000 // len(head))
        radius = np.zeros(m)
        np.maximum.at(radius, patch, np.arccos(np.clip((u * u[head[patch]]).sum(1), -1, 1)))
        sure, maybe = [], []
        for i in range(0, m, step):
            apart = np.arccos(np.clip(u[head[i : i + step]] @ u[head].T, -1, 1))
            apart[np.arange(m)[None, :] <= np.arange(i, min(m, i + step))[:, None]] = np.inf
            sure.append(np.argwhere(apart <= threshold) + [i, 0])
            maybe.append(np.argwhere((apart > threshold) & (apart - radius[i : i + step, None] - radius[None, :] <= threshold + slack)) + [i, 0])
        sure, maybe = np.concatenate(sure), np.concatenate(maybe)
        part = joined(m, sure[:, 0], sure[:, 1])
        maybe = maybe[part[maybe[:, 0]] != part[maybe[:, 1]]]
        late, doubt = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        n = size[maybe[:, 0]] * size[maybe[:, 1]]
        cut = np.searchsorted(np.cumsum(n), np.arange(0, n.sum() + 4_000_000, 4_000_000))
        for lo, hi in zip(cut[:-1], cut[1:]):  # all cells of one patch with all of the other, some patches at a time
            mine, k = maybe[lo:hi], n[lo:hi]
            row = np.repeat(np.arange(len(mine)), k)
            at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            a = order[begin[mine[row, 0]] + at // size[mine[row, 1]]]
            b = order[begin[mine[row, 1]] + at % size[mine[row, 1]]]
            apart = np.arccos(np.clip((u[a] * u[b]).sum(1), -1, 1))
            late.append(mine[np.unique(row[apart <= threshold])])
            some = (apart > threshold) & (apart <= threshold + slack)
            doubt.append(np.stack([a[some], b[some]], 1))
        links = np.concatenate([sure, *late])
        part = joined(m, links[:, 0], links[:, 1])
        doubt = np.concatenate(doubt)
        doubt = doubt[part[patch[doubt[:, 0]]] != part[patch[doubt[:, 1]]]]
        first = np.append(head, doubt[:, 0])
        second = pa.array(np.append(np.zeros(m, np.int64), doubt[:, 1]), mask=np.arange(m + len(doubt)) < m)
        take = lambda c, i: table[c].combine_chunks().take(i)
        one = pa.array(first)
        return pa.table({"scope": take("scope", one), "patch": take("patch", one), "cell": take("cell", one), "part": pa.array(part[patch[first]], pa.int32()), "other": take("patch", second), "other_cell": take("cell", second)})

    rows = cells.select("scope", "patch", "cell", *(F.col(f"patch.{c}").alias(f"p{c}") for c in "xyz"), *(F.col(f"r.u{c}").alias(f"u{c}") for c in "xyz"))
    return in_runs(rows, ["scope"], kernel, f"scope {kind['scope']}, patch {kind['patch']}, cell {kind['cell']}, part int, other {kind['patch']}, other_cell {kind['cell']}")


def _joined_parts(links: DataFrame) -> DataFrame:
    """scope, part, root: the lowest of the parts that ``links`` (scope, part, to) join."""

    def kernel(table: pa.Table) -> pa.Table:
        a, b = table["part"].to_numpy(), table["to"].to_numpy()
        part = np.unique(np.append(a, b))
        label = joined(len(part), np.searchsorted(part, a), np.searchsorted(part, b))
        lowest = part[np.unique(label, return_index=True)[1]]
        return pa.table({"scope": pa.repeat(table["scope"][0], len(part)), "part": pa.array(part), "root": pa.array(lowest[label])})

    return in_runs(links, ["scope"], kernel, f"scope {dict(links.dtypes)['scope']}, part int, root int")


def _labelled(points: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``nodes`` with the lowest label of their component; a scope's patches and cells are in one task."""
    edge, slack = _cell(threshold)
    cells = points.groupBy("scope", "patch", "cell").agg(F.min_by(F.struct("ux", "uy", "uz"), "pid").alias("r"))
    first = durable(_first_parts(cells, threshold, slack))
    parts = first.where("other IS NULL").select("scope", "patch", "part")
    doubt = first.where("other IS NOT NULL").select("scope", _key("patch", "cell").alias("cell_a"), _key("other", "other_cell").alias("cell_b"))
    if not doubt.isEmpty():
        late = linked_cells(points.select("scope", _key("patch", "cell").alias("cell"), "ux", "uy", "uz"), doubt, threshold, edge)
        links = late.select("scope", F.col("cell_a.patch").alias("patch"), F.col("cell_b.patch").alias("other")).distinct()
        ends = links.join(parts, ["scope", "patch"]).join(parts.select("scope", F.col("patch").alias("other"), F.col("part").alias("to")), ["scope", "other"])
        roots = _joined_parts(ends.select("scope", "part", "to").distinct())
        parts = parts.join(roots, ["scope", "part"], "left").select("scope", "patch", F.coalesce("root", "part").alias("part"))
    mine = parts.join(nodes, ["scope", "patch"])
    lowest = mine.groupBy("scope", "part").agg(F.min("label").alias("label"))
    return mine.drop("label").join(lowest, ["scope", "part"]).select("scope", "patch", "label")


def _spread(points: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The same by rounds over all scopes: labels go to the neighbours until they stand, as many rounds as patches in a row at most."""
    links = _cells(points, _near_patches(nodes.select("scope", "patch")), threshold)
    links = durable(links.unionByName(links.select("scope", F.col("other").alias("patch"), F.col("patch").alias("other"))))
    while True:
        lower = links.join(nodes.select("scope", F.col("patch").alias("other"), F.col("label").alias("theirs")), ["scope", "other"]).groupBy("scope", "patch").agg(F.min("theirs").alias("theirs"))
        step = nodes.join(lower, ["scope", "patch"], "left")
        step = durable(step.select("scope", "patch", F.least("label", F.coalesce("theirs", "label")).alias("label"), (F.col("theirs") < F.col("label")).alias("changed")))
        nodes = step.select("scope", "patch", "label")
        if step.where("changed").isEmpty():
            return nodes


def components(points: DataFrame, threshold: float) -> DataFrame:
    """scope, pid, first_pid: each point (scope, pid, theta, phi) with the lowest pid of its component.

    Points at most ``threshold`` radians apart on the sphere are joined. Repeated points are of one
    component. Angles are finite; a scope without points has no row.
    """
    edge = 2 * math.sin(threshold / 2) / math.sqrt(3) * (1 - 1e-9)
    u = unit(F.col("theta"), F.col("phi"))
    p = points.select("scope", "pid", *(c.alias(f"u{a}") for c, a in zip(u, "xyz")))
    p = p.withColumns(
        {
            "patch": F.struct(*(F.floor(F.col(f"u{a}") / edge).alias(a) for a in "xyz")),
            "cell": F.struct(*(F.floor(F.col(f"u{a}") / (edge / FINE)).alias(a) for a in "xyz")),
        }
    )
    p = durable(p)
    nodes = durable(p.groupBy("scope", "patch").agg(F.min("pid").alias("label")))
    # A surface of area 4 pi meets some 1.5 patches for each patch's face.
    few = 1.5 * 4 * math.pi / edge**2 <= PATCHES
    nodes = (_labelled if few else _spread)(p, nodes, threshold)
    return p.select("scope", "pid", "patch").join(nodes, ["scope", "patch"]).select("scope", "pid", F.col("label").alias("first_pid"))
