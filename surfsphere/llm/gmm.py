"""Sites of poses on the sphere by Gaussian mixtures (problem 2).

The poses of a run are summed up in small cells of the unit sphere, so that a run is at most CELLS_OF_A_SPHERE
rows however many poses it has, and every pose still counts. Per run, the cells' directions are standardised and
turned to their principal axes, of which those without spread are left out; mixtures of growing numbers of
components are fitted by expectation-maximisation with a regularised covariance, and the Bayesian information
criterion picks one. Tasks fit many runs of like size at once as batched matrix products.

A component is a cluster. An exact check of the clusters follows, as sites are defined by a distance: within
each component, patches at most LINK_DEGREES apart are joined, and one that falls apart becomes several
clusters; then only the clusters' borders are looked at, and clusters whose poses come that near are one site.
What the cells can't decide is decided by the poses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import joined, linked_cells
from ..session import durable
from .topn import top_n

LINK_DEGREES = 15.0
#: Cells along the unit axis: an edge is some 0.9 degrees, and a sphere touches some 70,000 of them.
CELLS, PATCHES = 64, 14
CELLS_OF_A_SPHERE = 70_000
#: Numbers of components tried, in this order until the criterion gets worse PATIENCE times in a row.
LADDER, PATIENCE = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128), 2
#: EM goes on until the mean log likelihood of a pose gains less than GAIN, ROUNDS times at most; least variance of a
#: component in standardised units; rows of whole runs that a task treats at once.
GAIN, ROUNDS, RIDGE, CHUNK = 1e-3, 60, 0.01, 150_000
#: Pairs of patches, and of cells, compared at once.
PAIRS = 4_000_000
TYPICAL = 3


def unit_vector(theta: Column, phi: Column) -> list[Column]:
    return [F.sin(phi) * F.cos(theta), F.sin(phi) * F.sin(theta), F.cos(phi)]


def located(poses: DataFrame) -> DataFrame:
    """Different poses with both angles: run_id, pose_id, cluster_id, ux, uy, uz, cell.

    Null, NaN and infinite angles leave a pose unlocated. A pose delivered several times counts
    once (its rows are alike; were they not, with the lowest of each value).
    """
    inf = float("inf")
    ok = F.col("run_id").isNotNull() & F.col("pose_id").isNotNull() & (F.abs("theta") < inf) & (F.abs("phi") < inf)
    one = poses.where(ok).groupBy("run_id", "pose_id").agg(*(F.min(c).alias(c) for c in ("cluster_id", "theta", "phi")))
    u = unit_vector(F.col("theta"), F.col("phi"))
    out = one.select("run_id", "pose_id", "cluster_id", *(c.alias(n) for c, n in zip(u, ("ux", "uy", "uz"))))
    part = [F.floor((F.col(c) + 1) * CELLS).cast("int") for c in ("ux", "uy", "uz")]
    return out.withColumn("cell", (part[0] * 256 + part[1]) * 256 + part[2])


def summed_cells(poses: DataFrame) -> DataFrame:
    """run_id, cell, cluster_id, n and the sums of the unit vectors: what the mixtures are fitted to."""
    return poses.groupBy("run_id", "cell", "cluster_id").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in ("ux", "uy", "uz")))


def _quadratic(x: np.ndarray) -> np.ndarray:
    """(B, L, 3) -> (B, L, 10): 1, x, and the products of x's parts."""
    a, b, c = x[..., 0], x[..., 1], x[..., 2]
    return np.stack([np.ones_like(a), a, b, c, a * a, b * b, c * c, a * b, a * c, b * c], -1)


def _theta(weight: np.ndarray, mu: np.ndarray, cov: np.ndarray, dims: np.ndarray) -> np.ndarray:
    """Log densities of the components as linear forms of the quadratic features: (B, 10, K)."""
    p = np.linalg.inv(cov)
    pm = np.einsum("bkij,bkj->bki", p, mu)
    const = np.log(np.maximum(weight, 1e-12)) - 0.5 * (np.einsum("bki,bki->bk", mu, pm) + np.linalg.slogdet(cov)[1] + dims[:, None] * np.log(2 * np.pi))
    quad = [-0.5 * p[..., i, i] for i in range(3)] + [-p[..., 0, 1], -p[..., 0, 2], -p[..., 1, 2]]
    return np.stack([const, pm[..., 0], pm[..., 1], pm[..., 2], *quad], 1)


class _Seeds:
    """The heaviest cell of each run, then again and again the one farthest from all before, heavy ones first."""

    def __init__(self, x: np.ndarray, w: np.ndarray):
        self.x, self.pull = x, np.sqrt(w)
        self.far, self.found = np.full(w.shape, np.inf), [w.argmax(1)]

    def first(self, k: int) -> np.ndarray:
        """(B, k) cells."""
        row = np.arange(len(self.x))
        while len(self.found) < k:
            self.far = np.minimum(self.far, ((self.x - self.x[row, self.found[-1]][:, None]) ** 2).sum(2))
            self.found.append((self.far * self.pull).argmax(1))
        return np.stack(self.found[:k], 1)


def _fit(q: np.ndarray, w: np.ndarray, dims: np.ndarray, mu: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM of mixtures that start at the means ``mu`` (B, K, 3), until they settle: (log densities (B, L, K), their sums (B, L), the sums' slopes (B, L, 3))."""
    k, total = mu.shape[1], w.sum(1)
    theta = _theta(np.full(mu.shape[:2], 1.0 / k), mu, np.broadcast_to(np.eye(3) / k ** (2 / 3), (len(mu), k, 3, 3)), dims)
    open_runs, reached = np.arange(len(mu)), np.full(len(mu), -np.inf)
    for _ in range(ROUNDS):
        qb, wb = q[open_runs], w[open_runs]
        log = np.matmul(qb, theta[open_runs])
        top = log.max(2, keepdims=True)
        resp = np.exp(log - top)
        whole = resp.sum(2)
        mean = (wb * (top[..., 0] + np.log(whole))).sum(1) / total[open_runs]
        going = mean - reached[open_runs] >= GAIN
        reached[open_runs] = mean
        if not going.any():
            break
        open_runs, qb, resp = open_runs[going], qb[going], resp[going] * (wb / whole)[going][..., None]
        stat = np.matmul(resp.transpose(0, 2, 1), qb)
        n = np.maximum(stat[..., 0], 1e-9)
        mean3, square = stat[..., 1:4] / n[..., None], stat[..., 4:] / n[..., None]
        cov = np.empty((len(open_runs), k, 3, 3))
        for i in range(3):
            cov[..., i, i] = square[..., i] - mean3[..., i] ** 2
        for i, (a, c) in enumerate(((0, 1), (0, 2), (1, 2))):
            cov[..., a, c] = cov[..., c, a] = square[..., 3 + i] - mean3[..., a] * mean3[..., c]
        theta[open_runs] = _theta(n / total[open_runs][:, None], mean3, cov + RIDGE * np.eye(3), dims[open_runs])
    log = np.matmul(q, theta)
    top = log.max(2)
    resp = np.exp(log - top[..., None])
    whole = resp.sum(2)
    form = np.matmul(resp / whole[..., None], theta.transpose(0, 2, 1))  # (B, L, 10): the forms, weighted by the components' shares
    x = q[..., 1:4]
    pair = form[..., 7:]  # of xy, xz and yz
    slope = form[..., 1:4] + 2 * form[..., 4:7] * x + np.stack(
        [pair[..., 0] * x[..., 1] + pair[..., 1] * x[..., 2], pair[..., 0] * x[..., 0] + pair[..., 2] * x[..., 2], pair[..., 1] * x[..., 0] + pair[..., 2] * x[..., 1]], -1
    )
    return log, top + np.log(whole), slope


def fit_mixtures(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mixtures of B runs of up to L cells each (weight 0: no cell): component, log density and its slope at every cell, components chosen.

    ``u`` (B, L, 3) are mean directions, ``w`` (B, L) numbers of poses.
    """
    total = w.sum(1)
    mean = (u * w[..., None]).sum(1) / total[:, None]
    std = np.sqrt((((u - mean[:, None]) ** 2) * w[..., None]).sum(1) / total[:, None])
    x = (u - mean[:, None]) / np.maximum(std, 1e-4)[:, None]
    scatter = np.einsum("bl,bli,blj->bij", w, x, x) / total[:, None, None]
    spread, axes = np.linalg.eigh(scatter)
    kept = spread > 1e-3 * np.maximum(spread[:, -1:], 1e-12)
    x = np.matmul(x, axes) * kept[:, None, :]
    dims = np.maximum(kept.sum(1), 1)
    q, cells = _quadratic(x), (w > 0).sum(1)
    seeds = _Seeds(np.where(w[..., None] > 0, x, 0), w)
    best = np.full(len(u), np.inf)
    comp, density, chosen = np.zeros(w.shape, np.int64), np.zeros(w.shape), np.zeros(len(u), np.int64)
    slope = np.zeros((*w.shape, 3))
    back = (axes * kept[:, None, :]).transpose(0, 2, 1) / np.maximum(std, 1e-4)[:, None, :]  # from the principal axes to directions
    worse = np.zeros(len(u), np.int64)
    for k in LADDER:
        at = np.flatnonzero((worse < PATIENCE) & (cells >= max(1, 2 * k - 1)))
        if not len(at) or k > w.shape[1]:
            break
        step = max(1, 3_000_000 // (w.shape[1] * k))
        first = seeds.first(k)
        for s in range(0, len(at), step):
            b = at[s : s + step]
            log, dens, tilt = _fit(q[b], w[b], dims[b], x[b[:, None], first[b]])
            parts = 1 + dims[b] + dims[b] * (dims[b] + 1) / 2
            bic = -2 * (w[b] * np.where(w[b] > 0, dens, 0)).sum(1) + (k * parts - 1) * np.log(np.maximum(total[b], 2))
            better = bic < best[b]
            won = b[better]
            best[won], chosen[won] = bic[better], k
            comp[won], density[won], slope[won] = log[better].argmax(2), dens[better], np.matmul(tilt[better], back[won])
            worse[won] = 0
            worse[b[~better]] += 1
    return comp, density, slope, chosen


def _near(centre: np.ndarray, radius: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, angle) of pairs a < b of caps that come within ``limit`` of each other, some at a time."""
    edge = 2 * np.sin(min(np.pi, limit + 2 * radius.max()) / 2) + 1e-9
    box = np.floor((centre + 1) / edge).astype(np.int64) + 1
    width = box.max() + 2
    key = (box[:, 0] * width + box[:, 1]) * width + box[:, 2]
    order = np.argsort(key, kind="stable")
    found, begin = np.unique(key[order], return_index=True)
    size = np.diff(np.append(begin, len(key)))
    for step in [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]:
        to = found + (step[0] * width + step[1]) * width + step[2]
        there = np.minimum(np.searchsorted(found, to), len(found) - 1)
        mine = np.flatnonzero(found[there] == to)
        n = size[mine] * size[there[mine]]
        for part in np.split(mine, np.searchsorted(np.cumsum(n), np.arange(PAIRS, n.sum(), PAIRS))):
            k = size[part] * size[there[part]]
            row, at = np.repeat(part, k), np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            a, b = order[begin[row] + at // size[there[row]]], order[begin[there[row]] + at % size[there[row]]]
            a, b = a[a < b], b[a < b]
            angle = np.arccos(np.clip((centre[a] * centre[b]).sum(1), -1, 1))
            close = angle - radius[a] - radius[b] <= limit
            yield a[close], b[close], angle[close]


def link_clusters(u: np.ndarray, comp: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(cluster, site of every cell of a run, pairs of cells in different sites that the cells leave undecided).

    Clusters are the components, or the connected parts of those that fall apart; sites are clusters joined at
    their borders. A patch is the part of a component in a coarse cell; all its poses are neighbours.
    """
    # The most that a pose and its cell's mean direction are apart, in radians; a cell of one pose is that pose.
    slack = np.where(weight > 1, np.sqrt(3) / CELLS * 1.02, 1e-7)
    limit = np.radians(LINK_DEGREES)
    patches, patch_of = np.unique(np.column_stack([comp, np.floor((u + 1) * PATCHES)]), axis=0, return_inverse=True)
    patch_of, m = patch_of.ravel(), len(patches)
    centre = np.stack([np.bincount(patch_of, u[:, i], m) for i in range(3)], 1)
    centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    radius = np.zeros(m)
    np.maximum.at(radius, patch_of, np.arccos(np.clip((u * centre[patch_of]).sum(1), -1, 1)) + slack)
    found = [np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *_near(centre, radius, limit))] if m > 1 else [np.zeros(0, np.int64)] * 3
    a, b, angle = found
    sure = angle + radius[a] + radius[b] <= limit
    within = patches[a, 0] == patches[b, 0]
    order = np.argsort(patch_of, kind="stable")
    begin = np.searchsorted(patch_of[order], np.arange(m + 1))

    def decided(part: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """``part`` joined where cells of the pairs ``some`` of patches decide it, and the pairs of cells that don't."""
        doubt = []
        some = some & (part[a] != part[b])
        for i, j in zip(a[some], b[some]):
            if part[i] != part[j]:
                ca, cb = order[begin[i] : begin[i + 1]], order[begin[j] : begin[j + 1]]
                d = np.arccos(np.clip(u[ca] @ u[cb].T, -1, 1))
                both = slack[ca][:, None] + slack[cb][None, :]
                if (d + both <= limit).any():
                    part[part == part[j]] = part[i]
                elif (d - both <= limit).any():
                    x, y = np.nonzero(d - both <= limit)
                    doubt += list(zip(ca[x], cb[y]))
        return part, doubt

    # Each component for itself, then the borders between the clusters.
    cluster, doubt = decided(joined(m, a[sure & within], b[sure & within]), ~sure & within)
    across = sure & ~within
    cluster = np.unique(cluster, return_inverse=True)[1]
    merged = joined(cluster.max() + 1, cluster[a[across]], cluster[b[across]])[cluster]
    site, more = decided(merged, ~sure & ~within)
    doubt = [(x, y) for x, y in doubt + more if site[patch_of[x]] != site[patch_of[y]]]
    return cluster[patch_of], np.unique(site, return_inverse=True)[1][patch_of], doubt


LABELS = "run_id string, cell int, cluster_id int, n bigint, component int, n_components int, density double, level double, sx double, sy double, sz double, cluster int, site int, doubt_cell int"


def _label_runs(rows: pd.DataFrame) -> pd.DataFrame:
    """Labels of whole runs; ``doubt_cell`` rows, with n 0, name pairs of cells that need their poses."""
    rows = rows.sort_values(["run_id", "cell"], kind="stable", ignore_index=True)
    run = rows["run_id"].to_numpy()
    fresh = np.append(True, (run[1:] != run[:-1]) | (rows["cell"].to_numpy()[1:] != rows["cell"].to_numpy()[:-1]))
    cell_of = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    weight = np.add.reduceat(rows["n"].to_numpy(float), first)
    sums = np.stack([np.add.reduceat(rows[c].to_numpy(float), first) for c in ("ux", "uy", "uz")], 1)
    u = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    begin = np.flatnonzero(np.append(True, run[first][1:] != run[first][:-1]))
    size = np.diff(np.append(begin, len(first)))
    comp, density, slope, chosen = np.zeros(len(first), np.int64), np.zeros(len(first)), np.zeros((len(first), 3)), np.zeros(len(first), np.int64)
    level = np.ceil(np.log2(size)).astype(int)
    for lv in np.unique(level):  # runs of like size are fitted together
        mine = np.flatnonzero(level == lv)
        length = size[mine].max()
        for part in np.array_split(mine, max(1, len(mine) * length // 500_000 + 1)):
            if not len(part):
                continue
            idx = begin[part][:, None] + np.arange(length)
            real = np.arange(length) < size[part][:, None]
            idx = np.where(real, idx, 0)
            c, d, g, k = fit_mixtures(u[idx], np.where(real, weight[idx], 0.0))
            comp[idx[real]], density[idx[real]], slope[idx[real]] = c[real], d[real], g[real]
            chosen[idx[real]] = np.repeat(k, size[part])
    cluster, site = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    doubts = []
    cells = rows["cell"].to_numpy()[first]
    for b, n in zip(begin, size):
        cluster[b : b + n], site[b : b + n], doubt = link_clusters(u[b : b + n], comp[b : b + n], weight[b : b + n])
        doubts += [(run[first[b]], cells[b + i], cells[b + j]) for i, j in doubt]
    at_zero = density - (slope * u).sum(1)  # so that a pose's density is level + slope * direction
    out = rows[["run_id", "cell", "cluster_id", "n"]].assign(component=comp[cell_of], n_components=chosen[cell_of], density=density[cell_of], level=at_zero[cell_of], sx=slope[cell_of, 0], sy=slope[cell_of, 1], sz=slope[cell_of, 2], cluster=cluster[cell_of], site=site[cell_of], doubt_cell=None)
    if doubts:
        extra = pd.DataFrame(doubts, columns=["run_id", "cell", "doubt_cell"]).assign(n=0)
        out = pd.concat([out, extra], ignore_index=True)
    for c in ("cluster_id", "component", "n_components", "cluster", "site", "doubt_cell"):
        out[c] = out[c].astype("Int32")
    return out


def _kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    rows = 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        rows += len(b)
        if rows >= CHUNK:
            whole = pd.concat(held, ignore_index=True)
            last = whole["run_id"] == whole["run_id"].iloc[-1]  # may go on in the next batch
            if not last.all():
                yield _label_runs(whole[~last])
                whole = whole[last]
            held, rows = [whole], len(whole)
    if held:
        yield _label_runs(pd.concat(held, ignore_index=True))


def label_cells(poses: DataFrame) -> DataFrame:
    """Every run's cells with component, density and site; ``poses`` as ``located`` gives them.

    A run is one group of at most CELLS_OF_A_SPHERE cells times its cluster ids.
    """
    cells = summed_cells(poses).withColumn("cluster_id", F.col("cluster_id").cast("int"))
    # Nullable integers come as floats with NaN; cluster ids fit a double exactly.
    spread = cells.repartition("run_id").sortWithinPartitions("run_id")
    labels = durable(spread.mapInPandas(_kernel, LABELS))
    doubt = labels.where("doubt_cell IS NOT NULL")
    sure = labels.where("doubt_cell IS NULL").drop("doubt_cell")
    if not doubt.isEmpty():
        sure = _decide(sure, doubt, poses)
    return sure


def _decide(labels: DataFrame, doubt: DataFrame, poses: DataFrame) -> DataFrame:
    """Joins sites whose doubtful cells hold poses at most LINK_DEGREES apart."""
    site_of = labels.select("run_id", "cell", "site").distinct()
    points = poses.select(F.col("run_id").alias("scope"), "cell", "ux", "uy", "uz")
    pairs = doubt.select(F.col("run_id").alias("scope"), F.col("cell").alias("cell_a"), F.col("doubt_cell").alias("cell_b")).distinct()
    linked = linked_cells(points, pairs, float(np.radians(LINK_DEGREES)), 1 / CELLS).select(F.col("scope").alias("run_id"), F.col("cell_a").alias("cell"), F.col("cell_b").alias("doubt_cell")).distinct()
    pairs = (
        linked.join(site_of, ["run_id", "cell"]).join(site_of.select("run_id", F.col("cell").alias("doubt_cell"), F.col("site").alias("other")), ["run_id", "doubt_cell"])
        .select("run_id", "site", "other").distinct()
    )

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        sites = np.unique(g[["site", "other"]].to_numpy())
        part = joined(len(sites), np.searchsorted(sites, g["site"]), np.searchsorted(sites, g["other"]))
        return pd.DataFrame({"run_id": g["run_id"].iloc[0], "site": sites, "merged": sites[np.unique(part, return_index=True)[1]][part]})

    merged = pairs.groupBy("run_id").applyInPandas(merge, "run_id string, site int, merged int")  # a run's sites, not its poses
    return labels.join(merged, ["run_id", "site"], "left").withColumn("site", F.coalesce("merged", "site")).drop("merged")


def own_ids(labels: DataFrame) -> DataFrame:
    """run_id, site, own_id, n_poses: the non-null cluster_id of most of a site's poses (ties: the lowest; null if none has one)."""
    count = labels.groupBy("run_id", "site", "cluster_id").agg(F.sum("n").alias("n"))
    named = F.when(F.col("cluster_id").isNotNull(), F.struct(F.col("n").alias("n"), (-F.col("cluster_id")).alias("id")))
    return count.groupBy("run_id", "site").agg((-F.max(named)["id"]).alias("own_id"), F.sum("n").alias("n_poses"))


def strays(poses: DataFrame) -> DataFrame:
    """run_id, pose_id of the located poses whose cluster_id isn't their site's own; null ids are no strays."""
    spots = located(poses)
    labels = label_cells(spots)
    wrong = labels.join(own_ids(labels), ["run_id", "site"]).where("cluster_id <> own_id").select("run_id", "cell", "cluster_id")
    return spots.join(wrong, ["run_id", "cell", "cluster_id"]).select("run_id", "pose_id")


def sites(poses: DataFrame) -> DataFrame:
    """run_id, site, n_poses, own_id, n_components, typical: every site with its densest TYPICAL poses.

    A pose's density is the mixture's at its cell's mean direction, carried on to its own by its slope there.
    Sites are numbered within a run. Equally dense poses come by pose_id. Poses without angles are in none;
    a run without located poses has no site.
    """
    spots = located(poses)
    labels = label_cells(spots)
    dense = labels.groupBy("run_id", "cell").agg(*(F.first(c).alias(c) for c in ("site", "component", "level", "sx", "sy", "sz")))
    own = F.col("level") + F.col("sx") * F.col("ux") + F.col("sy") * F.col("uy") + F.col("sz") * F.col("uz")
    ranked = top_n(spots.join(dense, ["run_id", "cell"]).withColumn("rarity", -own), ["run_id", "site"], "pose_id", "rarity", TYPICAL)
    typical = ranked.groupBy("run_id", "site").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pose_id"))), lambda r: r["pose_id"]).alias("typical"))
    parts = dense.groupBy("run_id", "site").agg(F.countDistinct("component").alias("n_components"))
    return own_ids(labels).join(parts, ["run_id", "site"]).join(typical, ["run_id", "site"], "left").select("run_id", "site", "n_poses", "own_id", "n_components", "typical")
