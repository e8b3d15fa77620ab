"""Reference operators against brute force and known values."""

import math
import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from surfsphere import cli
from surfsphere.functions import angles
from surfsphere.functions.stats import incomplete_beta, t_two_sided, welch_moments
from surfsphere.operators import clusters, components, grids, mesh, nearest, residues, runs, surface
from surfsphere.plans import layers, reference_queries
from surfsphere.plans.pipeline import MapOptions, MissingResidues, SurfaceMap
from surfsphere.sources import pdb, writers
from surfsphere.streaming import arrivals


def test_students_t(spark):
    t, dof = np.array([0.190046, 49.581314, 0.0]), np.array([1.001385, 1.0, 5.0])
    assert np.allclose(incomplete_beta(dof / 2, 0.5, dof / (dof + t * t)), [0.880406, 0.012838, 1.0], atol=2e-6)
    df = spark.createDataFrame([(2, -6.36535, 0.00041760, 2, -6.26095, 0.60313), (1, 1.0, None, 1, 2.0, None), (1, 1.0, None, 3, 1.0, 0.0)], "a int, b double, c double, d int, e double, f double")
    m = welch_moments(*(F.col(c) for c in "abcdef"))
    got = df.select(m[0].alias("t"), m[1].alias("n"), m[2].alias("known")).withColumn("p", F.coalesce("known", t_two_sided("t", "n"))).collect()
    assert got[0]["p"] == pytest.approx(0.880406, abs=1e-4)
    assert [r["p"] for r in got[1:]] == [0.0, 1.0]


def test_components_against_brute_force(spark):
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(7, 3))
    u = centres[rnd.integers(0, 7, 250)] + rnd.normal(size=(250, 3)) * rnd.choice([0.05, 0.4], (250, 1))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    theta, phi = np.arctan2(u[:, 1], u[:, 0]), np.arccos(u[:, 2])
    for limit in (0.1, 0.26):
        near = np.arccos(np.clip(u @ u.T, -1, 1)) <= limit
        label = np.arange(250)
        while True:
            new = np.array([label[near[i]].min() for i in range(250)])
            if (new == label).all():
                break
            label = new
        df = spark.createDataFrame([("r", i, float(a), float(b)) for i, (a, b) in enumerate(zip(theta, phi))], "scope string, pid bigint, theta double, phi double")
        got = {r["pid"]: r["first_pid"] for r in components.components(df, limit).collect()}
        assert got == dict(enumerate(label.tolist()))
    assert components.components(df.limit(0), 0.2).count() == 0


def labels_of(u, limit):
    near = np.arccos(np.clip(u @ u.T, -1, 1)) <= limit
    label = np.arange(len(u))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(u))])
        if (new == label).all():
            return dict(enumerate(label.tolist()))
        label = new


@pytest.mark.parametrize("few", [True, False])
def test_components_at_the_limit(spark, monkeypatch, few):
    """Dense edges a hair under and over the limit apart, with a task a scope and in rounds."""
    if not few:
        monkeypatch.setattr(components, "PATCHES", 0)
    rnd = np.random.default_rng(9)
    rows, want = [], {}
    limit = math.radians(15)
    for scope, gap in (("over", 15.0003), ("under", 14.9997), ("far", 40.0)):
        lon = np.radians(np.concatenate([[0.0], -rnd.uniform(0.0001, 3, 300), [gap], gap + rnd.uniform(0.0001, 3, 300)]))
        lat = np.radians(np.concatenate([[0.0], rnd.uniform(-2, 2, 300), [0.0], rnd.uniform(-2, 2, 300)]))
        u = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)
        want[scope] = labels_of(u, limit)
        rows += [(scope, i, float(a), float(math.pi / 2 - b)) for i, (a, b) in enumerate(zip(lon, lat))]
    df = spark.createDataFrame(rows + rows[:9], "scope string, pid bigint, theta double, phi double").withColumn("patch", F.lit(1))
    got = {}
    for r in components.components(df, limit).collect():
        got.setdefault(r["scope"], {})[r["pid"]] = r["first_pid"]
    assert got == want and len(set(got["over"].values())) == 2 and len(set(got["under"].values())) == 1


def test_parts_are_joined_by_their_links():
    rnd = np.random.default_rng(2)
    a, b = rnd.integers(0, 500, 350), rnd.integers(0, 500, 350)
    label = list(range(500))
    for x, y in zip(a.tolist(), b.tolist()):
        old, new = label[y], label[x]
        label = [new if v == old else v for v in label]
    got = components.joined(500, a, b)
    assert len(set(zip(got.tolist(), label))) == len(set(label)) == len(set(got.tolist()))
    assert components.joined(3, np.zeros(0, int), np.zeros(0, int)).tolist() == [0, 1, 2]


def test_runs_come_whole(spark, monkeypatch):
    """Groups that go on over batches, with null keys and several keys."""
    monkeypatch.setattr(runs, "HELD", 50)
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.randrange(5), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, v bigint")

    def one(t):
        return pa.table({"g": t["g"][:1], "k": t["k"][:1], "n": pa.array([t.num_rows]), "total": pa.array([sum(t["v"].to_pylist())])})

    got = [tuple(r) for r in runs.in_runs(df, ["g", "k"], one, "g string, k int, n bigint, total bigint").collect()]
    want = [tuple(r) for r in df.groupBy("g", "k").agg(F.count("v"), F.sum("v")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert runs.in_runs(df.limit(0), ["g"], one, "g string, k int, n bigint, total bigint").count() == 0


def test_sites_have_all_located_poses(spark, tmp_path):
    def row(i, score, degrees, cluster):
        return ("r", i, f"p{i}", score, None if degrees is None else math.radians(degrees), math.pi / 2, 1.0, cluster)

    rows = [row(1, -5.0, 0, 1), row(2, float("nan"), 12, None), row(3, -7.0, 24, 1), row(4, None, 90, 2), row(5, float("inf"), 91, None), row(6, None, 92, 2), row(7, None, 93, 2), row(8, -9.0, None, 1), row(9, -4.0, 150, 3)]
    df = spark.createDataFrame(rows, "run_id string, pose_idx bigint, pose_id string, vina_score double, theta double, phi double, proj_distance double, cluster_id int")
    df.unionByName(df.limit(2)).write.parquet(str(tmp_path / "poses_mapped.parquet"))
    got = {r["pose_id"]: r["raw_label"] for r in reference_queries.QUERIES["sphere_clusters"](spark, str(tmp_path)).collect()}
    assert got == {"p1": 0, "p2": 0, "p3": 0, "p4": 1, "p5": 1, "p6": 1, "p7": 1, "p9": 2}
    r = {x["cluster_id"]: x for x in reference_queries.QUERIES["site_summary"](spark, str(tmp_path)).collect()}
    assert [r[k]["n_poses"] for k in (1, 2, 3)] == [4, 3, 1] and r[1]["best_pose_id"] is None and r[1]["vina_score_avg"] is None and r[1]["p_value"] is None
    assert r[2]["best_pose_id"] == "p3" and r[2]["vina_score_avg"] == -6.0 and r[2]["p_value"] == 1.0 and 0 < r[3]["p_value"] < 1


def test_antipodal_cluster_falls_back_to_its_first_member(spark):
    df = spark.createDataFrame([("r", 1, "a", -5.0, 0.0, math.pi / 2, 1), ("r", 2, "b", -5.0, math.pi, math.pi / 2, 1)], "scope string, pose_idx int, pose_id string, score double, theta double, phi double, c int")
    r = clusters.summary(df, ["scope"], "c").first()
    assert r["best_pose_id"] == "a" and r["n_poses"] == 2 and r["p_value"] == 1.0


def test_nearest_and_rays_against_brute_force(spark):
    rnd = np.random.default_rng(3)
    tri = rnd.uniform(-40, 40, (120, 1, 3)) + rnd.uniform(-6, 6, (120, 3, 3))
    pts = rnd.uniform(-60, 60, (40, 3))
    t = spark.createDataFrame([("s", i, *map(float, x.ravel())) for i, x in enumerate(tri)], "scope string, tid bigint, " + ", ".join(f"{c}{a} double" for c in "abc" for a in "xyz"))
    p = spark.createDataFrame([("s", i, *map(float, x), 0.0, 0.0, 0.0) for i, x in enumerate(pts)], "scope string, pid bigint, px double, py double, pz double, ox double, oy double, oz double")
    bary = rnd.dirichlet((1, 1, 1), 4000)
    sample = np.einsum("nk,tkd->tnd", bary, tri)
    got = {r["pid"]: r for r in nearest.nearest(p, t).collect()}
    for i, q in enumerate(pts):
        d = np.sqrt(((sample - q) ** 2).sum(2)).min()
        assert got[i]["distance"] <= d + 1e-9 and got[i]["distance"] >= d - 0.5
    v = t.select("scope", "tid", "ax", "ay", "az")
    got = {r["pid"]: r["tid"] for r in nearest.nearest(p, v, nearest.VERTEX).collect()}
    assert got == {i: int(((tri[:, 0] - q) ** 2).sum(1).argmin()) for i, q in enumerate(pts)}
    hits = {r["pid"]: r for r in nearest.first_hits(p, t).collect()}
    for i, q in enumerate(pts):
        g = q / np.linalg.norm(q)
        best = None
        for k, (a, b, c) in enumerate(tri):
            m = np.stack([-g, b - a, c - a], 1)
            s, f, h = np.linalg.solve(m, -a)
            if s > 1e-9 and f >= 0 and h >= 0 and f + h <= 1 and (best is None or s < best[0]):
                best = (s, k)
        assert (i in hits) == (best is not None)
        if best:
            assert hits[i]["tid"] == best[1] and hits[i]["distance"] == pytest.approx(abs(best[0] - np.linalg.norm(q)), abs=1e-6)
    assert nearest.raycast(p, t).count() == len(pts)


@pytest.mark.parametrize("group, few", [(50_000, 10_000), (40, 0), (40, 10_000)])
def test_nearest_vertices_of_scopes_cut_into_cells(spark, monkeypatch, group, few):
    monkeypatch.setattr(nearest, "GROUP", group)
    monkeypatch.setattr(nearest, "FEW", few)
    monkeypatch.setattr(nearest, "PAIRS", 500)
    rnd = np.random.default_rng(5)
    sets = {}
    for scope, n, m in (("large", 400, 300), ("small", 12, 9), ("bare", 5, 0), ("idle", 0, 7)):
        pts, vs = rnd.uniform(-90, 90, (n, 3)), np.round(rnd.uniform(-90, 90, (m, 3)))
        vs[m // 2 :] = vs[: m - m // 2]  # equal places: the lowest tid wins
        if scope == "large":
            pts[:4] = [[9999.999, 9999.999, 9999.999], [-300.0, 0.0, 4000.0], [0.0, 0.0, 1e9], [-64.0, 64.0, 0.0]]
            pts[4:50] = rnd.uniform(-1, 1, (46, 3))
            vs[:40] = rnd.uniform(-1, 1, (40, 3))
        sets[scope] = pts, vs
    p = [(s, f"{s}{i}", *map(float, x)) for s, (pts, _) in sets.items() for i, x in enumerate(pts)] + [("large", "large7", 50.0, 50.0, 50.0)]
    v = [(s, 1000 - i, *map(float, x)) for s, (_, vs) in sets.items() for i, x in enumerate(vs)]
    p_df = spark.createDataFrame(p, "scope string, pid string, px double, py double, pz double")
    v_df = spark.createDataFrame(v, "scope string, tid bigint, ax double, ay double, az double")
    want = {}
    for s, pid, *x in p:
        for s2, tid, *y in v:
            if s == s2:
                d2 = (x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2 + (x[2] - y[2]) ** 2
                want[s, pid] = min(want.get((s, pid), (math.inf,)), (d2, tid, *y))
    got = nearest.nearest(p_df, v_df, nearest.VERTEX).collect()
    assert len(got) == len(want)
    assert {(r["scope"], r["pid"]): (r["distance"], r["tid"], r["qx"], r["qy"], r["qz"]) for r in got} == {k: (math.sqrt(w[0]), *w[1:]) for k, w in want.items()}


def test_nearest_vertices_compare_blocks_not_all_pairs(spark, monkeypatch):
    """Every point once met all vertices of the boxes it kept, as rows: 10 million pairs of 0.01 GB went to the disk."""
    compared = []
    plain = nearest._d2
    monkeypatch.setattr(nearest, "_d2", lambda p, t: compared.append(len(p) * len(t)) or plain(p, t))
    rnd = np.random.default_rng(6)
    p, t = rnd.uniform(0, 100, (3000, 3)), rnd.uniform(0, 100, (3000, 3))
    assert (nearest._closest(p, t) == nearest._all_pairs(p, t)).all()
    all_pairs = 9_000_000
    assert sum(compared) - all_pairs < all_pairs / 3
    p[7], t[3], t[5] = [np.nan, 0, 0], [np.inf, 0, 0], [0, np.nan, 0]
    assert (nearest._closest(p, t) == nearest._all_pairs(p, t)).all()
    odd = np.array([[np.nan, 0, 0], [np.inf, 0, 0]])
    assert nearest._all_pairs(np.zeros((1, 3)), odd).tolist() == [1] and nearest._closest(p, odd).tolist() == nearest._all_pairs(p, odd).tolist()


@pytest.mark.parametrize("group", [50_000, 60])
def test_first_hits_of_scopes_cut_into_directions(spark, monkeypatch, group):
    monkeypatch.setattr(nearest, "GROUP", group)
    monkeypatch.setattr(nearest, "MEETS", 16)
    rnd = np.random.default_rng(8)
    t, p = [], []
    for scope, n, m in (("large", 300, 500), ("small", 10, 12), ("bare", 4, 0), ("idle", 0, 4)):
        tri = rnd.uniform(-50, 50, (m, 1, 3)) + rnd.uniform(-1, 1, (m, 3, 3)) * rnd.choice([5, 60], (m, 1, 1))
        if scope == "large":
            tri[:50] = tri[50:100]  # equal hits: the lowest tid
            tri[100:110, 2] = tri[100:110, 1]  # flat
            tri[110, 0], tri[111] = 0.0, [[0, 1, 0], [0, -1, 1], [0, -1, -1]]  # a corner at the origin, the origin within
        t += [(scope, 900 - i, *map(float, x.ravel())) for i, x in enumerate(tri)]
        for i in range(n):
            x, o = rnd.uniform(-60, 60, 3), [0.0, -0.0, 0.0] if i % 3 else [20.0, 1.0, -3.0]
            x = o if i == 6 else [np.nan, 0.0, 0.0] if i == 7 else x * np.eye(3)[i % 3] if i < 20 else x
            p.append((scope, f"{scope}{i}", *map(float, x), *o))
    t = spark.createDataFrame(t, "scope string, tid bigint, " + ", ".join(f"{c}{a} double" for c in "abc" for a in "xyz"))
    p = spark.createDataFrame(p, "scope string, pid string, px double, py double, pz double, ox double, oy double, oz double")
    length = "sqrt((px - ox) * (px - ox) + (py - oy) * (py - oy) + (pz - oz) * (pz - oz))"
    rays = p.selectExpr("*", *(f"(p{a} - o{a}) / {length} AS g{a}" for a in "xyz")).where(f"{length} >= 1e-12")
    pairs = nearest.staged(rays.join(t, "scope"), nearest.RAY).where("t IS NOT NULL")
    want = {(r["scope"], r["pid"]): r["m"] for r in pairs.groupBy("scope", "pid").agg(F.min(F.struct("t", "tid", "px", "py", "pz", "ox", "oy", "oz")).alias("m")).collect()}
    rows = nearest.first_hits(p, t).collect()
    got = {(r["scope"], r["pid"]): r for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and len(got) > 150
    for k, m in want.items():
        assert got[k]["tid"] == m["tid"]
        assert got[k]["distance"] == pytest.approx(abs(m["t"] - math.dist((m["px"], m["py"], m["pz"]), (m["ox"], m["oy"], m["oz"]))), abs=1e-9)


def test_rays_skip_what_lies_beyond_their_hits(monkeypatch):
    """Every ray once met all triangles whose boxes it crosses; triangles as large as their structure are crossed by all."""
    met = []
    plain = nearest._hit
    monkeypatch.setattr(nearest, "_hit", lambda o, g, tri: met.append(len(g) * len(tri)) or plain(o, g, tri))
    rnd = np.random.default_rng(9)
    tri, o = rnd.uniform(-100, 100, (3000, 3, 3)), np.zeros(3)
    g = nearest._unit_rows(rnd.normal(size=(2000, 3)))
    t, tid = nearest._first(o, g, tri, np.arange(3000))
    assert sum(met) < 2000 * 3000 / 2
    all_t = plain(o, g, tri)
    assert (t == all_t.min(1)).all() and (tid == np.where(np.isfinite(t), all_t.argmin(1), -1)).all()


def _cloud_tables(spark, d):
    """Two structures with 25 and 5 interface atoms at 5 vertices; every row is there twice, atoms with another loaded_at."""
    atoms = [(s, i, "A", "ALA", i // 3, "", "CB", "C", 10.0 * (i % 5) + 0.5, i / 100, 0.0) for s, n in (("s", 25), ("t", 5)) for i in range(n)]
    a = spark.createDataFrame(atoms, "structure_id string, atom_idx bigint, chain string, resname string, resseq int, icode string, name string, element string, x double, y double, z double")
    a.withColumn("loaded_at", F.lit(1)).unionByName(a.withColumn("loaded_at", F.lit(2))).write.parquet(str(d / "atoms.parquet"))
    i = spark.createDataFrame(sorted({(x[0], x[2], x[4], "") for x in atoms}), "structure_id string, chain string, resseq int, icode string")
    i.unionByName(i).write.parquet(str(d / "interface_residues.parquet"))
    v = spark.createDataFrame([(s, k, 10.0 * k, 0.0, 0.0) for s in "st" for k in range(5)], "structure_id string, vid bigint, vx double, vy double, vz double")
    v.unionByName(v).write.parquet(str(d / "mesh_vertices.parquet"))


def test_atoms_of_the_cloud_are_shuffled_once(spark, tmp_path, monkeypatch):
    """They were shuffled to make them distinct and again to join them, more than the input each time."""
    _cloud_tables(spark, tmp_path)
    seen = []
    plain = nearest.nearest
    monkeypatch.setattr(nearest, "nearest", lambda points, *more: seen.append(points) or plain(points, *more))
    got = reference_queries.QUERIES["ppi_atom_cloud"](spark, str(tmp_path)).collect()
    assert sorted((r["scope"], r["atom_idx"]) for r in got) == [("s", i) for i in range(25)] + [("t", i) for i in range(5)]
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = seen[0].select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert plan.count("Exchange hashpartitioning") == 2  # atoms, interface


def test_footprint_histogram_keeps_no_copy_of_its_points(spark, tmp_path, monkeypatch):
    _cloud_tables(spark, tmp_path)
    monkeypatch.setattr(reference_queries, "durable", lambda df: pytest.fail("the points were written to the disk once more"))
    got = reference_queries.QUERIES["ppi_footprint_hist"](spark, str(tmp_path)).collect()
    assert {r["scope"] for r in got} == {"s"} and sum(r["value"] for r in got) == 25 and len(got) == len({(r["iy"], r["ix"]) for r in got})


def test_block_surface_equals_the_sparse_one(spark):
    rnd = np.random.default_rng(1)
    atoms = spark.createDataFrame([("s" if i % 2 else "t", *map(float, x), str(rnd.choice(["C", "H", "ZN"]))) for i, x in enumerate(rnd.uniform(0, 30, (60, 3)))] + [("s", 1.0, 1.0, 1.0, "C")] * 2, "scope string, x double, y double, z double, element string")
    field, grid = surface.density_field(atoms, 1.3, 1.6), surface.grid_of(atoms, 1.3, 1.6)
    cols = ["scope", "ix", "iy", "iz", "tet", "tri", *(F.round(f"{c}{a}", 7) for c in "abc" for a in "xyz")]
    sparse = sorted(map(tuple, surface.iso_triangles(field, grid, 1.3, 0.5).select(*cols).collect()))
    dense = sorted(map(tuple, surface.block_triangles(atoms, 1.3, 1.6, "max", 0.5).select(*cols).collect()))
    assert len(sparse) > 500 and sparse == dense
    with pytest.raises(ValueError):
        surface.block_triangles(atoms, iso=0.0)


def test_blur_keeps_the_sum_and_equals_the_spectrum(spark):
    h = np.zeros((18, 36))
    h[2, 3], h[17, 35] = 4.0, 1.0
    df = spark.createDataFrame([(int(i), int(j), float(h[i, j])) for i, j in np.argwhere(h)], "iy int, ix int, value double")
    out = np.zeros_like(h)
    for r in grids.blur(df, [], 2.6, 18, 36).collect():
        out[r["iy"], r["ix"]] = r["value"]
    ky, kx = np.fft.fftfreq(18) * 18, np.fft.fftfreq(36) * 36
    want = np.fft.ifft2(np.fft.fft2(h) * np.exp(-0.5 * (kx[None] ** 2 + ky[:, None] ** 2) / 2.6**2)).real
    assert np.allclose(out, want, atol=1e-12) and out.sum() == pytest.approx(5.0)
    dense = np.zeros((36, 36))
    for r in grids.blur_dense(df.withColumn("g", F.lit(1)), ["g"], 2.6, 36).collect():
        dense[r["iy"], r["ix"]] = r["value"]
    k = np.fft.fftfreq(36) * 36
    square = np.zeros((36, 36))
    square[:18] = h
    assert np.allclose(dense, np.fft.ifft2(np.fft.fft2(square) * np.exp(-0.5 * (k[None] ** 2 + k[:, None] ** 2) / 2.6**2)).real, atol=1e-12)


def test_levels_without_the_grids(spark):
    df = spark.createDataFrame([(g, int(i), int(j), 1.0) for g in (1, 2) for i, j in np.random.default_rng(g).integers(0, 20, (30, 2))], "g int, iy int, ix int, value double")
    want = {r["g"]: (r["peak"], r["level"]) for r in grids.contour_levels(grids.blur_dense(df, ["g"], 2.6, 20), ["g"]).collect()}
    sparse = {g: max(r["value"] for r in grids.blur(df.where(F.col("g") == g), ["g"], 2.6, 20, 20).collect()) for g in (1, 2)}
    got = {r["g"]: (r["peak"], r["level"]) for r in grids.blurred_levels(df, ["g"], 2.6, 20).collect()}
    for g in (1, 2):
        assert got[g] == pytest.approx(want[g]) and got[g][0] == pytest.approx(sparse[g])


def test_bins_follow_the_edges(spark):
    edges = np.linspace(-math.pi, math.pi, 361)
    x = np.concatenate([edges, edges + 1e-13, np.random.default_rng(0).uniform(-4, 4, 500)])
    got = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(grids.clipped_bin(F.col("x"), -math.pi, math.pi, 360)).collect()]
    assert got == np.clip(np.searchsorted(edges, x, side="right") - 1, 0, 359).tolist()


def test_projections_and_wrap(spark):
    df = spark.createDataFrame([(-math.pi, 0.0), (math.pi, math.pi), (1.0, 1.0), (7.0, 2.0), (-9.4, 3.1)], "theta double, phi double").withColumn("theta", angles.wrap_angle(F.col("theta")))
    for name in angles.MAPS:
        for r in df.select(*(c.alias(n) for c, n in zip(angles.project(F.col("theta"), F.col("phi"), name), "xy"))).collect():
            assert name.startswith("equirect") or r["x"] ** 2 / 8 + r["y"] ** 2 / 2 <= 1 + 1e-6
    with pytest.raises(ValueError):
        angles.project(F.col("theta"), F.col("phi"), "globe")
    assert layers.graticule(spark, "hammer").count() == 5 * 220 + 5 * 300


def test_soup_curvature_equals_the_general_one(spark):
    v = spark.createDataFrame([("s", 0, 0.0, 0.0, 0.0), ("s", 1, 1.0, 0.0, 0.0), ("s", 2, 0.0, 2.0, 0.0), ("s", 9, 5.0, 5.0, 5.0)], "scope string, vid bigint, x double, y double, z double")
    f = spark.createDataFrame([("s", 0, 0, 1, 2)], "scope string, fid bigint, a bigint, b bigint, c bigint")
    got = {r["vid"]: r["curvature"] for r in mesh.laplacian(v, f).collect()}
    assert got == pytest.approx({0: math.sqrt(0.25 + 1), 1: math.sqrt(1 + 1), 2: math.sqrt(0.25 + 4), 9: 0.0})
    s = mesh.smooth(v.select("scope", "vid", F.col("x").alias("value")), f, 3)
    assert {r["vid"]: r["value"] for r in s.collect()} == pytest.approx({0: 1 / 3 + 1 / 24, 1: 1 / 3 - 2 / 24, 2: 1 / 3 + 1 / 24, 9: 5.0}, abs=0.2)


def test_pose_files(spark, tmp_path):
    atom = "ATOM      1  CA  ALA A   1       1.000   2.000   3.000  1.00  0.00           C"
    text = "\n".join(["REMARK", "MODEL 1", atom, atom, "END foo", "ENDMDL", "MODEL 2", "TER", "END", "MODEL 3", atom])
    (tmp_path / "p.pdb").write_text(text)
    (tmp_path / "s.dat").write_text("-1.5\n\n -2 \n")
    atoms, poses = pdb.load_poses(spark, str(tmp_path / "p.pdb"), str(tmp_path / "s.dat"))
    assert sorted((r["pose_id"], r["score"]) for r in poses.collect()) == [("pose0001", -1.5), ("pose0002", -2.0)]
    assert atoms.groupBy("pose_idx").count().count() == 2
    (tmp_path / "s2.dat").write_text("-1.5\n")
    with pytest.raises(ValueError, match="Mismatch"):
        pdb.load_poses(spark, str(tmp_path / "p.pdb"), str(tmp_path / "s2.dat"))
    (tmp_path / "bad.pdb").write_text("ATOM too short")
    with pytest.raises(Exception, match="Cannot parse"):
        pdb.load_structure(spark, str(tmp_path / "bad.pdb")).collect()


def test_text_files_are_read_in_splits(spark, tmp_path):
    rnd = np.random.default_rng(5)
    want = {}
    for name, end in (("a.txt", "\n"), ("b.txt", "\r\n"), ("c.txt", "\n")):
        lines = [f"{i}:" + "x" * int(rnd.integers(0, 40)) if i % 5 else "" for i in range(300)]
        (tmp_path / name).write_bytes(end.join([*lines, ""] if name != "c.txt" else [*lines, "last"]).encode())
        want[name] = lines + ["last"] * (name == "c.txt")
    (tmp_path / "d.txt").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "101")
    try:
        df = pdb.text_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 50
        got = {}
        for r in df.repartition(3).where("line_no >= 0").collect():
            got.setdefault(r["source"].rpartition("/")[2], {})[r["line_no"]] = r["line"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {k: dict(enumerate(v)) for k, v in want.items()}


def test_mesh_files_and_cells(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.5), (1, 1.0, 0.0, 0.0, 0.25), (2, 0.0, 1.0, 0.0, 1.0)], "vid bigint, x double, y double, z double, s double")
    f = spark.createDataFrame([(0, 0, 1, 2)], "fid bigint, a bigint, b bigint, c bigint")
    lines = lambda *a, **k: [r["line"] for r in writers.mesh_lines(v, f, *a, **k).orderBy("section", "id", "part").collect()]
    assert lines("obj")[1:] == ["v 0.000000 0.000000 0.000000", "v 1.000000 0.000000 0.000000", "v 0.000000 1.000000 0.000000", "f 1 2 3"]
    assert lines("ply", scalar="s", scalar_name="q")[-4:] == ["0.000000 0.000000 0.000000 0.500000", "1.000000 0.000000 0.000000 0.250000", "0.000000 1.000000 0.000000 1.000000", "3 0 1 2"]
    assert lines("stl")[1] == "  facet normal 0.000000e+00 0.000000e+00 1.000000e+00" and len(lines("stl")) == 9
    for bad in (lambda: lines("off"), lambda: lines("obj", scalar="s"), lambda: writers.mesh_lines(v.limit(0), f, "obj")):
        with pytest.raises(ValueError):
            bad()
    cells = writers.csv_cells(spark.createDataFrame([(1.0005, 3, "a"), (None, 4, None)], "x double, n int, s string")).collect()
    assert [tuple(r) for r in cells] == [("1.000", 3, "a"), ("nan", 4, None)]


def test_small_map_end_to_end(spark, tmp_path):
    rnd = np.random.default_rng(6)

    def line(i, name, res, chain, n, p):
        return f"ATOM  {i:5d}  {name:<3} {res} {chain}{n:4d}    {p[0]:8.3f}{p[1]:8.3f}{p[2]:8.3f}  1.00  0.00"

    ball = rnd.normal(size=(90, 3))
    ball = 8 * ball / np.linalg.norm(ball, axis=1, keepdims=True)
    (tmp_path / "t.pdb").write_text("\n".join(line(i, "CA" if i % 3 == 0 else "CB", "ALA", "X", i // 3 + 1, p) for i, p in enumerate(ball)))
    models = []
    for k, d in enumerate(([12, 0, 0], [12, 1, 0], [0, 0, 12], [-12, 0, 0])):
        models += [f"MODEL {k + 1}", line(1, "CA", "GLY", "d", 1, d), line(2, "N", "GLY", "d", 1, d), "ENDMDL"]
    (tmp_path / "p.pdb").write_text("\n".join(models))
    (tmp_path / "s.dat").write_text("-5\n-6\n-4\n-3\n")
    (tmp_path / "i.txt").write_text("Chain  X  ALA    2\nChain  X  ALA    3\n")
    o = MapOptions(*(str(tmp_path / n) for n in ("t.pdb", "p.pdb", "s.dat", "i.txt")), radius_scale=2.5, ppi_near_surface_eps=9.0, ppi_footprint=("atom_contour", "residue_points"), pose_layer=("scatter", "trace"), trace_pose="2", background="radial", mesh_vertex_scalar="curv_proxy")
    m = SurfaceMap(spark, o)
    assert m.validate()["present_count"] == 2
    got = {r["pose_id"]: r["cluster_id"] for r in m.pose_table().collect()}
    assert got["pose0001"] == got["pose0002"] == 1 and len(set(got.values())) == 3
    assert m.contour_points().count() == 6 and m.residue_points().count() == 2 and m.traces().count() == 2
    assert m.pose_density().count() == 180 * 360 and m.background().count() > 100
    assert m.background().where("value < 0 OR value > 1 OR band < 0 OR band > 39").isEmpty() and m.background_bar().first()["label"] == "Radial distance (normalized)"
    raw = SurfaceMap(spark, replace(o, background_colorbar_mode="raw", background_colorbar_vmax=8.5))
    bar = raw.background_bar().first()
    least = raw.background().agg(F.min("value"), F.max("value")).first()
    assert bar["label"] == "Radial distance" and bar["vmin"] == pytest.approx(least[0]) and bar["vmax"] == 8.5 and len(bar["bands"]) == 41 and len(bar["lines"]) == 13
    assert raw.background().where("value > 8.5 AND band <> 40 OR value <= 8.5 AND (band < 0 OR band > 39)").isEmpty()
    vertices, faces = m.mesh_tables()
    assert [r["fid"] for r in faces.orderBy("fid").collect()] == list(range(m.triangles.count()))
    assert vertices.count() == 3 * faces.count() and vertices.agg(F.max("value")).first()[0] == pytest.approx(1.0)
    for path in m.write(str(tmp_path / "out")):
        assert spark.read.csv(path, header=True).count() > 0
    (tmp_path / "q.txt").write_text("Chain  Q  ALA    2\n")
    with pytest.raises(MissingResidues, match="structure doesn't have: Q"):
        SurfaceMap(spark, MapOptions(o.protein, o.peptides, o.scores, str(tmp_path / "q.txt"))).validate()
    with pytest.raises(ValueError):
        MapOptions("a", "b", "c", "d", map="globe")


def test_every_layer_asked_for_is_written(spark, tmp_path):
    rnd = np.random.default_rng(6)

    def line(i, name, res, chain, n, p):
        return f"ATOM  {i:5d}  {name:<3} {res} {chain}{n:4d}    {p[0]:8.3f}{p[1]:8.3f}{p[2]:8.3f}  1.00  0.00"

    ball = rnd.normal(size=(90, 3))
    ball = 8 * ball / np.linalg.norm(ball, axis=1, keepdims=True)
    (tmp_path / "t.pdb").write_text("\n".join(line(i, "CA" if i % 3 == 0 else "CB", "ALA", "X", i // 3 + 1, p) for i, p in enumerate(ball)))
    models = []
    for k, d in enumerate(([12, 0, 0], [12, 1, 0], [0, 0, 12])):
        models += [f"MODEL {k + 1}", line(1, "CA", "GLY", "d", 1, d), "ENDMDL"]
    (tmp_path / "p.pdb").write_text("\n".join(models))
    (tmp_path / "s.dat").write_text("-5\n-6\n-4\n")
    (tmp_path / "i.txt").write_text("\n".join(f"Chain  X  ALA    {n}" for n in range(1, 11)) + "\n")
    given = [x for k, n in (("protein", "t.pdb"), ("peptides", "p.pdb"), ("scores", "s.dat"), ("ppi-file", "i.txt")) for x in (f"--{k}", str(tmp_path / n))]
    given += ["--radius-scale", "2.5", "--ppi-near-surface-eps", "9", "--pose-layer", "hexbin,centroid", "--cluster-contour", "filled", "--no-write-csv", "--out-prefix", str(tmp_path / "o")]
    assert cli.main(given) == 0

    def layer(name):
        return spark.read.parquet(str(tmp_path / f"o_layer_{name}"))

    assert layer("hexbin").agg(F.sum("n")).first()[0] == 3
    centroids = {r["cluster_id"]: r for r in layer("centroid").collect()}
    assert centroids[1]["text"] == "1:2\n<-5.50>" and centroids[1]["outline"] == "red" and centroids[2]["text"] == "2:1\n<-4.00>"
    c = layer("cluster_contour")
    grid = c.where("cluster_id = 1")
    assert grid.count() == 8100 and grid.agg(F.sum("value")).first()[0] == pytest.approx(2) and grid.where("fill_to IS NULL OR abs(level - fill_to / 4) > 1e-12 OR value > fill_to").isEmpty()
    assert [(r["kind"], r["position"], r["level"]) for r in c.where("cluster_id = 2").collect()] == [("point", 0.0, None)]
    i = layer("ppi_contour")
    assert i.count() == 180 * 360 and i.agg(F.sum("value")).first()[0] == pytest.approx(30)


def test_validation_and_points_keep_null_free_edges(spark):
    atoms = spark.createDataFrame([("s", 0, "A", "ALA", 1, "", "CA", "C", 0.0, 0.0, 0.0), ("s", 1, "A", "ALA", 1, "", "CB", "C", 2.0, 0.0, 0.0), ("s", 2, "A", "GLY", 2, "B", "N", "N", 4.0, 0.0, 0.0)], "scope string, atom_idx bigint, chain string, resname string, resseq int, icode string, name string, element string, x double, y double, z double")
    for mode, want in (("ca", [0.0, 4.0]), ("sc_com", [2.0, 4.0]), ("res_com", [1.0, 4.0])):
        assert [r["px"] for r in residues.residue_points(atoms, ["scope"], mode).orderBy("resseq").collect()] == want
    with pytest.raises(ValueError):
        residues.residue_points(atoms, ["scope"], "mid")
    i = spark.createDataFrame([("s", "A", 1, ""), ("s", "A", 2, ""), ("q", "A", 1, "")], "scope string, chain string, resseq int, icode string")
    got = {r["scope"]: r for r in residues.validation(i, atoms, ["scope"]).collect()}
    assert got["s"]["missing_examples"] == ["A:2"] and got["q"]["missing_count"] == 1 and got["q"]["chains"] == []


def test_streamed_scores(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("run_id,pose_id,vina_score,remark\nr,p,-1.5,ok\nr,p,x,ok\n")
    q = arrivals.split_stream(arrivals.score_stream(spark, str(folder)), str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [r["vina_score"] for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == [-1.5]
    assert [r["reason"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["score"]
