"""The general data problems against brute force, with nulls, repeats, ties, empty tables and clashing names."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from surfsphere.operators import eager_join, orphans, regions
from surfsphere.operators.prefix import running_sum
from surfsphere.sources import strict

POSES = "run_id string, cluster_id int, pose_id string, n_poses bigint"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_eager_join_equals_the_raw_join(spark):
    rnd = random.Random(1)
    left = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2, None]), f"p{rnd.randrange(9)}", rnd.choice([None, 3, 4])) for _ in range(200)]
    right = [(rnd.choice(["a", "b", "c", None]), rnd.choice([1, 2, 3, None]), "x", rnd.choice([None, 1, 5])) for _ in range(40)]
    a, b = spark.createDataFrame(left, POSES), spark.createDataFrame(right, POSES)
    got = eager_join.eager_join_sums(a, b, ["run_id", "cluster_id"], {"s": F.col("n_poses")}, {"t": F.col("n_poses")}, rollup=["run_id"])
    raw = a.withColumnRenamed("n_poses", "l").join(b.select("run_id", "cluster_id", F.col("n_poses").alias("r")), ["run_id", "cluster_id"])
    assert rows(got) == rows(raw.groupBy("run_id").agg(F.count("*"), F.sum("l"), F.sum("r")))
    none = eager_join.eager_join_sums(a.limit(0), b, ["run_id", "cluster_id"], {"s": F.col("n_poses")}).collect()
    assert [tuple(r) for r in none] == [(0, None)]


def test_miscounted_clusters(spark):
    poses = spark.createDataFrame([("r", 1, "a", 0), ("r", 1, "a", 0), ("r", 1, "b", 0), ("r", None, "c", 0), ("q", 1, "a", 0)], POSES)
    stated = spark.createDataFrame([("r", 1, 2), ("r", 1, 2), ("r", 2, 1), ("r", 3, 0), ("q", 1, None), ("q", 2, 3)], "run_id string, cluster_id int, n_poses bigint")
    assert rows(eager_join.miscounted_clusters(poses, stated)) == [("q", 2), ("r", 2)]
    assert rows(eager_join.miscounted_clusters(poses.limit(0), stated)) == [("q", 2), ("r", 1), ("r", 2)]
    assert rows(eager_join.miscounted_clusters(poses, stated.limit(0))) == []


ATOM = "ATOM      3  CA  ARG Z  94A    101.908 142.105 145.593  1.00  0.00           C"


def put(line, at, text):
    return line[: at - 1] + text + line[at - 1 + len(text) :]


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        (ATOM, None), (ATOM[:54], None), (ATOM[:53], "columns"), ("ATOM", "columns"), (put(ATOM, 23, "    "), "resseq"), (put(ATOM, 23, " -5 "), None), (put(ATOM, 23, "\t94 "), "resseq"),
        (put(ATOM, 23, " １２ "), "resseq"), (put(ATOM, 31, "     +1."), None), (put(ATOM, 31, "      .5"), None), (put(ATOM, 31, "       ."), "coord"), (put(ATOM, 39, "  1e5   "), "coord"), (put(ATOM, 47, "  nan   "), "coord"),
        ("HETATM" + ATOM[6:], None), (" " + ATOM, "skip"), ("", "skip"), (None, "skip"), ("ANISOU", "skip"), (put(ATOM, 18, "\U0001d518RG"), None), (put(ATOM, 47, " 5.593\n "), "coord"),
    ],
)
def test_atom_lines(spark, line, reason):
    good, bad = strict.split_rows(strict.checked_atoms(spark.createDataFrame([(1, line, "clash")], "line_id bigint, line string, x string")))
    found = [r["reason"] for r in bad.collect()]
    assert found == ([] if reason in (None, "skip") else [reason])
    assert good.count() == (reason is None)


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ("r,p,-5.1,ok", None), ('"r",p,"-5.1","a ""b"", c"', None), ("r,p, -5 ,", None), ("r,p,.5e-3,", None), ("r,p,NaN,", "score"), ("r,p,,", "score"), ("r,p,-5.1", "columns"), ("r,p,-5.1,a,b", "columns"),
        ('r,p,-5.1,said "x"', "quoting"), ('"r,p,-5.1,ok', "quoting"), ('r,"p"x,-5.1,ok', "quoting"), ('r,p,1,"a\\"b"', "quoting"), ('r,p,x,"', "quoting"), (",,,", "score"), ("   ", "skip"), ("", "skip"), (None, "skip"),
        ("run_id,pose_id,vina_score,remark", "skip"), ("r,p,\t5,", "score"), ("r,p,5\n,", "score"), ('r,p,1,""', None), ("r;p;1;ok", "columns"), ('r,p,"1" ,x', "quoting"),
    ],
)
def test_score_lines(spark, line, reason):
    good, bad = strict.split_rows(strict.checked_scores(spark.createDataFrame([(1, line)], "line_id bigint, line string")))
    assert [r["reason"] for r in bad.collect()] == ([] if reason in (None, "skip") else [reason])
    assert strict.scores_of(good).count() == (reason is None)


def test_score_values(spark):
    df = spark.createDataFrame([(1, '"r",p," -5.1 ","a ""b"", c"')], "line_id bigint, line string")
    r = strict.scores_of(strict.split_rows(strict.checked_scores(df))[0]).first()
    assert (r["run_id"], r["pose_id"], r["vina_score"], r["remark"]) == ("r", "p", -5.1, 'a "b", c')


def test_very_long_quoted_line(spark):
    line = "r,p,1,\"" + 'x""' * 50_000 + '"'
    assert strict.bad_lines(spark.createDataFrame([(1, "ATOM")], "line_id bigint, line string"), spark.createDataFrame([(2, line)], "line_id bigint, line string")).collect()[0]["line_id"] == 1


def test_orphans_against_brute_force(spark):
    rnd = random.Random(3)
    t = lambda: datetime(2025, rnd.randrange(1, 7), rnd.randrange(1, 28), rnd.randrange(24))
    spans = []
    for _ in range(40):
        a, b = sorted((t(), t()))
        spans.append((rnd.choice(["s1", "s2"]), rnd.choice(["A", "B", "C", None]), a, rnd.choice([None, b, b])))
    spans += spans[:3]
    atoms = [(rnd.choice(["s1", "s2", "s3"]), rnd.choice(["A", "B", "C", "?", None]), rnd.choice([-3, 0, 70, 5000, None]), rnd.choice(["", "", "X", None]), t()) for _ in range(400)]
    listed = [(rnd.choice(["s1", "s2", "s3"]), rnd.choice(["A", "B", "D", None]), rnd.choice([-3, 0, 63, 64, 70, 5000, None]), t()) for _ in range(200)]
    want = set()
    for s, c, n, _, at in atoms:
        if c not in (None, "?") and not any(x[0] == s and x[1] == c and x[2] <= at and (x[3] is None or x[3] > at) for x in spans):
            want.add(("atoms", s, c, n, at.strftime("%Y-%m")))
    for s, c, n, at in listed:
        if c is not None and n is not None and not any(a[0] == s and a[1] == c and a[2] == n and a[3] == "" and a[4] <= at for a in atoms):
            want.add(("interface_residues", s, c, n, at.strftime("%Y-%m")))
    frames = [
        spark.createDataFrame(atoms, "structure_id string, chain string, resseq int, icode string, loaded_at timestamp_ntz"),
        spark.createDataFrame(spans, "structure_id string, chain string, registered_at timestamp_ntz, deleted_at timestamp_ntz"),
        spark.createDataFrame(listed, "structure_id string, chain string, resseq int, listed_at timestamp_ntz").withColumn("period", F.lit("clash")),
    ]
    got = [tuple(r) for r in orphans.orphans(*frames).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert orphans.orphans(frames[0].limit(0), *frames[1:]).count() > 0
    assert orphans.orphans(frames[0], frames[1], frames[2].limit(0)).where("ref_table <> 'atoms'").count() == 0


def test_ear_clipping_covers_the_polygon():
    rnd = np.random.default_rng(5)
    for n in (3, 4, 7, 12):
        turn = np.sort(rnd.uniform(0, 2 * np.pi, (20, n)), 1)
        r = rnd.uniform(0.2, 1, (20, n))  # star-shaped around the origin, mostly concave
        turn[:, 0], turn[:, -1] = turn[:, 0] * 0, 2 * np.pi - 0.3
        x, y = r * np.cos(turn), r * np.sin(turn)
        tri = regions.ear_clip(x[:, ::-1], y[:, ::-1])
        area = 0.5 * np.abs((tri[..., 2] - tri[..., 0]) * (tri[..., 5] - tri[..., 1]) - (tri[..., 3] - tri[..., 1]) * (tri[..., 4] - tri[..., 0])).sum(1)
        ok = np.diff(np.append(turn, turn[:, :1] + 2 * np.pi, 1), axis=1).max(1) < np.pi
        whole = 0.5 * np.abs(np.sum(x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y, 1))
        assert np.allclose(area[ok], whole[ok])


def test_points_in_regions_of_all_sizes(spark):
    rnd = np.random.default_rng(2)
    rings = {1: [(0, 0), (10, 0), (10, 10), (5, 2), (0, 10)], 2: [(3, 3), (4, 3), (4, 4), (3, 4)], 3: [(-200, -200), (300, -200), (300, 300), (-200, 300)], 4: [(0, 0), (1, 1)]}
    points = [("s", i, *map(float, p), 0.5) for i, p in enumerate(rnd.integers(-2, 13, (300, 2)))] + [("s", 900, None, 1.0, 0.5), ("s", 901, float("nan"), 1.0, 0.5), (None, 902, 3.5, 3.5, 0.5), ("t", 903, 3.5, 3.5, 0.5), ("s", 904, 3.5, 3.5, 9.0)]
    points += points[:20]
    nan = float("nan")
    regs = [("s", k, [float(x) for x, _ in r], [float(y) for _, y in r], 0.0, 1.0, [nan] * 3) for k, r in rings.items()]
    p = spark.createDataFrame(points, "scope string, point_id bigint, x double, y double, z double")
    g = spark.createDataFrame(regs + regs[:1], "scope string, region_id bigint, ring_x array<double>, ring_y array<double>, z_lo double, z_hi double, centre array<double>")

    def inside(x, y, ring):
        on = hit = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            on |= cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by)
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hit = not hit
        return on or hit

    want = {(s, i, k) for s, i, x, y, z in points if s == "s" and x is not None and x == x and z <= 1 for k, r in rings.items() if len(r) > 2 and inside(x, y, r)}
    got = [tuple(r) for r in regions.region_join(p, g, edge=8.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert regions.region_join(p.limit(0), g, edge=8.0).count() == 0 and regions.region_join(p, g.limit(0), edge=8.0).count() == 0


@pytest.mark.parametrize("sent, held", [(100_000, 400_000), (0, 60)])
def test_contacts_against_brute_force(spark, monkeypatch, sent, held):
    """Dense nodes are split by points and triangles; their table is sent to all tasks or joined by a shuffle."""
    for name, value in (("HOT_POINTS", 50), ("HOT_TRIANGLES", 40), ("CHUNK", 500), ("SENT", sent), ("HELD", held)):
        monkeypatch.setattr(regions, name, value)
    rnd = np.random.default_rng(4)
    a = [("s" if i % 3 else "t", i, *map(float, p)) for i, p in enumerate(rnd.uniform(-6, 6, (600, 3)))] + [("s", 5000, None, 0.0, 0.0), ("s", 5001, 9999.999, 9999.999, 9999.999)]
    v = [("s", i, *map(float, p)) for i, p in enumerate(rnd.uniform(-6, 6, (150, 3)))] + [("u", 1, 0.0, 0.0, 0.0), ("s", 7000, 0.0, None, 0.0)]
    want = {(s, i, k) for s, i, *p in a if None not in p for t, k, *q in v if s == t and None not in q and sum((x - y) ** 2 for x, y in zip(p, q)) <= 2.25}
    atoms = spark.createDataFrame(a + a[:30], "structure_id string, atom_idx bigint, x double, y double, z double").withColumn("p", F.lit(1))
    verts = spark.createDataFrame(v + v[:30], "structure_id string, vid bigint, vx double, vy double, vz double").withColumn("level", F.lit("x"))
    got = [tuple(r) for r in regions.contacts(atoms, verts).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert regions.contacts(atoms.limit(0), verts).count() == 0 and regions.contacts(atoms, verts.limit(0)).count() == 0


def test_one_point_repeated_many_times_in_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(regions, "HOT_POINTS", 100)
    atoms = spark.range(20_000).select(F.lit("s").alias("structure_id"), F.lit(7).cast("bigint").alias("atom_idx"), *(F.lit(0.5).alias(c) for c in "xyz"))
    verts = spark.range(3).select(F.lit("s").alias("structure_id"), F.col("id").alias("vid"), F.col("id").cast("double").alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.0).alias("vz"))
    assert sorted(tuple(r) for r in regions.contacts(atoms, verts).collect()) == [("s", 7, 0), ("s", 7, 1)]


def test_box_hierarchies_find_every_box():
    rnd = np.random.default_rng(3)
    node = np.sort(rnd.integers(0, 6, 400))
    node = np.unique(node, return_inverse=True)[1]
    lo = rnd.uniform(-5, 5, (400, 3))
    hi = lo + rnd.uniform(0, 2, (400, 3))
    order, tiers = regions._hierarchy(lo, hi, node)
    assert sorted(order.tolist()) == list(range(400)) and len(tiers[-1][0]) == node.max() + 1
    for (lo0, hi0, _, _), (lo1, hi1, begin, count) in zip(tiers, tiers[1:]):
        assert count.max() <= regions.BRANCH and begin[0] == 0 and (begin[1:] == np.cumsum(count)[:-1]).all() and count.sum() == len(lo0)
        for k, (b, n) in enumerate(zip(begin, count)):
            assert (lo1[k] == lo0[b : b + n].min(0)).all() and (hi1[k] == hi0[b : b + n].max(0)).all()


def test_running_sums_over_parts(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(50)] + [("b", 7, None)], "k string, at bigint, v bigint")
    got = {(r["k"], r["at"]): r["s"] for r in running_sum(df, ["k"], "at", "v", "s", part=7).collect()}
    assert all(got["a", i] == sum(j % 3 for j in range(i + 1)) for i in range(50)) and got["b", 7] == 0
