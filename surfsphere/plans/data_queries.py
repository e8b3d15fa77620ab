"""Queries of the general data problems 1, 3, 5 and 6, and their SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import eager_join, orphans, regions
from ..session import table
from ..sources import strict


#: Cosines and sines of the corners of p3_regions.
_CORNERS = [[f(0.1 + 2 * math.pi * i / 5) for i in range(5)] for f in (math.cos, math.sin)]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return eager_join.miscounted_clusters(table(spark, d, "poses_mapped"), table(spark, d, "clusters"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return eager_join.stated_against_counted(table(spark, d, "poses_mapped"), table(spark, d, "clusters"))


def p1_join_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The raw join of poses and summaries rolled up by run, without that join."""
    poses, clusters = table(spark, d, "poses_mapped"), table(spark, d, "clusters")
    seen = F.when(F.col("proj_distance").isNotNull(), F.lit(1))
    return eager_join.eager_join_sums(
        poses, clusters, ["run_id", "cluster_id"], {"measured": seen, "pose_numbers": F.col("pose_idx")}, {"stated_poses": F.col("n_poses")}, rollup=["run_id"]
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return regions.contacts(table(spark, d, "atoms"), table(spark, d, "mesh_vertices"))


def p3_regions(spark: SparkSession, d: str) -> DataFrame:
    """Atoms in regions with five corners around the vertices, some of them turned inwards: structure_id, atom_idx, vid."""
    a = table(spark, d, "atoms").select(F.col("structure_id").alias("scope"), F.col("atom_idx").alias("point_id"), "x", "y", "z")
    v = table(spark, d, "mesh_vertices")
    far = [1.0 + F.pmod(F.col("vid") * 7 + 3 * i, F.lit(3)) for i in range(5)]
    ring = {c: F.array(*(F.col(f"v{c}") + r * float(t) for r, t in zip(far, turn))) for c, turn in zip("xy", _CORNERS)}
    r = v.select(
        F.col("structure_id").alias("scope"), F.col("vid").alias("region_id"), ring["x"].alias("ring_x"), ring["y"].alias("ring_y"), (F.col("vz") - 1.0).alias("z_lo"), (F.col("vz") + 1.0).alias("z_hi"),
        F.array(*(F.lit(float("nan")) for _ in range(3))).alias("centre"),
    )
    met = regions.region_join(a, r, edge=16.0)
    return met.select(F.col("scope").alias("structure_id"), F.col("point_id").alias("atom_idx"), F.col("region_id").alias("vid"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return strict.bad_lines(table(spark, d, "pdb_lines"), table(spark, d, "score_lines"))


def p5_atoms(spark: SparkSession, d: str) -> DataFrame:
    good, _ = strict.split_rows(strict.checked_atoms(table(spark, d, "pdb_lines")))
    return strict.atoms_of(good).select("line_id", "structure_id", "name", "resname", "chain", "resseq", "icode", "x", "y", "z", "element")


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    good, _ = strict.split_rows(strict.checked_scores(table(spark, d, "score_lines").drop("run_id")))
    return strict.scores_of(good).select("line_id", "run_id", "pose_id", "vina_score", "remark")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(table(spark, d, "atoms"), table(spark, d, "chain_inventory"), table(spark, d, "interface_residues"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    found = p6_found(spark, d)
    return found.groupBy("ref_table", "ref_month").agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("structure_id").alias("n_structures"))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p1_join_rollup, p3_found, p3_regions, p5_found, p5_atoms, p5_scores, p6_found, p6_report)}

def _regions_sql() -> str:
    """A point is in a region if a line from it crosses the border an odd number of times."""
    corner = [[f"(v.v{c} + (1 + (v.vid * 7 + {3 * i}) % 3) * {_CORNERS[k][i]!r})" for i in range(5)] for k, c in enumerate("xy")]
    sides = []
    for i in range(5):
        x1, y1, x2, y2 = corner[0][i], corner[1][i], corner[0][(i + 1) % 5], corner[1][(i + 1) % 5]
        sides.append(f"CASE WHEN ({y1} > a.y) <> ({y2} > a.y) AND a.x < ({x2} - {x1}) * (a.y - {y1}) / ({y2} - {y1}) + {x1} THEN 1 ELSE 0 END")
    return f"""SELECT DISTINCT a.structure_id, a.atom_idx, v.vid FROM (SELECT DISTINCT structure_id, atom_idx, x, y, z FROM atoms) a
JOIN (SELECT DISTINCT structure_id, vid, vx, vy, vz FROM mesh_vertices) v
  ON a.structure_id = v.structure_id AND a.z BETWEEN v.vz - 1 AND v.vz + 1 AND a.x BETWEEN v.vx - 3 AND v.vx + 3 AND a.y BETWEEN v.vy - 3 AND v.vy + 3
WHERE ({' + '.join(sides)}) % 2 = 1"""


_P1_BOTH = """
SELECT coalesce(s.run_id, c.run_id) AS run_id, coalesce(s.cluster_id, c.cluster_id) AS cluster_id,
       n_stated_min, n_stated_max, coalesce(n_counted, 0) AS n_counted
FROM (SELECT run_id, cluster_id, min(n_poses) AS n_stated_min, max(n_poses) AS n_stated_max FROM clusters
      WHERE run_id IS NOT NULL AND cluster_id IS NOT NULL GROUP BY 1, 2) s
FULL JOIN (SELECT run_id, cluster_id, count(DISTINCT pose_id) AS n_counted FROM poses_mapped
      WHERE run_id IS NOT NULL AND cluster_id IS NOT NULL AND pose_id IS NOT NULL GROUP BY 1, 2) c
ON s.run_id = c.run_id AND s.cluster_id = c.cluster_id"""

_P6 = """
SELECT DISTINCT 'atoms' AS ref_table, structure_id, chain, resseq, strftime(loaded_at, '%Y-%m') AS ref_month FROM atoms a
WHERE structure_id IS NOT NULL AND chain IS NOT NULL AND chain <> '?' AND loaded_at IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chain_inventory i
  WHERE i.structure_id = a.structure_id AND i.chain = a.chain AND i.registered_at <= a.loaded_at AND (i.deleted_at IS NULL OR i.deleted_at > a.loaded_at))
UNION ALL
SELECT DISTINCT 'interface_residues', structure_id, chain, resseq, strftime(listed_at, '%Y-%m') FROM interface_residues r
WHERE structure_id IS NOT NULL AND chain IS NOT NULL AND resseq IS NOT NULL AND listed_at IS NOT NULL AND NOT EXISTS (SELECT 1 FROM atoms a
  WHERE a.structure_id = r.structure_id AND a.chain = r.chain AND a.resseq = r.resseq AND a.icode = '' AND a.loaded_at <= r.listed_at)"""

_DEC = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)"
_FIELD = r'("[^"]*(""[^"]*)*"|[^",][^",]*|)'
_FOUR = f"^{_FIELD},{_FIELD},{_FIELD},{_FIELD}$"
_ATOM_LINE = "(starts_with(line, 'ATOM') OR starts_with(line, 'HETATM'))"
_CUT = {k: f"trim(substring(line, {a}, {n}), ' ')" for k, (a, n) in {"resseq": (23, 4), "x": (31, 8), "y": (39, 8), "z": (47, 8)}.items()}
_ATOM_BAD = f"""CASE WHEN length(line) < 54 THEN 'columns' WHEN NOT regexp_full_match({_CUT['resseq']}, '[+-]?[0-9]+') THEN 'resseq'
  WHEN NOT (regexp_full_match({_CUT['x']}, '{_DEC}') AND regexp_full_match({_CUT['y']}, '{_DEC}') AND regexp_full_match({_CUT['z']}, '{_DEC}')) THEN 'coord' END"""
_SCORE_FROM = f"""
(SELECT line_id, line, regexp_full_match(line, '{_FIELD}(,{_FIELD})*') AS quoted,
        regexp_full_match(line, '{_FIELD},{_FIELD},{_FIELD},{_FIELD}') AS four,
        [regexp_extract(line, '{_FOUR}', 1), regexp_extract(line, '{_FOUR}', 3), regexp_extract(line, '{_FOUR}', 5), regexp_extract(line, '{_FOUR}', 7)] AS raw
 FROM score_lines WHERE trim(line, ' ') <> '' AND line <> '{strict.SCORE_HEADER}')"""


def _unquoted(i: int) -> str:
    return f"CASE WHEN starts_with(raw[{i}], '\"') THEN replace(substring(raw[{i}], 2, length(raw[{i}]) - 2), '\"\"', '\"') ELSE raw[{i}] END"


_SCORE_BAD = f"""CASE WHEN NOT quoted THEN 'quoting' WHEN NOT four THEN 'columns'
  WHEN NOT regexp_full_match(trim({_unquoted(3)}, ' '), '{_DEC}([eE][+-]?[0-9]+)?') THEN 'score' END"""

SQL = {
    "p1_found": f"SELECT run_id, cluster_id FROM ({_P1_BOTH}) b WHERE n_stated_min <> n_counted OR n_stated_max <> n_counted",
    "p1_counts": _P1_BOTH,
    "p1_join_rollup": """
SELECT p.run_id, count(*) AS join_rows, CAST(sum(CASE WHEN p.proj_distance IS NOT NULL THEN 1 END) AS BIGINT) AS measured,
       CAST(sum(p.pose_idx) AS BIGINT) AS pose_numbers, CAST(sum(c.n_poses) AS BIGINT) AS stated_poses
FROM poses_mapped p JOIN clusters c ON p.run_id = c.run_id AND p.cluster_id = c.cluster_id GROUP BY 1""",
    "p3_regions": _regions_sql(),
    "p3_found": """
WITH a AS (SELECT DISTINCT structure_id, atom_idx, x, y, z, CAST(floor(x / 1.5e0) AS INT) AS cx, CAST(floor(y / 1.5e0) AS INT) AS cy, CAST(floor(z / 1.5e0) AS INT) AS cz
           FROM atoms WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
     o AS (SELECT unnest([-1, 0, 1]) AS d),
     v AS (SELECT DISTINCT structure_id, vid, vx, vy, vz, CAST(floor(vx / 1.5e0) AS INT) + ox.d AS cx, CAST(floor(vy / 1.5e0) AS INT) + oy.d AS cy, CAST(floor(vz / 1.5e0) AS INT) + oz.d AS cz
           FROM mesh_vertices, o ox, o oy, o oz WHERE vx IS NOT NULL AND vy IS NOT NULL AND vz IS NOT NULL)
SELECT DISTINCT a.structure_id, a.atom_idx, v.vid FROM a JOIN v ON a.structure_id = v.structure_id AND a.cx = v.cx AND a.cy = v.cy AND a.cz = v.cz
WHERE (x - vx) * (x - vx) + (y - vy) * (y - vy) + (z - vz) * (z - vz) <= 2.25e0""",
    "p5_found": f"""
SELECT * FROM (SELECT line_id, {_ATOM_BAD} AS reason FROM pdb_lines WHERE {_ATOM_LINE}
UNION ALL SELECT line_id, {_SCORE_BAD} FROM {_SCORE_FROM} s) b WHERE reason IS NOT NULL""",
    "p5_atoms": f"""
SELECT line_id, structure_id, trim(substring(line, 13, 4), ' ') AS name, trim(substring(line, 18, 3), ' ') AS resname,
  CASE WHEN trim(substring(line, 22, 1), ' ') = '' THEN '?' ELSE trim(substring(line, 22, 1), ' ') END AS chain, TRY_CAST({_CUT['resseq']} AS INT) AS resseq,
  trim(substring(line, 27, 1), ' ') AS icode, CAST({_CUT['x']} AS DOUBLE) AS x, CAST({_CUT['y']} AS DOUBLE) AS y, CAST({_CUT['z']} AS DOUBLE) AS z,
  upper(trim(substring(line, 77, 2), ' ')) AS element FROM pdb_lines WHERE {_ATOM_LINE} AND ({_ATOM_BAD}) IS NULL""",
    "p5_scores": f"""
SELECT line_id, {_unquoted(1)} AS run_id, {_unquoted(2)} AS pose_id, CAST(trim({_unquoted(3)}, ' ') AS DOUBLE) AS vina_score, {_unquoted(4)} AS remark
FROM {_SCORE_FROM} s WHERE ({_SCORE_BAD}) IS NULL""",
    "p6_found": _P6,
    "p6_report": f"SELECT ref_table, ref_month, count(*) AS n_orphans, count(DISTINCT structure_id) AS n_structures FROM ({_P6}) o GROUP BY 1, 2",
}
