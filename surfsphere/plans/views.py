"""The operators' input views over the given tables, as DataFrames and as SQL for the brute-force twins.

Redelivered rows collapse (they differ in loaded_at at most); rows without the columns an operator can't do
without are left out, as the reference model knows no nulls.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chem import element_or_guess
from ..session import table

INF = float("inf")


def settled(c: Column) -> Column:
    """Six decimals for comparison; the shift keeps exact decimal halves off the rounding edge."""
    return F.round(c + 1.3e-7, 6) + F.lit(0.0)


def r6(e: str) -> str:
    return f"(round({e} + 1.3e-7, 6) + 0.0e0)"


def atom_rows(spark: SparkSession, d: str) -> DataFrame:
    """The atoms with their redelivered rows, for those who make them distinct behind a join by the join's own shuffle."""
    a = table(spark, d, "atoms").where("structure_id IS NOT NULL AND resseq IS NOT NULL AND name IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    return a.select(
        F.col("structure_id").alias("scope"), "atom_idx", F.coalesce("chain", F.lit("?")).alias("chain"), F.coalesce("resname", F.lit("UNK")).alias("resname"), "resseq",
        F.coalesce("icode", F.lit("")).alias("icode"), "name", element_or_guess(F.col("element"), F.col("name")).alias("element"), "x", "y", "z",
    )


def atoms(spark: SparkSession, d: str) -> DataFrame:
    return atom_rows(spark, d).distinct()


def atoms_by_residue(spark: SparkSession, d: str) -> DataFrame:
    """``atoms``, made distinct where their residue's rows meet, so that a join by residue needs no shuffle of them."""
    return atom_rows(spark, d).repartition("scope", "chain", "resseq", "icode").distinct()


def poses(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "poses_mapped").where("run_id IS NOT NULL AND pose_idx IS NOT NULL AND theta IS NOT NULL AND phi IS NOT NULL AND cluster_id IS NOT NULL")
    p = p.where(F.abs("vina_score") < INF)
    return p.select(F.col("run_id").alias("scope"), "pose_idx", "pose_id", F.col("vina_score").alias("score"), "theta", "phi", "proj_distance", "cluster_id").distinct()


def located(spark: SparkSession, d: str) -> DataFrame:
    """All poses with a place on the sphere, whatever their cluster_id; a score that isn't a finite number is null."""
    p = table(spark, d, "poses_mapped").where("run_id IS NOT NULL AND pose_idx IS NOT NULL").where((F.abs("theta") < INF) & (F.abs("phi") < INF))
    score = F.when(F.abs("vina_score") < INF, F.col("vina_score"))
    return p.select(F.col("run_id").alias("scope"), "pose_idx", "pose_id", score.alias("score"), "theta", "phi").distinct()


def interface(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "interface_residues").where("structure_id IS NOT NULL AND chain IS NOT NULL AND resseq IS NOT NULL")
    return i.select(F.col("structure_id").alias("scope"), "chain", "resseq", F.coalesce("icode", F.lit("")).alias("icode")).distinct()


def vertices(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "mesh_vertices").where("structure_id IS NOT NULL AND vx IS NOT NULL AND vy IS NOT NULL AND vz IS NOT NULL")
    return v.select(F.col("structure_id").alias("scope"), "vid", F.col("vx").alias("x"), F.col("vy").alias("y"), F.col("vz").alias("z")).distinct()


def triangles(spark: SparkSession, d: str) -> DataFrame:
    """Three vertices with ids 3k, 3k + 1, 3k + 2 of a structure form triangle k; incomplete ones are left out."""
    v = vertices(spark, d).withColumn("tid", F.floor(F.col("vid") / 3)).withColumn("k", F.col("vid") % 3)
    corner = [F.max(F.when(F.col("k") == i, F.col(a))).alias(f"{c}{a}") for i, c in enumerate("abc") for a in "xyz"]
    return v.groupBy("scope", "tid").agg(*corner).where("ax IS NOT NULL AND bx IS NOT NULL AND cx IS NOT NULL")


def strip_faces(spark: SparkSession, d: str) -> DataFrame:
    """Faces of neighbouring ids (k, k + 1, k + 2) of a structure's vertices: a strip that shares its vertices."""
    v = vertices(spark, d).select("scope", "vid")
    b, c = (v.select("scope", (F.col("vid") - i).alias("vid"), F.lit(True).alias(f"has{i}")) for i in (1, 2))
    f = v.join(b, ["scope", "vid"]).join(c, ["scope", "vid"])
    return f.select("scope", F.col("vid").alias("fid"), F.col("vid").alias("a"), (F.col("vid") + 1).alias("b"), (F.col("vid") + 2).alias("c"))


def centres(spark: SparkSession, d: str, own: DataFrame | None = None) -> DataFrame:
    return (atoms(spark, d) if own is None else own).groupBy("scope").agg(F.avg("x").alias("ox"), F.avg("y").alias("oy"), F.avg("z").alias("oz"))


_S = "upper(trim(translate(name, '0123456789', '')))"
GUESS = f"CASE WHEN {_S} = '' THEN 'C' WHEN substring({_S}, 1, 2) IN ('CL', 'BR') THEN substring({_S}, 1, 2) ELSE substring({_S}, 1, 1) END"
SQL = {
    "a": f"""SELECT DISTINCT structure_id AS scope, atom_idx, coalesce(chain, '?') AS chain, coalesce(resname, 'UNK') AS resname, resseq, coalesce(icode, '') AS icode, name,
  CASE WHEN trim(coalesce(element, '')) = '' THEN {GUESS} ELSE upper(trim(element)) END AS element, x, y, z FROM atoms
  WHERE structure_id IS NOT NULL AND resseq IS NOT NULL AND name IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL""",
    "p": """SELECT DISTINCT run_id AS scope, pose_idx, pose_id, vina_score AS score, theta, phi, proj_distance, cluster_id FROM poses_mapped
  WHERE run_id IS NOT NULL AND pose_idx IS NOT NULL AND theta IS NOT NULL AND phi IS NOT NULL AND cluster_id IS NOT NULL AND vina_score IS NOT NULL AND NOT isnan(vina_score) AND NOT isinf(vina_score)""",
    "i": "SELECT DISTINCT structure_id AS scope, chain, resseq, coalesce(icode, '') AS icode FROM interface_residues WHERE structure_id IS NOT NULL AND chain IS NOT NULL AND resseq IS NOT NULL",
    "v": "SELECT DISTINCT structure_id AS scope, vid, vx AS x, vy AS y, vz AS z FROM mesh_vertices WHERE structure_id IS NOT NULL AND vx IS NOT NULL AND vy IS NOT NULL AND vz IS NOT NULL",
    "t": "SELECT * FROM (SELECT scope, vid // 3 AS tid, "
    + ", ".join(f"max(CASE WHEN vid % 3 = {i} THEN {a} END) AS {c}{a}" for i, c in enumerate("abc") for a in "xyz")
    + " FROM v GROUP BY 1, 2) g WHERE ax IS NOT NULL AND bx IS NOT NULL AND cx IS NOT NULL",
    "f": "SELECT v.scope, v.vid AS fid, v.vid AS a, v.vid + 1 AS b, v.vid + 2 AS c FROM v JOIN v v1 ON v1.scope = v.scope AND v1.vid = v.vid + 1 JOIN v v2 ON v2.scope = v.scope AND v2.vid = v.vid + 2",
    "o": "SELECT scope, avg(x) AS ox, avg(y) AS oy, avg(z) AS oz FROM a GROUP BY 1",
}
NEEDS = {"t": ["v"], "f": ["v"], "o": ["a"]}


def quoted(sql: str) -> str:
    """``by`` is a corner's coordinate here; keywords are written in capitals."""
    return re.sub(r"\bby\b", '"by"', sql)


def with_views(names: str, body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """WITH the named views (one letter each) and those they need, then ``extra`` ones, which may be recursive, then the query."""
    order: list[str] = []
    for n in names:
        order += [m for m in [*NEEDS.get(n, []), n] if m not in order]
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({s})" for n, s in (extra or {}).items()]
    return quoted(f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)} {body}")
