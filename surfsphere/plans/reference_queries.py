"""A query for every operator, over the given tables, with its SQL twin where SQL is fast enough."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import angles, chem
from ..operators import clusters, components, grids, mesh, nearest, residues, surface
from ..session import durable, table
from ..sources import pdb, strict, writers
from . import layers, views
from .data_queries import SQL as DATA_SQL
from .views import r6, settled, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
S = ["scope"]
PI = repr(math.pi) + "e0"
#: Grid of the density queries.
SPACING, RADIUS_SCALE, ISO = 2.0, 1.4, 0.4


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def out(df: DataFrame, *keys: str, **values: Column) -> DataFrame:
    return df.select(*keys, *(settled(c).alias(n) for n, c in values.items()))


# --- scans ---------------------------------------------------------------------------------------------


@query(f"SELECT line_id, structure_id, name, resname, chain, resseq, icode, x, y, z, CASE WHEN element = '' THEN {views.GUESS} ELSE element END AS element FROM ({DATA_SQL['p5_atoms']}) b")
def pdb_parse(spark, d):
    good, _ = strict.split_rows(strict.checked_atoms(table(spark, d, "pdb_lines")))
    a = strict.atoms_of(good).withColumn("element", chem.element_or_guess(F.col("element"), F.col("name")))
    return a.select("line_id", "structure_id", "name", "resname", "chain", "resseq", "icode", "x", "y", "z", "element")


_BLOCKS = r"""
l AS (SELECT structure_id, line_no, line, upper(trim(line)) AS s FROM pdb_lines WHERE structure_id IS NOT NULL),
m AS (SELECT *, max(regexp_matches(s, '^MODEL\b')) OVER (PARTITION BY structure_id) AS has_model FROM l),
c AS (SELECT *, CASE WHEN has_model THEN regexp_matches(s, '^MODEL\b') OR regexp_matches(s, '^ENDMDL\b') OR s = 'END' ELSE regexp_matches(s, '^(END|ENDMDL)\b') END AS cut FROM m),
b AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY structure_id ORDER BY line_no) AS block FROM c),
k AS (SELECT structure_id, line_no, dense_rank() OVER (PARTITION BY structure_id ORDER BY block) AS pose_idx FROM b WHERE starts_with(line, 'ATOM') OR starts_with(line, 'HETATM'))"""


def _pose_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "pdb_lines").where("structure_id IS NOT NULL")
    return pdb.split_poses(lines.select("structure_id", F.col("line_no").cast("bigint").alias("line_no"), "line"), ["structure_id"])


@query(f"WITH {_BLOCKS} SELECT structure_id, CAST(pose_idx AS BIGINT) AS pose_idx, count(*) AS n_atoms, CAST(min(line_no) AS BIGINT) AS first_line FROM k GROUP BY 1, 2")
def pose_split(spark, d):
    return _pose_lines(spark, d).groupBy("structure_id", F.col("pose_idx").cast("bigint").alias("pose_idx")).agg(F.count(F.lit(1)).alias("n_atoms"), F.min("line_no").alias("first_line"))


@query(
    f"""SELECT p.scope, p.pose_idx, p.pose_id, s.vina_score AS score FROM (SELECT DISTINCT run_id AS scope, pose_idx, pose_id FROM poses_mapped WHERE run_id IS NOT NULL AND pose_idx IS NOT NULL) p
JOIN (SELECT l.run_id, row_number() OVER (PARTITION BY l.run_id ORDER BY l.line_no) AS k, g.vina_score FROM ({DATA_SQL['p5_scores']}) g JOIN score_lines l USING (line_id)) s
ON s.run_id = p.scope AND s.k = p.pose_idx"""
)
def poses_with_scores(spark, d):
    """Poses joined by position with the readable score lines of their run's file."""
    raw = table(spark, d, "score_lines").select("line_id", F.col("run_id").alias("scope"), F.col("line_no").cast("bigint").alias("line_no"), "line")
    good = strict.scores_of(strict.split_rows(strict.checked_scores(raw))[0])
    listed = pdb.parse_scores(good.select("scope", "line_no", F.col("vina_score").cast("string").alias("line")), S)
    p = table(spark, d, "poses_mapped").where("run_id IS NOT NULL AND pose_idx IS NOT NULL").select(F.col("run_id").alias("scope"), "pose_idx")
    return pdb.positional_join(p, listed.withColumn("pose_idx", F.col("pose_idx").cast("bigint")), S).select("scope", "pose_idx", "pose_id", "score")


@query("SELECT DISTINCT structure_id AS scope, trim(chain) AS chain, resseq, '' AS icode FROM interface_residues WHERE structure_id IS NOT NULL AND chain IS NOT NULL AND resseq IS NOT NULL")
def ppi_parse(spark, d):
    """Interface rows written out as text lines and read back."""
    i = table(spark, d, "interface_residues").where("structure_id IS NOT NULL AND chain IS NOT NULL AND resseq IS NOT NULL")
    line = F.concat_ws("  ", F.lit("Chain"), "chain", F.coalesce("resname", F.lit("UNK")), F.lpad(F.col("resseq").cast("string"), 5, " "))
    return pdb.parse_interface(i.select(F.col("structure_id").alias("scope"), line.alias("line")), S)


# --- scalar functions ----------------------------------------------------------------------------------


@query(with_views("p", "SELECT scope, pose_id, CASE WHEN proj_distance IS NULL THEN 'nan' ELSE printf('%.3f', proj_distance) END AS proj_distance, printf('%.3f', score) AS score FROM p"))
def csv_format(spark, d):
    return writers.csv_cells(views.poses(spark, d).select("scope", "pose_id", "proj_distance", "score"))


def _face_sql(head: str, add: int) -> str:
    return f"SELECT scope, 2 AS section, CAST(fid AS BIGINT) AS id, '{head}' || ' ' || " + " || ' ' || ".join(f"CAST(({c} + {add}) AS BIGINT)" for c in "abc") + " AS line FROM f"


def _mesh_lines(spark: SparkSession, d: str, fmt: str, scalar: str | None) -> DataFrame:
    v = views.vertices(spark, d).select("scope", F.lit(1).alias("section"), F.col("vid").alias("id"), writers.vertex_line(fmt, scalar).alias("line"))
    return v.unionByName(views.strip_faces(spark, d).select("scope", F.lit(2).alias("section"), F.col("fid").alias("id"), writers.face_line(fmt).alias("line")))


@query(with_views("vf", f"SELECT scope, 1 AS section, vid AS id, printf('v %.6f %.6f %.6f', x, y, z) AS line FROM v UNION ALL {_face_sql('f', 1)}"))
def mesh_obj(spark, d):
    """The lines of the vertices and faces of every structure's mesh as OBJ files have them."""
    return _mesh_lines(spark, d, "obj", None)


@query(with_views("vf", f"SELECT scope, 1 AS section, vid AS id, printf('%.6f %.6f %.6f %.6f', x, y, z, z) AS line FROM v UNION ALL {_face_sql('3', 0)}"))
def mesh_ply(spark, d):
    """The same as PLY files have them, with the height as the vertices' scalar."""
    return _mesh_lines(spark, d, "ply", "z")


_NORMAL_VIEWS = {
    "cr": "SELECT *, (by - ay) * (cz - az) - (bz - az) * (cy - ay) AS n0, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS n1, (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) AS n2 FROM t",
    "nl": "SELECT *, sqrt(n0 * n0 + n1 * n1 + n2 * n2) AS l FROM cr",
}
_N = ", ".join(f"CASE WHEN l < 1e-12 THEN 0.0e0 ELSE n{i} / l END" for i in range(3))
_FACET = [f"printf('  facet normal %.6e %.6e %.6e', {_N})", "'    outer loop'", *(f"printf('      vertex %.6e %.6e %.6e', {c}x, {c}y, {c}z)" for c in "abc"), "'    endloop'", "'  endfacet'"]


@query(with_views("t", " UNION ALL ".join(f"SELECT scope, tid, {i} AS part, {e} AS line FROM nl" for i, e in enumerate(_FACET)), _NORMAL_VIEWS))
def mesh_stl(spark, d):
    """The lines of the facets of every structure's triangles as STL files have them."""
    return views.triangles(spark, d).select("scope", "tid", F.posexplode(writers.facet_lines()).alias("part", "line"))


@query(f"SELECT DISTINCT structure_id, atom_idx, name, {views.GUESS} AS guess FROM atoms WHERE name IS NOT NULL")
def guess_element(spark, d):
    a = table(spark, d, "atoms").where("name IS NOT NULL")
    return a.select("structure_id", "atom_idx", "name", chem.guess_element(F.col("name")).alias("guess")).distinct()


_MOD = f"((theta + {PI}) % (2 * {PI}))"
_WRAP = f"(CASE WHEN {_MOD} < 0 THEN ({_MOD} + 2 * {PI}) % (2 * {PI}) ELSE {_MOD} END - {PI})"


@query(with_views("p", f"SELECT scope, pose_id, {r6(_WRAP)} AS theta FROM p"))
def wrap_angle(spark, d):
    return out(views.poses(spark, d), "scope", "pose_id", theta=angles.wrap_angle(F.col("theta")))


_R = "sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy) + (z - oz) * (z - oz))"
_THETA = f"CASE WHEN {_R} < 1e-12 THEN 0.0e0 ELSE atan2(y - oy, x - ox) END"
_PHI = f"CASE WHEN {_R} < 1e-12 THEN {PI} / 2 ELSE acos(greatest(-1.0e0, least(1.0e0, (z - oz) / {_R}))) END"


@query(with_views("av" + "o", f"SELECT v.scope, vid, {r6(_THETA)} AS theta, {r6(_PHI)} AS phi FROM v JOIN o ON v.scope = o.scope"))
def spherical_uv(spark, d):
    v = views.vertices(spark, d).join(views.centres(spark, d), S)
    theta, phi = angles.spherical(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"), F.col("z") - F.col("oz"))
    return out(v, "scope", "vid", theta=theta, phi=phi)


def _projected(name: str):
    def run(spark, d):
        x, y = angles.project(angles.wrap_angle(F.col("theta")), F.col("phi"), name)
        return out(views.poses(spark, d), "scope", "pose_id", x=x, y=y)

    return run


_LON, _LAT = _WRAP, f"({PI} / 2 - phi)"
_HZ = f"sqrt(1 + cos({_LAT}) * cos({_LON} / 2))"
_EDGE = repr(math.pi / 2 - 1e-9) + "e0"
_NEWTON = f"(SELECT scope, pose_id, {_LON} AS lon, greatest(-{_EDGE}, least({_EDGE}, {_LAT})) AS lat, greatest(-{_EDGE}, least({_EDGE}, {_LAT})) AS t FROM p)"
for _i in range(10):
    _NEWTON = f"(SELECT scope, pose_id, lon, lat, t - CASE WHEN 2 + 2 * cos(2 * t) = 0 THEN 0 ELSE (2 * t + sin(2 * t) - {PI} * sin(lat)) / (2 + 2 * cos(2 * t)) END AS t FROM {_NEWTON} n{_i})"
for _name, _sql in {
    "project_equirect": with_views("p", f"SELECT scope, pose_id, {r6(_LON)} AS x, {r6(_LAT)} AS y FROM p"),
    "project_hammer": with_views("p", f"SELECT scope, pose_id, {r6(f'2 * sqrt(2.0e0) * cos({_LAT}) * sin({_LON} / 2) / {_HZ}')} AS x, {r6(f'sqrt(2.0e0) * sin({_LAT}) / {_HZ}')} AS y FROM p"),
    "project_mollweide": with_views("p", f"SELECT scope, pose_id, {r6(f'2 * sqrt(2.0e0) / {PI} * lon * cos(t)')} AS x, {r6('sqrt(2.0e0) * sin(t)')} AS y FROM {_NEWTON} n"),
}.items():
    QUERIES[_name], SQL[_name] = _projected(_name.removeprefix("project_")), _sql


@query(with_views("p", f"SELECT p.scope, pose_id, {r6('w - score + 1e-6')} AS linear, {r6('exp(-score)')} AS expo FROM p JOIN (SELECT scope, max(score) AS w FROM p GROUP BY 1) m ON p.scope = m.scope"))
def score_weights(spark, d):
    p = views.poses(spark, d)
    worst = p.groupBy("scope").agg(F.max("score").alias("worst"))
    s = F.col("score")
    return out(p.join(worst, S), "scope", "pose_id", linear=angles.score_weight(s, "linear", F.col("worst")), expo=angles.score_weight(s, "exp"))


@query(
    with_views(
        "p",
        f"""SELECT p.scope, pose_id, {r6('CASE WHEN hi - lo < 1e-12 THEN 0.0e0 ELSE (proj_distance - lo) / (hi - lo) END')} AS proj_distance
FROM p JOIN (SELECT scope, min(proj_distance) AS lo, max(proj_distance) AS hi FROM p WHERE proj_distance IS NOT NULL GROUP BY 1) m ON p.scope = m.scope WHERE proj_distance IS NOT NULL""",
    )
)
def normalize_01(spark, d):
    p = views.poses(spark, d).where("proj_distance IS NOT NULL").select("scope", "pose_id", "proj_distance")
    return out(mesh.min_max(p, "proj_distance", S), "scope", "pose_id", proj_distance=F.col("proj_distance"))


@query(with_views("vo", f"SELECT v.scope, vid, {r6(_R)} AS radial FROM v JOIN o ON v.scope = o.scope"))
def radial_distance(spark, d):
    v = views.vertices(spark, d).join(views.centres(spark, d), S)
    return out(v, "scope", "vid", radial=angles.distance(*((F.col(a), F.col(f"o{a}")) for a in "xyz")))


@query(
    """SELECT DISTINCT run_id, pose_id, CASE WHEN g = '' THEN 'LIG' || pose_id ELSE 'LIG' || CASE WHEN length(n) >= 4 THEN n ELSE lpad(n, 4, '0') END END AS label
FROM (SELECT run_id, pose_id, regexp_replace(pose_id, '[^0-9]', '', 'g') AS g, CAST(try_cast(regexp_replace(pose_id, '[^0-9]', '', 'g') AS BIGINT) AS VARCHAR) AS n FROM poses_mapped) q"""
)
def ligid(spark, d):
    return table(spark, d, "poses_mapped").select("run_id", "pose_id", chem.ligand_label(F.col("pose_id")).alias("label")).distinct()


# --- residues ------------------------------------------------------------------------------------------


@query(with_views("a", "SELECT scope, atom_idx, x, y, z FROM a WHERE upper(trim(name)) = 'CA'"))
def trace_ca(spark, d):
    return views.atoms(spark, d).where(F.upper(F.trim("name")) == "CA").select("scope", "atom_idx", "x", "y", "z")


_HAS = "SELECT 1 FROM a WHERE a.scope = i.scope AND a.chain = i.chain AND a.resseq = i.resseq AND a.icode = i.icode"


@query(with_views("ai", f"SELECT * FROM i WHERE EXISTS ({_HAS})"))
def ppi_present(spark, d):
    return residues.present(views.interface(spark, d), views.atoms(spark, d), S)


@query(with_views("ai", f"SELECT * FROM i WHERE NOT EXISTS ({_HAS})"))
def ppi_missing(spark, d):
    return residues.missing(views.interface(spark, d), views.atoms(spark, d), S)


@query(with_views("a", "SELECT scope, chain, count(*) AS n_atoms, count(DISTINCT (resseq, icode)) AS n_residues FROM a GROUP BY 1, 2"))
def residue_inventory(spark, d):
    return residues.inventory(views.atoms(spark, d), S)


@query(
    with_views(
        "ai",
        """SELECT m.scope, interface_total, present_count, missing_count, interface_chains, coalesce(residue_total, 0) AS residue_total, coalesce(chains, '') AS chains, missing_examples FROM
(SELECT scope, count(*) AS interface_total, count(*) FILTER (WHERE found) AS present_count, count(*) FILTER (WHERE NOT found) AS missing_count,
        string_agg(DISTINCT chain, ',' ORDER BY chain) AS interface_chains,
        coalesce(string_agg(chain || ':' || resseq || icode, ',' ORDER BY chain, resseq, icode) FILTER (WHERE NOT found AND k <= 20), '') AS missing_examples
 FROM (SELECT *, row_number() OVER (PARTITION BY scope, found ORDER BY chain, resseq, icode) AS k FROM
   (SELECT i.*, EXISTS (%s) AS found FROM i) e) f GROUP BY 1) m
LEFT JOIN (SELECT scope, count(DISTINCT (chain, resseq, icode)) AS residue_total, string_agg(DISTINCT chain, ',' ORDER BY chain) AS chains FROM a GROUP BY 1) t ON t.scope = m.scope""" % _HAS,
    )
)
def ppi_validation(spark, d):
    v = residues.validation(views.interface(spark, d), views.atoms(spark, d), S)
    return v.withColumns({c: F.array_join(c, ",") for c in ("interface_chains", "chains", "missing_examples")})


@query(with_views("a", f"SELECT scope, chain, {', '.join(f'{r6(f'avg({c})')} AS c{c}' for c in 'xyz')} FROM a GROUP BY 1, 2"))
def pose_cog(spark, d):
    c = residues.centre_of_geometry(views.atoms(spark, d), ["scope", "chain"])
    return out(c, "scope", "chain", **{f"c{a}": F.col(f"c{a}") for a in "xyz"})


_MASS = "CASE element " + " ".join(f"WHEN '{e}' THEN {m}e0" for e, m in chem.MASS.items()) + f" ELSE {chem.OTHER_MASS}e0 END"


@query(with_views("a", f"SELECT scope, chain, {', '.join(f'{r6(f'sum(w * {c}) / sum(w)')} AS c{c}' for c in 'xyz')} FROM (SELECT *, {_MASS} AS w FROM a) m GROUP BY 1, 2"))
def pose_com(spark, d):
    c = residues.centre_of_mass(views.atoms(spark, d), ["scope", "chain"])
    return out(c, "scope", "chain", **{f"c{a}": F.col(f"c{a}") for a in "xyz"})


_POINT = {
    "ca": "coalesce(arg_min({c}, atom_idx) FILTER (WHERE upper(name) = 'CA'), avg({c}))",
    "res": "avg({c})",
    "sc": "coalesce(avg({c}) FILTER (WHERE upper(name) NOT IN ('N', 'CA', 'C', 'O', 'OXT')), avg({c}))",
}
_RES = "scope, chain, resseq, icode"


def _points_sql(mode: str) -> str:
    return f"SELECT {_RES}, {', '.join(f'{_POINT[mode].format(c=c)} AS p{c}' for c in 'xyz')}, arg_min(resname, atom_idx) || resseq || icode AS label FROM a GROUP BY {_RES}"


def _residue_points(mode: str):
    def run(spark, d):
        r = residues.residue_points(views.atoms(spark, d), S, mode)
        return out(r, "scope", "chain", "resseq", "icode", "label", **{f"p{a}": F.col(f"p{a}") for a in "xyz"})

    return run


for _short, _mode in (("ca", "ca"), ("res", "res_com"), ("sc", "sc_com")):
    QUERIES[f"residue_point_{_short}"] = _residue_points(_mode)
    SQL[f"residue_point_{_short}"] = with_views("a", f"SELECT {_RES}, label, {', '.join(f'{r6(f'p{c}')} AS p{c}' for c in 'xyz')} FROM ({_points_sql(_short)}) q")


@query(with_views("a", "SELECT scope, chain, resseq, icode, arg_min(x, atom_idx) AS x, arg_min(y, atom_idx) AS y, arg_min(z, atom_idx) AS z FROM a WHERE name = 'CA' GROUP BY 1, 2, 3, 4"))
def ca_trace_dedup(spark, d):
    return residues.ca_trace(views.atoms(spark, d), S)


# --- projection on the surface -------------------------------------------------------------------------


def _interface_points(spark: SparkSession, d: str, own: DataFrame | None = None) -> DataFrame:
    atoms = residues.interface_atoms(views.interface(spark, d), views.atoms(spark, d) if own is None else own, S)
    r = residues.residue_points(atoms, S, "sc_com")
    return r.withColumn("pid", F.concat_ws(":", "chain", F.col("resseq").cast("string"), "icode"))


_IP = f"SELECT *, chain || ':' || resseq || ':' || icode AS pid FROM ({_points_sql('sc').replace('FROM a', 'FROM (SELECT a.* FROM a JOIN i ON a.scope = i.scope AND a.chain = i.chain AND a.resseq = i.resseq AND a.icode = i.icode) j')}) q"


def _nearest_sql(source: str, stages: nearest.Stages, points: str = "q") -> str:
    pairs = f"(SELECT k.scope, k.pid, k.px, k.py, k.pz, t.* EXCLUDE (scope) FROM {points} k JOIN {source} t ON k.scope = t.scope)"
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, pid ORDER BY d2, tid) AS rn FROM {nearest.staged_sql(pairs, stages)} s) r WHERE rn = 1"


_VT = "(SELECT scope, vid AS tid, x AS ax, y AS ay, z AS az FROM v)"


def _vertex_targets(spark: SparkSession, d: str) -> DataFrame:
    return views.vertices(spark, d).select("scope", F.col("vid").alias("tid"), *(F.col(c).alias(f"a{c}") for c in "xyz"))


@query(with_views("aiv", f"SELECT scope, pid, tid, {r6('sqrt(d2)')} AS distance FROM ({_nearest_sql(_VT, nearest.VERTEX)}) n", {"q": _IP}))
def nearest_vertex(spark, d):
    n = nearest.nearest(_interface_points(spark, d), _vertex_targets(spark, d), nearest.VERTEX)
    return out(n, "scope", "pid", "tid", distance=F.col("distance"))


_Q = ", ".join(f"{r6(f'q{c}')} AS q{c}" for c in "xyz")


@query(with_views("ait", f"SELECT scope, pid, {r6('sqrt(d2)')} AS distance, {_Q} FROM ({_nearest_sql('t', nearest.TRIANGLE)}) n", {"q": _IP}))
def nearest_triangle(spark, d):
    n = nearest.nearest(_interface_points(spark, d), views.triangles(spark, d))
    return out(n, "scope", "pid", distance=F.col("distance"), **{f"q{c}": F.col(f"q{c}") for c in "xyz"})


_LEN = "sqrt((px - ox) * (px - ox) + (py - oy) * (py - oy) + (pz - oz) * (pz - oz))"
_RAYS = f"(SELECT q.scope, q.pid, px, py, pz, ox, oy, oz, {', '.join(f'(p{c} - o{c}) / {_LEN} AS g{c}' for c in 'xyz')}, t.* EXCLUDE (scope) FROM q JOIN o ON q.scope = o.scope JOIN t ON t.scope = q.scope WHERE {_LEN} >= 1e-12)"


@query(
    with_views(
        "aiot",
        f"""SELECT scope, pid, {r6('distance')} AS distance, hit FROM (SELECT scope, pid, sqrt((px - ox - t * gx) * (px - ox - t * gx) + (py - oy - t * gy) * (py - oy - t * gy) + (pz - oz - t * gz) * (pz - oz - t * gz)) AS distance, TRUE AS hit FROM h
UNION ALL SELECT scope, pid, sqrt(d2), FALSE FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.scope = n.scope AND h.pid = n.pid)) u""",
        {
            "q": _IP,
            "h": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, pid ORDER BY t, tid) AS rn FROM {nearest.staged_sql(_RAYS, nearest.RAY)} s WHERE t IS NOT NULL) r WHERE rn = 1",
            "n": _nearest_sql("t", nearest.TRIANGLE),
        },
    )
)
def raycast(spark, d):
    atoms = views.atoms_by_residue(spark, d)
    points = _interface_points(spark, d, atoms).join(views.centres(spark, d, atoms), S)
    return out(nearest.raycast(points, views.triangles(spark, d)), "scope", "pid", "hit", distance=F.col("distance"))


def _atom_cloud(spark: SparkSession, d: str) -> DataFrame:
    heavy = residues.interface_atoms(views.interface(spark, d), views.atom_rows(spark, d), S, heavy=True).distinct()
    points = heavy.select("scope", F.col("atom_idx").alias("pid"), *(F.col(c).alias(f"p{c}") for c in "xyz"))
    return nearest.nearest(points, _vertex_targets(spark, d), nearest.VERTEX)


_CLOUD = "SELECT a.scope, atom_idx AS pid, x AS px, y AS py, z AS pz FROM a JOIN i ON a.scope = i.scope AND a.chain = i.chain AND a.resseq = i.resseq AND a.icode = i.icode WHERE element <> 'H'"
#: Distance up to which an atom counts as near the surface.
NEAR = 1.5


@query(with_views("aiv", f"SELECT scope, pid AS atom_idx, {r6('sqrt(d2)')} AS distance FROM ({_nearest_sql(_VT, nearest.VERTEX)}) n WHERE sqrt(d2) <= {NEAR}e0", {"q": _CLOUD}))
def near_surface(spark, d):
    n = _atom_cloud(spark, d).where(F.col("distance") <= NEAR).withColumnRenamed("pid", "atom_idx")
    return out(n, "scope", "atom_idx", distance=F.col("distance"))


_UV = {"theta": _THETA, "phi": _PHI}
_UV_HIT = {n: e.replace("(x -", "(qx -").replace("(y -", "(qy -").replace("(z -", "(qz -").replace(", x -", ", qx -").replace("atan2(y", "atan2(qy") for n, e in _UV.items()}
_UVQ = ", ".join(f"{r6(e)} AS {n}" for n, e in _UV_HIT.items())


def _mapped(n: DataFrame, spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, Column]]:
    theta, phi = angles.spherical(*(F.col(f"q{a}") - F.col(f"o{a}") for a in "xyz"))
    return n.join(views.centres(spark, d), S), {"theta": theta, "phi": phi}


@query(with_views("aiov", f"SELECT n.scope, pid AS atom_idx, {_UVQ} FROM ({_nearest_sql(_VT, nearest.VERTEX)}) n JOIN o ON n.scope = o.scope WHERE sqrt(d2) <= {NEAR}e0", {"q": _CLOUD}))
def ppi_atom_cloud(spark, d):
    n, uv = _mapped(_atom_cloud(spark, d).where(F.col("distance") <= NEAR).withColumnRenamed("pid", "atom_idx"), spark, d)
    return out(n, "scope", "atom_idx", **uv)


@query(with_views("aiot", f"SELECT n.scope, label, {_UVQ} FROM (SELECT scope, pid, qx, qy, qz FROM ({_nearest_sql("t", nearest.TRIANGLE)}) w) n JOIN o ON n.scope = o.scope JOIN q ON q.scope = n.scope AND q.pid = n.pid", {"q": _IP}))
def ppi_residue_points(spark, d):
    points = _interface_points(spark, d)
    n, uv = _mapped(nearest.nearest(points, views.triangles(spark, d)).join(points.select("scope", "pid", "label"), ["scope", "pid"]), spark, d)
    return out(n, "scope", "label", **uv)


# --- clusters ------------------------------------------------------------------------------------------


_DOT = "(sin(a.phi_centroid) * cos(a.theta_centroid) * sin(b.phi_centroid) * cos(b.theta_centroid) + sin(a.phi_centroid) * sin(a.theta_centroid) * sin(b.phi_centroid) * sin(b.theta_centroid) + cos(a.phi_centroid) * cos(b.phi_centroid))"
_CC = "SELECT DISTINCT run_id, cluster_id, theta_centroid, phi_centroid FROM clusters WHERE run_id IS NOT NULL AND theta_centroid IS NOT NULL AND phi_centroid IS NOT NULL"


@query(f"WITH c AS ({_CC}) SELECT a.run_id, a.cluster_id, b.cluster_id AS other, {r6(f'acos(greatest(-1.0e0, least(1.0e0, {_DOT})))')} AS angle FROM c a JOIN c b ON a.run_id = b.run_id AND a.cluster_id < b.cluster_id WHERE acos(greatest(-1.0e0, least(1.0e0, {_DOT}))) <= {math.radians(40)!r}e0")
def angular_pairs(spark, d):
    """Clusters of a run whose centroids are at most 40 degrees apart; a run has a few dozen summaries."""
    c = table(spark, d, "clusters").where("run_id IS NOT NULL AND theta_centroid IS NOT NULL AND phi_centroid IS NOT NULL").select("run_id", "cluster_id", "theta_centroid", "phi_centroid").distinct()
    pairs = layers.angular_pairs(c.select(F.col("run_id").alias("scope"), F.col("cluster_id").alias("pid"), F.col("theta_centroid").alias("theta"), F.col("phi_centroid").alias("phi")), math.radians(40))
    return out(pairs.select(F.col("scope").alias("run_id"), F.col("pid").alias("cluster_id"), "other", "angle"), "run_id", "cluster_id", "other", angle=F.col("angle"))


_LIMIT = f"{math.radians(15.0)!r}e0"
_PATCH = f"{2 * math.sin(math.radians(7.5)) / math.sqrt(3) * (1 - 1e-9)!r}e0"
#: Poses of a patch are neighbours, so patches with neighbours among their poses are the graph's nodes; the twin compares all pairs of poses.
_SITES = {
    "lo": """SELECT DISTINCT run_id AS scope, pose_idx, pose_id, CASE WHEN isfinite(vina_score) THEN vina_score END AS score, theta, phi FROM poses_mapped
  WHERE run_id IS NOT NULL AND pose_idx IS NOT NULL AND isfinite(theta) AND isfinite(phi)""",
    "un": "SELECT *, sin(phi) * cos(theta) AS ux, sin(phi) * sin(theta) AS uy, cos(phi) AS uz FROM lo",
    "pt": f"SELECT *, concat_ws(' ', CAST(floor(ux / {_PATCH}) AS BIGINT), CAST(floor(uy / {_PATCH}) AS BIGINT), CAST(floor(uz / {_PATCH}) AS BIGINT)) AS patch FROM un",
    "lk": f"SELECT DISTINCT a.scope, a.patch AS x, b.patch AS y FROM pt a JOIN pt b ON a.scope = b.scope AND a.patch <> b.patch AND acos(greatest(-1.0e0, least(1.0e0, a.ux * b.ux + a.uy * b.uy + a.uz * b.uz))) <= {_LIMIT}",
    "nd": "SELECT scope, patch, min(pose_idx) AS head FROM pt GROUP BY 1, 2",
    "re": "SELECT scope, patch AS x, patch AS y FROM nd UNION SELECT re.scope, re.x, lk.y FROM re JOIN lk ON lk.scope = re.scope AND lk.x = re.y",
    "fi": "SELECT re.scope, re.x AS patch, min(nd.head) AS head FROM re JOIN nd ON nd.scope = re.scope AND nd.patch = re.y GROUP BY 1, 2",
    "lb": "SELECT pt.*, CAST(dense_rank() OVER (PARTITION BY pt.scope ORDER BY fi.head) - 1 AS INT) AS label FROM pt JOIN fi ON fi.scope = pt.scope AND fi.patch = pt.patch",
}


@query(with_views("", "SELECT scope, pose_id, label AS raw_label FROM lb", _SITES, recursive=True))
def sphere_clusters(spark, d):
    """Each pose's component of the 15 degree graph of its run, numbered by first members."""
    p = views.located(spark, d)
    return layers.labelled(p, math.radians(15.0)).select("scope", "pose_id", "raw_label")


_STATS = f"""SELECT scope, cluster_id AS label, count(*) AS n_poses, arg_min(pose_id, (score, pose_idx)) AS best_pose_id, min(score) AS lo, max(score) AS hi, avg(score) AS mean, stddev_pop(score) AS sd,
  coalesce(var_samp(score), 0.0e0) AS var, avg(sin(phi) * cos(theta)) AS mx, avg(sin(phi) * sin(theta)) AS my, avg(cos(phi)) AS mz FROM p GROUP BY 1, 2"""
_RANKED = "SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n_poses DESC, lo, label) AS rank FROM st"
_NORM = "sqrt(mx * mx + my * my + mz * mz)"
_VIEWS = {"st": _STATS, "rk": _RANKED}


@query(with_views("p", f"SELECT scope, label AS cluster_id, {r6('atan2(my, mx)')} AS theta, {r6(f'acos(greatest(-1.0e0, least(1.0e0, mz / {_NORM})))')} AS phi FROM st", _VIEWS))
def cluster_centroid(spark, d):
    m = clusters.moments(views.poses(spark, d), S, "cluster_id")
    return out(m, "scope", "cluster_id", theta=F.col("theta_centroid"), phi=F.col("phi_centroid"))


@query(with_views("p", "SELECT scope, label, CAST(rank AS INT) AS rank, n_poses FROM rk", _VIEWS))
def cluster_rank(spark, d):
    m = clusters.ranked(clusters.moments(views.poses(spark, d), S, "cluster_id"), S, "cluster_id")
    return m.select("scope", F.col("cluster_id").alias("label"), "rank", "n_poses")


@query(with_views("p", f"SELECT scope, CAST(rank AS INT) AS cluster_id, n_poses, best_pose_id, lo AS vina_score_min, hi AS vina_score_max, {r6('mean')} AS vina_score_avg, {r6('sd')} AS vina_score_stddev FROM rk", _VIEWS))
def cluster_summary(spark, d):
    s = clusters.summary(views.poses(spark, d).withColumnRenamed("cluster_id", "label"), S, "label")
    return out(s, "scope", "cluster_id", "n_poses", "best_pose_id", "vina_score_min", "vina_score_max", vina_score_avg=F.col("vina_score_avg"), vina_score_stddev=F.col("vina_score_stddev"))


_WELCH = """SELECT k.scope, k.rank, k.n_poses AS n2, k.mean AS m2, k.var AS v2, r.n_poses AS n1, r.mean AS m1, r.var AS v1, k.var / k.n_poses + r.var / r.n_poses AS se2
FROM rk k JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY mean, rank) AS best FROM rk) b WHERE best = 1) r ON r.scope = k.scope"""
_DEN = "(CASE WHEN n1 > 1 THEN v1 * v1 / (n1 * n1 * (n1 - 1.0e0)) ELSE 0.0e0 END + CASE WHEN n2 > 1 THEN v2 * v2 / (n2 * n2 * (n2 - 1.0e0)) ELSE 0.0e0 END)"


@query(with_views("p", f"SELECT scope, CAST(rank AS INT) AS cluster_id, CASE WHEN se2 > 1e-20 THEN {r6('abs(m1 - m2) / sqrt(se2)')} END AS t, CASE WHEN se2 > 1e-20 THEN {r6(f'se2 * se2 / {_DEN}')} END AS dof FROM w", {**_VIEWS, "w": _WELCH}))
def welch_pvalue(spark, d):
    s = clusters.tested(clusters.ranked(clusters.moments(views.poses(spark, d), S, "cluster_id"), S, "cluster_id"), S)
    return out(s, "scope", F.col("rank").alias("cluster_id"), t=F.col("t"), dof=F.col("dof"))


def _test_views(ranked: str) -> dict[str, str]:
    """Welch's test of ``ranked`` (scope, rank, n, mean, var) against the row of lowest mean: view pv (scope, rank, p_value).

    The incomplete beta function comes from its power series, whose terms are all positive.
    """
    den = "(CASE WHEN n1 > 1 THEN v1 * v1 / (n1 * n1 * (n1 - 1.0e0)) ELSE 0.0e0 END + CASE WHEN n2 > 1 THEN v2 * v2 / (n2 * n2 * (n2 - 1.0e0)) ELSE 0.0e0 END)"
    return {
        "we": f"""SELECT k.scope, k.rank, k.n AS n2, k.mean AS m2, coalesce(k.var, 0.0e0) AS v2, r.n AS n1, r.mean AS m1, coalesce(r.var, 0.0e0) AS v1
  FROM {ranked} k JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY mean NULLS LAST, rank) AS best FROM {ranked}) b WHERE best = 1) r ON r.scope = k.scope""",
        "se": f"SELECT *, CASE WHEN n1 > 0 AND n2 > 0 THEN v1 / n1 + v2 / n2 END AS se2, {den} AS den FROM we",
        "td": "SELECT *, abs(m1 - m2) / sqrt(se2) AS t, se2 * se2 / den AS dof FROM se WHERE se2 > 0 AND den > 0",
        "xa": "SELECT scope, rank, dof / (dof + t * t) AS x, dof / 2 AS a, 0.5e0 AS b FROM td",
        "sw": "SELECT scope, rank, x >= (a + 1) / (a + b + 2) AS turn, CASE WHEN x >= (a + 1) / (a + b + 2) THEN 1 - x ELSE x END AS x, CASE WHEN x >= (a + 1) / (a + b + 2) THEN b ELSE a END AS a, CASE WHEN x >= (a + 1) / (a + b + 2) THEN a ELSE b END AS b FROM xa",
        "sr": "SELECT scope, rank, x, a, b, 0 AS n, 1.0e0 AS term, 1.0e0 AS total FROM sw UNION ALL SELECT scope, rank, x, a, b, n + 1, term * x * (a + b + n) / (a + 1 + n), total + term * x * (a + b + n) / (a + 1 + n) FROM sr WHERE term > 1e-17 * total AND n < 100000",
        "su": "SELECT scope, rank, max(total) AS total FROM sr GROUP BY 1, 2",
        "ib": "SELECT scope, rank, turn, CASE WHEN x <= 0 THEN 0.0e0 ELSE exp(a * ln(x) + b * ln(1 - x) - (lgamma(a) + lgamma(b) - lgamma(a + b))) * total / a END AS v FROM sw JOIN su USING (scope, rank)",
        "pv": "SELECT se.scope, se.rank, CASE WHEN se2 = 0 THEN CASE WHEN m1 = m2 THEN 1.0e0 ELSE 0.0e0 END WHEN turn THEN 1 - v ELSE v END AS p_value FROM se LEFT JOIN ib USING (scope, rank)",
    }


_TESTED = {**_VIEWS, "rn": "SELECT scope, rank, n_poses AS n, mean, var FROM rk", **_test_views("rn")}


@query(with_views("p", f"SELECT scope, CAST(rank AS INT) AS cluster_id, {r6('p_value')} AS p_value FROM pv", _TESTED, recursive=True))
def cluster_pvalues(spark, d):
    """The p-values of Welch's test themselves; also tested against known values."""
    s = clusters.summary(views.poses(spark, d).withColumnRenamed("cluster_id", "label"), S, "label")
    return out(s, "scope", "cluster_id", p_value=F.col("p_value"))


@query(with_views("p", "SELECT scope, pose_id, cluster_id, score, CAST(row_number() OVER (PARTITION BY scope ORDER BY cluster_id, score, pose_id) AS INT) AS position FROM p"))
def poses_ordered(spark, d):
    return clusters.order_poses(views.poses(spark, d), S).select("scope", "pose_id", "cluster_id", "score", "position")


@query(with_views("p", "SELECT scope, pose_id, CAST(k AS INT) AS trace_rank FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score, pose_idx) AS k FROM p) q WHERE k <= 5"))
def trace_topk(spark, d):
    return clusters.trace_poses(views.poses(spark, d), S, "5").select("scope", "pose_id", "trace_rank")


@query(with_views("p", "SELECT scope, pose_id, CASE WHEN k <= 5 THEN 'LIG' || lpad(regexp_replace(regexp_replace(pose_id, '[^0-9]', '', 'g'), '^0+', ''), CAST(greatest(4, length(regexp_replace(regexp_replace(pose_id, '[^0-9]', '', 'g'), '^0+', ''))) AS INT), '0') ELSE '' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score, pose_idx) AS k FROM p) q"))
def pose_labels(spark, d):
    return layers.pose_labels(views.poses(spark, d), S, "topN", 5).select("scope", "pose_id", "label")


@query(with_views("p", f"SELECT scope, {r6('-atan2(sum(sin(theta)), sum(cos(theta)))')} AS seam, {r6('-atan2(sum(exp(-score) * sin(theta)), sum(exp(-score) * cos(theta)))')} AS weighted_seam FROM p GROUP BY 1"))
def auto_seam(spark, d):
    p = views.poses(spark, d)
    return out(p.groupBy("scope").agg(layers.auto_seam(F.col("theta")).alias("s"), layers.auto_seam(F.col("theta"), F.exp(-F.col("score"))).alias("w")), "scope", seam=F.col("s"), weighted_seam=F.col("w"))


_LABEL = f"rank || ':' || n_poses || chr(10) || '<' || printf('%.2f', {r6('mean')}) || '>'"


@query(
    with_views(
        "p",
        f"""SELECT k.scope, k.label AS cluster_id, CASE WHEN abs({r6('k.mean')} - b.best) <= 1e-8 + 1e-5 * abs(b.best) THEN 'red' WHEN c.p_value < 0.05 THEN 'lime' ELSE 'white' END AS outline, {_LABEL} AS text
FROM rk k JOIN (SELECT scope, min({r6('mean')}) AS best FROM rk GROUP BY 1) b ON b.scope = k.scope LEFT JOIN (SELECT run_id, cluster_id, max(p_value) AS p_value FROM clusters GROUP BY 1, 2) c ON c.run_id = k.scope AND c.cluster_id = k.label""",
        _VIEWS,
    )
)
def centroid_layer(spark, d):
    """Centroids' labels and outlines, with the p-values that the runs' own summaries state."""
    m = clusters.ranked(clusters.moments(views.poses(spark, d), S, "cluster_id"), S, "cluster_id")
    stated = table(spark, d, "clusters").groupBy(F.col("run_id").alias("scope"), "cluster_id").agg(F.max("p_value").alias("p_value"))
    m = m.withColumn("score_avg", settled(F.col("score_avg")))
    return layers.centroid_layer(m.join(stated, ["scope", "cluster_id"], "left"), S).select("scope", "cluster_id", "outline", "text")


# --- grids ---------------------------------------------------------------------------------------------


def _edge_sql(lo: str, hi: str, n: int, i: str) -> str:
    return f"(CASE WHEN {i} = {n} THEN {hi} ELSE ({i}) * (({hi} - ({lo})) / {n}) + ({lo}) END)"


def _bin_sql(x: str, lo: str, hi: str, n: int) -> str:
    i = f"floor(({x} - ({lo})) / (({hi} - ({lo})) / {n}))"
    return f"CAST(CASE WHEN {x} < {_edge_sql(lo, hi, n, i)} THEN {i} - 1 WHEN {x} >= {_edge_sql(lo, hi, n, f'({i} + 1)')} THEN {i} + 1 ELSE {i} END AS INT)"


_HALF = repr(math.pi / 2) + "e0"
_LATB, _LONB = (f"-{_HALF}", _HALF, 180), (f"-{PI}", PI, 360)


def _hist_sql(source: str, lat: str, lon: str, value: str, scope: str = "") -> str:
    inside = f"{lat} BETWEEN -{_HALF} AND {_HALF} AND {lon} BETWEEN -{PI} AND {PI}"
    return f"SELECT {scope}least(179, {_bin_sql(lat, *_LATB)}) AS iy, least(359, {_bin_sql(lon, *_LONB)}) AS ix, {value} AS value FROM {source} WHERE {inside} GROUP BY ALL"


_PW = f"(SELECT scope, {_WRAP} AS lon, {_HALF} - phi AS lat, score FROM p)"


def _pose_map(spark: SparkSession, d: str) -> DataFrame:
    return views.poses(spark, d).select("scope", angles.wrap_angle(F.col("theta")).alias("lon"), (math.pi / 2 - F.col("phi")).alias("lat"), "score")


@query(with_views("p", f"SELECT scope, iy, ix, {r6('value')} AS value FROM ({_hist_sql(f'(SELECT scope, unnest([lon, lon - 2 * {PI}, lon + 2 * {PI}]) AS lon, lat, score FROM {_PW} w)', 'lat', 'lon', 'sum(exp(-score / 10))', 'scope, ')}) h"))
def pose_density_hist(spark, d):
    m = grids.tripled(_pose_map(spark, d))
    return out(grids.histogram(m, S, F.col("lat"), F.col("lon"), F.exp(-F.col("score") / 10)), "scope", "iy", "ix", value=F.col("value"))


_CLOUD_UV = f"SELECT n.scope, {_THETA.replace('(x -', '(px -').replace('(y -', '(py -').replace('(z -', '(pz -').replace(', x -', ', px -').replace('atan2(y', 'atan2(py')} AS lon, {_HALF} - ({_PHI.replace('(x -', '(px -').replace('(y -', '(py -').replace('(z -', '(pz -')}) AS lat FROM ({_CLOUD}) n JOIN o ON n.scope = o.scope"


@query(with_views("aio", _hist_sql(f"({_CLOUD_UV})", "lat", "lon", "CAST(count(*) AS DOUBLE)", "scope, ")))
def ppi_hist(spark, d):
    """Interface atoms by the map cell of their own direction."""
    heavy = residues.interface_atoms(views.interface(spark, d), views.atoms(spark, d), S, heavy=True).join(views.centres(spark, d), S)
    theta, phi = angles.spherical(*(F.col(a) - F.col(f"o{a}") for a in "xyz"))
    return grids.histogram(heavy, S, math.pi / 2 - phi, theta)


#: Footprints of fewer points than that are drawn as points, not as a map.
FEW = 20


@query(
    with_views(
        "aiov",
        _hist_sql("(SELECT * FROM fp WHERE scope IN (SELECT scope FROM fp GROUP BY 1 HAVING count(*) >= 20))", "lat", "lon", "CAST(count(*) AS DOUBLE)", "scope, "),
        {"q": _CLOUD, "fp": f"SELECT n.scope, {_UV_HIT['theta']} AS lon, {_HALF} - ({_UV_HIT['phi']}) AS lat FROM ({_nearest_sql(_VT, nearest.VERTEX)}) n JOIN o ON n.scope = o.scope"},
    )
)
def ppi_footprint_hist(spark, d):
    """The interface atoms' places on the surface by map cell, for structures with at least FEW of them."""
    n, uv = _mapped(_atom_cloud(spark, d), spark, d)
    spots = n.select("scope", grids.closed_bin(math.pi / 2 - uv["phi"], -math.pi / 2, math.pi / 2, 180).alias("iy"), grids.closed_bin(uv["theta"], -math.pi, math.pi, 360).alias("ix"))
    cells = spots.groupBy("scope", "iy", "ix").agg(F.sum(F.lit(1.0)).alias("value")).withColumn("n", F.sum("value").over(Window.partitionBy("scope")))
    return cells.where((F.col("n") >= FEW) & F.col("iy").isNotNull() & F.col("ix").isNotNull()).drop("n")


_BG = f"SELECT scope, greatest(0, least(179, {_bin_sql('lat', *_LATB)})) AS iy, greatest(0, least(359, {_bin_sql('lon', *_LONB)})) AS ix, avg(radial) AS value FROM (SELECT v.scope, {_THETA} AS lon, {_HALF} - ({_PHI}) AS lat, {_R} AS radial FROM v JOIN o ON v.scope = o.scope) m GROUP BY 1, 2, 3"


def _background(spark: SparkSession, d: str) -> DataFrame:
    v = views.vertices(spark, d).join(views.centres(spark, d), S)
    theta, phi = angles.spherical(*(F.col(a) - F.col(f"o{a}") for a in "xyz"))
    return grids.mean_grid(v, S, math.pi / 2 - phi, theta, angles.distance(*((F.col(a), F.col(f"o{a}")) for a in "xyz")))


@query(with_views("vo", f"SELECT scope, iy, ix, {r6('value')} AS value FROM ({_BG}) g"))
def background_grid(spark, d):
    return out(_background(spark, d), "scope", "iy", "ix", value=F.col("value"))


@query(with_views("vo", f"SELECT g.scope, iy, ix, {r6('CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0.0e0 END')} AS value FROM g JOIN (SELECT scope, min(value) AS lo, max(value) AS hi FROM g GROUP BY 1) m ON m.scope = g.scope", {"g": _BG}))
def background_scaled(spark, d):
    return out(grids.scaled(_background(spark, d), S), "scope", "iy", "ix", value=F.col("value"))


@query(with_views("p", f"SELECT scope, pose_id, {r6('lon')} AS lon FROM (SELECT scope, pose_id, unnest([{_WRAP}, {_WRAP} - 2 * {PI}, {_WRAP} + 2 * {PI}]) AS lon FROM p) q"))
def wrap_lonlat(spark, d):
    p = views.poses(spark, d).select("scope", "pose_id", angles.wrap_angle(F.col("theta")).alias("lon"))
    return out(grids.tripled(p), "scope", "pose_id", lon=F.col("lon"))


_NY = int(70 / math.sqrt(3))
_HEX = f"""SELECT m.scope, (lon - (lox - 1e-9 * (hix - lox))) / ((hix + 1e-9 * (hix - lox) - (lox - 1e-9 * (hix - lox))) / 70) AS hx, (lat - loy) / ((hiy - loy) / {_NY}) AS hy
FROM {_PW} m JOIN (SELECT scope, lox - CASE WHEN lox = hix THEN greatest(0.1e0, abs(lox) * 0.1e0) ELSE 0 END AS lox, hix + CASE WHEN lox = hix THEN greatest(0.1e0, abs(lox) * 0.1e0) ELSE 0 END AS hix,
  loy - CASE WHEN loy = hiy THEN greatest(0.1e0, abs(loy) * 0.1e0) ELSE 0 END AS loy, hiy + CASE WHEN loy = hiy THEN greatest(0.1e0, abs(loy) * 0.1e0) ELSE 0 END AS hiy
  FROM (SELECT scope, min(lon) AS lox, max(lon) AS hix, min(lat) AS loy, max(lat) AS hiy FROM {_PW} w GROUP BY 1) e) s ON s.scope = m.scope"""
_HEX2 = f"SELECT *, round_even(hx, 0) AS i1, round_even(hy, 0) AS j1, floor(hx) AS i2, floor(hy) AS j2 FROM ({_HEX}) h"
_D1, _D2 = "(hx - i1) * (hx - i1) + 3.0e0 * (hy - j1) * (hy - j1)", "(hx - i2 - 0.5e0) * (hx - i2 - 0.5e0) + 3.0e0 * (hy - j2 - 0.5e0) * (hy - j2 - 0.5e0)"


@query(with_views("p", f"SELECT scope, CASE WHEN {_D1} < {_D2} THEN 1 ELSE 2 END AS lattice, CAST(CASE WHEN {_D1} < {_D2} THEN i1 ELSE i2 END AS INT) AS i, CAST(CASE WHEN {_D1} < {_D2} THEN j1 ELSE j2 END AS INT) AS j, count(*) AS n FROM ({_HEX2}) k GROUP BY 1, 2, 3, 4"))
def hexbin(spark, d):
    return grids.hexagons(_pose_map(spark, d), S, "lon", "lat")


_HM = f"(SELECT scope, 2 * sqrt(2.0e0) * cos({_LAT}) * sin({_LON} / 2) / {_HZ} AS lon, sqrt(2.0e0) * sin({_LAT}) / {_HZ} AS lat FROM p)"
_HEX2_HM = _HEX2.replace(_PW, _HM)


@query(with_views("p", f"SELECT scope, CASE WHEN {_D1} < {_D2} THEN 1 ELSE 2 END AS lattice, CAST(CASE WHEN {_D1} < {_D2} THEN i1 ELSE i2 END AS INT) AS i, CAST(CASE WHEN {_D1} < {_D2} THEN j1 ELSE j2 END AS INT) AS j, count(*) AS n FROM ({_HEX2_HM}) k GROUP BY 1, 2, 3, 4"))
def hexbin_hammer(spark, d):
    """The same on the projected plane of the Hammer map."""
    x, y = angles.project(angles.wrap_angle(F.col("theta")), F.col("phi"), "hammer")
    return grids.hexagons(views.poses(spark, d).select("scope", x.alias("x"), y.alias("y")), S, "x", "y")


_BLUR_SIGMA = 2.0


def _gains(n: int, sigma: float) -> str:
    return f"(SELECT d, list_sum(list_transform(range(-{n // 2}, {n - n // 2}), lambda k: exp(-k * k / {2 * sigma * sigma}e0) * cos(2 * {PI} * k * d / {n}))) / {n} AS g FROM (SELECT unnest(range(0, {n})) AS d) r)"


@query(
    with_views(
        "p",
        f"SELECT CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, {r6('sum(value * g)')} AS value FROM (SELECT iy, (ix + d) % 360 AS ix, value, g FROM dn, {_gains(360, _BLUR_SIGMA)} k) a GROUP BY 1, 2",
        {"h": _hist_sql(f"{_PW} w", "lat", "lon", "sum(exp(-score / 10))"), "dn": f"SELECT (iy + d) % 180 AS iy, ix, sum(value * g) AS value FROM h, {_gains(180, _BLUR_SIGMA)} k GROUP BY 1, 2"},
    )
)
def density_blur(spark, d):
    """The density map of all poses together, blurred."""
    h = grids.histogram(_pose_map(spark, d), [], F.col("lat"), F.col("lon"), F.exp(-F.col("score") / 10))
    return out(grids.blur(h, [], _BLUR_SIGMA), "iy", "ix", value=F.col("value"))


_CL = "scope, cluster_id"
_KDE_SPAN = f"""SELECT {_CL}, min(lon) - greatest(0.3e0 * greatest(max(lon) - min(lon), 1e-6), 0.05e0) AS lox, max(lon) + greatest(0.3e0 * greatest(max(lon) - min(lon), 1e-6), 0.05e0) AS hix,
  min(lat) - greatest(0.3e0 * greatest(max(lat) - min(lat), 1e-6), 0.05e0) AS loy, max(lat) + greatest(0.3e0 * greatest(max(lat) - min(lat), 1e-6), 0.05e0) AS hiy FROM m GROUP BY 1, 2"""
_KDE = f"SELECT {_CL}, least(89, {_bin_sql('lat', 'loy', 'hiy', 90)}) AS iy, least(89, {_bin_sql('lon', 'lox', 'hix', 90)}) AS ix, CAST(count(*) AS DOUBLE) AS value FROM m JOIN sp USING (scope, cluster_id) GROUP BY ALL"
_KDE_VIEWS = {"m": f"SELECT scope, cluster_id, {_WRAP} AS lon, {_HALF} - phi AS lat FROM p", "sp": _KDE_SPAN, "h": _KDE}


def _kde(spark: SparkSession, d: str) -> DataFrame:
    m = views.poses(spark, d).select("scope", "cluster_id", angles.wrap_angle(F.col("theta")).alias("lon"), (math.pi / 2 - F.col("phi")).alias("lat"))
    return grids.padded_histogram(m, ["scope", "cluster_id"], "lon", "lat")


@query(with_views("p", "SELECT * FROM h", _KDE_VIEWS))
def cluster_kde_hist(spark, d):
    return _kde(spark, d)


_LEVELS = {
    **_KDE_VIEWS,
    "gn": f"SELECT * FROM {_gains(90, 2.6)} k",
    "dw": f"SELECT {_CL}, (iy + d) % 90 AS iy, ix, sum(value * g) AS value FROM h, gn GROUP BY ALL",
    "bl": f"SELECT {_CL}, iy, (ix + d) % 90 AS ix, sum(value * g) AS value FROM dw, gn GROUP BY ALL",
    "pk": f"SELECT {_CL}, max(value) AS peak FROM bl GROUP BY ALL",
}


@query(with_views("p", f"SELECT {_CL}, {r6('peak')} AS peak, {r6('greatest(0.25e0 * peak, 1e-9)')} AS level FROM pk WHERE peak > 0", _LEVELS))
def cluster_kde_level(spark, d):
    """Peak and contour level of every cluster's blurred histogram."""
    return out(grids.blurred_levels(_kde(spark, d), ["scope", "cluster_id"], 2.6, 90), "scope", "cluster_id", peak=F.col("peak"), level=F.col("level"))


# --- surface -------------------------------------------------------------------------------------------


def _field(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = views.atoms(spark, d)
    return surface.density_field(a, SPACING, RADIUS_SCALE, "max"), surface.grid_of(a, SPACING, RADIUS_SCALE)


_RAD = "(CASE element " + " ".join(f"WHEN '{e}' THEN {m}e0" for e, m in chem.RADIUS.items()) + f" ELSE {chem.OTHER_RADIUS}e0 END * {RADIUS_SCALE}e0)"
_GRID = "SELECT scope, " + ", ".join(f"min({c}) - pad AS g{c}0, CAST(ceil((max({c}) + pad - (min({c}) - pad)) / {SPACING}e0) + 1 AS BIGINT) AS n{c}" for c in "xyz") + f" FROM (SELECT *, max({_RAD}) OVER (PARTITION BY scope) + 3 * {SPACING}e0 AS pad FROM a) q GROUP BY scope, pad"
_REACH = "3.0e0 * sigma"


def _splat(c: str, n: str) -> str:
    return f"unnest(range(CAST(greatest(floor((({c} - g{c}0) - {_REACH}) / {SPACING}e0), 0) AS BIGINT), CAST(least(ceil((({c} - g{c}0) + {_REACH}) / {SPACING}e0), {n} - 1) AS BIGINT) + 1)) AS i{c}"


_FIELD_VIEWS = {
    "gr": _GRID,
    "s0": f"SELECT a.scope, x, y, z, {_RAD} / 2.5e0 AS sigma, gr.* EXCLUDE (scope) FROM a JOIN gr ON gr.scope = a.scope",
    "s1": f"SELECT *, {_splat('x', 'nx')} FROM s0",
    "s2": f"SELECT *, {_splat('y', 'ny')} FROM s1",
    "s3": f"SELECT *, {_splat('z', 'nz')} FROM s2",
    "fd": "SELECT scope, ix, iy, iz, sum(" + " * ".join(f"exp(-0.5e0 * ((g{c}0 + i{c} * {SPACING}e0 - {c}) / sigma) * ((g{c}0 + i{c} * {SPACING}e0 - {c}) / sigma))" for c in "xyz") + ") AS rho FROM s3 GROUP BY 1, 2, 3, 4",
}


@query(with_views("a", f"SELECT scope, ix, iy, iz, {r6('rho')} AS rho FROM fd", _FIELD_VIEWS))
def density_field(spark, d):
    return out(_field(spark, d)[0], "scope", "ix", "iy", "iz", rho=F.col("rho"))


_TETS = "(VALUES " + ", ".join(f"({t}, {e}, {surface.TETRAHEDRA[t][a]}, {surface.TETRAHEDRA[t][b]})" for t in range(6) for e, (a, b) in enumerate(surface.TET_EDGES)) + ") te(tet, e, c0, c1)"
_CORN = "(VALUES " + ", ".join(f"({k}, {x}, {y}, {z})" for k, (x, y, z) in enumerate(surface.CORNERS)) + ") co(k, dx, dy, dz)"
_T = "CASE WHEN abs(v1 - v0) < 1e-12 THEN 0.5e0 ELSE (%s - v0) / (v1 - v0) END" % f"{ISO}e0"
_ISO_VIEWS = {
    **_FIELD_VIEWS,
    "co": f"SELECT * FROM {_CORN}",
    "cb": f"SELECT q.*, gr.* EXCLUDE (scope) FROM (SELECT scope, ix - dx AS ix, iy - dy AS iy, iz - dz AS iz, list_transform(range(0, 8), lambda j: coalesce(list_extract(list(rho ORDER BY k), CAST(list_position(list(k ORDER BY k), j) AS BIGINT)), 0.0e0)) AS v FROM fd, co GROUP BY ALL) q JOIN gr ON gr.scope = q.scope WHERE ix >= 0 AND iy >= 0 AND iz >= 0 AND ix < nx - 1 AND iy < ny - 1 AND iz < nz - 1 AND list_max(v) >= {ISO}e0 AND list_min(v) <= {ISO}e0",
    "ed": f"SELECT scope, ix, iy, iz, gx0, gy0, gz0, tet, e, v[c0 + 1] AS v0, v[c1 + 1] AS v1, p.dx AS ax, p.dy AS ay, p.dz AS az, r.dx AS bx, r.dy AS by, r.dz AS bz FROM cb, {_TETS} JOIN co p ON p.k = te.c0 JOIN co r ON r.k = te.c1 WHERE (v[c0 + 1] >= {ISO}e0) <> (v[c1 + 1] >= {ISO}e0)",
    "pt": "SELECT scope, ix, iy, iz, tet, row_number() OVER (PARTITION BY scope, ix, iy, iz, tet ORDER BY e) AS k, count(*) OVER (PARTITION BY scope, ix, iy, iz, tet) AS n, " + ", ".join(f"g{c}0 + {SPACING}e0 * (i{c} + a{c}) + {_T} * ({SPACING}e0 * (b{c} - a{c})) AS q{c}" for c in "xyz") + " FROM ed",
    "tr": "SELECT scope, ix, iy, iz, tet, tri, " + ", ".join(f"max(CASE WHEN k = CASE tri WHEN 0 THEN {i} ELSE {j} END THEN q{c} END) AS {n}{c}" for n, i, j in (("a", 1, 1), ("b", 2, 3), ("c", 3, 4)) for c in "xyz") + " FROM pt, (VALUES (0), (1)) w(tri) WHERE n >= 3 AND (tri = 0 OR n = 4) GROUP BY 1, 2, 3, 4, 5, 6",
}


@query(with_views("a", "SELECT scope, ix, iy, iz, tet, tri, " + ", ".join(f"{r6(f'{n}{c}')} AS {n}{c}" for n in "abc" for c in "xyz") + " FROM tr", _ISO_VIEWS))
def iso_triangles(spark, d):
    t = surface.block_triangles(views.atoms(spark, d), SPACING, RADIUS_SCALE, "max", ISO)
    return out(t, "scope", "ix", "iy", "iz", "tet", "tri", **{f"{n}{c}": F.col(f"{n}{c}") for n in "abc" for c in "xyz"})


_TRI_VIEWS = {
    **_FIELD_VIEWS,
    "u0": "SELECT v.scope, vid, " + ", ".join(f"greatest(0.0e0, least(CAST(n{c} - 2 AS DOUBLE), ({c} - g{c}0) / {SPACING}e0)) AS u{c}" for c in "xyz") + " FROM v JOIN gr ON gr.scope = v.scope",
    "u1": "SELECT scope, vid, " + ", ".join(f"CAST(floor(u{c}) AS BIGINT) + o{c}.o AS i{c}" for c in "xyz") + ", " + " * ".join(f"CASE o{c}.o WHEN 0 THEN 1 - (u{c} - floor(u{c})) ELSE u{c} - floor(u{c}) END" for c in "xyz") + " AS w FROM u0, (VALUES (0), (1)) ox(o), (VALUES (0), (1)) oy(o), (VALUES (0), (1)) oz(o)",
}


@query(with_views("av", f"SELECT u1.scope, vid, {r6('sum(w * coalesce(rho, 0.0e0))')} AS value FROM u1 LEFT JOIN fd ON fd.scope = u1.scope AND fd.ix = u1.ix AND fd.iy = u1.iy AND fd.iz = u1.iz GROUP BY 1, 2", _TRI_VIEWS))
def trilinear(spark, d):
    field, grid = _field(spark, d)
    points = views.vertices(spark, d).select("scope", F.col("vid").alias("pid"), *(F.col(c).alias(f"p{c}") for c in "xyz"))
    t = surface.trilinear(points, field, grid, SPACING).withColumnRenamed("pid", "vid")
    return out(t, "scope", "vid", value=F.col("value"))


_NB = "SELECT DISTINCT scope, vid, other FROM (" + " UNION ALL ".join(f"SELECT scope, {p} AS vid, {q} AS other FROM f" for p in "abc" for q in "abc" if p != q) + ") n"
_LAP = "SELECT v.scope, v.vid, coalesce(sqrt((mx - v.x) * (mx - v.x) + (my - v.y) * (my - v.y) + (mz - v.z) * (mz - v.z)), 0.0e0) AS curvature FROM v LEFT JOIN (SELECT nb.scope, nb.vid, avg(w.x) AS mx, avg(w.y) AS my, avg(w.z) AS mz FROM nb JOIN v w ON w.scope = nb.scope AND w.vid = nb.other GROUP BY 1, 2) m ON m.scope = v.scope AND m.vid = v.vid"


@query(with_views("vf", f"SELECT scope, vid, {r6('curvature')} AS curvature FROM lp", {"nb": _NB, "lp": _LAP}))
def curv_proxy(spark, d):
    return out(mesh.laplacian(views.vertices(spark, d), views.strip_faces(spark, d)), "scope", "vid", curvature=F.col("curvature"))


def _round_sql(source: str) -> str:
    return f"SELECT s.scope, s.vid, coalesce(m.value, s.value) AS value FROM {source} s LEFT JOIN (SELECT nb.scope, nb.vid, avg(o.value) AS value FROM nb JOIN {source} o ON o.scope = nb.scope AND o.vid = nb.other GROUP BY 1, 2) m ON m.scope = s.scope AND m.vid = s.vid"


@query(with_views("vf", f"SELECT scope, vid, {r6('value')} AS value FROM r2", {"nb": _NB, "r0": "SELECT scope, vid, z AS value FROM v", "r1": _round_sql("r0"), "r2": _round_sql("r1")}))
def smooth_scalar(spark, d):
    v = views.vertices(spark, d).select("scope", "vid", F.col("z").alias("value"))
    return out(mesh.smooth(v, views.strip_faces(spark, d), 2), "scope", "vid", value=F.col("value"))


_SUMMED = {
    **_SITES,
    "st": """SELECT scope, label, count(*) AS n_poses, count(score) AS n, arg_min(pose_id, (score, pose_idx)) FILTER (WHERE score IS NOT NULL) AS best_pose_id, min(score) AS lo_score, max(score) AS hi_score, avg(score) AS mean, stddev_pop(score) AS sd, var_samp(score) AS var,
  avg(ux) AS mx, avg(uy) AS my, avg(uz) AS mz FROM lb GROUP BY 1, 2""",
    "rk": "SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n_poses DESC, lo_score NULLS LAST, label) AS rank FROM st",
    **_test_views("rk"),
}


@query(
    with_views(
        "",
        f"""SELECT rk.scope, CAST(rk.rank AS INT) AS cluster_id, n_poses, best_pose_id, lo_score AS best_vina_score, lo_score AS vina_score_min, hi_score AS vina_score_max, {r6('mean')} AS vina_score_avg, {r6('sd')} AS vina_score_stddev,
  {r6('p_value')} AS p_value, {r6('atan2(my, mx)')} AS theta_centroid, {r6(f'acos(greatest(-1.0e0, least(1.0e0, mz / {_NORM})))')} AS phi_centroid FROM rk JOIN pv ON pv.scope = rk.scope AND pv.rank = rk.rank""",
        _SUMMED,
        recursive=True,
    )
)
def site_summary(spark, d):
    """The flagship: which sites do a run's poses form, and how good are they? Means and angles to six decimals."""
    p = layers.labelled(views.located(spark, d), math.radians(15.0))
    s = clusters.summary(p, S, "raw_label")
    shown = {c: F.col(c) for c in ("vina_score_avg", "vina_score_stddev", "p_value", "theta_centroid", "phi_centroid")}
    return out(s, "scope", "cluster_id", "n_poses", "best_pose_id", "best_vina_score", "vina_score_min", "vina_score_max", **shown)
