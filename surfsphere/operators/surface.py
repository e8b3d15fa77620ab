"""Density fields on sparse grids, iso-surfaces by tetrahedra, trilinear samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chem import radius
from .runs import in_runs

#: Reach of an atom's density in standard deviations, by quality; any other word counts as low.
REACH = {"max": 3.0, "med": 2.5, "low": 2.0}
# Corners of a cube, its tetrahedra and their edges, in the order that numbers the triangles.
# The table is kept as given: its last tetrahedron is flat, so surfaces have the seams that are expected of it.
CORNERS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
TETRAHEDRA = ((0, 1, 3, 4), (1, 2, 3, 6), (1, 3, 4, 6), (3, 4, 6, 7), (1, 4, 5, 6), (4, 6, 7, 5))
TET_EDGES = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))


def grid_of(atoms: DataFrame, spacing: float, radius_scale: float) -> DataFrame:
    """scope, origin (gx0, gy0, gz0) and size (nx, ny, nz) of each scope's grid: one row a scope."""
    pad = F.max(radius(F.col("element")) * radius_scale) + 3.0 * spacing
    out = atoms.groupBy("scope").agg(pad.alias("pad"), *(f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))))
    size = {f"n{c}": (F.ceil((F.col(f"hi{c}") + F.col("pad") - (F.col(f"lo{c}") - F.col("pad"))) / spacing) + 1).cast("bigint") for c in "xyz"}
    return out.withColumns(size).select("scope", *((F.col(f"lo{c}") - F.col("pad")).alias(f"g{c}0") for c in "xyz"), "nx", "ny", "nz")


def density_field(atoms: DataFrame, spacing: float = 1.0, radius_scale: float = 1.4, quality: str = "max") -> DataFrame:
    """scope, ix, iy, iz, rho: sum of the atoms' Gaussians at the grid points in their boxes; others have no row (0).

    ``atoms``: scope, x, y, z, element. An atom's cells are made from bounded sequences, never filtered
    from the whole grid, and sums are combined on the map side. Sums are in double precision.
    """
    grid = grid_of(atoms, spacing, radius_scale)
    sigma = radius(F.col("element")) * radius_scale / 2.5
    a = atoms.withColumn("sigma", sigma).where("sigma > 1e-6").join(grid, "scope")
    reach = REACH.get(quality, REACH["low"]) * F.col("sigma")
    for c in "xyz":
        at, n = F.col(c) - F.col(f"g{c}0"), F.col(f"n{c}")
        lo = F.greatest(F.floor((at - reach) / spacing), F.lit(0).cast("bigint"))
        hi = F.least(F.ceil((at + reach) / spacing), n - 1)
        a = a.withColumn(f"s{c}", F.sequence(lo, hi))
    a = a.select("scope", "x", "y", "z", "sigma", "gx0", "gy0", "gz0", F.explode("sx").alias("ix"), "sy", "sz")
    a = a.withColumn("w", _gauss("x", spacing)).select("scope", "y", "z", "sigma", "gy0", "gz0", "w", "ix", F.explode("sy").alias("iy"), "sz")
    a = a.withColumn("w", F.col("w") * _gauss("y", spacing)).select("scope", "z", "sigma", "gz0", "w", "ix", "iy", F.explode("sz").alias("iz"))
    return a.withColumn("w", F.col("w") * _gauss("z", spacing)).groupBy("scope", "ix", "iy", "iz").agg(F.sum("w").alias("rho"))


def _gauss(c: str, spacing: float) -> Column:
    d = (F.col(f"g{c}0") + F.col(f"i{c}") * spacing - F.col(c)) / F.col("sigma")
    return F.exp(-0.5 * d * d)


def iso_cubes(field: DataFrame, grid: DataFrame, iso: float) -> DataFrame:
    """scope, ix, iy, iz, v (8 corner values) of the cubes that the iso-surface may cross.

    Every grid point is sent to the cubes that it's a corner of: one shuffle instead of seven joins. For
    iso > 0 a cube without any stored corner can't be crossed.
    """
    if iso <= 0:
        raise ValueError("the iso value must be above zero")
    corner = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(o).alias(a) for o, a in zip(c, "xyz"))) for k, c in enumerate(CORNERS))))
    spread = field.withColumn("c", corner).select("scope", "rho", F.col("c.k").alias("k"), *((F.col(f"i{a}") - F.col(f"c.{a}")).alias(f"i{a}") for a in "xyz"))
    spread = spread.where("ix >= 0 AND iy >= 0 AND iz >= 0")
    v = [F.coalesce(F.max(F.when(F.col("k") == k, F.col("rho"))), F.lit(0.0)) for k in range(8)]
    cubes = spread.groupBy("scope", "ix", "iy", "iz").agg(F.array(*v).alias("v")).where((F.array_max("v") >= iso) & (F.array_min("v") <= iso))
    return cubes.join(grid, "scope").where("ix < nx - 1 AND iy < ny - 1 AND iz < nz - 1")


def iso_triangles(field: DataFrame, grid: DataFrame, spacing: float, iso: float = 1.0) -> DataFrame:
    """scope, ix, iy, iz, tet, tri and corners ax .. cz of the iso-surface's triangles.

    A tetrahedron's crossed edges give three or four points in edge order; four give two triangles, the
    first three points, and the first, third and fourth.
    """
    cubes = iso_cubes(field, grid, iso)
    tets = F.array(*(F.array(*(F.lit(c) for c in t)) for t in TETRAHEDRA))
    at = F.array(*(F.struct(*(F.lit(float(o)).alias(a) for o, a in zip(c, "xyz"))) for c in CORNERS))
    edges = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in TET_EDGES))
    one = cubes.select("*", F.posexplode(tets).alias("tet", "ids"), at.alias("corners"), edges.alias("edges"))

    def value(i: Column) -> Column:
        return F.get("v", F.get("ids", i))

    def crossing(e: Column) -> Column:
        v0, v1 = value(e["a"]), value(e["b"])
        p, q = F.get("corners", F.get("ids", e["a"])), F.get("corners", F.get("ids", e["b"]))
        t = F.when(F.abs(v1 - v0) < 1e-12, F.lit(0.5)).otherwise(F.try_divide(F.lit(iso) - v0, v1 - v0))
        place = [F.col(f"g{a}0") + spacing * (F.col(f"i{a}") + p[a]) + t * (spacing * (q[a] - p[a])) for a in "xyz"]
        return F.struct(*(c.alias(a) for c, a in zip(place, "xyz")))

    crossed = F.filter("edges", lambda e: (value(e["a"]) >= iso) != (value(e["b"]) >= iso))
    one = one.withColumn("pts", F.transform(crossed, crossing)).where("size(pts) >= 3")
    first = F.array(*(F.get("pts", F.lit(i)) for i in (0, 1, 2)))
    second = F.array(*(F.get("pts", F.lit(i)) for i in (0, 2, 3)))
    both = F.when(F.size("pts") == 4, F.array(first, second)).otherwise(F.array(first))
    tri = one.select("scope", "ix", "iy", "iz", "tet", F.posexplode(both).alias("tri", "p"))
    return tri.select("scope", "ix", "iy", "iz", "tet", "tri", *(F.get("p", F.lit(i))[a].alias(f"{c}{a}") for i, c in enumerate("abc") for a in "xyz"))


def trilinear(points: DataFrame, field: DataFrame, grid: DataFrame, spacing: float) -> DataFrame:
    """scope, pid, value: the field at each point (scope, pid, px, py, pz), clipped to the grid's last whole cell."""
    g = points.join(grid, "scope")
    for a in "xyz":
        u = F.greatest(F.lit(0.0), F.least((F.col(f"n{a}") - 2).cast("double"), (F.col(f"p{a}") - F.col(f"g{a}0")) / spacing))
        g = g.withColumn(f"u{a}", u).withColumns({f"f{a}": F.floor(f"u{a}")}).withColumn(f"r{a}", F.col(f"u{a}") - F.col(f"f{a}"))
    ends = [F.array(F.struct(F.lit(0).alias("o"), (1 - F.col(f"r{a}")).alias("w")), F.struct(F.lit(1).alias("o"), F.col(f"r{a}").alias("w"))) for a in "xyz"]
    for a, e in zip("xyz", ends):
        g = g.withColumn(f"e{a}", F.explode(e))
    near = g.select("scope", "pid", *((F.col(f"f{a}") + F.col(f"e{a}.o")).alias(f"i{a}") for a in "xyz"), (F.col("ex.w") * F.col("ey.w") * F.col("ez.w")).alias("w"))
    met = near.join(field, ["scope", "ix", "iy", "iz"], "left")
    return met.groupBy("scope", "pid").agg(F.sum(F.col("w") * F.coalesce("rho", F.lit(0.0))).alias("value"))


#: Cubes along the edge of a block of the dense path.
BLOCK = 24


def _blocks_kernel(spacing: float, reach: float, iso: float):
    """Density and iso-surface of one block as dense arrays; a block has its cubes' corners, one more a side."""
    corner = np.array(CORNERS)

    def run(rows: pa.Table) -> pa.Table:
        g = rows.to_pandas()
        head = g.iloc[0]
        base = [int(head[f"b{a}"]) * BLOCK for a in "xyz"]
        size = [min(BLOCK, int(head[f"n{a}"]) - 1 - b) + 1 for a, b in zip("xyz", base)]
        axes, sigma = [], g["sigma"].to_numpy()
        for a, b, n in zip("xyz", base, size):
            x, o = g[a].to_numpy(), float(head[f"g{a}0"])
            at = o + (b + np.arange(n)) * spacing
            w = np.exp(-0.5 * ((at[None, :] - x[:, None]) / sigma[:, None]) ** 2)
            i = b + np.arange(n)[None, :]
            lo, hi = np.floor((x - o - reach * sigma) / spacing), np.ceil((x - o + reach * sigma) / spacing)
            axes.append(np.where((i >= lo[:, None]) & (i <= hi[:, None]), w, 0.0))  # an atom's box, as in the sparse path
        flat = (axes[1][:, :, None] * axes[2][:, None, :]).reshape(len(g), -1)
        rho = ((axes[0] * g["times"].to_numpy()[:, None]).T @ flat).reshape(size)
        v = np.stack([rho[tuple(slice(o, o + n - 1) for o, n in zip(c, size))] for c in CORNERS], -1)
        hit = np.argwhere((v.max(-1) >= iso) & (v.min(-1) <= iso))
        vals = v[tuple(hit.T)]
        rows = []
        for tet, ids in enumerate(TETRAHEDRA):
            tv = vals[:, ids]
            inside = tv >= iso
            n_in = inside.sum(1)
            for many in (3, 4):  # crossed edges
                sel = np.flatnonzero((n_in == 2) if many == 4 else (n_in == 1) | (n_in == 3))
                if not len(sel):
                    continue
                cross = np.stack([inside[sel, a] != inside[sel, b] for a, b in TET_EDGES], 1)
                edge = np.argsort(~cross, axis=1, kind="stable")[:, :many]
                a, b = np.array(TET_EDGES)[edge, 0], np.array(TET_EDGES)[edge, 1]
                row = sel[:, None]
                v0, v1 = tv[row, a], tv[row, b]
                flat_edge = np.abs(v1 - v0) < 1e-12
                t = np.where(flat_edge, 0.5, (iso - v0) / np.where(flat_edge, 1.0, v1 - v0))
                c0, c1 = corner[np.array(ids)[a]], corner[np.array(ids)[b]]
                origin = np.array([float(head[f"g{x}0"]) for x in "xyz"])
                at = hit[sel] + np.array(base)
                p = origin + spacing * (at[:, None, :] + c0) + t[..., None] * (spacing * (c1 - c0))
                for tri, pick in enumerate(((0, 1, 2), (0, 2, 3))[: many - 2]):
                    rows.append(np.concatenate([at, np.full((len(sel), 1), tet), np.full((len(sel), 1), tri), p[:, pick].reshape(len(sel), 9)], 1))
        names = ["ix", "iy", "iz", "tet", "tri", *(f"{c}{x}" for c in "abc" for x in "xyz")]
        out = pd.DataFrame(np.concatenate(rows) if rows else np.zeros((0, 14)), columns=names)
        out = out.astype({"ix": "int64", "iy": "int64", "iz": "int64", "tet": "int32", "tri": "int32"})
        out.insert(0, "scope", head["scope"])
        return pa.Table.from_pandas(out, schema=pa.schema([("scope", pa.string()), *((n, pa.int64()) for n in names[:3]), ("tet", pa.int32()), ("tri", pa.int32()), *((n, pa.float64()) for n in names[5:])]), preserve_index=False)

    return run


def block_triangles(atoms: DataFrame, spacing: float = 1.0, radius_scale: float = 1.4, quality: str = "max", iso: float = 1.0) -> DataFrame:
    """The triangles of ``iso_triangles(density_field(...))``, made block by block as dense arrays.

    For fine grids, on which an atom reaches tens of thousands of grid points: atoms are sent to the blocks
    they reach, and neither grid points nor cubes are ever shuffled. A block holds BLOCK^3 cubes and, since
    atoms at one place and of one radius are counted first, no more atoms than there are places.
    """
    if iso <= 0:
        raise ValueError("the iso value must be above zero")
    grid = grid_of(atoms, spacing, radius_scale)
    reach = REACH.get(quality, REACH["low"])
    sigma = radius(F.col("element")) * radius_scale / 2.5
    a = atoms.withColumn("sigma", sigma).where("sigma > 1e-6").groupBy("scope", "x", "y", "z", "sigma").agg(F.count(F.lit(1)).alias("times")).join(grid, "scope")
    for c in "xyz":
        at, n = F.col(c) - F.col(f"g{c}0"), F.col(f"n{c}")
        lo = F.greatest(F.floor((at - reach * F.col("sigma")) / spacing), F.lit(0).cast("bigint"))
        hi = F.least(F.ceil((at + reach * F.col("sigma")) / spacing), n - 1)
        # Grid point i is a corner of cubes i - 1 and i.
        first, last = F.floor(F.greatest(lo - 1, F.lit(0)) / BLOCK), F.floor(F.least(hi, n - 2) / BLOCK)
        a = a.withColumn(f"b{c}", F.explode(F.sequence(first, last)))
    schema = "scope string, ix bigint, iy bigint, iz bigint, tet int, tri int, " + ", ".join(f"{c}{x} double" for c in "abc" for x in "xyz")
    return in_runs(a.drop("element"), ["scope", "bx", "by", "bz"], _blocks_kernel(spacing, reach, iso), schema)
