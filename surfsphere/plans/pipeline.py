"""The whole map of one structure: from files to clusters, footprints, backgrounds and result tables."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import angles
from ..functions.chem import ligand_label
from ..operators import clusters, grids, mesh, nearest, residues, surface
from ..operators.prefix import running_sum
from ..session import durable
from ..sources import pdb, writers
from . import layers

log = logging.getLogger(__name__)
#: Filled bands and intervals between the lines of the background.
BANDS, LINES = 40, 12


@dataclass(frozen=True)
class MapOptions:
    """Everything that can be asked for; names and defaults follow the command line."""

    protein: str
    peptides: str
    scores: str
    ppi_file: str
    radius_scale: float = 1.4
    density_isovalue: float = 1.0
    grid_spacing: float = 1.0
    surface_quality: str = "max"
    cache_surface: str | None = None
    ppi_footprint: tuple[str, ...] = ("atom_contour",)
    ppi_residue_point: str = "sc_com"
    ppi_atom_filter: str = "near_surface"
    ppi_near_surface_eps: float = 1.5
    map: str = "mollweide"
    pose_projection: str = "nearest"
    metric: str = "vertex"
    peptide_center: str = "com"
    seam_rotate: str = "auto"
    cluster_distance: float = 15.0
    pose_layer: tuple[str, ...] = ("density",)
    trace_pose: str = "best"
    weight: str = "exp"
    cluster_contour: str = "none"
    cluster_contour_color: str | None = None
    pose_density_sigma: float = 2.0
    background: str = "none"
    background_smooth: int = 0
    background_colorbar: bool = False
    background_colorbar_location: str = "right"
    background_colorbar_mode: str = "norm"
    background_colorbar_label: str | None = None
    background_colorbar_vmin: float | None = None
    background_colorbar_vmax: float | None = None
    pose_label: str = "none"
    pose_label_top: int = 5
    mesh_vertex_scalar: str = "none"
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        choices = {
            "surface_quality": ("max", "med", "low"), "ppi_residue_point": ("ca", "res_com", "sc_com"), "map": angles.MAPS, "pose_projection": ("nearest", "raycast"), "metric": ("vertex", "triangle"), "peptide_center": ("com", "cog"),
            "weight": ("none", "exp", "linear"), "background": ("none", "curvature", "radial"), "pose_label": ("none", "first", "best", "topN"), "cluster_contour": ("none", "outline", "filled"), "mesh_vertex_scalar": ("none", "density", "curv_proxy"),
            "background_colorbar_mode": ("norm", "raw"), "background_colorbar_location": ("right", "bottom"),
        }
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if self.ppi_atom_filter == "sasa":
            raise NotImplementedError("The sasa filter is not implemented.")
        if self.ppi_atom_filter not in ("all_heavy", "near_surface"):
            raise ValueError(f"Unknown atom filter: {self.ppi_atom_filter}")
        if self.cluster_distance <= 0 or self.pose_density_sigma <= 0:
            raise ValueError("cluster_distance and pose_density_sigma must be above 0")
        if self.seam_rotate != "auto":
            float(self.seam_rotate)


class MissingResidues(ValueError):
    """Interface residues that the structure doesn't have; ``report`` tells which."""

    def __init__(self, report: dict):
        lost = sorted(set(report.get("interface_chains") or ()) - set(report.get("chains") or ()))
        chains = f"; chains that the structure doesn't have: {', '.join(lost)}" if lost else ""
        super().__init__(f"{report['missing_count']} interface residues are missing, first: {', '.join(report['missing_examples'])}{chains}")
        self.report = report | {"missing_chains": lost}


class SurfaceMap:
    """Lazily made tables of one map. Every table is a DataFrame; the surface is made once and reused."""

    def __init__(self, spark: SparkSession, options: MapOptions):
        self.spark, self.o = spark, options

    # -- scans and checks

    @cached_property
    def atoms(self) -> DataFrame:
        return pdb.load_structure(self.spark, self.o.protein).withColumn("scope", F.lit("map")).cache()

    @cached_property
    def _poses(self) -> tuple[DataFrame, DataFrame]:
        atoms, scores = pdb.load_poses(self.spark, self.o.peptides, self.o.scores)
        return atoms.withColumn("scope", F.lit("map")).cache(), scores.cache()

    @cached_property
    def interface(self) -> DataFrame:
        return pdb.load_interface(self.spark, self.o.ppi_file).withColumn("scope", F.lit("map")).cache()

    def validate(self) -> dict:
        """The interface report; raises MissingResidues before anything costly if it isn't clean."""
        rows = residues.validation(self.interface, self.atoms, ["scope"], 25).drop("scope").collect()  # one row
        report = rows[0].asDict() if rows else {"interface_total": 0, "missing_count": 0, "missing_examples": []}
        if report["missing_count"]:
            raise MissingResidues(report)
        return report

    @cached_property
    def centre(self) -> DataFrame:
        """scope, ox, oy, oz: one row."""
        return residues.centre_of_geometry(self.atoms, ["scope"]).select("scope", *(F.col(f"c{a}").alias(f"o{a}") for a in "xyz"))

    # -- surface

    @cached_property
    def grid(self) -> DataFrame:
        return surface.grid_of(self.atoms, self.o.grid_spacing, self.o.radius_scale)

    @cached_property
    def density(self) -> DataFrame:
        return surface.density_field(self.atoms, self.o.grid_spacing, self.o.radius_scale, self.o.surface_quality)

    @cached_property
    def triangles(self) -> DataFrame:
        """scope, tid, ax .. cz; numbered in the order of cubes, tetrahedra and triangles where order matters."""

        def build() -> DataFrame:
            tri = surface.block_triangles(self.atoms, self.o.grid_spacing, self.o.radius_scale, self.o.surface_quality, self.o.density_isovalue)
            # Dense enough and in scan order without a global sort: cube, tetrahedron and triangle in one number.
            tid = ((F.col("ix") * (1 << 17) + F.col("iy")) * (1 << 17) + F.col("iz")) * 12 + F.col("tet") * 2 + F.col("tri")
            return tri.withColumn("tid", tid).drop("ix", "iy", "iz", "tet", "tri")

        o = self.o
        if not o.cache_surface:
            return durable(build())
        digest = self.atoms.agg(F.sum(F.xxhash64("atom_idx", "element", "x", "y", "z").cast("decimal(38,0)"))).first()[0]
        return writers.cached_triangles(
            self.spark, o.cache_surface, build, atoms=digest, radius_scale=o.radius_scale, isovalue=o.density_isovalue, spacing=o.grid_spacing, quality=o.surface_quality
        )

    @cached_property
    def corners(self) -> DataFrame:
        """scope, tid, k, x, y, z and the curvature proxy: the triangles' corners, which are never shared."""
        parts = [
            F.struct(F.lit(k).alias("k"), *(F.col(f"{p}{x}").alias(f"{q}{x}") for p, q in zip(turn, "abc") for x in "xyz")) for k, turn in enumerate(("abc", "bca", "cab"))
        ]
        one = self.triangles.select("scope", "tid", F.explode(F.array(*parts)).alias("p")).select("scope", "tid", "p.*")
        return one.select("scope", "tid", "k", *(F.col(f"a{x}").alias(x) for x in "xyz"), mesh.soup_curvature().alias("curvature"))

    # -- points on the surface: all of them meet it in one join

    @cached_property
    def _points(self) -> DataFrame:
        """scope, kind, pid, px, py, pz of everything to be projected."""
        pose_atoms, _ = self._poses
        middle = residues.centre_of_mass if self.o.peptide_center == "com" else residues.centre_of_geometry
        at = [F.col(f"c{a}").alias(f"p{a}") for a in "xyz"]
        out = middle(pose_atoms, ["scope", "pose_idx"]).select("scope", F.concat(F.lit("pose:"), "pose_idx").alias("pid"), *at)
        own = residues.interface_atoms(self.interface, self.atoms, ["scope"])
        if "atom_contour" in self.o.ppi_footprint:
            heavy = own.where("element <> 'H'").select("scope", F.concat(F.lit("atom:"), "atom_idx").alias("pid"), *(F.col(a).alias(f"p{a}") for a in "xyz"))
            out = out.unionByName(heavy)
        if "residue_points" in self.o.ppi_footprint:
            r = residues.residue_points(own, ["scope"], self.o.ppi_residue_point)
            out = out.unionByName(r.select("scope", F.concat_ws(":", F.lit("residue"), "label", "chain", F.col("resseq").cast("string")).alias("pid"), "px", "py", "pz"))
        if "trace" in self.o.pose_layer:
            chosen = self.traced.select("pose_idx", "trace_rank")
            ca = pose_atoms.where(F.upper(F.trim("name")) == "CA").join(F.broadcast(chosen), "pose_idx")  # the chosen few poses
            out = out.unionByName(ca.select("scope", F.concat_ws(":", F.lit("trace"), "trace_rank", "atom_idx").alias("pid"), *(F.col(a).alias(f"p{a}") for a in "xyz")))
        return durable(out.join(self.centre, "scope"))

    @cached_property
    def traced(self) -> DataFrame:
        return clusters.trace_poses(self._poses[1].withColumn("scope", F.lit("map")), ["scope"], self.o.trace_pose)

    @cached_property
    def projected(self) -> DataFrame:
        """kind, id, distance, theta, phi of all points, not yet rotated.

        Poses go to the surface's closest corner, or with the triangle metric to its closest point, as all other points do.
        """
        pts, pose = self._points, F.col("pid").startswith("pose:")
        poses, rest = pts.where(pose), pts.where(~pose)
        hits = None
        if self.o.pose_projection == "raycast":
            hits = durable(nearest.first_hits(poses, self.triangles))
            poses = poses.join(hits.select("scope", "pid"), ["scope", "pid"], "left_anti")
        if self.o.metric == "triangle":
            hit = nearest.nearest(poses.unionByName(rest), self.triangles)
        else:
            corner = self.corners.select("scope", (F.col("tid") * 4 + F.col("k")).alias("tid"), *(F.col(a).alias(f"a{a}") for a in "xyz"))
            hit = nearest.nearest(poses, corner, nearest.VERTEX).unionByName(nearest.nearest(rest, self.triangles))
        hit = hit if hits is None else hits.unionByName(hit)
        theta, phi = angles.spherical(*(F.col(f"q{a}") - F.col(f"o{a}") for a in "xyz"))
        kind = F.substring_index("pid", ":", 1)
        out = hit.join(self.centre, "scope").withColumns({"theta": theta, "phi": phi, "kind": kind})
        return durable(out.select("kind", F.expr("substring(pid, length(kind) + 2)").alias("id"), "distance", "theta", "phi"))

    @cached_property
    def rotation(self) -> float:
        """Seam rotation in radians."""
        if self.o.seam_rotate != "auto":
            return math.radians(float(self.o.seam_rotate))
        return self.projected.where("kind = 'pose'").agg(layers.auto_seam(F.col("theta"))).first()[0]

    def _turned(self, kind: str) -> DataFrame:
        return self.projected.where(F.col("kind") == kind).withColumn("theta", angles.rotate(F.col("theta"), self.rotation))

    # -- results

    @cached_property
    def poses(self) -> DataFrame:
        """pose_idx, pose_id, score, theta, phi, proj_distance, cluster_id, in no order."""
        spots = self._turned("pose").select(F.col("id").cast("bigint").alias("pose_idx"), "theta", "phi", F.col("distance").alias("proj_distance"))
        scored = self._poses[1].withColumn("pose_idx", F.col("pose_idx").cast("bigint")).join(spots, "pose_idx").withColumn("scope", F.lit("map"))
        return durable(layers.labelled(scored, math.radians(self.o.cluster_distance)))

    @cached_property
    def clusters(self) -> DataFrame:
        return durable(clusters.summary(self.poses, ["scope"], "raw_label"))

    def pose_table(self) -> DataFrame:
        ids = self.poses.join(F.broadcast(self.clusters.select("raw_label", "cluster_id")), "raw_label")  # a sphere holds few clusters
        return ids.select("pose_id", F.col("score").alias("vina_score"), "theta", "phi", "proj_distance", "cluster_id", "pose_idx")

    def cluster_table(self) -> DataFrame:
        return self.clusters.drop("scope", "raw_label")

    def contour_points(self) -> DataFrame:
        """theta, phi of the interface's heavy atoms (near the surface, if so filtered), by atom."""
        pts = self._turned("atom")
        if self.o.ppi_atom_filter == "near_surface":
            pts = pts.where(F.col("distance") <= self.o.ppi_near_surface_eps)
        return pts.select("theta", "phi", F.col("id").cast("bigint").alias("atom_idx"))

    def residue_points(self) -> DataFrame:
        return self._turned("residue").select("theta", "phi", F.substring_index("id", ":", 1).alias("label"))

    def traces(self) -> DataFrame:
        """trace_rank, atom_idx, theta, phi, x, y and the ligand's label."""
        t = self._turned("trace").withColumns({"trace_rank": F.substring_index("id", ":", 1).cast("int"), "atom_idx": F.substring_index("id", ":", -1).cast("bigint")})
        x, y = angles.project(F.col("theta"), F.col("phi"), self.o.map)
        named = self.traced.select("trace_rank", ligand_label(F.col("pose_id")).alias("label"))
        return t.join(F.broadcast(named), "trace_rank").select("trace_rank", "atom_idx", "theta", "phi", x.alias("x"), y.alias("y"), "label")  # the chosen few poses

    def scatter(self) -> DataFrame:
        x, y = angles.project(F.col("theta"), F.col("phi"), self.o.map)
        named = layers.pose_labels(self.poses, ["scope"], self.o.pose_label, self.o.pose_label_top)
        return named.select("pose_id", x.alias("x"), y.alias("y"), "label")

    def pose_density(self) -> DataFrame:
        """iy, ix, value, x, y: the blurred weight of the poses, at projected cell centres."""
        lon, lat = angles.lonlat(F.col("theta"), F.col("phi"))
        worst = self.poses.agg(F.max("score").alias("worst"))
        m = grids.tripled(self.poses.withColumns({"lon": lon, "lat": lat}).crossJoin(F.broadcast(worst)))  # one row
        w = angles.score_weight(F.col("score"), self.o.weight, F.col("worst"))
        return self._centred(grids.blur(grids.histogram(m, [], F.col("lat"), F.col("lon"), w), [], self.o.pose_density_sigma))

    def hexbin(self) -> DataFrame:
        """lattice, i, j, n: the projected poses by hexagon."""
        x, y = angles.project(F.col("theta"), F.col("phi"), self.o.map)
        return grids.hexagons(self.poses.select("scope", x.alias("x"), y.alias("y")), ["scope"], "x", "y").drop("scope")

    def centroids(self) -> DataFrame:
        """cluster_id, x, y, text, outline of the clusters' centroids; a mean that isn't a finite number counts as none."""
        x, y = angles.project(F.col("theta_centroid"), F.col("phi_centroid"), self.o.map)
        mean = F.when(F.abs("vina_score_avg") < float("inf"), F.col("vina_score_avg"))
        ranks = self.clusters.withColumns({"rank": F.col("cluster_id"), "score_avg": mean, "x": x, "y": y})
        return layers.centroid_layer(ranks, ["scope"]).select("cluster_id", "x", "y", "text", "outline")

    def cluster_contours(self) -> DataFrame:
        """cluster_id, kind, iy, ix, value, x, y, level, fill_to, position, color: the clusters' blurred histograms of projected poses.

        The line is drawn at ``level``; ``fill_to`` is the peak where it's filled, else null. A cluster of one
        pose has that point (kind point) and no grid. ``position`` is the cluster's on the colour map, unless ``color`` is given.
        """
        n, by = 90, ["cluster_id"]
        x, y = angles.project(F.col("theta"), F.col("phi"), self.o.map)
        sizes = self.clusters.select("raw_label", "cluster_id", "n_poses")  # a sphere holds few clusters
        p = self.poses.join(F.broadcast(sizes), "raw_label").select("cluster_id", "n_poses", x.alias("x"), y.alias("y"))
        many = p.where("n_poses > 1")
        blurred = grids.blur_dense(grids.padded_histogram(many, by, "x", "y", n), by, 2.6, n)
        around = many.groupBy(*by).agg(*(f(c).alias(f"{m}_{c}") for c in "xy" for f, m in ((F.min, "lo"), (F.max, "hi"))))
        found = blurred.join(around, by).join(grids.contour_levels(blurred, by), by)
        at = {}
        for c, i in (("x", "ix"), ("y", "iy")):
            lo, hi = grids.padded(c)
            at[c] = lo + (F.col(i) + 0.5) * ((hi - lo) / n)
        fill = F.col("peak") if self.o.cluster_contour == "filled" else F.lit(None).cast("double")
        grid = found.withColumns(at).select("cluster_id", F.lit("contour").alias("kind"), "iy", "ix", "value", "x", "y", "level", fill.alias("fill_to"))
        points = p.where("n_poses = 1").select("cluster_id", F.lit("point").alias("kind"), "x", "y")
        last = self.clusters.agg(F.max("cluster_id").alias("last"))
        out = grid.unionByName(points, allowMissingColumns=True).crossJoin(F.broadcast(last))  # one row
        return out.withColumns({"position": layers.palette(F.col("cluster_id"), F.col("last")), "color": F.lit(self.o.cluster_contour_color).cast("string")}).drop("last")

    def interface_contour(self) -> DataFrame:
        """kind, iy, ix, value, x, y: the blurred count of the interface's atoms at projected cell centres; less than 20 atoms stay points."""
        p = self.contour_points()
        if p.count() >= 20:
            h = grids.histogram(p, [], math.pi / 2 - F.col("phi"), F.col("theta"))
            return self._centred(grids.blur(h, [], 2.0)).select(F.lit("contour").alias("kind"), "iy", "ix", "value", "x", "y")
        x, y = angles.project(F.col("theta"), F.col("phi"), self.o.map)
        none = {c: F.lit(None).cast(t) for c, t in (("iy", "int"), ("ix", "int"), ("value", "double"))}
        return p.withColumns(none).select(F.lit("point").alias("kind"), "iy", "ix", "value", x.alias("x"), y.alias("y"))

    def layer_tables(self) -> dict[str, DataFrame]:
        """Every layer that was asked for, by its name."""
        made = {"scatter": self.scatter, "density": self.pose_density, "hexbin": self.hexbin, "trace": self.traces, "centroid": self.centroids}
        out = {name: made[name]() for name in self.o.pose_layer}
        if self.o.cluster_contour != "none":
            out["cluster_contour"] = self.cluster_contours()
        if "atom_contour" in self.o.ppi_footprint and not self.contour_points().isEmpty():
            out["ppi_contour"] = self.interface_contour()
        if self.o.background != "none":
            out["background"] = self.background()
            if self.o.background_colorbar:
                out["background_bar"] = self.background_bar()
        return out

    def _centred(self, g: DataFrame) -> DataFrame:
        lat = (F.col("iy") + 0.5) * math.pi / 180 - math.pi / 2
        lon = (F.col("ix") + 0.5) * math.pi / 180 - math.pi
        x, y = angles.project(lon, math.pi / 2 - lat, self.o.map)
        return g.withColumns({"x": x, "y": y})

    def background(self, compat: bool = False) -> DataFrame:
        """iy, ix, value, x, y, band: the mean scalar of the surface by map cell, stretched to 0..1 unless it's to be raw.

        ``band`` is the cell's of BANDS equal ones between the bar's ends, -1 below and BANDS above them. ``compat``
        adds the copies a turn away, which pile up in the first and last column.
        """
        lo, hi = F.col("vmin"), F.col("vmax")
        band = F.when(F.col("value") < lo, -1).when(F.col("value") > hi, BANDS).otherwise(F.least(F.lit(BANDS - 1), F.floor((F.col("value") - lo) / (hi - lo) * BANDS)))
        g = self._background(compat).crossJoin(F.broadcast(self._ends(compat)))  # one row
        return self._centred(g.withColumn("band", band.cast("int")).drop("vmin", "vmax"))

    def _background(self, compat: bool) -> DataFrame:
        c = self.corners.join(self.centre, "scope")
        theta, phi = angles.spherical(*(F.col(a) - F.col(f"o{a}") for a in "xyz"))
        value: Column = angles.distance(*((F.col(a), F.col(f"o{a}")) for a in "xyz")) if self.o.background == "radial" else F.col("curvature")
        c = c.withColumns({"lon": angles.rotate(theta, self.rotation), "lat": math.pi / 2 - phi, "value": value})
        c = self._smoothed(c.select("scope", "tid", "k", "lon", "lat", "value"), self.o.background_smooth)
        raw = self.o.background_colorbar_mode == "raw"
        c = c if raw else mesh.min_max(c, "value", ["scope"])
        c = grids.tripled(c) if compat else c
        g = grids.mean_grid(c, [], F.col("lat"), F.col("lon"), F.col("value"))
        return g if raw else grids.scaled(g, [])

    def _ends(self, compat: bool = False) -> DataFrame:
        """vmin, vmax: the bar's ends, one row. A raw bar's are those given, else the filled cells'; if they leave no room, vmax is a hair above."""
        o = self.o
        if o.background_colorbar_mode == "norm":
            return self.spark.range(1).select(F.lit(0.0).alias("vmin"), F.lit(1.0).alias("vmax"))
        lo = F.min("value") if o.background_colorbar_vmin is None else F.lit(float(o.background_colorbar_vmin))
        hi = F.max("value") if o.background_colorbar_vmax is None else F.lit(float(o.background_colorbar_vmax))
        ends = self._background(compat).agg(lo.alias("vmin"), hi.alias("vmax"))
        return ends.withColumn("vmax", F.when(F.col("vmax") <= F.col("vmin"), F.col("vmin") + 1e-12).otherwise(F.col("vmax")))

    def background_bar(self) -> DataFrame:
        """label, location, vmin, vmax, bands, lines: the colour bar, one row; the ends of the filled bands and the levels of the lines."""
        o = self.o
        name = {"curvature": "Curvature (proxy)", "radial": "Radial distance"}.get(o.background, "Background scalar")
        label = o.background_colorbar_label or (f"{name} (normalized)" if o.background_colorbar_mode == "norm" else name)
        steps = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.col("vmin") + i * (F.col("vmax") - F.col("vmin")) / n)
        return self._ends().select(F.lit(label).alias("label"), F.lit(o.background_colorbar_location).alias("location"), "vmin", "vmax", steps(BANDS).alias("bands"), steps(LINES).alias("lines"))

    @staticmethod
    def _smoothed(c: DataFrame, rounds: int) -> DataFrame:
        """Neighbour means over corners that share no vertex: after each round a corner has the mean of the two others."""
        if rounds <= 0:
            return c
        whole = Window.partitionBy("scope", "tid")
        mean, share = F.avg("value").over(whole), (-0.5) ** rounds  # the part that differs from the mean is halved and turned each round
        return c.withColumn("value", mean + share * (F.col("value") - mean))

    def mesh_tables(self) -> tuple[DataFrame, DataFrame]:
        """(vertices, faces) numbered without gaps, for the mesh files."""
        # Faces are numbered in the order of their cubes: those of the cubes before, then those of the own cube.
        whole = durable(self.triangles.withColumn("cube", F.floor(F.col("tid") / 12)))
        cubes = whole.groupBy("scope", "cube").agg(F.count(F.lit(1)).alias("faces"))
        upto = running_sum(cubes, ["scope"], "cube", "faces", "upto", part=1 << 24).select("scope", "cube", (F.col("upto") - F.col("faces")).alias("before"))
        own = F.row_number().over(Window.partitionBy("scope", "cube").orderBy("tid")) - 1
        numbered = durable(whole.withColumn("own", own).join(upto, ["scope", "cube"]).select((F.col("before") + F.col("own")).alias("fid"), *(f"{c}{a}" for c in "abc" for a in "xyz")))
        faces = numbered.select("fid", *((F.col("fid") * 3 + i).alias(c) for i, c in enumerate("abc")))
        parts = [F.struct((F.col("fid") * 3 + i).alias("vid"), *(F.col(f"{c}{a}").alias(a) for a in "xyz"), F.lit(i).alias("k"), F.col("fid").alias("fid")) for i, c in enumerate("abc")]
        vertices = numbered.select(F.explode(F.array(*parts)).alias("v")).select("v.vid", "v.x", "v.y", "v.z")
        if self.o.mesh_vertex_scalar == "density":
            pts = vertices.select(F.lit("map").alias("scope"), F.col("vid").alias("pid"), *(F.col(a).alias(f"p{a}") for a in "xyz"))
            value = surface.trilinear(pts, self.density, self.grid, self.o.grid_spacing).select(F.col("pid").alias("vid"), "value", "scope")
            vertices = vertices.join(mesh.min_max(value, "value", ["scope"]).drop("scope"), "vid")
        elif self.o.mesh_vertex_scalar == "curv_proxy":
            bend = []
            for i, (a, b, c) in enumerate(("abc", "bca", "cab")):
                far = F.sqrt(sum((((F.col(f"{b}{x}") + F.col(f"{c}{x}")) / 2 - F.col(f"{a}{x}")) ** 2 for x in "xyz"), F.lit(0.0)))
                bend.append(F.struct((F.col("fid") * 3 + i).alias("vid"), far.alias("value")))
            value = numbered.select(F.explode(F.array(*bend)).alias("v")).select(F.lit("map").alias("scope"), "v.vid", "v.value")
            vertices = vertices.join(mesh.min_max(value, "value", ["scope"]).drop("scope"), "vid")
        return vertices, faces

    def write(self, prefix: str) -> list[str]:
        """The result tables as CSV folders under ``prefix``; footprint tables only where they have rows."""
        done = []

        def put(df: DataFrame, name: str, order: list[str], drop: list[str] = []) -> None:
            path = f"{prefix}_{name}"
            # Ordered before the columns that only order it are dropped; result tables fit one file.
            writers.csv_cells(df.orderBy(*order).drop(*drop)).coalesce(1).write.mode("overwrite").csv(path, header=True)
            done.append(path)

        put(self.pose_table(), "poses_mapped.csv", ["cluster_id", "vina_score", "pose_id"], ["pose_idx"])
        put(self.cluster_table(), "clusters.csv", ["cluster_id"])
        if "atom_contour" in self.o.ppi_footprint and not self.contour_points().isEmpty():
            put(self.contour_points(), "ppi_contour_mapped.csv", ["atom_idx"], ["atom_idx"])
        if "residue_points" in self.o.ppi_footprint and not self.residue_points().isEmpty():
            put(self.residue_points(), "ppi_residue_points_mapped.csv", ["label"])
        return done
