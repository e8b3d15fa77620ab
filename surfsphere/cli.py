"""Command line of the map: ``python -m surfsphere.cli --protein ... --peptides ... --scores ... --ppi-file ...``."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from pyspark.sql import functions as F

from .plans.layers import normal_layers
from .plans.pipeline import MapOptions, MissingResidues, SurfaceMap
from .session import get_spark
from .sources import writers

log = logging.getLogger("surfsphere")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="surfsphere", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    add = p.add_argument
    for name, text in (("--protein", "structure file"), ("--peptides", "file of several poses"), ("--scores", "a score a line"), ("--ppi-file", "interface residues")):
        add(name, required=True, help=text)
    add("--align-protein", default="none", choices=["none"])
    add("--radius-scale", type=float, default=1.4)
    add("--density-isovalue", type=float, default=1.0)
    add("--grid-spacing", type=float, default=1.0)
    add("--surface-quality", default="max", choices=["max", "med", "low"])
    add("--cache-surface", help="folder of surfaces by their parameters")
    add("--ppi-footprint", action="append", choices=["residue_points", "atom_contour"])
    add("--ppi-residue-point", default="sc_com", choices=["ca", "res_com", "sc_com"])
    add("--ppi-atom-filter", default="near_surface", choices=["all_heavy", "near_surface", "sasa"])
    add("--ppi-near-surface-eps", type=float, default=1.5)
    add("--map", default="mollweide", choices=["equirect", "mollweide", "hammer"])
    add("--pose-projection", default="nearest", choices=["nearest", "raycast"])
    add("--metric", default="vertex", choices=["vertex", "triangle"], help="poses go to the closest corner or to the closest point of the surface")
    add("--peptide-center", default="com", choices=["com", "cog"])
    add("--seam-rotate", default="auto", help="auto or degrees")
    add("--cluster-distance", type=float, default=15.0, help="degrees")
    add("--out-prefix", default="surfmap")
    add("--map-title")
    add("--format", default="svg", choices=["png", "pdf", "svg"], help="kept for compatibility: layers are written as tables")
    add("--write-csv", action=argparse.BooleanOptionalAction, default=True)
    add("--export-mesh", action="store_true")
    add("--mesh-format", default="ply", choices=["obj", "ply", "stl"])
    add("--mesh-path")
    add("--mesh-vertex-scalar", default="none", choices=["none", "density", "curv_proxy"])
    add("--mesh-scalar-name")
    add("--pose-layer", action="append", help="scatter, density, hexbin, trace, centroid; may be repeated or a comma list")
    add("--cluster-contour", default="none", choices=["none", "outline", "filled"])
    add("--cluster-contour-color")
    add("--trace-pose", default="best", help="best, first or a number")
    add("--weight", default="exp", choices=["none", "exp", "linear"])
    add("--pose-density-sigma", type=float, default=2.0)
    add("--background", default="none", choices=["none", "curvature", "radial"])
    add("--background-smooth", type=int, default=0)
    add("--background-colorbar", action="store_true")
    add("--background-colorbar-location", default="right", choices=["right", "bottom"])
    add("--background-colorbar-mode", default="norm", choices=["norm", "raw"])
    add("--background-colorbar-label")
    add("--background-colorbar-vmin", type=float)
    add("--background-colorbar-vmax", type=float)
    add("--pose-label", default="none", choices=["none", "first", "best", "topN"])
    add("--pose-label-top", type=int, default=5)
    add("--verbose", "-v", action="count", default=0)
    return p


def options_of(a: argparse.Namespace) -> MapOptions:
    names = MapOptions.__dataclass_fields__
    given = {k: v for k, v in vars(a).items() if k in names}
    given["pose_layer"] = tuple(normal_layers(a.pose_layer))
    given["ppi_footprint"] = tuple(dict.fromkeys(a.ppi_footprint or ["atom_contour"]))
    return MapOptions(**given)


def title(a: argparse.Namespace) -> str:
    return a.map_title or f"{Path(a.protein).stem} vs {Path(a.peptides).stem}"


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(a.verbose, 2)], format="[%(levelname)s] %(name)s: %(message)s")
    m = SurfaceMap(get_spark(), options_of(a))
    try:
        report = m.validate()
    except MissingResidues as e:
        log.error("%s", e)
        return 2
    log.info("%s: %s", title(a), report)
    prefix = str(Path(a.out_prefix).absolute())
    if a.write_csv:
        log.info("Wrote %s", ", ".join(m.write(prefix)))
    for layer, rows in m.layer_tables().items():
        rows.write.mode("overwrite").parquet(f"{prefix}_layer_{layer}")
    if a.export_mesh:
        scalar = None if a.mesh_vertex_scalar == "none" else "value"
        name = a.mesh_scalar_name or {"density": "density", "curv_proxy": "curv"}.get(a.mesh_vertex_scalar, "scalar")
        vertices, faces = m.mesh_tables()
        path = a.mesh_path or f"{prefix}_quicksurf.{a.mesh_format}"
        writers.write_mesh(vertices, faces, path, a.mesh_format, scalar=scalar, scalar_name=name)
        log.info("Wrote %s (%d faces)", path, faces.agg(F.count(F.lit(1))).first()[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
