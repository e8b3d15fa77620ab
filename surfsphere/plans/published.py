"""The options of the two published worked examples, for the test against their tables and for the bench."""

from __future__ import annotations

from pathlib import Path

from .pipeline import MapOptions


def example_folder(root: Path) -> Path | None:
    """The folder with the examples' data and expected tables in a checkout next to this one."""
    return next((p.parent for p in sorted(root.glob("*/examples/*/expected"))), None)


def example_options(folder: Path, number: int) -> MapOptions:
    poses, structure = sorted((folder / "data").glob("*.pdb"), key=lambda p: p.stat().st_size)  # the structure is the larger one
    files = [str(p) for p in (structure, poses, *(folder / "data").glob("*.dat"), *(folder / "data").glob("*.txt"))]
    common = dict(
        ppi_footprint=("residue_points", "atom_contour"), background_smooth=1, background_colorbar=True, background_colorbar_mode="raw", trace_pose="5",
        pose_label="topN", pose_label_top=5, seam_rotate="-120", radius_scale=4.0, grid_spacing=0.4, surface_quality="max", ppi_near_surface_eps=12.0,
    )
    if number == 1:
        return MapOptions(*files, **common, background="curvature", pose_layer=("scatter",), map="equirect")
    return MapOptions(*files, **common, background="radial", pose_layer=("trace",))
