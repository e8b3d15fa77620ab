"""Residues: inventories, interface checks, representative points, centres."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chem import MAIN_CHAIN, mass

RESIDUE = ["chain", "resseq", "icode"]


def centre_of_geometry(atoms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean position by key: cx, cy, cz."""
    return atoms.groupBy(*keys).agg(*(F.avg(c).alias(f"c{c}") for c in "xyz"))


def centre_of_mass(atoms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean position by key, weighted with the elements' masses (all above zero)."""
    w = mass(F.col("element"))
    return atoms.groupBy(*keys).agg(*((F.sum(w * F.col(c)) / F.sum(w)).alias(f"c{c}") for c in "xyz"))


def inventory(atoms: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Atoms and different residues of every chain."""
    by_residue = atoms.groupBy(*scope, *RESIDUE).agg(F.count(F.lit(1)).alias("n"))  # spreads a long chain
    return by_residue.groupBy(*scope, "chain").agg(F.sum("n").alias("n_atoms"), F.count(F.lit(1)).alias("n_residues"))


def present(interface: DataFrame, atoms: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Interface residues that the atoms have; an atom with an insertion code never matches an empty one."""
    return interface.join(atoms.select(*scope, *RESIDUE).distinct(), [*scope, *RESIDUE], "left_semi")


def missing(interface: DataFrame, atoms: DataFrame, scope: Sequence[str]) -> DataFrame:
    return interface.join(atoms.select(*scope, *RESIDUE).distinct(), [*scope, *RESIDUE], "left_anti")


def validation(interface: DataFrame, atoms: DataFrame, scope: Sequence[str], examples: int = 20) -> DataFrame:
    """A row per scope with interface residues: totals, chains, present and missing counts, first missing ones.

    The examples are the first of a ranking within the scope, taken before anything is gathered.
    """
    from pyspark.sql.window import Window

    has = atoms.select(*scope, *RESIDUE).distinct()
    marked = interface.join(has.withColumn("found", F.lit(True)), [*scope, *RESIDUE], "left")
    lost = marked.where("found IS NULL").withColumn("k", F.row_number().over(Window.partitionBy(*scope).orderBy(*RESIDUE))).where(F.col("k") <= examples)
    label = F.concat(F.col("chain"), F.lit(":"), F.col("resseq").cast("string"), F.col("icode"))
    first = lost.groupBy(*scope).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", label.alias("r")))), lambda s: s["r"]).alias("missing_examples"))
    counts = marked.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("interface_total"), F.count("found").alias("present_count"), F.count(F.when(F.col("found").isNull(), 1)).alias("missing_count"),
        F.array_sort(F.collect_set("chain")).alias("interface_chains"),
    )
    total = has.groupBy(*scope).agg(F.count(F.lit(1)).alias("residue_total"), F.array_sort(F.collect_set("chain")).alias("chains"))
    out = counts.join(total, list(scope), "left").join(first, list(scope), "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"residue_total": F.coalesce("residue_total", F.lit(0)), "chains": F.coalesce("chains", none), "missing_examples": F.coalesce("missing_examples", none)})


def residue_points(atoms: DataFrame, scope: Sequence[str], mode: str = "sc_com") -> DataFrame:
    """A point (px, py, pz) and a label for every residue.

    ca: its first CA in file order; res_com: the mean of its atoms; sc_com: that of its atoms outside the
    main chain (hydrogens such as HA count as side chain). Without such atoms the mean of all.
    """
    mode = mode.lower()
    if mode not in ("ca", "res_com", "sc_com"):
        raise ValueError(f"Unknown residue point mode: {mode}")
    name = F.upper("name")

    def point(c: str) -> Column:
        whole = F.avg(c)
        if mode == "ca":
            is_ca = name == "CA"
            return F.coalesce(F.min_by(F.when(is_ca, F.col(c)), F.when(is_ca, F.col("atom_idx"))), whole)
        if mode == "sc_com":
            return F.coalesce(F.avg(F.when(~name.isin(*MAIN_CHAIN), F.col(c))), whole)
        return whole

    label = F.concat(F.min_by("resname", "atom_idx"), F.col("resseq").cast("string"), F.col("icode"))
    return atoms.groupBy(*scope, *RESIDUE).agg(*(point(c).alias(f"p{c}") for c in "xyz"), label.alias("label"))


def interface_atoms(interface: DataFrame, atoms: DataFrame, scope: Sequence[str], heavy: bool = False) -> DataFrame:
    """Atoms of interface residues, without hydrogens if ``heavy``."""
    out = atoms.join(interface.select(*scope, *RESIDUE).distinct(), [*scope, *RESIDUE])
    return out.where(F.upper("element") != "H") if heavy else out


def ca_trace(atoms: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The first atom named exactly CA of every residue."""
    return (
        atoms.where(F.col("name") == "CA").groupBy(*scope, *RESIDUE)
        .agg(F.min_by(F.struct("x", "y", "z"), "atom_idx").alias("p")).select(*scope, *RESIDUE, "p.x", "p.y", "p.z")
    )
