"""Column expressions on atoms: elements, masses, radii, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard atomic masses and van der Waals radii, and what other elements count as.
MASS = {"H": 1.008, "C": 12.011, "N": 14.007, "O": 15.999, "P": 30.974, "S": 32.06, "CL": 35.45, "BR": 79.904, "F": 18.998, "I": 126.904}
RADIUS = {"H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "S": 1.80, "P": 1.80, "F": 1.47, "CL": 1.75, "BR": 1.85, "I": 1.98}
OTHER_MASS, OTHER_RADIUS = 12.0, 1.70
#: Atom names of the main chain.
MAIN_CHAIN = ("N", "CA", "C", "O", "OXT")


def _lookup(key: Column, values: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def mass(element: Column) -> Column:
    return _lookup(F.upper(F.trim(element)), MASS, OTHER_MASS)


def radius(element: Column) -> Column:
    return _lookup(F.upper(element), RADIUS, OTHER_RADIUS)


def guess_element(name: Column) -> Column:
    """From an atom's name: its first letter, two for chlorine and bromine; carbon where there's none."""
    s = F.upper(F.trim(F.translate(name, "0123456789", "")))
    return F.when(s == "", F.lit("C")).when(F.substring(s, 1, 2).isin("CL", "BR"), F.substring(s, 1, 2)).otherwise(F.substring(s, 1, 1))


def element_or_guess(element: Column, name: Column) -> Column:
    e = F.upper(F.trim(F.coalesce(element, F.lit(""))))
    return F.when(e == "", guess_element(F.coalesce(name, F.lit("")))).otherwise(e)


def ligand_label(pose_id: Column) -> Column:
    """pose0007 -> LIG0007; the number without leading zeros, four digits at least; LIG and the id if it has no digit."""
    digits = F.regexp_replace(pose_id, "[^0-9]", "")
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    padded = F.when(F.length(plain) >= 4, plain).otherwise(F.lpad(plain, 4, "0"))
    return F.when(digits == "", F.concat(F.lit("LIG"), pose_id)).otherwise(F.concat(F.lit("LIG"), padded))
