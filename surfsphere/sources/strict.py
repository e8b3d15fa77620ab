"""Loading of text rows of which some are malformed (problem 5).

Every column comes in as nullable text; each rule is a Column that is null where the rule holds and the
reason's name where it doesn't. The rules of a row form an array, its nulls are dropped, and the rows are
split by whether that error array is empty. All of it is one projection per row inside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the input formats: ASCII digits only, no exponent in coordinates.
INTEGER = r"\A[+-]?[0-9]+\z"
DECIMAL = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z"
DECIMAL_EXP = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"(?=,|\z)|(?!")[^",]*+)'
QUOTED_LINE = rf"\A{FIELD}(?:,{FIELD})*+\z"
SCORE_HEADER = "run_id,pose_id,vina_score,remark"


def unless(holds: Column, reason: str) -> Column:
    """Null where the rule holds, else its reason. A null outcome counts as a failure."""
    return F.when(~F.coalesce(holds, F.lit(False)), F.lit(reason))


def with_errors(df: DataFrame, rules: Sequence[Column]) -> DataFrame:
    """Adds ``errors``, the reasons that apply in the rules' order (empty: a valid row)."""
    return df.withColumn("errors", F.filter(F.array(*rules), lambda e: e.isNotNull()))


def split_rows(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, bad rows); a bad row has its first reason as ``reason``."""
    bad = F.size("errors") > 0
    return checked.where(~bad).drop("errors"), checked.where(bad).withColumn("reason", F.col("errors")[0])


def _part(line: Column, first: int, last: int) -> Column:
    return F.btrim(F.substring(line, first, last - first + 1), F.lit(" "))


def checked_atoms(lines: DataFrame, line: str = "line") -> DataFrame:
    """Fixed-width atom lines as text columns with ``errors``.

    Only lines that start with ATOM or HETATM are taken; null, empty and other lines are no atoms and no
    errors. Positions count characters (code points). Repeated lines stay repeated, and the input's other
    columns are kept unless one has the name of a parsed column, which then replaces it.
    """
    v = F.col(line)
    kept = lines.where(v.startswith("ATOM") | v.startswith("HETATM"))
    cols = {
        "name": _part(v, 13, 16), "resname": _part(v, 18, 20), "chain": _part(v, 22, 22), "resseq": _part(v, 23, 26),
        "icode": _part(v, 27, 27), "x": _part(v, 31, 38), "y": _part(v, 39, 46), "z": _part(v, 47, 54), "element": F.upper(_part(v, 77, 78)),
    }
    long_enough = F.length(v) >= 54
    coords = F.col("x").rlike(DECIMAL) & F.col("y").rlike(DECIMAL) & F.col("z").rlike(DECIMAL)
    return with_errors(
        kept.withColumns(cols),
        [unless(long_enough, "columns"), unless(F.col("resseq").rlike(INTEGER), "resseq"), unless(coords, "coord")],
    )


def atoms_of(valid: DataFrame) -> DataFrame:
    """Typed atoms of the valid rows. A residue number of any length fits a bigint or becomes null."""
    return valid.withColumns(
        {
            "resseq": F.col("resseq").try_cast("int"),
            "chain": F.when(F.col("chain") == "", F.lit("?")).otherwise(F.col("chain")),
            "x": F.col("x").cast("double"), "y": F.col("y").cast("double"), "z": F.col("z").cast("double"),
        }
    )


def checked_scores(lines: DataFrame, line: str = "line") -> DataFrame:
    """Comma-separated score lines as text columns with ``errors``.

    Null lines, lines of spaces and header lines are skipped. The fields of a correctly quoted line are
    cut with the same pattern that checks them; a quoted field is its content, with doubled quotes halved.
    """
    v = F.col(line)
    kept = lines.where((F.btrim(v, F.lit(" ")) != "") & (v != SCORE_HEADER))
    quoted = v.rlike(QUOTED_LINE)
    fields = F.when(quoted, F.regexp_extract_all(v, F.lit(rf"(?<=\A|,)({FIELD})(?=,|\z)"), F.lit(1)))

    def value(i: int) -> Column:
        raw = F.try_element_at(F.col("fields"), F.lit(i))
        inner = F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))
        return F.when(raw.startswith('"'), inner).otherwise(raw)

    # The columns are numbered by position; values are only cut from lines with the right number of them.
    out = kept.withColumn("fields", fields)
    out = out.withColumns({"run_id": value(1), "pose_id": value(2), "score_text": F.btrim(value(3), F.lit(" ")), "remark": value(4)})
    is_quoted, four = F.col("fields").isNotNull(), F.size("fields") == 4
    return with_errors(
        out,
        [unless(is_quoted, "quoting"), unless(~is_quoted | four, "columns"), unless(~is_quoted | F.col("score_text").rlike(DECIMAL_EXP), "score")],
    ).drop("fields")


def scores_of(valid: DataFrame) -> DataFrame:
    return valid.withColumn("vina_score", F.col("score_text").cast("double")).drop("score_text")


def bad_lines(pdb_lines: DataFrame, score_lines: DataFrame) -> DataFrame:
    """line_id, reason of every bad line of both tables; a line_id repeated with one reason comes once."""
    bad = [split_rows(c)[1].select("line_id", "reason") for c in (checked_atoms(pdb_lines.select("line_id", "line")), checked_scores(score_lines.select("line_id", "line")))]
    return bad[0].unionByName(bad[1]).distinct()
