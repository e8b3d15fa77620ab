"""Structure files, pose files, score lists and interface lists as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.chem import element_or_guess
from ..operators.prefix import running_sum
from . import strict


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """source, line_no (from 0), line of each text file; all kinds of line ends, an end after the last line starts no other.

    Files are read in splits. A line's number is its place in the split, which is one run of rows of a task,
    after the lines of the file's splits before.
    """
    split = F.struct(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select(split.alias("split"), F.col("value").alias("line")).withColumn("row", F.monotonically_increasing_id())
    sizes = lines.groupBy("split").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("split.source").orderBy("split.start").rowsBetween(Window.unboundedPreceding, -1))  # a row per split
    sizes = sizes.select("split", "first", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = lines.join(F.broadcast(sizes), "split")  # no more rows than splits, which the driver lists anyway
    return numbered.select("split.source", (F.col("before") + F.col("row") - F.col("first")).alias("line_no"), "line")


def atom_lines(line: Column) -> Column:
    return line.startswith("ATOM") | line.startswith("HETATM")


def parse_atoms(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Atoms of fixed-width lines (keys, line_no, line), in file order by atom_idx = line_no; bad lines raise.

    All alternative locations are kept. A blank chain is ``?``, a blank element is guessed from the name.
    """
    checked = strict.checked_atoms(lines.select(*keys, "line_no", "line"))
    ok = F.when(F.size("errors") == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("Cannot parse atom line: "), F.col("line"))).cast("boolean"))
    atoms = strict.atoms_of(checked.where(ok))
    atoms = atoms.withColumn("element", element_or_guess(F.col("element"), F.col("name")))
    return atoms.select(*keys, F.col("line_no").cast("bigint").alias("atom_idx"), "chain", "resname", "resseq", "icode", "name", "element", "x", "y", "z")


def load_structure(spark: SparkSession, path: str) -> DataFrame:
    atoms = parse_atoms(text_lines(spark, path), [])
    if atoms.isEmpty():
        raise ValueError(f"No ATOM/HETATM records in {path}")
    return atoms


def split_poses(lines: DataFrame, scope: list[str]) -> DataFrame:
    """Adds pose_idx (from 1) to the atom lines of pose files (scope, line_no, line).

    In a file with a MODEL line, MODEL, ENDMDL and lines of just END separate poses; in others every line
    that starts with the word END or ENDMDL. Blocks without atoms don't count, an unended last one does.
    """
    s = F.upper(F.trim("line"))
    model, word_end = s.rlike(r"^MODEL\b"), s.rlike(r"^(END|ENDMDL)\b")
    with_models = lines.groupBy(*scope).agg(F.max(F.coalesce(model, F.lit(False))).alias("has_model"))
    marked = lines.join(with_models, scope) if scope else lines.crossJoin(F.broadcast(with_models))  # one row
    cut = F.when(F.col("has_model"), model | (word_end & s.startswith("ENDMDL")) | (s == "END")).otherwise(word_end)
    marked = marked.withColumn("cut", F.coalesce(cut, F.lit(False)).cast("bigint"))
    blocks = running_sum(marked, scope, "line_no", "cut", "block").where(atom_lines(F.col("line")))
    first = blocks.groupBy(*scope, "block").agg(F.count(F.lit(1)).alias("_n")).withColumn("one", F.lit(1).cast("bigint"))
    numbered = running_sum(first, scope, "block", "one", "pose_idx").select(*scope, "block", "pose_idx")
    return blocks.join(numbered, [*scope, "block"]).drop("cut", "has_model", "block")


def parse_scores(lines: DataFrame, scope: list[str]) -> DataFrame:
    """scope, pose_idx (from 1), score: one number a line, blank lines left out; others raise."""
    text = F.trim("line")
    kept = lines.where(text != "").withColumn("one", F.lit(1).cast("bigint"))
    value = F.when(text.rlike(strict.DECIMAL_EXP) | F.lower(text).rlike(r"\A[+-]?(nan|inf|infinity)\z"), text.cast("double"))
    value = F.coalesce(value, F.raise_error(F.concat(F.lit("Cannot parse score: "), F.col("line"))).cast("double"))
    return running_sum(kept, scope, "line_no", "one", "pose_idx").select(*scope, "pose_idx", value.alias("score"))


def positional_join(blocks: DataFrame, scores: DataFrame, scope: list[str]) -> DataFrame:
    """Poses with the scores at their positions: scope, pose_idx, pose_id, score."""
    poses = blocks.select(*scope, "pose_idx").distinct()
    return poses.join(scores, [*scope, "pose_idx"]).withColumn("pose_id", pose_id(F.col("pose_idx")))


def pose_id(index: Column) -> Column:
    return F.concat(F.lit("pose"), F.when(index < 10000, F.lpad(index.cast("string"), 4, "0")).otherwise(index.cast("string")))


def load_poses(spark: SparkSession, peptides: str, scores: str) -> tuple[DataFrame, DataFrame]:
    """(pose atoms with pose_idx, poses with scores) of a pose file and a score list of as many lines."""
    lines = split_poses(text_lines(spark, peptides), [])
    listed = parse_scores(text_lines(spark, scores), [])
    n_blocks, n_scores = lines.agg(F.max("pose_idx")).first()[0] or 0, listed.count()
    if not n_scores:
        raise ValueError(f"No scores found in {scores}")
    if n_blocks != n_scores:
        raise ValueError(f"Mismatch: {n_blocks} pose blocks in {peptides} but {n_scores} scores in {scores}")
    return parse_atoms(lines, ["pose_idx"]), positional_join(lines, listed, [])


def parse_interface(lines: DataFrame, keys: list[str] = []) -> DataFrame:
    """keys, chain, resseq, icode: the word after ``Chain`` and the last word of each line that isn't blank; each once."""
    toks = F.split(F.trim("line"), r"\s+")
    at = F.array_position(toks, "Chain")
    chain = F.when(at > 0, F.try_element_at(toks, (at + 1).cast("int")))
    resseq = F.when(F.element_at(toks, -1).rlike(strict.INTEGER), F.element_at(toks, -1)).try_cast("int")
    good = chain.isNotNull() & resseq.isNotNull()
    ok = F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("Cannot parse interface line: "), F.col("line"))).cast("boolean"))
    return lines.where(F.trim("line") != "").where(ok).select(*keys, chain.alias("chain"), resseq.alias("resseq"), F.lit("").alias("icode")).distinct()


def load_interface(spark: SparkSession, path: str) -> DataFrame:
    return parse_interface(text_lines(spark, path))
