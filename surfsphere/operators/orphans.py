"""Orphan references by period, found with sparse bitmaps (problem 6).

Keys become integers inside a key range; 64 neighbouring keys share one long word, and only words with a
bit set exist, so the bitmaps are stored compressed. For each (range, word, period) the referring table has
the bits of the keys it names and the parent table those of the keys that are known throughout the period.
``reference AND NOT parent`` leaves the keys that may lack a parent; only their rows are then held against
the parents' exact times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import durable


def month_index(t: Column) -> Column:
    return F.year(t) * 12 + F.month(t) - 1


def month_name(index: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"))


def dictionary(keys: DataFrame, ranges: Sequence[str], code_of: str) -> DataFrame:
    """(ranges, code_of, code): dense integers for the different values of ``code_of`` in a key range.

    An integer column is its own code. Otherwise the ranks are made over different values only, so a range
    costs as much as it has values, however many rows refer to it.
    """
    distinct = keys.select(*ranges, code_of).distinct()
    if dict(distinct.dtypes)[code_of] in ("int", "bigint", "smallint", "tinyint"):
        return distinct.withColumn("code", F.col(code_of).cast("bigint"))
    ranked = F.dense_rank().over(Window.partitionBy(*ranges).orderBy(code_of)) - 1
    return distinct.withColumn("code", ranked.cast("bigint"))


def _bitmaps(coded: DataFrame, ranges: Sequence[str], name: str) -> DataFrame:
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("code").bitwiseAND(F.lit(63)).cast("int"))
    return coded.groupBy(*ranges, F.shiftright("code", 6).alias("word"), "period").agg(F.bit_or(bit).alias(name))


def orphan_references(
    refs: DataFrame, spans: DataFrame, ranges: Sequence[str], code_of: str, at: str, extra: Sequence[str] = ()
) -> DataFrame:
    """(ranges, code_of, extra, period) of the references for which no parent is known at their time.

    ``refs`` has the key columns, ``at`` and ``extra``; ``spans`` has the key columns, valid_from and
    valid_to (null: still valid). A parent is known at t if valid_from <= t and valid_to is null or > t.
    References with a null key or time are none; spans with a null key or start are none. Repeated
    references and spans change nothing, and an empty parent table leaves every reference an orphan.
    """
    keys = [*ranges, code_of]
    refs = refs.select(*keys, *(c for c in extra if c not in keys), F.col(at).alias("at")).dropna(subset=[*keys, "at"]).distinct()
    # Both are read several times below: different references and spans are far fewer than rows.
    refs = durable(refs.withColumn("period", month_index(F.col("at"))))
    spans = durable(spans.select(*keys, "valid_from", "valid_to").dropna(subset=[*keys, "valid_from"]).distinct())
    codes = dictionary(refs, ranges, code_of)
    integer = dict(codes.dtypes)[code_of] != "string"

    def coded(df: DataFrame) -> DataFrame:
        return df.withColumn("code", F.col(code_of).cast("bigint")) if integer else df.join(codes, keys)

    named = _bitmaps(coded(refs.select(*keys, "period").distinct()), ranges, "named")
    seen = refs.agg(F.min("period").alias("first"), F.max("period").alias("last"))  # one row
    # Only whole months count for the bitmaps: a span's first and last month go to the exact check.
    lo = F.greatest(month_index(F.col("valid_from")) + 1, F.col("first"))
    hi = F.least(F.coalesce(month_index(F.col("valid_to")) - 1, F.col("last")), F.col("last"))
    whole = (
        coded(spans).crossJoin(F.broadcast(seen)).withColumns({"lo": lo, "hi": hi}).where("lo <= hi")
        .select(*ranges, "code", F.explode(F.sequence("lo", "hi")).alias("period"))
    )
    known = _bitmaps(whole, ranges, "known")
    left = F.col("named").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("bigint"))))
    open_words = named.join(known, [*ranges, "word", "period"], "left").withColumn("left", left).where("left <> 0")
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("left").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)) != 0)
    decoded = open_words.select(*ranges, "period", "word", F.explode(bits).alias("bit")).withColumn("code", F.col("word") * 64 + F.col("bit")).drop("word", "bit")
    if integer:
        decoded = decoded.withColumnRenamed("code", code_of).withColumn(code_of, F.col(code_of).cast(dict(refs.dtypes)[code_of]))
    else:
        decoded = decoded.join(codes, [*ranges, "code"]).drop("code")
    doubtful = refs.join(decoded, [*keys, "period"])
    s = spans.select(*(F.col(k).alias(f"s_{k}") for k in keys), "valid_from", "valid_to")
    on = [F.col(k) == F.col(f"s_{k}") for k in keys]
    on += [F.col("valid_from") <= F.col("at"), F.col("valid_to").isNull() | (F.col("valid_to") > F.col("at"))]
    return doubtful.join(s, on, "left_anti").select(*keys, *(c for c in extra if c not in keys), "period").distinct()


def orphan_atoms(atoms: DataFrame, inventory: DataFrame) -> DataFrame:
    """Atoms that name a chain unknown at their loading time (null chains and ``?`` name none)."""
    refs = atoms.where(F.col("chain") != "?")
    spans = inventory.select("structure_id", "chain", F.col("registered_at").alias("valid_from"), F.col("deleted_at").alias("valid_to"))
    out = orphan_references(refs, spans, ["structure_id"], "chain", "loaded_at", ["resseq"])
    return out.select(F.lit("atoms").alias("ref_table"), "structure_id", "chain", "resseq", month_name(F.col("period")).alias("ref_month"))


def orphan_residues(interface: DataFrame, atoms: DataFrame) -> DataFrame:
    """Interface residues whose residue no atom had reached by the listing time."""
    first = (
        atoms.where((F.col("icode") == "") & F.col("chain").isNotNull() & F.col("resseq").isNotNull())
        .groupBy("structure_id", "chain", "resseq").agg(F.min("loaded_at").alias("valid_from"))
        .withColumn("valid_to", F.when(F.lit(False), F.col("valid_from")))
    )
    out = orphan_references(interface, first, ["structure_id", "chain"], "resseq", "listed_at")
    return out.select(F.lit("interface_residues").alias("ref_table"), "structure_id", "chain", "resseq", month_name(F.col("period")).alias("ref_month"))


def orphans(atoms: DataFrame, inventory: DataFrame, interface: DataFrame) -> DataFrame:
    return orphan_atoms(atoms, inventory).unionByName(orphan_residues(interface, atoms))
