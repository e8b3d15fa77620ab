"""Score files that keep arriving: the strict loading rules on a stream, valid and bad rows to their own sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import strict


def score_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of text files as they come into a folder, checked as in a batch (one projection, no state)."""
    return strict.checked_scores(spark.readStream.text(folder).withColumnRenamed("value", "line"))


def split_stream(checked: DataFrame, valid_path: str, bad_path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's scores and bad lines as Parquet; a batch that is repeated replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        valid, bad = strict.split_rows(batch)
        strict.scores_of(valid).write.mode("overwrite").parquet(f"{valid_path}/batch={number}")
        bad.select("line", "reason").write.mode("overwrite").parquet(f"{bad_path}/batch={number}")

    return checked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
