"""Manuscripts checked as they arrive: a folder of Parquet or text that grows, and findings appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.report import check_corpus


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """A stream of manuscripts(doc_id, text, bib, language) from text files that are put into a folder."""
    raw = spark.readStream.text(path, wholetext=True)
    return raw.select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), T.normalize(F.col("value")).alias("text"), F.lit("").alias("bib"), T.language(F.col("value")).alias("language"))


def check_arrivals(stream: DataFrame, out: str, checkpoint: str):
    """Start a query that checks each batch and appends its findings to `out`; documents are whole, so no state is kept.

    A batch that is repeated after a failure replaces what it wrote before: its number is a partition of the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = check_corpus(batch)  # the batch's files are read once, as its manuscripts are persisted
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")
        found.prepared.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
