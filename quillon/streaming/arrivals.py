"""The same checks on manuscripts that arrive in a folder.

A check is a map from documents to rows, so it runs on a stream as it stands.
Checks that join or aggregate run on each micro-batch and append their findings;
a batch that is repeated after a failure overwrites its own folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def manuscripts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (the path) and text of files as they arrive."""
    rows = spark.readStream.format("text").option("wholetext", "true").load(folder)
    return rows.select(F.col("_metadata.file_path").alias("doc_id"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def audit(arriving: DataFrame, check: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataStreamWriter:
    """A writer that puts each batch's findings under ``out/batch=N``."""

    def write(batch: DataFrame, number: int) -> None:
        check(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
