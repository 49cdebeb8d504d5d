"""Resumable inventory: each archive file is processed once, across restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from ..sources import archives

FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def run_once(stream: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """Append what is new in ``stream`` to ``out`` and stop.

    The checkpoint records which inputs are done; a run that was stopped
    continues with the rest, and the file sink drops output of unfinished
    batches.
    """
    query = (
        transform(stream)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", out)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def inventory_stream(
    spark: SparkSession, root: str, out: str, checkpoint: str, files_per_batch: int = 1000
) -> None:
    """Member inventory of the archives below ``root`` that were not done before."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
        .filter(paths.is_archive(F.col("path")))
    )
    run_once(files, out, checkpoint, lambda df: archives.read_members(df).drop("head", "metadata"))


def table_inventory(
    spark: SparkSession, folder: str, name: str, schema: T.StructType, out: str, checkpoint: str,
    transform: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """The same loop over the Parquet table ``name`` in ``folder``, one file or a folder; returns the inventory so far."""
    # A plain path must be a folder; what a pattern finds may be either.
    files = spark.readStream.schema(schema).parquet(f"{folder}/{{{name}}}")
    run_once(files, out, checkpoint, transform)
    # With its schema, as a table without rows may leave no file behind.
    return spark.read.schema(transform(files).schema).parquet(out)
