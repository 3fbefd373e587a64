"""Incremental checks over a drop folder of cells, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamgrid.functions import text as tx

CELLS = "source_name string, page_index int, table_index int, row_id int, col_id int, text string, confidence double, arrived timestamp"


def cells(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Cells of Parquet files as they arrive."""
    return spark.readStream.schema(CELLS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def flag_counts(stream: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, source_name, flag, n): findings of single cells in tumbling windows of arrival; state older than ``late`` is dropped."""
    found = stream.withWatermark("arrived", late).select("arrived", "source_name", F.explode(tx.cell_flags(F.col("text"), F.col("confidence"))).alias("flag"))
    return found.groupBy(F.window("arrived", window).alias("w"), "source_name", "flag").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "source_name", "flag", "n")


def each_batch(stream: DataFrame, apply: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Writes ``apply`` of every batch, a folder each: a batch that runs again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        apply(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
