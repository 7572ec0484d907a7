"""Keeps the measures of files up to date as files arrive.

Measuring is a projection, so it runs on a stream as it is; each micro-batch is appended to a table under its own
number, which makes a repeated batch harmless.  Readers take the newest measures of each path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from arborspark.operators.totals import measured


def keep_measures(files: DataFrame, folder: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Starts a query that writes the measures of a stream (path, text, arrived) to ``folder``, one sub-folder a batch."""

    def append(batch: DataFrame, number: int) -> None:
        measured(batch).drop("text").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = files.select("path", "text", "arrived").writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def newest(spark: SparkSession, folder: str) -> DataFrame:
    """The last measures of each path."""
    rows = spark.read.parquet(folder)
    w = W.partitionBy("path").orderBy(F.desc("arrived"), F.desc("batch"))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "batch")
