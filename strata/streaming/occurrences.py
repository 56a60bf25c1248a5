"""Canonical occurrences as a stream: files that arrive are added to running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.functions.numeric import bin_to
from strata.sources.schema import SCHEMA


def occurrence_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of canonical occurrences as they arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_genera(stream: DataFrame, width: float = 5.0) -> DataFrame:
    """Occurrences of each genus in each bin so far; diversity is the number of its rows per bin."""
    rows = stream.dropna(subset=["mid_ma", "genus"])
    return rows.groupBy(bin_to("mid_ma", width).alias("time_bin"), "genus").agg(F.count("*").alias("occurrences"))


def write_running_genera(stream: DataFrame, out: str, checkpoint: str, width: float = 5.0) -> StreamingQuery:
    """Keeps the table at ``out`` at the counts so far, from all files there were (each batch writes a new version)."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version={number:09d}")

    return running_genera(stream, width).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
