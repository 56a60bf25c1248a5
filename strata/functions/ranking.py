"""Ranks over large groups without putting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled_rank(frame: DataFrame, groups: list[str], noise: Column, name: str, buckets: int | None = None) -> DataFrame:
    """``frame`` with ``name``: each row's rank (from 0) in its group by a 64-bit hash ``noise``, whose equal values follow the rows.

    Hashes fall into ordered buckets (64, or ``spark.sql.shuffle.partitions`` if more); a row's rank is its rank within its bucket plus the number of rows in the buckets before.
    """
    buckets = buckets or max(64, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.floor((noise.cast("double") / 2.0**64 + 0.5) * buckets).cast("int")
    marked = frame.withColumns({"_noise": noise}).withColumn("_bucket", F.least(F.greatest(bucket, F.lit(0)), F.lit(buckets - 1)))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = marked.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n")).withColumn("_base", F.sum("_n").over(before) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy("_noise", *frame.columns)) - 1
    return marked.withColumn("_within", within).join(bases, [*groups, "_bucket"]).select(*frame.columns, (F.col("_within") + F.col("_base")).alias(name))


def bin_index(occ: DataFrame, column: str = "time_bin", name: str = "bin_index") -> DataFrame:
    """Each distinct bin with its index among the observed ones, oldest first, from 0 (some hundred rows whatever the input)."""
    return occ.select(column).distinct().withColumn(name, F.row_number().over(Window.orderBy(F.desc(column))) - 1)
