"""The canonical table in buckets of genera, so that analyses by genus read it without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.sources.normalize import conform


def write_bucketed(occ: DataFrame, table: str, buckets: int = 64, folder: str | None = None) -> DataFrame:
    """Writes ``occ`` as the catalog's ``table``, bucketed and sorted by genus within each source, in ``folder`` or the warehouse; returns the table.

    Rows are dealt to as many tasks as buckets before the write, so each bucket of a source is one file.  A genus's rows are in one bucket: take more
    buckets for larger tables, and drop null genera (they share one) where no analysis needs them.
    """
    writer = conform(occ).repartition(buckets, "genus").write.mode("overwrite").bucketBy(buckets, "genus").sortBy("genus")
    writer = writer.option("path", folder) if folder else writer
    writer.saveAsTable(table)
    return occ.sparkSession.table(table)


def drop_bucketed(spark: SparkSession, table: str) -> None:
    spark.sql(f"drop table if exists {table}")
