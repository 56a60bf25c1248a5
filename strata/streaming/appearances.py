"""First and last appearances of genera as a stream with state.

Files arrive in any order and may overlap: a late row can move a genus's first appearance; an identifier that was there before is not counted again
(if it comes with another age, that widens the range, so the result is the same in any order).
Identifiers are remembered by the engine's own deduplication, spread over all tasks by genus, source and identifier, so that a genus with a third of
all rows is many keys; no Python runs for each row.  A batch adds, by genus and ``slot``, the range of its rows and the number of its new identifiers;
``appearances`` joins all batches in one aggregation.

``write_ranges`` remembers identifiers with their age: there a row that comes again with another age is another row.

Rows without age or genus don't count; rows without identifier count each time.  Needs the RocksDB state store, whose state may be larger than
memory and of which a checkpoint writes changes only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "genus string, slot int, first_appearance double, last_appearance double, occurrences long"
SLOTS = 64


def new_appearances(stream: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(genus, slot, mid_ma, n): the age of each row, and with ``n`` = 1 each identifier of a genus once and each row without one."""
    slot = F.pmod(F.xxhash64("source_db", "occurrence_id", F.when(F.col("occurrence_id").isNull(), F.col("mid_ma"))), F.lit(slots)).cast("int")
    rows = stream.dropna(subset=["mid_ma", "genus"]).select("genus", slot.alias("slot"), "source_db", "occurrence_id", "mid_ma")
    known = rows.filter("occurrence_id is not null").select("genus", "slot", "source_db", "occurrence_id").dropDuplicates()
    ages = rows.select("genus", "slot", "mid_ma", F.col("occurrence_id").isNull().cast("long").alias("n"))
    return ages.unionByName(known.select("genus", "slot", F.lit(None).cast("double").alias("mid_ma"), F.lit(1).cast("long").alias("n")))


def write_appearances(stream: DataFrame, out: str, checkpoint: str, slots: int = SLOTS) -> StreamingQuery:
    """Adds what each batch brought to ``out`` as a table of its own, under the batch's number: a batch that runs again writes the same."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)

    def put(batch: DataFrame, number: int) -> None:
        spans = batch.groupBy("genus", "slot").agg(F.max("mid_ma").alias("first_appearance"), F.min("mid_ma").alias("last_appearance"), F.sum("n").alias("occurrences"))
        spans.write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    return new_appearances(stream, slots).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def appearances(spark: SparkSession, out: str) -> DataFrame:
    """(genus, first_appearance, last_appearance, occurrences, duration) so far, as ``ranges.genus_ranges`` gives them for all rows."""
    held = spark.read.schema(f"{OUT}, batch int").option("basePath", out).parquet(out)
    spans = held.groupBy("genus").agg(F.max("first_appearance").alias("first_appearance"), F.min("last_appearance").alias("last_appearance"), F.sum("occurrences").alias("occurrences"))
    return spans.withColumn("duration", F.col("first_appearance") - F.col("last_appearance"))


def compact(spark: SparkSession, out: str, to: str) -> None:
    """One row for each key of ``out`` as the only table of ``to``, between two runs of the stream."""
    held = spark.read.schema(f"{OUT}, batch int").option("basePath", out).parquet(out)
    joined = held.groupBy("genus", "slot").agg(F.max("first_appearance").alias("first_appearance"), F.min("last_appearance").alias("last_appearance"), F.sum("occurrences").alias("occurrences"), F.max("batch").alias("batch"))
    joined.write.partitionBy("batch").parquet(to)


RANGES = "genus string, first_appearance double, last_appearance double, occurrences long"


def write_ranges(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Adds ranges and counts of each batch's new rows by genus to ``out``, under the batch's number."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    rows = stream.dropna(subset=["mid_ma", "genus"]).select("source_db", "occurrence_id", "genus", "mid_ma")
    named = rows.filter("occurrence_id is not null").dropDuplicates()
    each = named.unionByName(rows.filter("occurrence_id is null"))

    def put(batch: DataFrame, number: int) -> None:
        spans = batch.groupBy("genus").agg(F.max("mid_ma").alias("first_appearance"), F.min("mid_ma").alias("last_appearance"), F.count("*").alias("occurrences"))
        spans.write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    return each.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def ranges_so_far(spark: SparkSession, out: str) -> DataFrame:
    """(genus, first_appearance, last_appearance, occurrences, duration) of all that ``write_ranges`` added."""
    held = spark.read.schema(f"{RANGES}, batch int").option("basePath", out).parquet(out)
    spans = held.groupBy("genus").agg(F.max("first_appearance").alias("first_appearance"), F.min("last_appearance").alias("last_appearance"), F.sum("occurrences").alias("occurrences"))
    return spans.withColumn("duration", F.col("first_appearance") - F.col("last_appearance"))
