"""Diversity through time: observed, shareholder-quorum subsampled, and latitudinal centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.numeric import bin_to

DATED = ("mid_ma", "genus")
PLACED = ("mid_ma", "lat", "lng", "genus")


def binned(occ: DataFrame, width: float = 5.0, required: tuple[str, ...] = DATED) -> DataFrame:
    """Occurrences with all ``required`` columns, and their ``time_bin``."""
    return occ.dropna(subset=list(required)).withColumn("time_bin", bin_to("mid_ma", width))


def diversity_curve(occ: DataFrame, width: float = 5.0, required: tuple[str, ...] = DATED) -> DataFrame:
    """Distinct genera per time bin."""
    return binned(occ, width, required).groupBy("time_bin").agg(F.count_distinct("genus").alias("diversity"))


def sqs_diversity(occ: DataFrame, quota: float = 0.5, width: float = 5.0, required: tuple[str, ...] = DATED, float_compat: bool = False) -> DataFrame:
    """Smallest number of most frequent genera whose joint frequency reaches ``quota``; all genera if none does.

    Exact by integer counts.  ``float_compat`` adds up frequencies as doubles, which may take one genus more at an exact tie.
    """
    counts = binned(occ, width, required).groupBy("time_bin", "genus").agg(F.count("*").alias("n"))
    by_bin = Window.partitionBy("time_bin")
    order = by_bin.orderBy(F.desc("n"), "genus").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(by_bin)
    if float_compat:
        share = (F.col("n") / total).alias("share")
        ranked = counts.select("time_bin", "genus", "n", share).withColumn("cum", F.sum("share").over(order))
        before = F.lag("cum", 1, 0.0).over(by_bin.orderBy(F.desc("n"), "genus"))
        taken = ranked.withColumn("taken", before < quota)
    else:
        taken = counts.withColumn("taken", F.sum("n").over(order) - F.col("n") < F.lit(float(quota)) * total)
    return taken.groupBy("time_bin").agg(F.count_if("taken").alias("sqs_diversity"))


def latitudinal_centroid(occ: DataFrame, width: float = 5.0, min_rows: int = 100) -> DataFrame:
    """Mean absolute latitude, rows and genera of bins with at least ``min_rows`` placed occurrences."""
    return (binned(occ, width, PLACED).groupBy("time_bin")
            .agg(F.avg(F.abs("lat")).alias("mean_abs_lat"), F.count("*").alias("n"), F.count_distinct("genus").alias("diversity"))
            .filter(F.col("n") >= min_rows))
