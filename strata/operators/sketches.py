"""Diversity from sketches that are stored and merged, without the rows that made them.

Each download adds a small table: a HyperLogLog sketch of genera for each source and bin.  Sketches of overlapping downloads merge to that of
their union, as a genus counts once however often it comes.  The relative standard error is about 0.83 / sqrt(2 ** precision).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.diversity import binned

PRECISION = 12


def diversity_sketches(occ: DataFrame, width: float = 5.0, precision: int = PRECISION) -> DataFrame:
    """(source_db, time_bin, occurrences, sketch) of rows with age and genus."""
    return binned(occ, width).groupBy("source_db", "time_bin").agg(F.count("*").alias("occurrences"), F.hll_sketch_agg("genus", precision).alias("sketch"))


def merged(*tables: DataFrame) -> DataFrame:
    """One sketch for each source and bin of all tables; occurrences add up, also those of downloads that overlap."""
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("source_db", "time_bin").agg(F.sum("occurrences").alias("occurrences"), F.hll_union_agg("sketch").alias("sketch"))


def sketched_diversity(sketches: DataFrame) -> DataFrame:
    """(time_bin, diversity): estimated genera of each bin over all sources."""
    return sketches.groupBy("time_bin").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("diversity"))


def relative_error(precision: int = PRECISION) -> float:
    """Standard error of an estimate as a share of the true number."""
    return 0.8326 / 2 ** (precision / 2)
