"""Origination and extinction between observed time bins, and the features of the extinction model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.numeric import bin_to
from strata.functions.ranking import bin_index
from strata.operators.diversity import PLACED, binned


def _presence(rows: DataFrame, *keep) -> DataFrame:
    """Distinct (bin_index, genus) and the index of the genus's bin before and after it."""
    index = F.broadcast(bin_index(rows))  # one row for each bin on a fixed time scale
    there = rows.join(index, "time_bin").groupBy("genus", "time_bin", "bin_index").agg(*keep) if keep else rows.join(index, "time_bin").select("genus", "time_bin", "bin_index").distinct()
    by_genus = Window.partitionBy("genus").orderBy("bin_index")
    return there.withColumns({"before": F.lag("bin_index").over(by_genus), "after": F.lead("bin_index").over(by_genus), "seen": F.row_number().over(by_genus) - 1})


def turnover_rates(occ: DataFrame, width: float = 5.0) -> DataFrame:
    """Per observed bin: genera, those absent from the next older observed bin, those absent from the next younger one, and rates.

    In the oldest bin all genera originate, in the youngest all go extinct.
    """
    there = _presence(binned(occ, width).select("time_bin", "genus"))
    new = F.col("before").isNull() | (F.col("before") != F.col("bin_index") - 1)
    gone = F.col("after").isNull() | (F.col("after") != F.col("bin_index") + 1)
    sums = there.groupBy("time_bin").agg(F.count("*").alias("total_genera"), F.count_if(new).alias("originations"), F.count_if(gone).alias("extinctions"))
    rate = lambda c: F.col(c).cast("double") / F.col("total_genera")
    return sums.withColumns({"origination_rate": rate("originations"), "extinction_rate": rate("extinctions")})


def mass_extinctions(rates: DataFrame, sigmas: float = 2.0, exclude_edge_bins: bool = False) -> DataFrame:
    """``rates`` with ``is_mass_extinction``: rate above the mean plus ``sigmas`` population standard deviations of all bins."""
    inner = rates
    if exclude_edge_bins:
        ends = rates.agg(F.min("time_bin").alias("lo"), F.max("time_bin").alias("hi"))
        inner = rates.join(F.broadcast(ends), (F.col("time_bin") > F.col("lo")) & (F.col("time_bin") < F.col("hi"))).drop("lo", "hi")
    level = inner.agg((F.avg("extinction_rate") + F.lit(sigmas) * F.stddev_pop("extinction_rate")).alias("level"))
    flagged = rates.join(F.broadcast(level))
    if exclude_edge_bins:
        flagged = flagged.join(F.broadcast(ends)).withColumn("level", F.when((F.col("time_bin") > F.col("lo")) & (F.col("time_bin") < F.col("hi")), F.col("level"))).drop("lo", "hi")
    return flagged.withColumn("is_mass_extinction", F.coalesce(F.col("extinction_rate") > F.col("level"), F.lit(False))).drop("level")


def extinction_features(occ: DataFrame, width: float = 5.0, cell: float = 5.0, with_environment: bool = True) -> DataFrame:
    """A row for each genus in each bin but the youngest one, with its features there and whether it is absent from the next bin."""
    rows = binned(occ, width, PLACED).withColumn("locality", F.struct(bin_to("lat", cell).alias("lat_bin"), bin_to("lng", cell).alias("lng_bin")))
    features = [F.count_distinct("locality").alias("geographic_range"), F.count("*").alias("abundance"), (F.max("lat") - F.min("lat")).alias("lat_range")]
    if with_environment:
        features.append(F.count_distinct("environment").alias("env_breadth"))
    youngest = F.broadcast(rows.agg(F.min("time_bin").alias("youngest")))
    there = _presence(rows, *features).join(youngest).filter(F.col("time_bin") > F.col("youngest"))
    extinct = F.when(F.col("after") == F.col("bin_index") + 1, 0).otherwise(1).cast("long")
    named = ["geographic_range", "abundance", "lat_range"] + ["env_breadth"] * with_environment
    return there.select("genus", "time_bin", *named, F.col("seen").cast("long").alias("age"), extinct.alias("extinct_next_bin"))


def extinction_rate(features: DataFrame) -> DataFrame:
    return features.agg(F.count("*").alias("samples"), F.avg("extinct_next_bin").alias("extinction_rate"))
