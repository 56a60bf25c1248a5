"""Temperature through time and its correlation with diversity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.diversity import diversity_curve

#: Age in Ma and mean temperature in degrees Celsius, by age.
KNOTS = ((0, 14), (10, 14), (30, 18), (50, 24), (65, 22), (80, 24), (100, 26), (140, 22), (170, 20), (200, 19), (230, 22), (250, 25),
         (270, 16), (300, 12), (340, 14), (360, 20), (400, 22), (420, 20), (440, 16), (450, 12), (480, 18), (500, 22), (540, 24))


def temperature(age: Column) -> Column:
    """Linear between knots, constant outside of them."""
    pieces = [(b, F.lit(float(ta)) + (age - float(a)) * ((tb - ta) / (b - a))) for (a, ta), (b, tb) in zip(KNOTS, KNOTS[1:])]
    first = F.when(age <= KNOTS[0][0], float(KNOTS[0][1]))
    return reduce(lambda chain, piece: chain.when(age <= piece[0], piece[1]), pieces, first).when(age.isNotNull(), float(KNOTS[-1][1]))


def temperature_curve(spark: SparkSession, oldest: int = 540) -> DataFrame:
    """A row for each million years from 0."""
    time = F.col("id").cast("double")
    return spark.range(oldest + 1).select(time.alias("time"), temperature(time).alias("temperature"))


def climate_timeseries(occ: DataFrame, width: float = 5.0) -> DataFrame:
    return diversity_curve(occ, width).select("time_bin", "diversity", temperature(F.col("time_bin")).alias("temperature"))


def correlation(frame: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation; 0 where it is undefined."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return frame.agg(F.coalesce(F.try_divide(F.covar_pop(a, b), F.when(spread > 0, spread)), F.lit(0.0)).alias("correlation"))
