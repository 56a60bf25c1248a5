"""Points in intervals of a table, joined by equality.

Each interval has a level, the least power of two that is as long as it, and lies in two cells of that level at most; a point has one cell on each level
that the table has (some dozens, whatever its rows).  Points and intervals meet by (level, cell), and the exact condition decides, so the join is
a hash or merge join and never a nested loop, for any number of overlapping intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.numeric import bin_to


def _level(length: Column, finest: int) -> Column:
    return F.when(length > 0, F.greatest(F.ceil(F.log2(length)).cast("int"), F.lit(finest))).otherwise(finest)


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("long")


def within(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, finest: int = -6, how: str = "inner") -> DataFrame:
    """``points`` joined with the ``intervals`` where ``low <= at <= high``; ``how``: inner, or left to keep points without any.

    Columns of both sides have different names.  Null or NaN points and ends meet nothing; an interval whose ends are in the wrong order is empty.  Levels
    run from ``finest`` (shorter intervals are there too) to that of the longest interval; they are counted first.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    if clash := {c.lower() for c in points.columns} & {c.lower() for c in intervals.columns}:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    level = _level(F.col(high) - F.col(low), finest)
    kept = intervals.filter((F.col(low) <= F.col(high)) & ~F.isnan(high)).withColumn("_level", level)
    levels = sorted(r["_level"] for r in kept.select("_level").distinct().collect())  # powers of two: some dozens
    cells = kept.withColumn("_cell", F.explode(F.sequence(_cell(F.col(low), F.col("_level")), _cell(F.col(high), F.col("_level")))))
    on_levels = F.array(*(F.struct(F.lit(k).alias("level"), _cell(F.col(at), F.lit(k)).alias("cell")) for k in levels)) if levels else F.array().cast("array<struct<level:int,cell:bigint>>")
    if how == "inner":
        keyed = points.filter(F.col(at).isNotNull() & ~F.isnan(at)).withColumn("_key", F.explode(on_levels))
        met = keyed.join(cells, (F.col("_key.level") == F.col("_level")) & (F.col("_key.cell") == F.col("_cell")) & F.col(at).between(F.col(low), F.col(high)))
        return met.select(*points.columns, *intervals.columns)
    distinct = points.select(F.col(at).alias("_at")).distinct()  # a point's intervals follow from its place alone
    found = within(distinct, intervals, "_at", low, high, finest)
    return points.join(found, F.col(at) == F.col("_at"), "left").drop("_at")


def range_through_diversity(occ: DataFrame, width: float = 5.0) -> DataFrame:
    """(time_bin, standing_diversity): genera whose range spans each observed bin, seen there or not."""
    rows = occ.dropna(subset=["mid_ma", "genus"]).select("genus", bin_to("mid_ma", width).alias("time_bin"))
    spans = rows.groupBy("genus").agg(F.min("time_bin").alias("youngest"), F.max("time_bin").alias("oldest"))
    bins = rows.select("time_bin").distinct()
    return within(bins, spans, "time_bin", "youngest", "oldest").groupBy("time_bin").agg(F.count("*").alias("standing_diversity"))


def segments(knots: DataFrame, at: str = "age", value: str = "temperature") -> DataFrame:
    """(from_at, to_at, from_value, to_value) between neighbouring knots of a curve; its first and last values go on to both sides."""
    far = float(1 << 40)
    by = Window.orderBy(at)  # a curve's knots, not the points
    pairs = knots.select(F.col(at).alias("from_at"), F.col(value).alias("from_value"), F.lead(at).over(by).alias("to_at"), F.lead(value).over(by).alias("to_value"), F.lag(at).over(by).alias("before"))
    inner = pairs.select("from_at", F.coalesce("to_at", F.lit(far)).alias("to_at"), "from_value", F.coalesce("to_value", "from_value").alias("to_value"))
    first = pairs.filter("before is null").select(F.lit(-far).alias("from_at"), F.col("from_at").alias("to_at"), "from_value", F.col("from_value").alias("to_value"))
    return inner.unionByName(first)


def interpolated(points: DataFrame, knots: DataFrame, at: str, name: str, knot_at: str = "age", knot_value: str = "temperature") -> DataFrame:
    """``points`` with ``name``, the curve of ``knots`` at ``at``: linear between them, constant outside; null for null points."""
    met = within(points, segments(knots, knot_at, knot_value), at, "from_at", "to_at", how="left")
    share = F.try_divide(F.col(at) - F.col("from_at"), F.when(F.col("from_value") != F.col("to_value"), F.col("to_at") - F.col("from_at")))
    value = F.col("from_value") + F.coalesce(share, F.lit(0.0)) * (F.col("to_value") - F.col("from_value"))
    inside = (F.col(at) < F.col("to_at")) | F.col("to_at").isNull()  # a point on a knot meets two segments
    return met.filter(inside).select(*points.columns, value.alias(name))
