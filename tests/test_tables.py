"""Intervals, sketches, SQL functions and bucketed tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strata.functions.sql import register_functions
from strata.operators import climate, diversity, intervals, ranges, sketches, turnover
from strata.sources import bucketed
from strata.sources.tables import occurrences


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_intervals_against_all_pairs(spark):
    """Lengths from nothing to far beyond all points, negative ends, points on ends, nulls, NaN and ends in the wrong order."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    spans = [(k, a := round(rng.uniform(-50, 600), 2), a + round(rng.choice([0, 0.001, 0.3, 5, 40, 700]) * rng.random(), 3)) for k in range(3000)] + [(3000, 5.0, 4.0), (3001, None, 4.0), (3002, 1.0, None), (3003, -1e9, 1e9), (3004, 8.0, 8.0), (3005, float("nan"), 3.0), (3006, 3.0, float("nan"))]
    points = [(k, round(rng.uniform(-60, 620), 2)) for k in range(400)] + [(400, spans[0][1]), (401, spans[1][2]), (402, None), (403, 8.0), (403, 8.0), (404, float("nan")), (405, 0.0), (406, -0.0)]
    p, s = spark.createDataFrame(points, "id long, age double").repartition(3), spark.createDataFrame(spans, "span long, a double, b double").repartition(4)
    found = intervals.within(p, s, "age", "a", "b")
    con = duckdb.connect()
    con.register("p", p.toPandas())
    con.register("s", s.toPandas())
    want = con.execute("select id, span from p join s on not isnan(age) and not isnan(a) and not isnan(b) and age between a and b").fetchall()
    assert sorted(map(tuple, found.select("id", "span").collect())) == sorted(want) and len(want) > 10_000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = plan(intervals.within(p, s, "age", "a", "b"))
        assert "SortMergeJoin" in shown and "NestedLoop" not in shown and "Cartesian" not in shown
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left = intervals.within(p, s, "age", "a", "b", how="left")
    assert left.count() == len(want) + len(points) - sum(any(w[0] == k for w in want) for k, _ in dict.fromkeys(points)) - 1
    assert intervals.within(p, s.limit(0), "age", "a", "b").count() == 0
    with pytest.raises(ValueError):
        intervals.within(p, s.withColumnRenamed("span", "id"), "age", "a", "b")


def test_curve_from_a_table(spark):
    ages = [(float(a),) for a in (-5, 0, 0.5, 10, 29.9, 30, 66.6, 252, 539, 540, 999)] + [(None,), (10.0,)]
    points = spark.createDataFrame(ages, "at double")
    knots = spark.createDataFrame([(float(a), float(t)) for a, t in climate.KNOTS], "age double, temperature double")
    found = sorted(((r.at, r.t) for r in intervals.interpolated(points, knots, "at", "t").collect()), key=str)
    want = sorted(((r.at, r.t) for r in points.select("at", climate.temperature(F.col("at")).alias("t")).collect()), key=str)
    assert [a for a, _ in found] == [a for a, _ in want] and all(x == y or x == pytest.approx(y) for (_, x), (_, y) in zip(found, want))


def test_sketches_merge(spark, sf_dir):
    """Sketches of overlapping parts give the estimate of all rows, whatever the parts, and that is near the truth."""
    occ = occurrences(spark, sf_dir).persist()
    part = F.pmod(F.crc32("occurrence_id"), F.lit(3))
    whole = sorted(map(tuple, sketches.sketched_diversity(sketches.diversity_sketches(occ)).collect()))
    pieces = sketches.merged(*(sketches.diversity_sketches(occ.filter(x)) for x in (part < 2, part > 0, part == 1)))
    assert sorted(map(tuple, sketches.sketched_diversity(pieces).collect())) == whole
    exact = {r.time_bin: r.diversity for r in diversity.diversity_curve(occ).collect()}
    assert exact.keys() == dict(whole).keys() and all(abs(n - exact[b]) <= 1 + 4 * sketches.relative_error() * exact[b] for b, n in whole)
    many = spark.range(200_000).select(F.col("id").cast("string").alias("genus"), (F.col("id") % 4 * 5.0).alias("mid_ma"), F.lit("s").alias("source_db"))
    for precision in (8, 12):
        errors = [abs(r.diversity / 50_000 - 1) for r in sketches.sketched_diversity(sketches.diversity_sketches(many, precision=precision)).collect()]
        assert max(errors) < 4 * sketches.relative_error(precision)
    occ.unpersist()


def test_sql_functions(spark, sf_dir):
    register_functions(spark)
    register_functions(spark)  # again changes nothing
    occ = occurrences(spark, sf_dir)
    occ.createOrReplaceTempView("some_occurrences")
    one = spark.sql("select time_bin(2.5, 5) a, time_bin(7.5, 5) b, time_bin(-0.1, 5) c, time_bin(null, 5) d, era(66) e, era(66.1) f, era(0) g, hemisphere(0) h, hemisphere(null) i, grid_cell(2.6, -177.6, 5) j").first()
    assert tuple(one) == (0.0, 10.0, 0.0, None, "Cenozoic", "Mesozoic", None, "Southern", None, "5.0,-180.0")
    eras = spark.sql("select era(mid_ma) as era, count(*) as occurrences from some_occurrences where era(mid_ma) is not null group by 1")
    assert sorted(map(tuple, eras.collect())) == sorted(map(tuple, ranges.era_counts(occ).select("era", "occurrences").collect()))
    assert "Python" not in plan(eras)
    for quota in (0.0, 0.3, 0.5, 1.0):
        found = spark.sql(f"select * from sqs(table(select time_bin(mid_ma, 5) as time_bin, genus, count(*) as n from some_occurrences where mid_ma is not null and genus is not null group by 1, 2) partition by (time_bin), {quota}d)")
        if quota:
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, diversity.sqs_diversity(occ, quota=quota).collect()))
        else:
            assert {r.sqs_diversity for r in found.collect()} == {0}


def test_bucketed_table_is_read_without_a_shuffle(spark, sf_dir, tmp_path):
    occ = occurrences(spark, sf_dir)
    table = bucketed.write_bucketed(occ, "bucketed_occurrences", 4, str(tmp_path / "b"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan as it is made
    try:
        found = ranges.genus_ranges(table)
        assert "Exchange" not in plan(found) and "Exchange" in plan(ranges.genus_ranges(occ))
        # what is left is the index of bins, some hundred rows, and the counts by bin
        assert "hashpartitioning(genus" not in plan(turnover.turnover_rates(table)) and "hashpartitioning(genus" in plan(turnover.turnover_rates(occ))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(map(str, found.collect())) == sorted(map(str, ranges.genus_ranges(occ).collect()))
    assert sorted(map(str, turnover.turnover_rates(table).collect())) == sorted(map(str, turnover.turnover_rates(occ).collect()))
    bucketed.drop_bucketed(spark, "bucketed_occurrences")
