"""All registered queries and their DuckDB counterparts."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import sql as functions
from strata.functions.shared import shared_folder, written
from strata.operators import climate, communities, diversity, extinction_model, intervals, network, ranges, sketches, taxonomy, turnover
from strata.sources import bucketed, normalize, services
from strata.sources.schema import COLUMNS
from strata.streaming import appearances
from strata.streaming import occurrences as stream
from strata.sources.tables import OCCURRENCES_SQL, occurrences, raw_neotoma, raw_pbdb, record_neotoma, record_pbdb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Names that mark the demonstration data's clade.
CLADE = ("Brand#1", "Brand#2", "Brand#3")
_CLADE = "('Brand#1', 'Brand#2', 'Brand#3')"


def _bin(column: str, width: int = 5) -> str:
    return f"(round_even({column}/{width}.0e0, 0)*{width}.0e0 + 0.0e0)"


def _add(name: str, build: Callable[[DataFrame], DataFrame], *ctes: str) -> None:
    """``ctes``: further common table expressions; the last item is the query itself."""
    QUERIES[name] = lambda spark, sf_dir: build(occurrences(spark, sf_dir))
    if ctes:
        ORACLE_SQL[name] = f"with recursive {', '.join([OCCURRENCES_SQL, *ctes[:-1]])} {ctes[-1]}"


def _rounded(build: Callable[[DataFrame], DataFrame], *columns: str, places: int = 6) -> Callable[[DataFrame], DataFrame]:
    """Doubles from sums are rounded for comparison, as their last digits depend on the order of rows."""
    return lambda occ: (out := build(occ)).withColumns({c: F.round(out[c], places) for c in columns})


DATED = f"dated as (select *, {_bin('mid_ma')} as time_bin from occ where mid_ma is not null and genus is not null)"
PLACED = f"placed as (select *, {_bin('mid_ma')} as time_bin, {_bin('lat')} as lat_bin, {_bin('lng')} as lng_bin from occ where mid_ma is not null and genus is not null and lat is not null and lng is not null)"
RANGES = "ranges as (select genus, max(mid_ma) as first_appearance, min(mid_ma) as last_appearance, count(*) as occurrences, max(mid_ma)-min(mid_ma) as duration from dated group by genus)"
MESOZOIC = "meso as (select * from placed where mid_ma between 66 and 252)"
WHOLE = "printf('%.0f', round_even({}, 0))"
ONE = "round_even({}, 1)"
TEMPERATURE = "case when {t} <= 0 then 14.0e0 " + " ".join(f"when {{t}} <= {b} then {ta}.0e0 + ({{t}} - {a}.0e0) * ({tb - ta}.0e0/{b - a}.0e0)" for (a, ta), (b, tb) in zip(climate.KNOTS, climate.KNOTS[1:])) + " else 24.0e0 end"
INDEXED = "bins as (select time_bin, row_number() over (order by time_bin desc) as i from (select distinct time_bin from {rows}))"
SPREAD = "flags as (select event, genus, bool_or(mid_ma <= hi and mid_ma > hi-15) as before, bool_or(mid_ma >= lo and mid_ma < lo+15) as after from dated, (values ('End-Permian (252 Ma)', 260.0e0, 245.0e0), ('End-Triassic (201 Ma)', 210.0e0, 195.0e0), ('End-Cretaceous (66 Ma)', 70.0e0, 60.0e0)) e(event, hi, lo) group by 1, 2)"

_add("diversity_curve", diversity.diversity_curve, DATED, "select time_bin, count(distinct genus) as diversity from dated group by 1")
_add("diversity_curve_geo", lambda o: diversity.diversity_curve(o, required=diversity.PLACED), PLACED, "select time_bin, count(distinct genus) as diversity from placed group by 1")
_SQS = ("counts as (select time_bin, genus, count(*) as n from dated group by 1, 2)",
        "cum as (select time_bin, n, sum(n) over (partition by time_bin order by n desc, genus rows unbounded preceding) as c, sum(n) over (partition by time_bin) as t from counts)")
_add("sqs_diversity", diversity.sqs_diversity, DATED, *_SQS, "select time_bin, count(*) filter (2*(c-n) < t) as sqs_diversity from cum group by 1")
_add("sqs_diversity_float", lambda o: diversity.sqs_diversity(o, float_compat=True), DATED, _SQS[0],
     "shares as (select time_bin, n / sum(n) over (partition by time_bin) as share, row_number() over (partition by time_bin order by n desc, genus) as k from counts)",
     "taken as (select distinct time_bin, 0 as k, 0.0e0 as so_far from shares union all select t.time_bin, t.k + 1, t.so_far + s.share from taken t join shares s on s.time_bin = t.time_bin and s.k = t.k + 1 where t.so_far < 0.5e0)",
     "select time_bin, max(k)::bigint as sqs_diversity from taken group by 1")
_add("latitudinal_centroid", _rounded(diversity.latitudinal_centroid, "mean_abs_lat"), PLACED,
     "select time_bin, round(avg(abs(lat)), 6) as mean_abs_lat, count(*) as n, count(distinct genus) as diversity from placed group by 1 having count(*) >= 100")

_RATES = (DATED, INDEXED.format(rows="dated"), "there as (select distinct genus, time_bin, i from dated join bins using (time_bin))",
          "near as (select *, lag(i) over (partition by genus order by i) as before, lead(i) over (partition by genus order by i) as after from there)",
          "rates as (select time_bin, count(*) as total_genera, count(*) filter (before is null or before <> i-1) as originations, count(*) filter (after is null or after <> i+1) as extinctions from near group by 1)",
          "shares as (select *, originations::double/total_genera as origination_rate, extinctions::double/total_genera as extinction_rate from rates)")
_SHOWN = ("origination_rate", "extinction_rate")
_add("turnover_rates", _rounded(turnover.turnover_rates, *_SHOWN), *_RATES, "select time_bin, total_genera, originations, extinctions, round(origination_rate, 6) as origination_rate, round(extinction_rate, 6) as extinction_rate from shares")
_add("mass_extinctions", _rounded(lambda o: turnover.mass_extinctions(turnover.turnover_rates(o)), *_SHOWN), *_RATES,
     "select time_bin, total_genera, originations, extinctions, round(origination_rate, 6) as origination_rate, round(extinction_rate, 6) as extinction_rate, extinction_rate > (select avg(extinction_rate) + 2*stddev_pop(extinction_rate) from shares) as is_mass_extinction from shares")

_add("mass_extinctions_inner", _rounded(lambda o: turnover.mass_extinctions(turnover.turnover_rates(o), exclude_edge_bins=True), *_SHOWN), *_RATES,
     "inner_bins as (select * from shares where time_bin > (select min(time_bin) from shares) and time_bin < (select max(time_bin) from shares))",
     "select s.time_bin, s.total_genera, s.originations, s.extinctions, round(s.origination_rate, 6) as origination_rate, round(s.extinction_rate, 6) as extinction_rate, coalesce(i.extinction_rate > (select avg(extinction_rate) + 2*stddev_pop(extinction_rate) from inner_bins), false) as is_mass_extinction from shares s left join inner_bins i using (time_bin)")

_add("genus_ranges", ranges.genus_ranges, DATED, RANGES, "select * from ranges")
_TOP = "select genus, " + ", ".join(f"{ONE.format(c)} as {n}" for c, n in (("first_appearance", "first_appearance"), ("last_appearance", "last_appearance"), ("duration", "duration_myr"))) + f", occurrences, concat({WHOLE.format('first_appearance')}, '-', {WHOLE.format('last_appearance')}, ' Ma') as age_range from (select * from ranges where duration > 0 {{more}} order by duration desc, genus limit 15)"
_add("survivor_champions", ranges.survivor_champions, DATED, RANGES, _TOP.format(more=""))
_add("survivor_champions_min3", lambda o: ranges.survivor_champions(o, more_than=2), DATED, RANGES, _TOP.format(more="and occurrences > 2"))
_add("most_common_genera", ranges.most_common_genera, DATED, RANGES, f"select genus, occurrences, concat({WHOLE.format('first_appearance')}, '-', {WHOLE.format('last_appearance')}) as age_range from ranges order by occurrences desc, genus limit 10")
_add("rarest_genera", ranges.rarest_genera, DATED, "select genus, count(*) as occurrences, round_even(avg(mid_ma), 1) as age_ma from dated group by 1 order by 2, 1 limit 10")
_add("geographic_champions", ranges.geographic_champions, PLACED, f"select genus, count(distinct ({_bin('lat', 10)}, {_bin('lng', 10)})) as unique_regions from placed group by 1 order by 2 desc, 1 limit 10")
_add("extinction_events", ranges.extinction_events, DATED, SPREAD,
     "sums as (select event, count(*) filter (before) as genera_before, count(*) filter (after) as genera_after, count(*) filter (before and after) as genera_surviving from flags where before or after group by 1)",
     "select *, round_even(genera_surviving/genera_before*100, 1) as survival_rate from sums where genera_before > 0 and genera_after > 0")
_add("extinction_event_members", ranges.extinction_event_members, DATED, SPREAD,
     "kinds as (select event, case when before and after then 'survivor' when before then 'victim' else 'newcomer' end as kind, genus from flags where before or after)",
     "select * from (select event, kind, genus, row_number() over (partition by event, kind order by genus) as position from kinds) where position <= 10")
_HISTOGRAM = f"hist as (select {_bin('first_appearance', 10)} as time_ma, count(*) as new_genera from ranges group by 1)"
_add("origination_histogram", ranges.origination_histogram, DATED, RANGES, _HISTOGRAM, "select * from hist")
_add("peak_origination", ranges.peak_origination, DATED, RANGES, _HISTOGRAM, "select * from hist order by new_genera desc, time_ma limit 1")
_add("global_stats", ranges.global_stats, DATED, "select count(*) as total_occurrences, count(distinct genus) as total_genera, max(mid_ma) as oldest, min(mid_ma) as youngest from dated")
_add("era_counts", ranges.era_counts, "select case when mid_ma <= 66 then 'Cenozoic' when mid_ma <= 252 then 'Mesozoic' else 'Paleozoic' end as era, count(*) as occurrences from occ where mid_ma > 0 and mid_ma <= 541 group by 1")
_add("occurrence_map", ranges.occurrence_map, "select lat, lng, count(*) as occurrences from occ where lat is not null and lng is not null group by 1, 2")
_add("mesozoic_top_genera", ranges.mesozoic_top_genera, PLACED, MESOZOIC, "select genus, count(*) as occurrences, round_even(avg(mid_ma), 0) as avg_age_ma from meso group by 1 order by 2 desc, 1 limit 15")
_add("period_breakdown", ranges.period_breakdown, PLACED, MESOZOIC,
     "select p.period, count(distinct genus) as genera, count(genus) as occurrences from (values ('Triassic'), ('Jurassic'), ('Cretaceous')) p(period) left join meso on p.period = case when mid_ma > 201 then 'Triassic' when mid_ma > 145 then 'Jurassic' else 'Cretaceous' end group by 1")
_add("hemisphere_diversity", ranges.hemisphere_diversity, PLACED, MESOZOIC, "select case when lat > 0 then 'Northern' else 'Southern' end as hemisphere, count(distinct genus) as genera from meso group by 1")
_EXPLORER = (PLACED, "refs as (select genus, primary_reference, row_number() over (partition by genus order by count(*) desc, primary_reference) as k from placed where primary_reference is not null group by 1, 2)",
             "explorer as (select genus, min(mid_ma) as min_age, max(mid_ma) as max_age, count(*) as occurrences, coalesce(any_value(r.primary_reference), 'Unknown') as reference from placed left join (select genus, primary_reference from refs where k = 1) r using (genus) group by 1)")
_add("genus_explorer", ranges.genus_explorer, *_EXPLORER, "select * from explorer")
_add("explorer_search", lambda o: ranges.explorer_search(ranges.genus_explorer(o), "g12"), *_EXPLORER, "select * from explorer where contains(lower(genus), 'g12')")
_add("explorer_page", lambda o: ranges.explorer_page(ranges.genus_explorer(o), 3), *_EXPLORER, "select * from explorer order by occurrences desc, genus limit 15 offset 30")
_add("quality_report", normalize.quality_report, "select source_db, count(*) as occurrences, count(mid_ma) as dated, min(mid_ma) as youngest, max(mid_ma) as oldest from occ group by 1")
_add("running_genera", stream.running_genera, DATED, "select time_bin, genus, count(*) as occurrences from dated group by 1, 2")
_add("normalized", normalize.conform, "select * from occ")
_add("normalized_pbdb", lambda o: normalize.normalize_pbdb(normalize.without_missing(raw_pbdb(o))), "select * replace ((max_ma + min_ma) / 2 as mid_ma, 'PBDB' as source_db) from occ")
_KNOWN = ("occurrence_id", "scientific_name", "mid_ma", "lat", "lng", "source_db")
_add("normalized_neotoma", lambda o: normalize.normalize_neotoma(raw_neotoma(o)),
     "select * replace (case when genus is not null then mid_ma end as mid_ma, 'Neotoma' as source_db, " + ", ".join(f'null::{"double" if c.endswith("_ma") else "varchar"} as "{c}"' for c in COLUMNS if c not in _KNOWN) + ") from occ")


def _pbdb_source(occ: DataFrame) -> DataFrame:
    """Recorded answers, an interval each, read through the data source by their executors."""
    spark = occ.sparkSession
    services.register(spark)
    folder = record_pbdb(occ, shared_folder(spark, "pbdb"))
    source = spark.read.format("pbdb").option("transport", "strata.sources.services:recorded").option("recorded", folder).option("intervals", "Cenozoic;Mesozoic;Paleozoic;Older")
    return normalize.normalize_pbdb(normalize.without_missing(source.load()))


def _neotoma_source(occ: DataFrame) -> DataFrame:
    """Recorded pages, read by offset."""
    spark, page = occ.sparkSession, 10_000
    services.register(spark)
    folder, pages = record_neotoma(occ, shared_folder(spark, "neotoma"), page)
    source = spark.read.format("neotoma").option("transport", "strata.sources.services:recorded").option("recorded", folder).option("page", page).option("limit", pages * page)
    return normalize.normalize_neotoma(services.neotoma_rows(source.load()))


def _streamed(occ: DataFrame, write: Callable, read: Callable) -> DataFrame:
    """The table as files that arrive in two runs of a stream, the second of which brings a third of the rows again."""
    spark = occ.sparkSession
    incoming, out, state = (shared_folder(spark, n) for n in ("incoming", "appearances", "state"))
    third = F.pmod(F.crc32("occurrence_id"), F.lit(3))
    for part in (occ.filter(third < 2), occ.filter(third > 0)):
        part.write.mode("append").parquet(incoming)
        write(stream.occurrence_stream(spark, incoming), out, state).awaitTermination()
    return read(spark, out)


def _stream_appearances(occ: DataFrame) -> DataFrame:
    return _streamed(occ, functools.partial(appearances.write_appearances, slots=1), appearances.appearances)


def _stream_ranges(occ: DataFrame) -> DataFrame:
    return _streamed(occ, appearances.write_ranges, appearances.ranges_so_far)


_add("pbdb_source", _pbdb_source, "select * replace ((max_ma + min_ma) / 2 as mid_ma, 'PBDB' as source_db) from occ")
_add("neotoma_source", _neotoma_source, ORACLE_SQL["normalized_neotoma"].removeprefix(f"with recursive {OCCURRENCES_SQL} "))
_add("stream_appearances", _stream_appearances, DATED,
     "select genus, max(mid_ma) as first_appearance, min(mid_ma) as last_appearance, count(distinct (source_db, occurrence_id)) as occurrences, max(mid_ma)-min(mid_ma) as duration from dated group by genus")
_add("stream_ranges", _stream_ranges, DATED,
     "select genus, max(mid_ma) as first_appearance, min(mid_ma) as last_appearance, count(distinct (source_db, occurrence_id, mid_ma)) as occurrences, max(mid_ma)-min(mid_ma) as duration from dated group by genus")
_add("unique_occurrences", lambda o: normalize.drop_repeats(normalize.conform(o)).select("source_db", "occurrence_id"), "select distinct source_db, occurrence_id from occ")
_NOISE = "md5(concat_ws('/', '42', coalesce(occurrence_id, ''), coalesce(genus, '')))"
_add("stable_sample", lambda o: ranges.stable_sample(o.dropna(subset=list(diversity.PLACED)), 20_000), "named as (select * from occ where mid_ma is not null and genus is not null and lat is not null and lng is not null)",
     f"select * from named order by {_NOISE}, {', '.join(f'{chr(34)}{c}{chr(34)} nulls first' for c in COLUMNS)} limit 20000")
_add("map_sample", ranges.map_sample, PLACED, MESOZOIC, f"select lat, lng from meso order by {_NOISE}, occurrence_id, genus, mid_ma, lat, lng limit 2000")

_FILLED = """filled as (select coalesce(phylum, 'Unknown') as p, coalesce("class", 'Unknown') as c, coalesce("order", 'Unknown') as o from occ)"""
_add("sunburst", taxonomy.sunburst, _FILLED, "top as (select o from filled group by 1 order by count(*) desc, o limit 50)",
     "select case when grouping_id(p, c, o)=3 then p when grouping_id(p, c, o)=1 then concat_ws('-', p, c) else concat_ws('-', p, c, o) end as id, case when grouping_id(p, c, o)=3 then p when grouping_id(p, c, o)=1 then c else o end as label, "
     "case when grouping_id(p, c, o)=3 then '' when grouping_id(p, c, o)=1 then p else concat_ws('-', p, c) end as parent, count(*) as value from filled where o in (select o from top) group by grouping sets ((p), (p, c), (p, c, o))")
_IN = f"""clade as (select *, {_bin('mid_ma')} as time_bin from occ where ("class" in {_CLADE} or "order" in {_CLADE} or phylum in {_CLADE}) and mid_ma is not null)"""
_add("clade_stats", lambda o: taxonomy.clade_stats(o, CLADE), _IN, f"select count(distinct genus) as total_genera, count(*) as total_occurrences, concat({WHOLE.format('max(max_ma)')}, ' - ', {WHOLE.format('min(min_ma)')}, ' Ma') as time_range from clade")
_add("clade_top_genera", lambda o: taxonomy.clade_top_genera(o, CLADE), _IN, "select genus, count(*) as occurrences from clade where genus is not null group by 1 order by 2 desc, 1 limit 10")
_add("clade_diversity", lambda o: taxonomy.clade_diversity(o, CLADE), _IN, "select time_bin, count(distinct genus) as diversity from clade group by 1")

QUERIES["temperature_curve"] = lambda spark, sf_dir: climate.temperature_curve(spark).withColumn("temperature", F.round("temperature", 6))
ORACLE_SQL["temperature_curve"] = f"select t::double as time, round({TEMPERATURE.format(t='t::double')}, 6) as temperature from range(541) r(t)"
_SERIES = (DATED, f"series as (select time_bin, count(distinct genus) as diversity, {TEMPERATURE.format(t='time_bin')} as temperature from dated group by 1)")
_add("climate_timeseries", _rounded(climate.climate_timeseries, "temperature"), *_SERIES, "select time_bin, diversity, round(temperature, 6) as temperature from series")
_add("climate_correlation", _rounded(lambda o: climate.correlation(climate.climate_timeseries(o), "diversity", "temperature"), "correlation"), *_SERIES, "select round(coalesce(corr(diversity, temperature), 0), 6) as correlation from series")

_add("climate_timeseries_table", _rounded(lambda o: intervals.interpolated(diversity.diversity_curve(o), o.sparkSession.createDataFrame([(float(a), float(t)) for a, t in climate.KNOTS], "age double, temperature double"), "time_bin", "temperature"), "temperature"),
     *_SERIES, "select time_bin, diversity, round(temperature, 6) as temperature from series")
_add("range_through_diversity", intervals.range_through_diversity, DATED, "bins as (select distinct time_bin from dated)", "spans as (select genus, min(time_bin) as youngest, max(time_bin) as oldest from dated group by 1)",
     "select time_bin, count(*) as standing_diversity from bins join spans on time_bin between youngest and oldest group by 1")


def _sketched(occ: DataFrame) -> DataFrame:
    """Two downloads that overlap leave a table of sketches each; their merge is held against the diversity of all rows, four standard errors either way."""
    part = F.pmod(F.crc32("occurrence_id"), F.lit(3))
    tables = [written(sketches.diversity_sketches(occ.filter(some)), "sketches") for some in (part < 2, part > 0)]
    found = sketches.sketched_diversity(sketches.merged(*tables)).withColumnRenamed("diversity", "estimate")
    near = F.abs(F.col("estimate") - F.col("diversity")) <= 1 + 4 * sketches.relative_error() * F.col("diversity")
    return diversity.diversity_curve(occ).join(found, "time_bin", "left").select("time_bin", "diversity", F.coalesce(near, F.lit(False)).alias("estimate_is_near"))


def _by_sql(occ: DataFrame) -> DataFrame:
    spark = occ.sparkSession
    functions.register_functions(spark)
    normalize.register(occ, "occurrences")
    return spark.sql("""select * from sqs(table(select time_bin(mid_ma, 5) as time_bin, genus, count(*) as n from occurrences
                        where mid_ma is not null and genus is not null group by 1, 2) partition by (time_bin), 0.5)""")


def _bucketed_ranges(occ: DataFrame) -> DataFrame:
    folder = shared_folder(occ.sparkSession, "bucketed")
    table = bucketed.write_bucketed(occ, f"occurrences_{folder.rpartition('-')[2]}", buckets=8, folder=folder)
    return ranges.genus_ranges(table)


_add("diversity_sketch", _sketched, DATED, "select time_bin, count(distinct genus) as diversity, true as estimate_is_near from dated group by 1")
_add("sql_functions", _by_sql, DATED, *_SQS, "select time_bin, count(*) filter (2*(c-n) < t) as sqs_diversity from cum group by 1")
_add("bucketed_ranges", _bucketed_ranges, DATED, RANGES, "select * from ranges")

_FEATURES = (PLACED, INDEXED.format(rows="placed"),
             "there as (select genus, time_bin, i, count(distinct (lat_bin, lng_bin)) as geographic_range, count(*) as abundance, max(lat)-min(lat) as lat_range, count(distinct environment) as env_breadth from placed join bins using (time_bin) group by 1, 2, 3)",
             "features as (select genus, time_bin, geographic_range, abundance, lat_range, env_breadth, row_number() over w - 1 as age, case when lead(i) over w = i+1 then 0 else 1 end::bigint as extinct_next_bin from there window w as (partition by genus order by i) qualify i < (select max(i) from bins))")
_add("extinction_features", turnover.extinction_features, *_FEATURES, "select * from features")
_add("extinction_features_basic", lambda o: turnover.extinction_features(o, with_environment=False), *_FEATURES, "select * exclude (env_breadth) from features")
_add("extinction_rate", _rounded(lambda o: turnover.extinction_rate(turnover.extinction_features(o)), "extinction_rate"), *_FEATURES, "select count(*) as samples, round(avg(extinct_next_bin), 6) as extinction_rate from features")

_EDGES = "select distinct {by} a.locality as src, b.locality as dst from {rows} a join {rows} b on {on} a.genus = b.genus and a.locality < b.locality"
_TEXT = "concat(printf('%.1f', {}), ',', printf('%.1f', {}))"
_add("bin_projection_edges", network.bin_projection_edges, PLACED, f"e as (select distinct time_bin, {_TEXT.format('lat_bin', 'lng_bin')} as locality, genus from placed)", _EDGES.format(by="a.time_bin,", rows="e", on="a.time_bin = b.time_bin and"))
_add("locality_network_edges", network.locality_network_edges, f"p as (select {_TEXT.format(_bin('lat'), _bin('lng'))} as locality, genus from occ where lat is not null and lng is not null and genus is not null)",
     "top as (select locality from p group by 1 order by count(*) desc, locality limit 50)", "e as (select distinct locality, genus from p where locality in (select locality from top))", _EDGES.format(by="", rows="e", on=""))
_PAIRED = f"e as (select distinct time_bin, {_TEXT.format('lat_bin', 'lng_bin')} as locality, genus from placed)"
_ROBUST = "robust as (select time_bin, avg(abs(lat)) as mean_abs_lat, count(distinct genus) as diversity, count(distinct (lat_bin, lng_bin)) as localities, count(*) as n from placed group by 1 having count(*) >= 100 and count(distinct genus) >= 5 and count(distinct (lat_bin, lng_bin)) >= 5)"
_BIN_EDGES = f"edges as ({_EDGES.format(by='a.time_bin,', rows='e', on='a.time_bin = b.time_bin and')})"
_add("locality_network_nodes", network.locality_network_nodes, f"p as (select {_bin('lat')} as lat_bin, {_bin('lng')} as lng_bin, {_TEXT.format(_bin('lat'), _bin('lng'))} as locality, genus from occ where lat is not null and lng is not null and genus is not null)",
     "top as (select locality, lat_bin, lng_bin, count(*) as occurrences from p group by 1, 2, 3 order by 4 desc, 1 limit 50)", "e as (select distinct locality, genus from p where locality in (select locality from top))",
     f"edges as ({_EDGES.format(by='', rows='e', on='')})", "ends as (select src as locality from edges union all select dst from edges)",
     "select t.locality, t.lat_bin, t.lng_bin, t.occurrences, count(x.locality) as degree from top t left join ends x using (locality) group by 1, 2, 3, 4")
_add("locality_network_layout", _rounded(network.locality_network_layout, "x", "y"))
_add("locality_communities", _rounded(lambda o: communities.communities(network.project(network.located(o).select("locality", "genus").distinct(), [])), "modularity"))
_add("biogeographic_dynamics", network.biogeographic_dynamics)
_add("biogeographic_bins", _rounded(lambda o: network.robust_bins(network.counted_cells(network.located(o))), "mean_abs_lat"), PLACED, _ROBUST, "select time_bin, round(mean_abs_lat, 6) as mean_abs_lat, diversity, localities, n from robust")
_add("biogeographic_edges", lambda o: network.biogeographic_dynamics(o).select("time_bin", "diversity", "n_edges"), PLACED, _ROBUST, _PAIRED, _BIN_EDGES,
     "select r.time_bin, r.diversity, (select count(*) from edges x where x.time_bin = r.time_bin) as n_edges from robust r")
_LARGEST = "best as (select time_bin from (select time_bin, count(*) as n, count(distinct (lat_bin, lng_bin)) as l, count(distinct genus) as g from placed group by 1 order by 2 desc, 1 limit 1) where l >= 10 and g >= 10)"
_add("null_histogram", lambda o: network.null_histogram(network.null_model(o)))
_add("null_model", lambda o: network.null_model_summary(network.null_model(o)))
_add("null_observed", lambda o: network.null_model(o, iterations=0).select("iteration", "time_bin", "n_edges"), PLACED, _LARGEST, _PAIRED, _BIN_EDGES,
     "select -1 as iteration, time_bin, (select count(*) from edges x where x.time_bin = best.time_bin) as n_edges from best")
_add("null_marginals", network.null_marginals, PLACED, _LARGEST, f"r as (select {_TEXT.format('lat_bin', 'lng_bin')} as locality, genus from placed join best using (time_bin))",
     "m as (select 'locality' as kind, locality as name, count(*) as n from r group by 1, 2 union all select 'genus', genus, count(*) from r group by 1, 2)",
     "select (i.k - 1)::int as iteration, kind, name, n from m, range(101) i(k)")


@functools.lru_cache(maxsize=1)
def _fitted(spark: SparkSession, sf_dir: str) -> extinction_model.ExtinctionModel:
    """The forest that both of its queries show, fitted once; the features are held meanwhile and released then."""
    features = turnover.extinction_features(occurrences(spark, sf_dir)).persist()
    try:
        found = extinction_model.fit(features)
        if found is None:
            raise ValueError("too few samples")
        return found
    finally:
        features.unpersist()


QUERIES["extinction_model_metrics"] = lambda spark, sf_dir: extinction_model.metrics(_fitted(spark, sf_dir))
QUERIES["feature_importances"] = lambda spark, sf_dir: extinction_model.feature_importances(_fitted(spark, sf_dir))
_add("extinction_split", lambda o: extinction_model.split_sizes(turnover.extinction_features(o)), *_FEATURES,
     "sizes as (select extinct_next_bin, count(*) as n, floor(count(*) * 0.7e0)::bigint as k from features group by 1)",
     "select 'train' as side, extinct_next_bin, k as n from sizes where k > 0 union all select 'test', extinct_next_bin, n - k from sizes where n > k")
