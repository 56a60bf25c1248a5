"""Genera: stratigraphic ranges, frequencies, spread, events and the explorer table.  Ties always go to the lesser key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.numeric import bin_to
from strata.operators.diversity import DATED, PLACED

#: Event, oldest age bound of the window before it, youngest bound of the window after it (Ma).
EVENTS = (("End-Permian (252 Ma)", 260.0, 245.0), ("End-Triassic (201 Ma)", 210.0, 195.0), ("End-Cretaceous (66 Ma)", 70.0, 60.0))
EVENT_SPAN = 15.0
MESOZOIC = (66.0, 252.0)
PERIODS = ("Triassic", "Jurassic", "Cretaceous")


def whole_text(value) -> "F.Column":
    """A number without decimals, halves to even."""
    return F.format_string("%.0f", F.rint(value))


def dated(occ: DataFrame) -> DataFrame:
    return occ.dropna(subset=list(DATED))


def genus_ranges(occ: DataFrame) -> DataFrame:
    """First and last appearance, duration and occurrences of each genus."""
    found = dated(occ).groupBy("genus").agg(F.max("mid_ma").alias("first_appearance"), F.min("mid_ma").alias("last_appearance"), F.count("*").alias("occurrences"))
    return found.withColumn("duration", F.col("first_appearance") - F.col("last_appearance"))


def survivor_champions(occ: DataFrame, n: int = 15, more_than: int = 0) -> DataFrame:
    """The ``n`` longest-lived genera with a duration and more than ``more_than`` occurrences."""
    top = genus_ranges(occ).filter((F.col("duration") > 0) & (F.col("occurrences") > more_than)).orderBy(F.desc("duration"), "genus").limit(n)
    one = lambda c: F.bround(F.col(c), 1)
    return top.select("genus", one("first_appearance").alias("first_appearance"), one("last_appearance").alias("last_appearance"), one("duration").alias("duration_myr"),
                      "occurrences", F.concat(whole_text(F.col("first_appearance")), F.lit("-"), whole_text(F.col("last_appearance")), F.lit(" Ma")).alias("age_range"))


def most_common_genera(occ: DataFrame, n: int = 10) -> DataFrame:
    top = genus_ranges(occ).orderBy(F.desc("occurrences"), "genus").limit(n)
    return top.select("genus", "occurrences", F.concat(whole_text(F.col("first_appearance")), F.lit("-"), whole_text(F.col("last_appearance"))).alias("age_range"))


def rarest_genera(occ: DataFrame, n: int = 10) -> DataFrame:
    found = dated(occ).groupBy("genus").agg(F.count("*").alias("occurrences"), F.avg("mid_ma").alias("age_ma"))
    return found.orderBy("occurrences", "genus").limit(n).withColumn("age_ma", F.bround("age_ma", 1))


def geographic_champions(occ: DataFrame, n: int = 10, cell: float = 10.0) -> DataFrame:
    """Genera found in the most ``cell``-degree squares."""
    placed = occ.dropna(subset=list(PLACED)).select("genus", F.struct(bin_to("lat", cell).alias("a"), bin_to("lng", cell).alias("b")).alias("cell"))
    return placed.groupBy("genus").agg(F.count_distinct("cell").alias("unique_regions")).orderBy(F.desc("unique_regions"), "genus").limit(n)


def _event_flags(occ: DataFrame) -> DataFrame:
    """(event, genus, before, after) for genera on either side of an event."""
    age = F.col("mid_ma")
    sides = [F.struct(F.lit(name).alias("event"), ((age <= end) & (age > end - EVENT_SPAN)).alias("before"), ((age >= start) & (age < start + EVENT_SPAN)).alias("after")) for name, end, start in EVENTS]
    rows = dated(occ).select("genus", F.explode(F.array(*sides)).alias("e")).filter("e.before or e.after")
    return rows.groupBy("e.event", "genus").agg(F.bool_or("e.before").alias("before"), F.bool_or("e.after").alias("after"))


def extinction_events(occ: DataFrame) -> DataFrame:
    """Genera before and after each event and the share of survivors; events with an empty side are left out."""
    both = F.col("before") & F.col("after")
    sums = _event_flags(occ).groupBy("event").agg(F.count_if("before").alias("genera_before"), F.count_if("after").alias("genera_after"), F.count_if(both).alias("genera_surviving"))
    return sums.filter("genera_before > 0 and genera_after > 0").withColumn("survival_rate", F.bround(F.col("genera_surviving") / F.col("genera_before") * 100, 1))


def extinction_event_members(occ: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` survivors, victims and newcomers of each event by name."""
    kind = F.when(F.col("before") & F.col("after"), "survivor").when(F.col("before"), "victim").otherwise("newcomer")
    ranked = _event_flags(occ).select("event", kind.alias("kind"), "genus").withColumn("position", F.row_number().over(Window.partitionBy("event", "kind").orderBy("genus")).cast("long"))
    return ranked.filter(F.col("position") <= n)


def origination_histogram(occ: DataFrame, width: float = 10.0) -> DataFrame:
    """First appearances per bin."""
    return genus_ranges(occ).groupBy(bin_to("first_appearance", width).alias("time_ma")).agg(F.count("*").alias("new_genera"))


def peak_origination(occ: DataFrame, width: float = 10.0) -> DataFrame:
    """The bin with most first appearances, the youngest such bin at a tie."""
    best = F.max_by("time_ma", F.struct(F.col("new_genera"), -F.col("time_ma")))
    return origination_histogram(occ, width).agg(best.alias("time_ma"), F.max("new_genera").alias("new_genera"))


def global_stats(occ: DataFrame) -> DataFrame:
    return dated(occ).agg(F.count("*").alias("total_occurrences"), F.count_distinct("genus").alias("total_genera"), F.max("mid_ma").alias("oldest"), F.min("mid_ma").alias("youngest"))


def era_counts(occ: DataFrame) -> DataFrame:
    """Occurrences by era, (0,66], (66,252], (252,541] Ma; others have none."""
    age = F.col("mid_ma")
    era = F.when((age > 0) & (age <= 66), "Cenozoic").when((age > 66) & (age <= 252), "Mesozoic").when((age > 252) & (age <= 541), "Paleozoic")
    return occ.select(era.alias("era")).filter("era is not null").groupBy("era").agg(F.count("*").alias("occurrences"))


def mesozoic(occ: DataFrame) -> DataFrame:
    return occ.dropna(subset=list(PLACED)).filter(F.col("mid_ma").between(*MESOZOIC))


def mesozoic_top_genera(occ: DataFrame, n: int = 15) -> DataFrame:
    found = mesozoic(occ).groupBy("genus").agg(F.count("*").alias("occurrences"), F.rint(F.avg("mid_ma")).alias("avg_age_ma"))
    return found.orderBy(F.desc("occurrences"), "genus").limit(n)


def period_breakdown(occ: DataFrame) -> DataFrame:
    """Genera and occurrences in each Mesozoic period; zeros where there are none."""
    age = F.col("mid_ma")
    period = F.when(age > 201, PERIODS[0]).when(age > 145, PERIODS[1]).otherwise(PERIODS[2])
    found = mesozoic(occ).groupBy(period.alias("period")).agg(F.count_distinct("genus").alias("genera"), F.count("*").alias("occurrences"))
    every = occ.sparkSession.createDataFrame([(p,) for p in PERIODS], "period string")
    return every.join(found, "period", "left").fillna(0, ["genera", "occurrences"])


def hemisphere_diversity(occ: DataFrame) -> DataFrame:
    side = F.when(F.col("lat") > 0, "Northern").otherwise("Southern")
    return mesozoic(occ).groupBy(side.alias("hemisphere")).agg(F.count_distinct("genus").alias("genera"))


def genus_explorer(occ: DataFrame) -> DataFrame:
    """Range, occurrences and the most frequent reference of each genus (the least one at a tie, ``Unknown`` without any).

    Rows are counted by genus and reference first, so that a genus of many rows is one small group for each of its references.
    """
    counts = occ.dropna(subset=list(PLACED)).groupBy("genus", "primary_reference").agg(F.min("mid_ma").alias("lo"), F.max("mid_ma").alias("hi"), F.count("*").alias("n"))
    first = F.min(F.when(F.col("primary_reference").isNotNull(), F.struct(-F.col("n"), "primary_reference"))).getField("primary_reference")
    return counts.groupBy("genus").agg(F.min("lo").alias("min_age"), F.max("hi").alias("max_age"), F.sum("n").alias("occurrences"), F.coalesce(first, F.lit("Unknown")).alias("reference"))


def explorer_search(explorer: DataFrame, term: str) -> DataFrame:
    return explorer.filter(F.lower("genus").contains(term.lower()))


def explorer_page(explorer: DataFrame, page: int = 1, size: int = 15) -> DataFrame:
    """Page ``page`` (from 1) by falling occurrences."""
    return explorer.orderBy(F.desc("occurrences"), "genus").offset((page - 1) * size).limit(size)


def occurrence_map(occ: DataFrame) -> DataFrame:
    """Occurrences at each place."""
    return occ.dropna(subset=["lat", "lng"]).groupBy("lat", "lng").agg(F.count("*").alias("occurrences"))


def stable_sample(rows: DataFrame, n: int, seed: int = 42, names: tuple[str, ...] = ("occurrence_id", "genus")) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), the same ones whatever the partitioning: the first by a hash of ``names``, then by all columns.

    Rows are counted first, so that only those below a threshold of the hash, a few more than ``n`` in all, are sorted and meet in the end; the
    threshold doubles if rows that share a hash leave too few below it.
    """
    noise = F.md5(F.concat_ws("/", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names)))
    total, wanted = rows.count(), n + 6 * int(n**0.5) + 16
    kept = rows
    while total > 2 * wanted:
        threshold = F.lit(f"{(wanted << 128) // total:032x}")
        kept = rows.filter(noise < threshold)
        if kept.count() >= n:
            break
        wanted, kept = 2 * wanted, rows
    return kept.orderBy(noise, *rows.columns).limit(n)


def map_sample(occ: DataFrame, n: int = 2000, seed: int = 42) -> DataFrame:
    """Up to ``n`` Mesozoic places."""
    return stable_sample(mesozoic(occ).select("occurrence_id", "genus", "mid_ma", "lat", "lng"), n, seed).select("lat", "lng")
