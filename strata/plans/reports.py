"""Documents for dashboards: small results, gathered on the driver and written as JSON or text.

Every number comes from an operator's DataFrame; only results whose size does not follow the input are collected, but for the
explorer table, whose rows are the genera.
"""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import climate, diversity, extinction_model, network, ranges, taxonomy, turnover


def _rows(frame: DataFrame) -> list[dict]:
    return [r.asDict() for r in frame.collect()]


def _columns(frame: DataFrame, names: dict[str, str]) -> dict[str, list]:
    rows = frame.collect()
    return {shown: [r[c] for r in rows] for c, shown in names.items()}


def rates(occ: DataFrame) -> list[dict]:
    found = turnover.mass_extinctions(turnover.turnover_rates(occ)).withColumnRenamed("time_bin", "time").orderBy(F.desc("time"))
    return _rows(found.select("time", "origination_rate", "extinction_rate", "total_genera", "originations", "extinctions", "is_mass_extinction"))


def climate_document(occ: DataFrame) -> dict:
    series = climate.climate_timeseries(occ)
    value = climate.correlation(series, "diversity", "temperature").first().correlation
    return {"timeseries": _rows(series.withColumnRenamed("time_bin", "time").orderBy(F.desc("time"))),
            "temperature_curve": _rows(climate.temperature_curve(occ.sparkSession).orderBy("time")),
            "correlation": 0.0 if math.isnan(value) else value}


def null_model_document(occ: DataFrame, iterations: int = 100, seed: int = 42) -> dict | None:
    found = network.null_model(occ, iterations, seed).collect()  # one row for each iteration
    observed = next((r for r in found if r.iteration == -1), None)
    if observed is None or observed.modularity is None:
        return None
    drawn = [r.modularity for r in sorted(found, key=lambda r: r.iteration) if r.iteration >= 0 and r.modularity is not None]
    p = sum(m >= observed.modularity for m in drawn) / len(drawn) if drawn else None
    return {"observed_modularity": observed.modularity, "null_distribution": drawn, "p_value": p, "time_bin": observed.time_bin, "significant": p is not None and p < 0.05}


def deep_time(occ: DataFrame) -> dict:
    members: dict[str, dict[str, list]] = {}
    for r in ranges.extinction_event_members(occ).orderBy("event", "kind", "position").collect():
        members.setdefault(r.event, {"survivor": [], "victim": [], "newcomer": []})[r.kind].append(r.genus)
    events = {r.event: {"genera_before": r.genera_before, "genera_after": r.genera_after, "survivors": members[r.event]["survivor"], "victims": members[r.event]["victim"],
                        "newcomers": members[r.event]["newcomer"], "survival_rate": r.survival_rate} for r in ranges.extinction_events(occ).collect()}
    stats, peak = ranges.global_stats(occ).first(), ranges.peak_origination(occ).first()
    champions = ranges.survivor_champions(occ).drop("age_range")
    return {"survivor_champions": _rows(champions), "rarest_genera": _rows(ranges.rarest_genera(occ)), "most_common": _rows(ranges.most_common_genera(occ)),
            "geographic_champions": _rows(ranges.geographic_champions(occ)), "extinction_analysis": events,
            "stats": {"total_genera": stats.total_genera, "total_occurrences": stats.total_occurrences,
                      "time_span": f"{stats.oldest:.0f} - {stats.youngest:.0f} Ma" if stats.total_occurrences else "",
                      "peak_origination": {"time_ma": peak.time_ma, "new_genera": peak.new_genera}}}


def facts(occ: DataFrame) -> list[str]:
    """Sentences about the Mesozoic and the whole table; none for what has no rows."""
    top = ranges.mesozoic_top_genera(occ, 1).first()
    count = ranges.mesozoic(occ).agg(F.count_distinct("genus")).first()[0]
    stats = ranges.global_stats(occ).first()
    periods = {r.period: r.genera for r in ranges.period_breakdown(occ).collect()}
    out = []
    if top:
        late, early = periods["Cretaceous"], periods["Triassic"] + periods["Jurassic"]
        out += [f"The table has {count:,} Mesozoic genera.", f"Most Mesozoic occurrences, {top.occurrences:,}, are of {top.genus}.",
                f"The Cretaceous has {late:,} genera" + (", more than the Triassic and the Jurassic have together." if late > early else "."),
                f"{top.genus} was found {top.occurrences:,} times."]
    if stats.total_occurrences:
        out.append(f"All {stats.total_occurrences:,} occurrences span {stats.oldest:.0f} million years.")
    if widest := ranges.geographic_champions(occ, 1).first():
        out.append(f"The most widespread genus is {widest.genus}, found in {widest.unique_regions} regions.")
    if longest := ranges.survivor_champions(occ, 1).first():
        out.append(f"The longest-lived genus is {longest.genus}: {longest.duration_myr:.0f} million years.")
    return out


def dino_zone(occ: DataFrame) -> dict:
    periods = {r.period: {"genera": r.genera, "occurrences": r.occurrences} for r in ranges.period_breakdown(occ).collect()}
    return {"top_genera": _rows(ranges.mesozoic_top_genera(occ)), "period_breakdown": periods, "facts": facts(occ),
            "map": _columns(ranges.map_sample(occ), {"lat": "lat", "lng": "lng"}), "total_genera": ranges.mesozoic(occ).agg(F.count_distinct("genus")).first()[0]}


def taxonomy_document(occ: DataFrame, clade: tuple[str, ...] = taxonomy.DINOSAURS) -> dict:
    stats = taxonomy.clade_stats(occ, clade).first().asDict()
    stats["top_genera"] = {r.genus: r.occurrences for r in taxonomy.clade_top_genera(occ, clade).collect()}
    survivors = ranges.survivor_champions(occ, more_than=2).select("genus", F.col("duration_myr").alias("duration"), F.col("age_range").alias("range"), "occurrences")
    return {"sunburst": _columns(taxonomy.sunburst(occ).orderBy("id"), {"id": "ids", "label": "labels", "parent": "parents", "value": "values"}),
            "dino_stats": stats, "dino_chart": _columns(taxonomy.clade_diversity(occ, clade), {"time_bin": "time", "diversity": "diversity"}), "survivors": _rows(survivors)}


def web_data(occ: DataFrame, sample: int | None = None) -> dict:
    """``sample``: so many rows, the same ones each time, for networks and the model; all rows by default."""
    placed = occ.dropna(subset=list(diversity.PLACED))
    heavy = ranges.stable_sample(placed, sample) if sample else placed
    curve = diversity.diversity_curve(occ, required=diversity.PLACED).orderBy(F.desc("time_bin"))
    sqs = diversity.sqs_diversity(occ, required=diversity.PLACED).orderBy(F.desc("time_bin"))
    sota = network.biogeographic_dynamics(heavy, min_rows=50)
    names = ("geographic_range", "abundance", "lat_range", "age")
    model = extinction_model.fit(turnover.extinction_features(heavy, with_environment=False), names, trees=50, share=None, least=101)
    ml = {}
    if model:
        shown = dict(zip(names, ("Geographic Range", "Abundance", "Latitudinal Range", "Age")))
        ml = {"features": list(shown.values()), "importance": model.forest.featureImportances.toArray().tolist(), "accuracy": extinction_model.metrics(model).first().accuracy}
    explorer = ranges.genus_explorer(occ).orderBy(F.desc("occurrences"), "genus")
    return {"diversity": _columns(curve, {"time_bin": "time", "diversity": "count"}), "sqs": _columns(sqs, {"time_bin": "time", "sqs_diversity": "count"}),
            "map": _columns(explorer, {"genus": "genus", "min_age": "min_age", "max_age": "max_age", "occurrences": "count", "reference": "reference"}),
            "sota": _columns(sota, {"time_bin": "time", "modularity": "modularity", "mean_abs_lat": "mean_abs_lat"}), "ml": ml}


def model_summary(model: extinction_model.ExtinctionModel, features: DataFrame) -> str:
    size, found = turnover.extinction_rate(features).first(), extinction_model.metrics(model).first()
    lines = ["Extinction model", f"Samples: {size.samples:,}", f"Extinction rate: {size.extinction_rate:.2%}", f"Accuracy: {found.accuracy:.2%}", f"ROC-AUC: {found.roc_auc:.3f}", "Importances:"]
    return "\n".join(lines + [f"  {r.feature}: {r.importance:.4f}" for r in extinction_model.feature_importances(model).collect()]) + "\n"


DOCUMENTS = {"rates": rates, "climate": climate_document, "null": null_model_document, "deep-time": deep_time, "dino-zone": dino_zone, "taxonomy": taxonomy_document, "web": web_data}


def write_document(occ: DataFrame, name: str, folder: str) -> str:
    """Writes one of ``DOCUMENTS`` as ``<name>_data.json``; its path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name.replace('-', '_')}_data.json")
    with open(path, "w") as out:
        json.dump(DOCUMENTS[name](occ), out, allow_nan=False)
    return path
