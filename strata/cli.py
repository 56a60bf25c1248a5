"""Command line: download, normalize, analyze, report.  Run with ``python -m strata.cli``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from strata.operators import diversity, extinction_model, network, ranges, turnover
from strata.plans import reports
from strata.sources import acquire, normalize


def _model(occ: DataFrame, out: str) -> dict[str, DataFrame]:
    features = turnover.extinction_features(occ).persist()
    model = extinction_model.fit(features)
    if model is None:
        raise SystemExit("too few samples for a model")
    with open(f"{out}/ml_extinction_summary.txt", "w") as f:
        f.write(reports.model_summary(model, features))
    return {"feature_importances": extinction_model.feature_importances(model), "model_metrics": extinction_model.metrics(model)}


#: Analysis to the tables it writes.
ANALYSES = {
    "basic": lambda occ, out: {"diversity_curve": diversity.diversity_curve(occ), "occurrence_map": ranges.occurrence_map(occ)},
    "advanced": lambda occ, out: {"locality_network": network.locality_network_edges(occ), "locality_nodes": network.locality_network_nodes(occ), "locality_layout": network.locality_network_layout(occ), "sqs_diversity": diversity.sqs_diversity(occ)},
    "sota": lambda occ, out: {"biogeographic_dynamics": network.biogeographic_dynamics(occ), "latitudinal_shift": diversity.latitudinal_centroid(occ)},
    "ml": _model,
    "check": lambda occ, out: {"quality": normalize.quality_report(occ), "eras": ranges.era_counts(occ)},
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strata", description=__doc__)
    verbs = out.add_subparsers(dest="verb")
    download = verbs.add_parser("download", help="fetch raw occurrences")
    download.add_argument("--interval", default="Cambrian,Cretaceous")
    download.add_argument("--source", choices=("pbdb", "neotoma"), default="pbdb")
    download.add_argument("--limit", type=int, default=10_000, help="records of neotoma")
    download.add_argument("--output", default="data/raw")
    normal = verbs.add_parser("normalize", help="raw files to canonical Parquet; all: both sources, then the merge")
    normal.add_argument("--source", choices=("pbdb", "neotoma", "merge", "all"), default="all")
    normal.add_argument("--input", default="data/raw")
    normal.add_argument("--output", default="data/processed")
    normal.add_argument("--null-policy", choices=("strict", "literal"), default="strict")
    analyze = verbs.add_parser("analyze", help="result tables as Parquet")
    analyze.add_argument("--type", choices=tuple(ANALYSES), default="basic")
    report = verbs.add_parser("report", help="JSON documents")
    report.add_argument("--name", choices=(*reports.DOCUMENTS, "all"), default="all")
    for verb in (analyze, report):
        verb.add_argument("--input", default="data/processed/merged_occurrences.parquet")
        verb.add_argument("--output", default="data/analysis")
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    if not args.verb:
        parser().print_help()
        return 0
    if args.verb == "download":
        fetch = acquire.fetch_pbdb(args.interval, args.output) if args.source == "pbdb" else acquire.fetch_neotoma(args.limit, args.output)
        print(fetch or "the download failed")
        if fetch is None:
            return 1
    spark = spark or SparkSession.builder.appName("strata").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.verb == "download":
        if args.source == "pbdb":
            normalize.preview(spark, fetch).show(truncate=24)  # the header and some rows, to check the download
        return 0
    if args.verb == "normalize":
        steps = ("pbdb", "neotoma", "merge") if args.source == "all" else (args.source,)
        paths = [normalize.normalize_folder(spark, s, args.output if s == "merge" else args.input, args.output, args.null_policy) for s in steps]
        print(*(p or f"no input for {s}" for s, p in zip(steps, paths)), sep="\n")
        return int(paths[-1] is None)
    occ = spark.read.parquet(args.input)
    if args.verb == "analyze":
        import os

        os.makedirs(args.output, exist_ok=True)
        for name, table in ANALYSES[args.type](occ, args.output).items():
            table.write.mode("overwrite").parquet(f"{args.output}/{name}.parquet")
            print(f"{args.output}/{name}.parquet")
    else:
        for name in reports.DOCUMENTS if args.name == "all" else (args.name,):
            print(reports.write_document(occ, name, args.output))
    return 0


if __name__ == "__main__":
    sys.exit(main())
