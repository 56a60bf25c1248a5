"""Ingest, normalisation, reports, command line and stream."""

from __future__ import annotations

import json
import os
import time
from urllib import error

from strata import cli
from strata.plans import reports
from strata.sources import acquire, normalize
from strata.sources.schema import COLUMNS
from strata.streaming import occurrences as stream


def _raw(folder):
    os.makedirs(folder)
    (folder / "pbdb_occurrences_1.csv").write_text('occurrence_no,identified_name,identified_rank,max_ma,min_ma,lat,lng,genus,extra\n1,"A ""x""",genus,10,6,1.5,2,Aa,9\n2,"B\nline",genus,NA,6,,2,NA,9\n')
    (folder / "pbdb_occurrences_2.csv").write_text("genus,occurrence_no,max_ma,min_ma\nBb,3,30,20\n")
    (folder / "neotoma_occurrences_1.json").write_text(json.dumps({"data": [{"occurrenceid": 0, "taxonname": "old"}]}))
    time.sleep(0.02)
    ages = [1200, {"age": 1200}, "bad", -50]
    rows = [{"occurrenceid": k, "taxonname": f"t{k}", "age": a, "site": {"geography": {"coordinates": [10.0, 20.0]}} if k else "none"} for k, a in enumerate(ages)]
    (folder / "neotoma_occurrences_2.json").write_text(json.dumps({"data": rows}))
    os.utime(folder / "neotoma_occurrences_1.json", (1, 1))


def test_normalize_both_sources_and_merge(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    _raw(raw)
    assert cli.main(["normalize", "--input", str(raw), "--output", out], spark) == 0
    rows = {(r.source_db, r.occurrence_id): r for r in spark.read.parquet(f"{out}/merged_occurrences.parquet").collect()}
    assert len(rows) == 7
    one, two, three = (rows["PBDB", k] for k in "123")
    assert tuple(one.asDict()) == COLUMNS
    assert (one.scientific_name, one.mid_ma, one.lat, one.genus) == ('A "x"', 8.0, 1.5, "Aa")
    assert (two.scientific_name, two.max_ma, two.mid_ma, two.genus) == ("B\nline", None, None, None)
    assert (three.genus, three.mid_ma, three.lat) == ("Bb", 25.0, None)
    ages = [rows["Neotoma", str(k)].mid_ma for k in range(4)]
    assert ages == [0.0012, 0.0012, None, -0.00005]
    assert (rows["Neotoma", "0"].lat, rows["Neotoma", "1"].lat, rows["Neotoma", "1"].lng, rows["Neotoma", "1"].genus) == (None, 20.0, 10.0, None)


def test_literal_null_policy(spark, tmp_path):
    _raw(tmp_path / "raw")
    pbdb = normalize.normalize_pbdb(normalize.read_pbdb(spark, str(tmp_path / "raw")), "literal")
    assert sorted(r.genus for r in pbdb.collect()) == ["Aa", "Bb", "nan"]
    neotoma = normalize.normalize_neotoma(normalize.read_neotoma(spark, str(tmp_path / "raw")), "literal")
    assert {r.genus for r in neotoma.collect()} == {"None"}


def test_preview_and_sql(spark, tmp_path):
    _raw(tmp_path / "raw")
    shown = normalize.preview(spark, str(tmp_path / "raw" / "pbdb_occurrences_1.csv"), ("genus", "max_ma"), 1)
    assert [tuple(r) for r in shown.collect()] == [("Aa", "10")]
    normalize.register(normalize.normalize_pbdb(normalize.read_pbdb(spark, str(tmp_path / "raw"))))
    assert spark.sql("select count(*) as n from occurrences where genus is not null").first().n == 2


def test_no_input(spark, tmp_path):
    os.makedirs(tmp_path / "empty")
    assert cli.main(["normalize", "--source", "pbdb", "--input", str(tmp_path / "empty"), "--output", str(tmp_path / "o")], spark) == 1
    assert normalize.read_neotoma(spark, str(tmp_path / "empty")) is None
    assert cli.main([]) == 0


def test_drop_repeats(spark, tmp_path):
    _raw(tmp_path / "raw")
    frame = normalize.normalize_pbdb(normalize.read_pbdb(spark, str(tmp_path / "raw")))
    assert normalize.drop_repeats(frame.unionByName(frame)).count() == 3


def test_downloads(tmp_path):
    seen = []

    def answer(url, query):
        seen.append(query)
        yield b"a,b\n"
        yield b"1,2\n"

    path = acquire.fetch_pbdb("Permian", str(tmp_path), "x.csv", answer)
    assert open(path).read() == "a,b\n1,2\n" and seen[0]["interval"] == "Permian" and seen[0]["limit"] == "all"

    def broken(url, query):
        yield b"a"
        raise error.URLError("no network")

    assert acquire.fetch_pbdb(folder=str(tmp_path), filename="y.csv", transport=broken) is None and not os.path.exists(tmp_path / "y.csv")
    good = acquire.fetch_neotoma(5, str(tmp_path), "n.json", lambda url, query: [json.dumps({"data": []}).encode()])
    assert json.load(open(good)) == {"data": []}
    assert acquire.fetch_neotoma(5, str(tmp_path), "m.json", lambda url, query: [b"{}"]) is None


def test_reports_and_analyses(spark, sf_dir, tmp_path):
    from strata.sources.tables import occurrences

    path = str(tmp_path / "occ.parquet")
    occurrences(spark, sf_dir).write.parquet(path)
    for name in reports.DOCUMENTS:
        assert cli.main(["report", "--name", name, "--input", path, "--output", str(tmp_path / "r")], spark) == 0
    rates = json.load(open(tmp_path / "r" / "rates_data.json"))
    assert rates[0]["time"] > rates[-1]["time"] and all(0 <= r["extinction_rate"] <= 1 and r["originations"] <= r["total_genera"] for r in rates)
    climate = json.load(open(tmp_path / "r" / "climate_data.json"))
    assert len(climate["temperature_curve"]) == 541 and [r["diversity"] for r in climate["timeseries"]] == [r["total_genera"] for r in rates]
    assert set(json.load(open(tmp_path / "r" / "deep_time_data.json"))) == {"survivor_champions", "rarest_genera", "most_common", "geographic_champions", "extinction_analysis", "stats"}
    assert json.load(open(tmp_path / "r" / "dino_zone_data.json"))["facts"]
    assert cli.main(["analyze", "--type", "basic", "--input", path, "--output", str(tmp_path / "a")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "a" / "diversity_curve.parquet")).count() == len(rates)
    null = json.load(open(tmp_path / "r" / "null_data.json"))
    assert null is None or (len(null["null_distribution"]) == 100 and null["significant"] == (null["p_value"] < 0.05))
    tables = {"advanced": ("locality_network", "locality_nodes", "locality_layout", "sqs_diversity"), "sota": ("biogeographic_dynamics", "latitudinal_shift"), "ml": ("feature_importances", "model_metrics"), "check": ("quality", "eras")}
    for kind, names in tables.items():
        assert cli.main(["analyze", "--type", kind, "--input", path, "--output", str(tmp_path / "a")], spark) == 0
        assert all(spark.read.parquet(str(tmp_path / "a" / f"{n}.parquet")).count() >= (kind != "sota") for n in names)
    assert "Accuracy" in open(tmp_path / "a" / "ml_extinction_summary.txt").read()
    web = reports.web_data(spark.read.parquet(path), sample=1500)
    assert set(web) == {"diversity", "sqs", "map", "sota", "ml"} and web["ml"]["accuracy"] > 0


def test_facts_follow_their_conditions(spark):
    """Each sentence is there only for what has rows, and the comparison only if it holds."""
    columns = "genus string, mid_ma double, lat double, lng double, max_ma double, min_ma double"
    row = lambda g, age: (g, age, 1.0, 2.0, age + 1, age - 1)
    late = [row("A", 100.0), row("A", 90.0), row("B", 80.0), row("C", 70.0), row("D", 230.0)]
    said = reports.facts(spark.createDataFrame(late, columns))
    assert said[0] == "The table has 4 Mesozoic genera." and said[1] == "Most Mesozoic occurrences, 2, are of A." and said[3] == "A was found 2 times."
    assert "3 genera, more than the Triassic and the Jurassic" in said[2] and len(said) == 7
    early = reports.facts(spark.createDataFrame([row("A", 230.0), row("B", 160.0), row("C", 70.0)], columns))
    assert early[2] == "The Cretaceous has 1 genera."
    assert reports.facts(spark.createDataFrame([], columns)) == []
    assert not any("Mesozoic" in s for s in reports.facts(spark.createDataFrame([row("A", 10.0)], columns)))


def test_download_command_shows_the_header(spark, tmp_path, monkeypatch, capsys):
    asked = []

    def fetch(interval, folder):
        asked.append(interval)
        path = tmp_path / "pbdb_occurrences_9.csv"
        path.write_text("occurrence_no,genus\n1,Rex\n")
        return str(path)

    monkeypatch.setattr(acquire, "fetch_pbdb", fetch)
    assert cli.main(["download", "--interval", "Permian", "--output", str(tmp_path)], spark) == 0 and asked == ["Permian"]
    assert "occurrence_no" in capsys.readouterr().out
    monkeypatch.setattr(acquire, "fetch_neotoma", lambda limit, folder: asked.append(limit))
    assert cli.main(["download", "--source", "neotoma", "--limit", "7"], spark) == 1 and asked == ["Permian", 7]


def test_stream_counts_files_as_they_arrive(spark, sf_dir, tmp_path):
    from strata.operators.diversity import diversity_curve
    from strata.sources.tables import occurrences

    occ = occurrences(spark, sf_dir).persist()
    incoming, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (occ.filter("mid_ma < 300"), occ.filter("mid_ma >= 300")):
        part.write.mode("append").parquet(incoming)
        query = stream.write_running_genera(stream.occurrence_stream(spark, incoming), out, state)
        query.awaitTermination()
    latest = sorted(os.listdir(out))[-1]
    found = spark.read.parquet(f"{out}/{latest}").groupBy("time_bin").count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, diversity_curve(occ).collect()))
    occ.unpersist()
