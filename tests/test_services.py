"""The services as data sources, against downloads by file, and streams with state."""

from __future__ import annotations

import csv
import json
import os
from urllib import error

import pytest
from pyspark.sql import functions as F

from strata.operators.ranges import genus_ranges
from strata.plans import registry
from strata.plans.registry import QUERIES
from strata.sources import acquire, normalize, services
from strata.sources.schema import SCHEMA
from strata.sources.tables import occurrences
from strata.streaming import appearances
from strata.streaming.occurrences import occurrence_stream

ANSWERS = {
    "Permian": 'occurrence_no,identified_name,max_ma,min_ma,genus\n1,"A ""x"", ü",10,6,Aa\n2,"B\nline",NA,6,NA\n',
    "Triassic": "﻿genus,occurrence_no,extra\r\nBb,3,x\r\n",
    "Jurassic,Cretaceous": "genus,occurrence_no\nCc,4\n\nDd\n" + "".join(f"G{k},{k}\n" for k in range(9000)),
    "Older": "",
}


def answer(url, query):
    """Chunks that end within characters."""
    raw = ANSWERS[query["interval"]].encode()
    for a in range(0, len(raw), 7):
        yield raw[a : a + 7]


def shaky(url, query, options):
    """Fails in the middle of each part, as often as a file in ``folder`` does not yet say."""
    path = f"{options['folder']}/{query.get('interval', query.get('offset'))}"
    times = os.path.getsize(path) if os.path.exists(path) else 0
    with open(path, "a") as f:
        f.write("x")
    raw = ANSWERS[query["interval"]].encode()
    yield raw[: len(raw) // 2]
    if times < int(options["failures"]):
        raise error.URLError("lost")
    yield raw[len(raw) // 2 :]


def page(url, query):
    if query["limit"] == "3" and query["offset"] == "9":
        yield b'{"status": "error"}'
        return
    first, n = int(query["offset"]), int(query["limit"])
    yield json.dumps({"data": [{"occurrenceid": k, "taxonname": f"t{k}", "age": 1000 * k} for k in range(first, min(first + n, 7))]}).encode()


def read(spark, transport, **options):
    services.register(spark)
    given = {"intervals": "Permian; Triassic;Jurassic,Cretaceous;Older;Permian", "transport": f"test_services:{transport}"} | options
    return spark.read.format("pbdb").options(**given).load()


@pytest.fixture(scope="module", autouse=True)
def here(spark):
    spark.sparkContext.addPyFile(os.path.abspath(__file__))


def test_intervals_are_partitions(spark, tmp_path):
    frame = read(spark, "answer")
    assert frame.columns == list(services.PBDB_COLUMNS) and frame.rdd.getNumPartitions() == 4
    rows = frame.collect()
    assert len(rows) == 2 + 1 + 2 + 9000
    found = {r.occurrence_no: r for r in rows[:5]}
    assert found["1"].identified_name == 'A "x", ü' and found["2"].identified_name == "B\nline" and found["3"].genus == "Bb" and found["3"].max_ma is None

    for k, interval in enumerate(ANSWERS):
        acquire.fetch_pbdb(interval, str(tmp_path), f"pbdb_occurrences_{k}.csv", answer)
    downloaded = normalize.normalize_pbdb(normalize.read_pbdb(spark, str(tmp_path)))
    fetched = normalize.normalize_pbdb(normalize.without_missing(frame))
    assert fetched.dtypes == downloaded.dtypes
    assert sorted(map(str, fetched.collect())) == sorted(map(str, downloaded.collect()))


def test_own_columns(spark):
    services.register(spark)
    frame = spark.read.format("pbdb").schema("extra string, genus string").option("intervals", "Triassic").option("transport", "test_services:answer").load()
    assert [tuple(r) for r in frame.collect()] == [("x", "Bb")]
    with pytest.raises(Exception, match="are text"):
        spark.read.format("pbdb").schema("max_ma double").option("transport", "test_services:answer").load().collect()


def test_failures_are_retried(spark, tmp_path):
    want = sorted(map(str, read(spark, "answer").collect()))
    assert sorted(map(str, read(spark, "shaky", folder=str(tmp_path), failures="2").collect())) == want
    os.mkdir(tmp_path / "more")
    with pytest.raises(Exception, match="lost"):
        read(spark, "shaky", folder=str(tmp_path / "more"), failures="3").collect()


def test_recorded_files_have_a_header_each(spark, tmp_path):
    """An interval of several files is one answer with one header; a header may hold a line end, a file may lack its last one or all rows."""
    files = ['genus,"extra\nname"\nAa,1\n"B\nb",2', 'genus,"extra\nname"\nCc,3\ngenus,x\n', "", 'genus,"extra\nname"', 'genus,"extra\nname"\r\nDd,4']
    os.mkdir(tmp_path / "interval=Permian")
    for k, text in enumerate(files):
        (tmp_path / "interval=Permian" / f"part-{k}.csv").write_bytes(text.encode())
    options = {"recorded": f"file://{tmp_path}"}
    for chunk in (1, 5, 1 << 16):
        found = list(csv.reader(services.lines(services.recorded("", {"interval": "Permian"}, options, chunk))))
        assert [r for r in found if r] == [["genus", "extra\nname"], ["Aa", "1"], ["B\nb", "2"], ["Cc", "3"], ["genus", "x"], ["Dd", "4"]]
    (tmp_path / "interval=Permian" / "part-9.csv").write_text("extra,genus\n5,Ee\n")
    with pytest.raises(ValueError, match="another header"):
        list(services.recorded("", {"interval": "Permian"}, options))


def test_pbdb_source_of_several_files(spark, sf_dir):
    """As many rows as occurrences, however many files an interval was recorded in."""
    rows = occurrences(spark, sf_dir).repartition(3)
    found = registry._pbdb_source(rows)
    assert found.count() == rows.count() and found.filter("genus = 'genus'").count() == 0


def test_pages(spark):
    services.register(spark)
    source = spark.read.format("neotoma").option("transport", "test_services:page")
    frame = source.option("limit", 8).option("page", 3).load()
    assert frame.rdd.getNumPartitions() == 3
    rows = normalize.normalize_neotoma(services.neotoma_rows(frame))
    assert sorted((r.occurrence_id, r.mid_ma) for r in rows.collect()) == [(str(k), k / 1000) for k in range(7)]
    with pytest.raises(Exception, match="no data"):
        source.option("limit", 12).option("page", 3).load().collect()


def occurrence(k, genus, age, name=None):
    return (name or f"o{k}", "s", "genus", None, None, age, None, None, *(None,) * 4, genus, None, "PBDB", None, None)


def test_appearances_in_any_order(spark, tmp_path):
    """Late rows, repeated identifiers, rows without one, and a restart between any two files."""
    rows = [occurrence(k, f"G{k % 7}", float(k * 37 % 500)) for k in range(300)]
    rows += [occurrence(k, "Hot", 10.0 + k % 3) for k in range(1000, 1200)] + [occurrence(1, None, 5.0), occurrence(2, "G1", None)]
    nameless = [(None, *occurrence(0, "Hot", 400.0)[1:])] * 3
    parts = [rows[200:], rows[:120] + rows[250:], rows[100:220] + nameless, [occurrence(0, "Late", 1.0), occurrence(5, "G5", 600.0, "new")]]
    incoming, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in parts:
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(incoming)
        appearances.write_appearances(occurrence_stream(spark, incoming), out, state, slots=3).awaitTermination()
    everything = spark.createDataFrame(list(dict.fromkeys(rows + parts[3])) + nameless, SCHEMA)
    want = sorted(map(tuple, genus_ranges(everything).collect()))
    columns = ["genus", "first_appearance", "last_appearance", "occurrences", "duration"]
    assert sorted(map(tuple, appearances.appearances(spark, out).select(columns).collect())) == want
    last = spark.read.parquet(f"{out}/batch=000000003").collect()
    assert {r.genus for r in last} == {"Late", "G5"}, "a batch holds what it changed"
    appearances.compact(spark, out, str(tmp_path / "compact"))
    assert sorted(map(tuple, appearances.appearances(spark, str(tmp_path / "compact")).select(columns).collect())) == want
    appearances.write_appearances(occurrence_stream(spark, incoming), out, state, slots=3).awaitTermination()
    assert sorted(os.listdir(out))[-1] == "batch=000000003", "nothing new, nothing written"


def test_appearances_run_without_python_for_each_row(spark, tmp_path):
    """The engine remembers identifiers, by source and identifier; one that comes again with another age widens the range and counts once."""
    named = lambda source, name, age: (name, *occurrence(0, "G", age)[1:14], source, None, None)
    parts = [[named("x", "a/b", 10.0), named("x/a", "b", 20.0), named(None, "c", 20.0), named("", "c", 20.0)], [named("x", "a/b", 30.0), named(None, None, 15.0), named(None, "c", 5.0)]]
    incoming, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in parts:
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(incoming)
        query = appearances.write_appearances(occurrence_stream(spark, incoming), out, state)
        query.awaitTermination()
    assert [o["operatorName"] for o in query.recentProgress[-1]["stateOperators"]] == ["dedupe"]
    assert [tuple(r) for r in appearances.appearances(spark, out).select("genus", "first_appearance", "last_appearance", "occurrences").collect()] == [("G", 30.0, 5.0, 5)]


def test_ranges_by_deduplication(spark, tmp_path):
    """The same files in another order, with a restart between any two; a batch that runs again replaces itself."""
    rows = [occurrence(k, f"G{k % 7}", float(k * 37 % 500)) for k in range(300)] + [occurrence(k, "Hot", 10.0 + k % 3) for k in range(1000, 1200)]
    nameless = [(None, *occurrence(0, "Hot", 400.0)[1:])] * 3
    parts = [[occurrence(0, "Late", 1.0)], rows[100:420] + nameless, rows[:120] + rows[250:] + [occurrence(1, None, 5.0), occurrence(2, "G1", None)]]
    incoming, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in parts:
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(incoming)
        appearances.write_ranges(occurrence_stream(spark, incoming), out, state).awaitTermination()
    want = genus_ranges(spark.createDataFrame(rows + nameless + parts[0], SCHEMA))
    columns = ["genus", "first_appearance", "last_appearance", "occurrences", "duration"]
    assert sorted(map(tuple, appearances.ranges_so_far(spark, out).select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert sorted(os.listdir(out)) == [f"batch={k:09d}" for k in range(3)]


def test_registered(spark, sf_dir):
    assert QUERIES["pbdb_source"](spark, sf_dir).filter(F.col("genus").isNull()).count() > 0
