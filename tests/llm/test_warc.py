"""WARC archives and their capture index against a plain version, a sequential reading and DuckDB."""

from __future__ import annotations

import base64
import glob
import gzip
import hashlib
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from strata.llm import oracle, warc


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain(rows, least=0) -> list[tuple]:
    """One response for each payload: the row with the greatest key."""
    groups: dict = {}
    for page, _, html in rows:
        groups.setdefault(html or "", []).append(page)
    out = []
    for html, pages in groups.items():
        raw = html.encode()
        pages.sort(key=lambda x: (x is not None, x or 0))
        for k, page in enumerate(pages):
            last = k + 1 == len(pages) or len(raw) < least
            out.append((page, len(raw), digest(raw), "response" if last else "revisit", None if last else pages[-1]))
    return out


@pytest.fixture(scope="module")
def page_rows():
    rows = [(k, f"http://{'www.' * (k % 2)}Site{k % 7}.example.com{':8080' * (k % 5 == 0)}/a/{k % 11}?q={k}", f"<p>page {k}</p>" + "x" * (k % 50)) for k in range(300)]
    rows += [(1000 + k, "http://hot.example.org/same", "<html>copy</html>") for k in range(150)]
    rows += [(2000, None, None), (2001, "", ""), (2002, "no scheme\tand blank", "a"), (2003, "http://user@h.example/\n", "A\r\n\r\nWARC/1.1\r\n\r\n"), (2004, "http://é.example/ü", "ü" * 40_000), (None, "http://none.example/", "<p>page 3</p>xxx")]
    rows += [(7, "http://www.Site0.example.com/a/7?q=7", "<p>page 7</p>xxxxxxx")] * 2 + [(None, None, None)] * 2
    return rows


@pytest.fixture(scope="module")
def pages(spark, page_rows):
    schema = "page_id long, url string, html string, at int, payload int, row string"
    return spark.createDataFrame([(*r, 1, 2, "x") for r in page_rows], schema).repartition(3).persist()


NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("least", [0, 30])
def test_round_trip(spark, pages, page_rows, least):
    found = warc.archive_round_trip(spark, pages, least=least).select(*NAMES).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, plain(page_rows, least)))


def test_files(spark, pages, page_rows, tmp_path):
    """Small blocks: every file reads as a whole too, keys ascend over all shards, and lookups give what a sequential reading gives."""
    folder = str(tmp_path / "w")
    shards = warc.write_archives(pages, folder, lines=4, parts=5)
    assert sum(n for _, n, _, _ in shards) == len(page_rows) and len(shards) > 2
    keys, records, entries = [], 0, 0
    for shard, n, first, last in shards:
        lines = gzip.open(f"{folder}/{warc.FILES['index'].format(shard)}").read().decode().splitlines()
        own = [x.split("\t")[0] for x in lines]
        assert (len(lines), own[0], own[-1]) == (n, first, last)
        entries += len(open(f"{folder}/{warc.FILES['blocks'].format(shard)}", newline="\n").read().splitlines())
        keys += own
        records += gzip.open(f"{folder}/{warc.FILES['archive'].format(shard)}").read().count(b"WARC-Record-ID: ")
    assert keys == sorted(keys, key=str.encode) and records == len(page_rows) and entries >= len(page_rows) // 4
    assert len(glob.glob(f"{folder}/*")) == 3 * len(shards)

    wanted = spark.createDataFrame([("org,example,hot)/same",), ("com,example,site0)/a/3?q=14",), ("absent",), ("",), ("zzz",), (None,), ("org,example,hot)/same",)], "at string")
    found = warc.look_up(wanted, folder, shards).groupBy("key").count().collect()
    assert {r.key: r["count"] for r in found} == {"org,example,hot)/same": 150, "com,example,site0)/a/3?q=14": 1, "": 4}


def test_keys(spark):
    urls = ["http://www.Example.com:8/a?b#c", "https://example.org", "ftp://u:p@x.y.z/", "mailto:a@b", "plain text", "", None, "http://a.b/x y"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in frame.select(warc.url_key(F.col("url"))).collect()] == ["com,example,www:8)/a?b#c", "org,example)", "z,y,x)/", "mailto:a@b", "plain%20text", "", "", "b,a)/x%20y"]
    assert urlsplit("http://www.Example.com:8/a").hostname == "www.example.com"


def test_damage():
    raw = warc.record("http://a/", "5", 0, b"payload", None, "1970-01-01T00:00:00Z")
    assert warc.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"\r\n\r\npayload", b"\r\n\r\npaYload"))
    with pytest.raises(ValueError):
        warc.parse(raw[:-6])


def test_empty(spark, pages):
    assert warc.archive_round_trip(spark, pages.limit(0)).collect() == []


def test_sql(spark, pages):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    rows = [r for r in pages.select("page_id", "url", "html").distinct().collect() if r.page_id is not None]
    con.executemany("insert into pages values (?, ?, ?)", [tuple(r) for r in rows])
    want = con.execute(oracle.WARC).fetchall()
    found = warc.archive_round_trip(spark, pages.filter("page_id is not null").dropDuplicates(["page_id", "url", "html"])).select(*NAMES, "url").collect()
    assert sorted(str(r[:5]) for r in map(tuple, found)) == sorted(str(r[:5]) for r in want)
