"""WARC archives of pages with a two-level capture index.

``write_archives`` sorts captures by reversed-host URL key over all shards.  A shard is three files: ``pages-N.warc.gz`` (a gzip member for
each record), ``index-N.gz`` (a line for each capture in key order, in compressed blocks of ``lines`` lines) and ``blocks-N.txt``, the
sparse directory: first key, place and length of each block.  The driver only sees a row for each shard: number and first and last key.

``look_up`` deals keys to the shards whose range holds them, in order.  A task loads its shard's directory, finds the block by binary
search, reads that range of the index, finds the lines by binary search in the block, and reads the records' ranges of the archive.  As
records lie in key order, neighbouring lookups read neighbouring ranges.

Of captures with the same payload, that with the greatest key is a ``response``, the others are ``revisit`` records which refer to it and hold
no payload but the HTTP headers, with the payload's length; payloads of fewer than ``least`` bytes are stored each time.  Decisions
are made on digests of payloads; only the final shuffle by URL key moves payloads, where each meets its decision as a neighbour.
Files are written under a name of their own and renamed, with the same bytes for the same input, so a task may run again at any time.

Defined results: a null payload counts as empty; a null or empty URL has the empty key; a URL without ``scheme://`` is its own key; blanks and
control characters in keys and targets are percent-encoded; a null page key is the least and read back as null; of several rows with the
greatest key and the same payload one is the response; rows alike in all columns each give a record; an empty table gives no shards;
payloads of any length are stored whole, one at a time in memory; further columns are not read, whatever their names.  The table must
give the same rows in the same partitions when it is read again, as files do; a payload that does not fit its decision raises ValueError.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import columns, discard, materialise, shared_dir, spread_join
from strata.llm.token_files import file_system

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = {"archive": "pages-{:06d}.warc.gz", "index": "index-{:06d}.gz", "blocks": "blocks-{:06d}.txt"}
_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]*)?(.*)$"
_ODD = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: Column) -> Column:
    """``scheme://www.example.com:8/a?b`` as ``com,example,www:8)/a?b``."""
    url = encoded = F.coalesce(url, F.lit(""))
    for code in (*range(0x21), 0x7F):
        encoded = F.replace(encoded, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    url = F.when(url.rlike(_ODD.pattern), encoded).otherwise(url)
    host, port, rest = (F.regexp_extract(url, _URL, k) for k in (1, 2, 3))
    turned = F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), port, F.lit(")"), rest)
    return F.when(url.rlike(_URL), turned).otherwise(url)


def quoted(url: str) -> str:
    return _ODD.sub(lambda m: f"%{ord(m[0]):02X}", url)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name_of(page: str | None, row: int) -> str:
    return f"urn:page:{'' if page is None else page}:{row}"


def page_of(name: str) -> str | None:
    return name.strip("<>").split(":")[2] or None


def record(url: str, page: str | None, row: int, payload: bytes, refers: tuple[str | None, int] | None, date: str) -> bytes:
    """A WARC record; a revisit if it refers to another one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Target-URI: {quoted(url)}", f"WARC-Date: {date}", f"WARC-Record-ID: <{name_of(page, row)}>",
            f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers:
        head[4:4] = [f"WARC-Refers-To: <{name_of(*refers)}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


def parse(raw: bytes) -> dict:
    """What a record says of its capture; raises ValueError if length or digest do not fit."""
    head, rest = _headers(raw)
    size = int(head["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {head['warc-record-id']} has another length")
    http, payload = _headers(block)
    digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
    if kind == "response" and (len(payload) != int(http["content-length"]) or base32_sha1(payload) != digest):
        raise ValueError(f"the payload of {head['warc-record-id']} is damaged")
    refers = head.get("warc-refers-to")
    return {"page": page_of(head["warc-record-id"]), "url": head["warc-target-uri"], "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": kind,
            "refers_to": page_of(refers) if refers else None, "payload": payload if kind == "response" else None}


def packed(raw: bytes, level: int) -> bytes:
    made = zlib.compressobj(level, zlib.DEFLATED, 31)
    return made.compress(raw) + made.flush()


def decisions(pages: DataFrame, least: int) -> DataFrame:
    """pages: (at, page, row, payload).  (at, page, row, mark, other_page, other_row): which capture each refers to, if any."""
    marked = pages.select("at", "page", "row", F.sha2("payload", 256).alias("mark"), F.octet_length("payload").alias("size"))
    held = materialise(marked, "captures")
    same = held.filter(F.col("size") >= least).groupBy("mark").agg(F.count("*").alias("n"), F.max(F.struct("page", "row")).alias("last")).filter("n > 1")
    copies = materialise(same, "copies")
    joined = spread_join(held, copies, "mark", "n", held.count(), "left")
    mine = F.col("row") == F.col("last.row")
    out = materialise(joined.select("at", "page", "row", "mark", F.when(~mine, F.col("last.page")).alias("other_page"), F.when(~mine, F.col("last.row")).alias("other_row")), "decisions")
    discard(held, copies)
    return out


def write_archives(pages: DataFrame, folder: str, url: str = "url", payload: str = "html", key: str = "page_id", least: int = 0, lines: int = 1024, level: int = 6,
                   date: str = "1970-01-01T00:00:00Z", parts: int | None = None) -> list[tuple[int, int, str, str]]:
    """Writes the archives and their index; returns (shard, captures, first key, last key) by shard."""
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = pages.select(url_key(F.col(url)).alias("at"), F.col(key).alias("page"), F.monotonically_increasing_id().alias("row"), F.col(url).alias("url"), F.coalesce(payload, F.lit("")).alias("payload"))
    decided = decisions(given, least)
    none = lambda kind: F.lit(None).cast(kind)
    kind = pages.schema[key].dataType
    both = decided.select("at", "page", "row", none("string").alias("url"), none("string").alias("payload"), "mark", "other_page", "other_row").unionByName(
        given.select("*", none("string").alias("mark"), none(kind).alias("other_page"), none("long").alias("other_row")))
    order = ["at", "page", "row"]
    dealt = both.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.col("mark").isNull())
    text = lambda x: None if x is None else str(x)

    def run(batches):
        system, root = file_system(folder)
        shard = TaskContext.get().partitionId()
        names = {k: f"{root}/{v.format(shard)}" for k, v in FILES.items()}
        own = {k: f"{v}.{uuid.uuid4().hex}" for k, v in names.items()}
        out, ends, n, held, first, last, decision = None, dict.fromkeys(FILES, 0), 0, [], None, None, None

        def put(name: str, raw: bytes) -> tuple[int, int]:
            at = ends[name]
            out[name].write(raw)
            ends[name] += len(raw)
            return at, len(raw)

        def flush() -> None:
            at, size = put("index", packed("".join(held).encode(), level))
            put("blocks", f"{held[0].partition(chr(9))[0]}\t{at}\t{size}\n".encode())
            held.clear()

        for batch in batches:
            for at, page, row, target, body, mark, other_page, other_row in zip(*columns(batch, "at", "page", "row", "url", "payload", "mark", "other_page", "other_row")):
                if mark.is_valid:
                    decision = (row.as_py(), mark.as_py(), None if not other_row.is_valid else (text(other_page.as_py()), other_row.as_py()))
                    continue
                raw = body.as_py().encode()
                if decision is None or decision[:2] != (row.as_py(), hashlib.sha256(raw).hexdigest()):
                    raise ValueError("the table gave other rows when it was read again")
                if out is None:
                    out = {k: system.open_output_stream(v) for k, v in own.items()}
                last = at.as_py()
                first = last if first is None else first
                made = record(target.as_py() or "", text(page.as_py()), row.as_py(), raw, decision[2], date)
                held.append("{}\t{}\t{}\n".format(last, *put("archive", packed(made, level))))
                n += 1
                if len(held) == lines:
                    flush()
        if out is not None:
            if held:
                flush()
            for k in FILES:
                out[k].close()
                system.move(own[k], names[k])
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": [n], "first": [first], "last": [last]})

    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    found = sorted(map(tuple, dealt.mapInArrow(run, "shard int, n long, first string, last string").collect()))
    discard(decided)
    return found


class Ranges:
    """Reads ranges of a file, ``ahead`` bytes at a time."""

    def __init__(self, system, path: str, ahead: int):
        self.file, self.ahead, self.at, self.held = system.open_input_file(path), ahead, 0, b""

    def read(self, at: int, size: int) -> bytes:
        if not self.at <= at or at + size > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(max(size, self.ahead), at)
        return self.held[at - self.at : at - self.at + size]


class CaptureIndex:
    """Lookups in one shard."""

    def __init__(self, folder: str, shard: int, ahead: int = 1 << 18):
        system, root = file_system(folder)
        with system.open_input_file(f"{root}/{FILES['blocks'].format(shard)}") as f:
            entries = [x.split("\t") for x in f.read().decode().splitlines()]
        self.first, self.place = [x[0].encode() for x in entries], [(int(a), int(n)) for _, a, n in entries]
        self.index, self.archive = (Ranges(system, f"{root}/{FILES[k].format(shard)}", ahead) for k in ("index", "archive"))
        self.block, self.lines = -1, []

    def _load(self, block: int) -> list[tuple[bytes, int, int]]:
        if block != self.block:
            found = zlib.decompress(self.index.read(*self.place[block]), 31).splitlines()
            self.block, self.lines = block, [(k, int(a), int(n)) for k, a, n in (x.split(b"\t") for x in found)]
        return self.lines

    def captures(self, key: bytes):
        """The records of a key, in order."""
        block = max(0, bisect.bisect_left(self.first, key) - 1)  # a block may end with the key that the next one begins with
        while block < len(self.first) and self.first[block] <= key:
            found = self._load(block)
            at = bisect.bisect_left(found, (key,))
            while at < len(found) and found[at][0] == key:
                yield zlib.decompress(self.archive.read(*found[at][1:]), 31)
                at += 1
            block += 1


def look_up(keys: DataFrame, folder: str, shards: list[tuple[int, int, str, str]], column: str = "at", page_type: str = "long") -> DataFrame:
    """(key, url, page_id, payload_bytes, payload_digest, record_type, refers_to) of all captures of each distinct key in ``column``."""
    bounds = sorted((first.encode(), last.encode(), shard) for shard, _, first, last in shards)
    firsts, lasts = [x[0] for x in bounds], [x[1] for x in bounds]

    def deal(batches):
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for key in batch.column(0).to_pylist():
                raw = key.encode()
                for k in range(bisect.bisect_left(lasts, raw), bisect.bisect_right(firsts, raw)):
                    out[0].append(k)
                    out[1].append(key)
            yield pa.RecordBatch.from_pydict({"place": pa.array(out[0], pa.int32()), "at": pa.array(out[1], pa.string())})

    def run(batches):
        shard, index = None, None
        names = ("url", "page", "payload_bytes", "payload_digest", "record_type", "refers_to")
        for batch in batches:
            rows: list[tuple] = []
            for place, key in zip(*(c.to_pylist() for c in columns(batch, "place", "at"))):
                if place != shard:
                    shard, index = place, CaptureIndex(folder, bounds[place][2])
                for raw in index.captures(key.encode()):
                    found = parse(raw)
                    rows.append((key, *(found[x] for x in names)))
            kinds = {"at": pa.string(), **{x: pa.int64() if x == "payload_bytes" else pa.string() for x in names}}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))

    wanted = keys.select(F.col(column).alias("at")).filter(F.col("at").isNotNull()).distinct().mapInArrow(deal, "place int, at string")
    dealt = wanted.repartitionById(max(1, len(bounds)), F.col("place")).sortWithinPartitions("place", "at")
    read = dealt.mapInArrow(run, "at string, url string, page string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return read.select(F.col("at").alias("key"), "url", F.col("page").cast(page_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(page_type).alias("refers_to"))


def archive_round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes all pages to a new folder in the shared one and finds each of them again through the index."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    shards = write_archives(pages, folder, least=least)
    return look_up(pages.select(url_key(F.col("url")).alias("at")), folder, shards, page_type=pages.schema["page_id"].dataType.simpleString()).drop("key")
