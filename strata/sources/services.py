"""The two occurrence services as Spark data sources.

``spark.read.format("pbdb")`` asks for one interval a partition, ``format("neotoma")`` for one page a partition, so each executor
fetches its own part and nothing passes through the driver or a local file:

    register(spark)
    raw = spark.read.format("pbdb").option("intervals", "Permian;Triassic;Jurassic").load()
    normalize.normalize_pbdb(normalize.without_missing(raw))

Options of both:

* ``transport``: ``module:function``, importable on executors, in place of HTTP.  It takes an address and a query and gives chunks of bytes.
  Further options are passed to it as they are, if it takes a third argument.
* ``retries`` (2): how often a part is asked for again when the transport fails.  Rows that were given already are passed over the next time, so
  the service must give the same rows in the same order.  After that the task fails and Spark runs it again.

``pbdb``: ``intervals``, separated by semicolons, each a partition (an interval may be a range such as ``Cambrian,Cretaceous``).  Columns of
text: those of the schema, by the header's names; without a schema the raw names of the canonical columns.  What a header lacks is null, what the schema lacks is
dropped; a part without a header gives no rows.  Fields may hold line ends; chunks may end anywhere, also within a character.

``neotoma``: ``limit`` (10,000) records in pages of ``page`` (1,000) by offset.  One column of text ``record``, the JSON of each; an answer
without ``data`` raises ValueError.  Pages beyond the last record give no rows.
"""

from __future__ import annotations

import codecs
import csv
import importlib
import inspect
import json
from collections.abc import Callable, Iterable, Iterator
from urllib import error

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from strata.sources.acquire import NEOTOMA_URL, PBDB_QUERY, PBDB_URL
from strata.sources.schema import COLUMNS, PBDB_RENAMES

_RAW = {b: a for a, b in PBDB_RENAMES.items()}
#: Names that the service gives to the canonical columns that it has.
PBDB_COLUMNS = tuple(_RAW.get(c, c) for c in COLUMNS if c not in ("mid_ma", "source_db"))
BATCH = 4096


def transport_of(options: dict[str, str]) -> Callable[[str, dict[str, str]], Iterable[bytes]]:
    module, _, name = options.get("transport", "strata.sources.acquire:http").partition(":")
    found = getattr(importlib.import_module(module), name)
    takes = [p for p in inspect.signature(found).parameters.values() if p.default is p.empty]
    return (lambda url, query: found(url, query, options)) if len(takes) > 2 else found


def lines(chunks: Iterable[bytes]) -> Iterator[str]:
    """Lines with their ends, from chunks of UTF-8 that may end anywhere."""
    decode, rest = codecs.getincrementaldecoder("utf-8-sig")(), ""
    for chunk in chunks:
        *whole, rest = (rest + decode.decode(chunk)).split("\n")
        for line in whole:
            yield line + "\n"
    if rest := rest + decode.decode(b"", final=True):
        yield rest


def retried(rows: Callable[[], Iterator], retries: int) -> Iterator:
    """All rows; after a failed transport anew, without those that were given."""
    given = 0
    for left in range(retries, -1, -1):
        try:
            for k, row in enumerate(rows()):
                if k >= given:
                    given = k + 1
                    yield row
            return
        except (error.URLError, OSError):
            if not left:
                raise


class _Part(InputPartition):
    def __init__(self, query: dict[str, str]):
        super().__init__(tuple(sorted(query.items())))
        self.query = query


class _Reader(DataSourceReader):
    def __init__(self, names: list[str], options: dict[str, str]):
        self.names, self.options, self.retries = names, dict(options), int(options.get("retries", 2))

    def rows(self, query: dict[str, str]) -> Iterator[list[str | None]]:
        raise NotImplementedError

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], self.names)
        for row in retried(lambda: self.rows(partition.query), self.retries):
            held.append(row)
            if len(held) == BATCH:
                yield batch()
                held = []
        if held:
            yield batch()


class PbdbReader(_Reader):
    def partitions(self) -> list[InputPartition]:
        given = [x.strip() for x in self.options.get("intervals", "Cambrian,Cretaceous").split(";")]
        return [_Part({"interval": x} | PBDB_QUERY) for x in dict.fromkeys(given) if x]

    def rows(self, query):
        found = csv.reader(lines(transport_of(self.options)(PBDB_URL, query)))
        header = {name: k for k, name in reversed(list(enumerate(next(found, []))))}
        places = [header.get(n) for n in self.names]
        for row in found:
            if row:
                yield [None if k is None or k >= len(row) else row[k] for k in places]


class NeotomaReader(_Reader):
    def partitions(self) -> list[InputPartition]:
        limit, page = int(self.options.get("limit", 10_000)), int(self.options.get("page", 1_000))
        return [_Part({"limit": str(min(page, limit - a)), "offset": str(a)}) for a in range(0, limit, page)]

    def rows(self, query):
        answer = json.loads(b"".join(transport_of(self.options)(NEOTOMA_URL, query)))
        if not isinstance(answer, dict) or not isinstance(answer.get("data"), list):
            raise ValueError(f"the answer for offset {query['offset']} has no data")
        for record in answer["data"]:
            yield [json.dumps(record)]


class _Source(DataSource):
    def reader(self, schema: StructType) -> DataSourceReader:
        odd = [f.name for f in schema.fields if not isinstance(f.dataType, StringType)]
        if odd:
            raise ValueError(f"columns of this source are text: {', '.join(odd)}")
        return self._reader(schema.names, self.options)


class PbdbSource(_Source):
    _reader = PbdbReader

    @classmethod
    def name(cls) -> str:
        return "pbdb"

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in PBDB_COLUMNS])


class NeotomaSource(_Source):
    _reader = NeotomaReader

    @classmethod
    def name(cls) -> str:
        return "neotoma"

    def schema(self) -> StructType:
        return StructType([StructField("record", StringType())])


def register(spark: SparkSession) -> None:
    for source in (PbdbSource, NeotomaSource):
        spark.dataSource.register(source)


def neotoma_rows(records: DataFrame) -> DataFrame:
    """What ``normalize.normalize_neotoma`` takes; records that are no JSON are null."""
    return records.select(F.try_parse_json("record").alias("row"))


def first_record(read: Callable[[int], bytes], chunk: int) -> tuple[bytes, bytes]:
    """The first record of a CSV file with its line end, which a quoted field may hold too, and what was read after it."""
    raw, at = read(chunk), -1
    while raw:
        at = raw.find(b"\n", at + 1)
        if at >= 0 and raw.count(b'"', 0, at) % 2 == 0:
            return raw[: at + 1], raw[at + 1 :]
        if at < 0:
            at = len(raw) - 1
            more = read(chunk)
            if not more:
                break
            raw += more
    return raw, b""


def recorded(url: str, query: dict[str, str], options: dict[str, str], chunk: int = 1 << 16) -> Iterator[bytes]:
    """A transport that answers from the folder ``recorded``: PBDB's parts are the files below ``interval=<name>``, Neotoma's pages those below
    ``offset=<number>``, one after the other by name.  Each of PBDB's files has its header, which an answer gives once; another header
    than the first file's raises ValueError."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(options["recorded"])
    part = f"interval={query['interval']}" if "interval" in query else f"offset={query['offset']}"
    found = sorted(f.path for f in system.get_file_info(fs.FileSelector(f"{root}/{part}", allow_not_found=True)) if f.is_file and not f.base_name.startswith(("_", ".")))
    header, last = b"", b"\n"
    for path in found:
        with system.open_input_stream(path) as f:
            if "interval" in query:
                head, rest = first_record(f.read, chunk)
                if header and head and head.rstrip(b"\r\n") != header.rstrip(b"\r\n"):
                    raise ValueError(f"{path} has another header than the files before it")
                start = rest if header else head + rest
                header = header or head
                yield start if last.endswith(b"\n") else b"\n" + start  # a file may end without a line end
                last = start or last
            while raw := f.read(chunk):
                yield raw
                last = raw
