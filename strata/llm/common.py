"""Shared helpers: document frames, Arrow text buffers, materialised intermediates."""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` and ``text`` of the documents table; a null text is read as the empty text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); where it is unset, a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return found.rstrip("/") if found else _own_dir()


@functools.cache
def _own_dir() -> str:
    made = tempfile.mkdtemp(prefix="strata-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes the tables that ``materialise`` wrote for these frames; nothing may read them afterwards."""
    for frame in frames:
        session = frame.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(frame._written)
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and its n+1 offsets from 0; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def raws(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; nulls count as empty."""
    data, offsets = text_buffer(column)
    return [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def give_back() -> None:
    """Returns what this process has freed to the system: Arrow's pool and, where the C library can, its heap.

    Python workers live on between tasks and stages; what they keep counts against an executor's memory.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def leaving_none(run):
    """``run`` (batches to batches), after which nothing that it freed stays with the worker."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to ``rows`` rows or somewhat more."""
    held, n = [], 0
    join = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield join()
            held, n = [], 0
    if n:
        yield join()


def blocks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of documents with about ``size`` bytes each; a longer document is a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def spread_join(frame: DataFrame, table: DataFrame, on: str, rows: str, total: int, how: str = "inner", share: int = 10_000) -> DataFrame:
    """``frame`` joined with ``table``, which has a row for each value of ``on`` and the number of its rows in ``frame`` as ``rows``.

    Values of a ``share``-th of all ``total`` rows or more are hot: there are ``share`` of them at most, which are broadcast, so no
    hot value's rows meet in one task.  Both frames are read twice.
    """
    hot = F.broadcast(table.filter(F.col(rows) * share >= total))
    return frame.join(hot, on).unionByName(frame.join(hot.select(on), on, "left_anti").join(table, on, how))


def range_index(key, bounds: list):
    """The number of sorted ``bounds`` at or below ``key`` (0 for null), looked up in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse, table = (F.array(*map(F.lit, some)) for some in (bounds[step - 1 :: step], bounds))
    if isinstance(bounds[0], Decimal):  # one type for all, so that no bound is cast for each row
        coarse, table = (some.cast("array<decimal(38,0)>") for some in (coarse, table))
    below = lambda some: F.size(F.filter(some, lambda b: b <= key))
    at = below(coarse) * step if len(bounds) >= step else F.lit(0)
    return F.when(key.isNotNull(), at + below(F.slice(table, at + 1, step))).otherwise(0).cast("int")


def quantile_bounds(frame: DataFrame, key: str, parts: int) -> list:
    """Up to ``parts`` - 1 distinct values that part the key column evenly; only that column is read."""
    ticks = [k / parts for k in range(1, parts)]
    found = frame.select(F.percentile_approx(key, ticks, 20 * parts).alias("q")).first().q if ticks else None
    return sorted(set(found or []))


@dataclass
class KeyRanges:
    """Ranges of rows by an integer key (null least) and, at a tie, by the first seven bytes of the text: rows of ``place`` in order."""

    place: Column
    bounds: list

    @property
    def number(self) -> Column:
        """The range of a row, from 0."""
        return range_index(self.place, self.bounds)


def key_ranges(rows: DataFrame, key: str, text: str, parts: int | None = None, falling_texts: bool = False, target: int = 1 << 30) -> KeyRanges:
    """Ranges of about equal numbers of rows: ``parts``, or ``spark.sql.shuffle.partitions`` and at least one for each ``target`` bytes of text.

    Rows that share a key, or have none, fall into several ranges too; only those that begin alike stay together.
    """
    if not isinstance(rows.schema[key].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"{key} is no integer; number the rows first")
    found = rows.agg(F.sum(F.octet_length(text)).alias("bytes"), F.min(key).alias("least")).first()
    parts = parts or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), (found.bytes or 0) // target)
    head = F.conv(F.rpad(F.hex(F.substring(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("decimal(18,0)")
    head = F.lit(1 << 56).cast("decimal(18,0)") - 1 - head if falling_texts else head
    before = F.lit(str((found.least or 0) - 1)).cast("decimal(20,0)")
    place = (F.coalesce(F.col(key).cast("decimal(20,0)"), before) * F.lit(1 << 56).cast("decimal(17,0)") + head).cast("decimal(38,0)")
    return KeyRanges(place, quantile_bounds(rows.select(place.alias("place")), "place", parts))
