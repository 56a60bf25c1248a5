"""Token ids as flat binary files.

A corpus is a folder of shards.  A shard holds the documents of a range of keys, in ascending order, as three flat little-endian
files: ``tokens-N.bin`` (unsigned 16- or 32-bit ids, one document after the other), ``offsets-N.bin`` (n+1 unsigned 64-bit
places of documents in the shard's ids) and ``keys-N.bin`` (signed 64-bit keys).  The manifest has each shard's number of
documents and tokens; prefix sums over it are the shards' bases, so a document's place in the whole corpus is its shard's base
plus its own offset.

Ranges are of the key and, at a tie, the first bytes of the text, so that many rows without a key, or with the same one, do not meet in one
task; their number follows the bytes of the table.  One shuffle then brings texts into order and ids are
written as they are made.  A task writes under names of its own and renames at the end, and the same input gives the
same bytes, so a task may run again at any time.  Files are memory-mapped to be read; a shared folder that only a file-system
library reaches is read and written through pyarrow's file systems.

Defined results: null text counts as empty (the end id alone); rows with equal keys follow each other by text; a null key comes
first and is written as the least 64-bit number, read back as null, as is a key of that very number; an empty table gives no shards; a key that is
no integer raises TypeError; texts of any length are written whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from strata.llm.common import blocks, columns, shared_dir, text_buffer
from strata.llm.segments import library_encoder

NULL_KEY = -(1 << 63)
FILES = ("tokens", "offsets", "keys")


def file_system(uri: str):
    """(pyarrow file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def range_partitions(frame: DataFrame, key: str, text: str, parts: int | None = None, target: int = 1 << 29) -> DataFrame:
    """``frame`` in partitions of ascending ranges of an integer key and, at a tie, the first bytes of the text; each sorted by key and then the text.

    ``parts`` of them, or ``spark.sql.shuffle.partitions`` and at least one for each ``target`` bytes that the plan's statistics tell.
    """
    if not isinstance(frame.schema[key].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"{key} is no integer; number the rows first")
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = 0 if size >= 1 << 62 else size  # unknown
    parts = parts or min(max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // target), 1 << 20)
    head = F.substring(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 1, 7)
    dealt = frame.withColumn("_head", head).repartitionByRange(parts, F.col(key).asc_nulls_first(), "_head").drop("_head")
    return dealt.sortWithinPartitions(F.col(key).asc_nulls_first(), text)


@functools.cache
def _encoder(path: str):
    from tokenizers import Tokenizer

    return library_encoder(Tokenizer.from_file(path))


def write_corpus(docs: DataFrame, folder: str, tokenizer: str, end_id: int, parts: int | None = None, wide: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes the shards of ``docs``; returns the manifest (shard, n_docs, n_tokens), which is computed when asked for."""
    kind = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterator[pa.RecordBatch]):
        system, root = file_system(folder)
        encoder, shard = _encoder(tokenizer), TaskContext.get().partitionId()
        names = {f: f"{root}/{f}-{shard:06d}.bin" for f in FILES}
        own = {f: f"{n}.{uuid.uuid4().hex}" for f, n in names.items()}
        out, docs_here, ids_here = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = {f: system.open_output_stream(n) for f, n in own.items()}
                out["offsets"].write(np.zeros(1, "<u8").tobytes())
            keys, texts = columns(batch, key, text)
            out["keys"].write(keys.cast(pa.int64()).fill_null(NULL_KEY).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            data, offsets = text_buffer(texts)
            for a, b in blocks(offsets, 2 << 20):
                ids, places = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if len(ids) and ids.max() > np.iinfo(kind).max or end_id > np.iinfo(kind).max:
                    raise ValueError("an id needs more bits; write with wide=True")
                full = np.insert(ids, places[1:], end_id)
                out["tokens"].write(full.astype(kind).tobytes())
                out["offsets"].write((ids_here + places[1:] + np.arange(1, b - a + 1)).astype("<u8").tobytes())
                ids_here += len(full)
            docs_here += batch.num_rows
        if out is not None:
            for f in FILES:
                out[f].close()
                system.move(own[f], names[f])
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [docs_here], "n_tokens": [ids_here]})

    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    return range_partitions(docs.select(key, text), key, text, parts).mapInArrow(run, "shard int, n_docs long, n_tokens long")


def manifest_with_bases(manifest: DataFrame) -> list[tuple[int, int, int, int]]:
    """(shard, n_docs, n_tokens, base) by shard; there is one row for each written partition."""
    rows = sorted((r.shard, r.n_docs, r.n_tokens) for r in manifest.collect())
    bases = np.cumsum([0, *(n for _, _, n in rows)]).tolist()
    return [(*r, b) for r, b in zip(rows, bases)]


def open_flat(folder: str, name: str, shard: int, kind: str) -> np.ndarray:
    """A flat file as an array; memory-mapped where the folder is a local path."""
    system, root = file_system(folder)
    path = f"{root}/{name}-{shard:06d}.bin"
    if system.type_name == "local":
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)


def read_corpus(spark: SparkSession, folder: str, shards: list[tuple[int, int, int, int]], wide: bool = False, key: str = "doc_id", step: int = 4096) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, from the files; ``shards`` as ``manifest_with_bases`` gives them."""
    kind = "<u4" if wide else "<u2"

    def run(batches):
        for batch in batches:
            for shard, n, total, base in zip(*(c.to_pylist() for c in batch.columns)):
                tokens, offsets, keys = open_flat(folder, "tokens", shard, kind), open_flat(folder, "offsets", shard, "<u8"), open_flat(folder, "keys", shard, "<i8")
                if (len(keys), len(offsets), len(tokens)) != (n, n + 1, total) or offsets[-1] != total:
                    raise ValueError(f"shard {shard} does not fit its manifest")
                for a in range(0, n, step):
                    at = offsets[a : min(n, a + step) + 1].astype(np.int64)
                    raw = memoryview(tokens[at[0] : at[-1]].astype("<u4").tobytes())
                    ends = (4 * (at - at[0])).tolist()
                    mine = keys[a : a + step]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.asarray(mine), mask=np.asarray(mine == NULL_KEY)), pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array([zlib.crc32(raw[x:y]) for x, y in zip(ends, ends[1:])], pa.int64())],
                        [key, "start", "n_tokens", "ids_crc32"])

    schema = "shard int, n_docs long, n_tokens long, base long"
    rows = spark.createDataFrame(shards, schema).repartitionById(max(1, len(shards)), F.col("shard") % max(1, len(shards)))
    return rows.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, parts: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes ``docs`` to a new folder in the shared one and gives each document as the files have it."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    shards = manifest_with_bases(write_corpus(docs, folder, tokenizer, end_id, parts, text=text, key=key))
    return read_corpus(spark, folder, shards, key=key)
