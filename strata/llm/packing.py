"""Vector best-fit packing of token sequences.

Items have a size in three dimensions: tokens, documents (1 each) and attention cost (the square of their tokens).  Lengths
are whole numbers up to the capacity, so items fall into at most ``capacity`` classes, and a corpus of any size is packed by its
histogram: classes are dealt from long to short, each to the class of open bins with the best score among those which have room in
every dimension, as many at a time as either class has.  The score of a bin is either the weighted dot product of the item's
size and the bin's residual (more is better) or the weighted norm of the residual after placing (less is better).  All given rules
are tried on the histogram and the one with fewest bins is taken.

With one limit on tokens alone (1,024 documents and 1,024 squared in attention never bind below 1,024 tokens) every rule keeps the
token limit, and the further dimensions only rank bins; smaller limits bind, and then a rule that sees them needs fewer bins.

A plan is a list of runs: items of one length, ranks lo.. up, go to consecutive bins at one offset.  Ranks within a length come
from window functions over hashed buckets, whose number follows the items, and prefix sums of bucket counts, so that a length which
many documents share does not meet in one task; each item then looks up its run among those of its length.

Defined results: null text counts as empty (the end id alone); only documents above the capacity are cut, into full pieces after
a first piece with the rest; repeated rows are packed each; an empty table gives no pieces; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import blocks, columns, give_back, leaving_none, materialise, text_buffer
from strata.llm.segments import library_encoder


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024


@dataclass(frozen=True)
class Rule:
    """How bins are chosen: ``dot`` or ``norm``, with weights for tokens, documents and attention."""

    kind: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)


#: The first one of those with the fewest bins is taken.
RULES = (Rule("norm", (1.0, 0.1, 0.1)), Rule("norm", (1.0, 0.0, 0.5)), Rule("dot", (1.0, 0.1, 0.1)), Rule("dot", (0.0, 0.0, 1.0)), Rule("norm", (1.0, 0.0, 0.0)), Rule("dot", (1.0, 0.0, 0.0)))

#: length, rank of the first item, number of items, bin of the first item, place in the bin
Run = tuple[int, int, int, int, int]


def pack_histogram(histogram: dict[int, int], limits: Limits, rule: Rule) -> tuple[list[Run], int]:
    """Runs of a plan for so many items of each length, and the number of bins."""
    caps = np.array([limits.tokens, limits.documents, limits.attention], float)
    weights = np.array(rule.weights)
    runs: list[Run] = []
    open_bins: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)  # residual: ranges (first bin, number)
    bins = 0
    for length in sorted(histogram, reverse=True):
        size, left, rank = (length, 1, length * length), histogram[length], 0
        if any(s > c for s, c in zip(size, caps)):
            raise ValueError(f"an item of {length} tokens exceeds the limits of a bin")
        fitting = [r for r in open_bins if all(a >= b for a, b in zip(r, size))]
        if fitting and left:
            room = np.array(fitting, float) / caps
            item = np.array(size) / caps
            score = (weights * room * item).sum(1) if rule.kind == "dot" else -(weights * (room - item) ** 2).sum(1)
            for k in np.lexsort((np.array(fitting)[:, 0], -score)).tolist():
                state = fitting[k]
                while left:
                    fits = min(a // b for a, b in zip(state, size))
                    if not fits or not open_bins[state]:
                        break
                    start, number = open_bins[state].pop()
                    if number > left:
                        open_bins[state].append((start + left, number - left))
                        number = left
                    runs.append((length, rank, number, start, limits.tokens - state[0]))
                    rank, left = rank + number, left - number
                    # as many more items of this length as the class of bins just filled takes come next by its own score
                    after = tuple(a - b for a, b in zip(state, size))
                    while left and all(a >= b for a, b in zip(after, size)):
                        more = min(left, number)
                        if more < number:
                            open_bins[after].append((start + more, number - more))
                            number = more
                        runs.append((length, rank, number, start, limits.tokens - after[0]))
                        rank, left = rank + number, left - number
                        after = tuple(a - b for a, b in zip(after, size))
                    open_bins[after].append((start, number))
                if not open_bins[state]:
                    del open_bins[state]
                if not left:
                    break
        each = min(int(c // s) for s, c in zip(size, caps))
        while left:  # new bins, filled with items of this length
            number, many = max(1, left // each), min(each, left)
            for k in range(many):
                runs.append((length, rank, number, bins, k * length))
                rank += number
            left -= number * many
            open_bins[tuple(int(c) - many * s for s, c in zip(size, caps))].append((bins, number))
            bins += number
    return runs, bins


def plan(histogram: dict[int, int], limits: Limits, rules: tuple[Rule, ...] = RULES) -> tuple[list[Run], int]:
    return min((pack_histogram(histogram, limits, r) for r in rules), key=lambda found: found[1])


@functools.cache
def _encoder(path: str):
    from tokenizers import Tokenizer

    return library_encoder(Tokenizer.from_file(path))


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, text: str = "text", key: str = "doc_id", keep: str | None = None) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): the pieces of each document.  ``keep``: name of a column for the ids."""

    def run(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            keys, texts = columns(batch, key, text)
            data, offsets = text_buffer(texts)
            for a, b in blocks(offsets, 2 << 20):
                ids, places = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                full = np.insert(ids, places[1:], end_id)
                at = places + np.arange(b - a + 1)
                size = np.diff(at)
                number = -(-size // capacity)
                row = np.repeat(np.arange(b - a), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                first = size - (number - 1) * capacity
                start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[row])
                raw = memoryview(full.astype("<u4").tobytes())
                begin = at[row] + start
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(begin.tolist(), (begin + length).tolist())]
                out = {key: keys.slice(a, b - a).take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64())}
                if keep:
                    out[keep] = pa.ListArray.from_arrays(pa.array(np.append(begin, at[-1]), pa.int32()), pa.array(full.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)
                give_back()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(leaving_none(run), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + (f", {keep} array<int>" if keep else ""))


def place(items: DataFrame, limits: Limits = Limits(), rules: tuple[Rule, ...] = RULES, length: str = "length", salt: str | None = None, bucket_rows: int = 1_000_000) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``, without ``salt``.  ``items`` is read several times, so it should be a written table.

    Items of one length are ranked in buckets of about ``bucket_rows`` by a hash of the row; rows that may be alike in every column
    need a ``salt`` column, so that they spread too.
    """
    spark = items.sparkSession
    histogram = {int(r[length]): r.n for r in items.groupBy(length).agg(F.count("*").alias("n")).collect()}  # at most limits.tokens rows
    runs, _ = plan(histogram, limits, rules)
    by_length = defaultdict(list)
    for n, *run in runs:
        by_length[n].append(tuple(run))
    # a row for each length; a plan has at most limits.tokens ** 2 runs, whatever the number of items
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("lo", "number", "bin", "at")]))
    runs_of = [[dict(zip(("lo", "number", "bin", "at"), run)) for run in some] for some in by_length.values()]
    # from Arrow, as a list would start Python workers that only pass it on
    table = spark.createDataFrame(pa.table({"_length": pa.array(list(by_length), pa.int64()), "_runs": pa.array(runs_of, kind)}))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(histogram.values()) // bucket_rows)
    row = F.struct(*(c for c in items.columns if c != salt))
    marked = items.select(row.alias("_row"), F.col(length).cast("long").alias("_length"), F.pmod(F.xxhash64(*items.columns), F.lit(buckets)).alias("_bucket"))
    counts = marked.groupBy("_length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = counts.select("_length", "_bucket", (F.sum("_n").over(before) - F.col("_n")).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_length", "_bucket").orderBy("_row")) - 1
    ranked = marked.withColumn("_within", within).join(bases, ["_length", "_bucket"]).withColumn("_rank", F.col("_within") + F.col("_base"))
    own = F.filter("_runs", lambda r: (r.lo <= F.col("_rank")) & (F.col("_rank") < r.lo + r.number))[0]
    placed = ranked.join(F.broadcast(table), "_length").withColumn("_run", own)
    return placed.select("_row.*", (F.col("_run.bin") + F.col("_rank") - F.col("_run.lo")).alias("sequence_id"), F.col("_run.at").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of all pieces."""
    found = pieces(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), tokenizer, end_id, limits.tokens, "_text", "_key")
    items = materialise(found.withColumn("_salt", (F.monotonically_increasing_id() % 1024).cast("int")), "pieces")
    return place(items, limits, salt="_salt").withColumnRenamed("_key", key)
