"""Alignment of the tokens of two tokenizers, as relations.

``align_units`` is the alignment: tokens are unfolded with their positions, a windowed running sum of byte lengths gives each token's end,
an equi-join of both sides on text and end (a full outer one) gives a row for each end.  Rows where both sides end are cuts, whose running count
numbers the groups.  Such a row is also a link: between two neighbouring ends lie exactly one token of either side, so overlapping pairs
and rows correspond one to one, and no pair is looked for that doesn't overlap.

Texts are cut into units where both tokenizers provably have a token end (``Cutter``); each distinct unit is encoded and aligned once, however often it
occurs, and a link counts as often as its unit.  That is what makes whole corpora of tokens affordable: every table of tokens is as large as the
corpus's vocabulary of units.  Back to documents: the most frequent units' figures (``HEAD`` of them at most, ``SHORT`` bytes each) go to all
tasks; those of other units are joined by unit and gathered for each document.

Defined results: texts that are null or empty, or that either side's tokens don't give back byte for byte (U+2581 is a blank for pieces), have no
tokens, zeros and an empty ``groups_sha256``, and count nowhere; repeated rows, or null keys, each give a row; texts of any length are read whole; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.byte_bpe import ByteDecoder
from strata.llm.common import blocks, columns, discard, materialise, spread_join, text_buffer
from strata.llm.segments import _LETTER, _SPACE, SegmentEncoder, _lut, cuts_are_proven

HEAD, SHORT = 220_000, 48
#: Units that a task interns before it starts anew.
HELD = 150_000
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_GRAPH = _lut(range(0x21, 0x7F))


class Cutter(SegmentEncoder):
    """Interns units: each has a number from 0, its place in ``units``, until ``restart``."""

    def __init__(self, blanks: bytes, marks: bytes, cut: bool):
        self.units: list[str] = []
        self.blanks, self.marks = _lut(blanks), _lut(marks)
        super().__init__(self._intern, cut=cut)

    def _intern(self, texts: list[str]) -> list[list[int]]:
        first = len(self.units)
        self.units += texts
        return [[first + k] for k in range(len(texts))]

    def restart(self) -> None:
        self.units = []
        self._clear()

    def _whole(self, text: str) -> list[int]:
        return self._intern([text])[0]

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.cut:
            return super()._cuts(data, offsets)
        cut, letter = np.zeros(len(data), bool), _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # Latin-1 letters
        cut[1:] = (~_SPACE[data][:-1] & self.blanks[data[1:]]) | (letter[:-1] & self.marks[data[1:]])
        for k in self._whole_documents(data, offsets):  # there, only before blanks that follow what is certainly visible
            a, b = offsets[k], offsets[k + 1]
            cut[a:b] = False
            cut[a + 1 : b] = _GRAPH[data[a : b - 1]] & (data[a + 1 : b] == 0x20) & self.blanks[0x20]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(cut)


class TokenizerPair:
    """A: a byte-level ``tokenizers`` file, on a blank and the text; B: a ``sentencepiece`` model, which adds that blank itself."""

    def __init__(self, a: str, b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        self.decoder = ByteDecoder.of_tokenizer(self.a)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        inner = {(x, y) for i, p in enumerate(pieces) if not self.b.is_byte(i) for x, y in zip(p.replace("▁", " "), p.replace("▁", " ")[1:])}
        blanks = [c for c in " \t\n\r\x0b\x0c" if not any(y == c and not x.isspace() for x, y in inner)]
        marks = [c for c in string.punctuation if c != "'" and not any(y == c and x.isalpha() for x, y in inner)]
        #: The model keeps text as it is: such probes come back, and bytes stand for what has no piece.
        kept = sum(map(self.b.is_byte, range(len(pieces)))) == 256 and all(self._fits(x) for x in (" ", "  a  b ", "ﬁÅÅ", "é", "Ａ　b", "A\r\n\tb\x00\x1f​", " ﻿"))
        self.proven = kept and "\n" not in {y for _, y in inner} | {x for x, _ in inner} and cuts_are_proven(self.a) and self.a.normalizer is None
        self.cutter = Cutter("".join(blanks).encode(), "".join(marks).encode(), self.proven)

    def tokens(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides.  A unit that doesn't begin with a blank, or is but one, follows a line feed, whose two pieces are dropped again."""
        found = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        led = [u.startswith(" ") and len(u) > 1 for u in units]
        other = self.b.encode([u[1:] if x else "\n" + u for u, x in zip(units, led)], num_threads=1)
        return found, [ids if x else ids[2:] for ids, x in zip(other, led)]

    def _fits(self, unit: str) -> bool:
        a, b = self.tokens([unit if unit.startswith(" ") else " " + unit])
        raw = unit.encode() if unit.startswith(" ") else b" " + unit.encode()
        return self.decoder.decode(np.array(a[0], np.int64))[0].tobytes() == raw == b"".join(self.bytes_b[i] for i in b[0])

    def fits(self, unit: str) -> bool:
        """Whether both sides give the unit's bytes back."""
        return "▁" not in unit if self.proven else self._fits(unit)

    def sizes(self, spark) -> tuple[DataFrame, DataFrame]:
        """(id, size) of both vocabularies: bytes of each token."""
        schema = "id int, size int"
        return tuple(spark.createDataFrame(list(enumerate(map(int, x))), schema) for x in (self.decoder.length, map(len, self.bytes_b)))


@functools.cache
def _pair(a: str, b: str) -> TokenizerPair:
    return TokenizerPair(a, b)


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A blank before each text that is not empty."""
    full = np.diff(offsets) > 0
    return np.insert(data, offsets[:-1][full], 0x20), offsets + np.append(0, np.cumsum(full))


class _Reader:
    """Units of texts by number, and whether the texts fit."""

    def __init__(self, pair: TokenizerPair):
        self.pair, self.cutter = pair, pair.cutter
        self.restart()

    def restart(self) -> None:
        self.cutter.restart()
        self.odd = np.zeros(0, bool)

    def release(self) -> None:
        """Workers are used again: what a task interned is not kept."""
        self.restart()
        pa.default_memory_pool().release_unused()

    def read(self, texts: pa.Array):
        """(first row, last row, unit numbers, places of rows among them, rows that don't fit) of each block."""
        data, offsets = text_buffer(texts)
        for a, b in blocks(offsets, 2 << 20):
            part, at = spaced(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            units, places = self.cutter.encode(part, at)
            self.odd = np.append(self.odd, [not self.pair.fits(u) for u in self.cutter.units[len(self.odd) :]])
            bad = np.zeros(b - a, bool)
            bad[np.searchsorted(places, np.flatnonzero(self.odd[units]), side="right") - 1] = True
            yield a, b, units, places, bad


def count_units(docs: DataFrame, a: str, b: str, text: str) -> DataFrame:
    """(unit, n): how often each unit occurs in texts that fit."""

    def run(batches):
        reader, counts = _Reader(_pair(a, b)), np.zeros(0, np.int64)

        def flush():
            some = np.flatnonzero(counts)
            for k in range(0, len(some), 10_000):
                at = some[k : k + 10_000].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([reader.cutter.units[x] for x in at], pa.string()), pa.array(counts[at])], ["unit", "n"])

        for batch in batches:
            for _, _, units, places, bad in reader.read(batch.column(0)):
                good = units[~np.repeat(bad, np.diff(places))] if bad.any() else units
                now = np.bincount(good, minlength=len(reader.cutter.units))
                now[: len(counts)] += counts
                counts = now
                if len(counts) > HELD:
                    yield from flush()
                    reader.restart()
                    counts = np.zeros(0, np.int64)
        yield from flush()
        reader.release()

    return docs.select(text).mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def encode_units(units: DataFrame, a: str, b: str) -> DataFrame:
    """(unit, n, a array<int>, b array<int>)."""

    def run(batches):
        pair = _pair(a, b)
        for batch in batches:
            names, n = columns(batch, "unit", "n")
            found = pair.tokens(names.to_pylist())
            yield pa.RecordBatch.from_arrays([names, n, *(pa.array(x, pa.list_(pa.int32())) for x in found)], ["unit", "n", "a", "b"])

    return units.mapInArrow(run, "unit string, n long, a array<int>, b array<int>")


def align_units(units: DataFrame, sizes_a: DataFrame, sizes_b: DataFrame) -> DataFrame:
    """units: (uid, a, b) with lists of token ids that give the same bytes.  A row for each link: (uid, end, a_id, b_id) of the tokens that overlap,
    ``a_ends`` and ``b_ends`` (whether they end there; a cut where both do), ``group_id``, counted from the unit's last group."""

    def tokens(side: str, sizes: DataFrame) -> DataFrame:
        rows = units.select("uid", F.posexplode(side).alias("pos", "id")).join(F.broadcast(sizes), "id")  # a row for each id of the vocabulary
        so_far = Window.partitionBy("uid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.select("uid", F.sum("size").over(so_far).cast("int").alias("end"), F.col("id").alias(f"{side}_id"))

    ends = tokens("a", sizes_a).join(tokens("b", sizes_b), ["uid", "end"], "full_outer")
    back = Window.partitionBy("uid").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a running frame, from the last end on
    a_ends, b_ends = F.col("a_id").isNotNull(), F.col("b_id").isNotNull()
    return ends.select("uid", "end", F.last("a_id", ignorenulls=True).over(back).alias("a_id"), F.last("b_id", ignorenulls=True).over(back).alias("b_id"),
                       a_ends.alias("a_ends"), b_ends.alias("b_ends"), F.count(F.when(a_ends & b_ends, 1)).over(back).cast("int").alias("group_id"))


def unit_groups(links: DataFrame) -> DataFrame:
    """(uid, n_groups, n_links, groups): ``groups`` is the text ``a1,a2|b1;a3|b2`` of a unit's groups in order."""
    ids = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(f"{side}_ends"), F.struct("end", F.col(f"{side}_id").alias("id"))))), lambda x: x["id"].cast("string")), ",")
    each = links.groupBy("uid", "group_id").agg(F.concat(ids("a"), F.lit("|"), ids("b")).alias("ids"), F.count("*").alias("links"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("group_id")).alias("at"), "ids")))
    return each.groupBy("uid").agg(F.count("*").alias("n_groups"), F.sum("links").alias("n_links"), F.array_join(F.transform(listed, lambda x: x["ids"]), ";").alias("groups"))


def unit_table(docs: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """(unit, n, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each distinct unit of all texts; ``discard`` removes it."""
    spark = docs.sparkSession
    units = materialise(encode_units(count_units(docs, a, b, text), a, b).withColumn("uid", F.monotonically_increasing_id()), "units")
    links = materialise(align_units(units.select("uid", "a", "b"), *_pair(a, b).sizes(spark)), "links")
    pair = (F.shiftleft(F.col("a_id").cast("long"), 32) + F.col("b_id")).alias("pair")
    weighed = links.select("uid", pair).join(units.select("uid", "n"), "uid").groupBy("pair").agg(F.sum("n").alias("count"), F.count("*").alias("rows"))
    counted = materialise(weighed, "pairs")
    best = counted.groupBy((F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))).alias("b_id")).agg(F.max("count").alias("most"))
    judged = counted.withColumn("b_id", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))).join(best, "b_id").select("pair", "rows", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    table = materialise(judged, "judged")
    scored = spread_join(links.select("uid", pair), table, "pair", "rows", links.count()).groupBy("uid").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    made = units.select("uid", "unit", "n", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b")).join(unit_groups(links), "uid").join(scored, "uid")
    out = materialise(made.select("unit", "n", *SUMS, "groups"), "aligned")
    discard(units, links, counted, table)
    return out


def head_of(table: DataFrame, most: int) -> tuple[int, pa.Table]:
    """A limit, and the units that occur more often and have ``SHORT`` bytes at most: ``most`` of them at most."""
    powers = range(48)
    found = table.agg(*(F.count(F.when(F.col("n") >= 1 << k, 1)).alias(f"k{k}") for k in powers)).first()
    limit = next((1 << k for k in powers if found[k] <= most), 1 << 48)
    return limit, table.filter((F.col("n") >= limit) & (F.octet_length("unit") <= SHORT)).toArrow()


def align(docs: DataFrame, a: str, b: str, text: str = "text", key: str = "doc_id", most: int = HEAD) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document."""
    spark = docs.sparkSession
    table = unit_table(docs, a, b, text)
    head = spark.sparkContext.broadcast(head_of(table, most)[1])

    def encode(batches):
        reader, codes = _Reader(_pair(a, b)), np.zeros(0, np.int32)
        known = {u: k for k, u in enumerate(head.value["unit"].to_pylist())}
        codec = pa.Codec("zstd")
        for batch in batches:
            keys, texts = columns(batch, key, text)
            for first, last, units, places, bad in reader.read(texts):
                codes = np.append(codes, np.array([known.get(u, -1) for u in reader.cutter.units[len(codes) :]], np.int32))
                found, sizes, packed, rest = codes[units], [], [], []
                for k in range(last - first):
                    mine = found[places[k] : places[k + 1]] if not bad[k] else found[:0]
                    tail, others = mine < 0, []
                    if tail.any():
                        names, which = np.unique(units[places[k] : places[k + 1]][tail], return_inverse=True)
                        mine[tail] = -1 - which
                        others = [reader.cutter.units[x] for x in names.tolist()]
                    sizes.append(len(mine))
                    packed.append(codec.compress(mine.astype("<i4").tobytes(), asbytes=True) if len(mine) else b"")
                    rest.append(others)
                yield pa.RecordBatch.from_arrays([keys.slice(first, last - first), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary()), pa.array(rest, pa.list_(pa.string()))], ["key", "size", "units", "rest"])
            if len(codes) > HELD:
                reader.restart()
                codes = np.zeros(0, np.int32)
        reader.release()

    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(key).alias(key), F.col(text).alias(text)).mapInArrow(encode, f"key {kind}, size int, units binary, rest array<string>")
    held = materialise(named.withColumn("row", F.monotonically_increasing_id()), "coded")
    figures = F.struct("pos", *SUMS, "groups")
    others = held.select("row", F.posexplode("rest").alias("pos", "unit")).join(table.drop("n"), "unit").groupBy("row").agg(F.array_sort(F.collect_list(figures)).alias("others"))

    def finish(batches):
        _pair.cache_clear()  # not needed any more in this worker
        known = head.value
        sums, groups = np.array([known[c].to_numpy() for c in SUMS], np.int64).reshape(len(SUMS), -1), known["groups"].to_pylist()
        codec = pa.Codec("zstd")
        for batch in batches:
            keys, sizes, packed, rest = columns(batch, "key", "size", "units", "others")
            out, digests = np.zeros((len(SUMS), len(keys)), np.int64), []
            for k, (size, raw, more) in enumerate(zip(sizes.to_pylist(), packed, rest)):
                if not size:
                    digests.append("")
                    continue
                mine = np.frombuffer(codec.decompress(raw.as_buffer(), 4 * size), "<i4")
                out[:, k] = sums[:, mine[mine >= 0]].sum(axis=1)
                if more.is_valid:
                    more = more.as_py()
                    out[:, k] += np.array([[x[c] for c in SUMS] for x in more], np.int64)[-1 - mine[mine < 0]].sum(axis=0)
                    texts = [groups[x] if x >= 0 else more[-1 - x]["groups"] for x in mine.tolist()]
                else:
                    texts = [groups[x] for x in mine.tolist()]
                digests.append(hashlib.sha256(";".join(texts).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(x) for x in out), pa.array(digests, pa.string())], [key, *SUMS, "groups_sha256"])

    schema = f"`{key}` {kind}, {', '.join(f'{c} long' for c in SUMS)}, groups_sha256 string"
    return held.select("row", "key", "size", "units").join(others, "row", "left").select("key", "size", "units", "others").mapInArrow(finish, schema)
