"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius through vantage-point trees.

A fingerprint is a row of 32-bit keys (two for 64 bits).  Each key has a vantage-point tree over its own Hamming distance, and the
trees look for pairs with a key at most 1 bit apart; such pairs are links if all bits together differ in ``bits`` at most.
Two fingerprints of 64 bits within 3 bits differ by at most 1 bit in one of their halves, so that finds each of their links.  On 32
bits balls of radius 1 are far smaller against the spread of distances than with radius 3 on 64, so the triangle bounds prune.

The upper trees come from a sample of distinct fingerprints that grows with the table (``SAMPLED`` for each shard), which only decides how
even the shards are, not which pairs are found: a fingerprint has one home shard, and visits each other shard that the triangle
bounds do not rule out.  A pair parts at some node; the one on the far side visits the near side, so visits from right to left suffice
to begin with, and a visitor follows every branch within its radius.  Shards hold about ``shard_rows`` fingerprints at home, a
hundred bytes each at most; in a shard the same splitting goes on down to small leaves, where distances are taken.  Where a
key parts nothing (many fingerprints share it), a node parts by all bits with radius ``bits``; a shard that is far too large all
the same is dealt into blocks of which every pair is a task.  A shard gives a spanning forest of its links, never all pairs.

Defined results: null text counts as empty; texts without words have fingerprint 0 and are linked like others; equal
fingerprints are one component, also over repeated rows; an empty table gives an empty result; a null key takes part but
is never a component's name unless all its keys are null; texts of any length are read whole, some ten thousand shingles at a time;
other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import columns, discard, gathered, materialise, raws, spread_join
from strata.llm.components import Forest, connected_components

#: Fingerprints in the sample for each shard of the upper trees.
SAMPLED = 8


def shingle_hashes(found: list[bytes], words: int, seed: int):
    """XXH64 values of all shingles of a list of words (of the whole list if it is shorter), some ten thousand at a time."""
    if len(found) <= words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)], np.uint64)
        return
    text = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    n, digest = len(found) - words + 1, xxhash.xxh64_intdigest
    starts, stops = (ends - size)[:n].tolist(), ends[words - 1 :].tolist()
    for a in range(0, n, 1 << 16):
        yield np.array([digest(text[s:e], seed) for s, e in zip(starts[a : a + (1 << 16)], stops[a : a + (1 << 16)])], np.uint64)


def fingerprint(raw: bytes, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the XXH64 values of all shingles, repeats included; 0 without words."""
    found = raw.lower().split()
    n, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(found, words, seed) if found else ():
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp long): the fingerprint's 64 bits as a signed number."""

    def run(batches):
        for batch in batches:
            keys, texts = columns(batch, key, text)
            marks = np.fromiter((fingerprint(r, words, seed) for r in raws(texts)), np.uint64, len(keys))
            yield pa.RecordBatch.from_arrays([keys, pa.array(marks.view(np.int64))], [key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long")


def points_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of 32-bit keys of a column of fingerprints (long or binary)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 2), np.uint32)
    if pa.types.is_integer(column.type):
        return np.ascontiguousarray(column.to_numpy(zero_copy_only=False)).view(np.uint32).reshape(-1, 2)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def column_of(points: np.ndarray, kind: pa.DataType) -> pa.Array:
    points = np.ascontiguousarray(points)
    if pa.types.is_integer(kind):
        return pa.array(points.view(np.int64).ravel())
    at = np.arange(len(points) + 1, dtype=np.int32) * (4 * points.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(points), [None, pa.py_buffer(at), pa.py_buffer(points.tobytes())])


def distance(points: np.ndarray, other: np.ndarray, key: int | None = None) -> np.ndarray:
    """Differing bits of a key, or of all keys."""
    if key is None:
        return np.bitwise_count(points ^ other).sum(axis=-1, dtype=np.int32)
    return np.bitwise_count(points[..., key] ^ other[..., key]).astype(np.int32)


def split(points: np.ndarray, key: int, bits: int) -> tuple[np.ndarray, int, int | None, int] | None:
    """(vantage, limit, key, radius) that part ``points`` most evenly with the fewest points at the boundary; None if none does.
    The key is None where all bits part far better."""
    n, best = len(points), None
    for by, radius in ((key, 1), (None, bits)):
        if best and best[0] <= 0.9 * n:
            break
        for v in points[np.linspace(0, n - 1, min(8, n)).astype(int)]:
            counts = np.bincount(distance(points, v, by), minlength=32 * points.shape[1] + 2)
            inner = np.cumsum(counts)
            reach = np.append(inner[radius:], np.full(radius, n))
            cost = np.where((inner > 0) & (inner < n), np.maximum(inner, n - inner) + reach - inner, 3 * n)
            mu = int(np.argmin(cost))
            if cost[mu] < (best[0] if best else 3 * n):
                best = (int(cost[mu]), v, mu, by, radius)
    return best and best[1:]


@dataclass
class Tree:
    """Nodes as arrays; a leaf has the vantage -1 and its shard's number in ``left``."""

    vantage: np.ndarray
    limit: np.ndarray
    key: np.ndarray  #: -1: all bits
    radius: np.ndarray
    left: np.ndarray
    right: np.ndarray
    shards: int


def build_tree(sample: np.ndarray, key: int, bits: int, leaf: int) -> Tree:
    nodes: list = [None]
    todo, shards = [(0, sample)], 0
    while todo:
        at, points = todo.pop()
        found = split(points, key, bits) if len(points) > leaf else None
        if found is None:
            nodes[at] = (np.zeros(sample.shape[1], np.uint32), -1, -1, 0, shards, 0)
            shards += 1
            continue
        vantage, limit, by, radius = found
        inside = distance(points, vantage, by) <= limit
        nodes[at] = (vantage, limit, -1 if by is None else by, radius, len(nodes), len(nodes) + 1)
        todo += [(len(nodes), points[inside]), (len(nodes) + 1, points[~inside])]
        nodes += [None, None]
    vantage, *rest = zip(*nodes)
    return Tree(np.array(vantage), *(np.array(x, np.int32) for x in rest), shards)


def route(tree: Tree, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, index of the point, whether it is its home) of all visits."""
    shard, index, homes = [], [], []
    todo = [(0, np.arange(len(points)), True)]
    while todo:
        at, some, home = todo.pop()
        if not len(some):
            continue
        mu, left, right = int(tree.limit[at]), int(tree.left[at]), int(tree.right[at])
        if mu < 0:
            shard.append(np.full(len(some), left, np.int32))
            index.append(some)
            homes.append(np.full(len(some), home))
            continue
        by, radius = int(tree.key[at]), int(tree.radius[at])
        d = distance(points[some], tree.vantage[at], None if by < 0 else by)
        if home:
            todo += [(left, some[d <= mu], True), (right, some[d > mu], True), (left, some[(d > mu) & (d <= mu + radius)], False)]
        else:
            todo += [(left, some[d <= mu + radius], False), (right, some[d > mu - radius], False)]
    if not shard:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(shard), np.concatenate(index), np.concatenate(homes)


def shard_links(points: np.ndarray, home: np.ndarray, key: int, bits: int = 3, leaf: int = 384) -> np.ndarray:
    """Root of each point in the graph of all links between a home point and any other point that differ by at most 1 bit in
    ``key`` and ``bits`` bits in all."""
    forest = Forest(len(points))
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        own, visiting = todo.pop()
        if not len(own):
            continue
        found = split(points[own[:: max(1, len(own) // 2048)]], key, bits) if len(own) > leaf else None
        if found is not None:
            vantage, mu, by, radius = found
            d, e = (distance(points[x], vantage, by) for x in (own, visiting))
            near = own[d <= mu]
            if 0 < len(near) < len(own):
                todo += [(near, np.concatenate([own[(d > mu) & (d <= mu + radius)], visiting[e <= mu + radius]])), (own[d > mu], visiting[e > mu - radius])]
                continue
        both = np.concatenate([own, visiting])
        for a in range(0, len(own), leaf):
            mine = own[a : a + leaf]
            for b in range(0, len(both), 4096):
                other = both[b : b + 4096]
                i, j = np.nonzero(np.bitwise_count(points[mine, key][:, None] ^ points[other, key][None, :]) <= 1)
                close = distance(points[mine[i]], points[other[j]]) <= bits
                forest.link(mine[i[close]], other[j[close]])
    return forest.roots(np.arange(len(points)))


def links(distinct: DataFrame, n: int, bits: int = 3, shard_rows: int | None = None) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of ``fp`` in ``distinct`` that have a key at most 1 bit apart and differ
    in ``bits`` bits at most.  ``n``: rows of ``distinct``; ``shard_rows``: between 8,192 and 262,144, for some 64 shards."""
    spark, kind = distinct.sparkSession, distinct.schema["fp"].dataType.simpleString()
    shard_rows = shard_rows or min(max(n // 64, 8_192), 262_144)
    sampled = max(2_048, SAMPLED * n // shard_rows)
    part = F.xxhash64("fp") <= min((sampled << 64) // max(1, n) - (1 << 63), (1 << 63) - 1)
    sample = points_of(distinct.select("fp").filter(part).toArrow()["fp"])  # about 8 for each shard
    sample = sample[np.lexsort(sample.T)] if len(sample) else np.zeros((0, 2), np.uint32)
    leaf = max(SAMPLED, len(sample) * shard_rows // max(1, n))
    trees = [build_tree(sample, key, bits, leaf) for key in range(sample.shape[1])]
    held = spark.sparkContext.broadcast(trees)

    def deal(batches):
        for batch in gathered(batches, 131_072):
            points = points_of(batch.column(0))
            for key, tree in enumerate(held.value):
                shard, some, home = route(tree, points)
                for a in range(0, len(shard), 65_536):
                    b = slice(a, a + 65_536)
                    yield pa.RecordBatch.from_arrays([pa.array(shard[b] * len(trees) + np.int32(key)), column_of(points[some[b]], batch.column(0).type), pa.array(home[b])], ["shard", "fp", "home"])

    dealt = materialise(distinct.select("fp").mapInArrow(deal, f"shard int, fp {kind}, home boolean"), "shards")
    sizes = dealt.groupBy("shard").count().filter(F.col("count") > 16 * shard_rows).collect()  # at most a row for each shard
    whole = dealt.withColumns({"i": F.lit(0), "j": F.lit(0)})
    if sizes:
        blocks = spark.createDataFrame([(r.shard, -(-r["count"] // (8 * shard_rows))) for r in sizes], "shard int, parts int")
        large = (dealt.join(F.broadcast(blocks), "shard").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                 .select("shard", "fp", "home", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
        whole = whole.join(F.broadcast(blocks), "shard", "left_anti").unionByName(large)

    def find(group: tuple, table: pa.Table) -> pa.Table:
        points = points_of(table["fp"])
        roots = shard_links(points, table["home"].to_numpy(), group[0].as_py() % len(trees), bits)
        moved = np.flatnonzero(roots != np.arange(len(points)))
        return pa.table([column_of(points[moved], table["fp"].type), column_of(points[roots[moved]], table["fp"].type)], ["a", "b"])

    return whole.groupBy("shard", "i", "j").applyInArrow(find, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, bits: int = 3, words: int = 3, seed: int = 42, text: str = "text", key: str = "doc_id", hot_share: int = 10_000) -> DataFrame:
    """(key, fingerprint, component_id): fingerprint as 16 hexadecimal digits, the least key that links lead to.

    A fingerprint that at least one of ``hot_share`` rows has is hot; there are ``hot_share`` of them at most, which are broadcast.
    """
    if bits > 3:
        raise ValueError("two halves with radius 1 cover up to 3 bits")
    marked = materialise(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), words, seed, "text", "key"), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("key").alias("rep"), F.count("*").alias("rows")), "distinct")
    found = connected_components(links(distinct, distinct.count(), bits))
    near = found.withColumnRenamed("node", "fp")
    least = near.join(distinct, "fp").groupBy("root").agg(F.min("rep").alias("least"))
    linked = near.join(least, "root").select("fp", "least")
    named = materialise(distinct.join(linked, "fp", "left").filter("rows > 1 or least is not null")
             .select("fp", "rows", F.coalesce("least", "rep").alias("component_id")), "named")
    discard(distinct, found)
    joined = spread_join(marked, named.withColumn("shared", F.lit(True)), "fp", "rows", marked.count(), "left", hot_share)
    component = F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("key"))
    return joined.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
