"""Near copies: texts whose word shingles have a Jaccard similarity of ``least`` or more, decided on the whole shingle sets.

Candidates share a bucket.  A text's buckets are its SimHash group (fingerprints of its shingles at most 3 of 64 bits apart, through
vantage-point trees) and ``bands`` hashes of ``rows`` minwise values each over its shingle set; texts of similarity s share one of the
latter with probability 1 - (1 - s^rows)^bands: 0.997 at 0.8, 0.17 at 0.5 and 0.005 at 0.3, whatever kind of edit parts them.  Buckets that
share texts are one cluster.  Inside a cluster similarity is counted exactly, on 64-bit hashes of all shingles; no estimate decides, equal
fingerprints neither.  Only texts of clusters with two texts or more have their shingles carried.  A cluster above ``block`` texts, or
above ``block_bytes`` of text, is dealt into blocks.  First each block is linked within itself and with a few anchors, which are in every block;
where that leaves texts outside the cluster's largest component, they are compared with the whole cluster, block by block.  Pairs that are
linked already are not counted, so a large group of near copies costs no more than its blocks.

Defined results: a null text counts as empty; texts with the same lower-cased (A-Z) words in the same order are one text; an empty
table gives no rows; null keys are the name of a text only if it has no other; other columns are not read.  A task holds the shingle sets of
one or two blocks, 8 bytes a word: some ``block_bytes`` and twice the longest text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import blocks, columns, discard, leaving_none, materialise, raws, spread_join, text_buffer
from strata.llm.components import connected_components
from strata.llm.simhash import links, shingle_hashes

ANCHORS = 8
#: Up to so many texts in clusters (8 bytes each) are broadcast, so that other texts' shingles are not carried; above, all are.
SOUGHT = 2_000_000


def text_mark(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(raw.lower().split()))


def shingle_set(raw: bytes, words: int, seed: int) -> np.ndarray:
    found = raw.lower().split()
    return np.unique(np.concatenate(list(shingle_hashes(found, words, seed)))) if found else np.zeros(0, np.uint64)


def set_fingerprint(hashes: np.ndarray) -> int:
    """64-bit SimHash of a set of hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` bijections of 32-bit numbers, as what is added and the odd number that multiplies then."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, (n, 1), np.uint32), rng.integers(0, 1 << 31, (n, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def band_hashes(hashes: np.ndarray, shuffles: tuple[np.ndarray, np.ndarray], rows: int) -> np.ndarray:
    """Minwise values of a set of hashes, joined by ``rows`` to one 64-bit hash a band; the band's number is part of it."""
    least = np.full(len(shuffles[0]), 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(short), 1 << 12):
        np.minimum(least, ((short[None, a : a + (1 << 12)] ^ shuffles[0]) * shuffles[1]).min(axis=1), out=least)
    return np.array([xxhash.xxh3_64_intdigest(some.tobytes(), k) for k, some in enumerate(least.reshape(-1, rows))], np.uint64).view(np.int64)


def set_links(sets: list[np.ndarray], home: np.ndarray, label: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs that link a home set with any other to at least ``least``, but for those that ``label`` or other pairs link already."""
    n, size = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    column = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)[1]
    ends = np.cumsum(size)
    order = np.argsort(column, kind="stable")
    holder = np.repeat(np.arange(n), size)[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(column))])
    root, out = label.copy(), []
    for x in np.flatnonzero(home).tolist():
        apart = root != root[x]
        if not apart.any():
            continue
        own = column[ends[x] - size[x] : ends[x]]
        common = np.bincount(np.concatenate([holder[first[c] : first[c + 1]] for c in own.tolist()] or [[]]).astype(np.int64), minlength=n)
        for y in np.flatnonzero(apart & (common / np.maximum(size[x] + size - common, 1) >= least)).tolist():
            if root[y] != root[x]:
                root[root == root[y]] = root[x]
                out.append((x, y))
    return out


def candidates(docs: DataFrame, bands: int, rows: int, shingle_words: int, seed: int, text: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((mark, key, size) of each distinct text, (mark, bucket) rows, (mark, lo) pairs of texts whose fingerprints are linked)."""
    kind = docs.schema[key].dataType.simpleString()

    def mark(batches):
        shuffles = permutations(bands * rows, seed)
        for batch in batches:
            names, texts = columns(batch, key, text)
            for a, b in blocks(text_buffer(texts)[1], 2 << 20):
                found = raws(texts.slice(a, b - a))
                sets = [shingle_set(r, shingle_words, seed) for r in found]
                keys = [band_hashes(s, shuffles, rows) if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays([names.slice(a, b - a), pa.array(list(map(text_mark, found)), pa.binary()), pa.array([set_fingerprint(s) if len(s) else 0 for s in sets], pa.int64()),
                                                  pa.array(list(map(len, found)), pa.int64()), pa.array(keys, pa.list_(pa.int64()))], [key, "mark", "fp", "size", "bands"])

    marked = docs.select(key, text).mapInArrow(leaving_none(mark), f"`{key}` {kind}, mark binary, fp long, size long, bands array<long>")
    held = materialise(marked.groupBy("mark").agg(F.min(key).alias(key), F.min("fp").alias("fp"), F.max("size").alias("size"), F.min("bands").alias("bands")), "texts")
    distinct = materialise(held.select("fp").distinct(), "distinct")
    reps = held.groupBy("fp").agg(F.min("mark").alias("rep"))
    named = lambda side: reps.select(F.col("fp").alias(side), F.col("rep").alias(f"{side}_rep"))
    pairs = links(distinct, distinct.count(), 3).join(named("a"), "a").join(named("b"), "b").select(F.col("a_rep").alias("mark"), F.col("b_rep").alias("lo"))
    grouped = held.select("mark", F.xxhash64(F.lit("fingerprint"), "fp").alias("bucket"))
    banded = held.select("mark", F.explode("bands").alias("bucket"))
    buckets = materialise(grouped.unionByName(banded), "buckets")
    discard(distinct)
    return held, buckets, pairs


def components(docs: DataFrame, least: float, bands: int = 24, rows: int = 7, shingle_words: int = 5, seed: int = 42, block: int = 256, block_bytes: int = 64 << 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(mark binary, key, root binary): a row for each distinct text with its least key; ``root`` is shared by a component of links."""
    nodes, buckets, pairs = candidates(docs, bands, rows, shingle_words, seed, text, key)
    shared = materialise(buckets.groupBy("bucket").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("bucket", "lo", "n"), "shared")
    stars = spread_join(buckets, shared, "bucket", "n", buckets.count()).select("mark", "lo")
    near = connected_components(stars.unionByName(pairs), "mark", "lo")
    clustered = materialise(nodes.select("mark", "size").join(near.withColumnRenamed("node", "mark"), "mark").select("mark", "size", F.col("root").alias("cluster")), "clustered")
    parts = F.ceil(F.greatest(F.count("*") / block, F.sum("size") / block_bytes)).cast("int")
    sizes = materialise(clustered.groupBy("cluster").agg(F.count("*").alias("n"), parts.alias("parts")), "sizes")
    total = clustered.count()
    members = materialise(spread_join(clustered.drop("size"), sizes, "cluster", "n", total).select("mark", "cluster", "parts"), "members")
    discard(buckets, shared, near, clustered, sizes)
    held = materialise(members.join(_shingle_sets(docs, members, shingle_words, seed, text), "mark"), "sets")

    def decide(payloads: list[bytes], home: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
        return set_links([np.frombuffer(x, np.uint64) for x in payloads], home, label, least)

    found = cluster_components(held, decide, total, block)
    out = materialise(nodes.join(found.withColumnRenamed("node", "mark"), "mark", "left").select("mark", key, F.coalesce("root", "mark").alias("root")), "near")
    discard(nodes, members, held, found)
    return out


def cluster_components(held: DataFrame, decide, total: int, block: int) -> DataFrame:
    """(node, root) of the components of all links between items of one cluster, as ``connected_components`` gives them.

    ``held``: (mark binary, cluster, parts, set binary), a written table, where ``parts`` is the number of blocks of the cluster's items.  An item
    may be in several clusters.  ``decide(sets, home, label)`` gives links between a home item and any other of those that have different
    labels.  ``total``: rows of ``held`` or more.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        marks = frame["mark"].tolist()
        label = np.unique(np.array([bytes(x).hex() for x in frame["label"]]), return_inverse=True)[1]
        found = decide(frame["set"].tolist(), frame["home"].to_numpy(bool), label)
        return pd.DataFrame({"a": [marks[x] for x, _ in found], "b": [marks[y] for _, y in found]})

    def linked(rows: DataFrame) -> DataFrame:
        return materialise(rows.select("cluster", "i", "j", "mark", "set", "home", "label").groupBy("cluster", "i", "j").applyInPandas(run, "a binary, b binary"), "links")

    place = lambda parts: F.pmod(F.xxhash64("mark"), parts).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    own = held.withColumns({"i": place(F.col("parts")), "home": F.lit(True), "label": F.col("mark"), "j": F.lit(0)})
    large = held.filter("parts > 1").select("mark", "cluster", "parts")
    if large.isEmpty():  # every cluster is one block, and its links are all known after that
        edges = linked(own)
        near = connected_components(edges)
        discard(edges)
        return near
    some = large.groupBy("cluster").agg(F.array_distinct(F.array(*(F.min_by("mark", F.xxhash64("mark", F.lit(s))) for s in range(ANCHORS)))).alias("marks"))
    anchors = held.join(some.select("cluster", F.explode("marks").alias("mark")), ["mark", "cluster"])
    edges = linked(own.unionByName(anchors.withColumns({"i": each("parts"), "home": F.lit(True), "label": F.col("mark"), "j": F.lit(0)})))

    near = connected_components(edges)
    labelled = materialise(large.join(near.withColumnRenamed("node", "mark"), "mark", "left").select("mark", "cluster", F.coalesce("root", "mark").alias("label")), "labels")
    most = labelled.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.sum("n").alias("n"))
    outside = materialise(spread_join(labelled, most, "cluster", "n", total).filter("label != most").select("mark", "cluster"), "outside")
    if not outside.isEmpty():
        count = outside.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("rest"))
        whole = held.join(labelled, ["mark", "cluster"]).join(count, "cluster")
        lone = whole.join(outside, ["mark", "cluster"], "left_semi").withColumns({"i": place(F.col("rest")), "j": each("parts"), "home": F.lit(True)})
        more = linked(lone.unionByName(whole.withColumns({"i": each("rest"), "j": place(F.col("parts")), "home": F.lit(False)})))
        first, near = near, connected_components(more.unionByName(near.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        discard(first, more)
    discard(edges, labelled, outside)
    return near


def _shingle_sets(docs: DataFrame, members: DataFrame, words: int, seed: int, text: str) -> DataFrame:
    """(mark, set): sorted 64-bit hashes of the shingles of each text in ``members`` (and of others, for the join to drop)."""
    few = members.count() <= SOUGHT
    head = lambda marks: np.frombuffer(b"".join(marks), np.int64)[::2]
    sought = docs.sparkSession.sparkContext.broadcast(np.sort(head(members.select("mark").toArrow()["mark"].to_pylist())) if few else None)

    def run(batches):
        given: set[bytes] = set()
        for batch in batches:
            texts = batch.column(0)
            for a, b in blocks(text_buffer(texts)[1], 2 << 20):
                found = raws(texts.slice(a, b - a))
                marks = list(map(text_mark, found))
                wanted = np.isin(head(marks), sought.value) if few else np.ones(len(marks), bool)
                part = []
                for k in np.flatnonzero(wanted).tolist():
                    if marks[k] not in given:  # copies in a task need one set
                        given.add(marks[k])
                        part.append(k)
                yield pa.RecordBatch.from_arrays([pa.array([marks[k] for k in part], pa.binary()), pa.array([shingle_set(found[k], words, seed).tobytes() for k in part], pa.binary())], ["mark", "set"])
                if len(given) > 100_000:
                    given.clear()

    return docs.select(text).mapInArrow(leaving_none(run), "mark binary, set binary").groupBy("mark").agg(F.min("set").alias("set"))
