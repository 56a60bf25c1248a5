"""Connected components of a graph given as an edge table, by alternating large and small stars.

Each round turns every node's links towards the least node in reach; only edges move, in joins and aggregations that combine
before the shuffle.  A hub's links are dealt into ``SALTS`` parts, each of which gets the hub's least neighbour (``with_least``), so they don't
meet in one task, and nothing is broadcast.  Rounds end when the edges no longer change; they are then stars around each
component's least node.

Before the rounds each task joins its own edges, ``LOT`` at a time (``stars``), once where they are and once more after the shuffle.  What is
left is shallow, so few rounds follow; every round is a dozen jobs, whose plans and stages stay in the driver's memory.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import discard, gathered, leaving_none, materialise

SALTS = 1024
#: Edges that a task joins at once, some 200 bytes each.
LOT = 1 << 18


class Forest:
    """Union-find over 0..n-1, for many links at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent[x]
        while not np.array_equal(p, q := self.parent[p]):
            p = q
        return p

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
            np.minimum.at(self.parent, a, b)


def stars(links: DataFrame, lot: int = LOT) -> DataFrame:
    """links: (u, v).  Edges (u, v), u > v, with the same components: of each ``lot`` of a partition's links, stars around the least node in reach.

    Nodes are compared as Spark does (bytes unsigned, numbers signed); links of other types stay as they are.
    """
    kind = links.schema["u"].dataType.simpleString()
    if not re.fullmatch("binary|string|bigint|int|smallint|tinyint", kind):
        return links

    def run(batches):
        for batch in gathered(batches, lot):
            coded = pa.concat_arrays([batch.column(0), batch.column(1)]).dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            u, v = rank[coded.indices.to_numpy()].reshape(2, -1)
            forest = Forest(len(order))
            forest.link(u, v)
            root = forest.roots(np.arange(len(order)))
            moved = np.flatnonzero(root != np.arange(len(order)))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(order[x])) for x in (moved, root[moved])], ["u", "v"])

    return links.select("u", "v").mapInArrow(leaving_none(run), f"u {kind}, v {kind}")


def with_least(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``lo``, the least value of their key.  However many rows a key has, a task gets about a ``SALTS``-th of them as one lot."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "_salt").agg(F.min(value).alias("lo"))
    each = parts.select(key, "_salt").join(parts.groupBy(key).agg(F.min("lo").alias("lo")), key)
    return salted.join(each, [key, "_salt"]).drop("_salt")


def _towards_least(links: DataFrame) -> DataFrame:
    """links: (u, v).  With m the least of u and its v: all (v, m) and (u, m), without loops."""
    moved = with_least(links, "u", "v").select(F.col("v"), F.least("u", "lo").alias("m"), "u")
    both = moved.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return both.select("e.u", "e.v").filter("u != v").distinct()


def _round(edges: DataFrame) -> DataFrame:
    """edges: (u, v) with u > v, distinct."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = with_least(both, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.least("u", "lo").alias("v")).distinct()
    return _towards_least(large)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link to another one; ``root`` is the component's least node.  ``discard`` removes its table.

    Loops and repeated edges change nothing; an edge with a null end links nothing; no edges give no rows.
    """
    given = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y")).filter("x and y and u != v")
    now = materialise(stars(stars(given.select("u", "v")).distinct()), "edges")
    state = None
    while True:
        held = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if held == state or not held[0]:
            break
        last, state, now = now, held, materialise(_round(now), "stars")
        discard(last)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    out._written = now._written
    return out
