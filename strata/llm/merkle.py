"""Merkle manifest of a table of documents, by postorder recursive traversal of aligned blocks.

A row's leaf is a digest over its columns.  The leaves of a group (``lang``), in ascending order of their key, are joined by runs of
``FAN`` until one node is left, the group's root; the roots of all groups, in the groups' order, make the table's root the same way.

Leaves get their place in the whole order from one range partitioning and prefix sums over its partitions.  Aligned blocks of
``FAN ** height`` nodes are then dealt evenly to tasks.  A block is traversed recursively in postorder: ``traverse`` returns the
digest of a subtree and, while unwinding, appends the siblings of each child to the leaves that the child contains.  Blocks' digests
are the nodes of the next, equally distributed traversal, up to single roots.  On the way back each block gets the siblings above it and
goes on to its own leaves, so no list of siblings is kept but in the task that digests it; a leaf is read twice, as a hundred bytes.

Defined results: a null value counts as ``-``, in an order nulls come first; rows with the same group and key follow by
leaf, and rows alike in all columns are leaves side by side; a row without key is not tampered with; a null text stays one when
tampered with; texts of any length are digested whole; an empty table gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import discard, materialise, spread_join

FAN = 8
#: Levels that one block covers: 512 nodes.
HEIGHT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def join_digests(nodes: list[bytes]) -> bytes:
    """Digest of the hexadecimal texts of raw digests, one after the other."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def levels(n: int) -> int:
    """Rounds of joining runs until one of ``n`` nodes is left."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def traverse(nodes: list[bytes], low: int, high: int, height: int, paths: list[list[tuple[list[bytes], list[bytes]]]] | None = None) -> bytes:
    """The digest of ``nodes[low:high]`` as a subtree of ``height`` levels.  ``paths``: for each node, gets (siblings to its left, to its
    right) of each level, from below."""
    if not height:
        return nodes[low]
    step = FAN ** (height - 1)
    children = [traverse(nodes, a, min(a + step, high), height - 1, paths) for a in range(low, high, step)]
    if paths is not None:
        for k, a in enumerate(range(low, high, step)):
            level = (children[:k], children[k + 1 :])
            for leaf in range(a, min(a + step, high)):
                paths[leaf].append(level)
    return join_digests(children)


def pack_path(path: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    """Levels one after the other: the numbers of siblings to the left and to the right, then the siblings."""
    return b"".join(bytes([len(left), len(right)]) + b"".join([*left, *right]) for left, right in path)


def unpack_path(raw: bytes) -> list[tuple[list[bytes], list[bytes]]]:
    out, at = [], 0
    while at < len(raw):
        left, right = raw[at], raw[at + 1]
        found = [raw[k : k + 32] for k in range(at + 2, at + 2 + 32 * (left + right), 32)]
        out.append((found[:left], found[left:]))
        at += 2 + 32 * (left + right)
    return out


def fold(leaf: bytes, path: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = join_digests([*left, leaf, *right])
    return leaf


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256, in hexadecimal, over the values: ``-`` for null, else number of UTF-8 bytes, colon, value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters untouched."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def placed(rows: DataFrame, *order: Column, name: str) -> tuple[DataFrame, int]:
    """``rows`` with ``at``, their place from 0 in the given order, and their number.  Hot keys are split if the order's last columns
    differ.  The number of partitions bounds what the driver sees."""
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = rows.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    held = materialise(ranged.withColumn("_id", F.monotonically_increasing_id()), name)
    counts = {r.part: r.n for r in held.groupBy(F.shiftright("_id", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    ends = np.cumsum([counts.get(p, 0) for p in range(max(counts, default=-1) + 1)] or [0])
    bases = F.array(*(F.lit(int(x)) for x in [0, *ends[:-1]])).cast("array<bigint>")
    out = held.withColumn("at", F.get(bases, F.shiftright("_id", 33).cast("int")) + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")
    out._written = held._written
    return out, int(ends[-1])


def _blocks(batches):
    """Runs of rows with the same ``block``, which come one after the other, as lists of columns."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        block = held["block"].to_numpy()
        ends = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *ends.tolist()], ends.tolist()):
            yield held.slice(a, b - a)
        held = held.slice(ends[-1]) if len(ends) else held
    if held is not None and held.num_rows:
        yield held


def _dealt(rows: DataFrame, total: int) -> DataFrame:
    """Rows by block, in order; blocks in even ranges.  ``total``: above all values of ``block``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = (F.col("block").cast("decimal(38,0)") * parts / F.lit(max(1, total)).cast("decimal(20,0)")).cast("int")
    return rows.repartitionById(parts, F.least(number, F.lit(parts - 1))).sortWithinPartitions("block", "rank")


def _with_block(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.col("first") + F.floor(F.col("rank") / size).cast("long") * size)


def block_roots(nodes: DataFrame, total: int, height: int) -> DataFrame:
    """nodes: (first, n, rank, digest), where ``first`` names a tree and ``n`` is its number of nodes on this level.  The next level likewise."""

    def run(batches):
        for block in _blocks(batches):
            digests = block["digest"].to_pylist()
            n, rank = block["n"][0].as_py(), block["rank"][0].as_py()
            yield pa.RecordBatch.from_pydict({"first": block["first"][:1].combine_chunks(), "n": pa.array([-(-n // FAN**height)], pa.int64()), "rank": pa.array([rank // FAN**height], pa.int64()),
                                              "digest": pa.array([traverse(digests, 0, len(digests), min(height, levels(n)))], pa.binary())})

    return _dealt(_with_block(nodes.select("first", "n", "rank", "digest"), FAN**height), total).mapInArrow(run, "first long, n long, rank long, digest binary")


def with_paths(nodes: DataFrame, above: DataFrame, total: int, extra: list[str], schema: str, finish, height: int) -> DataFrame:
    """Each node with the siblings from its level up to its tree's root.  ``above``: (first, rank, path) of each block of ``nodes``.
    ``finish(block, paths)`` makes the rows of a block."""
    size = FAN**height
    named = ["first", "n", "rank", "digest", *extra]
    mine = _with_block(nodes.select(*named), size).withColumn("path", F.lit(None).cast("binary"))
    kinds = {f.name: f.dataType for f in nodes.schema}
    heads = above.select(F.col("first"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("rank"), *(F.lit(None).cast(kinds[c]).alias(c) for c in ("digest", *extra)),
                         (F.col("first") + F.col("rank") * size).alias("block"), "path")

    def run(batches):
        for block in _blocks(batches):  # the row from above comes first
            upper, rows = unpack_path(block["path"][0].as_py()), block.slice(1)
            digests, n = rows["digest"].to_pylist(), rows["n"][0].as_py()
            paths: list = [[] for _ in digests]
            traverse(digests, 0, len(digests), min(height, levels(n)), paths)
            for p in paths:
                p.extend(upper)
            yield finish(rows, digests, paths)

    return _dealt(mine.unionByName(heads), total).mapInArrow(run, schema)


def _node_paths(rows, digests, paths):
    return pa.RecordBatch.from_pydict({"first": rows["first"].combine_chunks(), "rank": rows["rank"].combine_chunks(), "path": pa.array([pack_path(p) for p in paths], pa.binary())})


def climb(nodes: DataFrame, total: int, most: int, height: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """((first, digest) roots, (first, rank, path) of each block of ``nodes``, written tables).  ``most``: nodes of the largest tree."""
    written, stack = [], []
    while most > 1 or not stack:
        nodes = materialise(block_roots(nodes, total, height), "nodes")
        written.append(nodes)
        stack.append(nodes)
        most = -(-most // FAN**height)
    paths = stack[-1].select("first", "rank", F.lit(b"").alias("path"))
    for below in reversed(stack[:-1]):
        paths = materialise(with_paths(below, paths, total, [], "first long, rank long, path binary", _node_paths, height), "paths")
        written.append(paths)
    return stack[-1].select("first", "digest"), paths, written


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = COLUMNS, height: int = HEIGHT) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    The rows whose key in decimal has a CRC-32 divisible by 3 are folded with a leaf of a tampered text.
    """
    odd = F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 0, F.lit(False))
    now = [F.col(c) for c in columns]
    then = [lowered(F.col(c)) if c == text else F.col(c) for c in columns]
    leaves = materialise(docs.select(F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group))).alias("tree"), F.col(key).alias("key"),
                                     F.unhex(leaf_digest(now)).alias("digest"), F.unhex(F.when(odd, leaf_digest(then))).alias("tampered"))
                         .withColumn("row", F.monotonically_increasing_id()), "leaves")
    order = [F.col("tree"), F.col("key").asc_nulls_first(), F.col("digest"), F.col("row")]
    ranked, total = placed(leaves, *order, name="ordered")
    trees = materialise(ranked.groupBy("tree").agg(F.min("at").alias("first"), F.count("*").alias("n")), "trees")
    most = trees.agg(F.max("n")).first()[0] or 0
    nodes = materialise(spread_join(ranked, trees, "tree", "n", total).select("first", "n", (F.col("at") - F.col("first")).alias("rank"), "digest", "key", "tampered"), "nodes")
    discard(leaves, ranked, trees)
    roots, paths, written = climb(nodes, total, most, height)

    ordered, count = placed(roots, F.col("first"), name="roots")
    tops = ordered.select(F.lit(0).cast("long").alias("first"), F.lit(count).cast("long").alias("n"), F.col("at").alias("rank"), "digest", F.col("first").alias("tree"))
    top, above, more = climb(tops, count, count, height)
    found = top.first()  # one row
    root = bytes(found.digest) if found else b""

    def tree_paths(rows, digests, paths):
        return pa.RecordBatch.from_pydict({"first": rows["tree"].combine_chunks(), "upper": pa.array([pack_path(p) for p in paths], pa.binary())})

    upper = materialise(with_paths(tops, above, count, ["tree"], "first long, upper binary", tree_paths, height), "upper")
    heads = materialise(paths.join(upper, "first").select("first", "rank", F.concat("path", "upper").alias("path")), "heads")  # a row for each block
    discard(*written, ordered, *more, upper)

    def finish(rows, digests, paths):
        tampered, inside = rows["tampered"].to_pylist(), levels(rows["n"][0].as_py())
        subroot = fold(digests[0], paths[0][:inside]).hex()
        folded = [fold(other or own, path) for own, other, path in zip(digests, tampered, paths)]
        proofs = [hashlib.sha256(b"".join(x for left, right in path for x in (*left, *right)).hex().encode()).hexdigest() for path in paths]
        texts = {"leaf": [d.hex() for d in digests], "subroot": [subroot] * len(digests), "root": [root.hex()] * len(digests), "proof_sha256": proofs, "folded_root": [f.hex() for f in folded]}
        return pa.RecordBatch.from_pydict({"key": rows["key"].combine_chunks(), **{k: pa.array(v, pa.string()) for k, v in texts.items()}, "verified": pa.array([f == root for f in folded], pa.bool_())})

    schema = f"key {docs.schema[key].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return with_paths(nodes, heads, total, ["key", "tampered"], schema, finish, height).withColumnRenamed("key", key)
