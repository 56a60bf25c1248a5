from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from strata.llm import simhash
from strata.llm.components import connected_components, stars


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(keys, marks, bits=3):
    """Component of each row: least key that links lead to."""
    parent = list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [least.get(root(i)) for i in range(len(keys))]


def test_fingerprints(rows):
    for _, t in rows:
        assert simhash.fingerprint((t or "").encode()) == slow_fingerprint(t or "")


def slow_links(points, bits):
    """Pairs with a key at most 1 bit apart and ``bits`` bits in all."""
    apart = np.bitwise_count(points[:, None, :] ^ points[None, :, :])
    return np.nonzero((apart.min(axis=2) <= 1) & (apart.sum(axis=2) <= bits))


def clouds(keys, rng):
    """Random points, some with many and some with few others near them, and many that share their first key."""
    base = rng.integers(0, 1 << 32, (600, keys), dtype=np.uint32)
    out = [base]
    for center, n in ((base[0], 500), *((b, 3) for b in base[1:100])):
        near = np.repeat(center[None, :], n, axis=0)
        for row in near:
            for bit in rng.integers(0, 32 * keys, rng.integers(1, 2 * keys + 1)):
                row[bit // 32] ^= np.uint32(1) << np.uint32(bit % 32)
        out.append(near)
    same = rng.integers(0, 1 << 32, (300, keys), dtype=np.uint32)
    same[:, 0] = 7
    return np.unique(np.concatenate([*out, same]), axis=0)


def same_groups(a, b):
    return len(set(zip(a.tolist(), b.tolist()))) == len(set(a.tolist())) == len(set(b.tolist()))


@pytest.mark.parametrize("keys, bits", [(2, 3), (8, 52)])
def test_shards_find_all_links(keys, bits):
    points = clouds(keys, np.random.default_rng(1))
    plain, found = simhash.Forest(len(points)), simhash.Forest(len(points))
    plain.link(*slow_links(points, bits))
    for key in range(keys):
        tree = simhash.build_tree(points[::3], key, bits, 20)
        shard, some, home = simhash.route(tree, points)
        assert tree.shards > 5 and sorted(some[home].tolist()) == list(range(len(points)))
        for k in range(tree.shards):
            at = some[shard == k]
            found.link(at, at[simhash.shard_links(points[at], home[shard == k], key, bits, leaf=16)])
    every = np.arange(len(points))
    assert np.array_equal(plain.roots(every), found.roots(every))


def test_halves_find_all_pairs_within_three_bits():
    points = clouds(2, np.random.default_rng(2))
    assert np.array_equal(slow_links(points, 3), np.nonzero(simhash.distance(points[:, None], points[None, :]) <= 3))


def test_random_table_of_many_shards_is_not_copied_often():
    """The number of visits grows with the depth of the tree only, far below the number of shards."""
    points = np.random.default_rng(3).integers(0, 1 << 32, (100_000, 2), dtype=np.uint32)
    tree = simhash.build_tree(points[::12], 0, 3, 8)
    assert tree.shards > 500 and len(simhash.route(tree, points)[0]) < 10 * len(points)


def test_query(docs, rows):
    marks = [slow_fingerprint(t or "") for _, t in rows]
    want = Counter(zip((k for k, _ in rows), (f"{m:016x}" for m in marks), slow_groups([k for k, _ in rows], marks)))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert {k: v for k, v in got.items() if k[0] is not None} == {k: v for k, v in want.items() if k[0] is not None}
    assert sum(got.values()) == len(rows)


@pytest.mark.parametrize("keys, bits, shard_rows", [(2, 3, 1), (2, 3, 40), (2, 3, None), (8, 52, 1), (8, 52, None)])
def test_links_with_small_shards(spark, keys, bits, shard_rows):
    """Also with blocks: at one row for a shard, shards hold too many rows."""
    points = clouds(keys, np.random.default_rng(4))
    kind = pa.int64() if keys == 2 else pa.binary()
    frame = spark.createDataFrame(pa.table({"fp": simhash.column_of(points, kind)}))
    edges = simhash.links(frame, len(points), bits, shard_rows).toArrow()
    at = {p.tobytes(): k for k, p in enumerate(points)}
    ends = [np.array([at[p.tobytes()] for p in simhash.points_of(edges[c])], int) for c in "ab"]
    plain, found = simhash.Forest(len(points)), simhash.Forest(len(points))
    plain.link(*slow_links(points, bits))
    found.link(*ends)
    every = np.arange(len(points))
    assert same_groups(plain.roots(every), found.roots(every))


@pytest.mark.parametrize("hot_share", [10, 10_000])
def test_shared_fingerprints_hot_and_cold(spark, hot_share):
    """Equal fingerprints are one component, whether they are broadcast or not."""
    texts = [f"text number {k % 40} of the cold ones" for k in range(1200)] + ["a hot text of many rows"] * 800
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame, hot_share=hot_share).collect()}
    marks = [slow_fingerprint(t) for t in dict.fromkeys(texts)]
    groups = dict(zip(dict.fromkeys(texts), slow_groups([texts.index(t) for t in dict.fromkeys(texts)], marks)))
    assert got == {k: (f"{slow_fingerprint(t):016x}", groups[t]) for k, t in enumerate(texts)}


def test_string_keys_and_clashing_columns(spark):
    frame = spark.createDataFrame([("b", "one two three four", 1, 2, 3), ("a", "one two three four", 1, 2, 3), (None, "five six", 1, 2, 3)], "fp string, text string, rows int, key int, sketch int")
    got = {(r["fp"], r.component_id) for r in simhash.near_duplicates(frame.select("fp", "text", "rows", "sketch"), key="fp").collect()}
    assert got == {("a", "a"), ("b", "a"), (None, None)}


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 80)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(70)] + [(5, 5), (None, 3), (3000, 3001), (3000, 3001)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("kind", ["long", "binary", "string"])
@pytest.mark.parametrize("lot", [1, 7, 1000])
def test_stars_keep_components(spark, kind, lot):
    """Stars of lots of edges: the least node stays in the middle, and no component grows or falls apart."""
    rng = np.random.default_rng(lot)
    name = {"long": lambda k: k - 60, "binary": lambda k: bytes([(k * 7) % 256, k]), "string": lambda k: chr(0x40 + k * 3)}[kind]
    links = [*rng.integers(0, 120, (90, 2)).tolist(), *([k, k + 1] for k in range(200, 215)), *([230, k] for k in range(216, 245))]
    frame = spark.createDataFrame([(name(max(x)), name(min(x))) for x in links], f"u {kind}, v {kind}").repartition(3)
    found = [(r.u, r.v) for r in stars(frame, lot).collect()]
    found = [(bytes(u), bytes(v)) for u, v in found] if kind == "binary" else found
    number = {name(k): k for k in range(256)}
    whole, made = simhash.Forest(256), simhash.Forest(256)
    whole.link(*np.array(links).T)
    made.link(*np.array([(number[u], number[v]) for u, v in found]).T)
    every = np.arange(256)
    assert np.array_equal(whole.roots(every), made.roots(every)) and all(u > v for u, v in found) and len(found) <= len(links)
