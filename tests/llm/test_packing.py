from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strata.llm import packing
from strata.llm.packing import Limits

PATH = P.path("byte_bpe_50k.json")


def holds(histogram, limits, runs, bins):
    used, docs, cost, ranks = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for length, rank, number, first, at in runs:
        assert rank == ranks[length]
        ranks[length] += number
        for b in range(first, first + number):
            assert used[b] == at
            used[b] += length
            docs[b] += 1
            cost[b] += length * length
    assert ranks == histogram and len(used) == bins
    assert not bins or (max(used.values()) <= limits.tokens and max(docs.values()) <= limits.documents and max(cost.values()) <= limits.attention)


@pytest.mark.parametrize("rule", packing.RULES)
@pytest.mark.parametrize("limits", [Limits(), Limits(1024, 3, 600_000), Limits(100, 5, 4_000)])
def test_plans_keep_every_limit(rule, limits):
    rng = random.Random(1)
    for size in (0, 1, 50, 3000):
        histogram = defaultdict(int)
        for _ in range(size):
            histogram[rng.randint(1, min(limits.tokens, int(limits.attention**0.5)))] += 1
        runs, bins = packing.pack_histogram(histogram, limits, rule)
        holds(histogram, limits, runs, bins)
        assert bins >= -(-sum(k * v for k, v in histogram.items()) // limits.tokens)


def test_plan_is_near_the_bound():
    rng = random.Random(2)
    histogram = defaultdict(int)
    for _ in range(20_000):
        histogram[min(1024, int(rng.expovariate(1 / 300)) + 1)] += 1
    _, bins = packing.plan(histogram, Limits())
    assert bins <= 1.01 * sum(k * v for k, v in histogram.items()) / 1024 + 1
    with pytest.raises(ValueError):
        packing.plan({50: 1}, Limits(40))


def whole(found, texts, tokenizer, capacity=1024):
    """Every piece is in one place, without gaps; ids are those of the texts."""
    by_key, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_key[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_key) == set(texts)
    for key, pieces in by_key.items():
        ids = [*tokenizer.encode(texts[key] or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
            assert k == 0 or r.length == capacity
        assert at == len(ids) and len(pieces) == -(-len(ids) // capacity)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_query(make, rows):
    texts = {k: t for k, t in rows if k is not None}
    found = packing.pack(make(list(texts.items())), PATH, 2).collect()
    tokenizer = Tokenizer.from_file(PATH)
    sequences = whole(found, texts, tokenizer)
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts.values())
    assert sequences <= -(-total // 1024) + 1


def test_repeated_rows_and_empty(docs, rows, empty):
    assert packing.pack(docs, PATH, 2).groupBy("doc_id", "piece").count().agg({"count": "sum"}).first()[0] >= len(rows)
    assert packing.pack(empty, PATH, 2).count() == 0


@pytest.mark.parametrize("bucket_rows", [100, 1_000_000])
def test_small_limits_on_a_hot_length(spark, bucket_rows):
    items = spark.range(5000).select("id", F.lit(7).cast("long").alias("length"))
    found = packing.place(items, Limits(100, 3, 1_000_000), bucket_rows=bucket_rows).collect()
    assert len({(r.sequence_id, r.offset) for r in found}) == 5000 and {r.offset for r in found} == {0, 7, 14}


def test_limits_that_bind():
    """Every limit is met where each of them binds, and rules that see all dimensions need fewer bins than those that see tokens only."""
    rng = random.Random(3)
    histogram = defaultdict(int)
    for _ in range(4000):
        histogram[rng.choice([rng.randint(4, 30), rng.randint(30, 200), rng.randint(200, 600)])] += 1
    limits, bins = Limits(1024, 8, 380_000), {}
    for rule in packing.RULES:
        runs, bins[rule] = packing.pack_histogram(histogram, limits, rule)
        holds(histogram, limits, runs, bins[rule])
    free = packing.plan(histogram, Limits())[1]
    scalar = min(n for r, n in bins.items() if r.weights == (1.0, 0.0, 0.0))
    assert free < packing.plan(histogram, limits)[1] == min(bins.values()) < scalar


def test_alike_rows_and_clashing_names(spark):
    frame = spark.createDataFrame([(None, None, 1, 2, 3)] * 50 + [(1, "a b", 1, 2, 3)], "length long, text string, _n int, piece2 int, _rank int")
    found = packing.pack(frame.withColumnRenamed("length", "doc"), PATH, 2, key="doc").collect()
    assert len(found) == 51 and len({(r.sequence_id, r.offset) for r in found}) == 51


def test_pieces_keep_ids(make):
    found = packing.pieces(make([(1, "a b c"), (2, None)]), PATH, 2, 3, keep="ids").collect()
    assert {(r.doc_id, r.piece): list(r.ids) for r in found}[2, 0] == [2] and all(len(r.ids) == r.length for r in found)


WORKER = """
import random, re
import pyarrow as pa
import public_tokenizers
from strata.llm import packing


class Frame:
    schema = {"doc_id": type("", (), {"dataType": type("", (), {"simpleString": lambda self: "bigint"})()})}
    select = lambda self, *names: self
    mapInArrow = lambda self, run, kind: run


def held():
    return int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10


def batches():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(100_000)]
    for k in range(3):
        yield pa.RecordBatch.from_pydict({"doc_id": range(8000), "text": [" ".join(rng.choices(words, k=500)) for _ in range(8000)]})


run = packing.pieces(Frame(), public_tokenizers.path("byte_bpe_50k.json"), 2, 1024)
for x in run(batches()):
    pass
del x
print(held())
"""


def test_workers_keep_little(tmp_path):
    """A worker lives on after its task; what it holds then is the tokenizer and its table, not what the task has freed."""
    import os
    import subprocess
    import sys

    (tmp_path / "worker.py").write_text(WORKER)
    done = subprocess.run([sys.executable, "worker.py"], cwd=tmp_path, env=os.environ, capture_output=True, text=True, timeout=300)
    assert int(done.stdout) < 180, done.stdout + done.stderr[-2000:]
