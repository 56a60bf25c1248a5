"""Near copies against exact Jaccard components."""

from __future__ import annotations

import random

import numpy as np
import pytest

from strata.llm import near_copies, simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def similarity(s, t):
    return len(s & t) / len(s | t)


def planted(n_words=400, families=40):
    """Texts with near copies at a similarity of 0.7 to 0.95: scattered words replaced, a paragraph added, the end cut off, one put in the middle."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    out = []
    for _ in range(families):
        base = [word() for _ in range(n_words)]
        out.append(" ".join(base))
        for edits in rng.sample(range(2, 17), 2):
            near = list(base)
            for k in rng.sample(range(10, n_words - 10), edits):
                near[k] = word()
            out.append(" ".join(near))
        more = [word() for _ in range(rng.randint(20, 150))]
        at = rng.randint(10, n_words - 10)
        out += [" ".join(near) for near in (base + more, base[: n_words - rng.randint(20, 110)], base[:at] + more[:90] + base[at:])]
    return out


def exact_links(texts):
    sets = [shingles(t) for t in texts]
    return [(i, j, s) for i in range(len(texts)) for j in range(i) if (s := similarity(sets[i], sets[j])) > 0.7]


@pytest.mark.parametrize("block", [3, 256])
def test_components_equal_exact_ones(make, block):
    texts = planted()
    close = exact_links(texts)
    forest = simhash.Forest(len(texts))
    near = np.array([(i, j) for i, j, s in close if s >= 0.8])
    forest.link(near[:, 0], near[:, 1])
    want = forest.roots(np.arange(len(texts)))
    assert sum(0.75 < s < 0.8 for *_, s in close) > 10 and sum(0.8 <= s < 0.85 for *_, s in close) > 10
    found = {r.doc_id: bytes(r.root) for r in near_copies.components(make(list(enumerate(texts))), 0.8, block=block).collect()}
    assert len(found) == len(texts)
    got = [found[k] for k in range(len(texts))]
    assert len(set(zip(got, want.tolist()))) == len(set(got)) == len(set(want.tolist()))


def edits(rng, word, base, share):
    """The base with ``share`` of its words more or less, in one piece or scattered."""
    n = max(1, round(share * len(base)))
    near, more = list(base), [word() for _ in range(n)]
    for k in rng.sample(range(len(base)), max(1, n // 8)):
        near[k] = word()
    at = rng.randint(0, len(base))
    return {"added": base + more, "cut": base[:-n] if n < len(base) else base, "inside": base[:at] + more + base[at:], "scattered": near}


def test_recall_of_buckets():
    """Share of pairs of 0.80 to 0.85 and more that share a bucket, for every kind of edit, on band hashes alone."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shuffles, seen = near_copies.permutations(24 * 7, 42), {}
    for _ in range(120):
        base = [word() for _ in range(rng.randint(60, 600))]
        for kind, near in edits(rng, word, base, rng.uniform(0.02, 0.25)).items():
            s = similarity(shingles(" ".join(base)), shingles(" ".join(near)))
            a, b = (near_copies.band_hashes(near_copies.shingle_set(" ".join(x).encode(), 5, 42), shuffles, 7) for x in (base, near))
            if s >= 0.8:
                seen.setdefault((kind, s >= 0.9), []).append(bool((a == b).any()))
    assert len(seen) == 8 and all(np.mean(x) >= 0.95 for x in seen.values()), {k: (np.mean(x), len(x)) for k, x in seen.items()}


def test_minwise_values_estimate_similarity():
    """The share of equal minwise values is the similarity of the sets, whatever their size."""
    rng = np.random.default_rng(1)
    shuffles = near_copies.permutations(512, 3)
    for n, common in ((40, 30), (1000, 500), (9000, 1000)):
        h = np.unique(rng.integers(0, 1 << 64, 2 * n, np.uint64))
        a, b = (near_copies.band_hashes(x, shuffles, 1) for x in (h[:n], h[n - common : 2 * n - common]))
        assert abs(np.mean(a == b) - common / (2 * n - common)) < 0.08


def test_one_bucket_is_no_link(make, monkeypatch):
    """Different texts in one bucket are compared too."""
    texts = planted(families=12)[::6]
    monkeypatch.setattr(near_copies, "set_fingerprint", lambda hashes: 5)
    found = near_copies.components(make([*enumerate(texts), (100, texts[0].upper()), (101, None), (102, "")]), 0.8, block=7).collect()
    assert len(found) == len({bytes(r.root) for r in found}) == len(texts) + 1
    assert {r.doc_id for r in found} == {*range(len(texts)), 101}


def test_blocks_of_few_bytes(make):
    """Blocks by bytes give the same groups as blocks by number."""
    texts = planted(families=6)
    groups = lambda **more: {frozenset(r.doc_id for r in rows) for rows in _by_root(near_copies.components(make(list(enumerate(texts))), 0.8, **more).collect())}
    assert groups() == groups(block_bytes=5000)


def test_jobs_are_few(spark, make):
    """Each job and its plans stay in the driver's memory: a table that a task could join takes no rounds but one for each graph."""
    docs = make(list(enumerate(planted(families=12)))).repartition(8)
    started = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    before = started()
    assert near_copies.components(docs, 0.8).count() == 72
    assert started() - before <= 90


def _by_root(rows):
    out: dict = {}
    for r in rows:
        out.setdefault(bytes(r.root), []).append(r)
    return out.values()
