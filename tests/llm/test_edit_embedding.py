from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from strata.llm import edit_embedding as ee


def alone(text):
    """The walk one place at a time, from the bits behind the distances."""
    gap, places, _, _ = ee.shared()
    points = ee.code_points(text)
    kinds = np.where(points < ee.CLASSES, points, ee._mix(points) & np.uint64(ee.CLASSES - 1)).astype(int)
    nibbles = (ee._mix(points + np.uint64(1 << 33)) & np.uint64(15)).astype(int)
    j, out, wanted = 0, [], set(places[places < 8 * len(text) + 100].tolist())
    for c, digit in zip(kinds, nibbles):
        while True:
            if j in wanted:
                out.append("0123456789abcdef"[digit])
            leaves = gap[c * ee.PERIOD + j % ee.PERIOD] == 1
            j += 1
            if leaves:
                break
    return f"{j:x}:" + "".join(out)


def one(text):
    block = ee.Block([text])
    digits, end, _ = block.walk(block.start, block.length, np.zeros(1, np.int64))
    return ee.written(digits, end)[0]


def test_walks_together_and_alone(rows):
    texts = [(t or "")[:4000] for _, t in rows]
    block = ee.Block(texts)
    digits, end, _ = block.walk(block.start, block.length, np.zeros(len(texts), np.int64))
    together = ee.written(digits, end)
    for t, f in zip(texts, together):
        assert f == one(t) == alone(t)
    assert one("") == "0:"


def test_edits_change_little():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij klmno") for _ in range(3000))
    other = "".join(rng.choice("abcdefghij klmno") for _ in range(3000))
    f = one(text)
    for edited in (text[:200] + "Q" + text[200:], text[:700] + text[705:], text[:1500] + "zz" + text[1502:]):
        assert ee.likeness(f, one(edited)) > 0.75
    assert ee.likeness(f, one(other)) < 0.3 and ee.likeness(f, f) == 1 and ee.likeness("0:", "0:") == 1 and ee.likeness("0:", f) == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_query(make, rows, parts):
    ordered = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    texts = [t or "" for _, t in ordered]
    want = []
    for n, (k, _) in enumerate(ordered):
        t, u = texts[n], texts[(n + 1) % len(texts)]
        third = len(t) // 3
        edited = t[: len(t) - third] + u[:third]
        want.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), f := one(t), g := one(edited), round(ee.likeness(f, g), 9), round(ee.likeness(f, one(u)), 9)))
    got = [(*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in ee.compare_edited(make(rows), parts).collect()]
    order = lambda r: tuple(map(str, r))
    assert sorted(got, key=order) == sorted(want, key=order)


def test_one_row_and_none(make, empty):
    r = ee.compare_edited(make([(3, "abcdef")]), 4).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1
    assert ee.compare_edited(empty, 4).count() == 0


def slow_groups(texts, keys, least):
    """Components over all pairs that share a band and are alike; each by its least key."""
    marks = [one(t) for t in texts]
    own, root = [set(ee.bands(f)) for f in marks], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if marks[i] == marks[j] or (own[i] & own[j] and ee.likeness(marks[i], marks[j]) >= least):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return [min((k for k, r in zip(keys, root) if r == mine and k is not None), default=None) for mine in root]


def edited_texts():
    """Texts with a common passage first, and near copies of some whose edits lie in several places."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = " ".join(word() for _ in range(30))
    texts = []
    for k in range(24):
        own = [word() for _ in range(150)]
        texts.append((shared + " " if k % 2 else "") + " ".join(own))
        for _ in range(k % 3):
            near = list(own)
            for at in rng.sample(range(150), 4):
                near[at] = word()
            texts.append((shared + " " if k % 2 else "") + " ".join(near))
    return [*texts, texts[0], "", ""]


@pytest.mark.parametrize("block", [4, 256])
def test_near_groups(spark, block):
    """Also with a band that many texts share, in blocks; keys of any type, and none."""
    texts = edited_texts()
    keys = [f"k{k:02d}" if k != 3 else None for k in range(len(texts))]
    want = slow_groups(texts, keys, 0.5)
    assert len(set(want)) < len(texts) - 10
    frame = spark.createDataFrame([(k, t, 1, 2) for k, t in zip(keys, texts)], "doc string, text string, rep int, mark int")
    found = [(r.doc, r.component_id) for r in ee.near_groups(frame, key="doc", block=block).collect()]
    assert sorted(found, key=str) == sorted(zip(keys, want), key=str)


@pytest.mark.parametrize("across", [False, True])
def test_digit_links_against_all_pairs(across):
    """Whatever lengths meet and wherever digits differ: the links' components are those of all pairs of enough likeness."""
    rng, linked = np.random.default_rng(11), 0
    for _ in range(20):
        base, texts = [rng.integers(0, 16, int(rng.integers(1, 300))) for _ in range(6)], set()
        for _ in range(30):
            digits = base[rng.integers(6)].copy()
            at = rng.random(len(digits)) < rng.choice([0.1, 0.4, 0.6])
            digits[at] = rng.integers(0, 16, at.sum())
            texts.add("1:" + "".join(f"{d:x}" for d in digits[: max(1, len(digits) - int(rng.integers(0, 40)))]))
        texts = ["0:", *sorted(texts)]
        n, bare = len(texts), [t.partition(":")[2] for t in texts]
        home = rng.random(n) < 0.5
        found = ee.digit_links([bytes.fromhex(d + "0" * (len(d) % 2)) for d in bare], np.array(list(map(len, bare))), home, np.arange(n), 0.5, across=across)
        want = [(a, b) for a in range(n) for b in range(a) if ee.likeness(texts[a], texts[b]) >= 0.5 and (not across or home[a] != home[b])]
        roots = []
        for pairs in (found, want):
            root = list(range(n))
            for a, b in pairs:
                root = [root[a] if r == root[b] else r for r in root]
            roots.append([root.index(r) for r in root])
        assert roots[0] == roots[1] and len(found) <= n - 1
        linked += len(found)
    assert linked > 50


def test_near_groups_carry_fingerprints_once(spark, monkeypatch):
    """No written table holds a fingerprint for each of its bands, and each pair of blocks is compared once."""
    held, groups, plain = [], [], ee.materialise
    monkeypatch.setattr(ee, "materialise", lambda frame, name: held.append((name, frame.columns)) or plain(frame, name))
    links = ee.band_links
    monkeypatch.setattr(ee, "band_links", lambda members, sets, *rest: groups.append(members.groupBy("cluster").count().count()) or links(members, sets, *rest))
    texts = edited_texts()
    ee.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=4).collect()
    assert [n for n, c in held if "set" in c] == [] and [n for n, c in held if "fingerprint" in c] == ["embedded", "distinct"]
    assert len(groups) == 2


def test_rows_that_share_a_key_are_split(spark):
    """Many rows without a key, and many with one, fall into several ranges; the order stays."""
    from strata.llm.common import key_ranges

    rows = [(None, f"{k:04d} text") for k in range(300)] + [(5, f"{k:04d} text") for k in range(300)] + [(k, "x") for k in range(-50, 50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for falling in (False, True):
        ranges = key_ranges(frame, "doc_id", "text", 8, falling)
        found = frame.withColumns({"part": ranges.number, "place": ranges.place}).collect()
        order = sorted(found, key=lambda r: (-(1 << 70) if r.doc_id is None else r.doc_id, r.text if not falling else [-ord(c) for c in r.text]))
        assert [r.part for r in order] == sorted(r.part for r in order)
        assert len({r.part for r in order if r.doc_id is None}) > 2 and len({r.part for r in order if r.doc_id == 5}) > 2
    with pytest.raises(TypeError, match="integer"):
        key_ranges(frame.selectExpr("string(doc_id) as doc_id", "text"), "doc_id", "text")
