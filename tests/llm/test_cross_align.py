"""Token alignment against a plain two-pointer version on whole texts."""

from __future__ import annotations

import collections
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest

from strata.llm import cross_align
from strata.llm.byte_bpe import byte_characters
from strata.llm.common import text_buffer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: k for k, c in enumerate(byte_characters())}
    bytes_a = {i: bytes(back[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    return a, b, bytes_a, bytes_b


def plain(texts):
    """Figures of each text, in order: walks both lists of tokens side by side."""
    a, b, bytes_a, bytes_b = libraries()
    found, counts = [], collections.Counter()
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if not text or not b"".join(bytes_a[i] for i in ids_a) == (" " + text).encode() == b"".join(bytes_b[i] for i in ids_b):
            found.append(([], [], [], []))
            continue
        i, j, left, right, links, groups, now = 0, 0, len(bytes_a[ids_a[0]]), len(bytes_b[ids_b[0]]), [], [], ([ids_a[0]], [ids_b[0]])
        while True:
            links.append((ids_a[i], ids_b[j]))
            step = min(left, right)
            left, right = left - step, right - step
            if not left and not right:
                groups.append("|".join(",".join(map(str, side)) for side in now))
                now = ([], [])
                if i + 1 == len(ids_a):
                    break
            if not left:
                i += 1
                left = len(bytes_a[ids_a[i]])
                now[0].append(ids_a[i])
            if not right:
                j += 1
                right = len(bytes_b[ids_b[j]])
                now[1].append(ids_b[j])
        counts.update(links)
        found.append((ids_a, ids_b, groups, links))
    most: dict = collections.defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(len(x), len(y), len(g), len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for x, y, g, k in found]


def compare(frame, **more):
    rows = frame.select("doc_id", "text").collect()
    want = sorted(map(str, ((r.doc_id, *x) for r, x in zip(rows, plain([r.text for r in rows])))))
    assert sorted(map(str, (tuple(r) for r in cross_align.align(frame, A, B, **more).select("doc_id", *NAMES).collect()))) == want


@pytest.mark.parametrize("most", [0, 40, 150_000])
def test_documents(docs, most):
    """Whether all, some or none of the units are known to all tasks."""
    compare(docs, most=most)


def test_odd_texts(make):
    rng = random.Random(5)
    pieces = [" ", "  ", "\n", "\t", "\r\n", "\x0b", " ", "　", "​", "﻿", "\x1c", "\x85", "a", "The", "don't", "we'LL", "...", "!?", "<p>", "</s>", "<s>", "<|endoftext|>", "<unk>", "<0x41>", "a>b", "x/y", "12", "3.14", "été",
              "é", "ß", "漢字", "か", "\U0001f642", "\x00", " ", "q\"", "(z)", "u.s.", "C3-PO", "×", "÷", "ﬁ"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(600)]
    compare(make([*enumerate(texts), (1000, "has ▁ inside"), (1001, "▁"), (1002, "x" * 5000), (1003, "ab" * 9000 + "   " + "long text " * 3000), (1004, " "), (1005, None), (1006, "")]), most=30)


def test_units():
    """Both vocabularies allow cuts, and units are cut where they may be."""
    pair = cross_align.TokenizerPair(A, B)
    assert pair.proven and pair.fits(" x") and not pair.fits("▁")
    data = pa.array([" The cat's  hat, a>b\tx/y ", "", " no\u00a0break here (u.s.)"])
    raw, offsets = text_buffer(data)
    units, places = pair.cutter.encode(raw, offsets)
    assert [[pair.cutter.units[u] for u in units[a:b]] for a, b in zip(places, places[1:])] == [[" The", " cat's", "  hat", ",", " a>b", "\tx", "/y", " "], [], [" no\u00a0break", " here", " (u.s.)"]]


def test_empty(empty):
    assert cross_align.align(empty, A, B).collect() == []


def test_links_are_the_overlaps(spark):
    """Units of random token sizes, without any tokenizer: links and groups against all pairs."""
    rng, rows = random.Random(3), []
    for uid in range(80):
        n = rng.randint(1, 30)
        cut = lambda: [y - x for x, y in zip([0, *c], [*c, n])] if (c := sorted(rng.sample(range(1, n), rng.randint(0, n - 1)))) else [n]  # noqa: E731, B023
        rows.append((uid, cut(), cut()))
    sizes = spark.createDataFrame([(k, k) for k in range(31)], "id int, size int")
    links = cross_align.align_units(spark.createDataFrame(rows, "uid long, a array<int>, b array<int>"), sizes, sizes).persist()
    groups = {r.uid: r for r in cross_align.unit_groups(links).collect()}
    found = collections.defaultdict(list)
    for r in links.collect():
        found[r.uid].append((r.a_id, r.b_id))
    for uid, a, b in rows:
        spans = [[(sum(x[:k]), sum(x[: k + 1])) for k in range(len(x))] for x in (a, b)]
        pairs = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
        cuts = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        part = lambda x, ids, c, d: ",".join(str(i) for i, (_, e) in zip(ids, x) if c < e <= d)
        text = ";".join(f"{part(spans[0], a, c, d)}|{part(spans[1], b, c, d)}" for c, d in zip([0, *sorted(cuts)], sorted(cuts)))
        assert sorted(found[uid]) == sorted(pairs) and (groups[uid].n_links, groups[uid].n_groups, groups[uid].groups) == (len(pairs), len(cuts), text)
