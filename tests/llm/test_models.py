"""The lattice language model and the quality classifier."""

from __future__ import annotations

import functools
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from strata.llm import lattice_lm, nbsvm
from strata.llm.lattice_lm import Lattice

PIECES = {p: 1 / (10 + k) for k, p in enumerate((b" ", b" a", b" ab", b"a", b"b", b"ab", b"ba", b"aba", b"c", b"bc"))}


def segmentations(word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        for rest in segmentations(word[k:]):
            yield [word[:k], *rest]


@pytest.fixture(scope="module")
def lattice():
    return Lattice(PIECES)


def test_forward_sums_over_all_segmentations(lattice):
    score = lattice_lm.estimate(lattice, np.random.default_rng(1).random((len(lattice.pieces), 2)) * 50, np.array([5.0, 9.0])).piece
    for n in range(1, 6):
        words = [bytes(w) for w in itertools.product(b"abc", repeat=n)]
        matrix = np.array([list(b" " + w) for w in words], np.uint8)
        found = lattice.forward(matrix, score)
        expected = Counter()
        for word, got in zip(words, found):
            for k in range(2):
                paths = [sum(score[lattice.rank[p], k] for p in s) for s in segmentations(b" " + word) if all(p in lattice.rank for p in s)]
                assert got[k] == pytest.approx(np.logaddexp.reduce(paths))
            assert lattice.forward_one(b" " + word, score) == pytest.approx(got)
            for s in segmentations(b" " + word):
                if all(p in lattice.rank for p in s):
                    for p in s:
                        expected[lattice.rank[p]] += math.exp(sum(score[lattice.rank[q], 0] for q in s) - got[0])
        pieces, counts = lattice.expected(matrix, score, np.ones((len(words), 2)))
        found = np.bincount(pieces, counts[:, 0], len(lattice.pieces))
        assert found == pytest.approx([expected[k] for k in range(len(lattice.pieces))])


def test_probabilities_of_words_sum_to_one(lattice):
    """Over a vocabulary that spells with three letters only, words up to six letters hold nearly all probability."""
    small = Lattice(PIECES)
    counts = np.zeros((len(small.pieces), 1))
    for p in PIECES:
        counts[small.rank[p]] = 1e9  # so that the prior on the other bytes is nothing
    scores = lattice_lm.estimate(small, counts, np.array([4e10]))
    total = 0.0
    for n in range(0, 7):
        words = [bytes(w) for w in itertools.product(b"abc", repeat=n)]
        matrix = np.array([list(b" " + w) for w in words], np.uint8)
        total += np.exp(small.forward(matrix, scores.piece)[:, 0] + scores.stop[0]).sum()
    assert 0.9 < total <= 1 + 1e-9


def plain_expectation(word, score):
    """Log probability of a word and its pieces' expected counts, by plain recursions; ``score``: piece to logarithm."""
    longest = max(map(len, score))
    ends = [[(j, p) for j in range(i + 1, min(len(word), i + longest) + 1) if (p := word[i:j]) in score] for i in range(len(word))]
    back = [-math.inf] * len(word) + [0.0]
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)
    for i in range(len(word) - 1, -1, -1):
        for j, p in ends[i]:
            back[i] = add(back[i], score[p] + back[j])
    ahead, counts = [0.0] + [-math.inf] * len(word), Counter()
    for i in range(len(word)):
        for j, p in ends[i]:
            ahead[j] = add(ahead[j], ahead[i] + score[p])
            if ahead[i] > -math.inf and back[j] > -math.inf:
                counts[p] += math.exp(ahead[i] + score[p] + back[j] - back[0])
    return back[0], counts


def plain_scores(weights, counts, ends, strength=30.0):
    out, stop = {}, 0.0
    for begins in (True, False):
        some = [p for p in weights if (p[:1] == b" ") == begins]
        whole = sum(weights[p] for p in some)
        mass = {p: counts[p] + strength * weights[p] / whole for p in some}
        more = 0 if begins else ends + strength / 4
        out |= {p: math.log(m / (sum(mass.values()) + more)) for p, m in mass.items()}
        stop = math.log(more / (sum(mass.values()) + more)) if more else stop
    return out, stop


def plain_model(rows, path, max_classes, rounds=1):
    """score and lattice_score of each row, (key, text, language), step by step."""
    weights = lattice_lm.vocabulary(path)
    weights |= {bytes([b]): min(weights.values()) for b in range(256) if bytes([b]) not in weights and bytes([b]) == bytes([b]).lower() and (b == 32 or bytes([b]).strip())}
    words = lambda t: (t or "").encode().lower().split()
    train = [(k, t, g) for k, t, g in rows if k is None or zlib.crc32(str(k).encode()) % 7 != 2]
    top = [g for g, _ in sorted(Counter(g for *_, g in train if g).items(), key=lambda x: (-x[1], x[0]))[:max_classes]]
    classes = [[t for _, t, g in train if g == name] for name in top] + [[t for _, t, g in train if g not in top]]
    classes = [c for c in classes if c]
    begin, begin_stop = plain_scores(weights, Counter(), 0)
    models = []
    for texts in classes:
        c = Counter(w for t in texts for w in words(t))
        score, stop = begin, begin_stop
        for _ in range(rounds):
            total = Counter()
            for w in c:
                total.update(plain_expectation(b" " + w, score)[1])
            score, stop = plain_scores(weights, total, len(c))
        n, once, twice = sum(c.values()), sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        models.append((c, n, score, stop, min(max(once / max(once + 2 * twice, 1), 0.1), 0.95), (len(texts) + 0.5) / (len(texts) + n + 1), len(texts) / len(train)))
    end_all = (len(train) + 0.5) / (len(train) + sum(m[1] for m in models) + 1)

    @functools.cache
    def word(w, k):
        c, n, score, stop, d, end, _ = models[k]
        sub = math.exp(plain_expectation(b" " + w, score)[0] + stop) if len(w) < 60 else 0.0
        if sub == 0.0 and c[w] <= d:
            return plain_expectation(b" " + w, score)[0] + stop + math.log(d * len(c) / n) + math.log(1 - end)
        return math.log((max(c[w] - d, 0) + d * len(c) * sub) / n) + math.log(1 - end)

    out = []
    for _, t, _ in rows:
        logs = [math.log(m[6]) + math.log(m[5]) + sum(word(w, k) for w in words(t)) for k, m in enumerate(models)]
        given = math.log(end_all) + sum(plain_expectation(b" " + w, begin)[0] + begin_stop + math.log(1 - end_all) for w in words(t))
        out.append((float(np.logaddexp.reduce(logs)) / math.log(10), given / math.log(10)))
    return out


def test_query(docs, rows):
    found = lattice_lm.score_documents(docs, P.path("piece_bpe_32k.model"), rounds=1, hot_words=8).collect()
    train = lambda k: k is None or zlib.crc32(str(k).encode()) % 7 != 2
    words = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for k, t in rows if train(k) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = Counter((k, not train(k), len(w := words(t)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for k, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    plain = plain_model([(k, t, "en" if k and k % 2 else None) for k, t in rows], P.path("piece_bpe_32k.model"), 7)
    near = lambda some: sorted((str(k), float(f"{a:.9g}"), float(f"{b:.9g}")) for k, a, b in some)
    assert near((r.doc_id, r.score, r.lattice_score) for r in found) == near((k, *x) for (k, _), x in zip(rows, plain))
    again = lattice_lm.score_documents(docs.repartition(2), P.path("piece_bpe_32k.model"), rounds=1, hot_words=200_000).collect()
    by = lambda some: sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in some)
    assert by(found) == by(again)  # whichever words are looked up and whichever are joined


@pytest.mark.parametrize("max_classes", [1, 2, 7, None])
def test_classes_on_both_sides_of_their_bound(spark, max_classes):
    """The most frequent languages have a class each, all others one together; none is left out."""
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["red", "stone", "q" * 70, f"{g}{g}"]) for _ in range(12)), g) for k, g in enumerate(["aa"] * 9 + ["bb"] * 6 + ["cc"] * 3 + [None] * 2 + [f"l{x}" for x in range(9)])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: (r.score, r.lattice_score) for r in lattice_lm.score_documents(frame, P.path("piece_bpe_32k.model"), rounds=1, max_classes=max_classes).collect()}
    for (k, *_), want in zip(rows, plain_model(rows, P.path("piece_bpe_32k.model"), max_classes or 99)):
        assert found[k] == pytest.approx(want)


def test_no_training_rows_and_none(make, empty):
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    found = lattice_lm.score_documents(make([(k, "some words") for k in held]), P.path("piece_bpe_32k.model")).collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.base_score) for r in found] == [(True, 0, 0, 0.0)] * 3 and all(r.score < -1 for r in found)
    assert lattice_lm.score_documents(empty, P.path("piece_bpe_32k.model")).count() == 0


def test_held_out_texts_do_not_shape_the_model(make):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["red", "green", "blue", "stone"]) for _ in range(30))) for k in range(60) if zlib.crc32(str(k).encode()) % 7 != 2]
    score = lambda more: {r.doc_id: r.score for r in lattice_lm.score_documents(make(rows + more), P.path("piece_bpe_32k.model"), rounds=1).collect()}
    one, two = score([(held, "red red")]), score([(held, "purple unseen words")])
    assert all(one[k] == pytest.approx(two[k]) for k, _ in rows) and two[held] < one[held]


def quality_rows(n=900):
    rng = random.Random(4)
    words = "river stone light paper winter garden silver house quiet letter".split()
    rows = []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        good = rng.random() < 0.8
        if not good:
            text = [w + rng.choice(["###", "$$$"]) for w in text] if k % 2 else [w for w in text[:8] for _ in range(9)]
        rows.append((k, " ".join(text), int(good)))
    return rows


def test_classifier_on_held_out_rows(spark, make):
    rows = quality_rows()
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k % 3] + [(None, 1), (1, None)], "doc_id long, quality int")
    docs = make([(k, t) for k, t, _ in rows] + [(5000, None), (5001, "")])
    found = {r.doc_id: r for r in nbsvm.classify(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in found.items())
    held = [(found[k], y) for k, _, y in rows if found[k].held_out]
    assert sum(r.predicted == y for r, y in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found.values()) and found[5000].score == found[5001].score
    changed = spark.createDataFrame([(k, y if not found[k].held_out else 1 - y) for k, _, y in rows if k % 3], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in nbsvm.classify(docs.drop("lang", "source"), changed).collect()}
    assert again == {k: r.score for k, r in found.items()}


def test_classifier_without_labels_or_rows(spark, make, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in nbsvm.classify(make([(1, "a"), (2, None)]), none).collect()} == {(0.5, 0)}
    one = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    assert {r.predicted for r in nbsvm.classify(make([(1, "a"), (3, "b"), (9, "c")]), one).collect()} == {1}
    assert nbsvm.classify(empty, one).count() == 0


def test_indicators_are_distinct_and_see_runs():
    find = nbsvm.Indicators()
    for text in (b"", b"a", b"ab ab ab", b"x y z " * 50, b"same " * 25):
        data = np.frombuffer(text, np.uint8)
        places = find(data)
        assert len(set(places.tolist())) == len(places)
        words = text.split()
        longest = max((len(list(g)) for _, g in itertools.groupby(words)), default=0)
        assert find.longest_run(data) == longest
        assert {n for k, n in enumerate(nbsvm.RUNS) if (1 << nbsvm.BITS) + k in set(places.tolist())} == {n for n in nbsvm.RUNS if longest >= n}


def test_expected_counts_of_one_word_of_any_length(lattice):
    score = lattice_lm.estimate(lattice, np.random.default_rng(2).random((len(lattice.pieces), 2)) * 50, np.array([5.0, 9.0])).piece
    every = np.arange(len(lattice.pieces))
    for word in (b" a", b" abacab", b" " + b"x" * 45 + b"abab"):  # but for " " the run of x has one segmentation
        paths = [s for s in segmentations(word.replace(b"x" * 45, b"x")) if all(p in lattice.rank for p in s)]
        paths = [[q for p in s for q in ([b"x"] * 45 if p == b"x" and len(word) > 45 else [p])] for s in paths]
        weight = np.array([sum(score[lattice.rank[p]] for p in s) for s in paths])
        weight = np.exp(weight - np.logaddexp.reduce(weight))
        want = sum(np.bincount([lattice.rank[p] for p in s], minlength=len(every))[:, None] * w for s, w in zip(paths, weight))
        pieces, counts = lattice.expected_one(word, score)
        found = np.zeros_like(score)
        found[pieces] = counts
        assert found == pytest.approx(want)


def test_long_words_shape_the_scores(spark):
    words = [b"q" * 60, b"short"]
    frame = spark.createDataFrame([(w, [1, 0]) for w in words], "word binary, c array<long>")
    path = P.path("piece_bpe_32k.model")
    lattice = lattice_lm.lattice_of(path)
    scores = lattice_lm.estimate(lattice, np.zeros((len(lattice.pieces), 2)), np.zeros(2))
    counts = lattice_lm.expectation(frame, path, scores.piece, 2)
    size = np.fromiter(map(len, lattice.pieces), float)
    assert size @ counts == pytest.approx([sum(len(w) + 1 for w in words), 0])


def test_places_packed_either_way():
    for n in (0, 1, nbsvm.BITMAP // 4, nbsvm.BITMAP // 4 + 1, nbsvm.SIZE):
        places = np.sort(np.random.default_rng(n).permutation(nbsvm.SIZE)[:n])
        row = nbsvm.packed(places)
        assert np.array_equal(np.sort(nbsvm.unpacked(row)), places) and len(row) <= nbsvm.BITMAP


def test_classifier_against_a_plain_version():
    """Ratios by counting, the dual's optimum by its duality gap, and a score step by step."""
    rows = quality_rows(60)
    label = np.array([y for *_, y in rows])
    sets = [set(nbsvm.Indicators()(np.frombuffer(t.encode(), np.uint8)).tolist()) for _, t, _ in rows]
    packed = [nbsvm.packed(np.array(sorted(s))) for s in sets]
    counts = [Counter(p for s, y in zip(sets, label) if y == k for p in s) for k in (0, 1)]
    whole = [sum(c.values()) + nbsvm.SIZE for c in counts]
    ratio = nbsvm.log_count_ratio(packed, label)
    for p in set().union(*sets):
        assert ratio[p] == pytest.approx(math.log((counts[1][p] + 1) / whole[1]) - math.log((counts[0][p] + 1) / whole[0]))

    values = np.zeros((len(rows), nbsvm.SIZE))
    for x, s in zip(values, sets):
        at = sorted(s)
        x[at] = ratio[at] / math.sqrt(sum(ratio[p] ** 2 for p in at))
    sign, cost = np.where(label == 1, 1.0, -1.0), 1.0
    z, bias, alpha = nbsvm.dual_descent(packed, ratio**2, label, cost, epochs=400, least=1e-9)
    w = (alpha * sign) @ values
    assert z == pytest.approx(w * ratio) and bias == pytest.approx((alpha * sign).sum())
    primal = 0.5 * (w @ w + bias**2) + cost * np.maximum(0, 1 - sign * (values @ w + bias)).sum()
    dual = alpha.sum() - 0.5 * (w @ w + bias**2)
    assert alpha.min() >= 0 and alpha.max() <= cost and 0 <= primal - dual < 1e-4 * primal

    model = nbsvm.fit(packed, label)
    for s, row in zip(sets, packed):
        at = sorted(s)
        margin = sum(model.weights[p] for p in at) / math.sqrt(sum(ratio[p] ** 2 for p in at)) + model.bias
        assert model.margin(nbsvm.unpacked(row)) == pytest.approx(margin)
        assert model.score(margin) == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.offset))))


def test_every_place_of_long_texts_fits():
    """Texts that hold all places take a bit for each; a model is fitted to them."""
    rng = np.random.default_rng(3)
    long = [nbsvm.packed(np.flatnonzero(rng.random(nbsvm.SIZE) < 0.9)) for _ in range(40)]
    assert sum(map(len, long)) <= 40 * nbsvm.BITMAP
    model = nbsvm.fit(long, np.arange(40) % 2)
    assert np.isfinite(model.weights).all() and np.isfinite(model.slope)
