"""Language-model scoring by subword lattices.

A word's subword probability sums over all its segmentations into pieces of an existing vocabulary: a forward recursion over
the word's bytes in log space.  Pieces that begin a word and pieces within one (or the word's end) have a distribution each.

``lattice_score`` is that marginal by the scores in the vocabulary's file alone.  A unigram model's scores are logarithms of
probabilities and taken as they are; a BPE model's scores count merges (whole numbers, 0 for the first), and a piece of score s
weighs 1 / (10 - s), as frequencies fall with ranks.  Pieces that no lower-cased word can hold are left out.

``score`` is the model that learns from the corpus.  The file's weights are the prior (with ``strength``) of an expectation maximisation
over the distinct training words, ``rounds`` times; and each word seen in training is one more edge of the lattice, over the whole
word: seen c times it has its discounted relative frequency there, and the discount's mass goes to the pieces.  All of that
is kept for each class of training documents (their languages, and one for documents without; with ``max_classes`` only the most frequent ones are classes of their own, which bounds the
tables where a column holds more than languages),
and a text's probability is the mixture over classes of the product over its words and its end; so nothing but the text enters a score.

Words are lower-cased (A-Z) runs of bytes other than ASCII white space.  All counts cover the whole corpus.  A lattice is run once
for each distinct word.  Documents look up the ``hot_words`` most frequent words or fewer in a broadcast table, whose size that
bounds, as words above 64 bytes go by a 128-bit digest there; their other words are joined with the word table, where none
is frequent, so that no join key is hot.

Defined results: null text counts as empty (the end alone); every row is scored by itself, equal keys or not; without training
documents every word is unknown and the scores are those of the vocabulary alone; an empty table gives no rows; a null key is
training; texts and words of any length count whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import columns, discard, gathered, materialise
from strata.llm.nbsvm import held_out

#: Words up to so many bytes take the recursion together; longer ones take it alone.
TOGETHER = 48
BATCH = 20_000
#: Bytes that no lower-cased word holds.
_ABSENT = b" \t\n\r\x0b\x0cABCDEFGHIJKLMNOPQRSTUVWXYZ"
_B = np.uint64(0x100000001B3)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> dict[bytes, float]:
    """Pieces of a sentencepiece model, as bytes, and their weights by its scores; a leading blank marks those that begin a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    score = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i).replace(chr(0x2581), " ").encode()
        if piece[1:].translate(None, _ABSENT) == piece[1:] and piece[:1].translate(None, _ABSENT[1:]) == piece[:1]:
            score[piece] = model.get_score(i)
    merges = all(s == int(s) for s in score.values())
    return {p: 1 / (10 - s) if merges else math.exp(s) for p, s in score.items()}


def name_of(word: bytes) -> bytes:
    """What a word is looked up by: itself, or above 64 bytes a digest after a byte that no text holds."""
    return word if len(word) <= 64 else b"\xff" + hashlib.blake2b(word, digest_size=16).digest()


class Lattice:
    """The vocabulary as a hashed trie: its nodes are the prefixes of pieces, the blank, and every byte that a word can hold.
    ``weights``: of pieces; those added here weigh as little as the least."""

    def __init__(self, weights: dict[bytes, float]):
        least = min(weights.values(), default=1.0)
        weights = weights | {p: least for b in range(256) if (p := bytes([b])) not in weights and (b == 32 or b not in _ABSENT)}
        pieces, self.weight = list(weights), np.array(list(weights.values()))
        self.rank = {p: k for k, p in enumerate(pieces)}
        nodes = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)})
        self.node_piece = np.array([self.rank.get(p, -1) for p in nodes])
        self.pieces, self.begins = pieces, np.array([p[:1] == b" " for p in pieces])
        self.bits = max(10, (4 * len(nodes)).bit_length())
        self.keys, self.nodes = np.zeros((1 << self.bits) + 64, np.uint64), np.full((1 << self.bits) + 64, -1, np.int32)
        for k, p in enumerate(nodes):
            key = self._key(p)
            at = int(self._slot(np.array([key], np.uint64))[0])
            while self.nodes[at] >= 0:
                if self.keys[at] == key:
                    raise ValueError("two prefixes share a key")
                at += 1
            self.keys[at], self.nodes[at] = key, k

    @staticmethod
    def _key(p: bytes) -> np.uint64:
        h = 0
        for b in p:
            h = (h * int(_B) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return np.uint64(h)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Nodes of keys, -1 for none."""
        at = self._slot(key)
        out = np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            node = self.nodes[at]
            hit = (node >= 0) & (self.keys[at] == key[todo])
            out[todo[hit]] = node[hit]
            on = (node >= 0) & ~hit
            todo, at = todo[on], at[on] + 1
        return out

    def edges(self, words: np.ndarray):
        """For words of one length (a row of bytes each, with the leading blank): (from, to, rows, pieces) of all edges, by start."""
        n, size = words.shape
        for i in range(size):
            rows, key = np.arange(n), np.zeros(n, np.uint64)
            for j in range(i, size):
                key = key * _B + words[rows, j].astype(np.uint64) + np.uint64(1)
                node = self.find(key)
                live = node >= 0
                rows, key, node = rows[live], key[live], node[live]
                if not len(rows):
                    break
                piece = self.node_piece[node]
                full = piece >= 0
                if full.any():
                    yield i, j + 1, rows[full], piece[full]

    def forward(self, words: np.ndarray, score: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Log probability of each word's bytes in each class; ``score``: pieces x classes.  ``keep`` gets alphas and edges."""
        n, size = words.shape
        alpha = np.full((size + 1, n, score.shape[1]), -np.inf)
        alpha[0] = 0.0
        kept = []
        for i, j, rows, piece in self.edges(words):
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + score[piece])
            kept.append((i, j, rows, piece))
        if keep is not None:
            keep += [alpha, kept]
        return alpha[size]

    def expected(self, words: np.ndarray, score: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and their expected counts in each class over the words, by the backward recursion."""
        keep: list = []
        total = self.forward(words, score, keep)
        alpha, kept = keep
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0.0
        pieces, counts = [], []
        for i, j, rows, piece in reversed(kept):
            step = score[piece] + beta[j, rows]
            beta[i, rows] = np.logaddexp(beta[i, rows], step)
            pieces.append(piece)
            counts.append(np.exp(alpha[i, rows] + step - total[rows]) * weight[rows])
        return np.concatenate(pieces), np.concatenate(counts)

    def forward_one(self, word: bytes, score: np.ndarray) -> np.ndarray:
        """The same for one word of any length, holding only as many alphas as the longest piece needs."""
        longest = max(map(len, self.pieces))
        alpha = {0: np.zeros(score.shape[1])}
        for i in range(len(word)):
            now = alpha.pop(i, None)
            if now is None:
                continue
            for j in range(i + 1, min(len(word), i + longest) + 1):
                k = self.rank.get(word[i:j])
                if k is not None:
                    alpha[j] = np.logaddexp(alpha[j], now + score[k]) if j in alpha else now + score[k]
        return alpha[len(word)]

    def expected_one(self, word: bytes, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and their expected counts in each class for one word of any length; betas only as far as the longest piece reaches."""
        longest, n = max(map(len, self.pieces)), len(word)
        found = lambda i: ((j, k) for j in range(i + 1, min(n, i + longest) + 1) if (k := self.rank.get(word[i:j])) is not None)
        alpha = np.full((n + 1, score.shape[1]), -np.inf)
        alpha[0] = 0.0
        for i in range(n):
            for j, k in found(i):
                alpha[j] = np.logaddexp(alpha[j], alpha[i] + score[k])
        beta, counts = {n: np.zeros(score.shape[1])}, {}
        for i in range(n - 1, -1, -1):
            beta[i] = np.full(score.shape[1], -np.inf)
            for j, k in found(i):
                step = score[k] + beta[j]
                beta[i] = np.logaddexp(beta[i], step)
                counts[k] = counts.get(k, 0.0) + np.exp(alpha[i] + step - alpha[n])
            beta.pop(i + longest, None)
        return np.array(list(counts)), np.array(list(counts.values()))


@functools.cache
def lattice_of(path: str) -> Lattice:
    """One for each worker process and vocabulary."""
    return Lattice(vocabulary(path))


def by_length(words: list[bytes]):
    """(indices, matrix of bytes with a leading blank) of words by length; None for the matrix of longer ones."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        for a in range(0, len(at), BATCH):
            some = at[a : a + BATCH]
            yield some, None if n > TOGETHER else np.frombuffer(b"".join(b" " + words[k] for k in some), np.uint8).reshape(len(some), n + 1)


@dataclass
class Scores:
    """Log probabilities: of pieces (beginning ones among themselves, inner ones together with the word's end), and of that end."""

    piece: np.ndarray
    stop: np.ndarray


def estimate(lattice: Lattice, counts: np.ndarray, ends: np.ndarray, strength: float = 30.0) -> Scores:
    """Scores from expected counts (pieces x classes), drawn towards the vocabulary's weights; these alone where counts are 0."""
    prior = lattice.weight
    out = np.zeros_like(counts)
    b = lattice.begins
    for mask, more in ((b, 0.0), (~b, 1.0)):
        share = prior[mask] / prior[mask].sum()
        mass = counts[mask] + strength * share[:, None]
        whole = mass.sum(0) + more * (ends + strength / 4)
        out[mask] = np.log(mass / whole)
    inner = counts[~b].sum(0) + strength
    return Scores(out, np.log((ends + strength / 4) / (inner + ends + strength / 4)))


def count_words(docs: DataFrame, n_classes: int, text: str, class_column: str, flush: int = 400_000) -> DataFrame:
    """(word binary, n_all, c array<long>): occurrences in all texts and in the training texts of each class; class -1: none."""

    def run(batches):
        held: dict[int, Counter] = {k: Counter() for k in range(-1, n_classes)}

        def out():
            for k, c in held.items():
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(np.full(len(c), k, np.int32)), pa.array(list(c.values()), pa.int64())], ["word", "k", "n"])
                    c.clear()

        for batch in batches:
            texts, kinds = columns(batch, text, class_column)
            for t, k in zip(texts, kinds.to_pylist()):
                held[k].update((t.as_py() or "").encode().lower().split())
                if sum(map(len, held.values())) > flush:
                    yield from out()
        yield from out()

    rows = docs.select(text, class_column).mapInArrow(run, "word binary, k int, n long")
    per = [F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(n_classes)]
    return rows.groupBy("word").agg(F.sum("n").alias("n_all"), *per).select("word", "n_all", F.array(*[f"c{k}" for k in range(n_classes)]).alias("c"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def expectation(words: DataFrame, vocabulary_path: str, score: np.ndarray, n_classes: int) -> np.ndarray:
    """Expected piece counts over the distinct training words (each once for each class that has it): pieces x classes."""
    held = words.sparkSession.sparkContext.broadcast(score)

    def run(batches):
        lattice = lattice_of(vocabulary_path)
        total = np.zeros_like(held.value)
        for batch in gathered(batches, 100_000):
            some, counts = columns(batch, "word", "c")
            seen = _matrix(counts, n_classes) > 0
            raw = some.to_pylist()
            for at, matrix in by_length(raw):
                for x in at.tolist() if matrix is None else ():
                    there = np.flatnonzero(seen[x])
                    piece, count = lattice.expected_one(b" " + raw[x], held.value[:, there])
                    total[piece[:, None], there] += count
                for k in range(n_classes if matrix is not None else 0):
                    there = matrix[seen[at, k]]
                    if len(there):
                        piece, count = lattice.expected(there, held.value[:, k : k + 1], np.ones((len(there), 1)))
                        total[:, k] += np.bincount(piece, count[:, 0], len(total))
        used = np.flatnonzero(total.sum(1) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, k]) for k in range(n_classes))], ["piece", *(f"e{k}" for k in range(n_classes))])

    rows = words.filter(F.exists("c", lambda x: x > 0)).select("word", "c").mapInArrow(run, "piece long, " + ", ".join(f"e{k} double" for k in range(n_classes)))
    out = np.zeros_like(score)
    for r in rows.groupBy("piece").agg(*(F.sum(f"e{k}") for k in range(n_classes))).collect():  # a row for each piece of the vocabulary
        out[r[0]] = r[1:]
    return out


def score_documents(docs: DataFrame, vocabulary_path: str, class_by: str | None = "lang", of: int = 7, rest: int = 2, max_classes: int | None = None, rounds: int = 3,
                    hot_words: int = 200_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score)."""
    spark = docs.sparkSession
    held = held_out(key, of, rest)
    label = F.col(class_by).cast("string") if class_by and class_by in docs.columns else F.lit(None).cast("string")
    marked = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), held.alias("_held"), label.alias("_label"))
    labels = marked.filter("not _held and _label is not null").groupBy("_label").count().orderBy(F.desc("count"), "_label")
    found = [r["_label"] for r in (labels if max_classes is None else labels.limit(max_classes)).collect()]  # a row for each class
    k = len(found) + 1
    number = F.lit(k - 1)
    for i, name in enumerate(found):
        number = F.when(F.col("_label") == name, i).otherwise(number)
    marked = marked.withColumn("_class", F.when(F.col("_held"), -1).otherwise(number).cast("int"))
    ends = np.zeros(k)
    for r in marked.filter("not _held").groupBy("_class").count().collect():  # a row for each class
        ends[r["_class"]] = r["count"]
    if k > 1 and not ends[-1]:
        k, ends = k - 1, ends[:-1]  # no document is left for the last class

    words = materialise(count_words(marked, k, "_text", "_class"), "words")
    each = lambda f: [f(F.col("c")[i]).alias(f"x{i}") for i in range(k)]
    tokens = np.array(list(words.agg(*each(lambda c: F.coalesce(F.sum(c), F.lit(0)))).first()), float)
    types, once, twice = (np.array(list(words.agg(*each(f)).first()), float) for f in (lambda c: F.count_if(c > 0), lambda c: F.count_if(c == 1), lambda c: F.count_if(c == 2)))
    v_all = words.filter(F.exists("c", lambda x: x > 0)).count() + (1 if ends.sum() else 0)
    n_all = int(tokens.sum() + ends.sum())
    discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)

    lattice = lattice_of(vocabulary_path)
    scores = estimate(lattice, np.zeros((len(lattice.pieces), k)), np.zeros(k))
    given = Scores(scores.piece[:, :1], scores.stop[:1])
    for _ in range(rounds if n_all else 0):
        scores = estimate(lattice, expectation(words, vocabulary_path, scores.piece, k), types)

    end = (ends + 0.5) / (ends + tokens + 1)
    with np.errstate(divide="ignore"):
        back = np.log(np.where(tokens > 0, discount * types / np.maximum(tokens, 1), 1.0)) + np.log1p(-end) + scores.stop
        seen = np.log1p(-end) - np.log(np.maximum(tokens, 1))
    base_of = lambda c: np.log10((c + 1) / (n_all + v_all + 1))
    end_all = (ends.sum() + 0.5) / (ends.sum() + tokens.sum() + 1)
    parts = spark.sparkContext.broadcast((np.hstack([scores.piece, given.piece]), back, seen, discount, given.stop + np.log1p(-end_all)))

    def price(batches):
        lattice = lattice_of(vocabulary_path)
        piece, back, seen, discount, more = parts.value
        for batch in gathered(batches, 100_000):
            some, counts = columns(batch, "word", "c")
            raw, c = some.to_pylist(), _matrix(counts, k).astype(float)
            sub = np.empty((len(raw), k + 1))
            for at, matrix in by_length(raw):
                if matrix is not None:
                    sub[at] = lattice.forward(matrix, piece)
                else:
                    for i in at.tolist():
                        sub[i] = lattice.forward_one(b" " + raw[i], piece)
            with np.errstate(divide="ignore"):
                log10 = np.hstack([np.logaddexp(np.log(np.maximum(c - discount, 0)) + seen, sub[:, :k] + back), sub[:, k:] + more]) / math.log(10)
            whole = c.sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(list(map(name_of, raw)), pa.binary()), columns(batch, "n_all")[0], pa.array(whole > 0), pa.array(base_of(whole)), *(pa.array(log10[:, i]) for i in range(k + 1))], ["word", "n_all", "known", "base", *names])

    names = [*(f"p{i}" for i in range(k)), "given"]
    doubles = ", ".join(f"{p} double" for p in names)
    priced = materialise(words.mapInArrow(price, f"word binary, n_all long, known boolean, base double, {doubles}"), "priced")
    discard(words)

    level = F.floor(F.log2(F.col("n_all").cast("double")) * 16)
    above, least = 0, math.inf
    for r in sorted(priced.groupBy(level.alias("l")).count().collect(), key=lambda r: -r.l):  # some hundred rows
        above += r["count"]
        if above > hot_words:
            break
        least = r.l
    is_hot = level >= least if least < math.inf else F.lit(False)
    table = priced.filter(is_hot).collect()  # hot_words rows at most
    hot = spark.sparkContext.broadcast(({bytes(r.word): i for i, r in enumerate(table)}, np.array([[r.known, r.base, *(r[p] for p in names)] for r in table], float).reshape(-1, 3 + k)))

    def look_up(batches):
        index, values = hot.value
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, flags, texts = columns(batch, "_key", "_held", "_text")
            sums, tail, sizes = np.zeros((len(keys), 3 + k)), [], np.zeros(len(keys), np.int64)
            for d, t in enumerate(texts):
                counts = Counter((t.as_py() or "").encode().lower().split())
                known_as = list(map(name_of, counts))
                at = np.fromiter((index.get(w, -1) for w in known_as), np.int64, len(counts))
                n = np.fromiter(counts.values(), np.float64, len(counts))
                sizes[d] = n.sum()
                known = at >= 0
                sums[d] = n[known] @ values[at[known]]
                tail.append([(w, int(m)) for w, m, h in zip(known_as, n, known) if not h])
            rows = np.arange(row, row + len(keys)) + (task << 36)
            row += len(keys)
            lengths = pa.array(np.append(0, np.cumsum([len(x) for x in tail])), pa.int32())
            flat = [x for some in tail for x in some]
            lists = pa.ListArray.from_arrays(lengths, pa.StructArray.from_arrays([pa.array([w for w, _ in flat], pa.binary()), pa.array([m for _, m in flat], pa.int64())], ["word", "n"]))
            yield pa.RecordBatch.from_arrays([pa.array(rows), keys, flags, pa.array(sizes + 1), *(pa.array(sums[:, i]) for i in range(3 + k)), lists], ["_row", "_key", "_held", "n_tokens", "known", "base", *names, "tail"])

    kind = docs.schema[key].dataType.simpleString()
    looked = materialise(marked.select("_key", "_held", "_text").mapInArrow(look_up, f"_row long, _key {kind}, _held boolean, n_tokens long, known double, base double, {doubles}, tail array<struct<word:binary,n:long>>"), "looked")
    rest_of = looked.select("_row", F.explode("tail").alias("t")).select("_row", "t.word", F.col("t.n").alias("n"))
    sums = ["known", "base", *names]
    joined = rest_of.join(priced.filter(~is_hot), "word").groupBy("_row").agg(*(F.sum(F.col("n") * F.col(s).cast("double")).alias(f"t_{s}") for s in sums))
    full = looked.join(joined, "_row", "left").select("_key", "_held", "n_tokens", *((F.col(s) + F.coalesce(F.col(f"t_{s}"), F.lit(0.0))).alias(s) for s in sums))
    share = np.log10(np.maximum(ends, 1e-300) / max(ends.sum(), 1)) if ends.sum() else np.zeros(k)
    logs = [F.col(p) + F.lit(float(share[i] + np.log10(end[i]))) for i, p in enumerate(names[:k]) if ends[i] or not ends.sum()]
    most = F.greatest(*logs) if len(logs) > 1 else logs[0]
    mixed = most + F.log10(sum((F.pow(F.lit(10.0), x - most) for x in logs), F.lit(0.0)))
    return full.select(
        F.col("_key").alias(key), F.col("_held").alias("held_out"), "n_tokens", (F.col("known").cast("long") + (1 if ends.sum() else 0)).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + float(base_of(ends.sum()))).alias("base_score"), mixed.alias("score"),
        (F.col("given") + float(np.log10(end_all))).alias("lattice_score"))
