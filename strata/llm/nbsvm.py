"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of its byte n-grams of 2 to 4 bytes, hashed to ``2 ** BITS`` places, and of word n-grams that are
one word n times, which have places of their own for the n in ``RUNS``.  Each indicator is scaled
by the smoothed log-count ratio of its place between the classes, rows are brought to length 1, and a linear model with hinge
loss is fitted by dual coordinate descent.  Margins become scores through a logistic curve fitted to margins from models that have not
seen the row's fold; the model itself is fitted to all rows.

The model is fitted on at most ``max_rows`` labelled rows (the first by a hash of the key), whose indicators meet in one task: as places
or, where that is less, as a bit for each place, so a row takes 33 kB at most and 8,000 rows 262 MB, however long their texts
are.  The driver only gets the model, whose size is fixed.  Every text is scored as a whole.

Defined results: null text counts as empty, whose score comes from the bias alone; a key with several texts or labels trains with
the least text and label; without both classes among the labelled rows every score is their smoothed share; an empty table
gives no rows; null labels do not train; ``score`` replaces columns of the names ``score`` and ``predicted``, other columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import columns, give_back, leaving_none, text_buffer

BITS = 18
FOLDS = 3
RUNS = (2, 3, 4, 6, 8, 12, 20)
SIZE = (1 << BITS) + len(RUNS)
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def _power(base: np.uint64, n: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), int(n), 1 << 64))


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Indicators:
    """Distinct feature places of byte strings."""

    def __init__(self):
        self.stamp = np.zeros(SIZE, np.int64)
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def longest_run(self, data: np.ndarray) -> int:
        """The most times in a row that a word occurs, by hashes of words from running sums."""
        edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8)))
        start, stop = edge[::2], edge[1::2]
        if len(start) < 2:
            return len(start)
        while len(self.powers) <= len(data):
            n = np.uint64(len(self.powers))
            self.powers = np.concatenate([self.powers, self.powers * _power(_BASE, n)])
            self.inverse = np.concatenate([self.inverse, self.inverse * _power(_INVERSE, n)])
        total = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)]))
        word = (total[stop] - total[start]) * self.inverse[start]
        breaks = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1], [True]]))
        return int(np.diff(breaks).max())

    def __call__(self, data: np.ndarray) -> np.ndarray:
        out = []
        wide = data.astype(np.uint32)
        for n in (2, 3, 4):
            m = len(wide) - n + 1
            if m <= 0:
                break
            h = np.full(m, np.uint32(n * 0x01000193), np.uint32)
            for k in range(n):
                h = (h ^ wide[k : k + m]) * _FACTORS[k]
                h ^= h >> np.uint32(15)
            at = (h >> np.uint32(32 - BITS)).astype(np.int64)
            order = np.arange(m)
            self.stamp[at] = order
            out.append(at[self.stamp[at] == order])
        run = self.longest_run(data)
        out.append(np.array([(1 << BITS) + k for k, n in enumerate(RUNS) if run >= n], np.int64))
        found = np.concatenate(out)
        order = np.arange(len(found))
        self.stamp[found] = order
        return found[self.stamp[found] == order]


BITMAP = -(-SIZE // 8)


def packed(places: np.ndarray) -> bytes:
    """Places as 32-bit numbers, or as a bit for each place (``BITMAP`` bytes) if that is less."""
    if 4 * len(places) < BITMAP:
        return places.astype("<u4").tobytes()
    bits = np.zeros(8 * BITMAP, np.uint8)
    bits[places] = 1
    return np.packbits(bits).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.flatnonzero(np.unpackbits(raw)) if len(raw) == BITMAP else raw.view("<u4")


@dataclass
class Model:
    weights: np.ndarray  #: of the places, the ratio included, before a row is brought to length 1
    squares: np.ndarray  #: of the ratios
    bias: float
    slope: float
    offset: float

    def packed(self) -> bytes:
        return np.concatenate([[self.bias, self.slope, self.offset], self.weights, self.squares]).astype("<f8").tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Model:
        x = np.frombuffer(data, "<f8")
        return cls(x[3 : 3 + SIZE], x[3 + SIZE :], *map(float, x[:3]))

    def margin(self, places: np.ndarray) -> float:
        size = np.sqrt(self.squares[places].sum())
        return float(self.weights[places].sum() / size if size else 0.0) + self.bias

    def score(self, margin):
        return 1.0 / (1.0 + np.exp(np.clip(-(self.slope * np.asarray(margin) + self.offset), -50, 50)))


def log_count_ratio(rows: list[bytes], label: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = [np.full(SIZE, smoothing), np.full(SIZE, smoothing)]
    for row, y in zip(rows, label):
        counts[int(y)][unpacked(row)] += 1
    p, q = counts[1] / counts[1].sum(), counts[0] / counts[0].sum()
    return np.log(p / q)


def dual_descent(rows: list[bytes], square: np.ndarray, label: np.ndarray, cost: float, epochs: int = 10, seed: int = 1, least: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights x ratios, bias, dual variables) of the linear hinge-loss model over rows of length 1, with the bias as one more feature of value 1.

    ``square``: squared ratios.  A row's value at a place is its ratio over the row's norm, so neither values nor weights need to be held
    apart: with z = weight x ratio a margin is the sum of z over the row's norm, and a step moves z by the squared ratios.
    """
    z, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    sign = np.where(label == 1, 1.0, -1.0)
    norm = np.sqrt([square[unpacked(r)].sum() for r in rows])
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        most = 0.0
        for i in order:
            at, size = unpacked(rows[i]), norm[i] or 1.0
            gradient = sign[i] * (z[at].sum() / size + bias) - 1.0
            new = min(max(alpha[i] - gradient / (1.0 + (norm[i] > 0)), 0.0), cost)
            step = new - alpha[i]
            if step:
                alpha[i] = new
                z[at] += step * sign[i] / size * square[at]
                bias += step * sign[i]
                most = max(most, abs(step))
        if most < least:
            break
    return z, bias, alpha


def calibrate(margin: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic curve with smoothed targets, by Newton's method."""
    n1, n0 = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(-(x @ theta), -50, 50)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p) - 1e-4 * (theta - [1.0, 0.0]))
        theta += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: list[bytes], label: np.ndarray, cost: float = 1.0) -> Model:
    """``rows``: packed distinct places of each text; ``label``: 0 or 1."""
    n1 = int(label.sum())
    if not 0 < n1 < len(label):
        share = (n1 + 1) / (len(label) + 2)
        return Model(np.zeros(SIZE), np.ones(SIZE), 0.0, 1.0, float(np.log(share / (1 - share))))
    fold = np.arange(len(rows)) % FOLDS
    margin = np.zeros(len(rows))
    for k in range(FOLDS):
        part = [r for r, f in zip(rows, fold) if f != k]
        own = _fit(part, label[fold != k], cost) if 0 < label[fold != k].sum() < len(part) else None
        for i in np.flatnonzero(fold == k).tolist():
            margin[i] = own.margin(unpacked(rows[i])) if own else 0.0
    model = _fit(rows, label, cost)
    model.slope, model.offset = calibrate(margin, label)
    return model


def _fit(rows: list[bytes], label: np.ndarray, cost: float) -> Model:
    square = log_count_ratio(rows, label) ** 2
    z, bias, _ = dual_descent(rows, square, label, cost)
    return Model(z, square, bias, 1.0, 0.0)


def held_out(key: str = "doc_id", of: int = 4, rest: int = 2):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % of == rest, F.lit(False))


def indicator_rows(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(places binary, ...): packed distinct feature places of each text."""

    def run(batches):
        find = Indicators()
        for batch in batches:
            data, offsets = text_buffer(columns(batch, text)[0])
            rows = [packed(find(data[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *columns(batch, *keep)], ["places", *keep])

    kinds = dict(docs.dtypes)
    return docs.select(text, *keep).mapInArrow(leaving_none(run), ", ".join(["places binary", *(f"`{k}` {kinds[k]}" for k in keep)]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 8_000, text: str = "text", key: str = "doc_id") -> Model:
    """A model from the labelled rows that are not held out, ``max_rows`` of them at most."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_key")).agg(F.min(label).cast("int").alias("_label"))
    chosen = F.broadcast(usable.orderBy(F.xxhash64("_key"), "_key").limit(max_rows))  # at most max_rows keys and labels
    marked = docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text")).join(chosen, "_key").groupBy("_key", "_label").agg(F.min("_text").alias("_text"))
    rows = indicator_rows(marked, "_text", ("_key", "_label")).repartition(1)  # at most max_rows of 33 kB at most

    def run(batches):
        held = [r for batch in batches for r in zip(*(c.to_pylist() for c in columns(batch, "_key", "_label", "places")))]
        held.sort(key=lambda r: r[:2])
        yield pa.RecordBatch.from_arrays([pa.array([fit([r for *_, r in held], np.array([y for _, y, _ in held], int)).packed()], pa.binary())], ["model"])

    found = rows.mapInArrow(leaving_none(run), "model binary").first()
    return Model.unpacked(bytes(found.model)) if found else fit([], np.zeros(0, int))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` with ``score`` and ``predicted`` after them."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.squares.astype(np.float32), model.bias, model.slope, model.offset))

    @F.pandas_udf("double")
    def scored(texts):
        own, find = Model(*held.value), Indicators()
        data, offsets = text_buffer(pa.Array.from_pandas(texts, type=pa.large_string()))
        margins = [own.margin(find(data[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        out = texts.__class__(own.score(np.array(margins)))
        del data, offsets
        give_back()
        return out

    return docs.withColumn("score", scored(F.coalesce(text, F.lit("")))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, max_rows: int = 8_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) of every document."""
    model = train(docs, labels, label, max_rows, text, key)
    return score(docs.select(key, text), model, threshold, text, key).select(key, held_out(key).alias("held_out"), "score", "predicted")
