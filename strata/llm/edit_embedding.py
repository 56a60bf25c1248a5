"""Document fingerprints by a randomised edit embedding.

All texts share one source of random bits h(j, c) for output places j and characters c.  A walk over a text writes its current
character at place j and goes on to the next character if h(j, c) is 1, else stays; so texts at a small edit distance
soon walk in step again after an edit, and their outputs differ in few places.  A character that is entered at place j is left after
the first place from j on with a 1 for it: these distances are tabulated, so that a walk takes one step for each character, and
steps of all documents of a block are taken together.

Only sampled places of the output are kept, as four hashed bits of the character there: every place up to 32, then 32
stratified places in each octave.  The sample is the same for all texts and covers a text of any length evenly by weight; the
likeness of two fingerprints is the weighted share of sampled places with equal digits, up to the longer one's end.  Bands are
groups of consecutive samples of an octave; texts that share a band are candidates, and likeness verifies them (``near_groups``).
A pair of near texts is found only if they share a band, so recall is measured (README).

Defined results: null text counts as empty, its fingerprint is ``0:``; two empty texts have likeness 1, an empty and
another text 0; documents with equal keys are ordered by text; a null key counts as the least; a single document is its own next
one; an empty table gives no rows; ``compare_edited`` orders by an integer key and raises TypeError for another, ``near_groups`` takes any
key, and a group of rows without keys has none; texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import columns, discard, key_ranges, leaving_none, materialise, range_index, spread_join
from strata.llm.components import Forest, connected_components

PERIOD, CLASSES, DENSE, NONE = 8192, 256, 32, 16
#: Output places up to which sample counts are tabulated; beyond, they are searched for.
TABLE = 1 << 21
#: Groups of up to ``FEW`` fingerprints are compared pair by pair for a whole lot of ``LOT`` rows or somewhat more at once.
FEW, LOT = 48, 16_384


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)


@functools.cache
def shared(seed: int = 7):
    """Distances to the next 1, sampled places, their weights' running sums, and the number of samples below each place."""
    rng = np.random.default_rng(seed)
    bits = rng.integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    twice = np.concatenate([bits, bits], axis=1)
    gap = np.zeros((CLASSES, 2 * PERIOD + 1), np.int64)
    gap[:, -1] = PERIOD
    for j in range(2 * PERIOD - 1, -1, -1):
        gap[:, j] = np.where(twice[:, j], 1, gap[:, j + 1] + 1)
    places, weights = [np.arange(DENSE)], [np.ones(DENSE)]
    for octave in range(34):
        width = 1 << octave
        places.append(DENSE * width + np.arange(DENSE) * width + rng.integers(0, width, DENSE))
        weights.append(np.full(DENSE, float(width)))
    places = np.concatenate(places)
    below = np.searchsorted(places, np.arange(TABLE + 1)).astype(np.int16)
    return np.ascontiguousarray(gap[:, :PERIOD]).astype(np.uint8).ravel(), places, np.append(0, np.cumsum(np.concatenate(weights))), below


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Block:
    """Texts whose walks are taken together."""

    STEPS = 64

    def __init__(self, texts: list[str], seed: int = 7):
        self.gap, self.places, self.running, self.below = shared(seed)
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.length) - self.length
        points = code_points("".join(texts))
        kinds = np.where(points < CLASSES, points, _mix(points) & np.uint64(CLASSES - 1)).astype(np.int64)
        self.row = (kinds * PERIOD).astype(np.int32)
        self.digit = (_mix(points + np.uint64(1 << 33)) & np.uint64(15)).astype(np.uint8)

    def samples_below(self, j: np.ndarray) -> np.ndarray:
        if not j.size or j.max() <= TABLE:
            return self.below[j]
        return np.searchsorted(self.places, j)

    def walk(self, start: np.ndarray, length: np.ndarray, entered: np.ndarray, marks: np.ndarray | None = None):
        """Digits (a row for each walk, NONE where it has none), the place after each walk's end, and the place at which the
        character number ``marks`` is entered.  ``entered``: the place at which a walk begins."""
        order = np.argsort(-length, kind="stable")
        start, length, j = start[order], length[order], entered[order].astype(np.int64)
        mark = marks[order] if marks is not None else None
        at_mark = j.copy()
        n = len(order)
        samples = int(np.searchsorted(self.places, int((j + 4 * length).max()) + 64)) if n else 0
        digits = np.full((n, samples), NONE, np.uint8)
        done = 0
        steps = np.arange(self.STEPS)
        while True:
            active = int(np.searchsorted(-length, -done, side="left"))
            if not active:
                break
            if active < 16:
                for d in range(active):
                    j[d] = self._alone(start[d] + done, length[d] - done, int(j[d]), digits, d, None if mark is None else int(mark[d]) - done, at_mark)
                break
            left = length[:active] - done
            at = start[:active, None] + (done + np.minimum(steps[None, :], left[:, None] - 1))
            rows = np.ascontiguousarray(self.row[at].T)
            J = np.empty((self.STEPS + 1, active), np.int64)
            J[0] = j[:active]
            for b in range(self.STEPS):
                slot = J[b] & (PERIOD - 1)
                slot += rows[b]
                np.add(J[b], self.gap[slot], out=J[b + 1])
            valid = np.minimum(left, self.STEPS)
            k = self.samples_below(J)
            some, who = np.nonzero((k[1:] > k[:-1]) & (steps[:, None] < valid[None, :]))
            first, number = k[some, who].astype(np.int64), (k[some + 1, who] - k[some, who]).astype(np.int64)
            value = self.digit[at[who, some]]
            within = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            which = np.repeat(first, number) + within
            digits[np.repeat(who, number), which] = np.repeat(value, number)
            if mark is not None:
                hit = np.flatnonzero((mark[:active] >= done) & (mark[:active] <= done + valid))
                at_mark[hit] = J[mark[hit] - done, hit]
            j[:active] = J[valid, np.arange(active)]
            done += self.STEPS
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        return digits[back], j[back], at_mark[back]

    def _alone(self, start: int, length: int, j: int, digits: np.ndarray, d: int, mark: int | None, at_mark: np.ndarray) -> int:
        """The rest of one walk."""
        gap, places = self.gap, self.places
        k = int(np.searchsorted(places, j))
        following, mask = int(places[k]), PERIOD - 1
        row = self.row[start : start + length].tolist()
        for i, r in enumerate(row):
            if i == mark:
                at_mark[d] = j
            j += int(gap[r + (j & mask)])
            while j > following:
                digits[d, k] = self.digit[start + i]
                k += 1
                following = int(places[k])
        if mark == length:
            at_mark[d] = j
        return j

    def likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row by row."""
        weights = np.diff(self.running)[: a.shape[1]]
        equal = ((a == b) & (a < NONE)) @ weights
        whole = self.running[np.maximum((a < NONE).sum(1), (b < NONE).sum(1))]
        return np.where(whole > 0, equal / np.maximum(whole, 1), 1.0)


_HEX = np.frombuffer(b"0123456789abcdef-", np.uint8)


def written(digits: np.ndarray, end: np.ndarray) -> list[str]:
    """Fingerprints: the output's length, a colon, and the sampled digits."""
    shown = _HEX[digits]
    return [f"{e:x}:" + row[:n].tobytes().decode() for e, n, row in zip(end.tolist(), (digits < NONE).sum(1).tolist(), shown)]


def likeness(a: str, b: str, seed: int = 7) -> float:
    """Likeness of two fingerprints."""
    x, y = (np.frombuffer(s.partition(":")[2].encode(), np.uint8) for s in (a, b))
    running = shared(seed)[2]
    n, m = min(len(x), len(y)), max(len(x), len(y))
    return float(np.diff(running)[:n] @ (x[:n] == y[:n]) / running[m]) if m else 1.0


def bands(fingerprint: str, width: int = 8) -> list[str]:
    """Band keys: their number and digits; bands without all their digits are left out, but for the first one."""
    digits = fingerprint.partition(":")[2]
    return [f"{k // width}:{digits[k : k + width]}" for k in range(0, max(1, len(digits)), width) if k + width <= len(digits) or not k]


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 7) -> DataFrame:
    """(key, fingerprint)."""

    def run(batches):
        for batch in batches:
            keys, texts = columns(batch, key, text)
            for a in range(0, len(keys), 2000):
                block = Block([x.as_py() or "" for x in texts.slice(a, 2000)], seed)
                digits, end, _ = block.walk(block.start, block.length, np.zeros(len(block.length), np.int64))
                yield pa.RecordBatch.from_arrays([keys.slice(a, 2000), pa.array(written(digits, end))], [key, "fingerprint"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint string")


def octaves(sets: list[bytes], size: np.ndarray) -> list[np.ndarray]:
    """Digits of fingerprints, two in a byte, by octave: a row of 32 for each, NONE beyond its end."""
    width = -(-int(size.max(initial=0)) // DENSE) * DENSE
    out = np.full((len(sets), width), NONE, np.uint8)
    for row, packed, n in zip(out, sets, size.tolist()):
        raw = np.frombuffer(packed, np.uint8)
        row[:n] = np.stack([raw >> 4, raw & 15], axis=1).ravel()[:n]
    return [np.ascontiguousarray(out[:, k : k + DENSE]) for k in range(0, width, DENSE)]


def digit_links(sets: list[bytes], size: np.ndarray, home: np.ndarray, label: np.ndarray, least: float, seed: int = 7, across: bool = False) -> list[tuple[int, int]]:
    """Links of at least ``least`` likeness between fingerprints, but for those that labels or other links give; with ``across`` only
    between one at ``home`` and one that is not.

    Samples of an octave weigh the same, and the octaves below weigh together what it weighs.  So equal digits are counted octave by octave from
    the shorter fingerprint's last one, and a pair is left as soon as the octaves below could not make up for what is missing, which for unrelated
    texts is after one or two; fingerprints of too different lengths are not compared at all.  Weights are powers of two, so sums are exact.
    """
    order = np.argsort(size, kind="stable")
    digits, running = [d[order] for d in octaves(sets, size)], shared(seed)[2]
    size, home, root, out = size[order], home[order], label[order].copy(), []
    whole = np.maximum(running[size], 1)
    end = np.searchsorted(whole * least, running[size], side="right")
    for x in range(len(order)):
        top = (int(size[x]) - 1) // DENSE
        apart = root[x + 1 : end[x]] != root[x]
        if across:
            apart &= home[x + 1 : end[x]] != home[x]
        other = np.flatnonzero(apart) + x + 1
        got = np.zeros(len(other))
        for k in range(top, -1, -1):
            if not len(other):
                break
            own = digits[k][x].copy()
            own[own == NONE] = NONE + 1  # the other one's digits beyond this end are no equal ones
            equal = (digits[k][other] == own).view(np.uint64)
            count = ((equal[:, 0] + equal[:, 1] + equal[:, 2] + equal[:, 3]) * np.uint64(0x0101010101010101)) >> np.uint64(56)
            got += count * (running[DENSE * k + 1] - running[DENSE * k])
            left = (got + running[DENSE * k]) / whole[other] >= least
            other, got = other[left], got[left]
        for y in other.tolist() if top >= 0 else ():
            if root[y] != root[x]:
                root[root == root[y]] = root[x]
                out.append((int(order[x]), int(order[y])))
    return out


def likely_pairs(sets: list[bytes], size: np.ndarray, x: np.ndarray, y: np.ndarray, least: float, seed: int = 7) -> np.ndarray:
    """Which pairs (x, y) have ``least`` likeness, decided as in ``digit_links``."""
    digits, running = octaves(sets, size), shared(seed)[2]
    short, long = np.where(size[x] <= size[y], x, y), np.where(size[x] <= size[y], y, x)
    whole, got, n = np.maximum(running[size[long]], 1), np.zeros(len(x)), size[short]
    alive = np.flatnonzero(running[n] / whole >= least)
    for k in range(len(digits) - 1, -1, -1):
        now = alive[n[alive] > DENSE * k]
        a, b = digits[k][short[now]], digits[k][long[now]]
        got[now] += ((a == b) & (a < NONE)).sum(axis=1) * (running[DENSE * k + 1] - running[DENSE * k])
        alive = alive[(got[alive] + running[np.minimum(DENSE * k, n[alive])]) / whole[alive] >= least]
    return alive[n[alive] > 0]


def band_links(members: DataFrame, sets: DataFrame, least: float, block: int, seed: int) -> DataFrame:
    """(a, b): links within each cluster of ``members`` (mark, cluster, n, label), where ``n`` is a cluster's size and items of one label are linked already.

    A cluster above ``block`` items is dealt into blocks, and each pair of blocks is a group, so that each pair of items is compared once.  Fingerprints,
    ``sets`` (mark, size, set), join the members on their way to the groups and are not stored with them.
    """

    def linked(lot: pa.Table) -> pa.RecordBatch:
        cluster, i, j, size = (lot.column(c).to_numpy() for c in ("cluster", "i", "j", "size"))
        label = lot.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        home, marks, packed = lot.column("home").to_numpy(), lot.column("mark").combine_chunks(), lot.column("set").to_pylist()
        first = np.flatnonzero(np.append(True, (cluster[1:] != cluster[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        end = np.append(first[1:], len(cluster))
        few = np.repeat(end - first <= FEW, end - first)
        at, stop, found = np.flatnonzero(few), np.repeat(end, end - first), [(np.zeros(0, np.int64),) * 2]
        for step in range(1, FEW):
            at = at[at + step < stop[at]]
            apart = (label[at] != label[at + step]) & ((i[at] == j[at]) | (home[at] != home[at + step]))
            found.append((at[apart], at[apart] + step))
        x, y = map(np.concatenate, zip(*found))
        kept = np.unique(np.concatenate([x, y]))
        near = likely_pairs([packed[k] for k in kept.tolist()], size[kept], np.searchsorted(kept, x), np.searchsorted(kept, y), least, seed)
        forest = Forest(len(cluster))
        forest.link(x[near], y[near])
        for a, b in zip(first.tolist(), end.tolist()):
            if b - a > FEW:
                pairs = np.array(digit_links(packed[a:b], size[a:b], home[a:b], label[a:b], least, seed, bool(i[a] != j[a])), np.int64).reshape(-1, 2) + a
                forest.link(pairs[:, 0], pairs[:, 1])
        rows = np.arange(len(cluster))
        root = forest.roots(rows)
        out = np.flatnonzero(root != rows)
        return pa.RecordBatch.from_arrays([marks.take(pa.array(out)), marks.take(pa.array(root[out]))], ["a", "b"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= LOT:
                lot = pa.Table.from_batches(held).combine_chunks()
                keys = [lot.column(c).to_numpy() for c in ("cluster", "i", "j")]
                cut = int(np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0)).max(initial=-1)) + 1  # the last group may go on
                if cut:
                    yield linked(lot.slice(0, cut).combine_chunks())
                held, n = lot.slice(cut).to_batches(), lot.num_rows - cut
        if n:
            yield linked(pa.Table.from_batches(held).combine_chunks())

    parts = F.ceil(F.col("n") / block).cast("int")
    dealt = members.select("mark", "cluster", "label", F.pmod(F.xxhash64("mark"), parts).cast("int").alias("at"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("with"))
    pairs = dealt.select("mark", "cluster", "label", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), (F.col("at") <= F.col("with")).alias("home"))
    rows = pairs.select("cluster", "i", "j", "mark", "label", "home").join(sets, "mark")
    return rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(leaving_none(run), "a binary, b binary")


def near_groups(docs: DataFrame, least: float = 0.5, width: int = 8, text: str = "text", key: str = "doc_id", seed: int = 7, block: int = 8192) -> DataFrame:
    """(key, component_id): groups of documents whose fingerprints share a band and have a likeness of ``least`` or more; the least key is a group's name.

    Equal fingerprints are one.  Each band's fingerprints are compared within the band, in blocks if there are many, but for pairs that
    are linked already; so every candidate is either linked or verified, and no band is cut.  A quarter of the bands is taken first: most near copies
    share one of those, and bands whose fingerprints are all linked then are not dealt any more.
    """
    marked = materialise(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", "key", seed), "embedded")
    distinct = materialise(marked.groupBy("fingerprint").agg(F.min("key").alias("rep")).withColumn("mark", F.unhex(F.md5("fingerprint"))), "distinct")

    def deal(batches):
        for batch in batches:
            rows = [(m, b) for m, f in zip(*(c.to_pylist() for c in batch.columns)) for b in bands(f, width)]
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in rows], pa.binary()), pa.array([b for _, b in rows], pa.string())], ["mark", "cluster"])

    dealt = distinct.select("mark", "fingerprint").mapInArrow(deal, "mark binary, cluster string")
    dealt = materialise(dealt.select("mark", F.xxhash64("cluster").alias("cluster"), (F.substring_index("cluster", ":", 1).cast("int") % 4 == 3).alias("early")), "bands")
    digits = F.substring_index("fingerprint", ":", -1)
    sets = distinct.select("mark", F.length(digits).alias("size"), F.unhex(F.concat(digits, F.when(F.length(digits) % 2 == 1, "0").otherwise(""))).alias("set"))
    near = None
    for early in (True, False):
        some, label = dealt.filter(F.col("early") == early).select("mark", "cluster"), F.col("mark")
        if near is not None:
            some, label = some.join(near.withColumnRenamed("node", "mark"), "mark", "left"), F.coalesce("root", "mark")
        some = materialise(some.select("mark", "cluster", label.alias("label")), "labelled")
        found = some.groupBy("cluster").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        sizes = materialise(found.filter("lo < hi").select("cluster", "n"), "sizes")
        members = materialise(spread_join(some, sizes, "cluster", "n", some.count()), "members")
        edges = materialise(band_links(members, sets, least, block, seed), "links")
        last, near = near, connected_components(edges if near is None else edges.unionByName(near.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        discard(some, sizes, members, edges, *([last] if last is not None else []))
    rooted = distinct.join(near.withColumnRenamed("node", "mark"), "mark", "left").select("fingerprint", "rep", F.coalesce("root", "mark").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fingerprint", "component_id")
    out = materialise(marked.join(named, "fingerprint").select(F.col("key").alias(key), "component_id"), "groups")
    discard(marked, distinct, dealt, near)
    return out


def compare_edited(docs: DataFrame, parts: int | None = None, text: str = "text", key: str = "doc_id", seed: int = 7, block_chars: int = 6_000_000) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, bands_edited, bands_next).

    Each text is compared with its edited form, in which the first code points of the next document (by descending key, the
    first one after the last) stand for its last third, and with that next document.  Texts are dealt once, by ranges of the
    key (and of the text at a tie), whose number follows the bytes of all texts; the first document of a range also goes to the end of the range before it.
    """
    spark = docs.sparkSession
    ranges = key_ranges(docs.select(key, text), key, text, parts, falling_texts=True)
    rows = docs.select(key, text, ranges.place.alias("_key"))
    part = (F.lit(len(ranges.bounds)) - range_index(F.col("_key"), ranges.bounds)).cast("int")
    heads = sorted((r.p, r.k) for r in rows.groupBy(part.alias("p")).agg(F.max("_key").alias("k")).collect())  # a row for each range
    before = spark.createDataFrame([(k, heads[n - 1][0]) for n, (_, k) in enumerate(heads)], "_key decimal(38,0), _before int")
    row = lambda p, ghost: F.struct(p.alias("part"), F.lit(ghost).alias("ghost"))
    targets = F.when(F.col("_before").isNull(), F.array(row(part, False))).otherwise(F.array(row(part, False), row(F.col("_before"), True)))
    dealt = (rows.join(F.broadcast(before), "_key", "left").withColumn("_to", F.explode(targets))
             .select(key, text, "_key", F.col("_to.part").alias("_part"), F.col("_to.ghost").alias("_ghost"))
             .repartitionById(max(1, len(heads) and heads[-1][0] + 1), F.col("_part"))
             .sortWithinPartitions("_ghost", F.desc("_key"), text).select(key, text, "_ghost"))
    kinds = dict(docs.select(key).dtypes)

    def emit(keys: list, texts: list[str], key_type) -> pa.RecordBatch:
        """``texts`` has one more than ``keys``: the next one after the last."""
        n = len(keys)
        block = Block(texts, seed)
        length, start = block.length, block.start
        cut = length - length // 3
        digits, end, entered = block.walk(start, length, np.zeros(n + 1, np.int64), cut)
        taken = np.minimum(length[:n] // 3, length[1:])
        tail, edited_end, _ = block.walk(start[1:], taken, entered[:n])
        width = max(digits.shape[1], tail.shape[1])
        wide = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=NONE)
        digits, tail = wide(digits), wide(tail)
        shared_samples = np.searchsorted(block.places, entered[:n])
        edited = np.where(np.arange(width)[None, :] < shared_samples[:, None], digits[:n], tail)
        mine, changed = written(digits, end), written(edited, edited_end)
        hashes = [hashlib.sha256((t[:c] + u[:k]).encode("utf-8", "replace")).hexdigest() for t, u, c, k in zip(texts, texts[1:], cut.tolist(), taken.tolist())]
        own = [set(bands(f)) for f in mine]
        common = ([len(o & set(bands(f))) for o, f in zip(own, changed)], [len(a & b) for a, b in zip(own, own[1:])])
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, key_type), pa.array(length[:n]), pa.array(hashes), pa.array(mine[:n]), pa.array(changed),
             pa.array(block.likeness(digits[:n], edited)), pa.array(block.likeness(digits[:n], digits[1:])), *(pa.array(c, pa.int32()) for c in common)],
            [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "bands_edited", "bands_next"])

    def run(batches: Iterator[pa.RecordBatch]):
        keys, texts, size = [], [], 0
        for batch in batches:
            key_type = batch.column(0).type
            for k, t, ghost in zip(*(c.to_pylist() for c in batch.columns)):
                t = t or ""
                if texts and (size >= block_chars or ghost):
                    yield emit(keys, [*texts, t], key_type)
                    keys, texts, size = [], [], 0
                if ghost:
                    return
                keys.append(k)
                texts.append(t)
                size += len(t)
        if texts:
            raise ValueError("the range has no following document")

    return dealt.mapInArrow(run, f"`{key}` {kinds[key]}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited int, bands_next int")
