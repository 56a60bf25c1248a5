"""Biogeographic networks of localities and genera: projection, communities, modularity, and a permutation null model."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.numeric import bin_to
from strata.operators.diversity import PLACED


def located(occ: DataFrame, width: float = 5.0, cell: float = 5.0) -> DataFrame:
    """Placed and dated occurrences with ``time_bin`` and ``locality`` (latitude and longitude of a cell)."""
    place = F.concat_ws(",", bin_to("lat", cell).cast("string"), bin_to("lng", cell).cast("string"))
    return occ.dropna(subset=list(PLACED)).withColumns({"time_bin": bin_to("mid_ma", width), "locality": place})


def bin_projection_edges(occ: DataFrame, width: float = 5.0, cell: float = 5.0) -> DataFrame:
    """Pairs of localities that share a genus in a bin (src < dst)."""
    return project(located(occ, width, cell).select("time_bin", "locality", "genus").distinct(), ["time_bin"])


def project(edges: DataFrame, by: list[str]) -> DataFrame:
    """Distinct pairs of localities with a common genus within ``by``; ``edges`` are distinct.

    Each genus is one list of its localities, of which there are no more than cells on the grid, however many occurrences it has.
    """
    lists = edges.groupBy(*by, "genus").agg(F.sort_array(F.collect_set("locality")).alias("places")).filter(F.size("places") > 1).select(*by, "places").distinct()
    left = lists.select(*by, "places", F.posexplode("places").alias("at", "src"))
    pairs = left.select(*by, "src", F.explode(F.slice("places", F.col("at") + 2, F.size("places"))).alias("dst"))
    return pairs.distinct()


def locality_network_edges(occ: DataFrame, top: int = 50, cell: float = 5.0) -> DataFrame:
    """Edges among the ``top`` localities with most occurrences, over all ages."""
    place = F.concat_ws(",", bin_to("lat", cell).cast("string"), bin_to("lng", cell).cast("string"))
    rows = occ.dropna(subset=["lat", "lng", "genus"]).select(place.alias("locality"), "genus")
    best = rows.groupBy("locality").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "locality").limit(top).select("locality")
    return project(rows.join(F.broadcast(best), "locality", "left_semi").distinct(), [])


def locality_network_nodes(occ: DataFrame, top: int = 50, cell: float = 5.0) -> DataFrame:
    """The ``top`` localities with most occurrences, those without an edge too: occurrences, centre of the cell, and edges among them."""
    rows = occ.dropna(subset=["lat", "lng", "genus"]).select(bin_to("lat", cell).alias("lat_bin"), bin_to("lng", cell).alias("lng_bin"))
    best = rows.groupBy("lat_bin", "lng_bin").agg(F.count("*").alias("occurrences"))
    best = best.withColumn("locality", F.concat_ws(",", F.col("lat_bin").cast("string"), F.col("lng_bin").cast("string"))).orderBy(F.desc("occurrences"), "locality").limit(top)
    edges = locality_network_edges(occ, top, cell)
    degree = edges.select(F.explode(F.array("src", "dst")).alias("locality")).groupBy("locality").agg(F.count("*").alias("degree"))
    return best.join(degree, "locality", "left").fillna(0, ["degree"])


#: A pair of places written for itself takes as long as so many pairs of a matrix product, squares compared.
SPARSE = 64
#: Graphs of up to so many nodes (a matrix of 8 bytes a pair), with an edge or more to ``DENSE_SHARE`` pairs, merge by a matrix.
DENSE_NODES, DENSE_SHARE = 4096, 100


def merged_by_matrix(nodes: list, near: dict[int, dict[int, float]], degree: dict[int, int], m: float) -> list[set]:
    """``communities`` with gains as a matrix, whose rows know their best partner of a higher number: the same unions in the same order."""
    n = len(nodes)
    share = np.array([degree[k] / (2 * m) for k in range(n)])
    gain = np.full((n, n), -np.inf)
    for a, held in near.items():
        b = np.fromiter(held, np.int64, len(held))
        gain[a, b] = 1 / m - 2 * share[a] * share[b]
    upper = lambda a: a + 1 + int(gain[a, a + 1 :].argmax()) if a + 1 < n else a
    partner = np.array([upper(a) for a in range(n)])
    best = gain[np.arange(n), partner]
    members = {k: {v} for k, v in enumerate(nodes)}
    while True:
        a = int(best.argmax())
        b = int(partner[a])
        if not best[a] > 0:
            return list(members.values())
        members[a] |= members.pop(b)
        mine, lost = gain[a].copy(), gain[b].copy()
        mine[[a, b]] = lost[[a, b]] = -np.inf
        here, there = mine > -np.inf, lost > -np.inf
        mine[here & ~there] -= (2 * share[b] * share)[here & ~there]
        mine[there & ~here] = lost[there & ~here] - (2 * share[a] * share)[there & ~here]
        mine[here & there] += lost[here & there]
        gain[b] = gain[:, b] = best[b] = -np.inf
        gain[a] = gain[:, a] = mine
        share[a] += share[b]
        rows = np.arange(a)  # rows below a see its new gains
        better = (mine[:a] > best[:a]) | ((mine[:a] == best[:a]) & (a < partner[:a]))
        for c in rows[~better & ((partner[:a] == a) | (partner[:a] == b)) & (best[:a] > -np.inf)].tolist():
            partner[c] = upper(c)
            best[c] = gain[c, partner[c]]
        partner[:a][better], best[:a][better] = a, mine[:a][better]
        for c in (a + 1 + np.flatnonzero((partner[a + 1 : b] == b) & (best[a + 1 : b] > -np.inf))).tolist():
            partner[c] = upper(c)
            best[c] = gain[c, partner[c]]
        partner[a] = upper(a)
        best[a] = gain[a, partner[a]]


def communities(nodes: list, edges: list[tuple]) -> list[set]:
    """Greedy modularity maximisation: the pair of linked communities whose union raises modularity most is merged, as long as
    one does; the pair with the least names at a tie."""
    degree = dict.fromkeys(range(len(nodes)), 0)
    number = {v: k for k, v in enumerate(nodes)}
    near: dict[int, dict[int, float]] = defaultdict(dict)
    for a, b in {(min(x, y), max(x, y)) for x, y in ((number[a], number[b]) for a, b in edges) if x != y}:
        near[a][b] = near[b][a] = 1.0
        degree[a] += 1
        degree[b] += 1
    m = sum(degree.values()) / 2
    if not m:
        return [{v} for v in nodes]
    if len(nodes) <= DENSE_NODES and m * DENSE_SHARE >= len(nodes) ** 2:
        return merged_by_matrix(nodes, near, degree, m)
    share = {k: d / (2 * m) for k, d in degree.items()}
    members = {k: {v} for k, v in enumerate(nodes)}
    for a in near:  # from here on, what a union of the two would add to modularity
        near[a] = {b: 1 / m - 2 * share[a] * share[b] for b in near[a]}
    queue = [(-gain, a, b) for a in near for b, gain in near[a].items() if a < b]
    heapq.heapify(queue)
    while queue:
        gain, a, b = heapq.heappop(queue)
        if near.get(a, {}).get(b) != -gain:
            continue
        if gain >= 0:
            break
        members[a] |= members.pop(b)
        lost = near.pop(b)
        for c in set(near[a]) | set(lost):
            if c in (a, b):
                continue
            both = c in near[a] and c in lost
            joint = near[a][c] + lost[c] if both else near[a][c] - 2 * share[b] * share[c] if c in near[a] else lost[c] - 2 * share[a] * share[c]
            near[a][c] = near[c][a] = joint
            near[c].pop(b, None)
            heapq.heappush(queue, (-joint, min(a, c), max(a, c)))
        near[a].pop(b, None)
        share[a] += share[b]
    return list(members.values())


def modularity(parts: list[set], edges: list[tuple]) -> float | None:
    """Newman's modularity of a partition; None without edges."""
    edges = list({tuple(sorted(e)) for e in edges if e[0] != e[1]})
    if not edges:
        return None
    of = {v: k for k, part in enumerate(parts) for v in part}
    inside, degree = defaultdict(int), defaultdict(int)
    for a, b in edges:
        degree[of[a]] += 1
        degree[of[b]] += 1
        inside[of[a]] += of[a] == of[b]
    m = len(edges)
    return sum(inside[k] / m - (d / (2 * m)) ** 2 for k, d in degree.items())


def linked(places: np.ndarray, genera: np.ndarray, n_places: int, n_genera: int, step: int = 4096) -> list[tuple[int, int]]:
    """Pairs of places (i < j) with a common genus, from pairs (place, genus) as numbers.

    A genus of few places gives its pairs one by one; those of so many that a row of a matrix product costs less are multiplied, ``step`` at a time.
    """
    code = np.unique(genera.astype(np.int64) * n_places + places)
    places, genera = code % n_places, code // n_places
    held = np.bincount(genera, minlength=n_genera)
    many = held * held * SPARSE > n_places * n_places
    near = np.zeros((n_places, n_places), bool)
    few = ~many[genera]
    place, stop = places[few], np.cumsum(held[~many])
    at, end = np.arange(len(place)), np.repeat(stop, held[~many])
    for apart in range(1, int(held[~many].max(initial=0))):
        at = at[at + apart < end[at]]
        near[place[at], place[at + apart]] = True
    number = np.cumsum(many) - 1
    places, genera = places[~few], number[genera[~few]]
    for first in range(0, int(many.sum()), step):
        a, b = np.searchsorted(genera, (first, first + step))
        there = np.zeros((n_places, min(step, int(many.sum()) - first)), np.float32)
        there[places[a:b], genera[a:b] - first] = 1
        near |= there @ there.T > 0
    return list(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))


def graph(locality: pa.ChunkedArray, genus: pa.ChunkedArray) -> tuple[int, int, list[tuple[int, int]]]:
    """(localities, genera, linked pairs of localities, which are numbered by name)."""
    place, genus = (c.combine_chunks().dictionary_encode() for c in (locality, genus))
    names = place.dictionary.to_pylist()
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    return len(names), len(genus.dictionary), linked(rank[place.indices.to_numpy()], genus.indices.to_numpy(), len(names), len(genus.dictionary))


def modularity_by(edges: DataFrame, *by: str) -> DataFrame:
    """(*by, modularity, n_communities, n_edges) of the locality graphs of distinct (*by, locality, genus).

    Localities are projected within the group, where their pairs are a matrix, whatever the number of genera; a group's rows are
    bounded by the grid's cells and the genera.  Localities without a link are communities of their own.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        n, _, pairs = graph(rows["locality"], rows["genus"])
        parts = communities(list(range(n)), pairs)
        values = [pa.array([modularity(parts, pairs)], pa.float64()), pa.array([len(parts)], pa.int64()), pa.array([len(pairs)], pa.int64())]
        return pa.table([*(pa.array([k.as_py()], k.type) for k in key), *values], [*by, "modularity", "n_communities", "n_edges"])

    kinds = ", ".join(f"`{b}` {edges.schema[b].dataType.simpleString()}" for b in by)
    return edges.select(*by, "locality", "genus").groupBy(*by).applyInArrow(run, f"{kinds}, modularity double, n_communities long, n_edges long")


def counted_cells(rows: DataFrame) -> DataFrame:
    """(time_bin, locality, genus, n, abs_lat) of ``located`` rows: their number and the sum of their absolute latitudes."""
    return rows.groupBy("time_bin", "locality", "genus").agg(F.count("*").alias("n"), F.sum(F.abs("lat")).alias("abs_lat"))


def robust_bins(counted: DataFrame, min_rows: int = 100, min_localities: int = 5, min_genera: int = 5) -> DataFrame:
    """Bins of ``counted_cells`` with enough rows, localities and genera: mean absolute latitude, genera, localities, rows."""
    sums = counted.groupBy("time_bin").agg((F.sum("abs_lat") / F.sum("n")).alias("mean_abs_lat"), F.count_distinct("genus").alias("diversity"), F.count_distinct("locality").alias("localities"), F.sum("n").alias("n"))
    return sums.filter((F.col("n") >= min_rows) & (F.col("localities") >= min_localities) & (F.col("diversity") >= min_genera))


def biogeographic_dynamics(occ: DataFrame, width: float = 5.0, cell: float = 5.0, min_rows: int = 100, min_localities: int = 5, min_genera: int = 5) -> DataFrame:
    """Modularity, mean absolute latitude and diversity of bins with enough rows, localities and genera, and edges of their graphs.

    A bin's counted cells meet once, for its guards and its graph; bins that the guards leave out have no graph made.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        n = pc.sum(rows["n"]).as_py()
        out = []
        if n >= min_rows:
            localities, genera, pairs = graph(rows["locality"], rows["genus"])
            if localities >= min_localities and genera >= min_genera:
                out = [(key[0].as_py(), modularity(communities(list(range(localities)), pairs), pairs), pc.sum(rows["abs_lat"]).as_py() / n, genera, len(pairs))]
        return pa.table({name: pa.array([r[k] for r in out], kind) for k, (name, kind) in enumerate(columns.items())})

    columns = {"time_bin": pa.float64(), "modularity": pa.float64(), "mean_abs_lat": pa.float64(), "diversity": pa.int64(), "n_edges": pa.int64()}
    cells = counted_cells(located(occ, width, cell)).groupBy("time_bin")
    return cells.applyInArrow(run, "time_bin double, modularity double, mean_abs_lat double, diversity long, n_edges long").orderBy(F.desc("time_bin"))


def locality_network_layout(occ: DataFrame, top: int = 50, cell: float = 5.0, rounds: int = 300) -> DataFrame:
    """(locality, x, y) of ``locality_network_nodes`` for a chart, in the unit square: see ``force_layout``.  One group of ``top`` nodes."""
    nodes, edges = locality_network_nodes(occ, top, cell), locality_network_edges(occ, top, cell)
    both = nodes.select(F.col("locality").alias("src"), F.lit(None).cast("string").alias("dst")).unionByName(edges)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted(frame.loc[frame["dst"].isna(), "src"])
        number = {n: k for k, n in enumerate(names)}
        pairs = [(number[a], number[b]) for a, b in zip(frame["src"], frame["dst"]) if isinstance(b, str)]
        at = force_layout(len(names), pairs, rounds)
        return pd.DataFrame({"locality": names, "x": at[:, 0], "y": at[:, 1]})

    return both.groupBy().applyInPandas(run, "locality string, x double, y double")


def layout_energy(at: np.ndarray, edges: np.ndarray, k: float) -> float:
    """What ``force_layout`` lowers: edges pull with distance squared over ``k``, all pairs push with ``k`` squared over distance."""
    apart = np.linalg.norm(at[:, None] - at[None], axis=2)[np.triu_indices(len(at), 1)]
    along = np.linalg.norm(at[edges[:, 0]] - at[edges[:, 1]], axis=1)
    return float((along**3).sum() / (3 * k) - k**2 * np.log(np.maximum(apart, 1e-9)).sum())


def force_layout(n: int, edges: list[tuple[int, int]], rounds: int = 300) -> np.ndarray:
    """Positions of ``n`` nodes in the unit square by attraction along edges and repulsion of all pairs, from a circle in the nodes' order, so the same
    each time.  A step that raises the energy is halved and taken anew."""
    if n < 2:
        return np.full((n, 2), 0.5)
    k, pairs = (1 / n) ** 0.5, np.array(edges, int).reshape(-1, 2)
    turn = 2 * np.pi * np.arange(n) / n
    at, step = 0.5 + 0.5 * np.stack([np.cos(turn), np.sin(turn)], axis=1), 0.1
    energy = layout_energy(at, pairs, k)
    for _ in range(rounds):
        gap = at[:, None] - at[None]
        far = np.maximum((gap**2).sum(axis=2), 1e-12)
        force = (gap * (k**2 / far)[:, :, None]).sum(axis=1)
        pull = at[pairs[:, 0]] - at[pairs[:, 1]]
        pull *= np.linalg.norm(pull, axis=1)[:, None] / k
        np.add.at(force, pairs[:, 0], -pull)
        np.add.at(force, pairs[:, 1], pull)
        size = np.maximum(np.linalg.norm(force, axis=1), 1e-12)[:, None]
        new = at + force / size * np.minimum(size, step)
        now = layout_energy(new, pairs, k)
        if now > energy:
            step /= 2
            if step < 1e-6:
                break
            continue
        at, energy, step = new, now, step * 1.1
    low, high = at.min(axis=0), at.max(axis=0)
    return (at - low) / max(float((high - low).max()), 1e-12)


def largest_bin(occ: DataFrame, width: float = 5.0, cell: float = 5.0, min_localities: int = 10, min_genera: int = 10) -> DataFrame:
    """(time_bin, locality, genus, n): the rows of the bin with most of them, counted.  No row if the bin has too few localities or genera."""
    counted = located(occ, width, cell).groupBy("time_bin", "locality", "genus").agg(F.count("*").alias("n"))
    sums = counted.groupBy("time_bin").agg(F.sum("n").alias("rows"), F.count_distinct("locality").alias("l"), F.count_distinct("genus").alias("g"))
    best = sums.orderBy(F.desc("rows"), "time_bin").limit(1).filter((F.col("l") >= min_localities) & (F.col("g") >= min_genera)).select("time_bin")
    return counted.join(F.broadcast(best), "time_bin")


#: Rows of a node of the tree of localities that are shuffled as they are; more are split by drawing.
SHUFFLED = 1 << 22


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """Good ones among ``n`` drawn without replacement.  Above the library's limit by inversion: the ratios of neighbouring probabilities,
    summed as logarithms over 12 standard deviations to both sides of the mode."""
    total = good + bad
    if total < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = 16 + int(12 * (n * (good / total) * (bad / total) * ((total - n) / (total - 1))) ** 0.5)
    low, high = max(0, n - bad, mode - reach), min(n, good, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    logs = np.append(0.0, np.cumsum(np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)))
    sums = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def drawn(genera: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Rows of each genus among ``n`` drawn without replacement, for any number of rows."""
    out, total = np.zeros_like(genera), int(genera.sum())
    order = np.argsort(-genera, kind="stable")
    for at, k in enumerate(order.tolist()):
        if total < 10**9:
            rest = order[at:]
            out[rest] = rng.multivariate_hypergeometric(genera[rest], n, method="marginals")
            break
        out[k] = hypergeometric(int(genera[k]), total - int(genera[k]), n, rng)
        n, total = n - int(out[k]), total - int(genera[k])
    return out


def split_margins(places: np.ndarray, genera: np.ndarray, seeds: list[int], low: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first place, rows of its places, rows of genera there) of nodes with up to ``most`` rows, or of one place.

    ``places``, from number ``low`` on, are halved like a binary tree; how many rows of each genus fall to the left half is drawn at the node.  That
    gives each table with the margins ``places`` and ``genera`` the same probability as permuting genera over the rows.
    """
    if len(places) == 1 or places.sum() <= most:
        yield low, places, genera
        return
    half = len(places) // 2
    left = drawn(genera, int(places[:half].sum()), np.random.default_rng([*seeds, low, len(places)]))
    yield from split_margins(places[:half], left, seeds, low, most)
    yield from split_margins(places[half:], genera - left, seeds, low + half, most)


def node_cells(places: np.ndarray, genera: np.ndarray, seeds: list[int], low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, genus, rows) of the filled cells of a node that ``split_margins`` gave."""
    if len(places) == 1:
        genus = np.flatnonzero(genera)
        return np.zeros(len(genus), np.int64), genus, genera[genus]
    rows = np.repeat(np.arange(len(genera)), genera)
    np.random.default_rng([*seeds, low]).shuffle(rows)
    code, n = np.unique(np.repeat(np.arange(len(places)), places) * len(genera) + rows, return_counts=True)
    return code // len(genera), code % len(genera), n


def margins(counted: DataFrame) -> DataFrame:
    """(time_bin, locality, genus, n, by_place): rows of each locality and of each genus in ``counted``."""
    return counted.groupingSets([("time_bin", "locality"), ("time_bin", "genus")], "time_bin", "locality", "genus").agg(F.sum("n").alias("n"), F.grouping("genus").alias("by_place"))


def named_margins(counted: DataFrame) -> DataFrame:
    """(time_bin, places_name, places_n, genera_name, genera_n): localities by name, genera by rows and name."""
    listed = lambda flag, *names: F.sort_array(F.collect_list(F.when(F.col("by_place") == flag, F.struct(*names))))
    held = margins(counted).groupBy("time_bin").agg(listed(1, F.col("locality").alias("name"), "n").alias("places"), listed(0, "n", F.col("genus").alias("name")).alias("genera"))
    return held.select("time_bin", *(F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in ("places", "genera") for f in ("name", "n")))


def bare_margins(counted: DataFrame) -> DataFrame:
    """(time_bin, places_n, genera_n, genera_times): as ``named_margins``, but genera of as many rows are one entry, as no name changes a graph."""
    sums = margins(counted).withColumn("genus", F.lit(None)).groupBy("time_bin", "by_place", "locality", "n").agg(F.count("*").alias("times"))
    listed = lambda flag, *names: F.sort_array(F.collect_list(F.when(F.col("by_place") == flag, F.struct(*names))))
    held = sums.groupBy("time_bin").agg(listed(1, "locality", "n").alias("places"), listed(0, "n", "times").alias("genera"))
    return held.select("time_bin", F.col("places.n").alias("places_n"), F.col("genera.n").alias("genera_n"), F.col("genera.times").alias("genera_times"))


def iteration_rows(counted: DataFrame, iterations: int) -> DataFrame:
    """A row and a task for each iteration, so that no batch holds several copies of the margins."""
    return counted.sparkSession.range(0, iterations, 1, max(1, iterations)).select(F.col("id").cast("int").alias("iteration"))


def drawn_cells(places: np.ndarray, genera: np.ndarray, seeds: list[int], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, genus, rows) of the filled cells of an iteration's table, node by node, as ``permuted_cells`` draws them."""
    for low, held, rows in split_margins(places, genera, seeds, 0, most):
        there = np.flatnonzero(rows)
        place, genus, n = node_cells(held, rows[there], seeds, low)
        yield low + place, there[genus], n


def permuted_cells(counted: DataFrame, iterations: int = 100, seed: int = 42, most: int = SHUFFLED) -> DataFrame:
    """(iteration, time_bin, locality, genus, n): for each bin of ``counted``, tables with genera permuted over its rows, so that each locality and each
    genus keeps its number of rows.

    A task takes an iteration's margins, which the grid's cells and the genera bound, down a tree of localities to nodes of up to ``most`` rows, and
    other tasks finish the nodes; so an iteration spreads, and neither memory nor any limit follows the rows.  Seeds belong to
    iterations and nodes: the partitioning changes nothing.
    """
    drawn_from = named_margins(counted)
    numbers = iteration_rows(counted, iterations)

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                genera = np.asarray(r.genera_name, object)
                for low, places, rows in split_margins(np.asarray(r.places_n), np.asarray(r.genera_n), [seed, r.iteration], 0, most):
                    there = np.flatnonzero(rows)
                    yield pd.DataFrame({"iteration": [r.iteration], "time_bin": [r.time_bin], "low": [low], "places_name": [r.places_name[low : low + len(places)]], "places_n": [places],
                                        "genera_name": [genera[there]], "genera_n": [rows[there]]})

    def finish(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        (r,) = frame.itertuples()
        place, genus, n = node_cells(np.asarray(r.places_n), np.asarray(r.genera_n), [seed, r.iteration], r.low)
        return pd.DataFrame({"iteration": r.iteration, "time_bin": r.time_bin, "locality": np.asarray(r.places_name, object)[place], "genus": np.asarray(r.genera_name, object)[genus], "n": n})

    nodes = "iteration int, time_bin double, low int, places_name array<string>, places_n array<long>, genera_name array<string>, genera_n array<long>"
    parts = numbers.crossJoin(F.broadcast(drawn_from)).mapInPandas(split, nodes)  # margins: a row for each bin
    return parts.groupBy("iteration", "time_bin", "low").applyInPandas(finish, "iteration int, time_bin double, locality string, genus string, n long")


def null_model(occ: DataFrame, iterations: int = 100, seed: int = 42, width: float = 5.0, cell: float = 5.0, min_localities: int = 10, min_genera: int = 10, most: int = SHUFFLED) -> DataFrame:
    """(iteration, time_bin, modularity, n_edges) for the bin with most rows: iteration -1 as observed, the others with genera permuted
    over its rows.  No rows if the bin has too few localities or genera.

    A task draws an iteration's table, that of ``permuted_cells``, and makes its graph; no cell leaves the task.
    """
    counted = largest_bin(occ, width, cell, min_localities, min_genera)
    observed = modularity_by(counted.withColumn("iteration", F.lit(-1)), "iteration", "time_bin").select("iteration", "time_bin", "modularity", "n_edges")
    if not iterations:
        return observed

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                places, genera = np.asarray(r.places_n), np.repeat(np.asarray(r.genera_n), np.asarray(r.genera_times))
                place, genus, _ = map(np.concatenate, zip(*drawn_cells(places, genera, [seed, r.iteration], most)))
                pairs = linked(place, genus, len(places), len(genera))
                value = modularity(communities(list(range(len(places))), pairs), pairs)
                yield pd.DataFrame({"iteration": [r.iteration], "time_bin": [r.time_bin], "modularity": [value], "n_edges": [len(pairs)]})

    permuted = iteration_rows(counted, iterations).crossJoin(F.broadcast(bare_margins(counted)))  # margins: a row for each bin
    return observed.unionByName(permuted.mapInPandas(run, "iteration int, time_bin double, modularity double, n_edges long"))


def null_marginals(occ: DataFrame, iterations: int = 100, seed: int = 42, width: float = 5.0, cell: float = 5.0, min_localities: int = 10, min_genera: int = 10, most: int = SHUFFLED) -> DataFrame:
    """(iteration, kind, name, n): rows of each locality and of each genus in the tables that ``null_model`` compares.

    A task draws an iteration's table and adds its cells up; names stay Arrow's buffers from the margins to the result.
    """
    counted = largest_bin(occ, width, cell, min_localities, min_genera)
    observed = margins(counted).select(F.lit(-1).alias("iteration"), F.when(F.col("by_place") == 1, "locality").otherwise("genus").alias("kind"), F.coalesce("locality", "genus").alias("name"), "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, iteration in enumerate(batch.column("iteration").to_pylist()):
                names = [batch.column(f"{c}_name")[k].values for c in ("places", "genera")]
                places, genera = (batch.column(f"{c}_n")[k].values.to_numpy() for c in ("places", "genera"))
                sums = [np.zeros(len(n), np.int64) for n in names]
                for place, genus, n in drawn_cells(places, genera, [seed, iteration], most):
                    np.add.at(sums[0], place, n)
                    np.add.at(sums[1], genus, n)
                for kind, name, n in zip(("locality", "genus"), names, sums):
                    for a in range(0, len(n), 1 << 15):
                        some = n[a : a + (1 << 15)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), iteration, np.int32)), pa.array([kind] * len(some)), name.slice(a, len(some)), pa.array(some)], ["iteration", "kind", "name", "n"])

    permuted = iteration_rows(counted, iterations).crossJoin(F.broadcast(named_margins(counted)))
    return observed.unionByName(permuted.mapInArrow(run, "iteration int, kind string, name string, n long"))


def null_model_summary(null: DataFrame) -> DataFrame:
    """Observed modularity, permutations, p-value (share of permutations at or above it; null without any) and significance.  One aggregation over
    the permutations, whose number is a parameter."""
    drawn_values = F.collect_list(F.when(F.col("iteration") >= 0, F.col("modularity")))
    sums = null.groupBy("time_bin").agg(F.max(F.when(F.col("iteration") == -1, F.col("modularity"))).alias("observed_modularity"), drawn_values.alias("drawn"))
    reached = F.size(F.filter("drawn", lambda x: x >= F.col("observed_modularity")))
    n = F.when(F.size("drawn") > 0, F.size("drawn").cast("long"))
    return sums.select("time_bin", "observed_modularity", n.alias("permutations"), (reached / n).alias("p_value")).withColumn("significant", F.col("p_value") < 0.05)


def null_histogram(null: DataFrame, bins: int = 20) -> DataFrame:
    """Permutations in ``bins`` equal classes between the least and the largest modularity: (class from 1, lower edge, number)."""
    held = null.filter("iteration >= 0 and modularity is not null").agg(F.min("modularity").alias("lo"), F.max("modularity").alias("hi"), F.collect_list("modularity").alias("drawn"))
    each = held.select("lo", "hi", F.explode("drawn").alias("modularity"))
    step = (F.col("hi") - F.col("lo")) / bins
    number = F.when(step > 0, F.least(F.floor((F.col("modularity") - F.col("lo")) / F.when(step > 0, step)), F.lit(bins - 1))).otherwise(0).cast("int") + 1
    return each.select(number.alias("class"), (F.col("lo") + (number - 1) * step).alias("from_modularity")).groupBy("class", "from_modularity").agg(F.count("*").alias("permutations"))
