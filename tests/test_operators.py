"""Edge cases of the occurrence operators on hand-made rows."""

from __future__ import annotations

import itertools
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions.numeric import bin_to, to_double
from strata.functions.ranking import shuffled_rank
from strata.operators import climate, diversity, extinction_model, network, ranges, taxonomy, turnover
from strata.sources.schema import SCHEMA


def occ(spark, rows):
    """Rows of (genus, mid_ma) or dictionaries."""
    rows = [r if isinstance(r, dict) else {"genus": r[0], "mid_ma": r[1]} for r in rows]
    return spark.createDataFrame([tuple(r.get(f.name) for f in SCHEMA.fields) for r in rows], SCHEMA)


def table(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_bins_round_half_to_even_and_have_no_negative_zero(spark):
    rows = occ(spark, [("a", 2.5), ("a", 7.5), ("a", 12.5), ("b", -0.00005)])
    found = [r.b for r in rows.select(bin_to("mid_ma", 5.0).alias("b")).collect()]
    assert found == [0.0, 10.0, 10.0, 0.0] and str(found[3]) == "0.0"


def test_to_double_takes_numbers_only(spark):
    texts = spark.createDataFrame([("1.5",), ("NaN",), ("1d",), ("abc",), (None,), (" 2e3 ",), ("-.5",)], "x string")
    assert [r.y for r in texts.select(to_double(F.col("x")).alias("y")).collect()] == [1.5, None, None, None, None, 2000.0, -0.5]


@pytest.mark.parametrize("counts,quota,want", [([1, 1, 1, 1], 0.5, 2), ([6, 1, 1], 0.5, 1), ([3, 2], 1.5, 2), ([1] * 10, 0.5, 5)])
def test_sqs(spark, counts, quota, want):
    rows = occ(spark, [(f"g{k}", 5.0) for k, n in enumerate(counts) for _ in range(n)])
    assert diversity.sqs_diversity(rows, quota).first().sqs_diversity == want
    assert diversity.sqs_diversity(rows, quota, float_compat=True).first().sqs_diversity in (want, want + 1)


def test_sqs_grows_with_the_quota(spark):
    rng = random.Random(1)
    rows = occ(spark, [(f"g{rng.randint(0, 9)}", 5.0 * rng.randint(0, 3)) for _ in range(200)])
    last = 0
    for quota in (0.1, 0.4, 0.7, 0.99):
        now = diversity.sqs_diversity(rows, quota).agg(F.sum("sqs_diversity")).first()[0]
        assert last <= now
        last = now
    assert last <= diversity.diversity_curve(rows).agg(F.sum("diversity")).first()[0]


def test_turnover_against_sets(spark):
    rng = random.Random(2)
    data = [(f"g{rng.randint(0, 30)}", 5.0 * rng.choice([0, 1, 2, 4, 9])) for _ in range(120)] + [(None, 5.0), ("x", None)]
    bins = defaultdict(set)
    for g, m in data:
        if g and m is not None:
            bins[m].add(g)
    order = sorted(bins, reverse=True)
    want = []
    for k, b in enumerate(order):
        old = bins[order[k - 1]] if k else set()
        new = bins[order[k + 1]] if k + 1 < len(order) else set()
        want.append((b, len(bins[b]), len(bins[b] - old), len(bins[b] - new)))
    assert table(turnover.turnover_rates(occ(spark, data)), "time_bin", "total_genera", "originations", "extinctions") == sorted(want)


def test_genus_gap_counts_as_extinction_and_age(spark):
    rows = occ(spark, [{"genus": g, "mid_ma": m, "lat": 1.0, "lng": 2.0, "environment": "e"} for g, m in [("a", 20.0), ("b", 15.0), ("a", 10.0), ("c", 5.0)]])
    found = {(r.genus, r.time_bin): (r.age, r.extinct_next_bin) for r in turnover.extinction_features(rows).collect()}
    assert found == {("a", 20.0): (0, 1), ("b", 15.0): (0, 1), ("a", 10.0): (1, 1)}


def test_mass_extinctions_flag_and_edge_bins(spark):
    rates = spark.createDataFrame([(float(t), 1.0 if t in (0, 50) else 0.1, 1) for t in range(0, 100, 5)], "time_bin double, extinction_rate double, x int")
    assert table(turnover.mass_extinctions(rates).filter("is_mass_extinction"), "time_bin") == [(0.0,), (50.0,)]
    assert table(turnover.mass_extinctions(rates, exclude_edge_bins=True).filter("is_mass_extinction"), "time_bin") == [(50.0,)]


def test_event_windows(spark):
    flags = {r.genus: (r.before, r.after) for r in ranges._event_flags(occ(spark, [("a", 195.0), ("b", 210.0), ("c", 194.999)])).filter("event like 'End-Tri%'").collect()}
    assert flags == {"a": (False, True), "b": (True, False)}


def test_periods_at_their_edges(spark):
    rows = occ(spark, [{"genus": "g", "mid_ma": m, "lat": 0.0, "lng": 0.0} for m in (252.0, 201.0, 145.0, 66.0, 65.9, 253.0)])
    assert table(ranges.period_breakdown(rows), "period", "occurrences") == [("Cretaceous", 2), ("Jurassic", 1), ("Triassic", 1)]
    assert table(ranges.hemisphere_diversity(rows), "hemisphere", "genera") == [("Southern", 1)]
    assert table(ranges.period_breakdown(occ(spark, [])), "period", "genera") == [("Cretaceous", 0), ("Jurassic", 0), ("Triassic", 0)]


def test_explorer_mode_ties_and_paging(spark):
    rows = [{"genus": "g", "mid_ma": 1.0, "lat": 0.0, "lng": 0.0, "primary_reference": p} for p in ("b", "a", None)] + [{"genus": "h", "mid_ma": 1.0, "lat": 0.0, "lng": 0.0}]
    found = ranges.genus_explorer(occ(spark, rows))
    assert table(found, "genus", "occurrences", "reference") == [("g", 3, "a"), ("h", 1, "Unknown")]
    assert [r.genus for r in ranges.explorer_page(found, 2, 1).collect()] == ["h"]
    assert [r.genus for r in ranges.explorer_search(found, "G").collect()] == ["g"]


def test_peak_origination_takes_the_youngest_at_a_tie(spark):
    assert tuple(ranges.peak_origination(occ(spark, [("a", 10.0), ("b", 30.0)])).first()) == (10.0, 1)


def test_temperature_and_constant_correlation(spark):
    curve = {r.time: r.temperature for r in climate.temperature_curve(spark).collect()}
    assert len(curve) == 541 and (curve[0.0], curve[5.0], curve[20.0], curve[540.0]) == (14.0, 14.0, 16.0, 24.0)
    ages = spark.createDataFrame([(-1.0,), (700.0,), (None,)], "a double").select(climate.temperature(F.col("a")).alias("t")).collect()
    assert [r.t for r in ages] == [14.0, 24.0, None]
    flat = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "x double, y double")
    assert climate.correlation(flat, "x", "y").first()[0] == 0.0
    line = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double")
    assert climate.correlation(line, "x", "y").first()[0] == pytest.approx(1.0)


def test_sunburst_sums(spark):
    rng = random.Random(3)
    rows = occ(spark, [{"phylum": rng.choice(["p", "q", None]), "class": rng.choice("ab"), "order": rng.choice("xyz")} for _ in range(100)])
    nodes = {r.id: (r.parent, r.value) for r in taxonomy.sunburst(rows).collect()}
    assert sum(v for p, v in nodes.values() if p == "") == 100
    for name, (_, value) in nodes.items():
        if children := [v for p, v in nodes.values() if p == name]:
            assert sum(children) == value
    assert "Unknown" in nodes


KARATE = """1-2 1-3 1-4 1-5 1-6 1-7 1-8 1-9 1-11 1-12 1-13 1-14 1-18 1-20 1-22 1-32 2-3 2-4 2-8 2-14 2-18 2-20 2-22 2-31 3-4 3-8 3-9 3-10 3-14 3-28 3-29 3-33
4-8 4-13 4-14 5-7 5-11 6-7 6-11 6-17 7-17 9-31 9-33 9-34 10-34 14-34 15-33 15-34 16-33 16-34 19-33 19-34 20-34 21-33 21-34 23-33 23-34 24-26 24-28 24-30 24-33 24-34
25-26 25-28 25-32 26-32 27-30 27-34 28-34 29-32 29-34 30-33 30-34 31-33 31-34 32-33 32-34 33-34"""


def test_communities_on_the_karate_club():
    edges = [tuple(map(int, e.split("-"))) for e in KARATE.split()]
    assert len(edges) == 78
    parts = network.communities(list(range(1, 35)), edges)
    assert sorted(x for p in parts for x in p) == list(range(1, 35))
    assert network.modularity(parts, edges) == pytest.approx(0.3807, abs=2e-3)
    assert network.modularity([{1}, {2}], []) is None


def test_projection_against_pairs(spark):
    rng = random.Random(4)
    data = sorted({(5.0, f"l{rng.randint(0, 8)}", f"g{rng.randint(0, 12)}") for _ in range(40)})
    want = sorted({(a[0], a[1], b[1]) for a in data for b in data if a[2] == b[2] and a[1] < b[1]})
    found = network.project(spark.createDataFrame(data, "time_bin double, locality string, genus string"), ["time_bin"])
    assert table(found, "time_bin", "src", "dst") == want


def test_bin_without_edges_has_no_modularity(spark):
    rows = occ(spark, [{"genus": f"g{k}", "mid_ma": 5.0, "lat": 10.0 * k, "lng": 0.0} for k in range(6)])
    found = network.biogeographic_dynamics(rows, min_rows=1).collect()
    assert [(r.diversity, r.modularity) for r in found] == [(6, None)]
    assert network.biogeographic_dynamics(occ(spark, [])).collect() == []


def test_null_model_repeats_and_guards(spark):
    rng = random.Random(5)
    rows = [{"genus": f"g{rng.randint(0, 20)}", "mid_ma": 5.0, "lat": 5.0 * rng.randint(0, 11), "lng": 0.0} for _ in range(150)]
    null = network.null_model(occ(spark, rows), 5)
    one, two = (sorted(map(tuple, n.collect())) for n in (null, network.null_model(occ(spark, rows).repartition(3), 5)))
    assert one == two and [r[0] for r in one] == [-1, 0, 1, 2, 3, 4]
    summary = network.null_model_summary(null).first()
    assert summary.permutations == 5 and 0 <= summary.p_value <= 1
    assert network.null_model(occ(spark, rows[:5]), 5).collect() == []
    classes = network.null_histogram(null, 4).collect()
    assert sum(r.permutations for r in classes) == 5 and all(1 <= r["class"] <= 4 for r in classes)
    flat = spark.createDataFrame([(k, 5.0, 0.25) for k in range(-1, 3)], "iteration int, time_bin double, modularity double")
    assert [tuple(r) for r in network.null_histogram(flat).collect()] == [(1, 0.25, 3)]


def test_shuffled_rank_is_a_permutation(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    found = shuffled_rank(rows, ["g"], F.xxhash64("id"), "r", buckets=16)
    for g in range(3):
        mine = sorted(r.r for r in found.filter(F.col("g") == g).collect())
        assert mine == list(range(len(mine)))


def test_extinction_model(spark):
    rng = random.Random(6)
    rows = []
    for k in range(300):
        n = rng.randint(1, 50)
        rows.append((f"g{k}", 5.0, n, n, float(n), 1, 0, int(n < 25)))
    features = spark.createDataFrame(rows, "genus string, time_bin double, geographic_range long, abundance long, lat_range double, env_breadth long, age long, extinct_next_bin long")
    model = extinction_model.fit(features, trees=10, depth=4)
    found = extinction_model.metrics(model).first()
    assert found.accuracy > 0.95 and found.roc_auc > 0.95 and model.train.count() + model.test.count() == 300
    assert sum(r.importance for r in extinction_model.feature_importances(model).collect()) == pytest.approx(1.0)
    assert extinction_model.fit(features.limit(50)) is None


def test_forest_reads_its_split_and_sorts_it_once(spark):
    features = spark.range(300).selectExpr("concat('g', id) as genus", "5d as time_bin", "id % 50 as geographic_range", "id % 7 as abundance", "double(id % 11) as lat_range",
                                           "1L as env_breadth", "0L as age", "int(id % 50 < 25) as extinct_next_bin")
    model = extinction_model.fit(features, trees=2, depth=2)
    for side in (model.train, model.test):
        plan = side._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Relation" in plan
    assert model.train.intersect(model.test).count() == 0 and model.train.count() == 210


def slow_communities(n, edges):
    """Every pair of linked communities is tried at each step; the first of the best ones is merged."""
    parts, tied = {k: {k} for k in range(n)}, False
    while True:
        now = network.modularity(list(parts.values()), edges)
        gains = {}
        for a, b in itertools.combinations(sorted(parts), 2):
            if any((x in parts[a] and y in parts[b]) or (y in parts[a] and x in parts[b]) for x, y in edges):
                joined = [p for k, p in parts.items() if k not in (a, b)] + [parts[a] | parts[b]]
                gains[a, b] = network.modularity(joined, edges) - now
        best = max(gains.values(), default=0)
        if best <= 1e-12:
            return list(parts.values()), tied
        a, b = min(pairs := [pair for pair, g in gains.items() if g > best - 1e-12])
        tied |= len(pairs) > 1
        parts[a] |= parts.pop(b)


@pytest.mark.parametrize("seed", range(12))
def test_communities_against_a_slow_greedy_version(seed):
    rng = random.Random(seed)
    n = rng.randint(4, 16)
    edges = [e for e in itertools.combinations(range(n), 2) if rng.random() < (0.6 if e[0] % 3 == e[1] % 3 else 0.1)]
    if not edges:
        return
    fast, (slow, tied) = network.communities(list(range(n)), edges), slow_communities(n, edges)
    assert tied or sorted(map(sorted, fast)) == sorted(map(sorted, slow))
    assert network.modularity(fast, edges) == pytest.approx(network.modularity(slow, edges), abs=0.03 if tied else 1e-9)


@pytest.mark.parametrize("step", [1, 7, 4096])
def test_linked_places(step):
    rng = np.random.default_rng(step)
    place, genus = rng.integers(0, 12, 60), rng.integers(0, 30, 60)
    want = {(a, b) for a, b in itertools.combinations(range(12), 2) if set(genus[place == a]) & set(genus[place == b])}
    assert set(network.linked(place, genus, 12, 30, step)) == want


def test_linked_places_of_many_genera():
    """Most genera in two places of many, some in hundreds: as by sets, and no matrix product for each 4,096 genera."""
    rng, n = np.random.default_rng(4), 400
    genus = np.concatenate([rng.integers(0, 30_000, 40_000), np.full(300, 30_000), np.full(350, 30_001)])
    place = np.concatenate([rng.integers(0, n, 40_000), rng.permutation(n)[:300], rng.permutation(n)[:350]])
    want, places = set(), {}
    for g, p in zip(genus.tolist(), place.tolist()):
        places.setdefault(g, set()).add(p)
    for held in places.values():
        want |= set(itertools.combinations(sorted(held), 2))
    assert network.linked(place, genus, n, 30_002) == sorted(want)
    n, genus = 2701, np.repeat(np.arange(500_000), 2)
    began = time.process_time()
    found = network.linked(rng.integers(0, n, 1_000_000), genus, n, 500_000)
    assert 400_000 < len(found) < 500_000 and time.process_time() - began < 30


@pytest.mark.parametrize("seed", range(8))
def test_communities_by_a_matrix_are_the_same(seed, monkeypatch):
    """The same unions in the same order as from the queue, ties included."""
    rng = random.Random(seed)
    n = rng.randint(2, 70)
    edges = [e for e in itertools.combinations(range(n), 2) if rng.random() < (0.6 if e[0] % 3 == e[1] % 3 else 0.15)]
    found = []
    for most in (0, 4096):
        monkeypatch.setattr(network, "DENSE_NODES", most)
        found.append([sorted(part) for part in network.communities(list(range(n)), edges)])
    assert found[0] == found[1]


@pytest.mark.parametrize("most", [1, 3, 100])
def test_permuted_tables_are_those_of_shuffled_rows(most):
    """Sums stay, and tables are as frequent as if genera were shuffled over the rows, at whatever size nodes are split."""
    places, genera = np.array([0, 0, 1, 2, 2]), np.array([0, 0, 1, 1, 2])
    table = lambda p, g: tuple(np.bincount(3 * p + g, minlength=9).tolist())
    want = Counter(table(places, np.array(g)) for g in itertools.permutations(genera.tolist()))
    found = Counter()
    for k in range(12_000):
        out = np.zeros((3, 3), int)
        for low, counts, rows in network.split_margins(np.array([2, 1, 2]), np.array([2, 2, 1]), [7, k], 0, most):
            place, genus, n = network.node_cells(counts, rows, [7, k], low)
            out[low + place, genus] = n
        found[tuple(out.ravel().tolist())] += 1
    assert set(found) == set(want) and all(found[t] == pytest.approx(100 * n, rel=0.3, abs=40) for t, n in want.items())
    assert sum((found[t] - 100 * n) ** 2 / (100 * n) for t, n in want.items()) < 3 * len(want)


def test_hypergeometric_by_inversion_follows_the_library(monkeypatch):
    rng, numbers = np.random.default_rng(3), (40, 60, 30)
    exact = np.bincount(rng.hypergeometric(*numbers, 40_000), minlength=31)
    small = network.hypergeometric.__code__.replace(co_consts=tuple(10 if c == 10**9 else c for c in network.hypergeometric.__code__.co_consts))
    inverted = type(network.hypergeometric)(small, network.hypergeometric.__globals__)
    found = np.bincount([inverted(*numbers, rng) for _ in range(40_000)], minlength=31)
    common = exact + found > 200
    assert np.all(np.abs(exact - found)[common] < 5 * np.sqrt((exact + found)[common]))
    assert [inverted(20, 0, 5, rng), inverted(0, 20, 5, rng), inverted(7, 13, 20, rng), inverted(7, 13, 0, rng)] == [5, 0, 7, 0]
    big = [network.hypergeometric(3 * 10**9, 5 * 10**9, 4 * 10**9, rng) for _ in range(40)]
    sd = (4e9 * 3 / 8 * 5 / 8 * (4 / 8)) ** 0.5
    assert abs(np.mean(big) - 1.5e9) < 4 * sd / 40**0.5 and 0.6 * sd < np.std(big) < 1.5 * sd


def test_a_bin_of_more_rows_than_fit_anywhere(spark):
    """3,000 million rows: the margins of each permutation are those observed, and cells near what independence expects."""
    rows = [(5.0, f"p{p}", f"g{g}", n) for p in range(12) for g in range(9) if (n := (p + 1) * (g + 2) * 900_000 if (p + g) % 3 else 0)] + [(5.0, "p0", "rare", 3)]
    counted = spark.createDataFrame(rows, "time_bin double, locality string, genus string, n long")
    total = sum(r[3] for r in rows)
    assert total > 2 * 10**9
    cells = network.permuted_cells(counted, 3, most=1 << 16).collect()
    for k in range(3):
        for at, name in ((1, "locality"), (2, "genus")):
            want, found = Counter(), Counter()
            for r in rows:
                want[r[at]] += r[3]
            for r in cells:
                if r.iteration == k:
                    found[r[name]] += r.n
            assert want == found
    first = {(r.locality, r.genus): r.n for r in cells if r.iteration == 0}
    p, g = sum(r[3] for r in rows if r[1] == "p5"), sum(r[3] for r in rows if r[2] == "g4")
    assert first["p5", "g4"] == pytest.approx(p * g / total, rel=1e-3)


def test_permutations_run_once(spark):
    """One pass over the permutations for the summary and for the histogram, and a partitioning that changes nothing."""
    rng = random.Random(5)
    rows = [{"genus": f"g{rng.randint(0, 20)}", "mid_ma": 5.0, "lat": 5.0 * rng.randint(0, 11), "lng": 0.0} for _ in range(150)]
    null = network.null_model(occ(spark, rows), 5)
    for frame in (network.null_model_summary(null), network.null_histogram(null, 4)):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    cells = [sorted(map(tuple, network.permuted_cells(network.largest_bin(occ(spark, rows).repartition(n)), 4, most=20).collect())) for n in (1, 5)]
    assert cells[0] == cells[1] and len({(r[0], r[2]) for r in cells[0]}) == 4 * 12
    ends = network.null_marginals(occ(spark, rows), 4, most=20).groupBy("kind", "name").agg(F.count_distinct("n").alias("k"), F.count("*").alias("rows")).collect()
    assert {(r.k, r.rows) for r in ends} == {(1, 5)}


def test_null_model_keeps_cells_in_their_tasks(spark):
    """Its graphs are those of the permuted tables, however these are split; only the observed cells are shuffled to a graph, and no group holds margins."""
    rng = random.Random(8)
    rows = occ(spark, [{"genus": f"g{rng.randint(0, 30)}", "mid_ma": 5.0, "lat": 5.0 * rng.randint(0, 11), "lng": 0.0} for _ in range(200)])
    counted = network.largest_bin(rows)
    for most in (30, network.SHUFFLED):
        null = network.null_model(rows, 4, most=most)
        want = network.modularity_by(network.permuted_cells(counted, 4, most=most), "iteration", "time_bin").select("iteration", "time_bin", "modularity", "n_edges")
        assert sorted(map(tuple, null.filter("iteration >= 0").collect())) == sorted(map(tuple, want.collect()))
        cells = Counter()
        for r in network.permuted_cells(counted, 4, most=most).collect():
            cells[r.iteration, "locality", r.locality] += r.n
            cells[r.iteration, "genus", r.genus] += r.n
        ends = network.null_marginals(rows, 4, most=most)
        assert {(r.iteration, r.kind, r.name): r.n for r in ends.filter("iteration >= 0").collect()} == cells
    for frame, groups in ((null, 1), (ends, 0)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("FlatMapGroupsIn") == groups and plan.count("MapInPandas") + plan.count("MapInArrow") == 1


def test_split_takes_the_share_of_each_class(spark):
    rows = [(f"g{k}", 5.0, int(k % 3 == 0), 1) for k in range(100)]
    frame = spark.createDataFrame(rows, "genus string, time_bin double, extinct_next_bin int, abundance int")
    found = {(r.side, r.extinct_next_bin): r.n for r in extinction_model.split_sizes(frame).collect()}
    assert found == {("train", 1): 23, ("test", 1): 11, ("train", 0): 46, ("test", 0): 20}
    train, test = extinction_model.stratified_split(frame.repartition(7))
    assert train.intersect(test).count() == 0 and sorted(map(tuple, train.collect())) == sorted(map(tuple, extinction_model.stratified_split(frame)[0].collect()))


def test_network_guards(spark):
    """A bin stays only with enough rows, localities and genera."""
    def rows(bin_, n, places, genera):
        return [(f"g{k % genera}", float(bin_), 5.0 * (k % places), 0.0) for k in range(n)]

    frame = spark.createDataFrame(rows(5, 100, 6, 7) + rows(50, 99, 6, 7) + rows(100, 120, 4, 7) + rows(150, 120, 6, 4), "genus string, mid_ma double, lat double, lng double")
    found = network.biogeographic_dynamics(frame).collect()
    assert [(r.time_bin, r.diversity) for r in found] == [(5.0, 7)]


def test_layout():
    """A ring and two cliques: energy falls from the start, cliques are apart, positions repeat and fill the unit square."""
    ring = [(k, (k + 1) % 12) for k in range(12)]
    cliques = [(a + 6 * c, b + 6 * c) for c in range(2) for a, b in itertools.combinations(range(6), 2)] + [(0, 6)]
    for edges in (ring, cliques):
        at = network.force_layout(12, edges)
        assert np.array_equal(at, network.force_layout(12, edges)) and at.min() == 0 and at.max() == pytest.approx(1)
        energies = [network.layout_energy(network.force_layout(12, edges, rounds) * 1.0, np.array(edges), (1 / 12) ** 0.5) for rounds in (0, 300)]
        assert energies[1] < energies[0] or edges is ring  # a ring is laid out from the start
    inside = [np.linalg.norm(at[a] - at[b]) for a, b in cliques[:-1]]
    between = [np.linalg.norm(at[a] - at[b]) for a in range(6) for b in range(6, 12)]
    assert np.mean(inside) < 0.5 * np.mean(between)
    assert network.force_layout(0, []).shape == (0, 2) and network.force_layout(1, []).tolist() == [[0.5, 0.5]]


def test_layout_of_the_network(spark):
    rows = occ(spark, [{"genus": f"g{k // 3}", "mid_ma": 5.0, "lat": 5.0 * (k % 9), "lng": 0.0} for k in range(60)])
    found = network.locality_network_layout(rows, top=6).collect()
    assert {r.locality for r in found} == {r.locality for r in network.locality_network_nodes(rows, top=6).collect()} and all(0 <= r.x <= 1 and 0 <= r.y <= 1 for r in found)
    assert network.locality_network_layout(occ(spark, [])).collect() == []


def test_stable_sample_takes_few_rows_of_each_partition(spark):
    """Whether the threshold cuts or not, and where rows share a hash."""
    rows = spark.range(5000).select(F.col("id").cast("string").alias("occurrence_id"), (F.col("id") % 7).cast("string").alias("genus"))
    noise = F.md5(F.concat_ws("/", F.lit("42"), "occurrence_id", "genus"))
    for n in (0, 1, 40, 2400, 4999, 6000):
        want = [tuple(r) for r in rows.orderBy(noise, "occurrence_id", "genus").limit(n).collect()]
        assert sorted(map(tuple, ranges.stable_sample(rows.repartition(4), n).collect())) == sorted(want)
    same = spark.range(3000).select(F.lit("x").alias("occurrence_id"), F.lit("y").alias("genus"), "id")
    assert sorted(r.id for r in ranges.stable_sample(same, 10).collect()) == list(range(10))
