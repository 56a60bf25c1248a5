"""Communities on edge tables against the greedy version in memory and planted ones."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strata.operators import communities, network


def found(spark, edges):
    names, q = communities.detect(spark.createDataFrame(edges, "src string, dst string"))
    parts: dict = {}
    for r in names.collect():
        parts.setdefault(r.community, set()).add(r.node)
    assert all(c == min(part) for c, part in parts.items())
    return list(parts.values()), q


def planted(rng, blocks, size, inner, outer):
    """Blocks of nodes with many edges inside and few between, the first block three times as large."""
    of = [b for b in range(blocks) for _ in range(size * (3 if b == 0 else 1))]
    edges = [(f"n{i}", f"n{j}") for i, j in itertools.combinations(range(len(of)), 2) if rng.random() < (inner if of[i] == of[j] else outer)]
    return of, edges


def test_planted_communities_and_repeated_edges(spark):
    rng = random.Random(2)
    of, edges = planted(rng, 5, 10, 0.7, 0.02)
    parts, q = found(spark, edges + [(b, a) for a, b in edges[:30]] + [("n1", "n1"), (None, "n2")])
    assert sorted(map(len, parts)) == [10, 10, 10, 10, 30] and all(len({of[int(n[1:])] for n in part}) == 1 for part in parts)
    assert q == pytest.approx(network.modularity(parts, edges))


@pytest.mark.parametrize("seed", [1, 2])
def test_no_worse_than_greedy(spark, seed):
    rng = random.Random(seed)
    edges = planted(rng, 4, 8, 0.4, 0.1)[1] if seed == 1 else [(f"c{k}.{i}", f"c{k}.{j}") for k in range(8) for i, j in itertools.combinations(range(5), 2)] + [(f"c{k}.0", f"c{(k + 1) % 8}.1") for k in range(8)]
    parts, q = found(spark, edges)
    assert q == pytest.approx(network.modularity(parts, edges))
    nodes = sorted({n for e in edges for n in e})
    assert q >= 0.98 * network.modularity(network.communities(nodes, edges), edges)


def test_no_edges_and_a_star(spark):
    assert found(spark, []) == ([], None) and found(spark, [("a", "a")]) == ([], None)
    parts, q = found(spark, [("hub", f"x{k}") for k in range(40)])
    assert len(parts) == 1 and q == pytest.approx(0.0)


def test_nothing_is_gathered(spark):
    """A round has no window and no collected list: aggregations combine before their shuffle."""
    graph = communities.weights(spark.createDataFrame([("a", "b")], "src string, dst string"))
    state = graph.select(F.col("u").alias("node"), F.lit(1.0).alias("k"), F.col("u").alias("c"))
    plan = communities.moved_once(graph, state, 2.0, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_" not in plan and "Python" not in plan and "Pandas" not in plan
