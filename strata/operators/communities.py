"""Communities of graphs beyond one task: local moving and aggregation on edge tables.

A graph is a table of directed weights (u, v, w) with both directions of each edge.  In a round, links are summed by node and neighbouring community
(a join with the communities of ``v``, an aggregation that combines before the shuffle), each sum is joined with that community's total
degree, and a node goes where modularity gains most, if that is more than where it is.  Half of the nodes, by a hash of node and round, may
move in a round, so that neighbours don't swap places for ever.  When a level is settled its communities become the nodes of the next graph,
whose loops hold the inner links.  Levels end when modularity rises no more.  No step gathers a node's, a community's or a bin's edges in one
place; a hub's rows are one side of ordinary joins, which adaptive execution splits.

For graphs that fit a task, ``network.communities`` merges greedily instead, which takes no job for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.shared import forget, written

#: Less is no gain: sums of doubles depend on the order of rows.
LEAST_GAIN = 1e-9


def weights(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(u, v, w) of undirected edges; loops and repeated edges, in either direction, and edges with a null end change nothing."""
    pair = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y")).filter("x and y and u != v").select("u", "v").distinct()
    return pair.unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("w", F.lit(1.0))


def total_modularity(graph: DataFrame, both: float) -> float:
    """Modularity of the partition whose communities are the nodes of ``graph``; ``both``: the sum of all weights."""
    sums = graph.groupBy("u").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("u") == F.col("v"), F.col("w")).otherwise(0.0)).alias("inner"))
    return sums.agg(F.sum(F.col("inner") / both - (F.col("k") / both) ** 2).alias("q")).first().q or 0.0


def moved_once(graph: DataFrame, state: DataFrame, both: float, number: int) -> DataFrame:
    """state: (node, k, c).  The same after one round, with ``moved``."""
    totals = state.groupBy("c").agg(F.sum("k").alias("total"))
    near = graph.filter("u != v").join(state.select(F.col("node").alias("v"), F.col("c").alias("to")), "v").select(F.col("u").alias("node"), "to", "w")
    sums = near.unionByName(state.select("node", F.col("c").alias("to"), F.lit(0.0).alias("w"))).groupBy("node", "to").agg(F.sum("w").alias("w"))
    rated = sums.join(totals.withColumnRenamed("c", "to"), "to").join(state, "node")
    here = F.col("to") == F.col("c")
    gain = F.col("w") - F.col("k") * (F.col("total") - F.when(here, F.col("k")).otherwise(0.0)) / both
    best = rated.select("node", "k", "c", "to", gain.alias("gain"), here.alias("here")).groupBy("node").agg(
        F.first("k").alias("k"), F.first("c").alias("c"), F.min_by("to", F.struct(-F.round("gain", 9), "to")).alias("best"), F.max("gain").alias("most"), F.max(F.when(F.col("here"), F.col("gain"))).alias("stay"))
    goes = (F.col("most") > F.col("stay") + LEAST_GAIN * both) & (F.pmod(F.xxhash64("node", F.lit(number)), F.lit(2)) == 0)
    return best.select("node", "k", F.when(goes, F.col("best")).otherwise(F.col("c")).alias("c"), goes.alias("moved"))


def settled(graph: DataFrame, start: DataFrame | None, both: float, rounds: int, seed: int) -> DataFrame:
    """(node, c): communities after up to ``rounds`` rounds of moving, or fewer if no node wants to move; from ``start`` (node, c), else from nodes alone."""
    own = graph.groupBy("u").agg(F.sum("w").alias("k")).withColumnRenamed("u", "node")
    first = own.join(start, "node").select("node", "k", "c") if start is not None else own.withColumn("c", F.col("node"))
    state, quiet = written(first.withColumn("moved", F.lit(False)), "state"), 0
    for number in range(rounds):
        last, state = state, written(moved_once(graph, state.drop("moved"), both, seed * rounds + number), "state")
        forget(last)
        quiet = 0 if state.filter("moved").limit(1).count() else quiet + 1
        if quiet == 2:  # both halves have had their turn
            break
    return state


def joined(graph: DataFrame, to: DataFrame) -> DataFrame:
    """The graph of communities (node, c)."""
    left = graph.join(to.select(F.col("node").alias("u"), F.col("c").alias("a")), "u").join(to.select(F.col("node").alias("v"), F.col("c").alias("b")), "v")
    return written(left.groupBy("a", "b").agg(F.sum("w").alias("w")).select(F.col("a").alias("u"), F.col("b").alias("v"), "w"), "graph")


def detect(edges: DataFrame, a: str = "src", b: str = "dst", rounds: int = 16, passes: int = 3) -> tuple[DataFrame, float | None]:
    """((node, community), modularity) of an undirected graph; a community has the name of its least node.  Modularity is None without edges.

    A pass moves nodes, joins communities to a new graph, moves those, and so on; the next pass moves single nodes again from where the last one
    ended.  Passes end when modularity rises no more.
    """
    whole = graph = written(weights(edges, a, b), "graph")
    both = whole.agg(F.sum("w")).first()[0]
    names = written(whole.select(F.col("u").alias("node")).distinct().withColumn("c", F.col("node")), "names")
    if not both:
        forget(whole)
        return names.withColumnRenamed("c", "community"), None
    reached, seed, start = total_modularity(whole, both), 0, None
    for _ in range(passes):
        before = reached
        while True:
            to = settled(graph, start, both, rounds, seed)
            less = joined(graph, to)
            now = total_modularity(less, both)
            if now <= reached + LEAST_GAIN:
                forget(less, to)
                break
            moved = to.select("node", "c") if start is not None else names.join(to.select(F.col("node").alias("c"), F.col("c").alias("to")), "c").select("node", F.col("to").alias("c"))
            last, names = names, written(moved, "names")
            forget(last, to)
            if graph is not whole:
                forget(graph)
            graph, reached, seed, start = less, now, seed + 1, None
        if graph is not whole:
            forget(graph)
        if reached <= before + LEAST_GAIN:
            break
        graph, start, seed = whole, names, seed + 1
    least = names.groupBy("c").agg(F.min("node").alias("community"))
    named = written(names.join(least, "c").select("node", "community"), "names")
    forget(whole, names)
    return named, reached


def communities(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, community, size, modularity): ``detect`` as one table, with each community's number of nodes."""
    names, reached = detect(edges, a, b)
    sizes = names.groupBy("community").agg(F.count("*").alias("size"))
    return names.join(sizes, "community").select("node", "community", "size", F.lit(reached).cast("double").alias("modularity"))
