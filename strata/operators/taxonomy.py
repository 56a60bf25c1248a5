"""Taxonomic hierarchy and clade statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.numeric import bin_to
from strata.operators.ranges import whole_text

UNKNOWN = "Unknown"
#: Names that mark dinosaurs in any of the three ranks.
DINOSAURS = ("Saurischia", "Ornithischia", "Dinosauria")


def filled(occ: DataFrame) -> DataFrame:
    """Phylum, class and order with ``Unknown`` where they are missing."""
    ranks = {c: F.coalesce(F.col(c), F.lit(UNKNOWN)) if c in occ.columns else F.lit(UNKNOWN) for c in ("phylum", "class", "order")}
    return occ.withColumns(ranks)


def sunburst(occ: DataFrame, orders: int = 50) -> DataFrame:
    """Occurrences of the ``orders`` most frequent orders, their classes and phyla, as (id, label, parent, value)."""
    rows = filled(occ).select("phylum", "class", "order")
    top = rows.groupBy("order").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "order").limit(orders).select("order")
    counts = rows.join(F.broadcast(top), "order", "left_semi").groupBy("phylum", "class", "order").agg(F.count("*").alias("n"))
    p, c, o = F.col("phylum"), F.col("class"), F.col("order")
    level = lambda i, label, parent: F.struct(i.alias("id"), label.alias("label"), parent.alias("parent"))
    pc = F.concat_ws("-", p, c)
    nodes = F.explode(F.array(level(p, p, F.lit("")), level(pc, c, p), level(F.concat_ws("-", pc, o), o, pc)))
    return counts.select(nodes.alias("node"), "n").groupBy("node").agg(F.sum("n").alias("value")).select("node.*", "value")


def clade(occ: DataFrame, terms: tuple[str, ...] = DINOSAURS) -> DataFrame:
    """Dated occurrences with one of ``terms`` as class, order or phylum."""
    return occ.filter((F.col("class").isin(*terms) | F.col("order").isin(*terms) | F.col("phylum").isin(*terms)) & F.col("mid_ma").isNotNull())


def clade_stats(occ: DataFrame, terms: tuple[str, ...] = DINOSAURS) -> DataFrame:
    span = F.concat(whole_text(F.max("max_ma")), F.lit(" - "), whole_text(F.min("min_ma")), F.lit(" Ma"))
    return clade(occ, terms).agg(F.count_distinct("genus").alias("total_genera"), F.count("*").alias("total_occurrences"), span.alias("time_range"))


def clade_top_genera(occ: DataFrame, terms: tuple[str, ...] = DINOSAURS, n: int = 10) -> DataFrame:
    return clade(occ, terms).filter("genus is not null").groupBy("genus").agg(F.count("*").alias("occurrences")).orderBy(F.desc("occurrences"), "genus").limit(n)


def clade_diversity(occ: DataFrame, terms: tuple[str, ...] = DINOSAURS, width: float = 5.0) -> DataFrame:
    """Genera per bin, oldest first."""
    return clade(occ, terms).groupBy(bin_to("mid_ma", width).alias("time_bin")).agg(F.count_distinct("genus").alias("diversity")).orderBy(F.desc("time_bin"))
