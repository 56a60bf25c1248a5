"""Corpus preparation in four stages over ``documents``.

1. ``quality``: the classifier drops the documents that it rejects (predicted 0).
2. ``near_dedup``: of each group the document with the least key stays (one without a key only if none has one).
   Texts are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more; candidates are SimHash groups
   and, as those miss most edits in one piece, texts that share a band of minwise values.
3. ``personal_data``: spans are masked in the texts; ``n_chars`` follows.
4. ``packing``: the texts that are left become token sequences; a row for each piece.

Each stage's rows are written as Parquet to the shared folder and read again.  All stages but the last return the columns of
documents.  Rows are told apart by all their columns, as they may have no key or share one: rows alike in every column are one
document, and different texts under one key, or without a key, all stay unless they are near copies.  A null text counts as empty and
stays null; texts of any length are read whole; further columns, whatever their names and types, pass through all stages but the last one,
which reads keys and texts only; empty tables give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import near_copies, nbsvm, packing, pii
from strata.llm.common import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = nbsvm.train(docs, labels, "quality", max_rows=8_000)
    marked = nbsvm.score(docs.withColumnsRenamed({c: f"doc_{c}" for c in docs.columns}), model, threshold=0.7, text="doc_text", key="doc_doc_id")
    return marked.filter("predicted = 1").select(*(F.col(f"doc_{c}").alias(c) for c in docs.columns))


def hashable(frame: DataFrame, name: str):
    """A column that hashes take: maps, variants and what holds them as text (maps in the order of their keys)."""
    column, kind = F.col(f"`{name}`"), frame.schema[name].dataType.simpleString()
    if kind.startswith("map<") and kind.count("map<") == 1 and "variant" not in kind:
        return F.array_sort(F.map_entries(column))
    return F.to_json(F.struct(column)) if "map<" in kind or "variant" in kind else column


def row_key(docs: DataFrame):
    """A key of whole rows: rows share it if they are alike in every column.  It is ordered by ``doc_id``, rows without one last."""
    whole = [*(hashable(docs, c) for c in docs.columns), *(F.col(f"`{c}`").isNull() for c in docs.columns)]  # hashes skip nulls
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(F.lit(1), *whole).alias("a"), F.xxhash64(F.lit(2), *whole).alias("b"))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    k, a, b = (fresh(docs, name) for name in ("_key", "_a", "_b"))
    keyed = docs.withColumn(k, row_key(docs))
    texts = near_copies.components(keyed, least=0.8, shingle_words=5, seed=42, key=k)
    staying = texts.groupBy("root").agg(F.min(k).alias("k")).select(F.col("k.a").alias(a), F.col("k.b").alias(b))
    one = keyed.groupBy(F.col(f"{k}.a").alias(a), F.col(f"{k}.b").alias(b)).agg(F.first(F.struct(*docs.columns)).alias("row"))  # rows alike in all columns, joined before the shuffle
    return one.join(staying, [a, b], "left_semi").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.redact(docs)
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return masked if length is None else masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, limits=packing.Limits(tokens=1024))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", pack_sequences)]

#: SQL expresses neither the classifier nor the fingerprints; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return materialise(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
