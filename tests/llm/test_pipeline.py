"""The pipeline against a plain version of its decisions."""

from __future__ import annotations

import random

import public_tokenizers as P
from pyspark.sql import functions as F
from test_near_copies import planted, shingles, similarity
from test_packing import whole
from tokenizers import Tokenizer

import corpus_pipeline
from strata.llm import nbsvm, pii

STAGES = dict(corpus_pipeline.STAGES)


def near_groups(keys, texts):
    """Least key of each text's component of links of 0.8 or more, over all pairs of whole shingle sets."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and similarity(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return [min(k for k, r in zip(keys, root) if r == mine) for mine in root]


def rows():
    rng = random.Random(4)
    words = "river stone light paper winter garden silver house quiet letter morning copper window".split()
    out = []
    for k in range(300):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        if k % 6 == 0:
            text = [w + "###" for w in text]
        if k % 10 == 1:
            text.append("write to a.b@mail.example.com")
        out.append((k, " ".join(text)))
    return out + [(1000 + k, out[1][1]) for k in range(5)] + [(1, out[1][1])]


def test_stages_and_run(spark, make, tmp_path):
    data = rows()
    docs = make(data).drop("fingerprint", "score")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(k, int("###" not in t)) for k, t in data if k % 4], "doc_id long, quality int")
    labels.distinct().write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    good = STAGES["quality"](spark, docs, str(tmp_path)).persist()
    assert good.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in good.collect()) == sorted((k, t) for k, t in data if "###" not in t)

    single = STAGES["near_dedup"](spark, good, str(tmp_path)).persist()
    left = sorted({(r.doc_id, r.text) for r in good.collect()})
    groups = near_groups([k for k, _ in left], [t for _, t in left])
    want = [(k, t) for (k, t), g in zip(left, groups) if k == g]
    assert single.columns == docs.columns and sorted((r.doc_id, r.text) for r in single.collect()) == want

    clean = STAGES["personal_data"](spark, single, str(tmp_path)).persist()
    masked = {k: pii.mask(t) for k, t in want}
    assert clean.columns == docs.columns and {r.doc_id: r.text for r in clean.collect()} == masked
    assert all(r.n_chars == len(r.text) for r in clean.collect()) and any("[EMAIL]" in t for t in masked.values())

    whole(corpus_pipeline.run(spark, str(tmp_path)).collect(), masked, Tokenizer.from_file(P.path("byte_bpe_50k.json")))


def test_clashing_columns_nulls_and_empty_tables(spark, docs, empty, tables):
    kept = STAGES["quality"](spark, docs, tables)
    assert kept.columns == docs.columns
    single = STAGES["near_dedup"](spark, docs, tables)
    assert single.columns == docs.columns and single.groupBy("doc_id").count().filter("count > 1").count() == 0
    assert STAGES["personal_data"](spark, docs, tables).filter("text is null").count() == docs.filter("text is null").count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, tables)
        assert out.count() == 0 and (name == "packing" or out.columns == empty.columns)


def test_rejected_documents_go(spark, docs, tables):
    model = nbsvm.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    scored = nbsvm.score(docs.select("doc_id", "text"), model)
    assert STAGES["quality"](spark, docs, tables).count() == scored.filter(F.col("predicted") == 1).count()


def test_rows_without_a_key_or_with_a_shared_one_stay(spark, make):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)) for _ in range(30)]
    data = [(None, t) for t in texts[:10]] + [(7, t) for t in texts[10:20]] + [(k, t) for k, t in enumerate(texts[20:], 100)]
    copies = [(None, texts[0]), (None, texts[25]), (6, texts[12]), (8, texts[13])]
    want = sorted(data + [(6, texts[12])], key=str)
    want.remove((7, texts[12]))
    single = STAGES["near_dedup"](spark, make(data + copies), "")
    assert sorted(((r.doc_id, r.text) for r in single.collect()), key=str) == want


def test_near_dedup_against_all_pairs(make):
    """Near copies of 0.7 to 0.95 with keys, without one and with a shared one, and repeated rows: one row of each component stays."""
    texts = planted(families=20)
    keys = [None if k % 7 == 3 else 7 if k % 7 == 5 else k + 10 for k in range(len(texts))]
    data = list(zip(keys, texts)) + [(keys[k], texts[k]) for k in range(0, 60, 4)]
    groups = near_groups(list(range(len(texts))), texts)
    kept = [(r.doc_id, r.text) for r in STAGES["near_dedup"](None, make(data), "").collect()]
    assert len(kept) == len(set(kept)) == len(set(groups)) < 60
    number = {t: k for k, t in enumerate(texts)}
    assert {groups[number[t]] for _, t in kept} == set(groups)
    for key, text in kept:
        some = [k for k, g in zip(keys, groups) if g == groups[number[text]]]
        assert key == min((k for k in some if k is not None), default=None)


def test_columns_named_like_helpers(spark):
    rows = [(1, "one two three four five six", "a", 1, "x"), (2, "one two three four five six", "b", 2, "y"), (3, None, "c", 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _A int, root string")
    kept = STAGES["near_dedup"](spark, docs, "")
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_columns_of_any_type(spark):
    rows = [(1, "a b c", {"x": 1, "y": 2}, [{"k": "v"}]), (1, "a b c", {"y": 2, "x": 1}, [{"k": "v"}]), (2, "d e f", None, None), (3, "d e f", {}, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>, nested array<map<string,string>>")
    docs = docs.withColumn("v", F.parse_json(F.lit('{"a": 1}')))
    kept = STAGES["near_dedup"](spark, docs, "")
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b c"), (2, "d e f")]
