"""Repeated rows, clashing columns, very long texts and empty tables, operator by operator."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import ann, bpe, exact_dedup, language_id, ngram_join, packing, pii, quality, rans_store, toxicity
from quire.llm.token_cache import tokenizer_path

HF, TIK = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_multi_50k.tiktoken")
#: Names that operators give to columns of their own.
CLASH = ["score", "held_out", "predicted", "n", "d", "part", "label", "kind", "row", "copy", "term", "print", "length", "rank", "chunk", "uid", "found", "w", "spot"]


@pytest.fixture(scope="module")
def words():
    r = random.Random(8)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(400)]


@pytest.fixture(scope="module")
def docs(spark, words):
    r = random.Random(9)
    base = " ".join(r.choices(words, k=60))
    rows = [(1, base), (1, base), (2, base + " end"), (3, None), (4, ""), (5, "you idiot " * 20), (6, " ".join(r.choices(words, k=30)))]
    rows += [(i, " ".join(r.choices(words, k=25)) + (" you stupid idiot" if i % 3 == 0 else "")) for i in range(10, 130)]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else None, "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    for name in CLASH:
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(3).cache()


def test_repeated_rows_and_clashing_columns(spark, docs):
    n = docs.count()
    ones = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())[1]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1 - int(i % 3 == 0)) for i in range(10, 130)], "doc_id long, toxic int, quality int").withColumn("score", F.lit("x"))
    made = {
        "op1": rans_store.write_and_read(spark, docs, HF), "op2": pii.detect(docs), "op3": ngram_join.classes(docs), "op4": language_id.identify(docs), "op7": packing.pack(docs, HF, 64, 2).filter("piece = 0"),
        "op8": toxicity.score(docs, labels), "op9": exact_dedup.mark(docs), "op10": bpe.round_trip(docs, TIK, keep_ids=False), "op12": quality.score(docs, labels),
    }
    for name, df in made.items():
        assert df.count() == n and ones(df) == 2, name
    assert {tuple(r) for r in made["op3"].filter("doc_id in (1, 2)").select("component_id").collect()} == {(1,)}


@pytest.mark.parametrize("filtered", [language_id.accepted, exact_dedup.deduplicate, ngram_join.one_of_each, pii.sanitise])
def test_filters_keep_columns_and_take_empty_tables(docs, filtered):
    got = filtered(docs)
    assert got.columns == docs.columns and set(r.score for r in got.select("score").collect()) == {"x"}
    assert filtered(docs.filter("doc_id < 0")).collect() == []


def test_vectors_with_clashing_columns(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0], i % 3, "x", "x", "x") for i in range(60)] + [(3, [3.0, 3.0, 1.0], 0, "x", "x", "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, query_id string, score string, part string")
    got = ann.nearest(df, df.filter("vec_id % 20 = 0"), 4).collect()
    assert Counter(r.query_id for r in got) == {0: 4, 20: 4, 40: 4} and ann.nearest(df.filter("vec_id < 0"), df, 4).collect() == []


def test_very_long_texts(spark, words):
    r = random.Random(10)
    long = " ".join(r.choices(words, k=300_000))
    rows = [(1, long), (2, long + " mail ann@corp.example end"), (3, "you stupid idiot " + long)] + [(i, " ".join(r.choices(words, k=30)) + (" you idiot" if i % 2 else "")) for i in range(10, 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 80)], "doc_id long, toxic int")
    assert toxicity.score(df, labels).count() == len(rows)
    clean = {x.doc_id: x.text for x in pii.sanitise(df).collect()}
    assert clean[2].endswith("mail [EMAIL] end") and clean[1] == long
    assert {x.doc_id for x in ngram_join.one_of_each(df, width=5, num=80, den=100).collect()} == {1, *range(10, 80)}
    assert {x.doc_id for x in exact_dedup.deduplicate(df.union(df.filter("doc_id = 1").withColumn("doc_id", F.lit(9).cast("long")))).collect()} == {2, 3, 9, *range(10, 80)}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
