"""From documents to packed training sequences: language ID, exact and near duplicates, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame that is written as Parquet into the shared folder and read again
as the next one's ``docs``. All but the last keep the columns of documents. Run on an empty table, every stage gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import exact_dedup, language_id, ngram_join, packing, pii
from quire.llm.common import drop, keep
from quire.llm.token_cache import tokenizer_path


#: Rows of an Arrow batch, and parts in the encoder's cache: less than operators take by themselves, since a worker that all stages share keeps what each has needed at most.
BATCH_ROWS, CACHE = 500, 100_000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def told_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, no letters, or hardly better than a guess) go; without labelled rows, only those without letters."""
    _small_batches(spark)
    return language_id.accepted(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 on shingles of five words join, the one with the smallest id stays."""
    _small_batches(spark)
    return ngram_join.one_of_each(docs, width=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that reveal it are replaced in the texts; no document goes."""
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in sequences of 1024 ids; a null text is its end id alone."""
    _small_batches(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), 1024, 2, cache=CACHE)


STAGES = [
    ("language_id", told_language),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("pii", personal_data),
    ("packing", sequences),
]

#: Stages of learned models and of a tokeniser library have no SQL; a test holds the rows of ``run`` against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        after = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
