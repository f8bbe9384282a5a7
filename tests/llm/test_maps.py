"""Maps of hashed values: what they let through, and what they leave in plans."""

from pyspark.sql import functions as F

from quire.llm import exact_dedup, ngram_join
from quire.llm.common import bit_map


def test_a_map_lets_all_its_values_through_and_few_others(spark):
    ids = spark.range(0, 4002, 2)
    held, none = bit_map(ids, "id"), bit_map(ids.limit(0), "id")
    rows = spark.range(4000).withColumn("both", F.array("id", F.col("id") + 1))
    made = rows.select("id", held(F.col("id")).alias("one"), F.size(held.among("both")).alias("n"), none(F.col("id")).alias("none")).collect()
    assert all(r.one for r in made if r.id % 2 == 0) and sum(r.one for r in made if r.id % 2) < 20
    assert all(r.n >= 1 for r in made) and sum(r.n > 1 for r in made) < 40 and not any(r.none for r in made)


def test_plans_do_not_spell_maps_out(spark):
    """The driver holds the text of each query's plan."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 2 * 7 + k) % 997}" for k in range(30))) for i in range(40)], "doc_id long, text string")
    for made in (exact_dedup.deduplicate(docs), ngram_join.one_of_each(docs)):
        assert len(made._jdf.queryExecution().toString()) < 100_000 and made.count() == 20
