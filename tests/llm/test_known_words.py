"""Words that an encoder knows stay known, and token ids move only where they are asked for."""

from quire.llm import queries, rans_store
from quire.llm.token_cache import CachedEncoder, library_encoder, tokenizer_path

HF = tokenizer_path("byte_bpe_50k.json")


def test_a_full_cache_keeps_the_words_at_hand():
    asked = []

    def many(words, known):
        asked.append(set(words))
        return {x: f" {x}".encode() for x in words}

    encode = CachedEncoder(str.encode, many, limit=3)
    for text in ("a b c d e", "x b c f", "x b c g"):
        assert encode([text]) == [text.encode()]
    assert asked == [{"b", "c", "d", "e"}, {"f"}, {"g"}]


def test_results_do_not_depend_on_what_is_known():
    texts = ["uno dos, tres\ncuatro!", "dos tres, 12 ñu", "", "tres\ncuatro dos,", "uno ñu! dos, 12"]
    alone = [library_encoder(HF, limit=10**6)([t])[0] for t in texts]
    small = library_encoder(HF, limit=2)
    assert [small([t])[0] for t in texts * 2] == alone * 2 and len(small.new) < 8


def test_op1_moves_no_ids(spark):
    plan = lambda df: [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInPandas" in x][0]
    made = queries.op1_token_ids(spark, "/root/testdata/sf0.001")
    assert "ids_crc32" in plan(made) and "ids#" not in plan(made)
    docs = spark.createDataFrame([(1, "uno dos"), (2, None)], "doc_id long, text string")
    assert "ids#" in plan(rans_store.write_and_read(spark, docs, HF))
