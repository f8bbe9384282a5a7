"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import ann, bpe, exact_dedup, hard_negatives, language_id, ngram_join, packing, pii, quality, rans_store, secret_scan, toxicity, vector_codes
from quire.llm.token_cache import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document through rANS files and back; see ``rans_store``."""
    docs = _table(spark, sf_dir, "documents")
    return rans_store.write_and_read(spark, docs, tokenizer_path("byte_bpe_50k.json"), with_ids=False)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and revealing terms of every document; see ``pii``."""
    return pii.detect(_table(spark, sf_dir, "documents")).drop("found")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard index of 0.85 or more; see ``ngram_join``."""
    return ngram_join.classes(_table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; see ``language_id``."""
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found for every hundredth vector; see ``ann``."""
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 100 = 0"), 10)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; see ``secret_scan``."""
    return secret_scan.scan(_table(spark, sf_dir, "documents")).drop("found")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece's place in sequences of 1024 ids; see ``packing``."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 1024, 2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; see ``toxicity``."""
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which copy of every document stays; see ``exact_dedup``."""
    return exact_dedup.mark(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment-tree BPE and back; see ``bpe``."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), keep_ids=False)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every vector; see ``vector_codes``."""
    return vector_codes.encode(_table(spark, sf_dir, "embeddings"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; see ``quality``."""
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; see ``hard_negatives``. Every seventh row has its label moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_ids": op1_token_ids,
    "op2_pii": op2_pii,
    "op3_ngram_join": op3_ngram_join,
    "op4_language_id": op4_language_id,
    "op5_nearest": op5_nearest,
    "op6_secret_scan": op6_secret_scan,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_toxicity": op8_toxicity,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_vector_codes": op11_vector_codes,
    "op12_quality": op12_quality,
    "op13_hard_negatives": op13_hard_negatives,
}


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Every round written out: distances of all entries, the nearest, and floors of means."""
    finite = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, label, len(embedding) // {parts} AS w, embedding AS e FROM embeddings WHERE {finite})",
        f"x AS MATERIALIZED (SELECT vec_id, (i - 1) // w AS p, (i - 1) % w AS pos, CAST(floor({scale} * CAST(e[i] AS DOUBLE)) AS BIGINT) AS c FROM (SELECT vec_id, w, e, unnest(range(1, len(e) + 1)) AS i FROM v))",
        f"b0 AS MATERIALIZED (SELECT p, n AS entry, pos, c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM v ORDER BY vec_id LIMIT {entries}) USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT x.vec_id, x.p, b.entry, sum((x.c - b.c) * (x.c - b.c)) AS dist FROM x JOIN b{r} b ON b.p = x.p AND b.pos = x.pos GROUP BY ALL)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, entry, CAST(dist AS BIGINT) AS dist FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY dist, entry) = 1)")
        if r < rounds:
            mean = "CAST(floor(CAST(sum(x.c) AS DOUBLE) / count(*)) AS BIGINT)"
            steps.append(f"m{r} AS (SELECT x.p, a.entry, x.pos, {mean} AS c FROM x JOIN a{r} a USING (vec_id, p) GROUP BY ALL)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.entry, b.pos, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.entry = b.entry AND m.pos = b.pos)")
    return f"""WITH {', '.join(steps)},
        coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
        books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, entry, pos)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN v USING (vec_id), books"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_join": f"""
        WITH RECURSIVE
        w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                                             ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS t FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        reach(id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id),
        least AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least.c AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN least ON least.id = w.doc_id
    """,
    "op5_nearest": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y)) AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
    """,
    "op11_vector_codes": _codes_sql(),
    "op13_hard_negatives": """
        WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
             s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
             p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
             n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
                   FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
    """,
    "op9_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t
    """,
}
