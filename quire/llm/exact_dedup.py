"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A text (A-Z lower-cased) is cut into blocks of ``BLOCK`` characters. Distinct blocks, in order of their fingerprints, get whole numbers
as names; then neighbouring names are paired, distinct pairs are sorted and named, and so on until every document is one
name. Equal names of equal length mean equal texts, and the reverse.

A block's name is its place in the order of two 64-bit fingerprints. That these tell all blocks of the corpus apart is not assumed:
all distinct blocks are gathered once with their fingerprints, and if two different blocks share one, the work starts anew
with other seeds. So the contents of blocks cross the network once, with equal ones of a task merged before; all else is narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import bit_map, drop, fresh, keep

#: Characters of a block.
BLOCK = 4096
#: Windows that order names; a fixed number, so that names depend on nothing but the data.
BUCKETS = 1 << 14
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _blocks(text: Column, size: int) -> Column:
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def _prints(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(block, F.lit(2 * seed)), F.xxhash64(block, F.lit(2 * seed + 1))]


def _named(distinct: DataFrame, a: str, b: str) -> DataFrame:
    """Whole numbers for distinct pairs of whole numbers, by their order within buckets of the first."""
    bucket = F.pmod(F.xxhash64(a, b), F.lit(BUCKETS))
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy(a, b)).cast("long")
    return distinct.withColumn("__bucket", bucket).select(a, b, (rank * BUCKETS + F.col("__bucket")).alias("name"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``uid, doc_id, text_sha256, n_blocks, name`` of each row; equal (n_blocks, name) if and only if the normalised texts are equal."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    for seed in range(8):
        cut = source.select(F.explode(_blocks(F.col("text"), block)).alias("block"))
        h1, h2 = _prints(F.col("block"), seed)
        prints = keep(cut.select(h1.alias("h1"), h2.alias("h2"), "block").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n")), "dedup-prints")
        if prints.filter("n > 1").isEmpty():
            break
        drop(prints)
    else:
        raise RuntimeError("fingerprints of blocks clash under every seed")
    names = keep(_named(prints.select("h1", "h2"), "h1", "h2"), "dedup-names")
    drop(prints)

    cut = _blocks(F.col("text"), block)
    rows = source.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.transform(cut, lambda b: F.struct(*[h.alias(n) for h, n in zip(_prints(b, seed), ("h1", "h2"), strict=True)])).alias("blocks"))
    rows = keep(rows.withColumn("uid", F.monotonically_increasing_id()), "dedup-rows")
    level = rows.select("uid", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("pos", "b")).select("uid", "n_blocks", "pos", "b.h1", "b.h2")
    level = level.join(names, ["h1", "h2"]).select("uid", "n_blocks", F.col("n_blocks").alias("n"), "pos", "name")
    level = keep(level, "dedup-level")
    drop(names)
    done = level.filter("n = 1").select("uid", "n_blocks", "name")
    longest = level.agg(F.max("n")).first()[0] or 0
    while longest > 1:
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = level.filter("n > 1").groupBy("uid", "n_blocks", "n", (F.col("pos") / 2).cast("int").alias("half")).agg(side(0).alias("left"), F.coalesce(side(1), F.lit(-1)).alias("right"))
        pairs = keep(pairs, "dedup-pairs")
        names = _named(pairs.select("left", "right").distinct(), "left", "right")
        nxt = pairs.join(names, ["left", "right"]).select("uid", "n_blocks", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("half").alias("pos"), "name")
        level = keep(nxt, "dedup-level")
        drop(pairs)
        done = done.unionByName(level.filter("n = 1").select("uid", "n_blocks", "name"))
        longest = -(-longest // 2)
    return done.join(rows.select("uid", "doc_id", "text_sha256"), "uid")


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: a row for every row of ``docs``.

    Of equal texts the row with the largest id stays; of rows that share this id too, one of them. A null id is smaller than any other. A null
    text is an empty one, and all empty texts are equal. Other columns are not read. An empty table gives no rows.
    """
    rows = keep(identities(docs, id_col, text_col, block), "dedup-identities")
    low = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    groups = rows.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max_by("uid", low).alias("keep_uid"))
    groups = keep(groups, "dedup-groups")  # a plain table: the join can split a large group
    return rows.join(groups, ["n_blocks", "name"]).select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``mark`` keeps; of rows that share text and id, null or not, one of them.

    Rows that go, or are there again, are told by id and text. A map of their ids, of fixed size, spares most other rows the join.
    """
    marked = mark(docs, id_col, text_col).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    key, sha, stays = (fresh(x, docs) for x in ("row_id", "row_sha", "row_stays"))
    told = keep(marked.filter("n > 1 or not kept").select("doc_id", "text_sha256", F.col("kept").alias(stays)), "dedup-told")
    may_be = bit_map(told, "doc_id")
    row_id = F.col(id_col).cast("long")
    rows = docs.filter(may_be(row_id)).withColumn(key, row_id).withColumn(sha, F.sha2(normalised(F.col(text_col)), 256))
    met = rows.join(told, rows[key].eqNullSafe(told["doc_id"]) & (rows[sha] == told["text_sha256"]), "left").filter(F.coalesce(told[stays], F.lit(True)))
    once = met.dropDuplicates([key, sha])  # rows that weren't told are there once
    return docs.filter(~may_be(row_id)).unionByName(once.select(*[rows[c] for c in docs.columns]))
