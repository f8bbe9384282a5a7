"""Preparing blocks for a translation engine, reading its tagged replies and putting the results back. No engine is called here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.tables import kept

#: Characters of a batch; a longer block goes alone.
LIMIT = 3000
#: Ordinals of a document that are summed up together; limits of characters of a stretch whose pointers are found together.
CHUNK, STRETCH = 10_000, 64
#: Tagged blocks of a reply; the number must be the same at both ends.
TAGGED = r"(?s)<<<BLOCK_(\d+)>>>\s*(.*?)\s*<<<END_\1>>>"

c = F.col


def _offsets(rows: DataFrame) -> DataFrame:
    """``doc_id, ordinal, n, r, e`` out of ``doc_id, ordinal, n``: each block's rank in its document, from 0, and the characters before it. A document is summed up in
    chunks of ``CHUNK`` ordinals; only their totals meet."""
    chunked = rows.withColumn("chunk", F.floor(c("ordinal") / CHUNK))
    order = Window.partitionBy("doc_id", "chunk").orderBy("ordinal")
    own = chunked.withColumn("r", F.row_number().over(order) - 1).withColumn("e", F.sum("n").over(order) - c("n"))
    chunks = Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = chunked.groupBy("doc_id", "chunk").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    before = totals.select("doc_id", "chunk", F.coalesce(F.sum("k").over(chunks), F.lit(0)).alias("k"), F.coalesce(F.sum("s").over(chunks), F.lit(0)).alias("s"))
    return own.join(before, ["doc_id", "chunk"]).select("doc_id", "ordinal", "n", (c("r") + c("k")).alias("r"), (c("e") + c("s")).alias("e"))


def _next_starts(nodes: DataFrame, limit: int) -> DataFrame:
    """``doc_id, r, to``: the block that begins the next batch, if one begins at block ``r``: the last one whose characters before it are at most ``limit`` more than
    those before ``r``, or the one behind ``r``. A document is cut into stretches of ``STRETCH`` limits, each with what lies up to a limit behind it."""
    wide = STRETCH * limit
    stretch = lambda e: F.floor(e / wide)
    own, halo = stretch(c("e")), stretch(c("e") - limit)
    copies = F.when(own == halo, F.array(own)).otherwise(F.array(own, halo))
    seen = nodes.select("doc_id", "r", "e", own.alias("own"), F.explode(copies).alias("stretch"))
    reach = F.max("r").over(Window.partitionBy("doc_id", "stretch").orderBy("e").rangeBetween(Window.currentRow, limit))
    return seen.withColumn("to", F.greatest(reach, c("r") + 1)).filter(c("own") == c("stretch")).select("doc_id", "r", "to")


def numbered(blocks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id, block_ordinal, batch_id, local_i`` of the blocks that aren't blank. Only ids and lengths are looked at, and no document gathers in one row or task.

    A batch begins anew where the next block would overflow it. So from every block there is a pointer to where the next batch would begin, and the batches of a
    document are what is reached from its first block. Pointers are doubled: after k rounds the batches up to the 2^k-th are known, so that a
    document of a million batches takes twenty rounds of joins over narrow rows.
    """
    real = blocks.filter(strip(c("text")) != "").select("doc_id", c("block_ordinal").cast("long").alias("ordinal"), F.length("text").cast("long").alias("n"))
    nodes = kept(_offsets(real), "batch-nodes")
    # a last node for each document, where its text ends
    ends = nodes.groupBy("doc_id").agg((F.max("r") + 1).alias("r"), F.max(c("e") + c("n")).alias("e"))
    pointers = kept(_next_starts(nodes.select("doc_id", "r", "e").unionByName(ends), limit).join(ends.select("doc_id", c("r").alias("last")), "doc_id").select("doc_id", "r", F.least("to", "last").alias("to"), "last"), "batch-pointers")
    first = pointers.filter(c("r") < c("last"))
    starts, jump = nodes.filter("r = 0").select("doc_id", "r", F.lit(0).cast("long").alias("batch_id")), first
    # two batches that follow each other hold more than a limit, so there are at most so many
    most = ends.agg(F.max(2 * F.floor(c("e") / limit) + 2)).first()[0] or 0
    for k in range(max(0, int(most - 1).bit_length())):
        on = jump.filter(c("to") < c("last")).select("doc_id", "r", "to", "last")
        starts = starts.unionByName(starts.join(on, ["doc_id", "r"]).select("doc_id", c("to").alias("r"), (c("batch_id") + (1 << k)).alias("batch_id")))
        jump = on.join(jump.select("doc_id", c("r").alias("to"), c("to").alias("then")), ["doc_id", "to"]).select("doc_id", "r", c("then").alias("to"), "last")
        if k % 3 == 2:  # the plan doubles too
            starts, jump = kept(starts, "batch-starts"), kept(jump, "batch-jumps")
    spans = starts.join(first.select("doc_id", "r", "to"), ["doc_id", "r"])
    held = spans.select("doc_id", "batch_id", F.posexplode(F.sequence("r", c("to") - 1)).alias("local_i", "r"))
    return held.join(nodes.select("doc_id", "r", "ordinal"), ["doc_id", "r"]).select("doc_id", c("ordinal").alias("block_ordinal"), "batch_id", c("local_i").cast("long").alias("local_i"))


def batches(blocks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id, block_ordinal, text, batch_id, local_i``: blocks (``doc_id, block_ordinal, text``), in order, fill batches greedily; blank ones are left out, and a block that
    is longer than the limit goes alone. See ``numbered``; texts meet their numbers block by block."""
    own = blocks.select("doc_id", c("block_ordinal").cast("long").alias("block_ordinal"), "text")
    return own.join(numbered(blocks, limit), ["doc_id", "block_ordinal"]).select("doc_id", "block_ordinal", "text", "batch_id", "local_i")


def prompts(batched: DataFrame, instruction: str) -> DataFrame:
    """``doc_id, batch_id, prompt, max_tokens``."""
    one = F.concat(F.lit("<<<BLOCK_"), c("local_i").cast("string"), F.lit(">>>\n"), c("text"), F.lit("\n<<<END_"), c("local_i").cast("string"), F.lit(">>>"))
    made = batched.withColumn("one", one).groupBy("doc_id", "batch_id").agg(F.expr("listagg(one, '\n') WITHIN GROUP (ORDER BY local_i)").alias("body"), F.sum(F.length("text")).alias("chars"))
    return made.select("doc_id", "batch_id", F.concat(F.lit(instruction + "\n\n"), c("body")).alias("prompt"), F.greatest(F.lit(1024), F.expr("chars div 2")).cast("long").alias("max_tokens"))


def parse_replies(replies: DataFrame) -> DataFrame:
    """``doc_id, batch_id, local_i, translated`` out of ``doc_id, batch_id, reply``; of a tag given twice the last counts."""
    whole, number = F.regexp_extract_all("reply", F.lit(TAGGED), F.lit(2)), F.regexp_extract_all("reply", F.lit(TAGGED), F.lit(1))
    found = replies.select("doc_id", "batch_id", F.posexplode(F.arrays_zip(number.alias("i"), whole.alias("text"))).alias("at", "m"))
    found = found.select("doc_id", "batch_id", c("m.i").cast("long").alias("local_i"), "at", strip(c("m.text")).alias("translated"))
    return found.groupBy("doc_id", "batch_id", "local_i").agg(F.max_by("translated", "at").alias("translated"))


def apply(blocks: DataFrame, batched: DataFrame, parsed: DataFrame) -> DataFrame:
    """``blocks`` with ``text`` translated where there is a translation; others keep theirs."""
    by_block = batched.drop("text").join(parsed, ["doc_id", "batch_id", "local_i"]).select("doc_id", "block_ordinal", "translated")
    return blocks.join(by_block, ["doc_id", "block_ordinal"], "left").withColumn("is_translated", c("translated").isNotNull()).withColumn("text", F.coalesce("translated", "text")).drop("translated")


def language_sample(blocks: DataFrame, most: int = 4000) -> DataFrame:
    """``doc_id, sample``: non-blank blocks joined by spaces, the first characters of them.

    A block and the space behind it are two characters at least, so the sample lies in a document's first ``most / 2`` blocks: each task passes on
    no more of a document than these (a limit of ranks before the shuffle), and of them no more than ``most`` characters each. What moves doesn't grow with a book's length.
    """
    spark, key = blocks.sparkSession, "spark.sql.optimizer.windowGroupLimitThreshold"
    if 0 < int(spark.conf.get(key)) < most // 2 + 1:
        spark.conf.set(key, str(most // 2 + 1))
    order = Window.partitionBy("doc_id").orderBy("block_ordinal")
    head = blocks.filter(strip(c("text")) != "").select("doc_id", "block_ordinal", F.left("text", F.lit(most)).alias("text"))
    head = head.withColumn("r", F.row_number().over(order)).filter(c("r") <= most // 2 + 1)
    before = F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    head = head.withColumn("e", F.coalesce(before, F.lit(0))).filter(c("e") <= most)  # what begins right behind the sample brings the space that ends it
    return head.groupBy("doc_id").agg(F.left(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY block_ordinal)"), F.lit(most)).alias("sample"))


def first_of(blocks: DataFrame, kind: str = "title") -> DataFrame:
    """Each document's first block of a kind."""
    order = Window.partitionBy("doc_id").orderBy("block_ordinal")
    return blocks.filter(c("type") == kind).withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
