"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop, keep


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` of every end of an edge: the smallest id that its edges reach.

    Alternates large-star and small-star steps: each node hands its neighbours to the smallest it knows. Rounds grow with the logarithm of
    the longest path; every round is written to the shared folder. An aggregation by node finds minima, which are
    written before the join, so a node with very many edges costs a combined row a task, and the join can split it.
    """
    now = keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "edges-least")  # a plain table: the join can split a large key
        # large star: larger neighbours move to the smallest
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large, "edges-large")
        # small star: a node and its smaller neighbours move to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        nxt = keep(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = nxt.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        same = state == before and nxt.exceptAll(now).isEmpty()  # equal sums alone might be chance
        before = state
        drop(now, large, least)
        now = nxt
        if same:
            break
    ids = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    roots = ids.select(F.col("component").alias("id"), "component").distinct()
    return keep(ids.unionByName(roots).distinct(), "components")
