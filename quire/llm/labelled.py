"""A bounded sample of labelled texts, for the classifiers that are trained here."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> pa.Table:
    """``text, label`` of ``bound`` rows at most whose label is known and that aren't held out.

    The ids are the smallest by a hash of the id among the labelled ones, so the choice is the same at every run. They are a table of
    ``bound`` rows, which is why the texts can be met by a broadcast.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    ids = known.select(F.col(id_col).cast("long").alias("__id"), F.col(label).alias("__label")).orderBy(F.xxhash64("__id"), "__id", "__label").limit(bound)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return texts.join(F.broadcast(ids), "__id").orderBy(F.xxhash64("__id"), "__id", "__text").select(F.col("__text").alias("text"), F.col("__label").alias("label")).toArrow()
