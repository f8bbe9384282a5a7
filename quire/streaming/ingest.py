"""Files as they arrive: every new text file goes through the paragraph plan once, with its progress in a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.text import blank_line_paragraphs


def paragraphs(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of ``doc_id, para, text`` out of text files under ``path``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_a_batch).load(path)
    text = F.decode("content", "UTF-8")
    return files.filter("length > 0").select(F.col("path").alias("doc_id"), F.posexplode(blank_line_paragraphs(text)).alias("para", "text"))


def run(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Takes what is there and stops; the checkpoint remembers which files are done, across restarts."""
    return paragraphs(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
