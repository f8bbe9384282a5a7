"""Files as pages: images are decoded by Spark, plain text is split at form feeds, PDF goes to a pluggable reader."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.errors import EngineNotAvailable, UnsupportedFile
from quire.functions.text import has_meaningful_text
from quire.sources import frames as page_frames

IMAGES, PDF = ("jpg", "jpeg", "png", "bmp", "tif", "tiff"), ("pdf",)
PAGE = "doc_id string, page_index int, embedded_text string, image binary, width int, height int"


def kind(path: Column) -> Column:
    """"image", "pdf", or an error: unsupported files stop the job."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix.isin(*IMAGES), "image").when(suffix.isin(*PDF), "pdf").otherwise(F.raise_error(F.concat(F.lit("unsupported file: "), path)).cast("string"))


def stem(path: Column) -> Column:
    """The file's name without its suffix: what to call an exported file."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?$", 1)


def frames(content: bytes) -> int:
    """Frames of a TIFF file: the length of its chain of directories (0: not one)."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(content[:4])
    if order is None:
        return 0
    at, seen = struct.unpack_from(order + "I", content, 4)[0], set()
    while at and at not in seen and at + 2 <= len(content):
        seen.add(at)
        end = at + 2 + 12 * struct.unpack_from(order + "H", content, at)[0]
        at = struct.unpack_from(order + "I", content, end)[0] if end + 4 <= len(content) else 0
    return len(seen)


def framed(spark: SparkSession, path: str, dpi: int = 300, pixels: bool = True) -> DataFrame:
    """``frames.SCHEMA`` of image and text files: a row a frame. Without ``pixels`` only headers are read, which is what page counts need."""
    page_frames.register(spark)
    return spark.read.format("book_pages").option("dpi", dpi).option("pixels", str(pixels).lower()).load(path)


def images(spark: SparkSession, path: str, dpi: int = 300) -> DataFrame:
    """One page a frame, with its pixels as blue, green, red bytes; ``doc_id`` is the path, so files of one name stay apart.

    Frames of TIFF files are read by the format of ``frames``, a task each; others by Spark's decoder. A file that can't be decoded stops the job.
    """
    suffixes = {x for x in page_frames.OTHER for x in (x, x.upper())}
    read = spark.read.format("image").option("pathGlobFilter", "*.{" + ",".join(sorted(suffixes)) + "}").load(path).select("image.*")
    bad = F.raise_error(F.concat(F.lit("not an image: "), F.col("origin"))).cast("string")
    rows = read.select(F.when(F.col("height") < 1, bad).otherwise(F.col("origin")).alias("doc_id"), F.lit(0).alias("page_index"), F.lit(None).cast("string").alias("embedded_text"), F.col("data").alias("image"), "width", "height")
    if not any(page_frames.suffix_of(p) in page_frames.TIFF for p in suffix_paths(spark, path)):
        return rows
    page_frames.planned(path, page_frames.TIFF)  # says here and now what no image is
    tiff = framed(spark, path, dpi).filter("image is not null")
    return rows.unionByName(tiff.select(*rows.columns))


def suffix_paths(spark: SparkSession, path: str) -> list[str]:
    """One path for each suffix below a path: only names are read, and there are as many rows as suffixes."""
    names = spark.read.format("binaryFile").load(path).select("path")
    return [r[0] for r in names.groupBy(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).agg(F.min("path")).select("min(path)").limit(100).collect()]


def uploads(spark: SparkSession, path: str, max_mb: int = 300) -> DataFrame:
    """Files of a folder that may be taken: known kinds, not empty, not too large. Only names and sizes are read; see ``with_page_counts``."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length")
    known = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGES, *PDF)
    return rows.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).withColumn("accepted", known & (F.col("length") > 0) & (F.col("length") <= max_mb * 1024 * 1024))


def with_page_counts(spark: SparkSession, files: DataFrame, path: str, reader: Callable[[bytes], Iterable[tuple[str | None, bytes | None, int, int]]] | None = None) -> DataFrame:
    """``uploads`` with ``n_pages``: of PDF files by the reader, null for other kinds and where there is no reader. Files meet their counts by path."""
    if reader is None:
        return files.withColumn("n_pages", F.lit(None).cast("long"))
    counts = page_counts(pdf_pages(spark, path, reader).select("doc_id")).withColumnRenamed("doc_id", "path")
    return files.join(counts, "path", "left")


def pdf_pages(spark: SparkSession, path: str, reader: Callable[[bytes], Iterable[tuple[str | None, bytes | None, int, int]]] | None = None) -> DataFrame:
    """Pages of PDF files by ``reader`` (bytes to text, image, width, height of each page); without one there is no engine."""
    if reader is None:
        raise EngineNotAvailable("reading PDF needs a reader")

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["doc_id"], frame["content"], strict=True):
                rows = [(name, i, *page[:2], *page[2:]) for i, page in enumerate(reader(content))]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGE.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select(F.col("path").alias("doc_id"), "content").mapInPandas(run, PAGE)


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of text files, parted by form feeds."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,TXT}").load(path).select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))
    return files.select("doc_id", F.posexplode(F.split("text", "\f")).alias("page_index", "embedded_text"))


def pages(spark: SparkSession, path: str, reader: Callable[[bytes], Iterable[tuple[str | None, bytes | None, int, int]]] | None = None, dpi: int = 300) -> DataFrame:
    """``PAGE`` columns of a file, or of all files of a folder: images, PDF by the reader, plain text (txt). Other files stop the job.

    Only names are read to find the kinds; one job lists distinct suffixes.
    """
    found = {page_frames.suffix_of(p) for p in suffix_paths(spark, path)}
    if unknown := found - {*IMAGES, *PDF, "txt"}:
        raise UnsupportedFile(f"unsupported files: {', '.join(sorted(unknown))}")
    if not found:
        raise UnsupportedFile(f"no files in {path}")
    columns = [x.split()[0] for x in PAGE.split(", ")]
    parts = []
    if found & set(IMAGES):
        parts.append(images(spark, path, dpi).select(*columns))
    if found & set(PDF):
        parts.append(pdf_pages(spark, path, reader).select(*columns))
    if "txt" in found:
        empty = {"image": "binary", "width": "int", "height": "int"}
        parts.append(text_pages(spark, path).select("doc_id", "page_index", "embedded_text", *[F.lit(None).cast(t).alias(n) for n, t in empty.items()]))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def page_counts(pages: DataFrame) -> DataFrame:
    """``doc_id, n_pages``."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))


def block_texts(blocks: DataFrame) -> DataFrame:
    """``doc_id, page_index, embedded_text`` out of the blocks of pages (``ord, kind, text``): text blocks (kind 0) that aren't blank, parted by
    blank lines."""
    bare = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    real = blocks.filter("kind = 0").withColumn("bare", bare).filter("bare <> ''")
    return real.groupBy("doc_id", "page_index").agg(F.expr("listagg(bare, '\n\n') WITHIN GROUP (ORDER BY ord)").alias("embedded_text"))


def text_layers(pages: DataFrame, least_share: float = 0.6) -> DataFrame:
    """``doc_id, has_text_layer``: whether enough of a document's pages carry text."""
    return pages.groupBy("doc_id").agg((F.avg(has_meaningful_text(F.col("embedded_text")).cast("double")) >= least_share).alias("has_text_layer"))


def routed(pages: DataFrame, least_share: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Pages of documents that have a text layer, without their pixels, and those of the others.

    Which is decided on ids and a flag alone. Pixels meet the decision page by page, never by their document, whose pages would gather in one task; they cross the
    network once, into as many tasks as the session shuffles into, however few bytes they have: what comes next takes long for each page. (A join would leave its planner
    free to move them by other keys, or not at all.)
    """
    flags = pages.select("doc_id", "page_index", has_meaningful_text(F.col("embedded_text")).cast("double").alias("has_text"))
    layered = flags.groupBy("doc_id").agg((F.avg("has_text") >= least_share).alias("has_text_layer"))
    texts = pages.withColumn("image", F.lit(None).cast("binary")).join(layered.filter("has_text_layer"), "doc_id", "left_semi")
    scanned = flags.join(layered.filter("not has_text_layer"), "doc_id", "left_semi").select("doc_id", "page_index").distinct()
    both = pages.withColumn("__mark", F.lit(False)).unionByName(scanned.withColumn("__mark", F.lit(True)), allowMissingColumns=True)
    spread = both.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "page_index")
    wanted = spread.withColumn("__wanted", F.max("__mark").over(Window.partitionBy("doc_id", "page_index")))
    return texts, wanted.filter("__wanted and not __mark").drop("__mark", "__wanted")
