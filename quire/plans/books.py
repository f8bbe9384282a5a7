"""From pages to rendered books: lazy plans, hashed by page and then by document."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.config import Config, LayoutConfig
from quire.errors import Cancelled, EngineNotAvailable, UnsupportedFile
from quire.functions.text import blank_line_paragraphs
from quire.operators import images, layout, packages, reconstruct, recognize, render, translators
from quire.sources import files
from quire.tables import kept, path_of

#: Suffixes of formats.
SUFFIXES = {"txt": "txt", "markdown": "md", "html": "html", "docx": "docx", "epub": "epub"}


#: Layout analyzers by name: words and settings to regions in reading order (as ``layout.regions`` gives them).
ANALYZERS: dict[str, Callable[[DataFrame, LayoutConfig], DataFrame]] = {"heuristic": layout.regions}


def from_words(words: DataFrame, config: Config = Config()) -> DataFrame:
    """Blocks of each document out of recognised words."""
    kept = layout.confident(words, config.ocr.min_confidence)
    if config.layout.analyzer not in ANALYZERS:
        raise EngineNotAvailable(f"unknown layout analyzer: {config.layout.analyzer}")
    return reconstruct.merge_paragraphs(reconstruct.page_blocks(ANALYZERS[config.layout.analyzer](kept, config.layout)))


def from_images(pages: DataFrame, config: Config = Config(), make: Callable[[], recognize.Engine] | None = None) -> DataFrame:
    """Blocks out of page images: prepared, recognised by the engine, words bold by their strokes; each page by its own size.

    Pages are worked on where they are: ``files.routed`` spreads those of one book over all tasks.
    """
    prepared = images.prepare(pages, config.image).select("doc_id", "page_index", "image", "width", "height")
    # words below the confidence count for nothing, not even for the stroke that is usual in their block
    words = layout.confident(recognize.words(prepared, config, make), config.ocr.min_confidence)
    if config.ocr.detect_bold_italic:
        words = layout.bold_words(words).withColumn("is_bold", F.col("is_bold") | F.col("bold_by_stroke")).drop("bold_by_stroke")
    return from_words(words, config)


def from_text_layer(pages: DataFrame) -> DataFrame:
    """Blocks out of embedded text: paragraphs between blank lines, no titles, no merging."""
    rows = pages.filter("embedded_text is not null").select("doc_id", "page_index", F.posexplode(blank_line_paragraphs(F.col("embedded_text"))).alias("at", "text"))
    number = F.expr("row_number() over (partition by doc_id order by page_index, at) - 1").cast("long")
    run = F.array(F.struct(F.col("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic")))
    return rows.select(
        "doc_id", number.alias("block_ordinal"), F.lit("paragraph").alias("type"), run.alias("runs"), F.lit(1).alias("level"), F.lit(False).alias("list_ordered"),
        F.lit(None).cast("string").alias("footnote_marker"), F.lit(False).alias("first_line_indent"), F.col("page_index").cast("long").alias("source_page"),
    )


def processed(pages: DataFrame, config: Config = Config(), make: Callable[[], recognize.Engine] | None = None, translator: translators.Chat | translators.Direct | None = None, replies: str | None = None) -> DataFrame:
    """Blocks of all documents: those with a text layer from it, others from their images; translated if the settings say so, with the table of ``replies`` if it is named."""
    if config.translation.enabled and translator is None and translators.engine_for(config.translation) is None:
        raise EngineNotAvailable("translation is switched on, but no engine is named")
    texts, scans = files.routed(pages)
    read, seen = from_text_layer(texts), from_images(scans, config, make)
    blocks = read.unionByName(seen.withColumn("source_page", F.col("source_page").cast("long")))
    return translators.translated(blocks, config.translation, translator, store=replies) if config.translation.enabled else blocks


def _html(blocks: DataFrame, lang: str) -> DataFrame:
    return render.to_html_body(blocks).select("doc_id", render.html_page(F.col("title"), F.col("body"), F.lit(lang)).alias("content"))


#: Exporters by format: blocks and a language to ``doc_id, content``; a further one needs a suffix in ``SUFFIXES`` too.
EXPORTERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "txt": lambda blocks, lang: render.to_text(blocks),
    "markdown": lambda blocks, lang: render.to_markdown(blocks),
    "html": _html,
    "docx": lambda blocks, lang: packages.to_docx(blocks),
    "epub": lambda blocks, lang: packages.to_epub(blocks, reconstruct.titles(blocks), lang),
}


def exported(blocks: DataFrame, format_: str, lang: str = "es") -> DataFrame:
    """``doc_id, content`` in a format of ``EXPORTERS``."""
    if format_ == "pdf" and format_ not in EXPORTERS:
        raise EngineNotAvailable("writing PDF needs an engine")
    if format_ not in EXPORTERS:
        raise UnsupportedFile(f"unknown format: {format_}")
    return EXPORTERS[format_](blocks, lang)


Progress = Callable[[str, int, int], None]


class Written:
    """What an export has written: ``table`` has ``doc_id`` and ``packages.MANIFEST``, a row a file. Going through it gives the files' names, one partition after another."""

    def __init__(self, table: DataFrame):
        self.table = table

    def __iter__(self) -> Iterator[str]:
        return (r["name"] for r in self.table.select("name").toLocalIterator())


def export(blocks: DataFrame, store: str, out: str, config: Config = Config(), progress: Progress = lambda stage, at, of: None, cancelled: Callable[[], bool] = lambda: False) -> Written:
    """Writes every document in every format to ``out``, under the names of ``packages.file_names``.

    Blocks are worked out once, into the table ``store`` (a shared folder), and each format reads them from there. Between formats the
    job reports where it is and stops if it has been cancelled. Tasks note name, size and checksum of each file; these rows become the table ``out/manifest`` by a
    rename at the very end, so a manifest stands for a whole export. That of an earlier export goes before the first file is written.
    """
    spark = blocks.sparkSession

    def stop() -> None:
        if cancelled():
            raise Cancelled("the job was cancelled")

    stop()
    blocks.write.mode("overwrite").parquet(store)
    progress("reconstruction", 1, 1)
    held = spark.read.parquet(store)
    names = kept(packages.file_names(held), "names")
    lang = config.translation.target_language if config.translation.enabled else "es"
    manifest, store_ = path_of(spark, f"{out}/manifest")
    draft, _ = path_of(spark, f"{out}/.manifest-{uuid.uuid4().hex[:12]}")
    store_.delete(manifest, True)
    for i, format_ in enumerate(config.export.formats):
        stop()
        rendered = exported(held, format_, lang).join(names, "doc_id")
        packages.write_files(rendered, out, SUFFIXES[format_], format_).write.mode("append").parquet(draft.toString())
        progress("export", i + 1, len(config.export.formats))
    if not store_.rename(draft, manifest):
        raise OSError(f"the manifest can't be moved to {manifest.toString()}")
    return Written(spark.read.parquet(manifest.toString()))
