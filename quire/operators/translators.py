"""Translation engines behind one function: blocks in, the same blocks translated out.

Engines are made once a Python worker task, so that clients and models needn't be sent there. What fails keeps its original.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.config import TranslationConfig
from quire.errors import EngineNotAvailable
from quire.operators import reconstruct, replies, translate

c = F.col
log = logging.getLogger(__name__)

SYSTEM = (
    "The message holds blocks of a book, numbered by marks: <<<BLOCK_i>>> opens block i and <<<END_i>>> closes it. Give every block back, translated, between the same two marks, and "
    "write nothing else. What was one block stays one block. Leave as it is what already is in the language asked for."
)


@dataclass(frozen=True)
class Chat:
    """An engine that answers prompts: ``make`` gives ``(system, prompt, max_tokens) -> reply``. Blocks go in batches, marked."""

    make: Callable[[], Callable[[str, str, int], str]]
    ready: Callable[[], bool] = lambda: True


@dataclass(frozen=True)
class Direct:
    """An engine that translates a text: ``make`` gives ``(text, source, target) -> text``. Each block goes alone."""

    make: Callable[[], Callable[[str, str, str], str]]
    ready: Callable[[], bool] = lambda: True


ENGINES: dict[str, Chat | Direct] = {}


def available() -> list[str]:
    """Names of the registered engines that can run here; "none" isn't one of them."""
    return [name for name, engine in ENGINES.items() if engine.ready()]


def engine_for(config: TranslationConfig) -> Chat | Direct | None:
    """The engine that the settings name; None where nothing is to be translated."""
    if not config.enabled or config.engine == "none":
        return None
    if config.engine not in ENGINES:
        raise EngineNotAvailable(f"unknown translation engine: {config.engine}")
    if not ENGINES[config.engine].ready():
        raise EngineNotAvailable(f"translation engine {config.engine} isn't available")
    return ENGINES[config.engine]


def languages(blocks: DataFrame, detect: Callable[[str], str | None] | None = None, default: str = "en") -> DataFrame:
    """``doc_id, lang`` of every document: what ``detect`` says of a sample of its blocks; the default for blank texts and failures.

    Without ``detect`` the langdetect package is asked, seeded, where it is installed; else all get the default.
    """

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        ask = detect
        if ask is None:
            try:
                import langdetect

                langdetect.DetectorFactory.seed = 0
                ask = langdetect.detect
            except ImportError:
                ask = lambda text: default

        def one(sample: str | None) -> str:
            try:
                return (sample and sample.strip() and ask(sample)) or default
            except Exception:
                log.warning("no language found, %s is taken", default, exc_info=True)
                return default

        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang": [one(x) for x in frame["sample"]]})

    kind = blocks.schema["doc_id"].dataType.simpleString()
    texts = blocks.select("doc_id", "block_ordinal", reconstruct.plain("runs").alias("text"))
    found = translate.language_sample(texts).mapInPandas(run, f"doc_id {kind}, lang string")
    return texts.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("lang", F.lit(default)).alias("lang"))


def _replies(prompts: DataFrame, engine: Chat) -> DataFrame:
    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        ask = engine.make()
        for frame in frames:
            made = []
            for p in frame.itertuples():
                try:
                    made.append((p.doc_id, p.batch_id, ask(SYSTEM, p.prompt, int(p.max_tokens))))
                except Exception:  # one batch that fails must not end the book
                    log.exception("a batch of %s stays untranslated", p.doc_id)
            yield pd.DataFrame(made, columns=["doc_id", "batch_id", "reply"])

    return prompts.mapInPandas(run, f"doc_id {prompts.schema['doc_id'].dataType.simpleString()}, batch_id long, reply string")


def _direct(texts: DataFrame, langs: DataFrame, engine: Direct, target: str) -> DataFrame:
    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        ask = engine.make()
        for frame in frames:
            made = []
            for b in frame.itertuples():
                try:
                    made.append((b.doc_id, b.block_ordinal, ask(b.text, b.lang, target)))
                except Exception:
                    log.exception("block %s of %s stays untranslated", b.block_ordinal, b.doc_id)
            yield pd.DataFrame(made, columns=["doc_id", "block_ordinal", "translated"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    real = texts.filter(translate.strip(c("text")) != "").join(langs, "doc_id")
    return real.select("doc_id", "block_ordinal", "text", "lang").mapInPandas(run, f"doc_id {kind}, block_ordinal long, translated string")


def _paid_once(asked: DataFrame, engine: Chat | Direct, name: str, target: str, store: str) -> DataFrame:
    """``asked`` with ``reply``, from the table of replies at ``store``; see ``replies``."""
    chat = isinstance(engine, Chat)
    given = ["prompt", "max_tokens"] if chat else ["text", "lang"]
    keyed = asked.withColumn("key", replies.key_of(F.lit(name), F.lit(target), F.lit(SYSTEM if chat else ""), *given))

    def make() -> Callable[..., str]:
        ask = engine.make()
        return (lambda prompt, most: ask(SYSTEM, prompt, int(most))) if chat else (lambda text, lang: ask(text, lang, target))

    return keyed.join(replies.answered(keyed.select("key", *given), make, store), "key")


def translated(blocks: DataFrame, config: TranslationConfig, engine: Chat | Direct | None = None, detect: Callable[[str], str | None] | None = None, store: str | None = None) -> DataFrame:
    """``blocks`` (as ``reconstruct.merge_paragraphs`` gives them) in the target language; all else about a block stays.

    A translated block has one run without style. ``engine`` stands in for the one that the settings name. With ``store``, a path in the shared folder, replies are kept
    there, and no call is made twice, neither by a task nor by a job that runs again; else each call may cost again: write the result before using it twice.
    """
    engine = engine or engine_for(config)
    if engine is None:
        return blocks
    texts = blocks.select("doc_id", c("block_ordinal").cast("long").alias("block_ordinal"), reconstruct.plain("runs").alias("text"))
    if isinstance(engine, Chat):
        batched = translate.batches(texts)
        asked = translate.prompts(batched, f"Translate the following into the language with the code '{config.target_language}'.")
        got = _paid_once(asked, engine, config.engine, config.target_language, store).select("doc_id", "batch_id", "reply") if store else _replies(asked, engine)
        met = batched.join(translate.parse_replies(got), ["doc_id", "batch_id", "local_i"]).select("doc_id", "block_ordinal", "translated")
    else:
        langs = texts.select("doc_id").distinct().withColumn("lang", F.lit(config.source_language)) if config.source_language else languages(blocks, detect)
        if store:
            asked = texts.filter(translate.strip(c("text")) != "").join(langs, "doc_id")
            met = _paid_once(asked, engine, config.engine, config.target_language, store).select("doc_id", "block_ordinal", c("reply").alias("translated"))
        else:
            met = _direct(texts, langs, engine, config.target_language)
    flat = F.array(F.struct(c("translated").alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic")))
    return blocks.join(met, ["doc_id", "block_ordinal"], "left").withColumn("runs", F.when(c("translated").isNotNull(), flat).otherwise(c("runs"))).select(*blocks.columns)


def titles(blocks: DataFrame, before: DataFrame) -> DataFrame:
    """``title`` of each translated document: its first title block's text, else the title that it had before (``doc_id, title``)."""
    now = reconstruct.titles(blocks).withColumnRenamed("title", "now")
    return before.join(now, "doc_id", "left").select("doc_id", F.coalesce(F.nullif("now", F.lit("")), "title").alias("title"))
