"""Settings that are submitted as JSON, checked by rules that are rows; and choices as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import SHORT_CODES


@dataclass(frozen=True)
class Rule:
    """``path`` within the JSON; ``kind``: "some" (a list that isn't empty), "of" (each value is one of ``values``), "between" (numbers, if given). ``message``: what to
    tell whoever broke it."""

    path: str
    kind: str
    message: str
    values: tuple[str, ...] = ()
    low: float = 0
    high: float = 0


# Names and ranges of settings (fixed values).
OCR_ENGINES, TRANSLATORS, FORMATS = ("tesseract", "paddleocr", "easyocr"), ("none", "anthropic", "argos"), ("txt", "markdown", "html", "docx", "epub", "pdf")
TARGETS = ("en", "es", "fr", "de", "it", "pt", "nl", "ru", "ja", "ko", "ar")
RULES = (
    Rule("$.ocr.languages", "some", "ocr.languages: one at least"),
    Rule("$.export.formats", "some", "export.formats: one at least"),
    Rule("$.ocr.engine", "of", "ocr.engine: unknown", OCR_ENGINES),
    Rule("$.ocr.psm", "between", "ocr.psm: 0 to 13", low=0, high=13),
    Rule("$.ocr.oem", "between", "ocr.oem: 0 to 3", low=0, high=3),
    Rule("$.ocr.min_confidence", "between", "ocr.min_confidence: 0 to 100", low=0, high=100),
    Rule("$.translation.engine", "of", "translation.engine: unknown", TRANSLATORS),
    Rule("$.export.formats", "of", "export.formats: unknown", FORMATS),
    Rule("$.layout.max_columns", "between", "layout.max_columns: 1 to 8", low=1, high=8),
    Rule("$.image.target_dpi", "between", "image.target_dpi: 72 to 1200", low=72, high=1200),
)


def values_at(json: Column, path: str) -> Column:
    """The values at a path as an array of strings: those of a list, or the one that is there; null if nothing is."""
    found = F.get_json_object(json, path)
    return F.when(found.startswith("["), F.from_json(found, "array<string>")).when(found.isNotNull(), F.array(found))


def broken(json: Column, rule: Rule) -> Column:
    """Whether the settings break a rule. What isn't given has its default, which breaks none, but a list that must not be empty."""
    given = values_at(json, rule.path)
    if rule.kind == "some":
        return F.coalesce(F.size(given) == 0, F.lit(True))
    if rule.kind == "of":
        return F.coalesce(F.exists(given, lambda v: F.coalesce(~v.isin(*rule.values), F.lit(True))), F.lit(False))
    return F.coalesce(F.exists(given, lambda v: F.coalesce(~v.try_cast("double").between(rule.low, rule.high), F.lit(True))), F.lit(False))


def checked(forms: DataFrame, rules: tuple[Rule, ...] = RULES, json: str = "config_json") -> DataFrame:
    """``forms`` with ``position, message`` of the first rule that each breaks; both null where none is. Text that is no JSON breaks rule 0."""
    readable = F.coalesce(F.json_object_keys(F.col(json)).isNotNull(), F.lit(False))
    found = F.when(~readable, F.struct(F.lit(0).alias("position"), F.lit("no JSON object").alias("message")))
    for i, rule in enumerate(rules, 1):
        found = found.when(broken(F.col(json), rule), F.struct(F.lit(i).alias("position"), F.lit(rule.message).alias("message")))
    return forms.withColumn("__first", found).select(*forms.columns, "__first.position", "__first.message")


def choices(spark: SparkSession, available: tuple[str, ...] = ()) -> DataFrame:
    """``kind, value, available``: what may be chosen of languages, target languages, engines and formats. ``available`` names the engines that can run."""
    rows = [("language", v, True) for v in SHORT_CODES] + [("target", v, True) for v in TARGETS] + [("format", v, True) for v in FORMATS]
    rows += [("ocr_engine", v, v in available) for v in OCR_ENGINES] + [("translation_engine", v, v in available) for v in TRANSLATORS if v != "none"]
    return spark.createDataFrame(rows, "kind string, value string, available boolean")


def runnable(forms: DataFrame, choices: DataFrame, kind: str = "ocr_engine", path: str = "$.ocr.engine", json: str = "config_json") -> DataFrame:
    """Forms whose engine can run here: a left semi join with the choices, a table of fixed size."""
    own = choices.filter((F.col("kind") == kind) & F.col("available")).select(F.col("value").alias("__value"))
    return forms.withColumn("__value", F.get_json_object(json, path)).join(F.broadcast(own), "__value", "left_semi").drop("__value")
