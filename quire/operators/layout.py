"""Words to lines, blocks, zones, columns and regions in reading order.

Everything is keyed by (doc_id, page_index), and every order ends with an ordinal. Words are hashed by page once (``by_page``); lines, blocks,
columns and regions are aggregates and windows in that partitioning, with no further shuffle and no join back. Lines carry their words and
blocks their lines as arrays, which a page bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import LayoutConfig
from quire.functions import text as T
from quire.functions.arrays import bound
from quire.sources.typeset import PAGE_HEIGHT, PAGE_WIDTH

PAGE = ("doc_id", "page_index")
SIZE = {"page_width": PAGE_WIDTH, "page_height": PAGE_HEIGHT}
BLOCK = (*PAGE, "zone", "block_num", "par_num")
# Fixed thresholds: zones as shares of the page, sizes as ratios to the median.
HEADER, FOOTER, FOOTNOTE, TITLE_ZONE = 0.05, 0.08, 0.28, 0.2
SMALL, TITLE, HEADING, SPANNING = 0.82, 1.4, 1.15, 0.7
MIN_GAP, MIN_COLUMN = 0.015, 0.05

c = F.col


def confident(words: DataFrame, least: float = 40.0) -> DataFrame:
    """Words that aren't blank and reach the confidence."""
    return words.filter((T.strip(c("text")) != "") & (c("confidence") >= least) & (c("confidence") >= 0))


def page_size(table: DataFrame) -> tuple[Column, Column]:
    """Width and height of the pages: the table's ``page_width, page_height`` where it has them, else the typesetter's."""
    return tuple(c(n) if n in table.columns else F.lit(other) for n, other in SIZE.items())


def _sized(table: DataFrame) -> list[str]:
    return [n for n in SIZE if n in table.columns]


def by_page(words: DataFrame) -> DataFrame:
    """Words hashed by page: the one shuffle that layout needs. No page, and no book, is more than its own pages' work."""
    return words.repartition(*PAGE)


def lines(words: DataFrame, with_words: bool = False) -> DataFrame:
    """A row a line: text in word order, box, mean confidence, place in the page. Blank lines go. ``with_words`` adds ``words``, an array."""
    held = [F.collect_list(F.struct("word_ord", "text", "is_bold", "is_italic")).alias("words")] if with_words else []
    made = words.groupBy(*PAGE, *_sized(words), "block_num", "par_num", "line_num").agg(
        F.min("word_ord").alias("line_ord"), F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY word_ord)").alias("text"), F.min("l").alias("l"), F.min("t").alias("t"),
        F.max(c("l") + c("w")).alias("r"), F.max(c("t") + c("h")).alias("b"), F.avg("confidence").alias("confidence"), F.count("*").alias("n_words"), *held,
    )
    return made.filter(T.strip(c("text")) != "")


def line_style(text: Column, bold: Column, italic: Column) -> Column:
    """What runs need of a line, out of arrays of its words' fields in their order: ``text, bold, italic`` (an array each) of its stretches of one style, how many words
    it has and how many of them are bold and italic, whether its last one is cut by a hyphen (``cut``), and whether its first one begins ``small``."""

    def made(text: Column, bold: Column, italic: Column) -> Column:
        changed = lambda i: (i == 0) | (F.get(bold, i) != F.get(bold, i - 1)) | (F.get(italic, i) != F.get(italic, i - 1))
        opening = F.filter(F.sequence(F.lit(0), F.size(text) - 1), changed)
        stretch = lambda at, start, k: F.array_join(F.slice(text, start + 1, F.coalesce(F.get(at, k + 1), F.size(text)) - start), " ")
        length = lambda at: F.transform(at, lambda start, k: F.coalesce(F.get(at, k + 1), F.size(text)) - start)
        many = lambda at, flags: F.aggregate(F.zip_with(at, length(at), lambda start, n: F.when(F.get(flags, start), n).otherwise(0)), F.lit(0), lambda s, x: s + x)
        there = lambda flag: F.coalesce(flag, F.lit(False))
        return bound(opening, lambda at: F.struct(
            F.transform(at, lambda start, k: stretch(at, start, k)).alias("text"), F.transform(at, lambda start: F.get(bold, start)).alias("bold"), F.transform(at, lambda start: F.get(italic, start)).alias("italic"),
            F.size(text).alias("n_words"), many(at, bold).alias("n_bold"), many(at, italic).alias("n_italic"),
            there(T.ends_cut(F.get(text, F.size(text) - 1))).alias("cut"), there(T.begins_small(F.get(text, F.lit(0)))).alias("small"),
        ))

    return bound(text, lambda t: bound(bold, lambda b: bound(italic, lambda i: F.when(F.size(t) > 0, made(t, b, i)))))


def held_lines(rows: DataFrame, with_words: bool = False, with_style: bool = False) -> DataFrame:
    """What ``lines`` gives, out of a row a line that holds its ``words`` in their order (an array of ``word_ord, text, l, r, confidence, is_bold, is_italic``, or an array
    for each of these; styles only if lines are to hold their words) and their common ``t, h``: no sort, a column function of each row. Only lines that are to hold their words, or
    their ``line_style`` as ``style``, its stretches joined by line ends, move, by page."""
    total = F.aggregate("words.confidence", F.lit(0).cast("long"), lambda s, x: s + x)
    parts = ("word_ord", "text", "is_bold", "is_italic")
    # whether a line is blank, its first words tell; asked of its text, the text would be joined once for the filter and once more for the rows that stay
    there = rows.filter(F.exists("words.text", T.has_mark))
    made = there.select(
        *PAGE, *_sized(rows), "block_num", "par_num", "line_num", F.array_min("words.word_ord").alias("line_ord"), F.array_join("words.text", " ").alias("text"), F.array_min("words.l").alias("l"), "t",
        F.array_max("words.r").alias("r"), (c("t") + c("h")).alias("b"), (total.cast("double") / F.size("words.text")).alias("confidence"), F.size("words.text").cast("long").alias("n_words"),
        *([c(f"words.{n}").alias(f"__{n}") for n in parts] if with_words else []),
        *([line_style(*[c(f"words.{n}") for n in parts[1:]]).alias("style")] if with_style else []),
    )
    if with_style:
        # stretches of one style move instead of words, as one text: a line has no line end
        moved = by_page(made.drop("text").withColumn("style", c("style").withField("text", F.array_join("style.text", "\n"))))
        return moved.withColumn("text", F.replace(c("style.text"), F.lit("\n"), F.lit(" ")))
    if not with_words:
        return made
    # words move as plain arrays, and their text once
    moved = by_page(made.drop("text")).withColumn("text", F.array_join("__text", " "))
    return moved.withColumn("words", F.arrays_zip(*[c(f"__{n}").alias(n) for n in parts])).drop(*[f"__{n}" for n in parts])


def with_zone(lines: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """``zone``: page_number, header, footer or body, decided in this order by the box's middle."""
    _, height = page_size(lines)
    y = (c("t") + c("b")) / 2
    top, bottom = y <= height * HEADER, y >= height * (1 - FOOTER)
    on = F.lit
    number = on(config.detect_page_numbers) & (top | bottom) & T.looks_like_page_number(c("text"))
    zone = F.when(number, "page_number").when(on(config.detect_headers) & top, "header").when(on(config.detect_footers) & bottom, "footer").otherwise("body")
    return lines.withColumn("zone", zone)


def blocks(zoned: DataFrame, with_text: bool = False) -> DataFrame:
    """A row for each (zone, block, paragraph) of a page; lines that carry their words or ``style`` are held in ``lines``, others if ``with_text`` with order and text only.
    ``first_marks``: whether the first line begins with a footnote's marker. All of a block but its lines has a fixed size, so rows without them are neither sorted nor carry text."""
    text = [F.collect_list(F.struct("line_ord", "text")).alias("lines")] if with_text else []
    held = [F.collect_list(F.struct("line_ord", "text", "l", "t", "r", "b", "words")).alias("lines")] if "words" in zoned.columns else text
    held = [F.collect_list(F.struct("line_ord", "l", "t", "r", "b", "style")).alias("lines")] if "style" in zoned.columns else held
    return zoned.withColumn("__marks", T.looks_like_footnote_marker(c("text"))).groupBy(*BLOCK, *_sized(zoned)).agg(
        F.min("line_ord").alias("block_ord"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"), F.avg(c("b") - c("t")).alias("line_height"),
        F.min_by("__marks", "line_ord").alias("first_marks"), F.count("*").alias("n_lines"), *held,
    )


def _median(value: Column, *keys: str) -> Column:
    return F.median(value).over(Window.partitionBy(*keys))


def split_footnotes(blocks: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Body blocks low on the page, with small letters or a marker, become zone "footnote"."""
    _, height = page_size(blocks)
    y, body = (c("t") + c("b")) / 2, c("zone") == "body"
    with_median = blocks.withColumn("__m", _median(F.when(body, c("line_height")), *PAGE))
    small = (c("__m") > 0) & (c("line_height") <= c("__m") * SMALL)
    low = (y >= height * (1 - FOOTNOTE)) & (y < height * (1 - FOOTER))
    note = F.lit(config.detect_footnotes) & body & low & (small | c("first_marks"))
    return with_median.withColumn("zone2", F.when(note, "footnote").otherwise(c("zone"))).drop("__m")


def with_ranges(blocks: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Adds ``ranges``, the columns of each page: boxes of body blocks merged along x where gaps are small, narrow ones dropped."""
    width, _ = page_size(blocks)
    gap, least = (F.greatest(F.lit(1), F.floor(width * share)) for share in (MIN_GAP, MIN_COLUMN))
    boxes = blocks.withColumn("__l", F.greatest("l", F.lit(0))).withColumn("__r", F.least("r", width))
    boxes = boxes.withColumn("__real", (c("zone2") == "body") & (c("__r") > c("__l")))
    order = Window.partitionBy(*PAGE, "__real").orderBy("__l", "__r", "block_ord")
    boxes = boxes.withColumn("__reach", F.max("__r").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    boxes = boxes.withColumn("__run", F.sum(F.when(c("__reach").isNull() | (c("__l") - c("__reach") >= gap), 1).otherwise(0)).over(order))
    whole = Window.partitionBy(*PAGE, "__real", "__run")
    ends = boxes.withColumn("__range", F.struct(F.min("__l").over(whole).alias("l"), F.max("__r").over(whole).alias("r")))
    wide = c("__real") & (c("__range.r") - c("__range.l") >= least)
    found = ends.withColumn("__found", F.sort_array(F.collect_set(F.when(wide, c("__range"))).over(Window.partitionBy(*PAGE))))
    page = F.array(F.struct(F.lit(0).cast("long").alias("l"), width.cast("long").alias("r")))
    good = F.size("__found").between(1, config.max_columns) & F.lit(config.detect_columns)
    return found.withColumn("ranges", F.when(good, c("__found")).otherwise(page)).drop("__l", "__r", "__real", "__reach", "__run", "__range", "__found")


def column_ranges(blocks: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """``ranges`` of each page that has a body block."""
    return with_ranges(blocks, config).filter("zone2 = 'body'").groupBy(*PAGE).agg(F.first("ranges").alias("ranges"))


def column_index(l: Column, r: Column, ranges: Column) -> Column:  # noqa: E741
    """-1 for a box across columns, else the range that holds its middle, else the nearest."""
    total = F.element_at(ranges, -1)["r"] - F.element_at(ranges, 1)["l"]
    middle = (l + r) / 2
    inside = F.array_position(F.transform(ranges, lambda x: (middle >= x["l"]) & (middle <= x["r"])), F.lit(True))
    away = F.transform(ranges, lambda x: F.least(F.abs(middle - x["l"]), F.abs(middle - x["r"])))
    nearest = F.array_position(away, F.array_min(away))
    spans = (total > 0) & (r - l >= SPANNING * total) & (F.size(ranges) > 1)
    return F.when(spans, -1).when(inside > 0, inside - 1).otherwise(nearest - 1).cast("long")


def regions(words: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Regions with type, column and reading order; each holds its ``lines``, and these their ``words``."""
    return line_regions(lines(by_page(words), with_words=True), config)


def line_regions(lines: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """``regions`` of lines that hold their words."""
    return classified(split_footnotes(blocks(with_zone(lines, config)), config), config)


def classified(parted: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Adds ``type, column_index, reading_order`` to blocks whose footnotes are split off; removes what the settings remove."""
    _, height = page_size(parted)
    flow = c("zone2") == "body"
    held = ["lines"] if "lines" in parted.columns else []
    known = with_ranges(parted, config).withColumn("__m", _median(F.when(flow, c("line_height")), *PAGE))
    big = (c("__m") > 0) & (c("line_height") >= c("__m") * TITLE) & (c("t") <= height * TITLE_ZONE)
    kind = F.when(~flow, c("zone2")).when(big, "title").when((c("__m") > 0) & (c("line_height") >= c("__m") * HEADING), "heading").otherwise("body_text")
    at = F.when(flow, column_index(c("l"), c("r"), c("ranges"))).otherwise(F.lit(0).cast("long"))
    typed = known.select(*BLOCK, "block_ord", "l", "t", "r", "b", "line_height", "n_lines", *held, "zone2", kind.alias("type"), at.alias("column_index"))
    for name, gone in (("header", config.remove_headers), ("footer", config.remove_footers), ("page_number", config.remove_page_numbers)):
        if gone:
            typed = typed.filter(c("type") != name)
    spans = flow & (c("column_index") == -1)
    # a spanning block comes after what starts above it in every column, and before the rest
    above = F.count_if(spans).over(Window.partitionBy(*PAGE).orderBy("t"))
    nth = F.sum(spans.cast("long")).over(Window.partitionBy(*PAGE).orderBy("t", "block_ord").rowsBetween(Window.unboundedPreceding, -1))
    banded = typed.withColumn("band", F.when(spans, F.coalesce(nth, F.lit(0))).when(flow, above).otherwise(0)).withColumn("late", spans.cast("int"))
    zone = F.when(c("type") == "header", 0).when(flow, 1).when(c("type") == "footnote", 2).otherwise(3)
    order = Window.partitionBy(*PAGE).orderBy(zone, "band", "late", F.when(flow & ~spans, c("column_index")).otherwise(0), "t", (c("type") == "page_number").cast("int"), "block_ord")
    return banded.withColumn("reading_order", (F.row_number().over(order) - 1).cast("long")).drop("band", "late", "zone2")


def bold_words(words: DataFrame, ratio: float = 1.25) -> DataFrame:
    """``bold_by_stroke``: the stroke against the median of the positive strokes of the word's block."""
    m = _median(F.when(c("stroke") > 0, c("stroke")), *PAGE, "block_num")
    return words.withColumn("__m", m).withColumn("bold_by_stroke", F.coalesce((c("__m") > 1e-6) & (c("stroke") > 0) & (c("stroke") / c("__m") >= ratio), F.lit(False))).drop("__m")


def page_texts(lines: DataFrame) -> DataFrame:
    """``full_text`` of each page: its lines in order."""
    return lines.groupBy(*PAGE).agg(F.expr("listagg(text, '\n') WITHIN GROUP (ORDER BY line_ord)").alias("full_text"))


def quad_box(corners: Column | str) -> Column:
    """``l, t, w, h`` around a detection's corners (an array of ``x, y``), in whole pixels."""
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    whole = lambda v, name: v.cast("long").alias(name)
    return F.struct(whole(F.array_min(xs), "l"), whole(F.array_min(ys), "t"), whole(F.array_max(xs) - F.array_min(xs), "w"), whole(F.array_max(ys) - F.array_min(ys), "h"))
