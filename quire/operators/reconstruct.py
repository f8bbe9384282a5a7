"""Regions to paragraphs, styled runs, typed blocks and whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.arrays import bound
from quire.operators.layout import BLOCK, PAGE, line_style
from quire.tables import kept

# Fixed thresholds.
GAP, CHAR, INDENT, QUOTE = 1.6, 0.55, 1.8, 1.8

c = F.col
REGION = list(BLOCK)
PARAGRAPH = [*REGION, "para"]


def paragraphs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``para, indent_threshold, baseline_left`` to lines of regions: a new paragraph at an indent, a large gap or a list marker."""
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("line_ord")
    # markers are looked for before rows move, so that windows need no text
    first = lines.withColumn("__item", T.is_list_item(c("text"))).withColumn("__height", c("b") - c("t")).withColumn("gap", c("t") - F.lag("b").over(order))
    middles = {"baseline_left": F.median("l").over(whole), "indent_threshold": F.coalesce(F.median("__height").over(whole), F.lit(20.0)) * CHAR * INDENT}
    first = first.withColumns(middles)
    first = first.withColumn("typical", F.coalesce(F.median(F.when(c("gap") > 0, c("gap"))).over(whole), F.lit(0.0)))
    opens = (c("l") - c("baseline_left") > c("indent_threshold")) | ((c("typical") > 0) & (c("gap") > c("typical") * GAP)) | c("__item")
    opens = F.when(c("gap").isNull(), 0).when(opens, 1).otherwise(0)
    return first.withColumn("opens", opens).withColumn("para", F.sum("opens").over(order)).drop("opens", "gap", "typical", "__item", "__height")


def _joined(tokens: Column) -> Column:
    """Runs out of an array of ``text, bold, italic, opens``: texts joined from each token that opens a run up to the next one."""

    def run(tokens: Column, at: Column, start: Column, k: Column) -> Column:
        own, first = F.slice(tokens, start + 1, F.coalesce(F.get(at, k + 1), F.size(tokens)) - start), F.get(tokens, start)
        return F.struct(F.array_join(F.transform(own, lambda t: t["text"]), "").alias("text"), first["bold"].alias("bold"), first["italic"].alias("italic"))

    opening = lambda t: F.filter(F.transform(t, lambda x, i: F.when(x["opens"], i)), lambda i: i.isNotNull())
    return bound(tokens, lambda t: bound(opening(t), lambda at: F.transform(at, lambda start, k: run(t, at, start, k))))


def styled(words: Column) -> Column:
    """Runs of a paragraph's ``words`` (an array of ``word_ord, line_ord, text, is_bold, is_italic``, in order): joined with hyphens resolved at
    line ends, split where the style changes. Linear in the words."""

    def token(words: Column, w: Column, i: Column) -> Column:
        following, before = F.get(words, i + 1), F.get(words, i - 1)
        cut = F.coalesce(following["line_ord"] != w["line_ord"], F.lit(False)) & T.joins_hyphen(w["text"], following["text"])
        text = F.when(cut, F.left(w["text"], F.length(w["text"]) - 1)).when(following.isNull(), w["text"]).otherwise(F.concat(w["text"], F.lit(" ")))
        changed = F.coalesce((w["is_bold"] != before["is_bold"]) | (w["is_italic"] != before["is_italic"]), F.lit(False))
        return F.struct(text.alias("text"), w["is_bold"].alias("bold"), w["is_italic"].alias("italic"), ((i == 0) | changed).alias("opens"))

    return bound(words, lambda all_: _joined(F.transform(all_, lambda w, i: token(all_, w, i))))


def styled_lines(lines: Column) -> Column:
    """What ``styled`` gives, out of a paragraph's ``lines`` (an array of structs with ``style``, as ``layout.line_style`` makes it, in order)."""

    def tokens(lines: Column, line: Column, i: Column) -> Column:
        own, before, after = line["style"], F.get(lines, i - 1)["style"], F.get(lines, i + 1)["style"]
        cut = F.coalesce(own["cut"] & after["small"], F.lit(False))

        def token(text: Column, k: Column) -> Column:
            bold, italic = F.get(own["bold"], k), F.get(own["italic"], k)
            same = F.coalesce((F.element_at(before["bold"], -1) == bold) & (F.element_at(before["italic"], -1) == italic), F.lit(False))
            last = F.when(after.isNull(), text).when(cut, F.left(text, F.length(text) - 1)).otherwise(F.concat(text, F.lit(" ")))
            whole = F.when(k < F.size(own["text"]) - 1, F.concat(text, F.lit(" "))).otherwise(last)
            return F.struct(whole.alias("text"), bold.alias("bold"), italic.alias("italic"), ((k > 0) | ~same).alias("opens"))

        return F.transform(own["text"], token)

    return bound(lines, lambda all_: _joined(F.flatten(F.transform(all_, lambda line, i: tokens(all_, line, i)))))


def continued(parts: Column) -> Column:
    """Runs of a paragraph out of those of its parts (an array of arrays of runs, in order): a space between parts, and one run where
    the style goes on."""

    def token(flat: Column, r: Column, i: Column) -> Column:
        before, space = F.get(flat, i - 1), F.when(F.coalesce(F.get(flat, i + 1)["begins"], F.lit(False)), " ").otherwise("")
        same = F.coalesce((before["bold"] == r["bold"]) & (before["italic"] == r["italic"]), F.lit(False))
        return F.struct(F.concat(r["text"], space).alias("text"), r["bold"].alias("bold"), r["italic"].alias("italic"), ((i == 0) | ~r["begins"] | ~same).alias("opens"))

    flat = F.flatten(F.transform(parts, lambda p: F.transform(p, lambda r, i: F.struct(r["text"].alias("text"), r["bold"].alias("bold"), r["italic"].alias("italic"), (i == 0).alias("begins")))))
    return bound(flat, lambda all_: _joined(F.transform(all_, lambda r, i: token(all_, r, i))))


def line_parts(rows: DataFrame, keys: list[str], line: str = "line_num") -> DataFrame:
    """Stretches of one style out of a row a line that holds its ``words`` in their order: what ``run_rows`` takes, with ``first`` and ``last``, the words at the line's
    ends where a part has them. A column function of each row, so that parts move and not words. Styles are not null."""

    def part(text: Column, ord_: Column, bold: Column, italic: Column, at: Column, start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(at, k + 1), F.size(text))
        return F.struct(
            F.get(ord_, start).alias("word_ord"), F.array_join(F.slice(text, start + 1, end - start), " ").alias("text"), F.get(bold, start).alias("is_bold"), F.get(italic, start).alias("is_italic"),
            F.when(start == 0, F.get(text, start)).alias("first"), F.when(end == F.size(text), F.get(text, end - 1)).alias("last"),
        )

    def parts(text: Column, ord_: Column, bold: Column, italic: Column) -> Column:
        changed = lambda i: (i == 0) | (F.get(bold, i) != F.get(bold, i - 1)) | (F.get(italic, i) != F.get(italic, i - 1))
        opening = F.filter(F.sequence(F.lit(0), F.size(text) - 1), changed)
        return bound(opening, lambda at: F.transform(at, lambda start, k: part(text, ord_, bold, italic, at, start, k)))

    own = bound(c("words.text"), lambda t: bound(c("words.word_ord"), lambda o: bound(c("words.is_bold"), lambda b: bound(c("words.is_italic"), lambda i: parts(t, o, b, i)))))
    # a plain inline would work the parts out twice, for the filter that goes with it
    return rows.filter(F.size("words") > 0).select(*keys, c(line).alias("line_ord"), F.inline_outer(own))


def run_rows(words: DataFrame, keys: list[str], order: str = "word_ord", line: str = "line_ord", first: str = "text", last: str = "text") -> DataFrame:
    """``run, text, bold, italic`` of each paragraph, out of a row a word or a part of a line (``first`` and ``last`` are the words at the line's ends): windows in the
    partitioning of ``keys``, as ``styled`` does for words that are held in an array."""
    by = Window.partitionBy(*keys).orderBy(order)
    following, next_line = F.lead(first).over(by), F.lead(line).over(by)
    cut = F.coalesce(next_line != c(line), F.lit(False)) & T.joins_hyphen(c(last), c("__next"))
    rows = words.withColumn("__next", following).withColumn("__cut", cut).withColumn("__end", next_line.isNull())
    changed = F.coalesce((c("is_bold") != F.lag("is_bold").over(by)) | (c("is_italic") != F.lag("is_italic").over(by)), F.lit(False))
    token = F.when(c("__cut"), F.left("text", F.length("text") - 1)).when(c("__end"), c("text")).otherwise(F.concat("text", F.lit(" ")))
    rows = rows.withColumn("__token", token).withColumn("__changed", changed.cast("int")).withColumn("__opens", F.lag(line).over(by).isNull() | changed)
    rows = rows.withColumn("run", F.sum("__changed").over(by))
    # runs are many and short: a window that sorts rows is cheaper here than an aggregate, whose buffers are objects
    whole = Window.partitionBy(*keys, "run").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    made = rows.withColumn("__text", F.array_join(F.collect_list("__token").over(whole), "")).filter("__opens")
    return made.select(*keys, c("run").cast("long").alias("run"), c("__text").alias("text"), c("is_bold").alias("bold"), c("is_italic").alias("italic"))


def runs(words: DataFrame, keys: list[str], order: str = "word_ord", line: str = "line_ord") -> DataFrame:
    """``runs`` of each paragraph, out of a row a word."""
    held = F.sort_array(F.collect_list(F.struct(c(order).alias("word_ord"), c(line).alias("line_ord"), "text", "is_bold", "is_italic")))
    return words.groupBy(*keys).agg(styled(held).alias("runs"))


def dominant_style(words: DataFrame, keys: list[str]) -> DataFrame:
    """Whether more than half of the words are bold, italic."""
    return words.groupBy(*keys).agg((F.count_if("is_bold") > F.count("*") / 2).alias("bold"), (F.count_if("is_italic") > F.count("*") / 2).alias("italic"))


def plain(runs: Column | str) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def page_blocks(regions: DataFrame) -> DataFrame:
    """Typed blocks of every page, before paragraphs are merged; headers, footers and page numbers are left out. All in the partitioning of pages."""
    kept = regions.filter(c("type").isin("title", "heading", "body_text", "footnote"))
    margins = Window.partitionBy(*PAGE, "column_index")
    kept = kept.withColumn("column_left", F.median(F.when(c("type") == "body_text", c("l"))).over(margins))
    held = kept.select(*REGION, "type", "reading_order", "column_left", c("r").alias("region_right"), F.inline("lines"))
    if "words" in held.columns:
        own = F.sort_array("words")
        held = held.withColumn("style", line_style(own["text"], own["is_bold"], own["is_italic"])).drop("words")
        stretches = c("style")
    else:
        held = held.withColumn("text", F.replace(c("style.text"), F.lit("\n"), F.lit(" ")))
        stretches = c("style").withField("text", F.split("style.text", "\n"))
    # windows carry a line's text once, in its style
    held = held.withColumn("first", F.struct(T.is_list_item(c("text")).alias("item"), T.is_numbered(c("text")).alias("numbered"), "l"))
    held = paragraphs(held, REGION).drop("text").withColumn("para", F.when(c("type") == "body_text", c("para")).otherwise(0)).withColumn("style", stretches)
    # blocks of whole paragraphs
    para = held.groupBy(*PARAGRAPH, "type", "reading_order", "column_left", "region_right", "baseline_left", "indent_threshold").agg(
        F.min_by("first", "line_ord").alias("first"), F.median("l").alias("left"), F.median("r").alias("right"), F.count("*").alias("n_lines"),
        F.sort_array(F.collect_list(F.struct("line_ord", "style"))).alias("lines"), *[F.sum(f"style.{n}").alias(n) for n in ("n_words", "n_bold", "n_italic")],
    )
    made = para.withColumn("joined", F.array_join(F.flatten(F.transform("lines", lambda x: x["style"]["text"])), " "))
    made = made.withColumn("runs", styled_lines(c("lines"))).withColumn("bold", c("n_bold") > c("n_words") / 2).withColumn("italic", c("n_italic") > c("n_words") / 2)
    list_, heading = c("first.item"), c("type").isin("title", "heading")
    quote = (c("n_lines") > 1) & (c("left") - F.coalesce("column_left", "baseline_left") > c("indent_threshold") * QUOTE) & (c("region_right") - c("right") > c("indent_threshold"))
    kind = F.when(c("type") != "body_text", c("type")).when(list_, "list_item").when(quote, "quote").otherwise("paragraph")
    first = F.get("runs", F.lit(0))["text"]
    marker = F.when(c("type") == "footnote", T.footnote_marker(first))
    bare = F.transform("runs", lambda r, i: F.when(i == 0, F.struct(T.without_footnote_marker(r["text"]).alias("text"), r["bold"].alias("bold"), r["italic"].alias("italic"))).otherwise(r))
    final = F.when(heading, F.array(F.struct(c("joined").alias("text"), c("bold"), c("italic")))).when(marker.isNotNull(), bare).otherwise(c("runs"))
    return made.select(
        *PAGE, "reading_order", c("para").cast("long").alias("para"), kind.alias("type"), final.alias("runs"), F.when(c("type") == "heading", 2).otherwise(1).alias("level"),
        (F.coalesce(c("first.numbered"), F.lit(False)) & (c("type") == "body_text")).alias("list_ordered"), marker.alias("footnote_marker"),
        ((c("type") == "body_text") & (c("first.l") - c("baseline_left") > c("indent_threshold"))).alias("first_line_indent"),
    )


def _ends(runs: str) -> Column:
    """Whether a block's text ends a sentence: its last run tells, unless that is blank."""
    last = F.get(runs, F.size(runs) - 1)["text"]
    return F.when(T.has_mark(last), T.ends_sentence(last)).otherwise(T.ends_sentence(plain(runs)))


_REST = ["level", "list_ordered", "footnote_marker", "first_line_indent"]


def page_rows(blocks: DataFrame) -> DataFrame:
    """A row a page: its blocks as the array ``held``, with paragraphs joined that go on within the page; ``n`` of them; whether the first could go on
    one before (``joins``) and whether the last is a paragraph that ends no sentence (``open``). All in the partitioning of pages."""
    order = Window.partitionBy(*PAGE).orderBy("reading_order", "para")
    b = blocks.withColumn("ends", _ends("runs"))
    goes_on = (c("type") == "paragraph") & (F.lag("type").over(order) == "paragraph") & ~F.lag("ends").over(order)
    b = b.withColumn("starts", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("local", F.sum("starts").over(order))
    at = F.struct("reading_order", "para")
    parts = F.sort_array(F.collect_list(F.struct("reading_order", "para", "runs")))
    first = F.min_by(F.struct("type", *_REST), at)
    whole = b.groupBy(*PAGE, "local").agg(first.alias("f"), parts.alias("parts"), F.max_by("ends", at).alias("ends"))
    whole = whole.withColumn("runs", joined_parts("parts"))
    held = whole.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("local", "f.type", "runs", "ends", *[f"f.{n}" for n in _REST]))).alias("held"))
    last = F.element_at("held", -1)
    return held.select(*PAGE, "held", F.size("held").cast("long").alias("n"), (F.get("held", F.lit(0))["type"] == "paragraph").alias("joins"), ((last["type"] == "paragraph") & ~last["ends"]).alias("open"))


def gathered(blocks: DataFrame) -> DataFrame:
    """What ``merge_paragraphs`` gives, without ``source_page``, for what makes a row a document of them: blocks move to their document once, and no table is kept between."""
    order = Window.partitionBy("doc_id").orderBy("page_index", "reading_order", "para")
    b = blocks.withColumn("ends", _ends("runs"))
    goes_on = (c("type") == "paragraph") & (F.lag("type").over(order) == "paragraph") & ~F.lag("ends").over(order)
    b = b.withColumn("starts", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("block_ordinal", F.sum("starts").over(order) - 1)
    at = F.struct("page_index", "reading_order", "para")
    parts = F.sort_array(F.collect_list(F.struct("page_index", "reading_order", "para", "runs")))
    whole = b.groupBy("doc_id", "block_ordinal").agg(F.min_by(F.struct("type", *_REST), at).alias("f"), parts.alias("parts"))
    return whole.select("doc_id", "block_ordinal", "f.type", joined_parts("parts").alias("runs"), *[f"f.{n}" for n in _REST])


def joined_parts(parts: str) -> Column:
    """Runs of a paragraph out of its ``parts`` (an array of structs with ``runs``, in order). Most are of one part, whose runs stay as they are."""
    return F.when(F.size(parts) == 1, F.get(parts, F.lit(0))["runs"]).otherwise(continued(F.transform(parts, lambda p: p["runs"])))


def numbered_pages(pages: DataFrame) -> DataFrame:
    """``doc_id, page_index, before, joined, goes_on`` of ``page_rows``: blocks of the document before the page's first, whether the first goes on the last one
    of the page before, and whether the last goes on on the next page. The scan over a book sees a narrow row a page, and no text."""
    order = Window.partitionBy("doc_id").orderBy("page_index")
    flags = pages.select(*PAGE, "n", (c("joins") & F.coalesce(F.lag("open").over(order), F.lit(False))).alias("joined"), (c("open") & F.coalesce(F.lead("joins").over(order), F.lit(False))).alias("goes_on"))
    new = c("n") - c("joined").cast("long")
    return flags.select(*PAGE, F.coalesce(F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"), "joined", "goes_on")


def merge_paragraphs(blocks: DataFrame) -> DataFrame:
    """Joins a paragraph to the one before it, across columns and pages, if that one doesn't end a sentence; numbers the blocks.

    Pages are joined within themselves and kept as a table; a scan over their flags numbers them. Then only paragraphs at the borders of pages that do go on move once
    more; all other blocks stay where they are. So no task holds more of a book than a paragraph or a narrow row for each of its pages.
    """
    pages = kept(page_rows(blocks), "pages")
    met = pages.join(kept(numbered_pages(pages), "page-numbers"), list(PAGE))
    rows = met.select(*PAGE, "before", "joined", "goes_on", "n", F.posexplode("held").alias("at", "b"))
    edge = ((c("at") == 0) & c("joined")) | ((c("at") == c("n") - 1) & c("goes_on"))
    rows = rows.select("doc_id", (c("before") + c("at") - c("joined").cast("long")).alias("block_ordinal"), "page_index", "b.type", "b.runs", *[f"b.{n}" for n in _REST], edge.alias("edge"))
    columns = ["doc_id", "block_ordinal", "type", "runs", *_REST, "source_page"]
    inner = rows.filter(~c("edge")).withColumn("source_page", c("page_index")).select(*columns)
    parts = F.sort_array(F.collect_list(F.struct("page_index", "runs")))
    first = F.min_by(F.struct(*_REST, "page_index"), "page_index")
    outer = rows.filter("edge").groupBy("doc_id", "block_ordinal").agg(F.first("type").alias("type"), continued(F.transform(parts, lambda p: p["runs"])).alias("runs"), first.alias("f"))
    return inner.unionByName(outer.select("doc_id", "block_ordinal", "type", "runs", *[f"f.{n}" for n in _REST], c("f.page_index").alias("source_page")))


def title(text: str = "array_join(transform(runs, r -> r.text), '')") -> Column:
    """Of a document's blocks, the first title's text, or nothing: an aggregate."""
    return F.coalesce(F.expr(f"min_by({text}, block_ordinal) FILTER (WHERE type = 'title')"), F.lit("")).alias("title")


def titles(blocks: DataFrame) -> DataFrame:
    """``title`` of each document."""
    return blocks.groupBy("doc_id").agg(title())


def region_titles(regions: DataFrame) -> DataFrame:
    """What ``titles`` gives for the merged blocks of ``regions``. Titles are whole regions and never joined, so the first one's lines are enough: no runs, no merging."""
    kept = regions.filter(c("type").isin("title", "heading", "body_text", "footnote"))
    text = F.when(c("type") == "title", F.array_join(F.sort_array("lines")["text"], " "))
    rows = kept.select("doc_id", text.alias("text"), F.when(c("type") == "title", F.struct("page_index", "reading_order")).alias("at"))
    return rows.groupBy("doc_id").agg(F.coalesce(F.min_by("text", "at"), F.lit("")).alias("title"))


def merge_lines(docs: DataFrame) -> DataFrame:
    """The same continuation rule on the lines of plain texts: ``doc_id, para, text, n_lines``."""
    order = Window.partitionBy("doc_id").orderBy("ln")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    opens = F.when(F.coalesce(T.ends_sentence(F.lag("line").over(order)), F.lit(True)), 1).otherwise(0)
    rows = rows.withColumn("opens", opens).withColumn("para", F.sum("opens").over(order) - 1)
    return rows.groupBy("doc_id", "para").agg(F.expr("listagg(line, ' ') WITHIN GROUP (ORDER BY ln)").alias("text"), F.count("*").alias("n_lines"))
