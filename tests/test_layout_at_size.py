"""Long lines, samples that end between blocks, capitals, and what the layout queries move."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from quire import queries
from quire.functions import text as T
from quire.operators import layout, reconstruct, translate
from quire.sources import typeset


def test_a_sample_ends_with_the_space_before_the_next_block(spark):
    for first, want in ((3998, "x" * 3998 + " b"), (3999, "x" * 3999 + " "), (4000, "x" * 4000)):
        blocks = spark.createDataFrame([(1, 0, "x" * first), (1, 1, "b")], "doc_id long, block_ordinal long, text string")
        assert translate.language_sample(blocks).first().sample == want


def test_a_capital_is_one_letter(spark):
    rows = spark.createDataFrame([("ß",), ("a",), ("é",), ("ᾳ",), ("ᾀ",), ("ﬁ",), ("ŉ",), ("7",), ("",)], "x string")
    assert [r[0] for r in rows.select(T.upper_letter(F.col("x"))).collect()] == ["ẞ", "A", "É", "ᾼ", "ᾈ", "ﬁ", "ŉ", "7", ""]


def test_pairs_of_lines_with_a_very_long_one(spark):
    texts = ["a\nb\nc\nd\ne", "a", "a\n", "x" * 300_000, "a\nb\n" + "y" * 300_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    start = time.monotonic()
    got = [r[0] for r in rows.orderBy("i").select(T.in_pairs(F.col("t"))).collect()]
    assert got == ["a\nb\n \nc\nd\n \ne", "a", "a\n", texts[3], "a\nb\n \n" + texts[4][4:]]
    assert time.monotonic() - start < 15


def test_pairs_of_odd_lines_equal_their_sql(spark, tmp_path):
    import duckdb

    from quire.oracles import ORACLES

    texts = ["a\n\nb", "x  y \n\tz\n\n\n", "", None, "\n", "a\n \nb\nc", " lead\u3000\r\nq\u00a0", "a\nb", "a\nb\nc"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = base.execute(ORACLES["blank_line_paragraphs"]).fetchall()
    assert sorted(map(tuple, queries.blank_line_paragraphs(spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 13


def _documents(spark):
    long = " ".join("palabra" * (1 + i % 3) + ("." if i % 9 == 0 else "") for i in range(3000))
    texts = ["Uno dos.\n\n tres  cuatro\n" + "\n".join(f"linea {i} extraordinariamente larga para una columna estrecha de texto" for i in range(90)), "", None, long, " ", "ñandú extraordinario"]
    return spark.createDataFrame([(i - 1, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_setting_moves_no_words(spark):
    docs = _documents(spark)
    assert "Exchange" not in typeset.words(docs)._jdf.queryExecution().executedPlan().toString()
    rows = typeset.words(docs).collect()
    assert {r.doc_id for r in rows} == {-1, 0, 2, 3, 4}  # a null text gives nothing
    assert [(r.text, r.l, r.t, r.w, r.h, r.block_num) for r in rows if r.doc_id == 4] == [("ñandú", 180, 240, 75, 60, 100000), ("extraordinario", 270, 240, 210, 60, 100000), ("Libro 4", 180, 60, 105, 20, 1), ("1 Nota al pie 0", 180, 1960, 225, 28, 600001), ("1", 180, 2110, 15, 20, 600002)]
    assert typeset.words(docs.filter("text is null")).count() == 0 == typeset.words(docs.limit(0)).count()


def test_documents_are_set_alike_in_any_batch(spark, monkeypatch):
    pairs = [(r.doc_id, r.text) for r in _documents(spark).collect()] * 3
    batch = (pa.array([i for i, _ in pairs]), pa.array([t for _, t in pairs]))
    whole = [x for a in typeset._lists(iter([batch])) for x in a.to_pylist()]
    monkeypatch.setattr(typeset, "AT_ONCE", 100)
    alone = [x for a in typeset._lists(iter([batch])) for x in a.to_pylist()]
    assert whole == alone and len(whole) == len(pairs) and whole[:6] == whole[6:12]


def test_lines_from_held_words_are_those_from_words(spark):
    docs = _documents(spark)
    for with_words in (False, True):
        flat, held = layout.lines(typeset.words(docs), with_words), layout.held_lines(typeset.lines(docs), with_words)
        order = F.sort_array("words").alias("words") if with_words else F.lit(0)
        rows = [sorted(map(str, df.select(*sorted(set(flat.columns) - {"words"}), order).collect())) for df in (flat, held)]
        assert rows[0] == rows[1] and len(rows[0]) > 100


def test_lines_from_words_held_as_columns_are_those_from_words(spark):
    docs = _documents(spark)
    for with_words, fields in ((False, typeset.PLACED), (True, tuple(typeset.FIELDS))):
        rows = typeset.lines(docs, fields)
        assert rows.schema["words"].dataType.names == list(fields)
        flat, held = layout.lines(typeset.words(docs), with_words), layout.held_lines(rows, with_words)
        order = F.sort_array("words").alias("words") if with_words else F.lit(0)
        got, want = (sorted(map(str, df.select(*sorted(set(flat.columns) - {"words"}), order).collect())) for df in (held, flat))
        assert got == want and len(got) > 100


def test_blank_lines_go_and_text_is_joined_once(spark):
    word = lambda n, text: (n, text, 0, 0, 90, False, False)
    texts = [[" ", ""], ["", "\u3000", "x"], [], ["\u00a0\u2003"], ["\u200b"], None]
    made = [(1, 0, 1, 0, i, 0, 20, t and [word(j, x) for j, x in enumerate(t)] if t is not None else None) for i, t in enumerate(texts)]
    rows = spark.createDataFrame(made, f"doc_id long, {typeset.LINE[7:-1]}")
    assert sorted(r.line_num for r in layout.held_lines(rows).collect()) == [1, 4]
    plan = queries.words_to_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_join") == 1 and "is_bold" not in plan


ODD = ["", " ", None, "1. a", "1.", "1. ", "\u00a0\n2)\u2003b", " • x", "•x", "-\u3000", "xiv) y", "xivx) y", "abc. d", "a) ", "1234. x", "a\n1. b", "\u0661. x", "¹x", " ²", "3 ", "3 \u00a0", " 4 x", "5.) x", "*", "* ", "*\tn", "\u20071)\n\nz", "12.\u0085q"]


def test_paragraphs_move_no_text(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, x string")
    x = F.col("x")
    apart = T.lstrip(x).rlike(T.BULLET) | T.lstrip(x).rlike(T.NUMBERED)
    assert rows.filter(~T.is_list_item(x).eqNullSafe(apart)).count() == 0 < rows.filter(T.is_list_item(x)).count()
    plan = queries.split_paragraphs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan[: plan.index("Exchange")] and plan.count("Window [percentile(") == 2


def test_blocks_are_neither_sorted_nor_carry_text(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, x string")
    x = F.col("x")
    stripped = T.strip(x).rlike(r"^((?U:\d{1,3})[.)]?(?U:\s)|\*(?U:\s)|[¹²³⁴⁵⁶⁷⁸⁹])")
    assert rows.filter(~T.looks_like_footnote_marker(x).eqNullSafe(stripped)).count() == 0 < rows.filter(T.looks_like_footnote_marker(x)).count()
    for name in ("column_assign", "column_ranges", "title_heading_classify"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        steps = [x for x in plan.split("\n") if "Aggregate(" in x and "min_by" in x]
        assert len(steps) == 2 and all("HashAggregate" in x and "text#" not in x for x in steps), name


def test_first_words_move_and_no_lines(spark):
    plan = queries.indent_words(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan[: plan.index("Exchange")]


def test_titles_need_no_merging(spark):
    docs = _documents(spark)
    regions = layout.regions(typeset.words(docs))
    want = reconstruct.titles(reconstruct.merge_paragraphs(reconstruct.page_blocks(regions)))
    zoned = layout.with_zone(layout.held_lines(typeset.lines(docs)))
    got = reconstruct.region_titles(layout.classified(layout.split_footnotes(layout.blocks(zoned, with_text=True))))
    assert sorted(got.collect()) == sorted(want.collect()) and any(r.title for r in got.collect())


def test_kinds_of_paragraphs_move_no_words(spark):
    plan = queries.quote_detect(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "__word_ord" not in plan


def test_documents_are_set_once_and_after_they_are_dealt(spark):
    names = "words_to_lines page_full_text margin_split column_ranges reading_order split_paragraphs style_runs bold_vs_block_median indent_words column_assign title_heading_classify"
    for name in names.split():
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("REPARTITION_BY_NUM"), name


def test_runs_from_parts_of_lines_are_those_from_words(spark):
    word = lambda n, text, bold=False, italic=False: (n, text, 0, 0, 90, bold, italic)
    made = [(1, 0, 1, 0, 0, 0, 20, [word(0, "Una", True), word(2, "pa-", True)]), (1, 0, 1, 0, 1, 50, 20, [word(10, "labra", True), word(12, "y"), word(14, "X-")]), (1, 0, 1, 0, 2, 99, 20, [word(20, "Y"), word(22, "", True, True), word(24, "z-", False, True)]), (1, 0, 1, 0, 3, 140, 20, [])]
    small = spark.createDataFrame(made, f"doc_id long, {typeset.LINE[7:-1]}")
    keys = ["doc_id", "page_index", "block_num", "par_num"]
    for rows, least in ((small, 4), (typeset.lines(_documents(spark)), 100)):
        words = rows.select(*keys, F.col("line_num").alias("line_ord"), F.inline("words"))
        parts = reconstruct.line_parts(rows, keys)
        assert parts.count() < words.count()
        got, want = reconstruct.run_rows(parts, keys, first="first", last="last"), reconstruct.run_rows(words, keys)
        assert sorted(got.collect()) == sorted(want.collect()) and got.count() >= least
    runs = reconstruct.run_rows(reconstruct.line_parts(small, keys), keys, first="first", last="last")
    assert [tuple(r)[5:] for r in runs.orderBy("run").collect()] == [("Una palabra ", True, False), ("y X- Y ", False, False), (" ", True, True), ("z-", False, True)]


def test_style_runs_move_no_words(spark):
    plan = queries.style_runs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline(words" not in plan and "listagg" not in plan


def test_runs_from_styles_of_lines_are_those_from_words(spark):
    word = lambda n, text, bold=False, italic=False: (n, text, 0, 0, 90, bold, italic)
    made = [(1, 0, 1, 0, 0, 0, 20, [word(0, "Una", True), word(2, "pa-", True)]), (1, 0, 1, 0, 1, 50, 20, [word(10, "labra", True), word(12, "y"), word(14, "X-")]), (1, 0, 1, 0, 2, 99, 20, [word(20, "Y"), word(22, "", True, True), word(24, "z-", False, True)])]
    small = spark.createDataFrame(made, f"doc_id long, {typeset.LINE[7:-1]}")
    keys = ["doc_id", "page_index", "block_num", "par_num"]
    style = layout.line_style(F.col("words.text"), F.col("words.is_bold"), F.col("words.is_italic")).alias("style")
    for rows, least in ((small, 1), (typeset.lines(_documents(spark)), 20)):
        lines = rows.select(*keys, F.col("line_num").alias("line_ord"), style).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line_ord", "style"))).alias("lines"))
        got = lines.select(*keys, reconstruct.styled_lines(F.col("lines")).alias("runs"))
        want = reconstruct.runs(rows.select(*keys, F.col("line_num").alias("line_ord"), F.inline("words")), keys)
        assert sorted(got.collect()) == sorted(want.collect()) and got.count() >= least
    styles = small.orderBy("line_num").select(style).select("style.*").collect()
    assert [(r.n_words, r.n_bold, r.n_italic, r.cut, r.small) for r in styles] == [(2, 2, 0, True, False), (3, 1, 0, True, True), (3, 1, 2, True, False)]


def test_blocks_of_documents_move_no_words(spark):
    plan = queries._page_blocks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "__word_ord" not in plan and "arrays_zip" not in plan and "listagg" not in plan


def test_rendered_documents_keep_no_table_and_move_text(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(reconstruct, "kept", lambda df, name: kept.append(name) or df)
    for name in ("render_text", "render_markdown", "render_html"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not kept and plan.count("ArrowEvalPython") == 1 and "runs#" not in plan[: plan.index("SortAggregate" if "SortAggregate" in plan else "ObjectHashAggregate")], name


def test_gathered_blocks_are_those_merged_over_pages(spark):
    blocks = reconstruct.page_blocks(layout.regions(typeset.words(_documents(spark))))
    want = reconstruct.merge_paragraphs(blocks)
    got = reconstruct.gathered(blocks)
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect()) and got.count() > 20
