import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.config import Config, ConfigError, LayoutConfig
from quire.errors import UnsupportedFile
from quire.functions import text as T
from quire.operators import images, jobs, layout, packages, reconstruct, render, translate
from quire.plans import books
from quire.sources import files
from quire.streaming import ingest

WORD = "doc_id long, page_index long, word_ord long, text string, l long, t long, w long, h long, confidence long, block_num long, par_num long, line_num long, is_bold boolean, is_italic boolean, stroke double"


def words(spark, lines, bold=()):
    """``lines``: (left, top, text); pitch and boxes as a recogniser would give them."""
    rows, n = [], 0
    for k, (left, top, text) in enumerate(lines):
        for word in text.split():
            rows.append((1, 0, n, word, left, top, 15 * len(word), 40, 95, 1, 1, k, n in bold, False, 4.0))
            left += 15 * len(word) + 15
            n += 1
    return spark.createDataFrame(rows, WORD)


def paragraphs(spark, lines, bold=()):
    w = words(spark, lines, bold)
    return [r.text for r in reconstruct.merge_paragraphs(reconstruct.page_blocks(layout.regions(w))).orderBy("block_ordinal").select(reconstruct.plain("runs").alias("text")).collect()]


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        ([(100, 500, "one two"), (100, 546, "three.")], ["one two three."]),
        ([(100, 500, "a b."), (100, 546, "c."), (100, 662, "d.")], ["a b. c.", "d."]),
        ([(100, 500, "a b."), (180, 546, "c."), (100, 592, "d.")], ["a b.", "c. d."]),
        ([(100, 500, "la parti-"), (100, 546, "da sigue.")], ["la partida sigue."]),
        ([(100, 500, "la oracion-"), (100, 546, "Nueva sigue.")], ["la oracion- Nueva sigue."]),
        ([(100, 500, "goes"), (180, 546, "on.")], ["goes on."]),
    ],
)
def test_paragraphs(spark, lines, want):
    assert paragraphs(spark, lines) == want


def test_runs_follow_style(spark):
    got = reconstruct.runs(words(spark, [(100, 500, "a b c")], bold={1}).withColumn("line_ord", F.col("line_num")), ["doc_id"]).first().runs
    assert [(r.text, r.bold) for r in got] == [("a ", False), ("b ", True), ("c", False)]


def test_text_predicates(spark):
    texts = ["- x", "1. x", "plain", "iv) x", "….", "no dot", "", "42", " - 7 - ", "xiv", "12345", "1 note", "¹note", "*x", "٣. عدد"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    got = rows.select("i", T.is_bullet(t).alias("b"), T.is_numbered(t).alias("n"), T.ends_sentence(t).alias("e"), T.looks_like_page_number(t).alias("p"), T.looks_like_footnote_marker(t).alias("f")).orderBy("i").collect()
    assert [r.i for r in got if r.b] == [0, 8] and [r.i for r in got if r.n] == [1, 3, 14]
    assert [r.e for r in got][4:7] == [True, False, True]
    assert [r.i for r in got if r.p] == [0, 7, 8, 9] and [r.i for r in got if r.f] == [1, 11, 12, 14]


def test_blank_line_paragraphs_and_escape(spark):
    df = spark.createDataFrame([("a\nb\n \nc  d",), ("\n\n\n",), ("",)], "t string")
    assert [r[0] for r in df.select(T.blank_line_paragraphs(F.col("t"))).collect()] == [["a b", "c d"], [], []]
    assert spark.range(1).select(T.html_escape(F.lit("<a & 'b' \"c\">"))).first()[0] == "&lt;a &amp; &#x27;b&#x27; &quot;c&quot;&gt;"


BLOCK = "doc_id long, block_ordinal long, type string, runs array<struct<text: string, bold: boolean, italic: boolean>>, level int, list_ordered boolean, footnote_marker string, first_line_indent boolean, source_page long"


@pytest.fixture(scope="module")
def book(spark):
    run = lambda t, b=False, i=False: (t, b, i)
    rows = [
        ("title", [run("Mi Libro")], False, None), ("paragraph", [run("Con "), run("negrita", True), run(" y <x>")], False, None), ("quote", [run("Una cita.")], False, None),
        ("list_item", [run("Primero")], False, None), ("list_item", [run("Segundo")], True, None), ("footnote", [run("Nota.")], False, "1"), ("title", [run("Fin")], False, None),
    ]
    return spark.createDataFrame([(1, i, k, r, 1, o, m, False, 0) for i, (k, r, o, m) in enumerate(rows)], BLOCK)


def test_renderers(book):
    assert render.to_text(book).first().content == "MI LIBRO\n========\n\nCon negrita y <x>\n\n    Una cita.\n\n- Primero\n- Segundo\n\n[1] Nota.\n\nFIN\n===\n"
    assert render.to_markdown(book).first().content == "# Mi Libro\n\nCon **negrita** y <x>\n\n> Una cita.\n\n- Primero\n- Segundo\n\n[^1]: Nota.\n\n# Fin\n"
    body = render.to_html_body(book).first().body
    assert "<ul>\n<li>Primero</li>\n<li>Segundo</li>\n</ul>" in body and "<strong>negrita</strong> y &lt;x&gt;" in body and "<sup>1</sup> Nota." in body


def test_packages(spark, book, tmp_path):
    titles = reconstruct.titles(book)
    assert titles.first().title == "Mi Libro"
    with zipfile.ZipFile(io.BytesIO(packages.to_epub(book, titles).first().content)) as z:
        assert z.namelist()[0] == "mimetype" and {"chap_1.xhtml", "chap_2.xhtml"} <= set(z.namelist())
    with zipfile.ZipFile(io.BytesIO(packages.to_docx(book).first().content)) as z:
        assert b"ListNumber" in z.read("word/document.xml")
    names = packages.write_files(render.to_markdown(book), f"file://{tmp_path}/out", "md").collect()
    assert [r.name for r in names] == ["1.md"] and (tmp_path / "out/1.md").read_text().startswith("# Mi Libro")
    assert {f: books.exported(book, f).count() for f in ("txt", "markdown", "html", "docx", "epub")} == dict.fromkeys(("txt", "markdown", "html", "docx", "epub"), 1)


def test_translation(spark):
    blocks = spark.createDataFrame([(1, i, t) for i, t in enumerate(["x" * 2000, "y" * 900, " ", "z" * 200, "w" * 5000, "v"])], "doc_id long, block_ordinal long, text string")
    batched = translate.batches(blocks)
    assert [(r.block_ordinal, r.batch_id, r.local_i) for r in batched.orderBy("block_ordinal").collect()] == [(0, 0, 0), (1, 0, 1), (3, 1, 0), (4, 2, 0), (5, 3, 0)]
    reply = "<<<BLOCK_0>>>\n A <<<END_0>>> noise <<<BLOCK_1>>> lost <<<END_2>>> <<<BLOCK_0>>>B\nC<<<END_0>>>"
    parsed = translate.parse_replies(spark.createDataFrame([(1, 0, reply)], "doc_id long, batch_id long, reply string"))
    got = {r.block_ordinal: r.text for r in translate.apply(blocks, batched, parsed).collect()}
    assert got[0] == "B\nC" and got[1] == "y" * 900 and len(got) == 6


def test_jobs(spark):
    log = spark.createDataFrame([("a", 1, "pending", None), ("a", 2, "running", "ocr"), ("b", 1, "pending", None)], "job_id string, seq long, status string, stage string")
    change = spark.createDataFrame([("a", "done")], "job_id string, status string")
    after = log.unionByName(jobs.changed(log, change))
    assert {r.job_id: (r.seq, r.status, r.stage) for r in jobs.latest(after).collect()} == {"a": (3, "done", "ocr"), "b": (1, "pending", None)}


def test_column_index(spark):
    ranges = F.array(*[F.struct(F.lit(a).cast("long").alias("l"), F.lit(b).cast("long").alias("r")) for a, b in ((100, 700), (800, 1500))])
    at = lambda left, right: spark.range(1).select(layout.column_index(F.lit(left), F.lit(right), ranges)).first()[0]
    assert [at(120, 600), at(810, 900), at(100, 1400), at(740, 750), at(760, 770)] == [0, 1, -1, 0, 1]


def test_images():
    page = np.full((400, 300), 255, np.uint8)
    page[40:44, 20:280] = 0
    for y in range(80, 300, 8):
        page[y : y + 4, 20:140] = page[y : y + 4, 160:280] = 0
    page[370:374, 140:160] = 0
    assert images.otsu(page) == 0 and images.column_ranges(np.delete(page, [*range(40, 44), *range(370, 374)], 0)) == [(20, 140), (160, 280)]
    assert 44 <= images.header_cut(page, 0.3) < 80
    assert 300 < images.bottom_cut(page) < 370
    framed = np.pad(page, 10, constant_values=0)
    assert images.remove_black_borders(framed).shape == page.shape
    assert images.crop_margins(page).shape[0] < 400 and set(np.unique(images.binarize(page, "sauvola"))) <= {0, 255}
    with pytest.raises(ValueError):
        images.binarize(page, "no")
    assert images.cap_dimension(page, 100).shape == (100, 75) and images.cap_dimension(page, 399).shape == (399, 299)
    ramp = np.arange(0, 240, 2, dtype=np.uint8)[None].repeat(4, 0)
    assert np.abs(images.cap_dimension(ramp, 80)[0].astype(float) - (np.arange(80) * 3 + 1)).max() <= 1
    speck = page.copy()
    speck[60, 150] = 0  # one dark pixel parts no gap
    assert images._gaps(speck) == images._gaps(page) and images.significant_gap(speck) == images.significant_gap(page)
    light = np.linspace(60, 255, 300)  # uneven, so that one threshold can't serve
    shaded = np.where(page == 0, light - 50, light).astype(np.uint8)
    right = lambda method: ((images.binarize(shaded, method) == 0) == (page == 0)).mean()
    assert right("adaptive_gaussian") > 0.97 > right("otsu")


def test_config():
    assert Config.from_dict({"layout": {"max_columns": 2}}).layout.max_columns == 2
    for bad in ({"x": {}}, {"layout": {"typo": 1}}, {"layout": {"max_columns": 9}}, {"export": {"formats": []}}, {"ocr": {"languages": []}}):
        with pytest.raises(ConfigError):
            Config.from_dict(bad)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one\ntwo\n\nthree")
    go = lambda: ingest.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    go()
    (tmp_path / "in/b.txt").write_text("four")
    go()
    got = sorted((r.doc_id.rsplit("/", 1)[1], r.para, r.text) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a.txt", 0, "one two"), ("a.txt", 1, "three"), ("b.txt", 0, "four")]


def _bmp(gray):
    h, w = gray.shape
    rows = b"".join(np.repeat(r, 3).tobytes().ljust(-(-3 * w // 4) * 4, b"\0") for r in gray[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def test_files(spark, tmp_path):
    page = np.full((60, 40), 255, np.uint8)
    page[20:24, 5:35] = 0
    for name in ("a", "b"):  # files of one name in two folders are two documents
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "1.bmp").write_bytes(_bmp(page))
    pages = files.images(spark, f"{tmp_path}/in/*")
    assert pages.select("doc_id").distinct().count() == 2 and {(r.width, r.height) for r in pages.collect()} == {(40, 60)}
    made = images.prepare(pages).collect()
    assert len(made) == 2 and all(len(r.image) == r.width * r.height for r in made)
    ifd = lambda nxt: struct.pack("<H", 0) + struct.pack("<I", nxt)
    two = b"II*\0" + struct.pack("<I", 8) + ifd(14) + ifd(0)
    assert files.frames(two) == 2 and files.frames(_bmp(page)) == 0
    (tmp_path / "in/a/2.tif").write_bytes(two)
    with pytest.raises(UnsupportedFile):
        files.images(spark, f"{tmp_path}/in/*")


def test_language_codes(spark):
    codes = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    row = spark.range(1).select(T.named_code(codes("jpn", "eng")).alias("a"), T.named_code(codes()).alias("b"), T.short_codes(codes("kor", "xxx", "eng")).alias("c"), T.short_codes(codes()).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ("japan", "en", ["ko", "en"], ["en"])


def test_removal_flags_and_quotes(spark):
    head = [(100, 30, "Un encabezado"), (100, 2110, "12")]
    body = [(100, 500 + 46 * i, "texto normal de una linea bastante larga aqui.") for i in range(6)]
    w = words(spark, head + body).withColumn("block_num", F.when(F.col("t") < 100, 1).when(F.col("t") > 2000, 3).otherwise(2).cast("long"))
    kinds = lambda config: sorted(r.type for r in layout.regions(w, config).collect())
    assert kinds(LayoutConfig()) == ["body_text", "header", "page_number"]
    assert kinds(LayoutConfig(remove_headers=True, remove_page_numbers=True)) == ["body_text"]
    assert books.from_words(w).count() >= 1
    texts = spark.createDataFrame([("d", 0, "uno\n\ndos"), ("d", 1, None), ("d", 2, "tres")], "doc_id string, page_index int, embedded_text string")
    assert [(r.block_ordinal, r.runs[0].text, r.source_page) for r in books.from_text_layer(texts).orderBy("block_ordinal").collect()] == [(0, "uno", 0), (1, "dos", 0), (2, "tres", 2)]


def test_entry_lists_sql_for_its_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and {"paragraph_merge", "reading_order", "render_html"} <= set(e.oracle_sql())
