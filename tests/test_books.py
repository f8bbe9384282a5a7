"""Recognition, translation and whole books, with engines that stand in for real ones."""

import io
import sys
import zipfile

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quire import cli
from quire.config import Config, ExportConfig, ImageConfig, LayoutConfig, OcrConfig, TranslationConfig
from quire.errors import Cancelled, EngineNotAvailable, UnsupportedFile
from quire.operators import images, layout, packages, recognize, translators
from quire.plans import books
from quire.sources import files

W = recognize.Word
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import this file


class Fake(recognize.Engine):
    """Finds one word a run of inked rows."""

    def recognize(self, image, config):
        spans = images.runs((image == 0).any(1))
        return [W(f"w{i}", 0, a, image.shape[1], b - a, 90.0, 1, 1, i) for i, (a, b) in enumerate(spans)]


def page():
    """A heading, two columns of lines, a page number."""
    p = np.full((1000, 600), 255, np.uint8)
    p[30:45, 200:400] = 0
    for y in range(120, 860, 20):
        p[y : y + 10, 40:280] = p[y : y + 10, 320:560] = 0
    p[940:950, 290:310] = 0
    return p


def test_crops():
    config = LayoutConfig()
    got = recognize.crops(page(), config)
    assert [(x[0], x[2], x[4]) for x in got] == [(0, 600, 0), (40, 280, 100_000), (320, 560, 200_000), (0, 600, 600_000)]
    assert got[0][3] == got[1][1] == got[2][1] and got[1][3] == got[3][1] and got[3][3] == 1000
    words = recognize.page_words(Fake(), page(), OcrConfig(), config)
    assert len(words) == 1 + 2 * 37 + 1 and {w.block_num for w in words} == {1, 100_001, 200_001, 600_001}
    assert (words[0].t, words[1].t, words[1].l, words[38].l, words[-1].t) == (30, 120, 40, 320, 940)
    assert recognize.crops(page(), LayoutConfig(detect_columns=False)) == [(0, 0, 600, 1000, 0)]
    assert recognize.crops(np.zeros((0, 5), np.uint8), config) == []


def test_engines(monkeypatch):
    class Missing(Fake):
        def available(self):
            return False

    monkeypatch.setattr(recognize, "ENGINES", {"fake": Fake, "gone": Missing})
    assert recognize.available() == ["fake"] and isinstance(recognize.engine_for("fake"), Fake)
    with pytest.warns(UserWarning):
        assert type(recognize.engine_for("gone", "fake")) is Fake
    with pytest.raises(EngineNotAvailable), pytest.warns(UserWarning):
        recognize.engine_for("gone", "gone")
    with pytest.raises(EngineNotAvailable):
        recognize.engine_for("other")
    quad = [(10.0, 5.0), (60.5, 6.0), (60.0, 20.0), (9.5, 19.0)]
    got = recognize.quad_words([(quad, "a", 0.3), (quad, " ", 0.9), (quad, "b c", 0.8)], 40)
    assert got == [W("b c", 9, 5, 51, 15, 80.0, line_num=2)]


def test_styles_and_kernels():
    bar = lambda width: np.pad(np.zeros((30, width), np.uint8), ((5, 5), (8, 8)), constant_values=255)
    assert images.stroke_width(bar(3)) < images.stroke_width(bar(6)) < images.stroke_width(bar(10)) and images.stroke_width(np.full((9, 9), 255, np.uint8)) == 0
    word = np.full((40, 90), 255, np.uint8)
    for k in range(3):
        for y in range(4, 36):
            x = 20 + 20 * k - (y - 20) // 4
            word[y, x : x + 5] = 0
    assert images.style(word)[0] and not images.style(word[:, ::-1])[0] and not images.style(word[:, :40])[0] and images.style(word[:0]) == (False, 0.0)
    assert all(abs(x + np.degrees(np.arctan(0.25))) < 1 for x in images.slants(word == 0))
    assert len(images.letters(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 0, 1]], bool))) == 3
    assert len(images.letters(np.array([[1, 0, 1], [1, 0, 1], [1, 1, 1]], bool))) == 1
    for angle in (-9.0, 4.0):
        turned = images.rotate(page(), angle)
        assert abs(images.skew(turned) + angle) < 0.2 or abs(images.skew(turned) - angle) < 0.2
        assert abs(images.skew(images.deskew(turned))) < 0.5
    assert images.rotate(page(), 0.01).shape == page().shape == images.deskew(images.rotate(page(), 30))[:1000, :600].shape
    dim = np.random.default_rng(0).normal(120, 8, (90, 70)).clip(0, 255).astype(np.uint8)
    assert images.enhance_contrast(dim).std() > 1.5 * dim.std() and images.denoise(dim[:40, :40]).std() < dim.std() / 2


BLOCK = "doc_id string, block_ordinal long, type string, runs array<struct<text: string, bold: boolean, italic: boolean>>, level int, list_ordered boolean, footnote_marker string, first_line_indent boolean, source_page long"


@pytest.fixture(scope="module")
def blocks(spark):
    row = lambda i, kind, *runs: ("d", i, kind, [(t, b, False) for t, b in runs], 1, kind == "list_item", None, False, 0)
    return spark.createDataFrame([row(0, "title", ("Uno", True)), row(1, "paragraph", ("dos ", False), ("tres", True)), row(2, "paragraph", (" ", False)), row(3, "list_item", ("malo", False))], BLOCK)


def test_translation_engines(spark, blocks, monkeypatch):
    def chat():
        def ask(system, prompt, most):
            assert most >= 1024 and "'fr'" in prompt and "<<<BLOCK_i>>>" in system
            return "<<<BLOCK_0>>>One<<<END_0>>> <<<BLOCK_1>>>two three<<<END_1>>> <<<BLOCK_2>>>bad<<<END_3>>>"

        return ask

    def broken():
        def ask(*_):
            raise RuntimeError("no")

        return ask

    def direct():
        def ask(text, source, target):
            if text == "malo":
                raise ValueError(text)
            return f"{source}>{target}:{text}"

        return ask

    on = TranslationConfig(enabled=True, engine="x", target_language="fr")
    texts = lambda df: [("".join(r.text for r in b.runs), b.type) for b in df.orderBy("block_ordinal").collect()]
    same = texts(blocks)
    got = translators.translated(blocks, on, translators.Chat(chat))
    assert texts(got) == [("One", "title"), ("two three", "paragraph"), (" ", "paragraph"), ("malo", "list_item")] and got.columns == blocks.columns
    assert [len(b.runs) for b in got.orderBy("block_ordinal").collect()] == [1, 1, 1, 1]
    assert texts(translators.translated(blocks, on, translators.Chat(broken))) == same
    assert texts(translators.translated(blocks, on, translators.Direct(direct), lambda text: "es")) == [("es>fr:Uno", "title"), ("es>fr:dos tres", "paragraph"), (" ", "paragraph"), ("malo", "list_item")]
    assert texts(translators.translated(blocks, TranslationConfig(enabled=False))) == same
    monkeypatch.setattr(translators, "ENGINES", {"x": translators.Chat(chat), "y": translators.Chat(chat, lambda: False)})
    assert translators.available() == ["x"] and translators.engine_for(on) is translators.ENGINES["x"] and translators.engine_for(TranslationConfig(True, "none")) is None
    for name in ("y", "z"):
        with pytest.raises(EngineNotAvailable):
            translators.engine_for(TranslationConfig(True, name))
    blank = blocks.filter("block_ordinal = 2").withColumn("doc_id", F.lit("e"))
    assert {r.doc_id: r.lang for r in translators.languages(blocks.unionByName(blank), lambda text: "es").collect()} == {"d": "es", "e": "en"}


def test_books(spark, tmp_path):
    kind = "doc_id string, page_index int, embedded_text string, image binary, width int, height int"
    pixels = page()[..., None].repeat(3, 2).tobytes()
    rows = [("a/1.png", 0, None, pixels, 600, 1000), ("b/t.pdf", 0, "Este texto es suficiente.\n\nY sigue otro.", None, None, None)]
    pages = spark.createDataFrame(rows, kind)
    config = Config(image=ImageConfig(crop_margins=False, remove_borders=False, binarization="otsu", enhance_contrast=False), export=ExportConfig(formats=("txt", "docx")))
    made = books.processed(pages, config, Fake)
    got = {d: [b.type for b in made.filter(F.col("doc_id") == d).orderBy("block_ordinal").collect()] for d in ("a/1.png", "b/t.pdf")}
    assert got["b/t.pdf"] == ["paragraph", "paragraph"] and got["a/1.png"]
    seen = []
    names = books.export(made, f"{tmp_path}/store", f"file://{tmp_path}/out", config, lambda *e: seen.append(e))
    assert sorted(names) == ["1.docx", "1.txt", "t.docx", "t.txt"] and seen == [("reconstruction", 1, 1), ("export", 1, 2), ("export", 2, 2)]
    assert (tmp_path / "out/t.txt").read_text() == "Este texto es suficiente.\n\nY sigue otro.\n"
    with pytest.raises(Cancelled):
        books.export(made, f"{tmp_path}/store", f"file://{tmp_path}/out", config, cancelled=lambda: True)
    for bad, error in (("pdf", EngineNotAvailable), ("odt", UnsupportedFile)):
        with pytest.raises(error):
            books.exported(made, bad)


def test_page_size_counts(spark):
    row = lambda i, top: (1, 0, i, f"linea {i}", 100, top, 300, 20, 95, i, 1, i, False, False, 4.0, 800, 1000)
    words = spark.createDataFrame([row(0, 20), row(1, 400), row(2, 960)], "doc_id long, page_index long, word_ord long, text string, l long, t long, w long, h long, confidence long, block_num long, par_num long, line_num long, is_bold boolean, is_italic boolean, stroke double, page_width int, page_height int")
    assert {r.block_num: r.type for r in layout.regions(words).collect()} == {0: "header", 1: "body_text", 2: "footer"}


def test_package_parts(blocks):
    with zipfile.ZipFile(io.BytesIO(packages.to_docx(blocks).first().content)) as z:
        assert {"word/styles.xml", "word/numbering.xml", "word/_rels/document.xml.rels"} <= set(z.namelist())
        styles = z.read("word/styles.xml").decode()
        assert all(f'w:styleId="{k}"' in styles for k in ("Title", "Heading1", "IntenseQuote", "ListBullet", "ListNumber")) and b'<w:numId w:val="2"/>' in z.read("word/document.xml")
    with zipfile.ZipFile(io.BytesIO(packages.epub("T & U", "es", [("A <b>", "<p>x</p>")]))) as z:
        assert b"A &lt;b&gt;" in z.read("toc.ncx") and b"dcterms:modified" in z.read("content.opf") and b'toc="ncx"' in z.read("content.opf")


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("uno\fdos")
    assert files.page_counts(files.pages(spark, str(tmp_path))).first().n_pages == 2
    parts = spark.createDataFrame([("d", 0, 0, 0, " a "), ("d", 0, 1, 1, "img"), ("d", 0, 2, 0, " "), ("d", 0, 3, 0, "b")], "doc_id string, page_index int, ord int, kind int, text string")
    assert files.block_texts(parts).first().embedded_text == "a\n\nb"
    (tmp_path / "x.zip").write_text("zip")
    with pytest.raises(UnsupportedFile):
        files.pages(spark, str(tmp_path))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "libro.txt").write_text("Un parrafo que tiene bastante texto.\n\nOtro parrafo.")
    out = tmp_path / "out"
    assert cli.main([f"{tmp_path}/libro.txt", "-o", str(out), "-f", "markdown", "-f", "html"], spark) == 0
    assert (out / "libro.md").read_text().startswith("Un parrafo") and "<p>Otro parrafo.</p>" in (out / "libro.html").read_text()
    assert "[export] 2/2" in capsys.readouterr().out
    assert cli.main([f"{tmp_path}/none.txt", "-o", str(out)], spark) == 1 and "Error" in capsys.readouterr().err
    (tmp_path / "c.yaml").write_text("export:\n  formats: [txt]\nocr:\n  languages: [fra]\n") if _yaml() else None
    args = ["x", "--lang", "deu", "--translate-to", "fr"] + (["--config", f"{tmp_path}/c.yaml"] if _yaml() else [])
    got = cli.configured(cli.parser().parse_args(args))
    assert got.ocr.languages == ("deu",) and got.translation.enabled and got.translation.target_language == "fr" and (not _yaml() or got.export.formats == ("txt",))


def _yaml():
    try:
        import yaml  # noqa: F401
    except ImportError:
        return False
    return True
