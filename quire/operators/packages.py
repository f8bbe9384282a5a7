"""Documents as DOCX and EPUB packages, made a document at a time with the standard library."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterable
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import render
from quire.sources import files
from quire.tables import ranked

#: Word styles of block types (fixed values).
STYLES = {"title": "Title", "heading": "Heading1", "quote": "IntenseQuote", "list_item": "ListBullet"}
#: Name, base size in half points, and more, of each style in Word (fixed names).
WORD_STYLES = {
    "Title": ("Title", 56, "", ""), "Heading1": ("heading 1", 32, "<w:b/>", '<w:keepNext/><w:outlineLvl w:val="0"/>'),
    "IntenseQuote": ("Intense Quote", 22, "<w:i/>", '<w:ind w:left="864" w:right="864"/>'),
    "ListBullet": ("List Bullet", 22, "", '<w:numPr><w:numId w:val="1"/></w:numPr>'), "ListNumber": ("List Number", 22, "", '<w:numPr><w:numId w:val="2"/></w:numPr>'),
}
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _zip(files: list[tuple[str, str]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, (name, text) in enumerate(files):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))  # the same bytes each time
            z.writestr(info, text, zipfile.ZIP_STORED if i == 0 else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _styles() -> str:
    """The part that says what the paragraph styles look like."""
    one = lambda key, name, size, look, more: (
        f'<w:style w:type="paragraph" w:styleId="{key}"><w:name w:val="{name}"/><w:basedOn w:val="Normal"/><w:qFormat/><w:pPr>{more}</w:pPr><w:rPr>{look}<w:sz w:val="{size}"/></w:rPr></w:style>'
    )
    normal = '<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/><w:qFormat/><w:rPr><w:sz w:val="22"/></w:rPr></w:style>'
    return f'<?xml version="1.0"?><w:styles xmlns:w="{_W}">{normal}{"".join(one(k, *v) for k, v in WORD_STYLES.items())}</w:styles>'


def _numbering(lists: int) -> str:
    """The part that numbers lists: 1 for bullets, from 2 on a count of its own for each numbered list."""
    level = lambda i, kind, text: f'<w:abstractNum w:abstractNumId="{i}"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="{text}"/><w:pPr><w:ind w:left="720" w:hanging="360"/></w:pPr></w:lvl></w:abstractNum>'
    own = "".join(f'<w:num w:numId="{i}"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="1"/></w:lvlOverride></w:num>' for i in range(2, lists + 3))
    return f'<?xml version="1.0"?><w:numbering xmlns:w="{_W}">{level(0, "bullet", "•")}{level(1, "decimal", "%1.")}<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num>{own}</w:numbering>'


def docx(blocks: list[dict]) -> bytes:
    """Paragraphs with styles, bold and italic runs; footnote markers raised, first lines indented."""
    body, lists, before = [], 0, None
    for b in blocks:
        style = "ListNumber" if b["type"] == "list_item" and b["list_ordered"] else STYLES.get(b["type"])
        lists += style == "ListNumber" and before != style  # a numbered list begins at one
        before = style
        number = f'<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{lists + 1}"/></w:numPr>' if style == "ListNumber" else ""
        head = (f'<w:pStyle w:val="{style}"/>' if style else "") + number + ('<w:ind w:firstLine="432"/>' if b["first_line_indent"] else "")
        runs = [f'<w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t>{escape(b["footnote_marker"])}</w:t></w:r>'] if b.get("footnote_marker") else []
        for r in b["runs"]:
            look = "<w:b/>" * bool(r["bold"]) + "<w:i/>" * bool(r["italic"]) + '<w:sz w:val="18"/>' * (b["type"] == "footnote")
            runs.append(f'<w:r><w:rPr>{look}</w:rPr><w:t xml:space="preserve">{escape(r["text"], quote=False)}</w:t></w:r>')
        body.append(f"<w:p><w:pPr>{head}</w:pPr>{''.join(runs)}</w:p>")
    part = lambda n: f'<Override PartName="/word/{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.{n}+xml"/>'
    link = lambda n: f'<Relationship Id="{n}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{n}" Target="{n}.xml"/>'
    kinds = "http://schemas.openxmlformats.org/package/2006/content-types"
    return _zip(
        [
            ("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{kinds}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>{"".join(part(n) for n in ("styles", "numbering"))}</Types>'),
            ("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'),
            ("word/_rels/document.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{link("styles")}{link("numbering")}</Relationships>'),
            ("word/styles.xml", _styles()),
            ("word/numbering.xml", _numbering(lists)),
            ("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{_W}"><w:body>{"".join(body)}</w:body></w:document>'),
        ]
    )


def epub(title: str, lang: str, chapters: list[tuple[str, str]], modified: str = "2000-01-01T00:00:00Z") -> bytes:
    """Chapters (title, HTML) with contents and reading order; the id follows from what is inside."""
    own = hashlib.sha256(repr((title, chapters)).encode()).hexdigest()[:32]
    names = [f"chap_{i}.xhtml" for i in range(1, len(chapters) + 1)]
    page = lambda t, body: f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" lang="{escape(lang)}"><head><title>{escape(t)}</title></head><body>{body}</body></html>'
    links = "".join(f'<li><a href="{n}">{escape(t)}</a></li>' for n, (t, _) in zip(names, chapters, strict=True))
    manifest = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
    points = "".join(f'<navPoint id="p{i}" playOrder="{i + 1}"><navLabel><text>{escape(t)}</text></navLabel><content src="{n}"/></navPoint>' for i, (n, (t, _)) in enumerate(zip(names, chapters, strict=True)))
    ncx = f'<?xml version="1.0"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{own}"/></head><docTitle><text>{escape(title)}</text></docTitle><navMap>{points}</navMap></ncx>'
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(names)))
    return _zip(
        [
            ("mimetype", "application/epub+zip"),
            ("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'),
            ("content.opf", f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{own}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>{escape(lang)}</dc:language><meta property="dcterms:modified">{modified}</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{manifest}</manifest><spine toc="ncx">{spine}</spine></package>'),
            ("toc.ncx", ncx),
            ("nav.xhtml", page(title, f'<nav epub:type="toc" xmlns:epub="http://www.idpf.org/2007/ops"><ol>{links}</ol></nav>')),
            *[(n, page(t, body)) for n, (t, body) in zip(names, chapters, strict=True)],
        ]
    )


def to_docx(blocks: DataFrame) -> DataFrame:
    """``doc_id, content``: a package a document."""

    def one(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "content": [docx(list(b)) for b in frame["blocks"]]})

    held = F.sort_array(F.collect_list(F.struct("block_ordinal", "type", "runs", "list_ordered", "footnote_marker", "first_line_indent")))
    return blocks.groupBy("doc_id").agg(held.alias("blocks")).mapInPandas(one, f"doc_id {blocks.schema['doc_id'].dataType.simpleString()}, content binary")


def to_epub(blocks: DataFrame, titles: DataFrame, lang: str = "es") -> DataFrame:
    """``doc_id, content``: every title opens a chapter. HTML of chapters is made by SQL; only the package is Python."""
    marked = render.chapters(blocks)
    key = F.struct("doc_id", "chapter")
    bodies = render.to_html_body(marked.withColumn("doc_id", key)).select("doc_id.*", "body")
    named = marked.groupBy("doc_id", "chapter").agg(F.first("chapter_title").alias("name"))
    held = bodies.join(named, ["doc_id", "chapter"]).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chapter", "name", "body"))).alias("chapters")).join(titles, "doc_id")

    def one(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            made = [epub(t or "Documento", lang, [(c["name"], c["body"]) for c in chapters]) for t, chapters in zip(frame["title"], frame["chapters"], strict=True)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "content": made})

    return held.select("doc_id", "title", "chapters").mapInPandas(one, f"doc_id {blocks.schema['doc_id'].dataType.simpleString()}, content binary")


def file_names(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, name`` of every document: the stem of its path, made unique.

    Of documents that share a stem the first by id has it alone, the next ones are called ``stem~2``, ``stem~3``. A stem that ends like that itself always gets a
    number, so that no two names meet. A stem that most documents share is ranked in chunks, see ``tables.ranked``.
    """
    rows = docs.select(id_col).distinct().withColumn("stem", files.stem(F.col(id_col).cast("string")))
    plain = (F.col("rank") == 1) & ~F.col("stem").rlike("~[0-9]+$")
    named = F.when(plain, F.col("stem")).otherwise(F.concat_ws("~", "stem", F.col("rank").cast("string")))
    return ranked(rows, ["stem"], [id_col], "rank").select(id_col, named.alias("name"))


MANIFEST = "format string, name string, bytes long, sha256 string"


def write_files(rendered: DataFrame, path: str, extension: str, format_: str | None = None) -> DataFrame:
    """Writes each row's ``content`` to ``path/<name>.<extension>`` from the tasks; a file appears only when whole. Gives ``doc_id`` and ``MANIFEST``, a row a file,
    once the files are there: write it to make it happen. A task that runs again writes the same files. Rows without a ``name`` are called by their id, slashes as
    underscores; see ``file_names`` for names that never meet."""
    if "name" not in rendered.columns:
        rendered = rendered.withColumn("name", F.replace(F.col("doc_id").cast("string"), F.lit("/"), F.lit("_")))
    format_ = format_ or extension
    kind = rendered.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, at = fs.FileSystem.from_uri(path)
        store.create_dir(at, recursive=True)
        for frame in frames:
            rows = []
            for doc_id, own, content in zip(frame["doc_id"], frame["name"], frame["content"], strict=True):
                name, data = f"{own}.{extension}", content if isinstance(content, bytes) else content.encode()
                draft = f"{at}/.{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(draft) as out:
                    out.write(data)
                store.move(draft, f"{at}/{name}")
                rows.append((doc_id, format_, name, len(data), hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", *[c.split()[0] for c in MANIFEST.split(", ")]])

    return rendered.select("doc_id", "name", "content").mapInPandas(run, f"doc_id {kind}, {MANIFEST}")
