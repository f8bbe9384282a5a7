"""Frames of image files as a data source, routing and spreading of pages."""

import struct
import sys
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quire.config import Config, ImageConfig, LayoutConfig
from quire.errors import EngineNotAvailable
from quire.operators import recognize
from quire.plans import books
from quire.sources import files, frames

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import this file


def packed(data):
    out = b""
    for i in range(0, len(data), 100):
        part = data[i : i + 100]
        out += bytes([257 - len(part), part[0]]) if len(set(part)) == 1 and len(part) > 1 else bytes([len(part) - 1]) + part
    return out


def tiff(pages, order="<", packing=1, dpi=None, invert=False):
    """A TIFF file of images (grey, RGB or boolean), each in strips of seven rows."""
    out = bytearray({"<": b"II*\0", ">": b"MM\0*"}[order] + b"\0" * 4)
    link = 4
    for p in pages:
        bits = 1 if p.dtype == bool else 8
        rows = [(np.packbits(r if not invert else ~r, axis=-1) if bits == 1 else (255 - r if invert else r)).tobytes() for r in p]
        strips = [b"".join(rows[i : i + 7]) for i in range(0, len(rows), 7)]
        strips = [{1: bytes, 8: zlib.compress, 32773: packed}[packing](s) for s in strips]
        places = []
        for s in strips:
            places.append(len(out))
            out += s
        extra = lambda code, values: (len(out), out.extend(struct.pack(f"{order}{len(values)}{code}", *values)))[0]  # noqa: E731, B023
        many = lambda values: extra("I", values) if len(values) > 1 else values[0]  # noqa: E731, B023
        entries = [(256, 4, 1, p.shape[1]), (257, 4, 1, p.shape[0]), (258, 3, 1, bits), (259, 3, 1, packing), (262, 3, 1, 2 if p.ndim == 3 else 0 if invert else 1), (273, 4, len(strips), many(places)), (277, 3, 1, 3 if p.ndim == 3 else 1), (278, 4, 1, 7), (279, 4, len(strips), many([len(s) for s in strips]))]
        if dpi:
            entries += [(282, 5, 1, extra("I", (dpi * 10, 10))), (296, 3, 1, 2)]
        if len(out) % 2:
            out += b"\0"
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries))
        for tag, kind, n, value in entries:
            out += struct.pack(order + "HHI", tag, kind, n) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def png(width, height, dpi):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes([200]) * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"pHYs", struct.pack(">IIB", round(dpi / 0.0254), round(dpi / 0.0254), 1)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def images(seed=0):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, 256, (20, 13), np.uint8), rng.integers(0, 256, (9, 30, 3), np.uint8), rng.random((16, 21)) < 0.5, np.full((8, 8), 7, np.uint8)]


def as_bgr(p):
    p = p.astype(np.uint8) * 255 if p.dtype == bool else p
    return (p[..., ::-1] if p.ndim == 3 else p[..., None].repeat(3, 2)).tobytes()


@pytest.mark.parametrize("order, packing, invert", [("<", 1, False), (">", 1, False), ("<", 8, False), (">", 32773, False), ("<", 1, True)])
def test_frames_of_a_tiff(spark, tmp_path, order, packing, invert):
    pages = [p for p in images() if not (invert and p.ndim == 3)]
    (tmp_path / "x").mkdir()
    (tmp_path / "x/book.TIF").write_bytes(tiff(pages, order, packing, 200, invert))
    (tmp_path / "x/one.tiff").write_bytes(tiff(pages[:1], order, packing))
    (tmp_path / "x/_hidden.zip").write_bytes(b"")
    got = {(r.doc_id.rsplit("/", 1)[1], r.page_index): r for r in files.framed(spark, f"{tmp_path}/x", dpi=72).collect()}
    assert len(got) == len(pages) + 1
    for i, p in enumerate(pages):
        r = got["book.TIF", i]
        assert (r.width, r.height, r.dpi, r.n_pages, bytes(r.image)) == (p.shape[1], p.shape[0], 200, len(pages), as_bgr(p))
    assert got["one.tiff", 0].dpi == 72 and got["one.tiff", 0].n_pages == 1
    assert files.framed(spark, f"{tmp_path}/*").rdd.getNumPartitions() == len(pages) + 1
    both = files.pages(spark, f"{tmp_path}/x")
    assert both.count() == len(pages) + 1 and files.page_counts(both).count() == 2


def test_headers_without_pixels(spark, tmp_path):
    head = tiff(images(), dpi=150)
    (tmp_path / "a.tif").write_bytes(head)
    (tmp_path / "b.png").write_bytes(png(50, 40, 96))
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\1\0\x78\0\x78\0\0\xff\xc0\0\x0b\x08\0\x20\0\x30\1\1\x11\0")
    (tmp_path / "d.txt").write_text("uno\fdos")
    got = {(r.doc_id.rsplit("/", 1)[1], r.page_index): r for r in files.framed(spark, str(tmp_path), pixels=False).collect()}
    assert all(r.image is None for r in got.values()) and got["a.tif", 3].dpi == 150 and got["a.tif", 0].n_pages == 4
    assert (got["b.png", 0].width, got["b.png", 0].height, got["b.png", 0].dpi) == (50, 40, 96) and (got["c.jpg", 0].width, got["c.jpg", 0].height, got["c.jpg", 0].dpi) == (48, 32, 120)
    assert got["d.txt", 1].embedded_text == "dos" and got["d.txt", 0].n_pages == 2


def test_planning_reads_no_pixel(tmp_path, monkeypatch):
    big = tiff([np.zeros((900, 900), np.uint8)] * 3)
    (tmp_path / "a.tif").write_bytes(big)
    read = []
    real = frames.opened

    class Counted:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def seek(self, at):
            return self.file.seek(at)

        def read(self, *n):
            got = self.file.read(*n)
            read.append(len(got))
            return got

    monkeypatch.setattr(frames, "opened", lambda path: Counted(real(path)))
    assert len(frames.planned(str(tmp_path))) == 3 and sum(read) < 2000


def test_what_cannot_be_read_is_an_error(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(b"")
    with pytest.raises(Exception, match="unsupported files: zip"):
        files.framed(spark, str(tmp_path)).collect()
    other = tmp_path / "in"
    other.mkdir()
    data = bytearray(tiff(images()[:1]))
    at = data.index(struct.pack("<HHIH", 259, 3, 1, 1))
    data[at + 8] = 5  # a packing that isn't read here
    (other / "b.tif").write_bytes(data)
    try:
        import PIL  # noqa: F401
    except ImportError:
        with pytest.raises(Exception, match="imaging package"):
            files.framed(spark, str(other)).collect()
        with frames.opened(str(other / "b.tif")) as f, pytest.raises(EngineNotAvailable):
            frames.tiff_pixels(f, frames.tiff_header(f, frames.tiff_frames(f)[0]), "b.tif", 0)
    assert files.framed(spark, str(other), pixels=False).count() == 1


class WhereAmI(recognize.Engine):
    """One word a page: the partition that it is recognised in."""

    def recognize(self, image, config):
        from pyspark import TaskContext

        return [recognize.Word(f"part{TaskContext.get().partitionId()}", 1, 1, 5, 5, 90.0)]


def test_pages_of_one_book_are_recognised_in_all_tasks(spark):
    pages = spark.createDataFrame([("book.tif", i, None, bytes([255]) * 300, 10, 10) for i in range(400)] + [("t.pdf", 0, "Este texto es suficiente.", b"", 0, 0)], files.PAGE).coalesce(1)
    config = Config(image=ImageConfig(enabled=False), layout=LayoutConfig(detect_columns=False))
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        texts, scans = files.routed(pages)
        assert texts.select("doc_id").distinct().collect()[0][0] == "t.pdf" and scans.count() == 400
        words = recognize.words(books.images.prepare(scans, config.image), config, WhereAmI)
        assert len({r.text for r in words.select("text").collect()}) == 8
        plan = scans._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "page_index" in line and "REPARTITION_BY_NUM" in line]
        assert moved and not any("hashpartitioning(doc_id" in line and "image" in line and "page_index" not in line for line in plan.split("\n"))
        made = books.processed(pages, config, WhereAmI)
        assert made.filter(F.col("doc_id") == "t.pdf").count() == 1 and made.filter(F.col("doc_id") == "book.tif").count() >= 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)


def test_pdf_reader_and_uploads(spark, tmp_path):
    for name, data in (("a.pdf", b"2"), ("b.PDF", b""), ("c.pdf", b"3"), ("d.exe", b"x"), ("e.png", b"x" * 3_000_000)):
        (tmp_path / name).write_bytes(data)

    def reader(content):
        return [(f"pagina {i}", None, 10, 20) for i in range(int(content or b"0"))]

    got = sorted((r.doc_id.rsplit("/", 1)[1], r.page_index, r.embedded_text) for r in files.pdf_pages(spark, str(tmp_path), reader).collect())
    assert got == [("a.pdf", 0, "pagina 0"), ("a.pdf", 1, "pagina 1"), *[("c.pdf", i, f"pagina {i}") for i in range(3)]]
    up = files.uploads(spark, str(tmp_path), max_mb=2)
    assert {r["name"]: r.accepted for r in up.collect()} == {"a.pdf": True, "c.pdf": True, "d.exe": False, "e.png": False}  # Spark lists no empty files
    counted = {r["name"]: r.n_pages for r in files.with_page_counts(spark, up, str(tmp_path), reader).collect()}
    assert counted["a.pdf"] == 2 and counted["c.pdf"] == 3 and counted["e.png"] is None and files.with_page_counts(spark, up, str(tmp_path)).filter("n_pages is null").count() == 4
    with pytest.raises(EngineNotAvailable):
        files.pdf_pages(spark, str(tmp_path))


def test_log_goes_to_console_and_file_once(tmp_path, capsys):
    import logging

    from quire import logs

    for _ in range(2):
        logs.configure(logging.INFO, f"{tmp_path}/logs/quire.log")
    logging.getLogger("quire.plans").info("started")
    logging.getLogger("quire.plans").debug("hidden")
    logs.configure()
    assert (tmp_path / "logs/quire.log").read_text().count("started") == 1 and "hidden" not in (tmp_path / "logs/quire.log").read_text()
    assert capsys.readouterr().err.count("started") == 1
