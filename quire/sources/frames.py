"""Image and text files as pages, registered as the format ``book_pages``: a row a frame or a form-fed page.

``spark.read.format("book_pages").load(path)`` plans a partition for each file, and for each frame of a TIFF: planning lists names and follows the chain of a
TIFF's directories, no more than some hundred bytes of a file. With the option ``pixels`` off no pixel is read by the tasks either: sizes, resolutions and numbers of
pages come from headers. An unknown suffix is an error at planning.

Pixels of TIFF frames are read here, strip by strip, where they are stored plainly, packed by runs or deflated, and by the imaging package for all else where it is
installed. Other images get their pixels from Spark's own decoder, see ``files.images``; here they are null.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.errors import EngineNotAvailable, UnsupportedFile

TIFF, OTHER, TEXT = ("tif", "tiff"), ("png", "jpg", "jpeg", "bmp"), ("txt",)
SCHEMA = "doc_id string, page_index int, embedded_text string, image binary, width int, height int, dpi int, n_pages int"
# Numbers of TIFF fields (fixed values of the format).
_WIDTH, _HEIGHT, _BITS, _PACKING, _MEANING, _STRIPS, _SAMPLES, _ROWS, _SIZES, _X_RESOLUTION, _PLANES, _UNIT, _PREDICTOR, _COLOURS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 282, 284, 296, 317, 320
_FORMATS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i"}


@dataclass
class Header:
    """What a frame says of itself: size, dots per inch (0: nothing), and a TIFF's fields."""

    width: int
    height: int
    dpi: int = 0
    fields: dict[int, tuple] | None = None


def _order(file) -> str | None:
    file.seek(0)
    return {b"II*\0": "<", b"MM\0*": ">"}.get(file.read(4))


def _directory(file, order: str, at: int) -> tuple[dict[int, tuple[int, int, bytes]], int]:
    """Raw entries of a directory, and where the next one is (0: nowhere)."""
    file.seek(at)
    n = struct.unpack(order + "H", file.read(2))[0]
    held = file.read(12 * n + 4)
    entries = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", held, 12 * i)
        entries[tag] = (kind, count, held[12 * i + 8 : 12 * i + 12])
    return entries, struct.unpack_from(order + "I", held, 12 * n)[0]


def tiff_frames(file) -> list[int]:
    """Where the directory of each frame of a TIFF file stands."""
    order = _order(file)
    if order is None:
        raise UnsupportedFile("not a TIFF file")
    found: list[int] = []
    at = struct.unpack(order + "I", file.read(4))[0]
    while at and at not in found:
        found.append(at)
        at = _directory(file, order, at)[1]
    return found


def tiff_header(file, at: int) -> Header:
    order = _order(file)
    fields = {}
    for tag, (kind, count, held) in _directory(file, order, at)[0].items():
        code = _FORMATS.get(kind)
        if code is None:
            continue
        size = struct.calcsize("=" + code) * count
        if size > 4:
            file.seek(struct.unpack(order + "I", held)[0])
            held = file.read(size)
        fields[tag] = struct.unpack_from(f"{order}{code * count if len(code) > 1 else f'{count}{code}'}", held)
    scale = {2: 1.0, 3: 2.54}.get(fields.get(_UNIT, (2,))[0], 0)
    x = fields.get(_X_RESOLUTION, (0, 1))
    return Header(fields[_WIDTH][0], fields[_HEIGHT][0], round(x[0] / max(1, x[1]) * scale), fields)


def _unpacked(data: bytes) -> bytes:
    """Runs of bytes: a count and what it counts (the PackBits scheme)."""
    out, i = bytearray(), 0
    while i < len(data):
        n, i = data[i], i + 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def tiff_pixels(file, header: Header, path: str, frame: int) -> bytes:
    """Blue, green and red of each pixel, row by row."""
    f, w, h = header.fields or {}, header.width, header.height
    one = lambda tag, other: f.get(tag, (other,))[0]
    bits, packing, meaning, samples = one(_BITS, 1), one(_PACKING, 1), one(_MEANING, 1), one(_SAMPLES, 1)
    unpack = {1: lambda x: x, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpacked}.get(packing)
    if unpack is None or bits not in (1, 8) or meaning > 3 or samples > 1 and one(_PLANES, 1) != 1 or _STRIPS not in f:
        return _by_package(path, frame)
    row = -(-w * samples * bits // 8)
    parts = []
    for at, size in zip(f[_STRIPS], f[_SIZES], strict=True):
        file.seek(at)
        parts.append(unpack(file.read(size)))
    held = np.frombuffer(b"".join(parts), np.uint8)[: h * row].reshape(h, row)
    if bits == 1:
        pixels = np.unpackbits(held, axis=1)[:, :w, None] * np.uint8(1 if meaning == 3 else 255)
    else:
        pixels = held.reshape(h, w, samples)
        if one(_PREDICTOR, 1) == 2:
            pixels = np.cumsum(pixels, 1, dtype=np.uint8)
    if meaning == 3:
        colours = (np.array(f[_COLOURS]).reshape(3, -1) >> 8).astype(np.uint8)
        pixels = colours[:, pixels[..., 0]].transpose(1, 2, 0)
    elif meaning == 0:
        pixels = 255 - pixels
    pixels = pixels[..., :3] if pixels.shape[2] >= 3 else pixels[..., :1].repeat(3, 2)
    return np.ascontiguousarray(pixels[..., ::-1]).tobytes()


def _by_package(path: str, frame: int) -> bytes:
    try:
        from PIL import Image
    except ImportError:
        raise EngineNotAvailable(f"{path}: this kind of TIFF needs an imaging package") from None
    with opened(path) as file, Image.open(file) as image:
        image.seek(frame)
        return np.ascontiguousarray(np.array(image.convert("RGB"))[..., ::-1]).tobytes()


def other_header(file, suffix: str) -> Header:
    """Size and resolution of a PNG, BMP or JPEG file from its first bytes."""
    if suffix == "png":
        head = file.read(33)
        width, height, dpi = *struct.unpack(">II", head[16:24]), 0
        while len(chunk := file.read(8)) == 8 and chunk[4:] not in (b"IDAT", b"IEND"):
            size = struct.unpack(">I", chunk[:4])[0]
            held = file.read(size + 4)
            if chunk[4:] == b"pHYs" and held[8] == 1:
                dpi = round(struct.unpack(">I", held[:4])[0] * 0.0254)
        return Header(width, height, dpi)
    if suffix == "bmp":
        head = file.read(54)
        return Header(*map(abs, struct.unpack("<ii", head[18:26])), round(struct.unpack("<i", head[38:42])[0] * 0.0254))
    file.read(2)
    dpi = 0
    while len(mark := file.read(4)) == 4:
        kind, size = mark[1], struct.unpack(">H", mark[2:])[0] - 2
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", file.read(5)[1:])
            return Header(width, height, dpi)
        held = file.read(size)
        if kind == 0xE0 and held[:4] == b"JFIF":
            unit, x = held[7], struct.unpack(">H", held[8:10])[0]
            dpi = round(x * {1: 1, 2: 2.54}.get(unit, 0))
    raise UnsupportedFile("not a JPEG file")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


def opened(path: str):
    store, at = _store(path)
    return store.open_input_file(at)


def listed(path: str) -> list[str]:
    """Files of a folder, or of what a pattern matches, without hidden ones, as addresses in order; folders below are left out, as Spark's file sources do."""
    from pyarrow import fs

    fixed = path if not any(x in path for x in "*?[") else path[: min(path.index(x) for x in "*?[" if x in path)].rpartition("/")[0]
    store, at = _store(fixed)
    begin = path.split("://")[0] if "://" in path else "file"
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise UnsupportedFile(f"no files in {path}")
    wanted = path[len(fixed) :].strip("/").split("/") if fixed != path else []
    below = lambda p: p[len(at) :].strip("/").split("/") if p != at else []
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=bool(wanted)))
    fits = lambda own: len(wanted) <= len(own) <= len(wanted) + 1 and all(map(fnmatch, own, wanted))
    shown = [x.path for x in found if x.type == fs.FileType.File and fits(below(x.path)) and not any(p[:1] in "._" for p in below(x.path))]
    return sorted(f"{begin}://{'' if begin != 'file' or p.startswith('/') else '/'}{p}" for p in shown)


def suffix_of(path: str) -> str:
    return os.path.splitext(path)[1][1:].lower()


@dataclass
class Frame(InputPartition):
    """A file, or a frame of it: where its directory is."""

    path: str
    index: int
    at: int
    of: int


def planned(path: str, only: tuple[str, ...] = ()) -> list[Frame]:
    """A partition for each file (of the suffixes ``only``) and frame. Files of an unknown kind, and TIFF files without an image, are an error."""
    out: list[Frame] = []
    paths = [p for p in listed(path) if not only or suffix_of(p) in only]
    if unknown := sorted({suffix_of(p) for p in paths} - {*TIFF, *OTHER, *TEXT}):
        raise UnsupportedFile(f"unsupported files: {', '.join(unknown)}")
    for p in paths:
        if suffix_of(p) in TIFF:
            with opened(p) as file:
                found = tiff_frames(file)
                if not found or any(not {_WIDTH, _HEIGHT} <= set(_directory(file, _order(file), at)[0]) for at in found):
                    raise UnsupportedFile(f"not an image: {p}")
            out += [Frame(p, i, at, len(found)) for i, at in enumerate(found)]
        else:
            out.append(Frame(p, 0, 0, 1))
    return out


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.dpi = options["path"], int(options.get("dpi", "300"))
        self.pixels = options.get("pixels", "true").lower() == "true"

    def partitions(self) -> list[Frame]:
        return planned(self.path) or [Frame("", 0, 0, 0)]

    def read(self, frame: Frame) -> Iterator[tuple]:
        if not frame.of:
            return
        suffix = suffix_of(frame.path)
        with opened(frame.path) as file:
            if suffix in TEXT:
                pages = file.read().decode("utf-8", "replace").split("\f")
                yield from ((frame.path, i, text, None, None, None, self.dpi, len(pages)) for i, text in enumerate(pages))
                return
            header = tiff_header(file, frame.at) if suffix in TIFF else other_header(file, suffix)
            pixels = tiff_pixels(file, header, frame.path, frame.index) if self.pixels and suffix in TIFF else None
            yield frame.path, frame.index, None, pixels, header.width, header.height, header.dpi or self.dpi, frame.of


class PageSource(DataSource):
    """``SCHEMA`` of files; options ``dpi`` (where a file tells none) and ``pixels``."""

    @classmethod
    def name(cls) -> str:
        return "book_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("book_pages")`` known to a session."""
    spark.dataSource.register(PageSource)
