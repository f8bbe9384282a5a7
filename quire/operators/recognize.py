"""Page images to words: a plug-in contract for recognition engines, and the crops that an engine sees.

An engine is made once a Python worker task and gets one crop at a time: the band above the body, each column of the body, the band below.
Boxes are moved back to the page, and block numbers get an offset for each crop, so that no block crosses columns or bands.
"""

from __future__ import annotations

import warnings
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quire.config import Config, LayoutConfig, OcrConfig
from quire.errors import EngineNotAvailable
from quire.operators import images

#: What is added to block numbers: nothing above the body, so much a column, and past the last possible column below (a fixed value).
BLOCK_OFFSET = 100_000
WORDS = (
    "doc_id string, page_index int, word_ord long, text string, l long, t long, w long, h long, confidence double, block_num long, par_num long, line_num long, "
    "is_bold boolean, is_italic boolean, stroke double, page_width int, page_height int"
)


@dataclass(frozen=True)
class Word:
    text: str
    l: int  # noqa: E741
    t: int
    w: int
    h: int
    confidence: float
    block_num: int = 0
    par_num: int = 0
    line_num: int = 0


class Engine(ABC):
    """What recognises: words of a grey image with boxes and confidences from 0 to 100."""

    name = ""

    def available(self) -> bool:
        return True

    @abstractmethod
    def recognize(self, image: np.ndarray, config: OcrConfig) -> list[Word]: ...


class Tesseract(Engine):
    """By the pytesseract package, where it is installed."""

    name = "tesseract"

    def available(self) -> bool:
        try:
            import pytesseract

            pytesseract.get_tesseract_version()
        except Exception:  # the package or the program is missing
            return False
        return True

    def recognize(self, image: np.ndarray, config: OcrConfig) -> list[Word]:
        import pytesseract

        found = pytesseract.image_to_data(image, lang="+".join(config.languages), config=f"--psm {config.psm} --oem {config.oem}", output_type=pytesseract.Output.DICT)
        return table_words(found)


def table_words(found: dict[str, list]) -> list[Word]:
    """Words out of columns by name (text, conf, left, top, ...), as recognition programs list them: texts as they are, whatever they look like, without the
    white space around them; rows without a text, or for a box and not a word (a negative confidence), go."""
    rows = zip(*(found[n] for n in ("text", "left", "top", "width", "height", "conf", "block_num", "par_num", "line_num")), strict=True)
    return [Word(text.strip(), *map(int, box), float(conf), *map(int, nums)) for text, *box, conf, b, p, l in rows for nums in [(b, p, l)] if text.strip() and float(conf) >= 0]  # noqa: E741


ENGINES: dict[str, Callable[[], Engine]] = {"tesseract": Tesseract}


def available() -> list[str]:
    """Names of the registered engines that can run here."""
    return [name for name, make in ENGINES.items() if make().available()]


def engine_for(name: str, fallback: str = "tesseract") -> Engine:
    """The engine of that name; the fallback, with a warning, where it isn't available; an error where that isn't either."""
    if name not in ENGINES:
        raise EngineNotAvailable(f"unknown engine: {name}")
    made = ENGINES[name]()
    if made.available():
        return made
    warnings.warn(f"engine {name} isn't available, {fallback} is taken", stacklevel=2)
    made = ENGINES[fallback]()
    if not made.available():
        raise EngineNotAvailable(f"neither {name} nor {fallback} is available")
    return made


def quad_words(detections: Iterable[tuple[list[tuple[float, float]], str, float]], least: float) -> list[Word]:
    """Words out of what engines for whole lines give: four corners, text, confidence from 0 to 1. Each detection is a line, numbered before
    those below the confidence leave."""
    out = []
    for i, (corners, text, share) in enumerate(detections):
        xs, ys = [p[0] for p in corners], [p[1] for p in corners]
        if text.strip() and share * 100 >= least:
            out.append(Word(text, int(min(xs)), int(min(ys)), int(max(xs) - min(xs)), int(max(ys) - min(ys)), share * 100, line_num=i))
    return out


def crops(image: np.ndarray, config: LayoutConfig) -> list[tuple[int, int, int, int, int]]:
    """``left, top, right, bottom, block offset`` of what an engine sees; the whole page if columns aren't looked for. None is empty."""
    h, w = image.shape[:2]
    if not config.detect_columns:
        return [(0, 0, w, h, 0)] if h and w else []
    top = images.header_cut(image)
    bottom = max(images.bottom_cut(image), top)
    body = images.column_ranges(image[top:bottom], config.max_columns) if bottom > top else []
    body = body if len(body) > 1 else [(0, w)]
    parts = [(0, 0, w, top, 0), *[(a, top, b, bottom, (i + 1) * BLOCK_OFFSET) for i, (a, b) in enumerate(body)], (0, bottom, w, h, (config.max_columns + 2) * BLOCK_OFFSET)]
    return [x for x in parts if x[2] > x[0] and x[3] > x[1]]


def page_words(engine: Engine, image: np.ndarray, ocr: OcrConfig, layout: LayoutConfig) -> list[Word]:
    """Words of a page, crop by crop, with the page's coordinates."""
    out = []
    for left, top, right, bottom, offset in crops(image, layout):
        for w in engine.recognize(image[top:bottom, left:right], ocr):
            out.append(replace(w, l=w.l + left, t=w.t + top, block_num=w.block_num + offset))
    return out


def words(pages: DataFrame, config: Config = Config(), make: Callable[[], Engine] | None = None) -> DataFrame:
    """``WORDS`` of pages as ``images.prepare`` gives them (grey values, width, height); pages without an image give none.

    ``make`` builds the engine in the task; by default it is the one that the settings name. ``stroke`` and ``is_italic`` are measured in
    the image; ``is_bold`` follows from the strokes of a block, see ``layout.bold_words``. A page is worked on at a time, and pages keep
    the partitioning they come in.
    """
    make = make or (lambda: engine_for(config.ocr.engine))
    columns = [x.split()[0] for x in WORDS.split(", ")]

    def rows(engine: Engine, page: tuple) -> Iterator[tuple]:
        image = np.frombuffer(page.image, np.uint8).reshape(page.height, page.width)
        for i, w in enumerate(page_words(engine, image, config.ocr, config.layout)):
            crop = image[max(0, w.t) : max(0, w.t + w.h), max(0, w.l) : max(0, w.l + w.w)]
            italic, stroke = images.style(crop) if config.ocr.detect_bold_italic else (False, 0.0)
            yield (page.doc_id, page.page_index, i, w.text, w.l, w.t, w.w, w.h, w.confidence, w.block_num, w.par_num, w.line_num, False, italic, stroke, page.width, page.height)

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        engine = None
        for frame in frames:
            for page in frame.itertuples():
                engine = engine or make()  # a task without pages needs none
                yield pd.DataFrame(list(rows(engine, page)), columns=columns)

    return pages.filter("image is not null").select("doc_id", "page_index", "image", "width", "height").mapInPandas(run, WORDS)
