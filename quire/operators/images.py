"""Page images in numpy, for ``mapInPandas``: grey values, thresholds, borders, margins, columns and bands.

Images are two-dimensional arrays of grey values, ink dark. Each kernel is a function of one image; ``prepare`` runs them over a table of pages.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quire.config import ImageConfig

log = logging.getLogger(__name__)

# Fixed values of the adaptive threshold.
ADAPTIVE_WINDOW, ADAPTIVE_MARGIN = 31, 15


def to_gray(image: np.ndarray) -> np.ndarray:
    """Blue, green, red to grey by the usual weights; grey stays."""
    return image if image.ndim == 2 else np.round(image[..., :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def _shrunk(image: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Means over ``size`` equal stretches of an axis, parts of pixels by their share."""
    n = image.shape[axis]
    total = np.cumsum(image, axis)
    total = np.concatenate([np.zeros_like(total.take([0], axis)), total], axis)
    at = np.linspace(0, n, size + 1)
    whole = np.minimum(at.astype(int), n - 1)
    share = (at - whole).reshape([-1 if a == axis else 1 for a in range(image.ndim)])
    return np.diff(total.take(whole, axis) + share * image.take(whole, axis), axis=axis) * (size / n)


def cap_dimension(image: np.ndarray, most: int) -> np.ndarray:
    """Shrunk by areas, in proportion, so that the longest side has ``most`` pixels at most."""
    longest = max(image.shape[:2])
    if longest <= most:
        return image
    h, w = (max(1, int(n * (most / longest))) for n in image.shape[:2])
    return np.clip(_shrunk(_shrunk(image.astype(float), h, 0), w, 1).round(), 0, 255).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """The grey value up to which pixels are ink: the largest variance between the two classes."""
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    weight, value = n.cumsum(), (n * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (value[-1] * weight / weight[-1] - value) ** 2 / (weight * (weight[-1] - weight))
    return int(np.nan_to_num(between, nan=0.0, posinf=0.0).argmax())


def ink(image: np.ndarray) -> np.ndarray:
    return image <= otsu(image)


def remove_black_borders(image: np.ndarray, most: float = 0.15, dark: int = 50) -> np.ndarray:
    """Dark outer rows and columns go, up to a share of each side."""

    def trimmed(means: np.ndarray) -> tuple[int, int]:
        limit = int(len(means) * most)
        a = next((i for i in range(limit) if means[i] >= dark), limit)
        b = next((i for i in range(limit) if means[-1 - i] >= dark), limit)
        return a, len(means) - b

    (t, b), (l, r) = trimmed(image.mean(1)), trimmed(image.mean(0))  # noqa: E741
    return image[t:b, l:r]


def crop_margins(image: np.ndarray, padding: float = 0.02) -> np.ndarray:
    """The box of the ink and some padding; a page without ink stays."""
    mask = ink(image)
    rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    if not len(rows) or mask.all():
        return image
    h, w = image.shape
    y, x = int(h * padding), int(w * padding)
    return image[max(0, rows[0] - y) : rows[-1] + 1 + y, max(0, columns[0] - x) : columns[-1] + 1 + x]


def blurred(image: np.ndarray, window: int) -> np.ndarray:
    """Gaussian means around each pixel, edges continued; the deviation follows from the window as is usual for it."""
    half = window // 2
    sigma = 0.3 * ((window - 1) * 0.5 - 1) + 0.8
    weights = np.exp(-((np.arange(window) - half) ** 2) / (2 * sigma**2))
    weights /= weights.sum()
    out = image.astype(np.float32)
    for axis in (0, 1):
        padded = np.pad(out, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = out.shape[axis]
        out = sum(np.float32(v) * padded.take(range(i, i + n), axis) for i, v in enumerate(weights))
    return out


def binarize(image: np.ndarray, method: str = "adaptive_gaussian", window: int = 25, k: float = 0.2, r: float = 128.0) -> np.ndarray:
    """0 where there is ink, else 255. "adaptive_gaussian": ink is darker than the mean around it, by a margin; "sauvola": a threshold for each
    pixel from mean and deviation around it."""
    if method == "adaptive_gaussian":
        return np.where(image > np.round(blurred(image, ADAPTIVE_WINDOW)) - ADAPTIVE_MARGIN, 255, 0).astype(np.uint8)
    if method == "none":
        return image
    if method == "otsu":
        return np.where(ink(image), 0, 255).astype(np.uint8)
    if method != "sauvola":
        raise ValueError(f"unknown method: {method}")
    half = window // 2
    padded = np.pad(image.astype(float), half, mode="reflect") if min(image.shape) > half else np.pad(image.astype(float), half, mode="edge")

    def box(x: np.ndarray) -> np.ndarray:
        s = np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        n = 2 * half + 1
        return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / n**2

    mean = box(padded)
    deviation = np.sqrt(np.maximum(box(padded**2) - mean**2, 0))
    return np.where(image > mean * (1 + k * (deviation / r - 1)), 255, 0).astype(np.uint8)


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """Turned counterclockwise on a larger white canvas, cubic between pixels; hardly any angle changes nothing."""
    if abs(degrees) < 0.05:
        return image
    h, w = image.shape
    cos, sin = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    size = int(h * abs(cos) + w * abs(sin)), int(h * abs(sin) + w * abs(cos))
    y, x = (np.arange(n, dtype=np.float32) - n / 2 for n in size)
    at_x, at_y = cos * x[None] - sin * y[:, None] + w / 2, sin * x[None] + cos * y[:, None] + h / 2
    left, top = np.floor(at_x).astype(int), np.floor(at_y).astype(int)

    def weight(d: np.ndarray) -> np.ndarray:
        d = np.abs(d)
        return np.where(d <= 1, (1.25 * d - 2.25) * d * d + 1, np.where(d < 2, ((-0.75 * d + 3.75) * d - 6) * d + 3, 0))

    padded = np.pad(image, 3, constant_values=255).astype(np.float32)
    out = np.zeros(size, np.float32)
    for i in range(-1, 3):
        rows = np.clip(top + i + 3, 0, h + 5)
        for j in range(-1, 3):
            out += weight(at_y - top - i) * weight(at_x - left - j) * padded[rows, np.clip(left + j + 3, 0, w + 5)]
    return np.clip(out.round(), 0, 255).astype(np.uint8)


def skew(image: np.ndarray) -> float:
    """Degrees by which the smallest rectangle around the ink is turned, -45 to 45; 0 with hardly any ink."""
    mask = ink(image)
    if mask.sum() < 50 or mask.all():
        return 0.0
    ys = np.flatnonzero(mask.any(1))
    first, last = mask[ys].argmax(1), mask.shape[1] - 1 - mask[ys, ::-1].argmax(1)
    points = sorted({*zip(first.tolist(), ys.tolist(), strict=True), *zip(last.tolist(), ys.tolist(), strict=True)})

    def half(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
        kept: list[tuple[int, int]] = []
        for p in points:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) <= (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]):
                kept.pop()
            kept.append(p)
        return kept[:-1]

    hull = np.array(half(points) + half(points[::-1]), float)
    if len(hull) < 3:
        return 0.0
    edge = np.roll(hull, -1, 0) - hull
    angle = (np.arctan2(edge[:, 1], edge[:, 0]) + np.pi / 4) % (np.pi / 2) - np.pi / 4
    along = np.cos(angle)[:, None] * hull[:, 0] + np.sin(angle)[:, None] * hull[:, 1]
    across = np.cos(angle)[:, None] * hull[:, 1] - np.sin(angle)[:, None] * hull[:, 0]
    return float(np.degrees(angle[(np.ptp(along, 1) * np.ptp(across, 1)).argmin()]))


def deskew(image: np.ndarray, most: float = 15.0) -> np.ndarray:
    """Turned so that the ink's rectangle stands straight; beyond ``most`` degrees it stays."""
    angle = skew(image)
    return image if abs(angle) > most else rotate(image, angle)


def enhance_contrast(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Histograms equalised tile by tile with a clip limit, and mixed between the middles of the tiles."""
    h, w = image.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(image, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > tiles else "edge")
    area = th * tw
    limit = max(1, int(clip * area / 256))
    parts = padded.reshape(tiles, th, tiles, tw).swapaxes(1, 2).reshape(tiles * tiles, area)
    tables = np.empty((tiles * tiles, 256), np.float32)
    for i, part in enumerate(parts):
        n = np.bincount(part, minlength=256)
        over = int(np.maximum(n - limit, 0).sum())
        n = np.minimum(n, limit) + over // 256
        if rest := over % 256:  # what is left goes to evenly spaced values
            n[: rest * max(256 // rest, 1) : max(256 // rest, 1)] += 1
        tables[i] = np.clip(np.round(n.cumsum() * (255 / area)), 0, 255)

    def mix(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(n) / size - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), (at - low).astype(np.float32)

    (y0, y1, fy), (x0, x1, fx) = mix(h, th), mix(w, tw)
    value = lambda y, x: tables[y[:, None] * tiles + x[None], image]
    upper = value(y0, x0) * (1 - fx) + value(y0, x1) * fx
    lower = value(y1, x0) * (1 - fx) + value(y1, x1) * fx
    return np.round(upper * (1 - fy[:, None]) + lower * fy[:, None]).astype(np.uint8)


def denoise(image: np.ndarray, strength: float = 6, patch: int = 7, search: int = 21) -> np.ndarray:
    """Means over pixels around, weighted by how alike their patches are. Slow: a pass over the page for each of the places searched."""
    far, near = search // 2, patch // 2
    h, w = image.shape
    wide = np.pad(image.astype(np.float32), far + near, mode="symmetric")
    own = wide[far : far + h + 2 * near, far : far + w + 2 * near]
    total, weights = np.zeros((h, w), np.float32), np.zeros((h, w), np.float32)
    for dy in range(search):
        for dx in range(search):
            other = wide[dy : dy + h + 2 * near, dx : dx + w + 2 * near]
            s = np.pad(((own - other) ** 2).astype(np.float64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
            alike = np.exp(-((s[patch:, patch:] - s[:-patch, patch:] - s[patch:, :-patch] + s[:-patch, :-patch]) / patch**2) / strength**2).astype(np.float32)
            total += alike * other[near : near + h, near : near + w]
            weights += alike
    return np.round(total / weights).astype(np.uint8)


# Distances to the next and the diagonal pixel; of letters, the least area, height as a share of the word's, and number; the
# slant in degrees from which a word is italic.
NEXT, DIAGONAL = 0.955, 1.3693
LEAST_AREA, LEAST_HEIGHT, LEAST_LETTERS, SLANT = 15, 0.35, 3, -7.5


def stroke_width(crop: np.ndarray) -> float:
    """Twice the mean distance of ink to what is no ink, in pixels; 0 with hardly any ink, or nothing else."""
    mask = ink(crop) if crop.size else np.zeros((0, 0), bool)
    if mask.sum() < 8 or mask.all():
        return 0.0
    far = np.where(mask, np.inf, 0.0)
    while True:
        p = np.pad(far, 1, constant_values=np.inf)
        sides = np.minimum(np.minimum(p[:-2, 1:-1], p[2:, 1:-1]), np.minimum(p[1:-1, :-2], p[1:-1, 2:])) + NEXT
        corners = np.minimum(np.minimum(p[:-2, :-2], p[:-2, 2:]), np.minimum(p[2:, :-2], p[2:, 2:])) + DIAGONAL
        closer = np.minimum(far, np.minimum(sides, corners))
        if (closer == far).all():
            return float(far[mask].mean() * 2)
        far = closer


def letters(mask: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each connected part, corners counted as touching: runs of rows, united where they meet."""
    spans = [(y, a, b) for y, row in enumerate(mask) for a, b in runs(row)]
    parent = list(range(len(spans)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    above: list[int] = []
    row: list[int] = []
    for i, (y, a, b) in enumerate(spans):
        if row and spans[row[-1]][0] != y:
            above, row = (row if spans[row[-1]][0] == y - 1 else []), []
        for j in above:
            if spans[j][1] <= b and a <= spans[j][2]:
                parent[root(j)] = root(i)
        row.append(i)
    parts: dict[int, list[tuple[int, int, int]]] = {}
    for i, span in enumerate(spans):
        parts.setdefault(root(i), []).append(span)
    return [(np.concatenate([np.full(b - a, y) for y, a, b in p]), np.concatenate([np.arange(a, b) for _, a, b in p])) for p in parts.values()]


def slants(mask: np.ndarray) -> list[float]:
    """Degrees by which each letter leans, out of its second moments; small parts are left out."""
    out = []
    for y, x in letters(mask):
        if len(y) >= LEAST_AREA and np.ptp(y) + 1 >= len(mask) * LEAST_HEIGHT:
            tall, lean = ((y - y.mean()) ** 2).sum(), ((y - y.mean()) * (x - x.mean())).sum()
            if tall > 1e-3:
                out.append(float(np.degrees(np.arctan(lean / tall))))
    return out


def style(crop: np.ndarray) -> tuple[bool, float]:
    """Whether a word is italic, and the width of its strokes."""
    if not crop.size:
        return False, 0.0
    found = slants(ink(crop))
    return len(found) >= LEAST_LETTERS and float(np.median(found)) <= SLANT, stroke_width(crop)


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def column_ranges(image: np.ndarray, most: int = 4, gap: float = 0.02, least: float = 0.08, rows: float = 0.001) -> list[tuple[int, int]]:
    """Columns along x out of the ink of the whole page; the whole width if there are none or too many."""
    mask = ink(image)
    h, w = mask.shape
    found: list[tuple[int, int]] = []
    for a, b in runs(mask.sum(0) >= max(1, int(h * rows))):
        if found and a - found[-1][1] < max(1, int(w * gap)):
            found[-1] = (found[-1][0], b)
        else:
            found.append((a, b))
    found = [x for x in found if x[1] - x[0] >= max(1, int(w * least))]
    return found if 0 < len(found) <= most else [(0, w)]


# Fixed thresholds: ink that a blank row may have, as a share of the width; the least gap and the least significant one, as shares of the
# height; a significant gap as a multiple of the smallest between lines.
SPECKS, LEAST_GAP, LEAST_BAND, BAND = 0.001, 0.003, 0.025, 2.5


def _gaps(image: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows with hardly any ink, long enough to be no noise."""
    h, w = image.shape
    if not h:
        return []
    blank = ink(image).sum(1) <= max(1, int(w * SPECKS))
    return [(a, b) for a, b in runs(blank) if b - a >= max(1, int(h * LEAST_GAP))]


def significant_gap(image: np.ndarray) -> float:
    """Blank rows that part bands: as many times the smallest gap between lines, or that share of the page, whichever is more."""
    h = image.shape[0]
    inner = [b - a for a, b in _gaps(image) if a > 0 and b < h]
    return max(BAND * min(inner, default=0), LEAST_BAND * h)


def header_cut(image: np.ndarray, zone: float = 0.12) -> int:
    """The middle of the first significant gap near the top; 0 without one."""
    least = significant_gap(image)
    return next(((a + b) // 2 for a, b in _gaps(image[: int(image.shape[0] * zone)]) if a > 0 and b - a >= least), 0)


def bottom_cut(image: np.ndarray, zone: float = 0.35) -> int:
    """The middle of the first significant gap near the bottom; the height without one."""
    h, least = image.shape[0], significant_gap(image)
    top = int(h * (1 - zone))
    return next((top + (a + b) // 2 for a, b in _gaps(image[top:]) if b - a >= least), h)


def prepared(image: np.ndarray, config: ImageConfig) -> np.ndarray:
    """The steps in their fixed order; a step that fails leaves the image as it is, and a line in the log."""
    image = cap_dimension(to_gray(image), config.max_dimension_px)
    steps = [deskew] * config.deskew + [denoise] * config.denoise + [enhance_contrast] * config.enhance_contrast + [remove_black_borders] * config.remove_borders
    steps += [crop_margins] * config.crop_margins + [lambda x: binarize(x, config.binarization)]
    for step in steps if config.enabled else []:
        try:
            image = step(image)
        except (ValueError, IndexError):
            log.warning("step %s failed, the image stays as it is", getattr(step, "__name__", step), exc_info=True)
    return image


def prepare(pages: DataFrame, config: ImageConfig = ImageConfig()) -> DataFrame:
    """``doc_id, page_index, image, width, height, columns, header_cut, bottom_cut`` of pages with blue-green-red images."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p in frame.itertuples():
                image = prepared(np.frombuffer(p.image, np.uint8).reshape(p.height, p.width, -1), config)
                rows.append((p.doc_id, p.page_index, image.tobytes(), image.shape[1], image.shape[0], [{"l": a, "r": b} for a, b in column_ranges(image)], header_cut(image), bottom_cut(image)))
            yield pd.DataFrame(rows, columns=["doc_id", "page_index", "image", "width", "height", "columns", "header_cut", "bottom_cut"])

    return pages.filter("image is not null").mapInPandas(run, "doc_id string, page_index int, image binary, width int, height int, columns array<struct<l: int, r: int>>, header_cut int, bottom_cut int")
