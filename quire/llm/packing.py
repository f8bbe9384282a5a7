"""Sequence packing by length patterns: non-negative least squares on the histogram, then best fit for what is left.

The histogram of piece lengths has at most ``capacity`` entries, whatever the input's size. On the driver, patterns of one to three
lengths that fill a sequence are enumerated (those of three by their price, a column generation), their repeat counts are fitted to the histogram by non-negative
least squares, rounded down to what is there, and the rest is packed best fit, longest first, count by count. The result is a plan: a
list of patterns with repeats. Every piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import id_text, keep, releasing, slices
from quire.llm.token_cache import LIMIT, TEXTS, library_encoder

#: Pieces that one window over (chunk, length) may hold, about.
CHUNK = 1 << 16
#: Patterns of three that one pricing adds at most, pricings, and steps of a fit.
PATTERNS, PRICINGS = 120_000, 3
#: Sequences beyond the least number, as a share, with which a plan is good enough.
NEAR = 0.001
ROUNDS = 400


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of one or two lengths (0: none) that add up to the capacity, all of them present in ``lengths``."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    two = [(a, capacity - a, 0) for a in range(1, capacity // 2 + 1) if there[a] and there[capacity - a]]
    one = [(capacity, 0, 0)] if there[capacity] else []
    return np.array(one + two, np.int64).reshape(-1, 3)


def priced(lengths: np.ndarray, capacity: int, price: np.ndarray, most: int = PATTERNS) -> np.ndarray:
    """Of all patterns of three lengths that add up to the capacity, those with a negative price (a sum over their lengths), the ``most`` cheapest of them."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    rows, prices = np.zeros((0, 3), np.int64), np.zeros(0)
    for a in np.flatnonzero(there[: capacity // 3 + 1]).tolist():
        b = np.arange(max(a, 1), (capacity - a) // 2 + 1)
        own = price[a] + price[b] + price[capacity - a - b]
        b, own = (v[there[b] & there[capacity - a - b] & (own < 0)] for v in (b, own))
        rows, prices = np.concatenate([rows, np.stack([np.full(len(b), a), b, capacity - a - b], 1)]), np.append(prices, own)
        if len(rows) > 2 * most:
            best = np.argpartition(prices, most)[:most]
            rows, prices = rows[best], prices[best]
    best = np.argsort(prices, kind="stable")[:most]
    return rows[best]


def fit(histogram: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeat counts >= 0 of the patterns whose sum of squared differences to the histogram is least (accelerated projected gradient), and what a piece of each
    length more would change: the price by which further patterns are chosen."""
    n = len(histogram)
    used = (rows > 0).astype(float)
    weight = np.sqrt(np.arange(n) / n)  # short pieces find a place anyway
    weight[0] = 0

    def made(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows.ravel(), (x[:, None] * used).ravel(), n) * weight

    want, scale = histogram * weight, 0.0
    v = np.ones(len(rows))
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = ((made(v) * weight)[rows] * used).sum(1)
        scale = np.linalg.norm(v)
        v /= max(scale, 1e-12)
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(ROUNDS):
        new = np.maximum(0, y - (((made(y) - want) * weight)[rows] * used).sum(1) / max(1.05 * scale, 1e-12))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x, (made(x) - want) * weight


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs ``left[length]`` pieces of each length, longest first, each into the fullest sequence with room; equal steps together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            room = next((r for r in range(length, capacity) if open_.get(r)), capacity)
            if room == capacity:
                # a new sequence takes one piece now and others of this length in the next rounds, as best fit would
                fill = max(1, capacity // length)
                whole = n // fill
                if whole:
                    open_[capacity - fill * length].append(((length,) * fill, whole))
                if n - whole * fill:
                    open_[capacity - (n - whole * fill) * length].append(((length,) * (n - whole * fill), 1))
                break
            pattern, count = open_[room].pop()
            take = min(n, count)
            if count > take:
                open_[room].append((pattern, count - take))
            open_[room - length].append(((*pattern, length), take))
            n -= take
    return [x for own in open_.values() for x in own]


def rounded(histogram: np.ndarray, rows: np.ndarray, x: np.ndarray, capacity: int, strength: float) -> list[tuple[tuple[int, ...], int]]:
    """A plan out of fitted counts times ``strength``: rounded, no more than there is, most frequent patterns first; the rest best fit."""
    left, made = histogram.copy(), []
    whole = np.floor(x * strength + 0.5).astype(np.int64)
    for i in np.argsort(-whole, kind="stable").tolist():
        if whole[i] == 0:
            break
        own = tuple(int(v) for v in rows[i] if v)
        n = min(int(whole[i]), *(int(left[v]) // own.count(v) for v in own))
        if n > 0:
            for v in own:
                left[v] -= n
            made.append((own, n))
    return made + best_fit(left, capacity)


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and repeats that hold every piece of the histogram (``histogram[length]``, index 0 unused).

    Patterns of three come in by their price against what the fit so far leaves, so that each of them is considered whatever the capacity: ``PRICINGS`` times, or until a
    plan has no more than ``NEAR`` sequences beyond the least number that the ids allow. Fitted counts are tried at a few strengths; the plan with the
    fewest sequences is kept.
    """
    histogram = histogram.astype(np.int64)
    lengths = np.flatnonzero(histogram)
    rows = patterns(lengths, capacity)
    size = lambda made: sum(n for _, n in made)
    least = -(-int((histogram * np.arange(len(histogram))).sum()) // capacity)
    best: list[tuple[tuple[int, ...], int]] = []
    _, price = fit(histogram, rows)
    for _ in range(PRICINGS):
        known = len(rows)
        rows = np.unique(np.concatenate([rows, priced(lengths, capacity, price)]), axis=0)
        if len(rows) == known and best:
            break
        x, price = fit(histogram, rows)
        best = min([*([best] if best else []), *(rounded(histogram, rows, x, capacity, strength) for strength in (1.0, 0.97, 0.9, 0.75, 0.5))], key=size)
        if size(best) <= least * (1 + NEAR) + 1:
            break
    return best


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", cache: int = LIMIT) -> DataFrame:
    """``uid, doc_id, piece, start, length, ids_crc32`` of every piece; the first piece of a cut document takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, end = library_encoder(tokenizer, limit=cache), np.array([end_id], "<u4").tobytes()
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, chars=TEXTS):
                out = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    start, k = 0, 0
                    while start < n:
                        length = min(capacity, n - start) if start or n <= capacity else n % capacity or capacity
                        out.append((uid, doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                        start, k, uid = start + length, k + 1, uid + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _KINDS, strict=True)], _NAMES)
        encode.clear()

    return id_text(docs, id_col, text_col).mapInArrow(releasing(run), "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")


_NAMES = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", cache: int = LIMIT) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: every piece's place in sequences of ``capacity`` ids.

    Only narrow rows are shuffled. A piece's rank among those of its length is its rank in its chunk (a bounded window) plus the counts
    of the chunks before it, so no length, however frequent, gathers in one task.

    ``cache``: encoded parts that a task holds before it clears them; results don't depend on it. A null text is an empty one: its end id alone. Repeated rows, or rows with equal or null ids, are packed each for itself. An empty
    table gives no rows. Other columns are not read.
    """
    cut = keep(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, cache), "packing-pieces")
    counts = cut.groupBy("length").count().collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts:
        histogram[row[0]] = row[1]
    chunks = max(1, -(-int(histogram.sum()) // CHUNK))
    keys, base, sequence, offset = places(plan(histogram, capacity))

    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(chunks)))
    sizes = cut.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = sizes.select("length", "chunk", (F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "chunk").orderBy("uid")) - 1).join(before, ["length", "chunk"])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rank = (f["rank"] + f["before"]).to_numpy()
            i = np.searchsorted(keys, (f["length"].to_numpy() << 44) + rank, side="right") - 1
            f["sequence_id"], f["offset"] = sequence[i] + rank - base[i], offset[i]
            yield f[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def places(planned: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For runs of ranks of a length, in order of (length, rank): key, first rank, first sequence, offset within the sequence."""
    given: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, n in planned:
        at = 0
        for length in pattern:
            rows.append(((length << 44) + given[length], given[length], sequence, at))
            given[length] += n
            at += length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), table[:, 3].copy()
