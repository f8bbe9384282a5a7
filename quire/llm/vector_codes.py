"""Vector codes: product quantisation in whole numbers, with partial-distance search.

Components become integers, vectors are cut into parts, and each part position has a codebook. A round is one pass over the vectors: tasks
assign parts and give sums and counts of each entry, which Spark adds up to a few rows for each task and then for each entry. Nothing but the
codebooks is held by the driver, and nothing is sampled.

Partial-distance search: dimensions are taken in descending variance over the codebook; an entry leaves as soon as its distance so far is
strictly larger than the best complete distance, which is that of the entry that leads after the first quarter of the dimensions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import keep, releasing, small_batches

#: Distinct labels up to which their sums are broadcast; beyond, they are joined through a shuffle.
FEW_LABELS = 100_000
LARGEST = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Not null, and every component there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def integers(vectors: pa.Array, width: int, scale: int, bound: int) -> np.ndarray:
    """``floor(scale * x)`` of each component as [row, component]; what a shorter vector lacks is 0, and none is beyond ``bound``."""
    whole = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(whole * scale), -bound, bound).astype(np.int64)
    size = np.diff(np.asarray(vectors.offsets))
    if (size == width).all():
        return whole.reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < size[:, None]] = whole
    return out


def nearest_entry(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, ties to the lower index."""
    n, width = x.shape
    if not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-book.astype(np.float64).var(0), kind="stable")
    dense = order[: max(1, width // 4)]
    partial = np.zeros((n, len(book)), np.int64)
    for d in dense:
        partial += (x[:, d, None] - book[None, :, d]) ** 2
    best = ((x - book[partial.argmin(1)]) ** 2).sum(1)
    row, entry = np.nonzero(partial <= best[:, None])
    so_far = partial[row, entry]
    for d in order[len(dense) :]:
        so_far += (x[row, d] - book[entry, d]) ** 2
        alive = so_far <= best[row]
        row, entry, so_far = row[alive], entry[alive], so_far[alive]
    # whatever is left is complete; the entry of ``best`` always is, so each row has one
    begin = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(so_far, begin) if n else so_far
    first = np.flatnonzero(so_far == least[row])
    return entry[first[np.searchsorted(row[first], np.arange(n))]], least


class Codebooks:
    """Entries of each part position: ``books[part]`` is an array [entry, position within the part]."""

    def __init__(self, books: list[np.ndarray], scale: int, bound: int):
        self.books, self.scale, self.bound = books, scale, bound
        self.cuts = np.cumsum([0, *(b.shape[1] for b in books)])

    def read(self, vectors: pa.Array) -> np.ndarray:
        return integers(vectors, int(self.cuts[-1]), self.scale, self.bound)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes [row, part] and the squared distances, added up over the parts."""
        code, error = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x), np.int64)
        for p, book in enumerate(self.books):
            code[:, p], own = nearest_entry(x[:, self.cuts[p] : self.cuts[p + 1]], book)
            error += own
        return code, error

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each entry, the sum of the parts assigned to it [entry, component] and their number [entry, part]."""
        code, _ = self.assign(x)
        n = len(self.books[0])
        total, count = np.zeros((n, int(self.cuts[-1])), np.int64), np.zeros((n, len(self.books)), np.int64)
        for p in range(len(self.books)):
            count[:, p] = np.bincount(code[:, p], minlength=n)
            for d in range(self.cuts[p], self.cuts[p + 1]):
                total[:, d] = np.bincount(code[:, p], x[:, d].astype(np.float64), n).astype(np.int64)  # exact: below 2 ** 53 in a batch
        return total, count

    def moved(self, total: dict[tuple[int, int], int], count: dict[tuple[int, int], int]) -> Codebooks:
        """Each entry at the floor of its parts' mean, unused ones where they were."""
        books = [b.copy() for b in self.books]
        for p, book in enumerate(books):
            for e in range(len(book)):
                if n := count.get((e, p), 0):
                    book[e] = [total[e, d] // n for d in range(self.cuts[p], self.cuts[p + 1])]
        return Codebooks(books, self.scale, self.bound)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()


def _round(vectors: DataFrame, held: Codebooks) -> Codebooks:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count = 0
        for batch in batches:
            own = held.sums(held.read(batch.column(0)))
            total, count = total + own[0], count + own[1]
        if isinstance(total, int):
            return  # no rows
        rows = [np.concatenate([np.indices(a.shape).reshape(2, -1), a.reshape(1, -1)]) for a in (total, count)]
        e, at, value = np.concatenate(rows, 1)
        what = np.repeat(["sum", "count"], [total.size, count.size])
        yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(e), pa.array(at), pa.array(value)], ["what", "entry", "at", "value"])

    parts = vectors.mapInArrow(releasing(run), "what string, entry long, at long, value long")
    added = parts.groupBy("what", "entry", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # entries times (components + parts)
    by = lambda what: {(r["entry"], r["at"]): int(r["value"]) for r in added if r["what"] == what}
    return held.moved(by("sum"), by("count"))


def learn(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """Codebooks of all vectors of ``vectors`` that are ``finite``; None if there are none. They start at the smallest ids."""
    kept = vectors.filter(finite(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    width = kept.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return None
    width = -(-width // parts) * parts
    bound = min(1 << 27, int((LARGEST / max(1, width)) ** 0.5) // 2)  # squared distances fit 64 bits
    first = kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    start = integers(first, width, scale, bound)
    cut = width // parts
    held = Codebooks([start[:, p * cut : (p + 1) * cut] for p in range(parts)], scale, bound)
    for _ in range(rounds):
        held = _round(kept.select("v"), held)
    return held


def encode(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row whose vector is ``finite``.

    Null vectors, and those with a null or non-finite component, are left out; without any vector left there are no rows. Vectors shorter
    than the longest, and lengths that ``parts`` doesn't divide, count as filled up with zeros (so an empty vector is a zero). Components beyond
    2 ** 27 / ``scale`` count as that, so that distances fit 64 bits. Repeated rows each take part and each give a row; of equal smallest ids
    the smaller vectors start the codebooks, null ids last. Null labels are one label; a sum of errors beyond 64 bits is given as the
    largest such number. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries: 1 to 256, since an index is two hex digits")
    small_batches(vectors.sparkSession)
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    kept = vectors.filter(finite(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).alias("v"))
    kind = kept.schema["label"].dataType.simpleString()
    held = learn(vectors, id_col, vector_col, parts, entries, rounds, scale)
    if held is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = held.assign(held.read(batch.column(2)))
            digits = code.tobytes().hex()
            texts = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    coded = keep(kept.mapInArrow(releasing(run), f"vec_id long, label {kind}, code string, error long"), "codes")  # narrow rows
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    labels = keep(coded.groupBy(F.col("label").alias("its_label")).agg(total.alias("label_error")), "label-errors")
    few = labels.count() <= FEW_LABELS
    met = coded.join(F.broadcast(labels) if few else labels, F.col("label").eqNullSafe(F.col("its_label")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(held.sha256()).alias("codebooks_sha256"))
