"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

n-grams of one to three characters are hashed into ``DIMENSIONS`` columns. Weights are learned by follow-the-regularised-leader
(per-coordinate rates, elastic net: L1 makes them sparse, L2 small); a temperature, fitted on examples kept apart, calibrates the
probabilities. Document frequencies are counted over all documents that may be learned from; the weights are fitted on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import id_text, releasing, slices, small_batches
from quire.llm.labelled import held_out, sample

#: Rows of the labelled sample at most.
SAMPLE = 4_000
DIMENSIONS, LONGEST = 1 << 14, 3
#: Follow-the-regularised-leader: rate, its smoothing, L1, L2, passes.
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.05, 0.05, 3
#: What a document gets that has no letter.
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
#: Documents whose counts stand in memory at once.
TOGETHER = 128


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each ended by 0, with white space and digits each as one character; and the text of each."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("\0".join([*low, ""]).encode("utf-32-le"), "<u4").astype(np.uint64)
    small = np.arange(256, dtype=np.uint64)
    small[[9, 10, 11, 12, 13, 160]] = 32
    small[48:58] = 48
    code = np.where(code < 256, small[np.minimum(code, 255).astype(np.int64)], code)
    return code, np.repeat(np.arange(len(texts)), [len(t) + 1 for t in low])


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse n-gram counts: text, column, count, by text and column; no gram reaches into the next text."""
    code, doc = _codes(texts)
    rows, columns, values = [], [], []
    k = np.uint64(0x9E3779B97F4A7C15)
    keys = []
    gram = np.zeros(len(code), np.uint64)
    for n in range(1, LONGEST + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        gram = (gram[:m] + code[n - 1 :] + np.uint64(n)) * k
        keys.append(((gram ^ (gram >> np.uint64(29))) * k >> np.uint64(64 - 14)).astype(np.int64))
    edges = np.searchsorted(doc, np.arange(0, len(texts) + TOGETHER, TOGETHER))
    for g in range(len(edges) - 1):
        a, b = edges[g], edges[g + 1]
        base = g * TOGETHER
        own = []
        for n, x in enumerate(keys):  # n characters after the first
            first, last = doc[a : min(b, len(x))], doc[a + n : min(b, len(x)) + n]
            own.append(((first - base) * DIMENSIONS + x[a:b])[first == last])
        own = np.concatenate(own)
        c = np.bincount(own)
        there = np.flatnonzero(c)
        rows.append(there // DIMENSIONS + base)
        columns.append(there % DIMENSIONS)
        values.append(c[there])
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(values)


def tf_idf(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of unit length, worked out for some texts at a time."""
    if len(texts) > TOGETHER:
        made = [tf_idf(texts[a : a + TOGETHER], idf) for a in range(0, len(texts), TOGETHER)]
        return np.concatenate([m[0] + a for m, a in zip(made, range(0, len(texts), TOGETHER), strict=True)]), np.concatenate([m[1] for m in made]), np.concatenate([m[2] for m in made])
    row, column, count = counts(texts)
    x = (1 + np.log(count)) * idf[column]
    norm = np.sqrt(np.bincount(row, x * x, len(texts)))
    return row.astype(np.int32), column.astype(np.int32), (x / np.maximum(norm, 1e-12)[row]).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        row, column, x = tf_idf(texts, self.idf)
        return np.stack([np.bincount(row, x * self.weights[column, j], len(texts)) for j in range(len(self.languages))], 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability of each text; ``UNDETERMINED`` and 0 without letters or learned languages."""
        real = [i for i, t in enumerate(texts) if t is not None and self.languages and _LETTER.search(t)]
        names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if real:
            p = softmax(self.logits([texts[i] for i in real]) / self.temperature)
            best = p.argmax(1)
            score[real] = p[np.arange(len(real)), best]
            for i, j in zip(real, best.tolist(), strict=True):
                names[i] = self.languages[j]
        return names, score


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], languages: list[str], idf: np.ndarray) -> Model:
    """FTRL-proximal over the examples in the given order; every fifth is kept for the temperature."""
    names = sorted(set(languages))
    if not names:
        return Model([], idf, np.zeros((DIMENSIONS, 0)), 1.0)
    y = np.searchsorted(names, languages)
    row, column, x = tf_idf(texts, idf)
    edge = np.searchsorted(row, np.arange(len(texts) + 1))
    fit = [i for i in range(len(texts)) if i % 5 or len(texts) < 10]
    z, n = np.zeros((DIMENSIONS, len(names))), np.zeros((DIMENSIONS, len(names)))

    def solved(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    for _ in range(EPOCHS):
        for i in fit:
            c, v = column[edge[i] : edge[i + 1]], x[edge[i] : edge[i + 1], None]
            zc, nc = z[c], n[c]
            w = solved(zc, nc)
            p = softmax((v * w).sum(0)[None])[0]
            p[y[i]] -= 1
            g = v * p
            n[c] = nc + g * g
            z[c] = zc + g - (np.sqrt(nc + g * g) - np.sqrt(nc)) / ALPHA * w
    model = Model(names, idf, solved(z, n), 1.0)
    kept = [i for i in range(len(texts)) if i % 5 == 0]
    if len(kept) >= 10:
        logit, want = model.logits([texts[i] for i in kept]), y[kept]

        def loss(t: float) -> float:
            return float(-np.log(softmax(logit / t)[np.arange(len(kept)), want] + 1e-12).mean())

        model.temperature = min(np.geomspace(0.02, 5, 120), key=loss)
    return model


def fit(docs: DataFrame, label_col: str = "lang", bound: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from the rows of ``docs`` that have a label and aren't held out."""
    small_batches(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for part in slices(batch, chars=1_000_000):
                df += np.bincount(counts(part.column(0).to_pylist())[1], minlength=DIMENSIONS)
                rows += part.num_rows
        there = np.append(np.flatnonzero(df), -1)  # -1: the number of documents
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(np.append(df[there[:-1]], rows))], ["column", "n"])

    seen = known.select("text").mapInArrow(releasing(run), "column long, n long").groupBy("column").agg(F.sum("n").alias("n")).collect()  # DIMENSIONS rows at most
    total, df = 0, np.zeros(DIMENSIONS)
    for column, n in seen:
        if column < 0:
            total = n
        else:
            df[column] = n
    idf = np.log((1 + total) / (1 + df)) + 1
    learned = sample(known.select("doc_id", "text"), known.select("doc_id", "lang"), "lang", bound)
    return train(learned["text"].to_pylist(), learned["label"].to_pylist(), idf)


def identify(docs: DataFrame, label_col: str = "lang", bound: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    ``score`` is the calibrated probability. A text that is null or has no letter gets ``und`` and 0, as does every text if no row has a label.
    Repeated rows each give a row. Only the text decides a prediction.
    """
    model = model or fit(docs, label_col, bound, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, chars=1_000_000):
                names, score = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = id_text(docs, id_col, text_col)
    rows = rows.select("doc_id", "text", held_out(rows["doc_id"]).alias("held_out"))
    return rows.mapInArrow(releasing(run), "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = 0.3, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is told with a probability of ``least`` or more. Only texts go through Python.

    A text that is null or has no letter goes. If no row has a label there is no model to reject by, so all texts with a letter stay. Repeated
    rows are told alike. An empty table gives no rows.
    """
    model = fit(docs, label_col, SAMPLE, id_col, text_col)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            told = []
            for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), chars=1_000_000):
                own = part.column(0).to_pylist()
                if model.languages:
                    names, score = model.predict(own)
                    told += [n != UNDETERMINED and s >= least for n, s in zip(names, score.tolist(), strict=True)]
                else:
                    told += [t is not None and bool(_LETTER.search(t)) for t in own]
            yield pa.array(told, pa.bool_())

    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from releasing(run)(batches)

    return docs.filter(F.arrow_udf(told, "boolean")(F.col(text_col)))
