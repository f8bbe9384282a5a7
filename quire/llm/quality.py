"""Quality by attention-based multiple-instance learning: a document is a bag of passages, and only documents have labels.

Every passage of ``WORDS`` words, over the whole text, is encoded from what can be counted in it (kinds of characters, lengths and shapes of
words, repetition, a sketch of its words). Gated attention weighs the passages; the weighted sum of their codes is the document's, and
gives its score. Encoder, attention and classifier are learned together from the labels of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import id_text, releasing, slices
from quire.llm.labelled import held_out, sample
from quire.llm.text_hash import LOWER, flat, run_hashes, runs

#: Rows of the labelled sample at most; words of a passage; buckets of the sketch of a passage's words.
SAMPLE, WORDS, BUCKETS = 6_000, 48, 64
#: Sizes of a passage's code and of the attention's hidden layer; steps of training, documents of a step, and the rate.
CODE, HIDDEN, STEPS, BATCH, RATE, DECAY = 16, 8, 500, 128, 0.01, 1e-2
#: Bytes of texts whose features are worked out at once, about.
CHARS = 500_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Kinds of bytes: 0 small letters, 1 capitals, 2 digits, 3 white space, 4 ends of sentences, 5 other stops, 6 quotes and brackets, 7 other signs, 8 line ends, 9 beyond ASCII, 10 controls.
_KIND = np.full(256, 10, np.uint8)
for _kind, _bytes in enumerate(
    (range(97, 123), range(65, 91), range(48, 58), (9, 11, 12, 32), b".!?", b",;:-", b"\"'()[]", b"#$%&*+/<=>@\\^_`{|}~", (10, 13), range(128, 256))
):
    _KIND[list(_bytes)] = _kind
KINDS = 11
FEATURES = KINDS + 12 + BUCKETS


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features [passage, feature] of the passages of all texts in order, and where each text's begin (one more: the end). A text without words
    is one empty passage."""
    n = len(texts)
    data, at = flat(texts)
    begin, end, doc = runs(~_SPACE[data], at)
    count = np.bincount(doc, minlength=n)
    own = np.maximum(1, -(-count // WORDS))
    bag = np.concatenate([[0], np.cumsum(own)])
    word = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    passage, total = bag[doc] + word // WORDS, int(bag[-1])
    # a passage reaches from its first word, or its text's begin, to the next one
    opens = np.zeros(total + 1, np.int64)
    opens[bag[:-1]], opens[total] = at[:-1], len(data)
    later = (word % WORDS == 0) & (word > 0)
    opens[passage[later]] = begin[later]
    place = np.repeat(np.arange(total), np.diff(opens))
    kinds = np.bincount(place * KINDS + _KIND[data], minlength=total * KINDS).reshape(total, KINDS).astype(np.float64)
    size = np.maximum(1, kinds.sum(1))[:, None]

    words = np.bincount(passage, minlength=total).astype(np.float64)
    many = np.maximum(1, words)
    length = (end - begin).astype(np.float64)
    mean = np.bincount(passage, length, total) / many
    spread = np.sqrt(np.maximum(0, np.bincount(passage, length**2, total) / many - mean**2))
    first, last = (_KIND[data[x]] for x in (begin, end - 1)) if len(begin) else (np.zeros(0, np.uint8),) * 2
    hashed = run_hashes(LOWER[data], begin, end)
    pairs = np.sort(passage.astype(np.uint64) << np.uint64(40) | hashed >> np.uint64(24))
    new = np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]
    distinct = np.bincount((pairs[new] >> np.uint64(40)).astype(np.int64), minlength=total)
    again = np.zeros(len(hashed), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (passage[1:] == passage[:-1])
    share = lambda mask: np.bincount(passage[mask], minlength=total) / many
    shapes = [
        words / WORDS, mean / 10, spread / 10, share(length <= 3), share(length > 15), distinct / many, share(again), share(first == 1), share(last == 4), share(last == 7),
        share(length == 1), share((last != 0) & (last != 9) & (last != 4) & (last != 5)),
    ]
    bucket = (hashed >> np.uint64(58)).astype(np.int64)
    sketch = np.bincount(passage * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, BUCKETS) / many[:, None]
    return np.concatenate([kinds / size, np.stack(shapes, 1), np.sqrt(sketch)], 1), bag


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Network:
    """``w, b`` encode a passage, ``v, u, a`` weigh it, ``beta, c`` score a document; ``mean, scale`` standardise features."""

    params: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def weights(self, x: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, ...]:
        """Codes, both gates, and the attention of each passage, which adds up to one in a document."""
        p = self.params
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * s) @ p["a"]
        size = np.diff(bag)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, bag[:-1]), size))
        return h, t, s, e / np.repeat(np.add.reduceat(e, bag[:-1]), size)

    def forward(self, x: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, ...]:
        h, t, s, a = self.weights(x, bag)
        z = np.add.reduceat(a[:, None] * h, bag[:-1], axis=0)
        return h, t, s, a, z, z @ self.params["beta"] + self.params["c"][0]

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean logistic loss, and its derivatives."""
        p = self.params
        h, t, s, a, z, margin = self.forward(x, bag)
        loss = float(np.mean(np.logaddexp(0, margin) - y * margin))
        dm = (_sigmoid(margin) - y) / len(y)
        size = np.diff(bag)
        dz = np.repeat(dm, size)[:, None] * p["beta"]
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, bag[:-1]), size))
        gate = de[:, None] * p["a"]
        dt, ds = gate * s * (1 - t**2), gate * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (1 - h**2)
        return loss, {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de, "beta": z.T @ dm, "c": np.array([dm.sum()])}


@dataclass
class Model:
    network: Network | None
    rest: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """Of each text, worked out for about ``CHARS`` bytes at a time."""
        out = [np.zeros(0)]
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), chars=CHARS):
            if self.network is None:
                out.append(np.full(part.num_rows, self.rest))
            elif part.num_rows:
                x, bag = passages(part.column(0))
                out.append(_sigmoid(self.network.forward((x - self.network.mean) / self.network.scale, bag)[-1]))
        return np.concatenate(out)


def train(texts: pa.Array, good: np.ndarray, steps: int = STEPS) -> Model:
    """From labelled texts; with too few of them, or of one class, the model gives their mean (0 without any)."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if len(good) < 30 or good.min() == good.max():
        return Model(None, float(good.mean()) if len(good) else 0.0)
    made = [passages(part.column(0)) for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), chars=CHARS)]
    x, size = np.concatenate([m[0] for m in made]).astype(np.float32), np.concatenate([np.diff(m[1]) for m in made])
    bag = np.concatenate([[0], np.cumsum(size)])
    mean, scale = x.mean(0, dtype=np.float64), np.maximum(x.std(0, dtype=np.float64), 1e-3)
    rng = np.random.Generator(np.random.PCG64(12))
    shape = {"w": (x.shape[1], CODE), "b": (CODE,), "v": (CODE, HIDDEN), "u": (CODE, HIDDEN), "a": (HIDDEN,), "beta": (CODE,), "c": (1,)}
    params = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in ("b", "c") else np.zeros(s) for k, s in shape.items()}
    net = Network(params, mean, scale)
    first, second = ({k: np.zeros(s) for k, s in shape.items()} for _ in range(2))
    order, at = rng.permutation(len(good)), 0
    for step in range(1, steps + 1):
        if at + BATCH > len(order):
            order, at = rng.permutation(len(good)), 0
        chosen = order[at : at + BATCH]
        at += BATCH
        own = np.concatenate([np.arange(bag[i], bag[i + 1]) for i in chosen])
        _, grad = net.gradients((x[own] - mean) / scale, np.concatenate([[0], np.cumsum(size[chosen])]), good[chosen])
        rate = RATE * (1 - step / (steps + 1))
        for k, g in grad.items():
            g = g + DECAY * params[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(net, 0.0)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, bound: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    The model is fitted on ``bound`` labelled rows at most (``labelled.sample``) and sent to the tasks; it is small whatever the input. A null text is an empty one:
    one passage without words, which gets a score too. A very long text is as many passages as it needs, one after another in one task, whose memory grows with
    that text alone. Without labels all scores are 0, with labels of one class that class. Repeated rows each give a row, an empty table none; other columns are
    not read.
    """
    learned = sample(docs, labels, label, bound, id_col, text_col)
    model = train(learned["text"], learned["label"].to_numpy().astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = id_text(docs, id_col, text_col)
    rows = rows.select("doc_id", "text", held_out(rows["doc_id"]).alias("held_out"))
    return rows.mapInArrow(releasing(run), "doc_id long, held_out boolean, score double, predicted int")
