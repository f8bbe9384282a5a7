"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a fixed and of a learned lexicon, second-person words near lexicon words, capitals, punctuation,
obfuscated lexicon words (digits or signs for letters), and length. The labelled sample is dealt into three: on the first the lexicon
is learned, on the second the trees, on the third the calibration.
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

#: Rows of the labelled sample at most.
SAMPLE = 12_000
#: Insults (fixed values).
LEXICON = "idiot moron clown pathetic worthless scum loser stupid dumb trash garbage vermin disgusting fool imbecile coward liar pig filth filthy hate hateful shut disgrace ugly useless".split()
#: Second-person words of the four languages (fixed values).
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine tu te toi ton ta tes vous votre vos usted tú ti tus".split()
#: Signs that stand for letters (fixed values).
_FOR_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
NEAR = 5
#: Whole words, and beginnings of so many bytes, that the learned lexicon may hold: inflected and compound insults share their stem.
STEMS = (None, 4, 5, 6, 7)
ROUNDS, DEPTH, BINS, RATE = 120, 4, 48, 0.1

_PLAIN = LOWER.copy()
for _a, _b in _FOR_LETTERS.items():
    _PLAIN[ord(_a)] = ord(_b)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(x) for x in _FOR_LETTERS]] = True
FEATURES = 18


def _hashes(words: list[str]) -> np.ndarray:
    data, at = flat(pa.array(words))
    return np.sort(run_hashes(_PLAIN[data], at[:-1], at[1:]))


def _in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def word_hashes(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes, text and "holds a sign" of every run of letters and of signs that stand for letters; a run needs a letter.

    There is a list of hashes for each of ``STEMS``: the whole word first, then its beginnings.
    """
    data, at = flat(texts)
    begin, end, doc = runs(_LETTER[data] | _SIGN[data], at)
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    n = letters[end] - letters[begin]
    real = n > 0
    signs = (n < end - begin)[real]
    begin, end, plain = begin[real], end[real], _PLAIN[data]
    return [run_hashes(plain, begin, end if k is None else np.minimum(begin + k, end)) for k in STEMS], doc[real], signs


def _by_size(texts: pa.Array, chars: int = 1_000_000) -> Iterator[pa.Array]:
    for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), chars=chars):
        yield part.column(0)


def features(texts: pa.Array, strong: np.ndarray, weights: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The matrix of ``FEATURES`` columns, worked out for about a million bytes at a time."""
    return np.concatenate([np.zeros((0, FEATURES)), *(_features(part, strong, weights) for part in _by_size(texts))])


def _features(texts: pa.Array, strong: np.ndarray, weights: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``strong``: hashes of the fixed lexicon; ``weights``: for each of ``STEMS`` learned hashes (sorted) and log odds."""
    n = len(texts)
    data, at = flat(texts)
    stems, doc, signs = word_hashes(texts)
    hashed = stems[0]
    count = lambda mask: np.bincount(doc, mask, n)
    words = np.maximum(1, np.bincount(doc, minlength=n))
    hit, person = _in(hashed, strong), _in(hashed, _hashes(SECOND_PERSON))
    learned = np.zeros(len(hashed))
    for own, (table, odds) in zip(stems, weights, strict=True):
        if len(table):
            i = np.minimum(np.searchsorted(table, own), len(table) - 1)
            found = np.where(table[i] == own, odds[i], 0.0)
            learned = np.where(np.abs(found) > np.abs(learned), found, learned)
    any_hit = hit | (learned > 1.5)
    near = np.zeros(len(hashed), bool)
    for k in range(1, NEAR + 1):
        same = doc[k:] == doc[:-k]
        near[k:] |= person[:-k] & same
        near[:-k] |= person[k:] & same
    byte_doc = np.repeat(np.arange(n), np.diff(at))
    chars = np.maximum(1, np.diff(at))
    per_byte = lambda mask: np.bincount(byte_doc[mask], minlength=n)
    upper, letter = per_byte((data >= 65) & (data <= 90)), np.maximum(1, per_byte(_LETTER[data]))
    size, top = np.log1p(words), np.zeros(n)
    np.maximum.at(top, doc, learned)
    hits, strong_learned = count(hit), count(learned > 1.5)
    return np.stack(
        [
            hits, hits / words, np.minimum(hits, 20) / size, strong_learned, strong_learned / words, count(np.maximum(learned, 0)), count(learned) / words,
            count(learned < -0.7) / words, count(any_hit & near), count(person) / words, count(hit & signs), count(signs) / words, upper / letter,
            per_byte(data == 33) / chars, per_byte((data == 63) | (data == 46) | (data == 44)) / chars, size, top, count(learned > 3),
        ],
        axis=1,
    )


def learn_lexicon(texts: pa.Array, toxic: np.ndarray, least: int = 4, most: int = 2000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words and stems whose presence tells toxic from other texts: for each of ``STEMS`` sorted hashes and smoothed log odds."""
    seen, before = [], 0
    for part in _by_size(texts):
        stems, doc, _ = word_hashes(part)
        seen.append((stems, doc + before))
        before += len(part)
    n_bad = max(1.0, float(toxic.sum()))
    n_good = max(1.0, len(toxic) - n_bad)
    out = []
    for k in range(len(STEMS)):
        pairs = [np.unique(np.rec.fromarrays([stems[k], doc])) for stems, doc in seen]  # a text is in one part only
        pair = np.concatenate(pairs) if pairs else np.zeros(0, [("f0", "u8"), ("f1", "i8")])
        word, where = np.unique(pair["f0"], return_inverse=True)
        bad = np.bincount(where, toxic[pair["f1"]], len(word))
        all_ = np.bincount(where, minlength=len(word))
        odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((all_ - bad + 0.5) / (n_good + 1))
        sure = np.abs(odds) * np.sqrt(all_)
        good = np.flatnonzero((all_ >= least) & (sure > 4))
        good = np.sort(good[np.argsort(-sure[good], kind="stable")[:most]])
        out.append((word[good], odds[good]))
    return out


@dataclass
class Trees:
    """Trees as arrays [tree, node]: feature, cut, and leaf values; a node's children stand at 2i+1 and 2i+2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (1 << DEPTH) + 1]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for the logistic loss by second-order gains over binned features."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    mean = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    margin = np.full(n, np.log(mean / (1 - mean)))
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, k = (1 << level) - 1, 1 << level
            best = np.full(k, 1e-3)
            for j in range(m):
                key = (node - first) * BINS + binned[:, j]
                sg = np.bincount(key, g, k * BINS).reshape(k, BINS).cumsum(1)
                sh = np.bincount(key, h, k * BINS).reshape(k, BINS).cumsum(1)
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                gain[(sh < 2) | (th - sh < 2)] = 0
                gain[:, len(edges[j]) :] = 0
                at = gain.argmax(1)
                better = gain[np.arange(k), at] > best
                for a in np.flatnonzero(better):
                    best[a], feature[first + a], cut[first + a] = gain[a, at[a]], j, edges[j][at[a]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - (1 << DEPTH) + 1
        value = -RATE * np.bincount(leaf, g, 1 << DEPTH) / (np.bincount(leaf, h, 1 << DEPTH) + 1)
        margin += value[leaf]
        trees.append((feature, cut, value))
    return Trees(*(np.stack(t) for t in zip(*trees, strict=True)), start=float(np.log(mean / (1 - mean))))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing values between which ``np.interp`` calibrates."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, s2 = blocks.pop()
            v1, w1, s1 = blocks.pop()
            w = w1 + w2
            blocks.append([(v1 * w1 + v2 * w2) / w, w, (s1 * w1 + s2 * w2) / w])
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


@dataclass
class Model:
    strong: np.ndarray
    lexicon: list[tuple[np.ndarray, np.ndarray]]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        if self.trees is None:
            return np.full(len(texts), self.knots[1][0])
        margin = self.trees.margin(features(texts, self.strong, self.lexicon))
        spread = 0.02 / (1 + np.exp(-margin))  # keeps the order within a step of the calibration
        return np.clip(0.98 * np.interp(margin, *self.knots) + spread, 0, 1)


def train(texts: pa.Array, toxic: np.ndarray) -> Model:
    """From labelled texts; with too few of them, or of one class, the model gives their mean (0 without any)."""
    strong = _hashes(LEXICON)
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if len(toxic) < 30 or toxic.min() == toxic.max():
        return Model(strong, [], None, (np.zeros(1), np.array([float(toxic.mean()) if len(toxic) else 0.0])))
    third = np.arange(len(toxic)) % 3
    part = lambda k: (texts.take(pa.array(np.flatnonzero(third == k))), toxic[third == k])
    lexicon = learn_lexicon(*part(0))
    fit_texts, fit_y = part(1)
    trees = boost(features(fit_texts, strong, lexicon), fit_y)
    kept_texts, kept_y = part(2)
    return Model(strong, lexicon, trees, isotonic(trees.margin(features(kept_texts, strong, lexicon)), kept_y))


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.3, bound: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    The model is fitted on ``bound`` labelled rows at most (``labelled.sample``) and sent to the tasks; it is small whatever the input.
    A null text is an empty one and gets a score too. Without labels all scores are 0. Repeated rows each give a row.
    """
    learned = sample(docs, labels, label, bound, id_col, text_col)
    model = train(learned["text"], learned["label"].to_numpy().astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, chars=1_000_000):
                s = model.score(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = id_text(docs, id_col, text_col)
    rows = rows.select("doc_id", "text", held_out(rows["doc_id"]).alias("held_out"))
    return rows.mapInArrow(releasing(run), "doc_id long, held_out boolean, score double, predicted int")
