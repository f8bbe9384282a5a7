"""Vector codes, hard negatives and quality on odd rows and empty tables, against brute force and held-out labels."""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import ann, hard_negatives, quality, queries, vector_codes

NAN, INF = float("nan"), float("inf")
ODD = [None, [], [NAN] * 16, [1.0, None] * 8, [INF] + [0.0] * 15, [0.0] * 16, [0.25] * 16, [0.25] * 16, [0.5] * 5, [-0.3] * 16, [0.1, -0.2] * 8]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    points = np.round(rng.normal(0, 0.3, (400, 16)), 2)
    points[200:230] = points[7]  # copies
    rows = [(i, v, i % 3 if i % 11 else None) for i, v in enumerate(ODD)] + [(i + 20, v, int(rng.integers(0, 4)) if i % 3 else 1) for i, v in enumerate(points.tolist())]
    rows += [(30, points[10].tolist(), 1)] * 2 + [(None, points[3].tolist(), None), (25, [0.125] * 16, 0)]
    # columns that clash with names used inside
    return spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label int, v string, id int, part int, score int").repartition(5).cache()


def _good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _codes(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if _good(r.embedding)]
    width = -(-max(len(r.embedding) for r in kept) // parts) * parts
    whole = [[math.floor(4096 * x) for x in r.embedding] + [0] * (width - len(r.embedding)) for r in kept]
    cut = width // parts
    piece = lambda v, p: v[p * cut : (p + 1) * cut]
    first = sorted(range(len(kept)), key=lambda i: (kept[i].vec_id is None, kept[i].vec_id, kept[i].embedding))[:entries]
    books = [[piece(whole[i], p) for i in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(piece(v, p), books[p])[1] for v in whole]
            for k in range(len(books[p])):
                if held := [piece(v, p) for v, o in zip(whole, own) if o == k]:
                    books[p][k] = [sum(c) // len(held) for c in zip(*held)]
    made = [[near(piece(v, p), books[p]) for p in range(parts)] for v in whole]
    error = [sum(d for d, _ in m) for m in made]
    total = {r.label: sum(e for s, e in zip(kept, error) if s.label == r.label) for r in kept}
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(r.vec_id), "".join(f"{k:02x}" for _, k in m), e, total[r.label], sha) for r, m, e in zip(kept, made, error))


def _rows(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("joined", [False, True])
def test_vector_codes(vectors, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(vector_codes, "FEW_LABELS", 0)
    assert _rows(vector_codes.encode(vectors)) == _codes(vectors.collect())


def test_vector_codes_few_empty_and_huge(spark, vectors):
    few = vectors.filter("vec_id between 4 and 9")
    assert _rows(vector_codes.encode(few)) == _codes(few.collect())
    empty = vectors.filter("vec_id < 0")
    assert vector_codes.encode(empty).collect() == [] and vector_codes.encode(vectors.filter("vec_id < 1")).collect() == []
    huge = spark.createDataFrame([(1, [1e300] * 8, 1), (2, [-1e300] * 8, 1), (3, [0.0] * 8, None)], "vec_id long, embedding array<double>, label int")
    got = vector_codes.encode(huge, entries=1, rounds=0).collect()
    assert {r.vec_id: r.error >= 0 for r in got} == {1: True, 2: True, 3: True}
    with pytest.raises(ValueError):
        vector_codes.encode(huge, entries=300)


def test_partial_distances_equal_whole_ones():
    rng = np.random.default_rng(1)
    for width in (1, 2, 8, 13):
        x, book = rng.integers(-4, 4, (300, width)), rng.integers(-4, 4, (16, width))
        book[5] = book[2]
        whole = ((x[:, None] - book[None]) ** 2).sum(2)
        got, dist = vector_codes.nearest_entry(x, book)
        assert (got == whole.argmin(1)).all() and (dist == whole.min(1)).all()
    assert vector_codes.nearest_entry(np.zeros((0, 4), int), book[:, :4])[0].tolist() == []


def _mined(rows, anchors, positives=5, negatives=5):
    own = {}
    for r in rows:
        if r.vec_id is not None and r.label is not None and _good(r.embedding):
            v = [math.floor(256 * x) for x in r.embedding]
            own[r.vec_id] = min(own.get(r.vec_id, (str(r.label), v)), (str(r.label), v))
    width = max(len(v) for _, v in own.values())
    out = set()
    for a in own:
        if not anchors(a):
            continue
        dot = {i: sum(x * y for x, y in zip(own[a][1] + [0] * width, v)) for i, (_, v) in own.items() if i != a}
        same = sorted((-s, i) for i, s in dot.items() if own[i][0] == own[a][0])[:positives]
        for p, i in same:
            fit = sorted((-s, j) for j, s in dot.items() if own[j][0] != own[a][0] and 80 * -p <= 100 * s <= 100 * -p)[:negatives]
            out |= {(a, i, n + 1, j, -p, -s) for n, (s, j) in enumerate(fit)}
    return out


@pytest.mark.parametrize("shard", [16_000, 90])
def test_hard_negatives(vectors, shard):
    got = hard_negatives.mine(vectors, F.col("vec_id") % 10 == 0, shard=shard)
    assert {tuple(r) for r in got.collect()} == _mined(vectors.collect(), lambda i: i % 10 == 0) and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_without_rows_to_give(vectors):
    ask = F.col("vec_id") % 10 == 0
    for few in (vectors.filter("vec_id < 0"), vectors.filter("vec_id = 20"), vectors.filter("label = 1"), vectors.filter("vec_id % 10 = 3")):
        assert hard_negatives.mine(few, ask).collect() == []


def test_vantage_point_bounds_hold_every_score():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 60, (30, 8))[np.arange(3000) % 30] + rng.normal(0, 6, (3000, 8)))
    s = hard_negatives.Shard.read(hard_negatives.Shard.made(np.arange(3000), rng.integers(0, 3, 3000).astype(str), x))
    q = np.floor(rng.normal(0, 60, (20, 8)))
    upper, lower = s.bounds(q)
    score = q @ s.x.T
    assert sorted(np.concatenate(s.rows).tolist()) == list(range(3000)) and max(map(len, s.rows)) <= hard_negatives.LEAF
    skipped = 0
    for i, own in enumerate(s.rows):
        assert (score[:, own].max(1) <= upper[:, i]).all() and (score[:, own].min(1) >= lower[:, i]).all()
        skipped += (upper[:, i] < score.max(1)).sum()
    assert skipped > 100  # bounds leave leaves out


def _document(rng, good, words=80):
    own = ["the", "of", "and", "stone", "river", "house", "green", "walked", "slowly"] if good else ["zz|", "$$%", "qq##", "xx|", "%%%", "|"]
    return " ".join(rng.choice(own, words)) + "."


def test_quality_gradients():
    rng = np.random.default_rng(0)
    x, bag, y = rng.normal(0, 1, (11, 6)), np.array([0, 3, 4, 9, 11]), np.array([1.0, 0.0, 1.0, 0.0])
    shape = {"w": (6, 5), "b": (5,), "v": (5, 3), "u": (5, 3), "a": (3,), "beta": (5,), "c": (1,)}
    net = quality.Network({k: rng.normal(0, 0.5, s) for k, s in shape.items()}, np.zeros(6), np.ones(6))
    _, grad = net.gradients(x, bag, y)
    for name, p in net.params.items():
        for at in np.ndindex(p.shape):
            kept, ends = p[at], []
            for step in (1e-6, -1e-6):
                p[at] = kept + step
                ends.append(net.gradients(x, bag, y)[0])
            p[at] = kept
            assert abs((ends[0] - ends[1]) / 2e-6 - grad[name][at]) < 1e-6
    attention = net.weights(x, bag)[3]
    assert np.allclose(np.add.reduceat(attention, bag[:-1]), 1)


def test_quality_passages_cover_whole_texts():
    texts = ["", "one two", " \n ", " ".join(["word"] * 200), "é " * 97]
    x, bag = quality.passages(pa.array(texts))
    assert np.diff(bag).tolist() == [1, 1, 1, -(-200 // quality.WORDS), -(-97 // quality.WORDS)] and x.shape == (bag[-1], quality.FEATURES)
    alone = [quality.passages(pa.array([t]))[0] for t in texts]
    assert np.allclose(np.concatenate(alone), x)
    assert quality.passages(pa.array([], pa.string()))[0].shape == (0, quality.FEATURES)


def test_quality(spark):
    rng = np.random.default_rng(3)
    rows = [(i, _document(rng, i % 3 > 0), "x", 0.5) for i in range(300)]
    long = _document(rng, True, 400_000)
    rows += [(1000, None, "x", 0.0), (1001, "", "x", 0.0), (1002, long, "x", 0.0), (1003, _document(rng, False, 3000), "x", 0.0), (5, rows[5][1], "x", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 280)] + [(281, None), (None, 1)], "doc_id long, quality int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 5 for r in got) == 2
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in by.items())
    assert all(by[i].predicted == int(i % 3 > 0) for i in range(300)) and by[1002].predicted == 1 and by[1003].predicted == 0 and by[1000].score == by[1001].score
    assert quality.score(docs.filter("doc_id < 0"), labels).collect() == []
    assert {r.score for r in quality.score(docs, labels.filter("doc_id < 0")).collect()} == {0.0} and {r.score for r in quality.score(docs, labels.filter("quality = 1")).collect()} == {1.0}


def test_held_out_floors(spark):
    """Each classifier on the held-out rows of the given tables."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op12_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert len(got) > 80 and np.mean([r.predicted == labels[r.doc_id].quality for r in got]) >= 0.96
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.op4_language_id(spark, sf).collect() if r.held_out and langs[r.doc_id]]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in got]) >= 0.98
    # a third of the few labels of the smaller table is too little for the lexicon, the trees and the calibration each
    labels = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = [r for r in queries.op8_toxicity(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    assert len(got) > 900 and np.mean([r.predicted == labels[r.doc_id].toxic for r in got]) >= 0.97


def test_nearest_looks_at_nodes_that_no_edge_reaches():
    x = np.zeros((60, 2), np.float32)
    x[:50, 0], x[50:, 0] = np.arange(50), 1000 + np.arange(10)
    graph = np.full((60, 2), -1)
    graph[np.arange(49), 0] = np.arange(1, 50)
    whole, lost = ann._connected(x, graph, np.arange(1))
    assert whole.shape == (60, 2 + ann.RESCUE)
    seen, front = set(), [0]
    while front:
        n = front.pop()
        if n not in seen:
            seen.add(n)
            front += [int(v) for v in whole[n] if v >= 0]
    assert seen | set(lost.tolist()) == set(range(60)) and not seen & set(lost.tolist())
