"""Hard negatives by vantage-point trees over norm-augmented vectors.

With M the largest norm of a shard, a vector x gets one more component, the root of M² - |x|², and a query q gets 0. Then
|q - x|² = |q|² + M² - 2 q·x: the larger the inner product, the nearer the vector, and a window of scores is an annulus around the query.

A shard's tree halves its vectors by their distance from a vantage point again and again; for each node it knows between which distances from the
vantage point it lies. A query gets bounds of its distance to every leaf, and goes through the leaves that meet an annulus, nearest first, until no
leaf left can hold a better row. Scores are whole numbers and exact; bounds only steer, with room for rounding.

Shards and blocks of queries are files in the shared folder, as in ``ann``. Rows are dealt to shards by their id, so neither a label that many
rows share nor a group of copies ends up in one task, and results move as few narrow rows a query and task.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import keep, new_path
from quire.llm.shard_files import read, there, written
from quire.llm.vector_codes import finite

#: Vectors of a shard, and queries of a block, about; shards of a search task; vectors of a leaf at most.
SHARD, BLOCK, TOGETHER, LEAF = 16_000, 256, 4, 64


@dataclass
class Tree:
    """Nodes level by level: ``parent``, ``vantage`` (of inner nodes; -1: a leaf), nearest and farthest distance from the parent's vantage
    point, and where the node's vectors stand in ``order``."""

    parent: np.ndarray
    vantage: np.ndarray
    near: np.ndarray
    far: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    order: np.ndarray
    level: np.ndarray


def build(x: np.ndarray) -> Tree:
    """The tree of the rows of ``x`` (whole numbers), in the space with the further component."""
    square = (x * x).sum(1)
    high = np.sqrt(square.max() - square)
    order = np.arange(len(x))
    parent, vantage, near, far, begin, end, level = [-1], [], [0.0], [np.inf], [0], [len(x)], [0]
    while len(vantage) < len(parent):
        i = len(vantage)
        a, b = begin[i], end[i]
        if b - a <= LEAF:
            vantage.append(-1)
            continue
        own = order[a:b]
        away = lambda v: np.sqrt(np.maximum(0.0, square[own] + square[v] - 2 * (x[own] @ x[v]) + (high[own] - high[v]) ** 2))  # noqa: E731, B023
        v = int(own[away(own[0]).argmax()])  # a far point parts better than one in the middle
        dist, half = away(v), (b - a) // 2
        by = np.argsort(dist, kind="stable")
        order[a:b], dist = own[by], dist[by]
        vantage.append(v)
        for c, d in ((a, a + half), (a + half, b)):
            parent.append(i)
            near.append(dist[c - a])
            far.append(dist[d - a - 1])
            begin.append(c)
            end.append(d)
            level.append(level[i] + 1)
    return Tree(*(np.array(v) for v in (parent, vantage, near, far, begin, end, order, level)))


class Shard:
    """Vectors of a shard with their ids, labels (as codes) and tree."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, names: np.ndarray, tree: Tree):
        self.ids, self.labels, self.x, self.tree = ids[tree.order], labels[tree.order], x[tree.order].astype(np.float64), tree
        self.codes = {n: i for i, n in enumerate(names.tolist())}
        self.points = x.astype(np.float64)[np.maximum(tree.vantage, 0)]
        self.most = float((self.x * self.x).sum(1).max())
        self.leaves = np.flatnonzero(tree.vantage < 0)
        self.rows = [np.arange(a, b) for a, b in zip(tree.begin[self.leaves].tolist(), tree.end[self.leaves].tolist(), strict=True)]
        self.low = np.array([self.labels[r].min() for r in self.rows])
        self.high = np.array([self.labels[r].max() for r in self.rows])

    @staticmethod
    def made(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> bytes:
        """A shard as bytes. Of rows that share an id the one with the smallest label and then vector stays."""
        keys = [x[:, j] for j in range(x.shape[1] - 1, -1, -1)]
        order = np.lexsort([*keys, labels, ids])
        ids, labels, x = ids[order], labels[order], x[order]
        first = np.append(True, ids[1:] != ids[:-1])
        names, codes = np.unique(labels[first], return_inverse=True)
        out = io.BytesIO()
        np.savez(out, ids=ids[first], labels=codes, x=x[first].astype(np.int32), names=names, **build(x[first].astype(np.float64)).__dict__)
        return out.getvalue()

    @classmethod
    def read(cls, data: bytes) -> Shard:
        with np.load(io.BytesIO(data)) as z:
            return cls(z["ids"], z["labels"], z["x"], z["names"], Tree(*(z[n] for n in Tree.__dataclass_fields__)))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and leaf the largest and the smallest score that the leaf may hold."""
        t, reach = self.tree, (q * q).sum(1)[:, None] + self.most
        away = np.sqrt(np.maximum(0.0, reach - 2 * (q @ self.points.T)))
        least, most = np.zeros((len(q), len(t.parent))), np.full((len(q), len(t.parent)), np.inf)
        for level in range(1, int(t.level[-1]) + 1):
            own = np.flatnonzero(t.level == level)
            up = t.parent[own]
            least[:, own] = np.maximum(least[:, up], np.maximum(away[:, up] - t.far[own], t.near[own] - away[:, up]))
            most[:, own] = np.minimum(most[:, up], away[:, up] + t.far[own])
        slack = 0.25 + 1e-9 * reach
        return (reach - least[:, self.leaves] ** 2) / 2 + slack, (reach - most[:, self.leaves] ** 2) / 2 - slack

    def search(self, anchor: int, q: np.ndarray, label: str, same: bool, windows: np.ndarray, k: int, upper: np.ndarray, lower: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each window (smallest and largest score) the first k (score, id) of rows with the query's label, or without it: larger scores first,
        ties to the smaller id, the anchor itself left out. ``upper`` and ``lower``: the query's row of ``bounds``."""
        code = self.codes.get(label, -1)
        pure = (self.low == self.high) & (self.low == code)
        useful = (self.low <= code) & (code <= self.high) if same else ~pure
        useful &= (upper >= windows[:, 0].min()) & (lower <= windows[:, 1].max())
        order = np.flatnonzero(useful)
        order = order[np.argsort(-upper[order], kind="stable")]
        score, ids = np.zeros(0), np.zeros(0, np.int64)
        at, step = 0, 2
        while at < len(order):
            if self._done(windows, score, k, upper[order[at]]):
                break
            rows = np.concatenate([self.rows[leaf] for leaf in order[at : at + step]])
            rows = rows[((self.labels[rows] == code) == same) & (self.ids[rows] != anchor)]
            new = self.x[rows] @ q
            fit = ((new[:, None] >= windows[:, 0]) & (new[:, None] <= windows[:, 1])).any(1)
            score, ids = np.append(score, new[fit]), np.append(ids, self.ids[rows[fit]])
            by = np.lexsort([ids, -score])
            score, ids = score[by], ids[by]
            inside = (score[:, None] >= windows[:, 0]) & (score[:, None] <= windows[:, 1])
            held = (inside & (inside.cumsum(0) <= k)).any(1)
            score, ids = score[held], ids[held]
            at, step = at + step, min(2 * step, 64)
        return [[(int(s), int(i)) for s, i in zip(score[fit].tolist(), ids[fit].tolist(), strict=True)][:k] for fit in ((score >= a) & (score <= b) for a, b in windows)]

    @staticmethod
    def _done(windows: np.ndarray, score: np.ndarray, k: int, upper: float) -> bool:
        """Whether rows of at most the score ``upper`` can change no window any more."""
        for a, b in windows:
            own = score[(score >= a) & (score <= b)]
            if upper >= a and (len(own) < k or upper >= own[k - 1]):
                return False
        return True


def largest_component(width: int) -> int:
    """The bound of components for which inner products are exact in double precision."""
    return int((2.0**52 / max(1, width)) ** 0.5)


def mine(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5,
    low: tuple[int, int] = (80, 100), scale: int = 256, shard: int = SHARD,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives of every anchor and positive.

    Components become floor(``scale`` * x); a score is the inner product with the anchor; larger ones come first, ties by smaller id. ``anchors``
    tells which rows are asked. An anchor's positives are its first ``positives`` other rows with its label; for each, the first ``negatives`` rows of other
    labels are returned whose score is at most the positive's and at least ``low`` of it (a fraction).

    Rows without an id, label or vector, or with a null or non-finite component, take no part; without an anchor, a positive or a negative there
    is no row. Zero and empty vectors take part, with scores of 0. Vectors of unequal length count as filled up with zeros. Of rows that share an id the one with the smallest
    label (as text) and then vector counts. Components beyond ``largest_component`` count as that, so that scores are exact. Other columns are not read.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("asked"))
    rows = given.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    n, n_asked, width = rows.agg(F.count("*"), F.count_if("asked"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards, blocks = -(-n // shard), -(-n_asked // BLOCK)
    bound, path = largest_component(width), new_path(spark, "negatives")
    numbered = lambda df, of: df.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, of))).cast("int"))

    def whole(column: pd.Series) -> np.ndarray:
        out = np.zeros((len(column), width))
        for i, v in enumerate(column):
            out[i, : len(v)] = v
        return np.clip(np.floor(out * scale), -bound, bound)

    def write_shard(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        written(path, f"shard-{part}", Shard.made(frame["id"].to_numpy(), frame["label"].to_numpy(str), whole(frame["v"])))
        return pd.DataFrame({"part": [part]})

    def write_block(frame: pd.DataFrame) -> pd.DataFrame:
        part, out = int(frame["part"].iloc[0]), io.BytesIO()
        np.savez(out, ids=frame["id"].to_numpy(), labels=frame["label"].to_numpy(str), x=whole(frame["v"]))
        written(path, f"block-{part}", out.getvalue())
        return pd.DataFrame({"part": [part]})

    def write_windows(frame: pd.DataFrame) -> pd.DataFrame:
        part, out = int(frame["part"].iloc[0]), io.BytesIO()
        np.savez(out, ids=frame["id"].to_numpy(), positive=frame["positive_id"].to_numpy(), score=frame["positive_score"].to_numpy())
        written(path, f"windows-{part}", out.getvalue())
        return pd.DataFrame({"part": [part]})

    # a shard and a block hold a bounded number of rows, whatever the labels
    keep(numbered(rows.drop("asked"), shards).repartitionById(max(1, shards), F.col("part")).groupBy("part").applyInPandas(write_shard, "part int"), "negatives-shards")
    asked = rows.filter("asked").groupBy("id").agg(F.min(F.struct("label", "v")).alias("own")).select("id", "own.*")
    keep(numbered(asked, blocks).groupBy("part").applyInPandas(write_block, "part int"), "negatives-blocks")

    every = np.array([[-np.inf, np.inf]])
    first = _searched(spark, path, shards, blocks, lambda s, ids, labels, x, block: _positives(s, ids, labels, x, every, positives), "id long, positive_id long, positive_score long")
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("positive_score"), "positive_id"))
    found = keep(first.withColumn("n", best).filter(F.col("n") <= positives).drop("n"), "negatives-positives")  # at most ``positives`` rows an anchor
    keep(numbered(found, blocks).groupBy("part").applyInPandas(write_windows, "part int"), "negatives-windows")

    def negatives_of(s: Shard, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, block: int) -> list[tuple[int, ...]]:
        if not there(path, f"windows-{block}"):
            return []
        with np.load(io.BytesIO(read(path, f"windows-{block}"))) as z:
            owner, positive, score = z["ids"], z["positive"], z["score"]
        out = []
        upper, lower = s.bounds(x)
        for i in range(len(ids)):
            own = np.flatnonzero(owner == ids[i])
            windows = np.stack([-(-low[0] * score[own] // low[1]), score[own]], 1).astype(np.float64)
            sane = windows[:, 0] <= windows[:, 1]  # a negative score leaves nothing between
            own, windows = own[sane], windows[sane]
            if len(own):
                for p, hits in zip(own, s.search(int(ids[i]), x[i], labels[i], False, windows, negatives, upper[i], lower[i]), strict=True):
                    out += [(int(ids[i]), int(positive[p]), int(score[p]), row, own_score) for own_score, row in hits]
        return out

    second = _searched(spark, path, shards, blocks, negatives_of, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")).cast("int")
    return second.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _positives(s: Shard, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, windows: np.ndarray, k: int) -> list[tuple[int, ...]]:
    upper, lower = s.bounds(x)
    found = (s.search(int(i), q, label, True, windows, k, u, v)[0] for i, q, label, u, v in zip(ids, x, labels, upper, lower, strict=True))
    return [(int(i), row, score) for i, own in zip(ids, found, strict=True) for score, row in own]


def _searched(spark: SparkSession, path: str, shards: int, blocks: int, one: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows that ``one`` gives for each shard and block: a task holds some shards and goes through every g-th block, with enough tasks for all cores."""
    groups = [list(range(a, min(a + TOGETHER, shards))) for a in range(0, shards, TOGETHER)]
    g = min(blocks, max(1, -(-2 * spark.sparkContext.defaultParallelism // max(1, len(groups)))))
    tasks = [(i, own, j, g) for i, (own, j) in enumerate((own, j) for own in groups for j in range(g))]
    work = spark.createDataFrame(tasks, "slot int, shards array<int>, j int, g int")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for t in frame.itertuples():
                held = [Shard.read(read(path, f"shard-{s}")) for s in t.shards if there(path, f"shard-{s}")]
                for b in range(t.j, blocks, t.g):
                    if there(path, f"block-{b}"):  # else no query fell into it
                        with np.load(io.BytesIO(read(path, f"block-{b}"))) as z:
                            ids, labels, x = z["ids"], z["labels"], z["x"]
                        for s in held:
                            yield pd.DataFrame(one(s, ids, labels, x, b), columns=names)

    return work.repartitionById(max(1, len(tasks)), F.col("slot")).mapInPandas(run, schema)
