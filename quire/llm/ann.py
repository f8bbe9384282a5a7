"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

A shard holds about ``SHARD`` vectors of one length, chosen by a hash of the id. In it, equal vectors are one node. Nodes are inserted in
batches: a greedy beam search proposes neighbours; relaxed pruning (a candidate goes if a chosen neighbour is ``ALPHA`` times nearer to it than
the node is) keeps edges in diverse directions, at most ``DEGREE``; reverse edges are added and pruned alike.

Shards, and blocks of queries, are files in the shared folder. A search task is a row with their names: it reads ``TOGETHER`` shards,
searches them with a beam of ``BEAM`` for one block of queries after another, and yields the best of all of them, ordered by exact
distances. So no vector is copied through a shuffle, and results move as ``k`` narrow rows a query and task.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import keep, new_path
from quire.llm.shard_files import read, there, written

#: Vectors of a shard, and queries of a block, about; shards of a search task.
SHARD, BLOCK, TOGETHER = 16_000, 256, 4
DEGREE, ALPHA, BUILD_BEAM, BEAM = 24, 1.2, 40, 192
#: Places for edges to nodes that pruning has left without a way to them.
RESCUE = 4
BATCH = 256


def valid(vector: Column) -> Column:
    """Neither null nor zero nor empty, and every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def beam_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and squared distances of the beam of every query, nearest first (-1: none). All queries step together."""
    n = len(queries)
    starts = starts[:beam]
    ids = np.full((n, beam), -1)
    ids[:, : len(starts)] = starts
    dist = np.full((n, beam), np.inf, np.float32)
    dist[:, : len(starts)] = ((x[starts][None] - queries[:, None]) ** 2).sum(2)
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    done = ids < 0
    rows = np.arange(n)
    while True:
        rows = rows[~done[rows].all(1)]
        if not len(rows):
            return ids, dist
        at = (~done[rows]).argmax(1)
        done[rows, at] = True
        new = graph[ids[rows, at]]
        there = new >= 0
        there &= ~(new[:, :, None] == ids[rows][:, None, :]).any(2)
        d = ((x[new] - queries[rows][:, None]) ** 2).sum(2)
        d[~there] = np.inf
        both, far = np.concatenate([ids[rows], new], 1), np.concatenate([dist[rows], d], 1)
        flags = np.concatenate([done[rows], ~there], 1)
        order = np.argsort(far, axis=1, kind="stable")[:, :beam]
        ids[rows], dist[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(far, order, 1)
        flags = np.take_along_axis(flags, order, 1)
        flags[np.isinf(dist[rows])] = True
        done[rows] = flags


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of each node out of its candidates (-1: none), nearest first; candidates must differ from their node."""
    dist = ((x[candidates] - x[nodes][:, None]) ** 2).sum(2)
    dist[candidates < 0] = np.inf
    order = np.argsort(dist, axis=1, kind="stable")
    candidates, dist = np.take_along_axis(candidates, order, 1), np.take_along_axis(dist, order, 1)
    again = (candidates[:, 1:] == candidates[:, :-1]) & (candidates[:, 1:] >= 0)
    dist[:, 1:][again] = np.inf
    alive = np.isfinite(dist)
    out = np.full((len(nodes), degree), -1)
    vectors = x[candidates]
    rows = np.arange(len(nodes))
    for k in range(degree):
        rows = rows[alive[rows].any(1)]
        if not len(rows):
            break
        at = alive[rows].argmax(1)
        chosen = candidates[rows, at]
        out[rows, k] = chosen
        between = ((vectors[rows] - x[chosen][:, None]) ** 2).sum(2)
        alive[rows] &= alpha * alpha * between > dist[rows]
        alive[rows, at] = False
    return out


def build(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The graph of a shard's distinct vectors, nodes that it doesn't reach, and those from which searches start: the medoid and some spread ones."""
    n = len(x)
    rng = np.random.Generator(np.random.PCG64(seed))
    medoid = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    starts = np.unique(np.append(rng.permutation(n)[:8], medoid)) if n > BUILD_BEAM else np.arange(n)
    graph = np.full((n, DEGREE), -1)
    if n > 1:
        k = min(DEGREE // 2, n - 1)
        graph[:, :k] = (np.arange(n)[:, None] + rng.integers(1, n, (n, k))) % n
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            nodes = order[a : a + BATCH]
            found, _ = beam_search(x, graph, starts, x[nodes], BUILD_BEAM)
            candidates = np.concatenate([found, graph[nodes]], 1)
            candidates[candidates == nodes[:, None]] = -1
            graph[nodes] = robust_prune(x, nodes, candidates, DEGREE, alpha)
            _reverse(x, graph, nodes, alpha)
    return *_connected(x, graph, starts), starts


def _connected(x: np.ndarray, graph: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The graph with further edges to nodes that no search could reach, from the nearest that it finds; and the nodes for which
    there was no room, which every search looks at."""
    graph = np.concatenate([graph, np.full((len(graph), RESCUE), -1)], 1)
    for tries in count():
        seen = np.zeros(len(graph), bool)
        front = starts
        while len(front):
            seen[front] = True
            front = np.unique(graph[front])
            front = front[(front >= 0)]
            front = front[~seen[front]]
        lost = np.flatnonzero(~seen)
        if not len(lost) or tries == 4:
            return graph, lost
        for a in range(0, len(lost), BATCH):
            found, _ = beam_search(x, graph, starts, x[lost[a : a + BATCH]], BUILD_BEAM)
            for node, near in zip(lost[a : a + BATCH].tolist(), found.tolist(), strict=True):
                for v in near:
                    if v >= 0 and v != node and (free := np.flatnonzero(graph[v] < 0)).size:
                        graph[v, free[-1]] = node
                        break


def _reverse(x: np.ndarray, graph: np.ndarray, nodes: np.ndarray, alpha: float) -> None:
    """Adds the edges back from the neighbours of ``nodes`` and prunes the lists that they join."""
    to, back = graph[nodes].ravel(), np.repeat(nodes, graph.shape[1])
    to, back = to[to >= 0], back[to >= 0]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    ends, first, many = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, many)
    new = np.full((len(ends), int(many.max()) if len(many) else 0), -1)
    new[np.repeat(np.arange(len(ends)), many), place] = back
    for a in range(0, len(ends), 512):
        own, wide = ends[a : a + 512], int(many[a : a + 512].max())
        graph[own] = robust_prune(x, own, np.concatenate([graph[own], new[a : a + 512, :wide]], 1), DEGREE, alpha)


def _scale(x: np.ndarray) -> float:
    """What vectors are divided by so that single precision suits the usual ones."""
    usual = float(np.median(np.abs(x).max(1)))
    return 1.0 if 1e-10 < usual < 1e10 else usual


def _single(x: np.ndarray, scale: float) -> np.ndarray:
    """In single precision, with components so large that their squares would overflow cut: these only steer the search."""
    return x if x.dtype == np.float32 and scale == 1.0 else np.clip(x / scale, -1e15, 1e15).astype(np.float32)


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, added up component by component."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore"):
        for j in range(x.shape[1]):
            total += (x[:, j] - q[j]) ** 2
        return np.sqrt(total)


def index(ids: np.ndarray, x: np.ndarray, k: int) -> bytes:
    """A shard as bytes: distinct vectors, their graph, its starts, and each vector's smallest ids (more than k of equal ones can't be among the k nearest)."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order]) + 0.0  # no negative zeros
    _, first, group = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    group, ids = np.unique(np.stack([group, ids], 1), axis=0).T
    begin = np.searchsorted(group, np.arange(len(first) + 1))
    held = np.arange(len(ids)) - begin[group] <= k
    x, scale = x[first], _scale(x)
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    x = small if (small == x).all() else x
    graph, lost, starts = build(_single(x, scale))
    out = io.BytesIO()
    np.savez(out, x=x, graph=graph.astype(np.int32), starts=starts, lost=lost, ids=ids[held], begin=np.searchsorted(group[held], np.arange(len(first) + 1)), scale=scale)
    return out.getvalue()


class Shard:
    """A shard that was read back."""

    def __init__(self, data: bytes):
        with np.load(io.BytesIO(data)) as z:
            self.x, self.graph, self.starts, self.lost, self.ids, self.begin, self.scale = (z[n] for n in ("x", "graph", "starts", "lost", "ids", "begin", "scale"))
        self.near = _single(self.x, float(self.scale))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
        """For each query (distance, id) of the k nearest found, nearest first, ties to the smaller id."""
        out = []
        for a in range(0, len(queries), BATCH):
            q = _single(queries[a : a + BATCH], float(self.scale))
            found, _ = beam_search(self.near, self.graph, self.starts, q, max(BEAM, 2 * k))
            for query_id, vector, nodes in zip(query_ids[a : a + BATCH].tolist(), queries[a : a + BATCH], found, strict=True):
                nodes = np.concatenate([nodes[nodes >= 0], self.lost])
                score = exact(self.x[nodes].astype(np.float64), vector)
                own = [(s, i) for s, n in zip(score.tolist(), nodes.tolist(), strict=True) for i in self.ids[self.begin[n] : self.begin[n + 1]].tolist() if i != query_id]
                out.append(sorted(own)[:k])
        return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the k nearest found by Euclidean distance, ties to the smaller id, itself left out.

    Vectors that are null, empty, zero or not finite take no part; without valid ones there are no rows. Vectors of each length are a space of
    their own. Of rows that share an id and a vector one is returned; of queries that share an id the one with the smallest vector
    is asked. Other columns are not read.
    """
    spark = vectors.sparkSession

    def wanted(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias(name), F.col(vector_col).cast("array<double>").alias("embedding"))
        return rows.filter(F.col(name).isNotNull() & valid(F.col("embedding"))).withColumn("d", F.size("embedding"))

    rows, asked = wanted(vectors, "vec_id"), wanted(queries, "query_id").groupBy("query_id").agg(F.min("embedding").alias("embedding")).withColumn("d", F.size("embedding"))
    path = new_path(spark, "ann")

    def numbered(df: DataFrame, name: str, size: int) -> tuple[DataFrame, dict[int, int]]:
        """Rows with ``part`` and how many parts each length has."""
        parts = {r["d"]: -(-r["n"] // size) for r in df.groupBy("d").agg(F.count("*").alias("n")).collect()}  # a row a length
        many = F.create_map(*[F.lit(v) for pair in parts.items() for v in pair]) if parts else F.create_map(F.lit(0), F.lit(1))
        return df.withColumn("part", F.pmod(F.xxhash64(name), many[F.col("d")]).cast("int")), parts

    rows, shards = numbered(rows, "vec_id", shard)
    asked, blocks = numbered(asked, "query_id", BLOCK)

    def build_shard(frame: pd.DataFrame) -> pd.DataFrame:
        d, part = int(frame["d"].iloc[0]), int(frame["part"].iloc[0])
        written(path, f"shard-{d}-{part}", index(frame["vec_id"].to_numpy(), np.stack(frame["embedding"].to_numpy()), k))
        return pd.DataFrame({"d": [d], "part": [part]})

    def write_block(frame: pd.DataFrame) -> pd.DataFrame:
        d, part = int(frame["d"].iloc[0]), int(frame["part"].iloc[0])
        out = io.BytesIO()
        np.savez(out, ids=frame["query_id"].to_numpy(), x=np.stack(frame["embedding"].to_numpy()))
        written(path, f"block-{d}-{part}", out.getvalue())
        return pd.DataFrame({"d": [d], "part": [part]})

    # each shard is a task of its own: little data but much work
    before = np.cumsum([0, *shards.values()]).tolist()
    offset = F.create_map(*[F.lit(v) for pair in zip(shards or [0], before, strict=False) for v in pair])
    spread = rows.withColumn("slot", (offset[F.col("d")] + F.col("part")).cast("int")).repartitionById(max(1, before[-1]), F.col("slot"))
    keep(spread.groupBy("slot", "d", "part").applyInPandas(build_shard, "d int, part int"), "ann-shards")
    keep(asked.groupBy("d", "part").applyInPandas(write_block, "d int, part int"), "ann-blocks")

    # tasks: some shards, and every g-th block of queries, with enough tasks for all cores
    tasks = []
    for d, n in shards.items():
        groups = [list(range(a, min(a + TOGETHER, n))) for a in range(0, n, TOGETHER)]
        g = min(blocks.get(d, 0), max(1, -(-2 * spark.sparkContext.defaultParallelism // len(groups))))
        tasks += [(d, own, j, g) for own in groups for j in range(g)]
    work = spark.createDataFrame([(i, *t) for i, t in enumerate(tasks)], "slot int, d int, shards array<int>, j int, g int")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for t in frame.itertuples():
                held = [Shard(read(path, f"shard-{t.d}-{s}")) for s in t.shards if there(path, f"shard-{t.d}-{s}")]
                for b in range(t.j, blocks[t.d], t.g):
                    if not there(path, f"block-{t.d}-{b}"):  # no query fell into it
                        continue
                    with np.load(io.BytesIO(read(path, f"block-{t.d}-{b}"))) as z:
                        ids, x = z["ids"], z["x"]
                    found = [s.search(ids, x, k) for s in held]
                    best = [(q, i, score) for q, *own in zip(ids.tolist(), *found, strict=True) for score, i in sorted(set().union(*own))[:k]]
                    yield pd.DataFrame(best, columns=["query_id", "vec_id", "score"])

    met = work.repartitionById(max(1, len(tasks)), F.col("slot")).mapInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return met.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
