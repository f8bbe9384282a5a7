"""Byte-level BPE from a rank file, merging by a segment tree.

Over the byte positions of a piece stands a segment tree whose leaf ``i`` holds the rank of the pair that starts at the live
node ``i`` (none: infinity); inner nodes hold the leftmost minimum. A merge takes the root's pair, ends its right node and updates
three leaves: the pair at the node, the pair before it and the ended node, each in logarithmic time. Live neighbours
are kept in linked lists. Short pieces of one tree size go through all these steps together in numpy; long ones alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import id_text, releasing, slices
from quire.llm.token_cache import _WORD, TEXTS, CachedEncoder

#: Pieces of more bytes have a tree of their own.
TOGETHER = 128
_NONE = np.int64(1 << 62)


class SegmentTreeBpe:
    """``ranks``: token bytes to id, by merge priority. All 256 single bytes must be there."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.width = int(size).bit_length()
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << self.width | b] = rank
        self.pairs = pairs
        self.keys = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.found = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        first = self.byte
        self.begin = self._rank(first[:, None], first[None])  # of each two bytes
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.text = np.frombuffer(b"".join(tokens), np.uint8)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``_NONE`` where there is none."""
        key = left << self.width | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.found[i], _NONE)

    def many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian uint32 bytes."""
        out: list[bytes] = [b""] * len(pieces)
        sized: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > TOGETHER:
                out[i] = np.array(self.alone(p), "<u4").tobytes()
            elif p:
                sized.setdefault((len(p) - 1).bit_length(), []).append(i)
        for bits, own in sized.items():
            for a in range(0, len(own), 20_000):
                for i, ids in zip(own[a : a + 20_000], self._together([pieces[i] for i in own[a : a + 20_000]], 1 << bits), strict=True):
                    out[i] = ids
        return out

    def _together(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        n, lengths = len(pieces), np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(n, leaves)
        ids = np.zeros((n, leaves + 1), np.int64)  # the last column stands for "no node"
        ids[:, :leaves] = self.byte[raw]
        place = np.arange(leaves)
        following = np.where(place + 1 < lengths[:, None], place + 1, leaves)
        before = np.where(place > 0, place - 1, leaves)
        before = np.concatenate([np.broadcast_to(before, (n, leaves)), np.full((n, 1), leaves)], axis=1)
        following = np.concatenate([following, np.full((n, 1), leaves)], axis=1)
        live = place < lengths[:, None]
        tree = np.full((n, 2 * leaves), _NONE)
        rank = self.begin[raw[:, :-1], raw[:, 1:]]
        rank[place[1:] >= lengths[:, None]] = _NONE
        tree[:, leaves : 2 * leaves - 1] = np.where(rank < _NONE, rank * leaves + place[:-1], _NONE)
        for level in range(leaves.bit_length() - 2, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        rows = np.flatnonzero(tree[:, 1] < _NONE)

        def point(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + leaves
            tree[rows, node] = value
            for _ in range(leaves.bit_length() - 1):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        while len(rows):
            best = tree[rows, 1]
            i, merged = best % leaves, best // leaves
            j = following[rows, i]
            k, p = following[rows, j], before[rows, i]
            ids[rows, i], live[rows, j] = merged, False
            following[rows, i], before[rows, k] = k, i
            point(rows, j, np.full(len(rows), _NONE))
            rank = np.where(k < leaves, self._rank(merged, ids[rows, k]), _NONE)
            point(rows, i, np.where(rank < _NONE, rank * leaves + i, _NONE))
            rank = self._rank(ids[rows, p], merged)
            had = p < leaves
            point(rows[had], p[had], np.where(rank[had] < _NONE, rank[had] * leaves + p[had], _NONE))
            rows = rows[tree[rows, 1] < _NONE]
        flat = ids[:, :leaves][live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=1) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def alone(self, piece: bytes) -> list[int]:
        """The same for one piece, with lists."""
        n, none, get, width = len(piece), float("inf"), self.pairs.get, self.width
        leaves = 1 << max(0, n - 1).bit_length()
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        following, before = [*range(1, n), -1], list(range(-1, n - 1))
        tree: list = [(none, 0)] * (2 * leaves)
        for i in range(n - 1):
            tree[leaves + i] = (get(ids[i] << width | ids[i + 1], none), i)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def point(leaf: int, rank: float) -> None:
            node = leaf + leaves
            tree[node] = (rank, leaf)
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while (best := tree[1])[0] < none:
            merged, i = best
            j = following[i]
            k, p = following[j], before[i]
            ids[i], ids[j], following[i] = merged, -1, k
            if k >= 0:
                before[k] = i
            point(j, none)
            point(i, get(merged << width | ids[k], none) if k >= 0 else none)
            if p >= 0:
                point(p, get(ids[p] << width | merged, none))
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, one after another."""
        if not len(ids):
            return b""
        n = self.length[ids]
        end = np.cumsum(n)
        return self.text[np.arange(int(end[-1])) + np.repeat(self.at[ids] - (end - n), n)].tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> tuple[SegmentTreeBpe, CachedEncoder]:
    """The merger of a rank file (lines of base64 token and rank), and the encoder of whole texts over it."""
    import regex
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        bpe = SegmentTreeBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    # white space as Unicode has it, without the four separators that Python adds
    cut = regex.compile(PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall

    def many(words: set[str], known: dict[str, bytes]) -> dict[str, bytes]:
        plain = [x for x in words if x.isascii() and x.isalpha()]
        out = dict(zip(plain, bpe.many([b" " + x.encode() for x in plain]), strict=True))
        made, pieces = [], set()
        for x in words.difference(out):
            if m := _WORD.fullmatch(x):
                line, stem, mark = m.groups()
                own = [line, stem] if line else [" " + stem]
                if mark:
                    own.append(mark)
            else:
                own = cut(x if x[:1] == "\n" else " " + x)
            made.append((x, own))
            pieces.update(own)
        ids = {}
        for p in pieces:  # of a marked word the stem may be known
            if p[:1] == " " and (stem := out.get(p[1:]) or known.get(p[1:])):
                ids[p] = stem
        wanted = list(pieces.difference(ids))
        ids |= zip(wanted, bpe.many([p.encode() for p in wanted]), strict=True)
        for x, own in made:
            out[x] = b"".join([ids[p] for p in own])
        return out

    def heads(texts: list[str]) -> list[bytes]:
        own = [cut(x) for x in texts]
        pieces = list({p for x in own for p in x})
        ids = dict(zip(pieces, bpe.many([p.encode() for p in pieces]), strict=True))
        return [b"".join([ids[p] for p in x]) for x in own]

    return bpe, CachedEncoder(lambda text: heads([text])[0], many, heads)


def round_trip(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked, ``ids`` (little-endian uint32) of every text.

    One map over the rows, no shuffle. A null text is an empty one: no ids. Repeated rows each give a row; other columns aren't read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encode = load(ranks)
        sha = hashlib.sha256
        for batch in batches:
            for piece in slices(batch, chars=TEXTS):
                got = encode(piece.column(1).to_pylist())
                back = [bpe.decode(np.frombuffer(x, "<u4")) for x in got]
                columns = [piece.column(0), pa.array([len(x) // 4 for x in got], pa.int64()), pa.array([sha(x).hexdigest() for x in got]), pa.array([sha(x).hexdigest() for x in back])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns, names = [*columns, pa.array(got, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)
        encode.clear()

    return id_text(docs, id_col, text_col).mapInArrow(releasing(run), schema)
