"""Exact Jaccard self-join of word shingle sets, by a token-group matrix.

1.  Every document becomes the set of hashes of its shingles; equal sets collapse into their smallest id.
2.  Groups. Each set knows its prefix: the first tokens in an order that all sets share (frequent tokens last, then by hash). A token's pivot
    is, of the sets whose prefix has it, that with the fewest tokens that are not frequent (of a large group of near copies the most usual
    member), then that of the smallest id. A set is compared with the pivots it meets most (and often enough to link), so a group of near
    copies, however large, needs few comparisons a member. Large components of these links are groups; other sets form a group with those that meet the same pivot most.
3.  Matrix. Groups are dealt into parts of bounded size, and by the sizes of sets. A set that shares too few prefix tokens with
    all sets of a size in other components together links with none of them and leaves the search there. For each token and part: does the union
    of the part's prefixes hold the token? A set queries the parts: the count of its prefix tokens in a part's union bounds the overlap with every member.
4.  Only parts that the bound admits are opened, and the set is compared with their members of other components.

The bound. Sets x and y with a Jaccard index of t share at least a = ceil(t / (1 + t) * (|x| + |y|)) tokens. Of the two prefixes one ends first in the
order; what x and y share lies in both prefixes, or behind the prefix that ends first. So the prefixes share at least a - max(r(x), r(y))
tokens, where r counts the tokens behind a prefix. A prefix has |x| - ceil(t |x|) + l(x) tokens with l(x) = 1 + |x| // 20, so that this is l(x) or more:
it loses no link. Members of a large group of near copies that differ too much fail it by their own rare tokens, which come first in
the order and meet nothing. Links within a component aren't looked for again, as only what links reach is asked for.

Frequent tokens (license lines, shared passages) come last in the order, so they stand in a prefix only if the text has little else. Which
are frequent is counted over all documents; the list is bounded and only an order, so the result does not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bit_map, drop, fresh, id_text, keep, releasing, slices
from quire.llm.components import components
from quire.llm.text_hash import SLICE, shingle_sets

#: Tokens that the order puts last: at most so many, the most frequent.
FREQUENT = 200_000
#: A token counts as frequent from so many documents on.
FREQUENT_FROM = 32
#: Members of a part of a group.
PART = 64
#: Pivots that a set is compared with, those that it shares most prefix tokens with. Not a limit on links: parts find the rest.
PIVOTS = 2
#: Sets whose sizes differ by less than this factor are asked for together.
SIZE_STEP = 1.05
#: Bits of the map of ids whose sets are needed again; a full map only lets more sets through.
MAP_BITS = 1 << 23


def _sizes(n: np.ndarray | int, num: int, den: int):
    """Length of the prefix, and l, of sets of n tokens at the threshold num / den."""
    least = 1 + n // 20
    return np.minimum(n, n - (num * n + den - 1) // den + least), least


def _needed(n: str, m: str, num: int, den: int) -> Column:
    """The prefix tokens that sets of n and m tokens share at least if they link (columns' names or expressions)."""

    def behind(k: str) -> str:
        return f"greatest(0, ({num} * {k} + {den - 1}) div {den} - 1 - {k} div 20)"

    return F.expr(f"({num} * ({n} + {m}) + {num + den - 1}) div {num + den} - greatest({behind(n)}, {behind(m)})")


def _admitted(num: int, den: int) -> Column:
    """Whether ``shared`` prefix tokens may be enough for a set of n tokens and one of ``n_min`` to ``n_max``.

    Over the sizes that can link the need falls and rises in straight lines, but for rounding by 2, that end at these three.
    """
    low, high = f"greatest(n_min, ({num} * n + {den - 1}) div {den})", f"least(n_max, {den} * n div {num})"
    return F.col("shared") + 2 >= F.least(*[_needed("n", m, num, den) for m in (low, high, f"least(greatest({low}, n), {high})")])


def _alike(n: str, m: str, num: int, den: int) -> Column:
    """Whether sets of n and m tokens are of sizes that can link."""
    return F.expr(f"{den} * {m} >= {num} * {n} and {den} * {n} >= {num} * {m}")


def _frequent(rows: DataFrame, width: int) -> np.ndarray:
    """Hashes of the most frequent shingles, sorted. A task reports those that it saw in two documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pending = [], 0
        for batch in batches:
            for part in slices(batch, chars=SLICE):
                sets = shingle_sets(part.column(1), width)
                held.append(np.concatenate(sets))
                pending += len(held[-1])
                if pending > 2_000_000:
                    yield _counted(held)
                    held, pending = [], 0
        if held:
            yield _counted(held)

    seen = rows.mapInArrow(releasing(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT_FROM)
    top = seen.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toArrow()["token"].to_numpy()
    return np.sort(top.astype(np.int64).view(np.uint64))


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    token, n = np.unique(np.concatenate(held), return_counts=True)
    often = n > 1
    return pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["token", "n"])


def _prefixes(rows: DataFrame, width: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """``doc_id, n, rare, h1, h2, prefix``: size, prefix tokens that are not frequent, 128-bit fingerprint and prefix of every set."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        last = shared.value
        for batch in batches:
            for part in slices(batch, chars=SLICE):
                sets = shingle_sets(part.column(1), width)
                prints = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "<i8").reshape(-1, 2)
                prefix, rare = [], []
                for s in sets:
                    n = early = len(s)
                    size = int(_sizes(n, num, den)[0]) if n else 0
                    if len(last) and n:
                        late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                        s = np.concatenate([s[~late], s[late]])
                        early = n - int(late.sum())
                    prefix.append(s[:size].view(np.int64))
                    rare.append(min(early, size))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefix])]), pa.int32()), pa.array(np.concatenate(prefix) if prefix else []))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(rare, pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), lists],
                    ["doc_id", "n", "rare", "h1", "h2", "prefix"],
                )

    return rows.mapInArrow(releasing(run), "doc_id long, n long, rare long, h1 long, h2 long, prefix array<long>")


def _id_map(ids: DataFrame) -> bytes:
    """A bit map of hashed ids; its size is fixed."""
    spots = ids.select(F.pmod(F.xxhash64("id"), F.lit(MAP_BITS)).cast("int").alias("spot")).distinct()
    words = spots.groupBy((F.col("spot") / 32).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, spot % 32)) AS bits"))
    table = words.toArrow()  # MAP_BITS / 32 rows at most
    out = np.zeros(MAP_BITS // 32, np.uint32)
    out[table["word"].to_numpy()] = table["bits"].to_numpy().astype(np.uint32)
    return out.tobytes()


def _whole_sets(rows: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``id, tokens`` of the texts whose ids are asked for: a bit map thins the rows before the join."""
    shared = rows.sparkSession.sparkContext.broadcast(_id_map(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint32)
        for batch in batches:
            spot = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((bits[spot // 32] >> (spot % 32).astype(np.uint32)) & 1 == 1))
            for part in slices(batch, chars=SLICE):
                sets = shingle_sets(part.column(1), width)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["id", "tokens"])

    spotted = rows.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS)).cast("int").alias("spot"))
    return spotted.mapInArrow(releasing(run), "id long, tokens array<long>").join(ids, "id", "left_semi")


def _linked(pairs: DataFrame, rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link, exactly. Whole sets are made for the ids of the pairs only."""
    ids = keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "join-ids")
    sets = keep(_whole_sets(rows, ids, width), "join-sets")
    x, y = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    met = pairs.join(x, "a").join(y, "b")
    both = F.size(F.array_intersect("x", "y"))
    # one value a row: the overlap is worked out once
    met = met.select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.explode(F.array(both)).alias("both"))
    links = keep(met.filter(den * F.col("both") >= num * (F.col("total") - F.col("both"))).select("a", "b"), "join-links")
    drop(ids, sets)
    return links


def _hopeful(members: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The tokens that a set shares with sets of other components, by their sizes: ``id, n, token, component, other`` and more; and the ``id, other`` of sets
    that share enough of them with sets of a size, taken together, to link with one of these."""
    spread = members.groupBy("token", "size").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("n_min"), F.max("n").alias("n_max"))
    spread = keep(spread.withColumnRenamed("size", "other"), "join-spread")  # a plain table: the join can split a frequent token
    fits = (den * F.col("n_max") >= num * F.col("n")) & (den * F.col("n") >= num * F.col("n_min"))
    shared = keep(members.join(spread, "token").filter(fits).filter("lo <> component or hi <> component").select("id", "n", "token", "component", "other", "n_min", "n_max"), "join-shared")
    enough = shared.groupBy("id", "n", "other").agg(F.count("*").alias("shared"), F.min("n_min").alias("n_min"), F.max("n_max").alias("n_max"))
    hopeful = keep(enough.filter(_admitted(num, den)).select("id", "other"), "join-hopeful")
    drop(spread)
    return shared, hopeful


def classes(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: documents link where ``den * |intersection| >= num * |union|``.

    ``component_id`` is the smallest id that links reach. A text without words, or null, has an empty set and is linked with nothing. Ids are
    taken to be those of rows; rows that share an id count as linked, and a null id comes back with a null component. An empty table gives no rows.
    """
    if 20 * num < den:
        raise ValueError("a similarity of at least 0.05")
    rows = id_text(docs, id_col, text_col)
    known = keep(_prefixes(rows, width, num, den, _frequent(rows, width)), "join-prefixes")

    # 1. equal sets; the table of them is written so that the join can split a large group of copies
    sized = known.filter("n > 0 and doc_id is not null")
    equal = keep(sized.groupBy("h1", "h2").agg(F.min("doc_id").alias("id")), "join-equal")
    member = keep(sized.select("doc_id", "h1", "h2").join(equal, ["h1", "h2"]).select("doc_id", "id"), "join-members")
    one = sized.join(member.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    one = one.groupBy("doc_id").agg(F.min(F.struct("h1", "h2", "n", "rare", "prefix")).alias("s"))
    index = one.select(F.col("doc_id").alias("id"), "s.n", "s.rare", F.explode("s.prefix").alias("token"))
    often = index.groupBy("token").agg(F.count("*").alias("df"), F.min(F.struct("rare", "id", "n")).alias("p")).filter("df > 1")
    index = keep(index.join(often, "token").select("id", "n", "token", F.col("p.id").alias("pivot"), F.col("p.n").alias("m")), "join-index")
    sizes = keep(known.select("doc_id", "n"), "join-sizes")
    drop(known, equal)

    # 2. groups around pivots
    met = index.groupBy("id", "pivot", "n", "m").agg(F.count("*").alias("shared"))
    near = (F.col("id") != F.col("pivot")) & _alike("n", "m", num, den) & (F.col("shared") >= _needed("n", "m", num, den))
    p = F.struct("shared", "pivot")
    led = keep(met.groupBy("id", "n").agg(F.max(p).alias("lead"), F.sort_array(F.collect_list(F.when(near, p)), asc=False).alias("near")), "join-led")
    stars = keep(led.select("id", F.explode(F.slice("near", 1, PIVOTS)).alias("p")).select(F.col("id").alias("a"), F.col("p.pivot").alias("b")), "join-stars")
    links = _linked(stars, rows, width, num, den)
    component = components(links)
    sized = keep(component.groupBy("component").agg(F.count("*").alias("members")), "join-sized")
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")
    placed = led.select("id", "n", size.alias("size"), F.col("lead.pivot").alias("lead")).join(component, "id", "left").join(sized, "component", "left")
    large = F.coalesce(F.col("members") >= PART, F.lit(False))
    placed = placed.select("id", "n", "size", F.coalesce("component", "id").alias("component"), large.alias("large"), F.when(large, F.col("component")).otherwise(F.col("lead")).alias("group"))
    placed = keep(placed, "join-grouped")
    full = keep(placed.groupBy("large", "group", "size").agg(F.ceil(F.count("*") / PART).alias("parts")), "join-full")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    placed = keep(placed.join(full, ["large", "group", "size"]).select("id", "size", "component", "large", "group", part), "join-placed")

    # 3. tokens that stand in one component only can't link two, and sets that share too few leave
    open_ = keep(index.select("id", "n", "token").join(placed, "id"), "join-open")
    shared, hopeful = _hopeful(open_, num, den)
    members = keep(open_.join(hopeful.select("id").distinct(), "id", "left_semi").withColumnRenamed("size", "other"), "join-hoping")
    drop(open_)
    # the matrix of tokens and parts
    asking = shared.join(hopeful, ["id", "other"], "left_semi")
    key = ["other", "large", "group", "part"]
    matrix = keep(members.groupBy("token", *key).agg(F.min("component").alias("lo"), F.min("n").alias("n_min"), F.max("n").alias("n_max")), "join-matrix")
    met = asking.alias("q").join(matrix.alias("g"), (F.col("q.token") == F.col("g.token")) & (F.col("q.other") == F.col("g.other")) & (F.col("q.component") > F.col("g.lo")))
    bound = met.groupBy("q.id", "q.n", "q.component", *[f"g.{k}" for k in key]).agg(F.count("*").alias("shared"), F.min("g.n_min").alias("n_min"), F.max("g.n_max").alias("n_max"))
    admitted = bound.filter(_admitted(num, den)).withColumnRenamed("component", "own")

    # 4. open the parts
    opened = members.select(*key, "component", F.col("id").alias("b"), F.col("n").alias("m")).distinct()
    pairs = admitted.join(opened, key).filter("own > component").filter(_alike("n", "m", num, den)).filter(F.col("shared") >= _needed("n", "m", num, den))
    pairs = keep(pairs.select(F.col("id").alias("a"), "b").distinct(), "join-pairs")
    more = _linked(pairs, rows, width, num, den)
    drop(index, led, sized, full, placed, members, shared, hopeful, matrix, stars, pairs)
    whole = components(links.unionByName(more))

    # every document: its class, its set's component, or itself
    reached = member.join(whole, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component_id")).dropDuplicates(["doc_id"])
    return sizes.select("doc_id", F.col("n").alias("n_shingles")).join(reached, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, less those that ``classes`` links to a smaller id. Rows without an id, or without words, stay, and so do
    repeated rows of an id that stays. An empty table gives no rows."""
    gone = classes(docs, width, num, den, id_col, text_col).filter("component_id <> doc_id").select(F.col("doc_id").alias(fresh("gone_id", docs)))
    gone = keep(gone, "join-gone")
    may_be, row_id = bit_map(gone, gone[0]), F.coalesce(F.col(id_col).cast("long"), F.lit(0))
    # a map of fixed size spares most rows that stay the join
    return docs.filter(~may_be(row_id)).unionByName(docs.filter(may_be(row_id)).join(gone, F.col(id_col).cast("long") == gone[0], "left_anti"))
