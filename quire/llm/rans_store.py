"""Token files: ids under a static range asymmetric numeral system (rANS).

A file is a run of segments. A segment holds whole documents of about ``SEGMENT`` ids and has one frequency table that its
blocks share. Each block of ``STEPS * LANES`` ids is coded apart from the others by ``LANES`` interleaved states into
one stream of 32-bit words. The segment's head lists, for every block, the checkpoint from which it can be
decoded alone: final states, word count, id count and CRC-32; and, for every document, its id and length. So readers
may start at any segment, and at any block within it. numpy codes all lanes of a segment at once.

    head   magic, counts, then arrays: symbols, frequencies, doc ids, doc lengths, block words, block ids, block CRC-32, states
    body   32-bit words of block 0, block 1, ...
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import id_text, keep, new_path, releasing, slices, store
from quire.llm.token_cache import library_encoder

MAGIC = b"QRANS001"
#: Ids of a segment, about; a longer document makes a longer one.
SEGMENT = 1 << 21
#: Characters of texts that are encoded together, about: few enough that their words stay in the processor's cache.
TEXTS = 500_000
LANES, STEPS, BITS = 32, 512, 20
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<8sIIQII")


def _table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and frequencies that add up to 2**BITS, each at least 1."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    total = 1 << BITS
    if len(symbols) > total:
        raise ValueError(f"more than {total} different ids in a segment")
    freq = np.maximum(1, counts * total // max(1, counts.sum())).astype(np.int64)
    rest = total - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if rest >= 0:
        freq[order[0]] += rest
    for i in order:  # too many: the largest give way
        if rest >= 0:
            break
        give = min(-rest, int(freq[i]) // 2)
        freq[i] -= give
        rest += give
    return symbols.astype("<u4"), freq.astype("<u4")


def encode_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one segment. ``ids``: those of all its documents, one after another (at least one)."""
    symbols, freq = _table(ids)
    begin = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    size = LANES * STEPS
    blocks = -(-len(ids) // size)
    number = np.zeros(int(symbols[-1]) + 1, np.int32)
    number[symbols] = np.arange(len(symbols))
    place = number[ids]
    padded = np.full(blocks * size, int(freq.argmax()), np.int64)
    padded[: len(ids)] = place
    grid = padded.reshape(blocks, STEPS, LANES)
    f_all, b_all = freq.astype(np.uint64), begin
    state = np.full((blocks, LANES), _LOW, np.uint64)
    words, sent = np.zeros((STEPS, blocks, LANES), np.uint32), np.zeros((STEPS, blocks, LANES), bool)
    shift, bits = np.uint64(32), np.uint64(BITS)
    for t in range(STEPS - 1, -1, -1):
        x = grid[:, t]
        f = f_all[x]
        full = state >= (f << np.uint64(63 - BITS))
        words[t], sent[t] = state.astype(np.uint32), full
        state = np.where(full, state >> shift, state)
        q = state // f
        state = (q << bits) + (state - q * f) + b_all[x]
    streams = [words[:, b][sent[:, b]] for b in range(blocks)]
    held = np.minimum(size, len(ids) - np.arange(blocks) * size).astype("<u4")
    ids4 = np.ascontiguousarray(ids, "<u4")
    crc = np.array([zlib.crc32(ids4[b * size : (b + 1) * size]) for b in range(blocks)], "<u4")
    head = b"".join(
        x.tobytes()
        for x in (symbols, freq, np.asarray(doc_ids, "<i8"), np.asarray(lengths, "<u4"), np.array([len(s) for s in streams], "<u4"), held, crc, state.astype("<u8"))
    )
    packed = zlib.compress(head, 1)
    return _HEAD.pack(MAGIC, len(symbols), blocks, len(doc_ids), len(packed), zlib.crc32(packed)) + packed + b"".join(s.astype("<u4").tobytes() for s in streams)


def decode_segment(data: bytes, blocks: slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths and the ids of the chosen blocks; checks every CRC-32."""
    magic, n_symbols, n_blocks, n_docs, n_packed, crc_head = _HEAD.unpack_from(data)
    packed = data[_HEAD.size : _HEAD.size + n_packed]
    if magic != MAGIC or zlib.crc32(packed) != crc_head:
        raise ValueError("not a token segment, or a damaged one")
    head, at = zlib.decompress(packed), 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(head, kind, n, at)
        at += out.nbytes
        return out

    symbols, freq, doc_ids, lengths = take("<u4", n_symbols), take("<u4", n_symbols), take("<i8", n_docs), take("<u4", n_docs)
    n_words, held, crc = take("<u4", n_blocks), take("<u4", n_blocks), take("<u4", n_blocks)
    state = take("<u8", n_blocks * LANES).reshape(n_blocks, LANES)[blocks].astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(n_words.astype(np.int64))])[:-1][blocks]
    body = np.append(np.frombuffer(data, "<u4", int(n_words.sum(dtype=np.int64)), _HEAD.size + n_packed), np.uint32(0)).astype(np.uint64)
    begin = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    slot = np.repeat(np.arange(n_symbols, dtype=np.int32), freq)
    f_all, mask, bits, shift = freq.astype(np.uint64), np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
    out = np.zeros((len(state), STEPS, LANES), np.int32)
    pointer = first.astype(np.int64)[:, None]
    for t in range(STEPS):
        low = state & mask
        x = slot[low]
        out[:, t] = x
        state = f_all[x] * (state >> bits) + low - begin[x]
        more = state < _LOW
        rank = np.cumsum(more, axis=1)
        word = body[np.minimum(pointer + rank - 1, len(body) - 1) * more]
        state = np.where(more, (state << shift) | word, state)
        pointer = pointer + rank[:, -1:]
    if (state != _LOW).any():  # where every coder began
        raise ValueError("a block's words are damaged")
    ids = symbols[out].reshape(len(state), STEPS * LANES)
    runs = [row[:n] for row, n in zip(ids, held[blocks], strict=True)]
    for run, want in zip(runs, crc[blocks], strict=True):
        if zlib.crc32(np.ascontiguousarray(run, "<u4")) != want:
            raise ValueError("a block's ids don't match their checksum")
    return doc_ids, lengths, np.concatenate(runs) if runs else np.zeros(0, "<u4")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts under ``path`` (a shared folder) in ascending id order; returns the manifest.

    One range partitioning by id; then each task tokenises, codes and writes one file. A file gets its final name
    only when whole, and a task that runs again writes the same bytes under the same name. The manifest has a row a
    segment: ``file, part, segment, offset, size, n_docs, n_tokens, first_token``, the last counted over all files.

    A null text is an empty one and still gets the end id. Rows with a null id come first; of equal ids the smaller text.
    Other columns are not read. An empty table gives no file and an empty manifest.
    """
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "file string, part int, segment int, offset long, size long, n_docs long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId()
        encode, end = library_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        files, at = store(path)
        final, draft = f"{at}/part-{part:06d}.rans", f"{at}/.draft-{part:06d}-{context.taskAttemptId()}"
        out, made, offset = None, [], 0
        doc_ids: list[int] = []
        held: list[bytes] = []
        total = 0

        def flush() -> None:
            nonlocal offset, total, out
            if out is None:
                files.create_dir(at, recursive=True)
                out = files.open_output_stream(draft)
            lengths = np.array([len(x) // 4 for x in held], "<u4")
            data = encode_segment(np.array(doc_ids, "<i8"), lengths, np.frombuffer(b"".join(held), "<u4"))
            out.write(data)
            made.append((f"{path}/part-{part:06d}.rans", part, len(made), offset, len(data), len(held), total))
            offset += len(data)
            total = 0
            doc_ids.clear()
            held.clear()

        for batch in batches:
            for piece in slices(batch, chars=TEXTS):
                ids = piece.column(0).fill_null(np.iinfo(np.int64).min).to_pylist()
                for doc_id, got in zip(ids, encode(piece.column(1).to_pylist()), strict=True):
                    doc_ids.append(doc_id)
                    held.append(got + end)
                    total += len(got) // 4 + 1
                    if total >= SEGMENT:
                        flush()
        # known words stay for the worker's next task: most of the time goes into words met for the first time
        if held:
            flush()
        if out is not None:
            out.close()
            files.move(draft, final)
            yield pa.RecordBatch.from_pandas(pd.DataFrame(made, columns=[x.split()[0] for x in schema.split(", ")]), schema=_ARROW)

    manifest = keep(rows.mapInArrow(releasing(run), schema), "rans-manifest")
    files = manifest.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    # one narrow row a file: the only window over all of them
    base = files.select("part", (F.sum("__n").over(Window.orderBy("part")) - F.col("__n")).alias("__base"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(base, "part").select(*manifest.columns, (F.col("__base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("first_token"))


_ARROW = pa.schema([("file", pa.string()), ("part", pa.int32()), ("segment", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def read(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Decodes the segments of a manifest in parallel: ``doc_id, start, n_tokens, ids_crc32, ids`` (ids: little-endian uint32; only ``with_ids``)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                files, at = store(row.file)
                with files.open_input_file(at) as f:
                    f.seek(row.offset)
                    doc_ids, lengths, ids = decode_segment(f.read(row.size))
                held, end = ids.astype("<u4").tobytes(), np.cumsum(lengths.astype(np.int64))
                start = end - lengths
                runs = [held[4 * a : 4 * b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                null = doc_ids == np.iinfo(np.int64).min
                yield pd.DataFrame(
                    {"doc_id": pd.Series(doc_ids, dtype="Int64").mask(null), "start": start + row.first_token, "n_tokens": lengths.astype(np.int64), "ids_crc32": [zlib.crc32(x) for x in runs]}
                    | ({"ids": runs} if with_ids else {})
                )

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = manifest.repartition(tasks, F.col("part"), F.col("segment"))  # a set number: segments are small rows but much work
    return spread.mapInPandas(run, schema)


def write_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Files in the shared folder, and what they hold."""
    return read(keep(write(docs, new_path(spark, "rans"), tokenizer, end_id), "rans-segments"), with_ids)
