"""A deterministic typesetter: documents of plain text become lines of words with boxes, as if set on pages and recognised.

It gives the layout operators input of any size. All values are whole numbers (the stroke is a double); pages are 1700 by 2200.
A document is set where its row is, a column function of it, so no word is shuffled or sorted.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need numpy and pyarrow, not this package
PAGE_WIDTH, PAGE_HEIGHT = 1700, 2200
ROWS = 30
WORDS = "doc_id page_index word_ord text l t w h confidence block_num par_num line_num is_bold is_italic stroke".split()
#: A set line: its words in order, which share top and height.
LINE = (
    "struct<page_index: long, block_num: long, par_num: long, line_num: long, t: long, h: long, "
    "words: array<struct<word_ord: long, text: string, l: long, r: long, confidence: long, is_bold: boolean, is_italic: boolean>>>"
)
#: What ``lines`` gives of a word, and what lines take of it that are to hold no words.
FIELDS = {"word_ord": "long", "text": "string", "l": "long", "r": "long", "confidence": "long", "is_bold": "boolean", "is_italic": "boolean"}
PLACED = ("word_ord", "text", "l", "r", "confidence")
#: Characters that are set at once, about; a longer document goes alone.
AT_ONCE = 1 << 20


def _split(texts: pa.Array, mark: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The parts of all texts, the text that each is of, and its place in it."""
    held = pc.split_pattern(texts, mark)
    of = pc.list_parent_indices(held).to_numpy()
    counts = pc.list_value_length(held).to_numpy()
    return held.flatten(), of, np.arange(len(of)) - (np.cumsum(counts) - counts)[of]


def _starts(of: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` owners' members begin, and the end."""
    return np.searchsorted(of, np.arange(n + 1))


def _set(ids: np.ndarray, texts: pa.Array, fields: tuple[str, ...] = ()) -> pa.Array:
    """Lists of ``LINE``, one for each text; none is null. With ``fields``, a line's words are an array for each of them."""
    lines, line_doc, ln = _split(texts, "\n")
    word, word_line, wo = _split(lines, " ")
    two = ids % 3 == 0
    size = pc.utf8_length(word).to_numpy().astype(np.int64)
    before = np.cumsum(size + 1) - (size + 1)
    cs = before - before[_starts(word_line, len(lines))[:-1]][word_line]
    cap = np.where(two, 44, 88)[line_doc][word_line]
    tl, cc = cs // cap, cs % cap
    # a long word that leaves its line is cut in two
    cut = (size >= 8) & (cc + size > cap)
    of, n, k = np.repeat(np.arange(len(word)), 1 + cut), len(word), int(cut.sum())
    second = np.zeros(len(of), bool)
    second[1:] = of[1:] == of[:-1]
    whole, nth = ~cut[of], np.cumsum(cut)[of] - 1
    cuts = word.filter(pa.array(cut))
    heads = pc.binary_join_element_wise(pc.utf8_slice_codeunits(cuts, 0, 4), "-", "")
    text = pa.concat_arrays([word, heads, pc.utf8_slice_codeunits(cuts, 4)]).take(pa.array(np.where(whole, of, np.where(second, n + k + nth, n + nth))))
    size = np.where(whole, size[of], np.where(second, size[of] - 4, 5))
    tl, cc, wo, line = tl[of] + second, np.where(second, 0, cc[of]), wo[of], word_line[of]
    # set lines, numbered in their document
    new = np.ones(len(of), bool)
    new[1:] = (line[1:] != line[:-1]) | (tl[1:] != tl[:-1])
    first, at = np.flatnonzero(new), np.cumsum(new) - 1
    tl, ln, doc = tl[first], ln[line[first]], line_doc[line[first]]
    g = np.arange(len(first)) - _starts(doc, len(ids))[:-1][doc]
    both = two[doc]
    columns = np.where(both, 2, 1)
    page, col, row = g // (ROWS * columns), g % (ROWS * columns) // ROWS, g % ROWS
    heading, opens = (tl == 0) & (ln % 10 == 5), (tl == 0) & (ln % 4 == 0) & (ln > 0)
    top = np.arange(len(first)) - row
    opened = np.cumsum(opens) - np.cumsum(opens)[top] + opens[top]
    indent = np.where((tl == 0) & (ln % 4 != 0) & (ln > 0), 60, 0)
    left, width = np.where(both, 150 + 740 * col, 180), np.where(both, 660, 1340)
    l = left[at] + np.minimum(15 * cc + indent[at], width[at] - 15)  # noqa: E741
    r = l + np.minimum(15 * size, (left + width)[at] - l)
    # headers, page numbers and footnotes
    last = page[_starts(doc, len(ids))[1:] - 1]
    m_doc = np.repeat(np.arange(len(ids)), last + 1)
    m_page = np.arange(len(m_doc)) - _starts(m_doc, len(ids))[:-1][m_doc]
    noted = (ids[m_doc] + m_page) % 2 == 0
    string = lambda x: pa.array(x).cast(pa.string())
    named = lambda start, x: pc.binary_join_element_wise(start, string(x), "")
    margins = [
        (m_doc, m_page, named("Libro ", ids[m_doc]), -1, 60, 20, 1),
        (m_doc[noted], m_page[noted], named("1 Nota al pie ", m_page[noted]), 900_000_000_000, 1960, 28, 600_001),
        (m_doc, m_page, string(m_page + 1), 900_000_000_001, 2110, 20, 600_002),
    ]
    sizes = [pc.utf8_length(m[2]).to_numpy().astype(np.int64) for m in margins]
    joined = lambda body, *rest: np.concatenate([body, *rest]).astype(np.int64)
    each = lambda i: [np.full(len(m[0]), m[i]) for m in margins]
    none = [np.zeros(len(m[0])) for m in margins]
    words = dict(zip(FIELDS, (
            pa.array(joined(g[at] * 100_000 + 2 * wo + second, *each(3))), pa.concat_arrays([text, *[m[2] for m in margins]]), pa.array(joined(l, *[x + 180 for x in none])), pa.array(joined(r, *[180 + 15 * s for s in sizes])),
            pa.array(joined(30 + (13 * size + 7 * wo) % 70, *[x + 95 for x in none])), pa.array(np.concatenate([size % 9 == 0, *[x > 0 for x in none]])), pa.array(np.concatenate([size % 11 == 0, *[x > 0 for x in none]])),
    )))
    ends = pa.array(np.concatenate([first, np.arange(len(of), len(words["text"]) + 1)]).astype(np.int32))
    if fields:
        held = pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, words[f]) for f in fields], list(fields))
    else:
        held = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(list(words.values()), list(words)))
    made = pa.StructArray.from_arrays(
        [
            pa.array(joined(page, *[m[1] for m in margins])), pa.array(joined(100_000 * (col + 1) + np.where(g == 0, 0, np.where(heading, 2, 1)), *each(6))), pa.array(joined(np.where(heading, ln, ln // 4), *none)),
            pa.array(joined(g, *none)), pa.array(joined(240 + 46 * row + 30 * opened, *each(4))), pa.array(joined(np.where(g == 0, 60, np.where(heading, 48, 40)), *each(5))), held,
        ],
        ["page_index", "block_num", "par_num", "line_num", "t", "h", "words"],
    )
    docs = joined(doc, *[m[0] for m in margins])
    order = np.argsort(docs, kind="stable")
    return pa.ListArray.from_arrays(pa.array(_starts(docs[order], len(ids)).astype(np.int32)), made.take(pa.array(order)))


def _lists(batches: Iterator[tuple[pa.Array, pa.Array]], fields: tuple[str, ...] = ()) -> Iterator[pa.Array]:
    for ids, texts in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
        start = 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right")))
            own, number = texts.slice(start, end - start), ids.slice(start, end - start)
            there = pc.is_valid(own)
            made = _set(number.filter(there).to_numpy(), own.filter(there), fields) if pc.any(there).as_py() else pa.array([], pa.null())
            # a document without a text has no lines
            yield made if own.null_count == 0 else made.take(pa.array(np.cumsum(there.to_numpy(zero_copy_only=False)) - 1, mask=~there.to_numpy(zero_copy_only=False)))
            start = end


def lines(docs: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id`` and the columns of ``LINE`` for every line of a page, its header, page number and footnote too. With ``fields`` (some of ``FIELDS``), ``words`` is
    a struct of an array for each of them: whole columns of numbers cross from Python and are read as they are, where an array of structs is taken apart word by word."""

    def _lists_of(batches):  # noqa: ANN001, ANN202
        return _lists(batches, fields)

    _lists_of.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    line = LINE if not fields else LINE[: LINE.index("words:")] + "words: struct<" + ", ".join(f"{f}: array<{FIELDS[f]}>" for f in fields) + ">>"
    # a deterministic function would be worked out twice: the filter that goes with ``inline`` is pushed below it, with a copy of it
    made = F.arrow_udf(_lists_of, f"array<{line}>").asNondeterministic()
    return docs.select(F.col("doc_id"), made(F.col("doc_id"), F.col("text")).alias("lines")).select("doc_id", F.inline("lines"))


def words(docs: DataFrame) -> DataFrame:
    """``WORDS`` columns for every word, header, page number and footnote."""
    c = F.col
    flat = lines(docs).select("doc_id", "page_index", "block_num", "par_num", "line_num", "t", "h", F.inline("words"))
    return flat.withColumn("w", c("r") - c("l")).withColumn("stroke", F.when(c("is_bold"), 6.0).otherwise(4.0)).select(*WORDS)
