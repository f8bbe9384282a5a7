"""Secrets in texts: three fixed forms, and stretches of high entropy.

For stretches, every run of key-like characters of at least ``SHORTEST`` is a candidate, or what fixed forms and placeholder words leave of it. For each
character class a window slides over the stretches of that class; its Shannon entropy follows from counts that change by one character in
and one out a step. Windows over the class's threshold are joined into spans; a span needs a digit, as words alone are no keys. An allow-list
suppresses candidates that are identifiers of another kind, and windows that hold a placeholder word.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import id_text, releasing, slices

_ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A failing run is dropped as a whole, so only runs that are long enough are sought.
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A run of key-like characters.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "entropy")
SHORTEST = 20
#: Classes: name, characters, window, bits per character that a window must reach.
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 32, 3.1),
    ("letters-and-digits", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 20, 3.9),
    ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 24, 4.0),
)
#: Candidates that are no secrets, as whole matches.
ALLOW = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r"[0-9+/_=-]+",  # numbers, dates, rules
    r"[A-Za-z+/_=-]+",  # words, paths and rules without a digit
)
#: Words of placeholders: windows that hold one are suppressed, and what stands before and behind is looked at for itself.
PLACEHOLDERS = r"(?i)example|sample|placeholder|xxxx|0123456789|abcdefgh"
_CLOG = [0.0] + [c * math.log2(c) for c in range(1, 257)]


def entropy_spans(run: str, chars: frozenset[str], window: int, bits: float) -> list[tuple[int, int]]:
    """Joined spans of the windows of ``run`` that hold characters of the class only and whose entropy reaches ``bits``."""
    out: list[tuple[int, int]] = []
    limit = window * (math.log2(window) - bits) + 1e-9
    begin = 0
    while begin + window <= len(run):
        # a stretch of the class, if it is as long as a window
        end = begin
        while end < len(run) and run[end] in chars:
            end += 1
        if end - begin >= window:
            counts = dict.fromkeys(run[begin:end], 0)
            total = 0.0  # the sum of c * log2(c) over the window's counts
            for x in run[begin : begin + window]:
                counts[x] = c = counts[x] + 1
                total += _CLOG[c] - _CLOG[c - 1]
            at = begin
            for x, y in zip(run[begin + window : end] + " ", run[begin:end], strict=False):
                if total <= limit:
                    if out and at <= out[-1][1]:
                        out[-1] = (out[-1][0], at + window)
                    else:
                        out.append((at, at + window))
                if x == y or x == " ":
                    at += 1
                    continue
                counts[x] = c = counts[x] + 1
                total += _CLOG[c] - _CLOG[c - 1]
                counts[y] = c = counts[y] - 1
                total += _CLOG[c] - _CLOG[c + 1]
                at += 1
        begin = end + 1
    return out


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _rest(begin: int, end: int, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What ``cuts`` (in order, apart) leave of a span."""
    out = []
    for a, b in cuts:
        out.append((begin, a))
        begin = b
    return [*out, (begin, end)]


def find(text: str, allow: Sequence[re.Pattern], placeholders: re.Pattern = re.compile(PLACEHOLDERS)) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points: the fixed forms, then entropy spans of what they, and placeholder words, leave of each run."""
    base = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        base += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [("hex", *m.span()) for m in _HEX.finditer(text)]
    more: list[tuple[str, int, int]] = []
    taken, k = _joined([(s, e) for _, s, e in base]), 0
    for m in _CANDIDATE.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        own = k
        while own < len(taken) and taken[own][0] < m.end():
            own += 1
        run = m[0]
        if any(a.fullmatch(run) for a in allow):
            continue
        cuts = [(max(s, m.start()), min(e, m.end())) for s, e in taken[k:own]]
        cuts = _joined(cuts + [(m.start() + w.start(), m.start() + w.end()) for w in placeholders.finditer(run)])
        for at, end in _rest(m.start(), m.end(), cuts):
            piece = text[at:end]
            if len(piece) < SHORTEST or cuts and any(a.fullmatch(x) for a in allow for x in {piece, piece.strip("+/_=-")}):
                continue
            spans = [x for _, chars, window, bits in CLASSES for x in entropy_spans(piece, chars, window, bits)]
            more += [("entropy", at + a, at + b) for a, b in _joined(spans) if any(c.isdigit() for c in piece[a:b])]
    return base + more


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: Sequence[str] = ALLOW, placeholders: str = PLACEHOLDERS) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans, found`` of every row, in one map over the rows.

    ``spans``: kind:start:end by start, comma-joined; ``found``: the same as an array of structs with the matched text. ``base_sha256`` covers the fixed forms.
    A null text is an empty one, with no spans. Repeated rows each give a row, an empty table none. Time is in proportion to a text's length; a very long text
    stands alone in its slice, and memory grows with it. Other columns are not read.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, words = [re.compile(a) for a in allow], re.compile(placeholders)
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                got = [find(t, patterns, words) for t in texts]
                count = lambda kind: pa.array([sum(x[0] == kind for x in g) for g in got], pa.int64())  # noqa: E731,B023
                base = pa.array([hashlib.sha256(_listed([x for x in g if x[0] != "entropy"]).encode()).hexdigest() for g in got])
                found = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, a, b in g] for g, t in zip(got, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), count("assign"), count("access"), count("hex"), count("entropy"), base, pa.array([_listed(g) for g in got]), pa.array(found, pa.list_(span))],
                    ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans", "found"],
                )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string, found array<struct<kind: string, start: long, end: long, value: string>>"
    return id_text(docs, id_col, text_col).mapInArrow(releasing(run), schema)
