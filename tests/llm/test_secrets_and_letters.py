"""Entropy spans of whole queries, what the allow-list lets through, very long texts; and what counts as a letter."""

import base64
import math
import random
import re
import string
import time
from collections import Counter

import numpy as np

from quire.llm import language_id, secret_scan

KEYS = {
    "base64": lambda r: base64.b64encode(r.randbytes(30)).decode(),
    "alnum": lambda r: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(32)),
    "upper hex": lambda r: r.randbytes(24).hex().upper(),
    "url-safe": lambda r: base64.urlsafe_b64encode(r.randbytes(33)).decode(),
}
NAMES = {
    "camel": lambda r: "".join(r.choice(["get", "User", "Account", "Index", "By", "Name", "Or", "2", "Total", "List"]) for _ in range(8)),
    "path": lambda r: "/".join(r.choice(["usr", "share", "data", "v2", "index", "part", "tables", "log"]) for _ in range(7)),
    "snake": lambda r: "_".join(r.choice(["max", "row", "count", "table", "1", "limit", "of", "page"]) for _ in range(8)),
    "uuid": lambda r: "-".join(r.randbytes(n).hex() for n in (4, 2, 2, 2, 6)),
    "number": lambda r: "".join(r.choice("0123456789-") for _ in range(30)),
    "word": lambda r: "".join(r.choice(string.ascii_lowercase) for _ in range(28)),
}


def _texts(seed=4, n=60):
    r = random.Random(seed)
    made = [(kind, True, f(r)) for kind, f in KEYS.items() for _ in range(n)] + [(kind, False, f(r)) for kind, f in NAMES.items() for _ in range(n)]
    return [(kind, secret, f"a line with {x} in it") for kind, secret, x in made]


def _brute(text):
    """Spans of the entropy kind: every window by itself."""
    base = [m.span() for m in re.finditer(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    base += [m.span() for p, n in ((r"AKIA[A-Z0-9]+", 20), (r"[0-9a-f]+", 24)) for m in re.finditer(p, text) if len(m[0]) >= n]
    hidden = {i for a, b in base for i in range(a, b)}
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        if any(re.fullmatch(a, m[0]) for a in secret_scan.ALLOW):
            continue
        gone = hidden | {i for w in re.finditer(secret_scan.PLACEHOLDERS, m[0]) for i in range(m.start() + w.start(), m.start() + w.end())}
        held = "".join("\0" if i in gone else text[i] for i in range(*m.span()))
        for piece in re.finditer("[^\0]{20,}", held):
            if "\0" in held and any(re.fullmatch(a, x) for a in secret_scan.ALLOW for x in (piece[0], piece[0].strip("+/_=-"))):
                continue
            covered = set()
            for _, chars, window, bits in secret_scan.CLASSES:
                for i in range(len(piece[0]) - window + 1):
                    w = piece[0][i : i + window]
                    if set(w) <= chars and -sum(c / window * math.log2(c / window) for c in Counter(w).values()) >= bits - 1e-9:
                        covered |= set(range(i, i + window))
            at = m.start() + piece.start()
            runs = "".join("x" if i in covered else " " for i in range(len(piece[0])))
            out += [("entropy", at + x.start(), at + x.end()) for x in re.finditer("x+", runs) if any(c.isdigit() for c in piece[0][x.start() : x.end()])]
    return out


def test_entropy_spans_of_whole_queries(spark):
    r = random.Random(9)
    texts = [t for _, _, t in _texts()] + [None, "", "Same " + KEYS["alnum"](r)] * 2
    texts += ["".join(r.choice(["Zx9kQ2mT7vB4nL8p", "/", "=", "example", "xxxx", "deadbeef01", " ", "token=", "R1sW6yC3", "+", "_"]) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, found string, n_entropy int")
    got = {x.doc_id: x for x in secret_scan.scan(df).collect()}
    seen = 0
    for i, t in enumerate(texts):
        want = _brute(t or "")
        assert [tuple(s.split(":")) for s in got[i].spans.split(",") if s.startswith("entropy")] == [(k, str(a), str(b)) for k, a, b in want], t
        seen += len(want)
    assert seen > 200 and secret_scan.scan(df.filter("doc_id < 0")).collect() == []


def test_entropy_precision_and_recall():
    allow = [re.compile(a) for a in secret_scan.ALLOW]
    found = Counter()
    for kind, secret, t in _texts(seed=11, n=200):
        found[kind, secret] += any(k == "entropy" for k, _, _ in secret_scan.find(t, allow))
    recall = sum(n for (_, s), n in found.items() if s) / (200 * len(KEYS))
    wrong = sum(n for (_, s), n in found.items() if not s)
    assert recall >= 0.97 and wrong / (wrong + recall * 200 * len(KEYS)) <= 0.05, found


def test_placeholders_hide_windows_only():
    allow = [re.compile(a) for a in secret_scan.ALLOW]
    key = "Zx9kQ2mT7vB4nL8pR1sW6yC3"
    for t, at in ((key + "/example", 0), ("sample_" + key, 7), (key + "xxxx", 0)):
        assert any(k == "entropy" and a <= at and b >= at + len(key) for k, a, b in secret_scan.find(t, allow)), t
    assert secret_scan.find("example_key_0123456789abcdefghsample", allow) == []
    dump = base64.b64encode(random.Random(1).randbytes(150_000)).decode()
    for i in range(0, 200_000, 20_000):
        dump = dump[:i] + "xxxx" + dump[i + 4 :]
    covered = sum(b - a for k, a, b in secret_scan.find(dump, allow) if k == "entropy")
    assert covered > 0.95 * len(dump)


def test_long_key_dumps_take_time_in_proportion():
    allow = [re.compile(a) for a in secret_scan.ALLOW]
    r = random.Random(7)
    line = lambda: r.choice(["token=" + KEYS["alnum"](r), KEYS["base64"](r), r.randbytes(16).hex(), "AKIA" + "A1" * 10])
    text = "\n".join(line() for _ in range(50_000))
    took = []
    for part in (text[: len(text) // 4], text):
        begun = time.process_time()
        assert len(secret_scan.find(part, allow)) > len(part) // 60
        took.append(time.process_time() - begun)
    assert took[1] < 8 * took[0] + 1 and took[1] < 8, took  # quadratic: sixteen times


def test_letters_are_those_of_unicode(spark):
    texts = ["²½ ①", "①②", "", None, "١٢", "_", "das ist der Text und die Sprache", "ª", "日本"]
    rows = [(i, "the of and to in is " * 5 if i % 2 else "der die das und ist ein " * 5, "en" if i % 2 else "de") for i in range(100, 160)]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + rows + [(6, texts[6], None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert [got[i].lang_pred == "und" for i in range(9)] == [True] * 6 + [False] * 3 and got[6].lang_pred == "de"
    assert all(got[i].score == 0 for i in range(6)) and np.mean([got[i].lang_pred == lang for i, _, lang in rows]) == 1
    long = spark.createDataFrame([(1, "das ist der Text und die Sprache " * 30_000, None)], df.schema)
    assert [r.lang_pred for r in language_id.identify(df.union(long)).filter("doc_id = 1 and length(lang_pred) > 0").collect()].count("de") == 1
    assert language_id.accepted(df.filter("doc_id < 0")).collect() == [] and {r.doc_id for r in language_id.accepted(df).collect()} >= {6, 100}
