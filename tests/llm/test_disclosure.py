"""What the terms' spans of ``pii`` rest on, worked out by brute force; many spans in one text."""

import math
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import pii

MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def _told(texts):
    """Terms and kinds; every text is a document of its own."""
    n, terms, entities = len(texts), {}, {}
    for i, t in enumerate(texts):
        mails = {m[0].lower() for m in re.finditer(MAIL, t)}
        terms[i] = {w.lower() for w in re.findall(r"[^\W\d_]{4,}", re.sub(MAIL, " ", t))}
        entities[i] = {f"email:{m}" for m in mails} | ({"email"} if mails else set())
    docs_of = defaultdict(set)
    beside = defaultdict(set)
    for i in range(n):
        for w in terms[i]:
            docs_of[w].add(i)
            if entities[i]:
                beside[w].add(i)
    with_entity = defaultdict(set)
    for i, own in entities.items():
        for e in own:
            with_entity[e].add(i)
    real = {e: d for e, d in with_entity.items() if len(d) >= pii.SUPPORT}
    words = {w for w, d in beside.items() if len(d) >= pii.SUPPORT}
    need, best = math.log(max(1, len(real) * len(words)) / pii.CHANCE), {}
    for e, d in real.items():
        ic = -math.log2(len(d) / n)
        for w in words:
            k, chance = len(d & docs_of[w]), len(d) * len(docs_of[w]) / n
            if k >= pii.SUPPORT and ic > 0 and k > chance and k * math.log(k / chance) - k + chance >= need:
                best[w] = max(best.get(w, 0), math.log2(k * n / (len(d) * len(docs_of[w]))) / ic)
    return {w: "removed" if x >= pii.REMOVE else "general" for w, x in best.items() if x >= pii.GENERALISE}


@pytest.mark.parametrize("seed", [1, 2])
def test_terms_are_those_that_brute_force_tells(spark, seed):
    r = random.Random(seed)
    common = ["".join(r.choice("abcdefghijkl") for _ in range(5)) for _ in range(300)]
    people = [(f"p{i}@corp.example", [f"secretword{c}" for c in "abc"[: 1 + i % 3]], 3 + i % 9) for i in range(12)]
    people = [(m, [w + "xyzuvrst"[i % 8] * (1 + i // 8) for w in ws], n) for i, (m, ws, n) in enumerate(people)]
    texts = []
    for mail, words, n in people:
        for _ in range(n):
            own = [*r.sample(common, 25), mail, *(w for w in words if r.random() < 0.9)]
            r.shuffle(own)
            texts.append(" ".join(own))
        texts += [" ".join([*r.sample(common, 20), words[0]]) for _ in range(r.randrange(3))]
    texts += [" ".join(r.sample(common, 30)) for _ in range(400)]
    texts += [f"user{i}@other.example " + " ".join(r.sample(common, 20)) for i in range(60)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, entity string, copy int")
    got = {s.value: s.kind for x in pii.detect(df).collect() for s in x.found if s.kind in ("general", "removed")}
    want = _told(texts)
    assert got == want and len(want) >= 8 and len(set(want.values())) == 2


def test_three_chance_meetings_are_no_evidence(spark):
    r = random.Random(3)
    common = ["".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(4000)]
    texts = [" ".join([*r.sample(common, 40), f"user{i}@other.example"]) for i in range(300)] + [" ".join(r.sample(common, 40)) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(s.kind == "email" for x in pii.detect(df).collect() for s in x.found)


def test_many_spans_in_one_text(spark):
    def made(n):
        text = " ".join(f"user{i}@corp{i}.example and 10.0.{i % 256}.{i % 199}" for i in range(n))
        return spark.createDataFrame([(1, text)], "doc_id long, text string"), text

    took = []
    for n in (4000, 16_000):
        df, text = made(n)
        begun = time.perf_counter()
        got = df.select(pii.base_spans(F.col("text")).alias("s")).first().s
        took.append(time.perf_counter() - begun)
        assert len(got) == 2 * n and all(text[s.start : s.end] == s.value for s in got) and got[-1].end == len(text)
    assert took[1] < 8 * took[0] + 2, took
    df, text = made(3000)
    assert df.select(pii.without_addresses(F.col("text")).alias("t")).first().t == re.sub(MAIL, lambda m: " " * len(m[0]), text)
    clean = pii.sanitise(df).first().text
    assert clean == " ".join("[EMAIL] and [IP]" for _ in range(3000))
    assert pii.sanitise(df.filter("doc_id < 0")).collect() == []
