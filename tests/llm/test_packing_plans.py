"""Plans of whole histograms: nothing lost, and hardly a sequence more than the ids need."""

import numpy as np
import pyarrow.dataset as ds
import pytest

from quire.llm import packing
from quire.llm.token_cache import library_encoder, tokenizer_path


def _lengths(capacity):
    texts = ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table(columns=["text"])["text"].fill_null("").to_pylist()
    n = np.array([len(x) // 4 + 1 for x in library_encoder(tokenizer_path("byte_bpe_50k.json"))(texts)])
    return np.bincount(np.concatenate([np.full((n // capacity).sum(), capacity), (n % capacity)[n % capacity > 0]]), minlength=capacity + 1), n.sum()


def _checked(histogram, capacity):
    made, left = packing.plan(histogram, capacity), histogram.copy()
    for pattern, n in made:
        assert 0 < sum(pattern) <= capacity and n > 0
        for v in pattern:
            left[v] -= n
    assert not left[1:].any()
    return sum(n for _, n in made)


@pytest.mark.parametrize("capacity", [1024, 4096])
def test_real_lengths(capacity):
    histogram, total = _lengths(capacity)
    assert _checked(histogram, capacity) <= 1.005 * -(-total // capacity) + 1


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 1024, 2000])
def test_odd_histograms(capacity):
    rng = np.random.default_rng(capacity)
    assert packing.plan(np.zeros(capacity + 1, int), capacity) == []
    one = np.bincount([capacity // 2 + 1] * 9, minlength=capacity + 1)
    assert _checked(one, capacity) == 9
    assert _checked(np.bincount([1] * 50, minlength=capacity + 1), capacity) == -(-50 // capacity)
    many = np.bincount(rng.integers(1, max(2, capacity // 3), 5000), minlength=capacity + 1)
    assert _checked(many, capacity) <= 1.02 * -(-(many * np.arange(capacity + 1)).sum() // capacity) + 2


def test_every_pattern_of_three_is_priced():
    rng = np.random.default_rng(0)
    lengths, price = np.flatnonzero(rng.random(121) < 0.6), rng.normal(0, 1, 121)
    lengths = lengths[lengths > 0]
    got = {tuple(r) for r in packing.priced(lengths, 120, price).tolist()}
    there = set(lengths.tolist())
    want = {(a, b, 120 - a - b) for a in there for b in there if a <= b <= 120 - a - b and 120 - a - b in there and price[a] + price[b] + price[120 - a - b] < 0}
    assert got == want
    few = packing.priced(lengths, 120, price, 5)
    assert sorted(price[few].sum(1)) == pytest.approx(sorted(price[list(r)].sum() for r in want)[:5])
