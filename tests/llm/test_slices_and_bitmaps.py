"""Slices by bytes, parity bitmaps and scores of long texts, without a session."""

import numpy as np
import pyarrow as pa
import pytest

from ruleforge.llm import kneser_ney
from ruleforge.llm.common import slices
from ruleforge.llm.jaccard_join import parity, parity_difference


@pytest.mark.parametrize("size_a, size_b, shared", [(0, 1, 0), (1, 1, 1), (64, 65, 60), (129, 120, 120), (700, 800, 500), (5000, 9000, 4000)])
def test_bitmaps_never_differ_more_than_the_sets(size_a, size_b, shared):
    values = np.unique(np.random.default_rng(size_a + size_b).integers(-2**63, 2**63 - 1, 4 * (size_a + size_b)))
    np.random.default_rng(1).shuffle(values)
    a, b = np.sort(values[:size_a]), np.sort(values[size_a - shared:size_a - shared + size_b])
    apart = len(np.setxor1d(a, b))
    assert 0 <= parity_difference(parity(a), parity(b)) <= apart
    assert parity_difference(parity(a), parity(a)) == 0
    assert parity_difference(parity(a), parity(b)) == parity_difference(parity(b), parity(a))


def test_slices_hold_every_row_once_in_order():
    texts = ["a" * 10, None, "", "b" * 500, "c" * 90, "d" * 20, "é" * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["k", "t"])
    parts = list(slices(batch, rows=3, size=100))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert all(p.num_rows <= 3 for p in parts)
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 100 for p in parts)
    assert list(slices(batch.slice(0, 0))) == []


def test_scores_do_not_depend_on_parts(monkeypatch):
    texts = ["", "x", "some words of a text " * 40, "ü\0" * 30]
    value_of = lambda grams: -np.log((grams % 251).astype(float) + 2)
    whole = kneser_ney.text_scores(texts, value_of)
    monkeypatch.setattr(kneser_ney, "CHUNK", 7)
    parts = kneser_ney.text_scores(texts, value_of)
    assert np.array_equal(whole[1], parts[1])
    assert np.allclose(whole[0], parts[0], equal_nan=True) and np.isnan(whole[0][0])
