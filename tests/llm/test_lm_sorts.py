"""Sorts of the language model: values and places as one number, and shards that hold a block's n-grams without a second order."""

import numpy as np
import pytest

from eventloom.llm import language_model as L


@pytest.mark.parametrize("bits", [8, 44, 48, 63])
def test_places_in_order(bits):
    rng = np.random.default_rng(bits)
    values = rng.integers(0, 1 << bits, 70_000, dtype=np.uint64)
    values[:2000] = values[2000:4000] ^ np.uint64(1)  # apart in the lowest bit alone, which has no room
    order = L._order(values)
    assert order.dtype == np.uint32 and (np.sort(order) == np.arange(len(values))).all()
    assert (values[order] == np.sort(values)).all()
    want, place = np.unique(values, return_inverse=True)
    got = L._distinct(values)
    assert (got[0] == want).all() and (got[1] == place).all()
    assert len(L._order(values[:0])) == 0 and L._order(values[:1]).tolist() == [0]
    assert (L._sorted_distinct(values.copy()) == want).all()
