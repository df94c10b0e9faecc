"""Hard negatives against a plain sort of all scores, and packed products against plain ones."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from check import canonical
from eventloom.llm import hard_negatives as hn
from eventloom.llm.registry import registered

from ..conftest import DATA

SCHEMA = "vec_id long, embedding array<float>, label int, score string, row string, anchor string, band int, id int"


def brute(rows):
    """The contract in plain loops; ``rows``: (vec_id, vector, label) with distinct ids."""
    use = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        use.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    last = lambda i: (i is None, i or 0)
    out = []
    for a, av, al in use:
        if a is None or a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(av, v)), i, label) for i, v, label in use if i != a]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for s, p, label in [x for x in scored if x[2] == al][:5]:
            band = [x for x in scored if x[2] != al and 80 * s <= 100 * x[0] <= 100 * s][:5]
            out += [(a, p, k + 1, i, s, t) for k, (t, i, _) in enumerate(band)]
    return sorted(out, key=str)


def run(spark, monkeypatch, rows, **options):
    for name, value in options.items():
        monkeypatch.setattr(hn, name, value)
    df = spark.createDataFrame([(*r, "x", "y", "z", 1, 2) for r in rows], SCHEMA)
    monkeypatch.setattr(hn, "read", lambda *_: df)
    return sorted((tuple(r) for r in hn.op11_hard_negatives(spark, DATA).collect()), key=str)


def test_hard_negatives_match_sql(spark, duck):
    query, sql = registered()["op11_hard_negatives"]
    got, want = query(spark, DATA).toPandas(), duck.sql(sql).df()
    assert len(got) > 50 and canonical(got) == canonical(want)


def test_hard_negatives_awkward_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8) + 0.3], int(rng.integers(0, 3))) for i in range(1, 450)]
    same = [0.5] * 8
    rows += [(1000 + i, same, i % 2) for i in range(120)]  # ties, among them an anchor
    rows += [(None, same, 1), (2001, None, 1), (2002, [0.1, None], 1), (2003, [float("nan")] * 8, 1), (2004, [float("inf")] * 8, 1)]
    rows += [(2005, same, None), (2006, [], 1), (2007, [0.4] * 3, 1), (2008, [0.4] * 12, 0), (2100, [0.4] * 3, 1), (2200, [], 0), (2300, [-0.5] * 8, 2)]
    want = brute(rows)
    assert len(want) > 100
    assert run(spark, monkeypatch, rows + rows[:50] + [rows[449]] * 3) == want  # equal rows count once
    assert run(spark, monkeypatch, rows[::-1], ANCHORS_AT_ONCE=2, ROWS_AT_ONCE=16) == want


def test_huge_components(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x * 1e12)) for x in rng.normal(0.4, 0.2, 4)], int(rng.integers(0, 2))) for i in range(90, 210)]
    want = [r for r in brute(rows) if max(abs(r[4]), abs(r[5])) < 2**63]
    assert run(spark, monkeypatch, [(i, [x / 1e6 for x in v], n) for i, v, n in rows]) == brute([(i, [x / 1e6 for x in v], n) for i, v, n in rows])
    got = run(spark, monkeypatch, rows)
    assert all(abs(r[4]) <= 2**63 - 1 for r in got) and len(got) >= len(want)


@pytest.mark.parametrize("rows", [[], [(100, [0.5], 1)], [(1, [0.5], 1), (2, [0.5], 2)], [(100, None, 1)]])
def test_no_negatives(spark, monkeypatch, rows):
    assert run(spark, monkeypatch, rows) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 40), st.integers(0, 12), st.sampled_from([1, 200, 10**5, 10**9, 2**45]), st.integers(0, 2**32))
def test_packed_products(anchors, rows, dims, reach, seed):
    rng = np.random.default_rng(seed)
    a, r = rng.integers(-reach, reach + 1, (anchors, dims)), rng.integers(-reach, reach + 1, (rows, dims))
    exact = [[min(max(sum(int(x) * int(y) for x, y in zip(u, v)), hn.LEAST), hn.MOST) for v in r] for u in a]
    assert hn.packed_products(a, r).tolist() == exact


def test_several_candidates_share_a_product():
    rng = np.random.default_rng(1)
    a, r = rng.integers(-128, 128, (7, 64)), rng.integers(-128, 128, (33, 64))
    bits = (int((a - a.min()).sum(1).max()) * int((r - r.min()).max())).bit_length()
    assert hn.EXACT_BITS // bits >= 2
    assert (hn.packed_products(a, r) == a @ r.T).all()
