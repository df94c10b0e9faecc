"""Containment with take-overs: folded in stretches it is what one pass over all blocks gives."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.operators import visits as V

DAY0 = datetime(2020, 1, 1)
COLUMNS = ["subject_id", "visit_id", "visit_type", "visit_start", "visit_end", "has_ed", "has_admission"]


def one_pass(rows):
    """visit → (container, merged type, dropped type), with the list of open places as the state."""
    out = {}
    for subject in {r[0] for r in rows}:
        places = []
        for _, visit, kind, start, end, ed, adm in sorted((r for r in rows if r[0] == subject), key=lambda r: (r[3], r[1])):
            place = next((p for p in places if p["end"] >= end and p["end"] >= start), None)
            if place is None:
                places.append({"end": end, "holder": visit, "urgent": ed or adm, "adm": adm, "kind": kind, "members": [(visit, None)]})
                continue
            lost, lost_kind, lost_ed = visit, kind, ed
            if (ed or adm) and not place["urgent"]:
                lost, lost_kind, lost_ed = place["holder"], place["kind"], False
                place.update(end=end, holder=visit, urgent=True, adm=adm, kind=kind)
                place["members"] = [(v, d) for v, d in place["members"] if v != lost] + [(visit, None)]
            place["members"].append((lost, lost_kind))
            if place["adm"] and lost_ed:
                place["kind"] = V.ED_TO_INPATIENT_TYPE
        for p in places:
            out.update({(subject, v): (p["holder"], p["kind"], d) for v, d in p["members"]})
    return out


def random_blocks(seed, subjects, n, span, longest, urgent=0.2):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(subjects):
        for v in range(n):
            start = int(rng.integers(0, span))
            ed, adm = bool(rng.random() < urgent), bool(rng.random() < urgent / 2)
            kind = "IP" if adm else "ED" if ed else f"OP{v % 3}"
            rows.append((s, v + 1, kind, DAY0 + timedelta(hours=start), DAY0 + timedelta(hours=start + int(rng.integers(0, longest))), ed, adm))
    return rows


def merged(spark, rows, stretch=None):
    got = V.merge_contained_swapping(spark.createDataFrame(pd.DataFrame(rows, columns=COLUMNS)), stretch).collect()
    out = {(r.subject_id, r.visit_id): (r.container_id, r.merged_type, r.dropped_type) for r in got}
    assert len(got) == len(out) == len(rows)
    return out


@pytest.mark.parametrize("stretch", [None, 1, 7, 40])
def test_stretches_give_the_result_of_one_pass(spark, stretch):
    rows = random_blocks(1, 5, 60, 300, 90) + [(9, 1, "OP0", DAY0, DAY0, False, False)]
    assert merged(spark, rows, stretch) == one_pass(rows)


def test_a_start_that_is_never_forgotten(spark):
    # one stay spans all others, and each later ED visit takes over one of the outpatient places in it
    hour = timedelta(hours=1)
    rows = [(1, k + 1, "OP", DAY0 + k * hour, DAY0 + (5000 + 10 * k) * hour, False, False) for k in range(20)]
    rows += [(1, 100 + k, "ED", DAY0 + (100 + k) * hour, DAY0 + (200 + 13 * k) * hour, True, k % 3 == 0) for k in range(60)]
    assert merged(spark, rows, 10) == one_pass(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 25), st.booleans()), max_size=40), st.integers(1, 12))
def test_fold_of_batches(blocks, cut):
    blocks = sorted((s, s + n, u) for s, n, u in blocks)
    rows = [(0, i, "k", s, e, u, False) for i, (s, e, u) in enumerate(blocks)]
    want = one_pass(rows)
    opened, holder, places = {}, {}, V._NO_PLACES
    for at in range(0, len(rows), cut):
        part = rows[at : at + cut]
        ends, urgent, ids = np.array([r[4] for r in part]), np.array([r[5] for r in part]), np.array([r[1] for r in part])
        opener, role, after = V._fold_blocks(np.zeros(len(part), np.int64), ends, urgent, ids, places)
        still = after[1] >= part[-1][3]
        places = tuple(c[still] for c in after[1:])
        for i, o, r in zip(ids.tolist(), opener.tolist(), role.tolist()):
            opened[i] = o
            if r:
                holder[o] = i
    assert {(0, i): holder[o] for i, o in opened.items()} == {k: v[0] for k, v in want.items()}


def test_a_subject_with_two_million_overlapping_blocks(spark):
    n = 2_000_000
    start = F.timestamp_micros(F.col("id") * 1_000_000)
    draw = F.pmod(F.xxhash64("id"), F.lit(100_000))
    blocks = spark.range(n).select(
        F.lit(1).cast("long").alias("subject_id"),
        F.col("id").alias("visit_id"),
        F.lit("V").alias("visit_type"),
        start.alias("visit_start"),
        F.timestamp_micros(F.col("id") * 1_000_000 + draw * 1_000_000).alias("visit_end"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10)) == 0).alias("has_ed"),
        F.lit(False).alias("has_admission"),
    )
    got = V.merge_contained_swapping(blocks, 250_000).select("visit_id", "container_id").toPandas().sort_values("visit_id")
    given_blocks = blocks.select("visit_id", "visit_end", "has_ed").toPandas().sort_values("visit_id")
    ends = given_blocks["visit_end"].astype("int64").to_numpy()
    opener, role, _ = V._fold_blocks(np.zeros(n, np.int64), ends, given_blocks["has_ed"].to_numpy(), np.arange(n), V._NO_PLACES)
    holder = np.zeros(n, np.int64)
    for r in (1, 2):
        holder[opener[role == r]] = np.flatnonzero(role == r)
    assert (got["container_id"].to_numpy() == holder[opener]).all() and (role == 2).sum() > 100
