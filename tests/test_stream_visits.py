"""Visits on streams: the whole log at once, event by event, out of order, and late."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.session import new_folder
from eventloom.streaming import visits as X

GAP, DELAY, GRACE = 12 * 3600, 3600, 86_400
US = 1_000_000
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def batch_visits(events):
    out = []
    for subject in sorted({s for s, _ in events}):
        times = sorted(t for s, t in events if s == subject)
        start, last, n = times[0], times[0], 0
        for t in times:
            if t - last >= GAP:
                out.append((subject, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((subject, start, last, n))
    return out


def run(spark, batches, **options):
    """Visits (subject, start, last, events) by what was told in time and late; each list of events is a batch of the stream."""
    folder = new_folder(spark, "visit-events")
    for b in [[], *batches]:
        df = spark.createDataFrame([(s, T0 + timedelta(seconds=t)) for s, t in b], "subject_id long, time timestamp").coalesce(1)
        df.write.mode("append").parquet(folder)
    files = spark.read.parquet(folder).inputFiles()
    stream = spark.readStream.schema("subject_id long, time timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    table, left = X.run_closed(stream, lambda s: X.visits_stream(s, GAP, DELAY, options.get("grace", GRACE)), "visits")
    second = lambda c: (F.unix_seconds(c) - int(T0.timestamp())).alias(c)
    rows = table.select("subject_id", second("start"), (second("end") - GAP).alias("last"), "n_events", "late").collect()
    assert left == 0 and files
    told = sorted((r.subject_id, r.start, r.last, r.n_events) for r in rows if not r.late)
    late = {}
    for r in rows:
        if r.late:
            late[r.subject_id, r.start] = late.get((r.subject_id, r.start), 0) + r.n_events
    return told, late


def test_whole_log(spark):
    rng = np.random.default_rng(1)
    events = [(int(s), int(t)) for s, t in zip(rng.integers(0, 6, 300), rng.integers(0, 90 * 86_400, 300))]
    told, late = run(spark, [events])
    assert told == batch_visits(events) and not late


def test_batches_in_order_and_late_events(spark):
    day = 86_400
    batches = [
        [(1, 0), (1, 3600), (2, 0), (None, 5)],
        [(1, 2 * day), (2, 1800)],  # 2's second event is not late yet
        [(1, 3 * day)],
        [(2, 3 * day), (1, 3 * day - 2 * 3600)],
        [(1, 2 * day + 60), (1, 2 * day + 10 * 3600)],  # both fall into a visit that was told: two late events
        [(1, 30 * day)],
        [(1, 10)],  # dropped: further behind than delay and grace
    ]
    told, late = run(spark, batches)
    assert late == {(1, 2 * day): 2}
    assert told == [
        (1, 0, 3600, 2), (1, 2 * day, 2 * day, 1), (1, 3 * day - 7200, 3 * day, 2), (1, 30 * day, 30 * day, 1), (2, 0, 1800, 2), (2, 3 * day, 3 * day, 1),
    ]


def test_no_events(spark):
    assert run(spark, [[]]) == ([], {})


events = st.lists(st.tuples(st.integers(0, 40), st.integers(0, 3)), min_size=1, max_size=30)


@settings(max_examples=200, deadline=None)
@given(events, st.integers(1, 8), st.integers(0, 30))
def test_state_of_a_subject(steps, size, grace):
    """Times that fall back by less than the delay, cut into batches: every visit is told once, as in one pass, and nothing stays."""
    gap, delay, now, times = 10, 5, 0, []
    for forward, back in steps:
        now += forward
        times.append(now - min(back, delay - 1))
    state, told, watermark = X.VisitState(gap, grace), [], -(10**9)
    for i in range(0, len(times), size):
        assert not state.take(np.array(times[i : i + size]))
        watermark = max(times[: i + size]) - delay - grace
        told += state.tell(watermark)
    told += state.tell(10**9)
    assert state.next_time() is None and all(len(c) == 0 for c in state.held())
    want, order = [], sorted(times)
    start = last = order[0]
    n = 0
    for t in order:
        if t - last >= gap:
            want.append((start, last, n))
            start, n = t, 0
        last, n = t, n + 1
    assert sorted(told) == [*want, (start, last, n)]


@pytest.mark.parametrize("runs, want", [([(0, 5), (14, 14), (30, 31)], [(0, 14, 2), (30, 31, 1)]), ([(0, 50), (3, 4), (59, 60)], [(0, 60, 3)])])
def test_merge_runs(runs, want):
    starts, lasts = (np.array(c) for c in zip(*runs))
    got = X.merge_runs(starts, lasts, np.ones(len(runs), np.int64), 10)
    assert list(zip(*(c.tolist() for c in got))) == want
