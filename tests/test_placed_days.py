"""Days that are given once find their visit and their number without a shuffle by day."""

import datetime as dt

import __spark_entry__ as entry
from eventloom.operators import visits as V


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _visits(spark):
    t = lambda d: dt.datetime(2020, 1, d)
    rows = [(1, 5, t(1), t(3)), (1, 9, t(2), t(6)), (2, 4, t(1), None)]
    return spark.createDataFrame(rows, "subject_id long, visit_id long, visit_start timestamp, visit_end timestamp")


def test_given_days_are_shuffled_by_subject_alone(spark):
    days = [(1, 2), (1, 5), (1, 8), (1, 9), (2, 1), (2, 2), (3, 1)]
    days = spark.createDataFrame([(s, dt.date(2020, 1, d)) for s, d in days], "subject_id long, day date")
    visits = _visits(spark)
    out = V.place_days(days, visits, visits)
    assert "hashpartitioning(subject_id" in _plan(out) and ", day" not in "".join(x for x in _plan(out).split("\n") if "hashpartitioning" in x)
    got = {(r.subject_id, r.day.day): (r.visit_id, r.how) for r in out.collect()}
    assert got == {
        (1, 2): (5, "attached"), (1, 5): (9, "attached"), (1, 8): (10, "orphan"), (1, 9): (11, "orphan"),
        (2, 1): (4, "attached"), (2, 2): (5, "orphan"), (3, 1): (1, "orphan"),
    }
    twice = V.attach_days(days.union(days), visits)
    assert sorted((r.subject_id, r.day.day, r.visit_id) for r in twice.collect()) == [(1, 2, 5), (1, 5, 9), (2, 1, 4)]


def test_assigned_events_are_staged_twice(spark, monkeypatch):
    labels, stage = [], V.stage
    monkeypatch.setattr(V, "stage", lambda df, label: labels.append(label) or stage(df, label))
    for name in ("e7_assign_events", "e7_assign_every_event"):
        labels.clear()
        out = entry.queries()[name](spark, entry.ENTRY_DIR)
        assert labels == ["marked-events", "loose-days"] and "numeric_value" not in _plan(out)
