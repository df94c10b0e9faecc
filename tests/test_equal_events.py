"""Events that are all kept come back as often as they were; copies of outpatient visits once."""

import datetime as dt

from pyspark.sql import functions as F

from eventloom.operators import sequence as S


def test_equal_events_of_stays_come_back_as_often(spark, monkeypatch):
    monkeypatch.setattr(S, "COPIES_AT_ONCE", 3)
    at = dt.datetime(2020, 1, 1)
    rows = [(1, 1, "a", 1.0, at, "a", 5, "u", True)] * 8 + [(1, 2, "a", 1.0, at, "a", 5, "u", False)] * 4
    rows += [(1, 2, "a", 1.0, None, "a", 5, "u", False)] * 2 + [(1, 1, "a", 1.0, at, "a", 6, "u", True), (1, 3, "a", 1.0, at, "a", 5, "u", None)] * 2
    events = spark.createDataFrame(
        rows, "person_id long, visit_id long, token string, value double, time timestamp, code string, event_id long, unit string, is_stay boolean"
    )
    out = S.dedup_outpatient(events)
    got = {(r.visit_id, r.event_id, r.timed): r.n for r in out.groupBy("visit_id", "event_id", F.col("time").isNotNull().alias("timed")).agg(F.count("*").alias("n")).collect()}
    assert got == {(1, 5, True): 8, (1, 6, True): 2, (2, 5, True): 1, (2, 5, False): 2, (3, 5, True): 1}


def test_events_together_by_visit_are_not_moved_again(spark):
    columns = [F.col("id").alias("visit_id"), F.lit("t").alias("token"), F.lit(1.0).alias("value"), F.current_timestamp().alias("time"),
               F.lit("c").alias("code"), F.col("id").alias("event_id"), (F.col("id") % 2 == 0).alias("is_stay")]
    events = spark.range(1000).select((F.col("id") % 9).alias("person_id"), *columns).repartition(*S.VISIT_KEY)
    plan = S.dedup_outpatient(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
