"""Outpatient events are sorted with their columns once, and with those that are used."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from eventloom.operators import sequence as S


def test_outpatient_events_are_sorted_with_their_columns_once(spark):
    out = entry.queries()["q10_dedup_outpatient"](spark, entry.ENTRY_DIR)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min(__copy" in plan and "value_mask" not in plan and "l_returnflag" not in plan
    at = F.lit("2020-01-01").cast("timestamp")
    events = spark.range(6).select(
        F.lit(1).alias("person_id"), F.lit(1).alias("visit_id"), F.lit("t").alias("token"), F.lit(1.0).alias("value"), F.when(F.col("id") < 4, at).alias("time"),
        F.lit("c").alias("code"), "id", F.col("id").alias("event_id"), F.lit(None).cast("boolean").alias("is_stay"),
    )
    assert sorted(r.event_id for r in S.dedup_outpatient(events).collect()) == [0, 4, 5]
