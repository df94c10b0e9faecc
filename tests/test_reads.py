"""Tables are shuffled on reading only where too few tasks could read them; domain tables are read once."""

import duckdb
import pytest
from pyspark.sql import functions as F

from eventloom.operators import domains as D
from eventloom.sources import io


@pytest.mark.parametrize(("rows", "spread"), [(20_480, False), (400_000, True)])
def test_files_of_many_row_groups_are_not_dealt_out(spark, tmp_path, rows, spread):
    path = f"{tmp_path}/t.parquet"
    query = "SELECT i, hash(i) AS h FROM range(400000) r(i)"
    duckdb.sql("SET threads = 1")
    duckdb.sql(f"COPY ({query}) TO '{path}' (FORMAT parquet, ROW_GROUP_SIZE {rows})")
    df = io.read_spread(spark, path)
    assert ("Exchange" in df._jdf.queryExecution().executedPlan().toString()) == spread
    assert df.count() == 400_000


def test_records_are_joined_once_for_people_and_events(spark):
    rows = [(p, c, f"20{y:02d}-01-01") for p in range(5) for c, y in (("a", 1), ("a", 9), ("b", 9)) if c == "a" or p < 2]
    table = spark.createDataFrame(rows, "person_id long, c string, t string").withColumn("t", F.to_timestamp("t"))
    events = D.qualified_events([D.Domain("x", table, "c", "t"), D.Domain("y", table.filter("false"), "c", "t")], "2005-01-01", 3)
    assert "Union" not in events._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.person_id, r.code, r.time.year) for r in events.collect()) == [(p, "a", 2009) for p in range(5)]


def test_events_without_a_visit_do_not_meet_the_visits(spark, monkeypatch):
    written = []
    monkeypatch.setattr(D, "stage", lambda df, label: written.append((label, df.count())) or df)
    events = spark.range(10).select(
        F.lit(1).cast("long").alias("person_id"), F.when(F.col("id") < 3, F.col("id")).alias("visit_id"),
        F.to_timestamp(F.lit("2020-01-01")).alias("time"), F.lit("c").alias("code"),
    )
    start = F.to_timestamp(F.lit("2020-01-01"))
    visits = spark.range(2).select(F.lit(1).cast("long").alias("person_id"), F.col("id").alias("visit_id"), start.alias("visit_start"), start.alias("visit_end"))
    placed = D.place_events(events, visits)
    assert {r.how: r["count"] for r in placed.groupBy("how").count().collect()} == {"linked": 2, "attached": 8}
    assert dict(written)["domain-events"] == 3
