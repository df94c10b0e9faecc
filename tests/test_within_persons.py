"""Domain sequences that stay within persons: the same rows as without, and nothing shuffled after records are dealt out."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from eventloom.plans import sequences as Q

DAY = dt.timedelta(days=1)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("within"))
    at = dt.datetime(1997, 1, 1)
    people = [(i, f"c{i}", -1.0 if i % 4 == 0 else 1.0, "M") for i in range(1, 71)]
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
    orders = [(o, None if o % 59 == 0 else o % 71, "O", at + (o % 40) * 7 * DAY if o % 53 else None, kinds[o % 3]) for o in range(1, 600)]
    lines = [
        (o, (o * 7 + n) % 30, o % 5, n, float(n), "R" if n % 2 else "N", "F", None if n == 3 and o % 7 == 0 else at + (o % 400) * DAY)
        for o in range(1, 590) for n in range(1, 7) if o % 6
    ]
    for name, rows, schema in (
        ("customer", people, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"),
        (
            "lineitem", lines,
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
        ),
    ):
        frame = spark.createDataFrame(rows, schema)
        if name == "lineitem":
            frame = frame.withColumn("l_extendedprice", F.lit(1.0))
        frame.write.parquet(f"{root}/{name}.parquet")
    return root


def rows(df):
    return sorted(map(repr, df.collect()))


def test_sequences_within_persons_are_those_of_split_persons_and_of_the_sql(spark, tables, monkeypatch):
    within = Q.domain_sequences(spark, tables)
    got = rows(within)
    assert {"gap", "stay_gap", "event"} < {r.kind for r in within.select("kind").distinct().collect()}
    assert any("[DEATH]" in r for r in got)
    monkeypatch.setattr(Q, "SPLIT_ABOVE", 0)
    assert rows(Q.domain_sequences(spark, tables)) == got
    duck = duckdb.connect()
    duck.execute("SET TimeZone='UTC'")
    for name in ("customer", "orders", "lineitem"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet/*.parquet'")
    _, sql = Q.QUERIES["q17_domain_sequences"]
    want = duck.execute(sql).fetchall()
    assert len(want) == len(got)
    key = lambda r: (r[0], r[1], r[2], r[3], r[4])
    assert sorted(map(key, want)) == sorted((r.person_id, r.pos, r.kind, r.token, r.visit_id) for r in within.collect())


def test_records_are_not_shuffled_after_they_are_dealt_out(spark, tables, monkeypatch):
    plans, staged = [], Q.S.stage_within

    def watched(df, key, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return staged(df, key, label)

    for module in (Q.S, Q.D):
        monkeypatch.setattr(module, "stage_within", watched)
    out = Q.domain_sequences(spark, tables)
    plans.append(("result", out._jdf.queryExecution().executedPlan().toString()))
    shuffles = {label: plan.count(" Exchange hashpartitioning") for label, plan in plans}
    assert {k: v for k, v in shuffles.items() if v} in ({}, {"ordered-visits": 1}, {"death-visits": 1}, {"ordered-visits": 1, "death-visits": 1})
    assert {"domain-events", "loose-days", "placed-events", "event-tokens", "visit-layout", "result"} <= set(shuffles)


def test_the_caller_keeps_its_settings(spark, tables):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name), spark.conf.get("spark.sql.shuffle.partitions")
    within = Q.domain_sequences(spark, tables).sparkSession
    assert (spark.conf.get(name), spark.conf.get("spark.sql.shuffle.partitions")) == before
    assert within.conf.get(name) == "false" and int(within.conf.get("spark.sql.shuffle.partitions")) >= int(before[1])
