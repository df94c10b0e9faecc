"""Queries on sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import tokens as T
from ..session import new_folder, stage
from ..sources import adapters as A
from ..sources import io
from ..streaming import sketches as XS
from ..streaming import streams as X
from ..streaming import visits as XV
from .token_queries import _SPECIALS

QUERIES: dict = {}


def add(name, sql=None):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


@add("s1_parquet_scan", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-09-02'")
def parquet_scan(spark, d):
    df = io.read_table(spark, f"{d}/lineitem.parquet")
    return df.filter(F.col("l_shipdate") >= F.lit("1998-09-02").cast("timestamp_ntz")).select("l_orderkey", "l_partkey", "l_quantity")


def event_stream(spark, d):
    """The event log as a stream of files."""
    raw = io.read_table(spark, f"{d}/events.parquet", streaming=True)
    return raw.select(
        F.col("user_id").alias("subject_id"), "event_id", F.col("ts").cast("timestamp").alias("time"),
        F.col("event_type").alias("code"), F.col("value"),
        F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("long") % 3).cast("string")).alias("unit"),
    )


@add("s2_streaming_scan", "SELECT user_id AS subject_id, event_id, event_type AS code, value FROM events")
def streaming_scan(spark, d):
    return X.run_append(event_stream(spark, d).select("subject_id", "event_id", "code", "value"), "scan")


@add(
    "s3_event_source",
    """SELECT user_id AS subject_id, event_id, ts AS time, event_type AS code, props AS text_value, value AS numeric_value,
  json_extract_string(props, '$.k') AS unit, 0 AS visit_id FROM events""",
)
def event_source(spark, d):
    mapping = {
        "subject_id": "user_id", "time": "cast(ts as timestamp)", "code": "event_type", "text_value": "props",
        "numeric_value": "value", "unit": "get_json_object(props, '$.k')", "visit_id": "0",
    }
    return io.read_events(spark, f"{d}/events.parquet", mapping).drop("table", "end")


@add("s4_table_path", "SELECT c_custkey, c_mktsegment FROM customer")
def table_path(spark, d):
    return spark.read.parquet(io.table_path(spark, d, "customer")).select("c_custkey", "c_mktsegment")


@add(
    "s7_partitioned_sink",
    "SELECT o_orderkey, CASE WHEN o_custkey % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM orders "
    "UNION ALL SELECT o_orderkey, 'again' FROM orders WHERE o_orderpriority = '5-LOW'",
)
def partitioned_sink(spark, d):
    path = new_folder(spark, "orders")
    o = A.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    first = o.select("o_orderkey", F.when(F.col("o_custkey") % 10 < 7, "train").otherwise("test").alias("split"))
    io.write_table(first, path, ["split"])
    more = o.filter("o_orderpriority = '5-LOW'").select("o_orderkey", F.lit("again").alias("split"))
    io.write_table(more, path, ["split"], mode="append")
    return spark.read.parquet(path).select("o_orderkey", "split")


@add(
    "s7_replaced_shards",
    "SELECT o_orderkey, o_orderpriority AS shard, CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'second' ELSE 'first' END AS version FROM orders",
)
def replaced_shards(spark, d):
    """All orders by priority; two of the shards are written again, the second time twice."""
    path = new_folder(spark, "shards")
    o = A.table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("shard"))
    io.replace_shards(o.withColumn("version", F.lit("first")), path, "shard")
    for _ in range(2):
        io.replace_shards(o.filter("shard IN ('1-URGENT', '5-LOW')").withColumn("version", F.lit("second")), path, "shard")
    return spark.read.parquet(path).select("o_orderkey", "shard", "version")


@add(
    "s7_bucketed_join",
    "SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2",
)
def bucketed_join(spark, d):
    """Customers and orders bucketed by person: neither the join nor the aggregation shuffles."""
    people, orders = bucketed(spark, d)
    return people.join(orders, people["c_custkey"] == orders["o_custkey"], "left").groupBy("c_custkey", "c_mktsegment").agg(F.count("o_orderkey").alias("n"))


def bucketed(spark, d, buckets=8):
    name = lambda t: f"bucketed_{t}_{uuid.uuid4().hex}"
    people = A.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    orders = A.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    save = lambda df, t, key: io.save_bucketed(df, name(t), key, buckets, new_folder(spark, f"bucketed-{t}"))
    return save(people, "people", "c_custkey"), save(orders, "orders", "o_custkey")


def _log_vocab(spark, d, size):
    seq = A.log_events(spark, d).select(F.col("code").alias("token"))
    return stage(T.build_vocab(seq, size), "log-vocabulary")


@add(
    "x1_encode_stream",
    f"""WITH w AS (SELECT event_type AS token, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, token LIMIT 3),
v AS (SELECT token, id::INT AS id FROM {_SPECIALS} UNION ALL SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 4)::INT FROM w)
SELECT user_id AS subject_id, event_id, event_type AS token, coalesce(id, 2)::INT AS token_id FROM events LEFT JOIN v ON event_type = token""",
)
def encode_stream(spark, d):
    out = X.encode_stream(event_stream(spark, d), _log_vocab(spark, d, 8))
    return X.run_append(out.select("subject_id", "event_id", "token", "token_id"), "encoded")


@add(
    "x2_stream_moments",
    """SELECT event_type AS code, 'k' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) AS unit, count(*) AS n, round(avg(value), 6) AS mean,
  round(stddev_pop(value), 6) AS std FROM events GROUP BY 1, 2""",
)
def stream_moments(spark, d):
    out = X.run_latest(X.moments(event_stream(spark, d)), "moments", "update", ["code", "unit"])
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@add(
    "t5_merged_moments",
    """SELECT event_type AS code, 'k' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) AS unit, count(*) AS n, round(avg(value), 6) AS mean,
  round(stddev_pop(value), 6) AS std FROM events GROUP BY 1, 2""",
)
def merged_moments(spark, d):
    """Moments of the users' sevenths, merged into those of all events."""
    e = A.log_events(spark, d).select("code", "unit", (F.col("subject_id") % 7).alias("salt"), F.col("numeric_value").alias("value"))
    parts = e.groupBy("code", "unit", "salt").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2")
    )
    return X.merge_salted(parts).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@add("x2_stream_value_statistics")
def stream_value_statistics(spark, d):
    states = X.lab_stats_stream(event_stream(spark, d), k=3.0, capacity=100)
    latest = X.run_latest(states, "states", "update", ["code", "unit", "salt"])
    return X.merge_salted(latest).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@add(
    "x2_stream_sketches",
    """SELECT event_type AS code, 'k' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) AS unit, count(*) AS n, true AS quartiles_hold,
  true AS gate_holds FROM events WHERE value <> 0 GROUP BY 1, 2""",
)
def stream_sketches(spark, d):
    """Sketches of windows, merged: quartiles and the share in the gate are those of all values, within the sketch's error."""
    log = event_stream(spark, d)
    windows, left = XV.run_closed(log, XS.sketch_stream, "sketches")
    assert left == 0, "sketches stay in state"
    stats = stage(XS.robust_stats(XS.merge_sketches(windows)).drop("sketch"), "robust")
    return sketch_error(A.log_events(spark, d).withColumnRenamed("numeric_value", "value"), stats)


@add(
    "t5_merged_sketches",
    """SELECT event_type AS code, 'k' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) AS unit, count(*) AS n, true AS quartiles_hold,
  true AS gate_holds FROM events WHERE value <> 0 GROUP BY 1, 2""",
)
def merged_sketches(spark, d):
    """Sketches of the users' sevenths, merged in two steps."""
    e = A.log_events(spark, d).withColumnRenamed("numeric_value", "value").filter(XS.usable(F.col("value")))
    salt = (F.col("subject_id") % 7).alias("salt")
    parts = e.groupBy("code", "unit", salt).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", XS.SKETCH_K).alias("sketch"))
    thirds = XS.merge_sketches(parts.withColumn("third", F.col("salt") % 3), ("code", "unit", "third"))
    return sketch_error(e, stage(XS.robust_stats(XS.merge_sketches(thirds)).drop("sketch"), "robust"))


def sketch_error(values, stats):
    """Whether the exact ranks of the quartiles, and the exact share of values in the gate, are what the sketch says."""
    v, error = F.col("value"), XS.rank_error()
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    near = [(share(v < F.col(q)) <= r + error) & (share(v <= F.col(q)) >= r - error) for q, r in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))]
    kept = share((v >= F.col("low")) & (v <= F.col("high")))
    gate = F.abs(kept - F.first("n_kept") / F.first("n")) <= 2 * error + 1 / XS.GRID
    out = values.filter(XS.usable(v)).join(stats, ["code", "unit"]).groupBy("code", "unit")
    return out.agg(F.first("n").alias("n"), (near[0] & near[1] & near[2]).alias("quartiles_hold"), gate.alias("gate_holds"))


_SESSIONS = """WITH s AS (SELECT user_id AS subject_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 12 HOUR, TRUE)::INT AS opens FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(opens) OVER (PARTITION BY subject_id ORDER BY ts) AS s FROM s),
z AS (SELECT subject_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n_events FROM n GROUP BY subject_id, s)
SELECT * FROM z"""


@add("x3_stream_sessions", _SESSIONS)
def stream_sessions(spark, d):
    """All sessions, told in append mode: the log is closed at the end of the input, so none stays open."""
    sessions, left = XV.run_closed(event_stream(spark, d), X.sessions_stream, "sessions")
    assert left == 0, "sessions stay in state"
    return sessions


@add("x3_stream_visits", _SESSIONS)
def stream_visits(spark, d):
    """As sessions, by keyed state with timers; late events are further rows of their visit."""
    visits, left = XV.run_closed(event_stream(spark, d), XV.visits_stream, "visits")
    assert left == 0, "visits stay in state"
    return visits.groupBy("subject_id", "start").agg(F.max("end").alias("end"), F.sum("n_events").alias("n_events"))


@add("x3_sessions_batch", _SESSIONS)
def sessions_batch(spark, d):
    return X.sessions_stream(A.log_events(spark, d))


@add(
    "x3_stream_days",
    """WITH d AS (SELECT user_id AS subject_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n_events FROM events GROUP BY 1, 2)
SELECT * FROM d""",
)
def stream_days(spark, d):
    """Updated as events come in, so the day that is open at the end of the input is there too."""
    return X.run_latest(X.days_stream(event_stream(spark, d)), "days", "update", ["subject_id", "day"])
