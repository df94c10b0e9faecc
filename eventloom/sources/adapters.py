"""Views of the test tables in the event model, with the same views as SQL for checking.

``events`` gives flat events without visits. ``customer``, ``orders`` and ``lineitem`` give people, visits with types,
and events linked to visits. All are whole-table mappings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import parts, stage_by
from .io import read_spread


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_spread(spark, f"{root}/{name}.parquet")


def log_events(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select(
        F.col("user_id").alias("subject_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("time"),
        F.col("event_type").alias("code"),
        F.col("props").alias("text_value"),
        F.col("value").alias("numeric_value"),
        F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("long") % 3).cast("string")).alias("unit"),
    )


LOG_EVENTS_SQL = """
SELECT user_id AS subject_id, event_id, ts AS time, event_type AS code, props AS text_value, value AS numeric_value,
       'k' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) AS unit
FROM events"""


def people(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, root, "customer").select(
        key.alias("person_id"),
        F.date_add(F.lit("1940-01-01").cast("date"), ((key * 37) % 20000).cast("int")).cast("timestamp").alias("birth"),
        F.when(key % 2 == 0, "Gender/F").otherwise("Gender/M").alias("gender"),
        F.concat(F.lit("Race/"), F.col("c_mktsegment")).alias("race"),
    )


PEOPLE_SQL = """
SELECT c_custkey AS person_id, CAST(DATE '1940-01-01' + CAST((c_custkey * 37) % 20000 AS INTEGER) AS TIMESTAMP) AS birth,
       CASE WHEN c_custkey % 2 = 0 THEN 'Gender/F' ELSE 'Gender/M' END AS gender, 'Race/' || c_mktsegment AS race
FROM customer"""


def visits(spark: SparkSession, root: str, stay_days: str = "o_orderkey % 5", orders: DataFrame | None = None) -> DataFrame:
    start = F.col("o_orderdate").cast("timestamp")
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Visit/ER")
        .when(F.col("o_orderpriority") == "2-HIGH", "Visit/IP")
        .otherwise("Visit/OP")
    )
    end = start + F.make_dt_interval(F.expr(f"cast({stay_days} as int)"))
    return (table(spark, root, "orders") if orders is None else orders).select(
        F.col("o_custkey").alias("person_id"),
        F.col("o_orderkey").alias("visit_id"),
        kind.alias("visit_type"),
        start.alias("visit_start"),
        F.when(kind != "Visit/OP", end).alias("visit_end"),
        F.col("o_orderstatus").alias("discharge_facility"),
    )


def visits_sql(stay_days: str = "o_orderkey % 5") -> str:
    return f"""
SELECT o_custkey AS person_id, o_orderkey AS visit_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Visit/ER' WHEN '2-HIGH' THEN 'Visit/IP' ELSE 'Visit/OP' END AS visit_type,
       CAST(o_orderdate AS TIMESTAMP) AS visit_start,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
            THEN CAST(o_orderdate AS TIMESTAMP) + to_days(CAST({stay_days} AS INTEGER)) END AS visit_end,
       o_orderstatus AS discharge_facility
FROM orders"""


def _visit_event_columns() -> list[Column]:
    line = F.col("l_linenumber")
    return [
        F.col("o_custkey").alias("person_id"),
        F.col("l_orderkey").alias("visit_id"),
        (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 100 + line).alias("event_id"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval((line % 4).cast("int"))).alias("time"),
        F.concat(F.lit("Item "), (F.col("l_partkey") % 97).cast("string")).alias("code"),
    ]


def visit_events(spark: SparkSession, root: str) -> DataFrame:
    """One event per order line, inside its visit."""
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, root, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus",
        "l_extendedprice",
    )
    line = F.col("l_linenumber")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        *_visit_event_columns(),
        F.when(line % 2 == 0, F.col("l_quantity")).alias("numeric_value"),
        F.when(line % 3 == 0, F.concat(F.lit("state "), F.col("l_linestatus"))).alias("text_value"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("unit"),
    )


VISIT_EVENTS_SQL = """
SELECT o_custkey AS person_id, l_orderkey AS visit_id,
       l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS event_id,
       CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(l_linenumber % 4 AS INTEGER)) AS time,
       'Item ' || (l_partkey % 97) AS code,
       CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS numeric_value,
       CASE WHEN l_linenumber % 3 = 0 THEN 'state ' || l_linestatus END AS text_value,
       CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS unit
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def shipped_events(spark: SparkSession, root: str) -> DataFrame:
    """One event per order line at its ship date, which is unrelated to the visit it belongs to."""
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, root, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity"
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("person_id"),
        F.col("l_orderkey").alias("visit_id"),
        (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("event_id"),
        F.col("l_shipdate").cast("timestamp").alias("time"),
        F.concat(F.lit("Item "), (F.col("l_partkey") % 97).cast("string")).alias("code"),
        F.col("l_quantity").alias("numeric_value"),
    )


SHIPPED_EVENTS_SQL = """
SELECT o_custkey AS person_id, l_orderkey AS visit_id,
       l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS event_id, CAST(l_shipdate AS TIMESTAMP) AS time,
       'Item ' || (l_partkey % 97) AS code, l_quantity AS numeric_value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def concepts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select(
        F.col("p_partkey").alias("concept_id"), F.concat_ws(":", "p_brand", "p_type").alias("concept_code")
    )


CONCEPTS_SQL = "SELECT p_partkey AS concept_id, p_brand || ':' || p_type AS concept_code FROM part"


def conditions(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("person_id"),
        F.col("l_partkey").alias("condition_concept_id"),
        F.col("l_shipdate").cast("date").alias("condition_start_date"),
    )


CONDITIONS_SQL = """
SELECT o_custkey AS person_id, l_partkey AS condition_concept_id, CAST(l_shipdate AS DATE) AS condition_start_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def predictions(spark: SparkSession, root: str, label: str = "quality") -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "n_chars")
    labels = table(spark, root, "labels").select("doc_id", label)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("n_chars") - F.lit(2000.0)) / F.lit(1000.0)))
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("subject_id"),
        F.round(p, 9).alias("predicted_boolean_probability"),
        (F.col(label) == 1).alias("boolean_value"),
    )


def predictions_sql(label: str = "quality") -> str:
    return f"""
SELECT doc_id AS subject_id,
       round(1e0 / (1e0 + exp(-(n_chars - 2000e0) / 1000e0)), 9) AS predicted_boolean_probability,
       ({label} = 1) AS boolean_value
FROM labels JOIN documents USING (doc_id)"""


# ---- domain tables: the records of an order, with visit ids or without, and some with an id that is no visit -------------------


def orders_by_person(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and order lines with the customer and the date of their order, both staged in buckets of the customer.

    The records and visits below are made from them without a join or a shuffle.
    """
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    lines = table(spark, root, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"
    )
    key = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    lines = lines.join(key, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    person = ["o_custkey"]
    return tuple(stage_by(df.repartition(parts(spark), *person), person, label) for df, label in ((orders, "orders"), (lines, "order-lines")))


def condition_records(spark: SparkSession, root: str, lines: DataFrame | None = None) -> DataFrame:
    """One per order line at its ship date, without a visit."""
    if lines is None:
        orders = table(spark, root, "orders").select("o_orderkey", "o_custkey")
        lines = table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        F.col("o_custkey").alias("person_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("condition_occurrence_id"),
        (F.col("l_partkey") % 1000).alias("condition_concept_id"),
        F.col("l_shipdate").cast("date").alias("condition_start_date"),
    )


CONDITION_RECORDS_SQL = """
SELECT o_custkey AS person_id, CAST(NULL AS BIGINT) AS visit_id, l_orderkey * 10 + l_linenumber AS event_id,
       CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS time, CAST(l_partkey % 1000 AS VARCHAR) AS code, CAST(NULL AS DOUBLE) AS numeric_value,
       CAST(NULL AS VARCHAR) AS text_value, CAST(NULL AS VARCHAR) AS unit, 'condition' AS "table"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def drug_records(spark: SparkSession, root: str, lines: DataFrame | None = None) -> DataFrame:
    """One per order line in its visit."""
    e = visit_events(spark, root) if lines is None else lines.select(*_visit_event_columns())
    return e.select("person_id", "visit_id", F.col("event_id").alias("drug_exposure_id"), F.col("time").alias("drug_time"), F.col("code").alias("drug"))


DRUG_RECORDS_SQL = f"""
SELECT person_id, visit_id, event_id, time, code, CAST(NULL AS DOUBLE) AS numeric_value, CAST(NULL AS VARCHAR) AS text_value,
       CAST(NULL AS VARCHAR) AS unit, 'drug' AS "table" FROM ({VISIT_EVENTS_SQL})"""


def procedure_records(spark: SparkSession, root: str, orders: DataFrame | None = None) -> DataFrame:
    """One per order up to eight days after it, without a visit."""
    key = F.col("o_orderkey")
    return (table(spark, root, "orders") if orders is None else orders).select(
        F.col("o_custkey").alias("person_id"),
        key.alias("procedure_occurrence_id"),
        F.concat(F.lit("Proc "), (key % 11).cast("string")).alias("procedure_concept"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval((key % 9).cast("int"))).alias("procedure_time"),
    )


PROCEDURE_RECORDS_SQL = """
SELECT o_custkey AS person_id, CAST(NULL AS BIGINT) AS visit_id, o_orderkey AS event_id,
       CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 9 AS INTEGER)) AS time, 'Proc ' || (o_orderkey % 11) AS code,
       CAST(NULL AS DOUBLE) AS numeric_value, CAST(NULL AS VARCHAR) AS text_value, CAST(NULL AS VARCHAR) AS unit, 'procedure' AS "table"
FROM orders"""


def measurement_records(spark: SparkSession, root: str, lines: DataFrame | None = None) -> DataFrame:
    """One per order line some hours after the order; a third names no visit, some name one that is not listed."""
    line, key = F.col("l_linenumber"), F.col("l_orderkey")
    if lines is None:
        orders = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        lines = table(spark, root, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
        lines = lines.join(orders, key == F.col("o_orderkey"))
    return lines.select(
        F.col("o_custkey").alias("person_id"),
        F.when(line % 5 == 0, -key - 1).when(line % 3 != 0, key).alias("visit_id"),
        (key * 10 + line).alias("measurement_id"),
        F.concat(F.lit("Lab "), (F.col("l_suppkey") % 7).cast("string")).alias("measurement_concept"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), (line * 17).cast("int"))).alias("measurement_time"),
        F.col("l_quantity").alias("value_as_number"),
        F.col("l_returnflag").alias("unit_source"),
    )


MEASUREMENT_RECORDS_SQL = """
SELECT o_custkey AS person_id, CASE WHEN l_linenumber % 5 = 0 THEN -l_orderkey - 1 WHEN l_linenumber % 3 <> 0 THEN l_orderkey END AS visit_id,
       l_orderkey * 10 + l_linenumber AS event_id, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(l_linenumber * 17 AS INTEGER)) AS time,
       'Lab ' || (l_suppkey % 7) AS code, l_quantity AS numeric_value, CAST(NULL AS VARCHAR) AS text_value, l_returnflag AS unit,
       'measurement' AS "table"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def deaths(spark: SparkSession, root: str) -> DataFrame:
    """Customers in debt, some of them before their last order."""
    key = F.col("c_custkey")
    died = F.date_add(F.lit("2000-01-01").cast("date"), ((key * 13) % 900).cast("int")).cast("timestamp")
    return table(spark, root, "customer").select(key.alias("person_id"), F.when(F.col("c_acctbal") < 0, died).alias("time"))


DEATHS_SQL = """
SELECT c_custkey AS person_id, CAST(DATE '2000-01-01' + CAST((c_custkey * 13) % 900 AS INTEGER) AS TIMESTAMP) AS time
FROM customer WHERE c_acctbal < 0"""
