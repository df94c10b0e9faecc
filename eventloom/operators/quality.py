"""Table checks; each returns rows ``check, ok, detail, level``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import table_path

CHECK_SCHEMA = "`check` string, ok boolean, detail string, level string"

# Relational tables with the few columns each needs; the first four are required, the others recommended.
REQUIRED_TABLES = {
    "person": ("person_id",),
    "visit_occurrence": ("person_id", "visit_start_date"),
    "condition_occurrence": ("person_id", "condition_concept_id", "condition_start_date"),
    "concept": ("concept_id", "concept_code"),
}
RECOMMENDED_TABLES = {
    "drug_exposure": ("person_id", "drug_concept_id"),
    "procedure_occurrence": ("person_id", "procedure_concept_id"),
    "measurement": ("person_id", "measurement_concept_id"),
}


def _rows(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), CHECK_SCHEMA)


def check_tables(
    spark: SparkSession,
    root: str,
    required: Mapping[str, Sequence[str]] = REQUIRED_TABLES,
    recommended: Mapping[str, Sequence[str]] = RECOMMENDED_TABLES,
) -> DataFrame:
    """Presence, columns and non-emptiness of each table; recommended tables only warn."""
    rows = []
    for level, tables in (("error", required), ("warning", recommended)):
        for name, columns in tables.items():
            path = table_path(spark, root, name)
            rows.append((f"{name} present", path is not None, path or "not found", level))
            if path is None:
                continue
            df = spark.read.parquet(path)
            missing = [c for c in columns if c not in df.columns]
            rows.append((f"{name} columns", not missing, ", ".join(missing) or "all present", level))
            rows.append((f"{name} not empty", not df.isEmpty(), "", level))
    return _rows(spark, rows)


def check_schema(df: DataFrame) -> DataFrame:
    """Cohort columns, under our names or the event-standard names, their types, and in one pass over the rows keys, dates and labels.

    A label is 0 or 1, or a boolean. Rows are checked only where columns and types are right.
    """
    ours, theirs = ["person_id", "index_date", "label"], ["subject_id", "prediction_time", "boolean_value"]
    names = next((n for n in (ours, theirs) if set(n) <= set(df.columns)), None)
    rows = [("cohort columns", names is not None, ", ".join(df.columns), "error")]
    if names is None:
        return _rows(df.sparkSession, rows)
    person, when, label = names
    kinds = {n: df.schema[n].dataType for n in names}
    fits = {
        person: isinstance(kinds[person], (T.IntegralType, T.StringType)),
        when: isinstance(kinds[when], (T.DateType, T.TimestampType, T.TimestampNTZType)),
        label: isinstance(kinds[label], (T.BooleanType, T.IntegralType)),
    }
    rows += [(f"{n} type", ok, kinds[n].simpleString(), "error") for n, ok in fits.items()]
    if not all(fits.values()):
        return _rows(df.sparkSession, rows)
    count = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0))
    outside = ~F.coalesce(F.col(label).cast("int").isin(0, 1), F.lit(False))
    found = df.agg(
        F.count(F.lit(1)), count(F.col(person).isNull()), count(F.col(when).isNull()), count(outside)
    ).first()
    tests = ("cohort not empty", f"{person} present", f"{when} present", f"{label} within 0 and 1")
    rows += [(name, bool(n > 0 if i == 0 else n == 0), str(n), "error") for i, (name, n) in enumerate(zip(tests, found))]
    return _rows(df.sparkSession, rows)


def prediction_counts(df: DataFrame) -> DataFrame:
    """One row of counts behind :func:`check_predictions`."""
    p, y = F.col("predicted_boolean_probability"), F.col("boolean_value")
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(p.isNull() | F.isnan(p), 1).otherwise(0)).alias("missing_p"),
        F.sum(F.when((p < 0) | (p > 1), 1).otherwise(0)).alias("outside_p"),
        F.sum(F.when(y.cast("int") == 1, 1).otherwise(0)).alias("positives"),
        F.sum(F.when(y.cast("int") == 0, 1).otherwise(0)).alias("negatives"),
    )


def check_predictions(df: DataFrame) -> DataFrame:
    need = ("subject_id", "predicted_boolean_probability", "boolean_value")
    missing = [c for c in need if c not in df.columns]
    if missing:
        return _rows(df.sparkSession, [("prediction columns", False, ", ".join(missing), "error")])
    tests = F.array(
        *[
            F.struct(F.lit(name).alias("check"), ok.alias("ok"), detail.cast("string").alias("detail"), F.lit("error").alias("level"))
            for name, ok, detail in (
                ("predictions not empty", F.col("n") > 0, F.col("n")),
                ("probabilities present", F.col("missing_p") == 0, F.col("missing_p")),
                ("probabilities within 0 and 1", F.col("outside_p") == 0, F.col("outside_p")),
                ("both classes", (F.col("positives") > 0) & (F.col("negatives") > 0), F.col("positives")),
            )
        ]
    )
    return prediction_counts(df).select(F.inline(tests))


def check_metrics(df: DataFrame) -> DataFrame:
    """Metric rows ``metric, value`` must lie within 0 and 1."""
    ok = F.coalesce(F.col("value").between(0, 1), F.lit(False))
    return df.select(
        F.concat(F.col("metric"), F.lit(" within 0 and 1")).alias("check"),
        ok.alias("ok"),
        F.col("value").cast("string").alias("detail"),
        F.lit("error").alias("level"),
    )


def split_counts(df: DataFrame, key: str = "person_id") -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(key).isNull(), 1).otherwise(0)).alias("missing_key")
    )


def check_splits(df: DataFrame, expected: Sequence[str], key: str = "person_id") -> DataFrame:
    """Each expected split has rows and no missing keys."""
    want = df.sparkSession.createDataFrame([(s,) for s in expected], "split string")
    got = want.join(split_counts(df, key), "split", "left")
    n, missing = F.coalesce("n", F.lit(0)), F.coalesce("missing_key", F.lit(0))
    return got.select(
        F.concat(F.lit("split "), F.col("split")).alias("check"),
        ((n > 0) & (missing == 0)).alias("ok"),
        n.cast("string").alias("detail"),
        F.lit("error").alias("level"),
    )


def check_nonempty(df: DataFrame, name: str = "table") -> DataFrame:
    return _rows(df.sparkSession, [(f"{name} not empty", not df.isEmpty(), "", "error")])
