"""Filters and repairs on events, sequences and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any


def keep_min_length(seq: DataFrame, n: int = 1) -> DataFrame:
    """Rows of the people with at least ``n`` tokens; ``num_of_concepts`` is the person's total, on each of their rows."""
    return seq.filter(F.col("num_of_concepts") >= n)


def keep_long_people(seq: DataFrame, n: int) -> DataFrame:
    """Tokens of the people who have at least ``n`` of them, in long form."""
    long_enough = seq.groupBy("person_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= n)
    return seq.join(long_enough.select("person_id"), "person_id", "left_semi")


def select_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Keep those of ``required`` that exist."""
    return df.select(*[c for c in required if c in df.columns])


def drop_tables(events: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Drop events of the named source tables; events without a table stay."""
    return events.filter(F.col("table").isNull() | ~F.col("table").isin(*tables))


def drop_unusable(people: DataFrame, visits: DataFrame) -> DataFrame:
    """People with a birth date and at least one visit."""
    return people.filter(F.col("birth").isNotNull()).join(visits.select("person_id"), "person_id", "left_semi")


def drop_untimed(events: DataFrame) -> DataFrame:
    return events.filter(F.col("time").isNotNull())


def from_date(events: DataFrame, date: str) -> DataFrame:
    """Events on or after a date."""
    return events.filter(F.col("time") >= F.lit(date).cast("timestamp"))


def match_concepts(concepts: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Concepts whose code matches any pattern anywhere."""
    return concepts.filter(contains_any(F.col("concept_code"), patterns))


def repair_values(seq: DataFrame, missing: str = "N/A") -> DataFrame:
    """Missing unit or categorical value becomes a fixed token; NaN becomes value 0 with mask 0."""
    value = F.col("concept_values") if "concept_values" in seq.columns else F.col("number_as_values")
    out = seq.withColumns(
        {
            "concept_value_masks": F.when(F.isnan(value), 0).otherwise(F.col("concept_value_masks")).cast("int"),
            "concept_values": F.nanvl(value, F.lit(0.0)),
        }
    )
    for c in ("units", "concept_as_values"):
        if c in seq.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(missing)))
    return out


def clean_predictions(df: DataFrame) -> DataFrame:
    """``p`` and ``y`` as doubles; rows missing either are dropped, missing columns are an error."""
    need = {"predicted_boolean_probability", "boolean_value"}
    if not need <= set(df.columns):
        raise ValueError(f"predictions need the columns {sorted(need)}; found {df.columns}")
    keep = [c for c in ("subject_id", "prediction_time") if c in df.columns]
    out = df.select(
        *keep,
        F.col("predicted_boolean_probability").try_cast("double").alias("p"),
        F.col("boolean_value").try_cast("boolean").cast("double").alias("y"),
    )
    return out.filter(F.col("p").isNotNull() & ~F.isnan("p") & F.col("y").isNotNull())
