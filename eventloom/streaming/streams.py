"""Structured Streaming forms of cleaning, statistics and visit formation.

The stream functions return streaming DataFrames; ``run_*`` helpers drive one to the end of the available input and give
the written table back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import clean_code
from ..operators.tokens import OOV_ID
from ..session import new_folder
from .visits import open_to_closing


def encode_stream(stream: DataFrame, vocab: DataFrame) -> DataFrame:
    """Clean codes, drop untimed events and look up ids in a static vocabulary; append output."""
    ids = vocab.select("token", F.col("id").alias("token_id"))
    out = stream.filter(F.col("time").isNotNull()).withColumn("token", clean_code(F.col("code")))
    return out.join(ids, "token", "left").withColumn("token_id", F.coalesce("token_id", F.lit(OOV_ID)))


def sessions_stream(stream: DataFrame, gap: str = "12 hours", delay: str = "1 hour") -> DataFrame:
    """Visits as sessions: events of a subject less than ``gap`` apart; events later than ``delay`` are dropped."""
    return (
        open_to_closing(stream, delay, F.lit(True))
        .groupBy("subject_id", F.session_window("time", gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select("subject_id", F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n_events")
    )


def days_stream(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Visits as calendar days."""
    return (
        stream.withWatermark("time", delay)
        .groupBy("subject_id", F.window("time", "1 day").alias("day"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select("subject_id", F.col("day.start").alias("day"), "n_events")
    )


def moments(values: DataFrame) -> DataFrame:
    """Mean and deviation per (code, unit) without outlier gating; update or complete output."""
    return values.groupBy("code", "unit").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


_STATE = "n long, mean double, m2 double, buffer array<double>"
_STATS = "code string, unit string, n long, mean double, std double"


def combine(n: float, mean: float, m2: float, values: np.ndarray) -> tuple[int, float, float]:
    """Pooled count, mean and sum of squared deviations of a state and new values."""
    k = len(values)
    if k == 0:
        return int(n), float(mean), float(m2)
    other = float(values.mean())
    total, delta = n + k, other - mean
    m2 = m2 + float(((values - other) ** 2).sum()) + delta * delta * n * k / total
    return int(total), float(mean + delta * k / total), float(m2)


def gated_update(state: tuple | None, values: np.ndarray, k: float, capacity: int) -> tuple:
    """Next state ``(n, mean, m2, buffer)``.

    The first ``capacity`` values are buffered; once full, those between the quantiles that ``k`` deviations would mark
    seed the moments. After that a value counts when it lies within ``k`` deviations of the mean so far, the values before it in
    ``values`` included: how values are cut into batches makes no difference.
    """
    from ..operators.tokens import normal_share

    n, mean, m2, buffer = state or (0, 0.0, 0.0, [])
    values = values[~np.isnan(values) & (values != 0)]
    if n == 0:
        room = capacity - len(buffer)
        buffer, values = [*buffer, *values[:room].tolist()], values[room:]
        if len(buffer) < capacity:
            return 0, 0.0, 0.0, buffer
        full = np.array(buffer)
        lo, hi = np.quantile(full, [normal_share(-k), normal_share(k)])
        n, mean, m2 = combine(0, 0.0, 0.0, full[(full >= lo) & (full <= hi)])
        buffer = []
    for x in values.tolist():
        apart = x - mean
        if m2 > 0 and apart * apart > k * k * m2 / n:
            continue
        n += 1
        mean += apart / n
        m2 += apart * (x - mean)
    return n, mean, m2, buffer


def lab_stats_stream(stream: DataFrame, k: float = 3.0, capacity: int = 100, salts: int = 16) -> DataFrame:
    """Gated running statistics per (code, unit, salt); at most ``capacity`` values are held per key.

    A key may be very hot, so its rows are spread over ``salts`` independent states by a hash of the event id;
    :func:`merge_salted` pools them. Input has ``code, unit, value, event_id``.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = tuple(state.get) if state.exists else None
        for pdf in batches:
            current = gated_update(current, pdf["value"].to_numpy(float), k, capacity)
        n, mean, m2, buffer = current
        state.update((int(n), float(mean), float(m2), [float(b) for b in buffer]))
        if n == 0 and buffer:  # not full yet: report the plain moments of what is held
            n, mean, m2 = combine(0, 0.0, 0.0, np.array(buffer))
        yield pd.DataFrame(
            {"code": [key[0]], "unit": [key[1]], "salt": [key[2]], "n": [n], "mean": [mean], "m2": [m2]}
        )

    salted = stream.withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int"))
    return salted.groupBy("code", "unit", "salt").applyInPandasWithState(
        update,
        "code string, unit string, salt int, n long, mean double, m2 double",
        _STATE,
        "update",
        GroupStateTimeout.NoTimeout,
    )


def merge_salted(states: DataFrame) -> DataFrame:
    """``code, unit, n, mean, std`` pooled over salts."""
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / total
    second = F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")) / total
    return (
        states.filter("n > 0")
        .groupBy("code", "unit")
        .agg(total.alias("n"), mean.alias("mean"), F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))).alias("std"))
    )


def run_append(stream: DataFrame, label: str) -> DataFrame:
    """Drive an append stream over all available input into parquet and read it back."""
    spark = stream.sparkSession
    out, marks = new_folder(spark, label), new_folder(spark, f"{label}-marks")
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", marks)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_latest(stream: DataFrame, label: str, mode: str, keys: list[str]) -> DataFrame:
    """Drive an update or complete stream into a table of batches; the latest row of each key is the result."""
    spark = stream.sparkSession
    out, marks = new_folder(spark, label), new_folder(spark, f"{label}-marks")

    def write(df: DataFrame, batch_id: int) -> None:
        # overwriting the batch's own folder makes a repeated batch harmless
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", marks)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    batches = spark.read.option("basePath", out).parquet(out)
    return batches.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
