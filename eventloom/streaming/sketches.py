"""Robust value statistics on streams: a quantile sketch for each (code, unit) and stretch of time, merged in any order.

The state of a stream is one KLL sketch per key and window of event time; Spark keeps and merges it like any other aggregate, on the map side
too, and drops it when the window has closed. Sketches of windows, partitions or tables merge into one, and the gate is set on the
merged sketch: the median and so many robust deviations, a deviation being the distance of the quartiles over that of a normal
distribution. What is far out is left out wherever it came in the stream, the first values included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .visits import open_to_closing

SKETCH_K = 2000
GRID = 400
#: Distance of the quartiles of a normal distribution in standard deviations.
QUARTILES = 1.3489795003921634


def rank_error(k: int = SKETCH_K) -> float:
    """By how much of the whole a sketch may misplace a value, with 99 % confidence (the sketch's own formula)."""
    return 2.296 / k**0.9021


def usable(value: Column) -> Column:
    """Whether a value counts: it is there, a number, and not zero."""
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (value != 0), F.lit(False))


def sketch_stream(stream: DataFrame, every: str = "30 days", delay: str = "1 day", k: int = SKETCH_K) -> DataFrame:
    """``code, unit, from_time, n, sketch`` of each window of ``every``; append output, a window is told when it has closed.

    ``stream`` has ``time, code, unit, value``. Null codes and units are keys like others.
    """
    timed = open_to_closing(stream, delay, usable(F.col("value")))
    grouped = timed.groupBy("code", "unit", F.window("time", every).alias("__window"))
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", k).alias("sketch"))
    return out.select("code", "unit", F.col("__window.start").alias("from_time"), "n", "sketch")


def merge_sketches(parts: DataFrame, by: tuple[str, ...] = ("code", "unit"), k: int = SKETCH_K) -> DataFrame:
    """``by``, n and sketch: those of all parts of a key together."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def robust_stats(merged: DataFrame, deviations: float = 3.0) -> DataFrame:
    """Adds ``q25, median, q75, low, high, n_kept, mean, std``: quartiles, the gate, and count and moments of what lies in it.

    Moments are those of ``GRID`` evenly spaced quantiles. Where half of the values are equal the gate holds those alone.
    """
    at = lambda *ranks: F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(r) for r in ranks]))
    out = merged.withColumns({"__q": at(0.25, 0.5, 0.75), "__grid": at(*[(i + 0.5) / GRID for i in range(GRID)])})
    out = out.withColumns({name: F.col("__q")[i] for i, name in enumerate(("q25", "median", "q75"))})
    reach = deviations * (F.col("q75") - F.col("q25")) / QUARTILES
    out = out.withColumns({"low": F.col("median") - reach, "high": F.col("median") + reach})
    out = out.withColumn("__kept", F.filter("__grid", lambda x: (x >= F.col("low")) & (x <= F.col("high"))))
    size = F.size("__kept").cast("double")
    mean = F.aggregate("__kept", F.lit(0.0), lambda s, x: s + x, lambda s: F.try_divide(s, size))
    out = out.withColumns({"n_kept": F.round(F.col("n") * size / GRID).cast("long"), "mean": mean})
    square = F.aggregate("__kept", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean")), lambda s: F.try_divide(s, size))
    return out.withColumn("std", F.sqrt(square)).drop("__q", "__grid", "__kept")
