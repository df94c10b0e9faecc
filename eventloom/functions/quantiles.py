"""Exact quantiles by distributed rank selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .scan import double_levels, ordered_scan


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], weight: str | None = None
) -> DataFrame:
    """One row per group with ``n`` and ``q0, q1, …``: linearly interpolated quantiles.

    ``weight`` names a column of row multiplicities. Values are reduced to (group, value, count) with map-side combining and ranked by a bucketed scan, so no task sees a
    whole group; the built-in exact percentile keeps a group's values in one buffer.
    """
    if not by:  # one group: give it a constant key, so that its single total row joins like any other
        return exact_quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, probs, weight).drop("__all")
    by = list(by)
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = stage(df.groupBy(*by, F.col(value).alias("__x")).agg(size.alias("__c")), "value-counts")
    ranked = ordered_scan(counts, by, double_levels(F.col("__x")), [F.col("__x")], sums={"__upto": F.col("__c")})
    totals = counts.groupBy(*by).agg(F.sum("__c").alias("n"))
    ranked = ranked.join(totals, by)
    aggs = []
    for i, q in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(float(q))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("__upto") > rank) & (F.col("__upto") - F.col("__c") <= rank)
            aggs.append(F.max(F.when(hit, F.col("__x"))).alias(f"__{side}{i}"))
    picked = ranked.groupBy(*by).agg(F.max("n").alias("n"), *aggs)
    out = []
    for i, q in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(f"q{i}"))
    return picked.select(*by, "n", *out)
