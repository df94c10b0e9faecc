"""Vocabulary, encoding, and robust statistics of numeric values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import unit_draw
from ..functions.quantiles import exact_quantiles
from ..session import stage
from .sequence import NO_UNIT

# The special tokens and their ids.
SPECIAL_TOKENS = ("[PAD]", "[MASK]", "[OOV]", "[CLS]", "[UNUSED]")
PAD_ID, MASK_ID, OOV_ID, CLS_ID, UNUSED_ID = range(5)
OOV = "[OOV]"

STATS_KEY = ["concept_id", "unit"]


def build_vocab(seq: DataFrame, size: int = 50_000, min_freq: int = 0) -> DataFrame:
    """``token, id, n``: special tokens first, then by count descending and token ascending, ``size`` in all."""
    counts = (
        seq.filter(~F.col("token").isin(*SPECIAL_TOKENS))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_freq)
    )
    order = [F.desc("n"), F.asc("token")]
    top = stage(counts.orderBy(*order).limit(size - len(SPECIAL_TOKENS)), "vocabulary")  # one pass over the tokens
    rank = F.row_number().over(Window.orderBy(*order))  # over at most ``size`` rows
    words = top.select("token", (rank + len(SPECIAL_TOKENS) - 1).cast("int").alias("id"), "n")
    specials = seq.sparkSession.createDataFrame(
        [(t, i, 0) for i, t in enumerate(SPECIAL_TOKENS)], "token string, id int, n long"
    )
    return specials.unionByName(words)


def encode(seq: DataFrame, vocab: DataFrame) -> DataFrame:
    """``token_id`` per token; unknown tokens get the out-of-vocabulary id."""
    ids = vocab.select("token", F.col("id").alias("token_id"))
    out = seq.join(ids, "token", "left")
    return out.withColumn("token_id", F.coalesce("token_id", F.lit(OOV_ID)))


def decode(ids: DataFrame, vocab: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``token`` per ``token_id`` and, given ``names (token, name)``, its name (the token itself where it has none)."""
    words = vocab.select(F.col("id").alias("token_id"), "token")
    out = ids.join(words, "token_id", "left").withColumn("token", F.coalesce("token", F.lit(OOV)))
    if names is not None:
        out = out.join(names.select("token", "name"), "token", "left")
        out = out.withColumn("name", F.coalesce("name", "token"))
    return out


def normal_share(k: float) -> float:
    """Share of a normal distribution below ``k`` standard deviations."""
    return 0.5 * (1.0 + math.erf(k / math.sqrt(2.0)))


def lab_stats(values: DataFrame, k: float = 3.0, exact: bool = True) -> DataFrame:
    """Robust mean and deviation per (concept, unit).

    ``values`` has ``concept_id, unit, value, value_mask``. Masked-out, zero and NaN values are left out; the rest are
    kept between the quantiles that ``k`` standard deviations of a normal distribution would mark, and described.
    Defined as one exact two-pass computation, so the result does not depend on row order or batches. Values without a unit
    have the filler unit.
    ``exact=False`` takes the quantiles from a mergeable sketch in a single pass.
    """
    usable = values.filter((F.col("value_mask") == 1) & (F.col("value") != 0) & ~F.isnan("value"))
    usable = usable.select("concept_id", F.coalesce("unit", F.lit(NO_UNIT)).alias("unit"), "value")
    lo, hi = normal_share(-k), normal_share(k)
    if exact:
        bounds = exact_quantiles(usable, STATS_KEY, "value", [lo, hi]).drop("n")
    else:
        q = F.percentile_approx("value", [lo, hi], 10_000)
        bounds = usable.groupBy(*STATS_KEY).agg(q.alias("q")).select(
            *STATS_KEY, F.col("q")[0].alias("q0"), F.col("q")[1].alias("q1")
        )
    kept = usable.join(bounds, STATS_KEY).filter(F.col("value").between(F.col("q0"), F.col("q1")))
    out = kept.groupBy(*STATS_KEY).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("count")
    )
    return out.select(
        *STATS_KEY,
        "mean",
        "std",
        "count",
        F.lit(float(k)).alias("value_outlier_std"),
        (F.col("mean") - k * F.col("std")).alias("lower_bound"),
        (F.col("mean") + k * F.col("std")).alias("upper_bound"),
    )


def normalize(values: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds ``normalized``: the clipped z-score where there is a value and known statistics, else the value."""
    known = stats.select(*STATS_KEY, "mean", "std", "value_outlier_std")
    k = F.col("value_outlier_std")
    z = F.when(F.col("std") > 0, (F.col("value") - F.col("mean")) / F.col("std")).otherwise(F.lit(0.0))
    clipped = F.greatest(-k, F.least(k, z))
    use = (F.col("value_mask") == 1) & F.col("mean").isNotNull()
    known = known.withColumnsRenamed({"concept_id": "__concept", "unit": "__unit"})
    same = (F.col("concept_id") == F.col("__concept")) & (F.coalesce("unit", F.lit(NO_UNIT)) == F.col("__unit"))
    out = values.join(known, same, "left").drop("__concept", "__unit")
    return out.withColumn("normalized", F.when(use, clipped).otherwise(F.col("value"))).drop(
        "mean", "std", "value_outlier_std"
    )


def unit_distribution(stats: DataFrame) -> DataFrame:
    """``probability`` of each unit within its concept, and the upper end ``upto`` of its share in unit order."""
    # a concept has a handful of units: stats hold one row per (concept, unit)
    by = Window.partitionBy("concept_id")
    total = F.sum("count").over(by)
    share = F.when(total > 0, F.col("count") / total).otherwise(F.lit(1.0))
    upto = F.sum("count").over(by.orderBy("unit")) / total
    return stats.select(*STATS_KEY, share.alias("probability"), F.when(total > 0, upto).otherwise(1.0).alias("upto"))


def denormalize(values: DataFrame, stats: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``unit`` drawn by frequency and the value on its scale; unknown concepts keep their value and get the filler unit.

    The draw is a seeded hash of ``key`` (a unique column), so a retried task draws the same units.
    ``values`` has ``concept_id, normalized`` and ``key``.
    """
    ends = unit_distribution(stats).join(stats.select(*STATS_KEY, "mean", "std"), STATS_KEY)
    shares = ends.groupBy("concept_id").agg(
        F.array_sort(F.collect_list(F.struct("upto", "unit", "mean", "std"))).alias("units")
    )
    out = values.join(shares, "concept_id", "left").withColumn("__u", unit_draw(seed, F.col(key)))
    pick = F.get(F.filter("units", lambda e: e["upto"] > F.col("__u")), F.lit(0))
    pick = F.coalesce(pick, F.element_at("units", -1))
    out = out.withColumn("__pick", pick)
    value = F.when(F.col("__pick").isNull(), F.col("normalized")).otherwise(
        F.col("normalized") * F.col("__pick.std") + F.col("__pick.mean")
    )
    return out.withColumns({"unit": F.coalesce("__pick.unit", F.lit(NO_UNIT)), "value": value}).drop("units", "__u", "__pick")


def with_labels(seq: DataFrame) -> DataFrame:
    """Training labels start as a copy of the ids."""
    return seq.withColumn("label_id", F.col("token_id"))


def check_lengths(arrays: DataFrame, left: str = "input_ids", right: str = "labels") -> DataFrame:
    """Rows whose two arrays differ in length."""
    return arrays.filter(F.size(left) != F.size(right))
