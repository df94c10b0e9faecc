"""Sketches of values: far-out values go wherever they come, and neither windows nor the order of merging matter."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.session import new_folder
from eventloom.streaming import sketches as S
from eventloom.streaming import visits as X

SCHEMA = "time timestamp, code string, unit string, value double"


def values_with_outliers(n=6000):
    values = np.random.default_rng(7).normal(10, 2, n)
    values[:60] = 900.0  # the first of all
    values[-40:] = -500.0
    return values


def frame(spark, values, code="a", unit=None):
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    return spark.createDataFrame([(t0 + timedelta(hours=i), code, unit, float(v)) for i, v in enumerate(values)], SCHEMA)


def sketch(df, *by):
    return df.filter(S.usable(F.col("value"))).groupBy("code", "unit", *by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", S.SKETCH_K).alias("sketch"))


def check(row, values, deviations=3.0):
    error = S.rank_error()
    for q, r in ((row.q25, 0.25), (row.median, 0.5), (row.q75, 0.75)):
        assert (values < q).mean() <= r + error and (values <= q).mean() >= r - error
    kept = values[(values >= row.low) & (values <= row.high)]
    assert abs(row.n_kept - len(kept)) <= len(values) * (2 * error + 1 / S.GRID)
    assert row.mean == pytest.approx(kept.mean(), abs=0.1) and row.std == pytest.approx(kept.std(), rel=0.05)


def test_outliers_do_not_stay(spark):
    values = values_with_outliers()
    row = S.robust_stats(sketch(frame(spark, values))).first()
    assert row.n == len(values) and -2 < row.low < row.high < 22
    check(row, values)


def test_merging_in_any_order(spark):
    values = values_with_outliers()
    df = frame(spark, values).withColumn("part", F.floor(F.rand(3) * 40).cast("int"))
    parts = sketch(df, "part")
    for groups in (1, 3, 40):
        some = S.merge_sketches(parts.withColumn("g", F.col("part") % groups), ("code", "unit", "g"))
        row = S.robust_stats(S.merge_sketches(some)).first()
        assert row.n == len(values)
        check(row, values)


def test_stream_of_windows(spark):
    values = values_with_outliers()
    df = frame(spark, values).unionByName(frame(spark, [0.0, float("nan"), 5.0], "b", "u")).unionByName(frame(spark, [0.0], "c"))
    folder = new_folder(spark, "values")
    df.repartition(5).write.parquet(folder)
    windows, left = X.run_closed(spark.readStream.schema(SCHEMA).parquet(folder), S.sketch_stream, "sketches")
    assert left == 0 and windows.filter("code = 'a'").count() >= 8
    rows = {r.code: r for r in S.robust_stats(S.merge_sketches(windows)).collect()}
    assert set(rows) == {"a", "b"} and (rows["b"].n, rows["b"].mean, rows["b"].std, rows["b"].n_kept) == (1, 5.0, 0.0, 1)
    assert rows["a"].n == len(values)
    check(rows["a"], values)
