"""Inputs without rows, with one class, with nulls in keys: every case has a defined result and no row is lost."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import batches as B
from eventloom.operators import cohort as C
from eventloom.operators import features as L
from eventloom.operators import metrics as M
from eventloom.operators import quality as Q
from eventloom.operators import visits as V

PREDICTIONS = "p double, y int"
ONE_CLASS = {"positives": [(0.1 * i, 1) for i in range(1, 10)], "negatives": [(0.1 * i, 0) for i in range(1, 10)], "nothing": []}


@pytest.mark.parametrize("name", ONE_CLASS)
def test_metrics_of_one_class(spark, name):
    df = spark.createDataFrame(ONE_CLASS[name], PREDICTIONS)
    scores = M.score_table(df)
    assert M.roc_auc(scores).first()[0] is None
    defined = name == "positives"
    assert M.average_precision(scores).first()[0] == (1.0 if defined else None) and M.pr_auc(scores).first()[0] == (1.0 if defined else None)
    rows = {r.metric: r for r in M.bootstrap(scores, n=50).collect()}
    assert set(rows) == {"auroc", "auprc", "brier"} and rows["auroc"].value is None and rows["auroc"].lo is None
    assert (rows["brier"].value is None) == (name == "nothing")
    report = {(r.section, r.metric): r.value for r in M.evaluate(df, n_resamples=20).collect()}
    assert report["discrimination", "auroc"] is None and math.isnan(report["calibration", "slope"])
    assert (report["calibration", "ece"] is None) == (name == "nothing")


def test_strip_structural_loses_no_other_event(spark):
    events = spark.createDataFrame(
        [(1, 1, 1, None), (1, 1, 2, "IP"), (1, 1, 3, "a"), (1, 9, 4, "IP"), (1, None, 5, "IP"), (1, 1, 6, "home"), (2, 1, 7, "home"), (None, 1, 8, "x")],
        "subject_id long, visit_id long, event_id long, code string",
    )
    blocks = spark.createDataFrame([(1, 1, "IP", "home"), (2, 1, None, None)], "subject_id long, visit_id long, visit_type string, discharged_to string")
    kept = V.strip_structural(events, blocks)
    assert sorted(r.event_id for r in kept.collect()) == [1, 3, 4, 5, 7, 8] and set(kept.columns) == set(events.columns)


def test_folds_of_rows_without_a_label(spark, split_everything):
    rows = [(i, None if i % 3 == 0 else i % 2) for i in range(3000)]
    folds = C.stratified_folds(spark.createDataFrame(rows, "k long, y int"), "y", "k", 5)
    sizes = {(r.y, r.fold): r["count"] for r in folds.groupBy("y", "fold").count().collect()}
    assert sizes == {(y, f): 200 for y in (None, 0, 1) for f in range(5)} and folds.columns == ["k", "y", "fold"]


def next_fit(needs, budget):
    packs, used, current, slot = [], 0, 0, 0
    for need in needs:
        if slot and used + need > budget:
            current, used, slot = current + 1, 0, 0
        packs.append((current, slot))
        used, slot = used + need, slot + 1
    return packs


@pytest.mark.parametrize("budget, longest", [(64, 30), (16, 100), (2, 5), (1000, 3)])
def test_packing_is_next_fit(spark, budget, longest):
    lengths = np.random.default_rng(budget).integers(0, longest + 1, 500)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "person_id long, length long")
    packed = B.pack(df, budget, 50, shards=3).withColumn("h", B.hash32(42, F.col("person_id"))).toPandas()
    assert len(packed) == 500
    for _, shard in packed.sort_values(["h", "person_id"]).groupby("shard"):
        want = next_fit([min(n, 50) + 2 for n in shard["length"]], budget)
        assert list(zip(shard["pack"], shard["slot"])) == want


@pytest.mark.parametrize("lengths, want", [([0, 0, 0], 1), ([], 1), ([500, 500], 2), ([10, 10, 10, 10], 2), ([100], 1)])
def test_estimates(spark, lengths, want):
    df = spark.createDataFrame([(n,) for n in lengths], "length long")
    assert B.estimate_packs(df, 20, 1000).first()["packs"] == want


def test_members_of_packs_are_pooled(spark):
    packs = spark.createDataFrame(
        [(0, 0, [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0], [5.0, 6.0], None]), (0, 1, [[1.0, 1.0]]), (1, 0, [[2.0, 2.0]])],
        "shard int, pack long, vectors array<array<double>>",
    )
    ranges = spark.createDataFrame(
        [(0, 0, 1, 7, 1, 2), (0, 0, 2, 8, 4, 5), (0, 1, 1, 9, 1, 3), (0, 1, 2, 10, 2, 3)],
        "shard int, pack long, sample long, person_id long, from_pos long, to_pos long",
    )
    got = {r.person_id: r.vector for r in L.pool_packed(packs, ranges).collect()}
    assert got == {7: [2.0, 3.0], 8: [5.0, 6.0], 9: [1.0, 1.0], 10: []}


def test_schema_checks_read_rows(spark):
    good = [(1, date(2020, 1, 1), 0), (2, date(2020, 1, 1), 1)]
    bad = [(None, date(2020, 1, 1), 0), (2, None, 1), (3, date(2020, 1, 1), 7), (4, date(2020, 1, 1), None)]
    schema = "person_id long, index_date date, label int"
    ok = lambda df: {r["check"]: (r["ok"], r["detail"]) for r in Q.check_schema(df).collect()}
    assert all(v[0] for v in ok(spark.createDataFrame(good, schema)).values())
    found = ok(spark.createDataFrame(bad, schema))
    assert found["person_id present"] == (False, "1") and found["index_date present"] == (False, "1") and found["label within 0 and 1"] == (False, "2")
    assert ok(spark.createDataFrame([], schema))["cohort not empty"] == (False, "0")
    assert ok(spark.createDataFrame([(1, "2020", 0)], "person_id long, index_date string, label int"))["index_date type"] == (False, "string")
    theirs = spark.createDataFrame([(1, date(2020, 1, 1), True)], "subject_id long, prediction_time date, boolean_value boolean")
    assert all(v[0] for v in ok(theirs).values())


def plain_logistic(x, y, strength, rounds=50):
    """Newton steps on the mean log loss with an L2 penalty on the coefficients of features of unit deviation."""
    scaled = np.column_stack([np.ones(len(x)), x / x.std(axis=0, ddof=1)])
    penalty = strength * np.diag([0.0] + [1.0] * x.shape[1])
    beta = np.zeros(scaled.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-scaled @ beta))
        gradient = scaled.T @ (p - y) / len(y) + penalty @ beta
        beta -= np.linalg.solve((scaled * (p * (1 - p))[:, None]).T @ scaled / len(y) + penalty, gradient)
    return 1 / (1 + np.exp(-scaled @ beta))


@pytest.mark.parametrize("c", [0.01, 1.0, 100.0])
def test_logistic_regression_is_the_plain_fit(spark, c):
    rng = np.random.default_rng(6)
    x = rng.normal(0, [1, 3, 0.2], (300, 3))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.0, -0.4, 2.0] + 0.3)))).astype(int)
    df = spark.createDataFrame([(i, row.tolist(), int(t)) for i, (row, t) in enumerate(zip(x, y))], "k long, v array<double>, label int")
    data = L.assemble(df, "v")
    got = {r.k: r.p for r in L.predict(L.fit_logistic(data, [c], [0.0], folds=2), data, "k").collect()}
    want = plain_logistic(x, y, 1 / (c * 300))
    assert max(abs(got[i] - want[i]) for i in range(300)) < 2e-3


def test_calibration_is_the_plain_fit(spark):
    rng = np.random.default_rng(8)
    p = np.round(rng.random(800), 3)
    y = (rng.random(800) < p**2).astype(int)
    slope, intercept = M.calibration_fit(M.score_table(spark.createDataFrame(list(zip(p.tolist(), y.tolist())), PREDICTIONS)))
    q = np.clip(p, 1e-7, 1 - 1e-7)
    x, b = np.column_stack([np.ones(800), np.log(q / (1 - q))]), np.zeros(2)
    for _ in range(50):
        m = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x * (m * (1 - m))[:, None]).T @ x, x.T @ (y - m))
    assert (intercept, slope) == (pytest.approx(b[0], abs=1e-6), pytest.approx(b[1], abs=1e-6))
