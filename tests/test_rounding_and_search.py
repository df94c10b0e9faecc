"""Six digits as SQL gives them; threads of a grid search keep to themselves."""

import threading

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from eventloom.operators import features as L
from eventloom.operators import metrics as M
from eventloom.plans.model_queries import rounded


def test_rates_are_rounded_as_sql_rounds(spark, duck):
    """With 640 negatives 41/640 is 0.0640625: halves go the way of the double times a million."""
    p = spark.range(641).select((F.col("id") / 1000).alias("p"), (F.col("id") == 640).cast("double").alias("y"))
    got = {r.fp: r.fpr for r in rounded(M.roc_points(M.score_table(p)), ["fpr", "tpr"]).collect()}
    want = dict(duck.execute("SELECT i, round(i::HUGEINT / 640::HUGEINT, 6) FROM range(641) r(i)").fetchall())
    assert got == want


def test_threads_of_a_search_share_no_properties(spark, monkeypatch):
    rows = spark.range(60).select((F.col("id") % 2).alias("label"), array_to_vector(F.array(F.col("id") / 60, (F.col("id") % 7) / 7)).alias("features"))
    seen, evaluate = [], BinaryClassificationEvaluator._evaluate

    def watched(self, dataset):
        own = spark._jvm.java.lang.System.identityHashCode(spark.sparkContext._jsc.sc().getLocalProperties())
        seen.append((threading.get_ident(), own))
        return evaluate(self, dataset)

    monkeypatch.setattr(BinaryClassificationEvaluator, "_evaluate", watched)
    L.fit_logistic(rows, [0.1, 1.0, 10.0], [0.0, 1.0], folds=2)
    assert len(seen) == 12
    holders = {}
    for thread, own in seen:
        holders.setdefault(own, set()).add(thread)
    assert all(len(threads) == 1 for threads in holders.values())
