"""Queries on features, simple models, evaluation and table checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import bucket
from ..operators import clean as P
from ..operators import features as L
from ..operators import metrics as M
from ..operators import quality as Q
from ..session import new_folder, stage
from ..sources import adapters as A
from ..sources import io
from .cohort_queries import COHORT_CTE, FRACTIONS, SPLIT_CTE, cohort
from .cohort_queries import hash_split as split_query
from .sequences import EVENT_LOG_CTES, event_log_sequence

QUERIES: dict = {}


def add(name, sql=None):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


def rounded(df, columns=None):
    """Six digits as SQL's round gives them: a ratio like 41/640 = 0.0640625 is rounded as the double it is times a million."""
    columns = columns or [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(F.col(c) * 1e6, 0) / 1e6 for c in columns})


# ---- features ----------------------------------------------------------------------------------------------------

_CELLS = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings"


@add("l1_mean_pool", f"SELECT label, dim::INT AS dim, round(avg(x), 6) AS mean FROM ({_CELLS}) GROUP BY 1, 2")
def mean_pool(spark, d):
    return rounded(L.mean_pool(A.table(spark, d, "embeddings"), ["label"], "embedding"))


@add(
    "l2_mean_over_sequence",
    f"SELECT label, dim::INT AS dim, round(avg(x), 6) AS mean FROM ({_CELLS}) WHERE vec_id % 4 <> 0 GROUP BY 1, 2",
)
def mean_over_sequence(spark, d):
    valid = F.col("vec_id") % 4 != 0
    return rounded(L.mean_over_sequence(A.table(spark, d, "embeddings"), ["label"], valid, "embedding"))


@add("l3_first_vector", "SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS x0 FROM embeddings WHERE label = 0")
def first_vector(spark, d):
    e = A.table(spark, d, "embeddings").withColumn("token", F.when(F.col("label") == 0, "[CLS]").otherwise("[VS]"))
    return L.first_vector(e).select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("x0"))


@add(
    "l4_concept_frequencies",
    f"""WITH {EVENT_LOG_CTES}, c AS (SELECT subject_id AS person_id, token, count(*) AS n FROM logseq GROUP BY 1, 2)
SELECT person_id, token, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY person_id)), 6) AS weight FROM c""",
)
def concept_frequencies(spark, d):
    seq = event_log_sequence(spark, d).withColumnRenamed("subject_id", "person_id")
    return rounded(L.concept_frequencies(seq))


@add(
    "l4_scaled_age",
    f"""SELECT person_id, round((age - (SELECT avg(age) FROM a)) / (SELECT stddev_pop(age) FROM a), 6) AS scaled FROM a""".replace(
        "FROM a)", f"FROM (SELECT date_sub('year', birth, TIMESTAMP '2001-01-01') AS age FROM ({A.PEOPLE_SQL})))"
    ).replace("FROM a", f"FROM (SELECT person_id, date_sub('year', birth, TIMESTAMP '2001-01-01') AS age FROM ({A.PEOPLE_SQL})) a"),
)
def scaled_age(spark, d):
    from ..functions.timing import completed_years

    at = F.lit("2001-01-01").cast("timestamp")
    p = A.people(spark, d).select("person_id", completed_years(F.col("birth"), at).alias("age"))
    return rounded(L.scale(p, "age", "scaled").select("person_id", "scaled"))


def _training(spark, d):
    e = A.table(spark, d, "embeddings").withColumn("label", (F.col("label") < 5).cast("int"))
    return L.assemble(e, "embedding").select("vec_id", "features", "label")


def _unseen():
    return bucket(42, F.col("vec_id")) < 200_000


@add("l5_logistic_regression")
def logistic_regression(spark, d):
    """Two penalties, 20 strengths, five folds; scored on the fifth of the rows that no fit has seen."""
    data = stage(_training(spark, d), "training")
    strengths = [10.0 ** (-4 + 8 * i / 19) for i in range(20)]
    model = L.fit_logistic(data.filter(~_unseen()), c_values=strengths, penalties=[0.0, 1.0], folds=5)
    return L.predict(model, data.filter(_unseen()), "vec_id")


@add("l6_boosted_trees")
def boosted_trees(spark, d):
    """The default number of rounds; scored on the fifth of the rows that were not fitted."""
    data = stage(_training(spark, d), "training")
    return L.predict(L.fit_gbt(data.filter(~_unseen())), data.filter(_unseen()), "vec_id")


@add("l7_sigmoid", "SELECT doc_id, round(1 / (1 + exp(-(n_chars - 2000) / 1000e0)), 6) AS p FROM documents")
def sigmoid(spark, d):
    x = (F.col("n_chars") - 2000) / 1000.0
    return A.table(spark, d, "documents").select("doc_id", F.round(L.sigmoid(x), 6).alias("p"))


@add(
    "l8_modes",
    "SELECT l_quantity, n FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1) WHERE n = (SELECT max(n) FROM "
    "(SELECT count(*) AS n FROM lineitem GROUP BY l_quantity))",
)
def modes(spark, d):
    return L.modes(A.table(spark, d, "lineitem"), "l_quantity")


@add(
    "l9_enrich",
    """SELECT o_orderkey, coalesce(g, 0) AS gender_id, coalesce(r, 0) AS race_id FROM orders LEFT JOIN
(SELECT CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS k, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 2 + 1)::INT END AS g, c_nationkey AS r
FROM customer) ON o_custkey = k""",
)
def enrich(spark, d):
    key = F.col("c_custkey")
    demo = A.table(spark, d, "customer").select(  # some have no key, some no gender
        F.when(key % 3 != 0, key).alias("o_custkey"),
        F.when(key % 5 != 0, (key % 2 + 1).cast("int")).alias("gender_id"),
        F.col("c_nationkey").alias("race_id"),
    )
    orders = A.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return L.enrich(orders, demo, ["o_custkey"], ["gender_id", "race_id"]).select("o_orderkey", "gender_id", "race_id")


# ---- evaluation --------------------------------------------------------------------------------------------------


def cleaned(spark, d, label="quality"):
    return P.clean_predictions(A.predictions(spark, d, label))


def scores(spark, d, label="quality"):
    return M.score_table(cleaned(spark, d, label))


def order_scores(spark, d, unlabelled=True):
    """Many distinct scores: the price of an order as a probability that it is urgent."""
    o = A.table(spark, d, "orders")
    p = F.col("o_totalprice") / F.lit(1_000_000.0)
    return M.score_table(o.select(p.alias("p"), (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("y")), unlabelled)


PRED_CTE = f"""pr AS (SELECT predicted_boolean_probability AS p, boolean_value::INT AS y FROM ({A.predictions_sql()})),
sc AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg, count(*) AS n FROM pr GROUP BY 1),
cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, (SELECT sum(pos) FROM sc) AS np, (SELECT sum(neg) FROM sc) AS nn
  FROM sc WINDOW w AS (ORDER BY p DESC))"""
ORDER_CTE = PRED_CTE.replace(
    f"SELECT predicted_boolean_probability AS p, boolean_value::INT AS y FROM ({A.predictions_sql()})",
    "SELECT o_totalprice / 1000000e0 AS p, (o_orderpriority = '1-URGENT')::INT AS y FROM orders",
)


@add("p11_clean_predictions", f"SELECT subject_id, predicted_boolean_probability AS p, boolean_value::INT::DOUBLE AS y FROM ({A.predictions_sql()}) WHERE subject_id % 17 <> 0")
def clean_predictions(spark, d):
    df = A.predictions(spark, d)
    nan = F.when(F.col("subject_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("predicted_boolean_probability"))
    return P.clean_predictions(df.withColumn("predicted_boolean_probability", nan))


_AUC = "SELECT round(sum(neg * (tp - pos / 2)) / (any_value(np)::DOUBLE * any_value(nn)), 6) AS auroc FROM cu"


@add("a1_roc_auc", f"WITH {PRED_CTE} {_AUC}")
def roc_auc(spark, d):
    return rounded(M.roc_auc(scores(spark, d)))


@add("a1_roc_auc_orders", f"WITH {ORDER_CTE} {_AUC}")
def roc_auc_orders(spark, d):
    return rounded(M.roc_auc(order_scores(spark, d)))


@add("a2_average_precision", f"WITH {PRED_CTE} SELECT round(sum(pos * tp / (tp + fp)) / any_value(np), 6) AS auprc FROM cu")
def average_precision(spark, d):
    return rounded(M.average_precision(scores(spark, d)))


@add(
    "a3_pr_auc",
    f"""WITH {PRED_CTE}, pt AS (SELECT p, tp / np AS r, tp / (tp + fp) AS q FROM cu), lg AS (SELECT r, q, coalesce(lag(r) OVER (ORDER BY p DESC), 0) AS r0,
  coalesce(lag(q) OVER (ORDER BY p DESC), 1) AS q0 FROM pt) SELECT round(sum((r - r0) * (q + q0) / 2), 6) AS pr_auc FROM lg""",
)
def pr_auc(spark, d):
    return rounded(M.pr_auc(scores(spark, d)))


@add("a4_prevalence", f"WITH {PRED_CTE} SELECT count(*) AS n, sum(y)::BIGINT AS positives, sum(1 - y)::BIGINT AS negatives, round(avg(y), 6) AS prevalence FROM pr")
def prevalence(spark, d):
    return rounded(M.prevalence(scores(spark, d)))


@add("a5_roc_points", f"WITH {ORDER_CTE} SELECT p AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr, tp::BIGINT AS tp, fp::BIGINT AS fp FROM cu UNION ALL SELECT 'infinity'::DOUBLE, 0, 0, 0, 0")
def roc_points(spark, d):
    return rounded(M.roc_points(order_scores(spark, d, unlabelled=False)), ["fpr", "tpr"])


@add("a5_pr_points", f"WITH {ORDER_CTE} SELECT p AS threshold, round(tp / np, 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM cu UNION ALL SELECT NULL, 0, 1")
def pr_points(spark, d):
    return rounded(M.pr_points(order_scores(spark, d)), ["recall", "precision"])


_YOUDEN = "SELECT p AS threshold FROM cu ORDER BY round(tp / np - fp / nn, 12) DESC, p DESC LIMIT 1"
_SENSITIVE = "SELECT max(p) AS threshold FROM cu WHERE tp / np >= 0.9"
_F1 = """SELECT p AS threshold FROM (SELECT p, tp / np AS r, tp / (tp + fp) AS q FROM cu) WHERE r + q > 0
ORDER BY round(2 * q * r / (q + r), 12) DESC, p LIMIT 1"""
for _method, _sql in (("youden", _YOUDEN), ("high_sensitivity", _SENSITIVE), ("best_f1", _F1)):
    QUERIES[f"a6_threshold_{_method}"] = (
        lambda spark, d, m=_method: M.select_threshold(scores(spark, d), m),
        f"WITH {PRED_CTE} {_sql}",
    )


def _confusion_sql(op: str) -> str:
    return f"""WITH {PRED_CTE}, c AS (SELECT sum(CASE WHEN p {op} 0.5 THEN y END)::BIGINT AS tp, sum(CASE WHEN p {op} 0.5 THEN 1 - y END)::BIGINT AS fp,
  sum(CASE WHEN NOT p {op} 0.5 THEN 1 - y END)::BIGINT AS tn, sum(CASE WHEN NOT p {op} 0.5 THEN y END)::BIGINT AS fn FROM pr)
SELECT *, 0.5::DOUBLE AS threshold, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(tp / (tp + fp), 6) AS ppv,
  round(tn / (tn + fn), 6) AS npv, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""


@add("a7_threshold_metrics", _confusion_sql(">="))
def threshold_metrics(spark, d):
    return rounded(M.threshold_metrics(scores(spark, d), 0.5))


@add("a7_threshold_metrics_strict", _confusion_sql(">"))
def threshold_metrics_strict(spark, d):
    return rounded(M.threshold_metrics(scores(spark, d), 0.5, strict=True))


@add("a8_brier", f"WITH {PRED_CTE} SELECT round(avg((p - y) ** 2), 6) AS brier FROM pr")
def brier(spark, d):
    return rounded(M.brier(scores(spark, d)))


def _reliability_cte(cte: str, uniform: bool) -> str:
    edges = (
        "SELECT [i / 10e0 FOR i IN range(0, 11)] AS e"
        if uniform
        else "SELECT list_sort(list_distinct(quantile_cont(p, [i / 10e0 FOR i IN range(0, 11)]))) AS e FROM pr"
    ).replace("[i / 10e0 FOR i IN range(0, 11)]", str([i / 10 for i in range(11)]) + "::DOUBLE[]")
    return f"""{cte}, ed AS ({edges}),
bn AS (SELECT p, y, least(len(list_filter(e[2:len(e) - 1], lambda x: x <= p)), len(e) - 2)::INT AS bin FROM pr, ed),
rel AS (SELECT bin, avg(p) AS mean_p, avg(y) AS observed, count(*) AS n FROM bn GROUP BY 1)"""


_REL = "SELECT bin, round(mean_p, 6) AS mean_p, round(observed, 6) AS observed, n FROM rel"


@add("a9_reliability_quantile", f"WITH {_reliability_cte(PRED_CTE, False)} {_REL}")
def reliability_quantile(spark, d):
    return rounded(M.reliability(scores(spark, d)))


@add("a9_reliability_uniform", f"WITH {_reliability_cte(ORDER_CTE, True)} {_REL}")
def reliability_uniform(spark, d):
    return rounded(M.reliability(order_scores(spark, d), strategy="uniform"))


@add("a9_calibration_error", f"WITH {_reliability_cte(PRED_CTE, False)} SELECT round(sum(n * abs(observed - mean_p)) / sum(n), 6) AS ece FROM rel")
def calibration_error(spark, d):
    return rounded(M.calibration_error(M.reliability(scores(spark, d))))


@add(
    "a10_calibration_fit",
    f"""WITH RECURSIVE {PRED_CTE}, t AS (SELECT ln(q / (1 - q)) AS x, pos, n FROM (SELECT greatest(1e-7, least(1 - 1e-7, p)) AS q, pos, n FROM sc)),
newton AS (SELECT 0 AS i, 0e0 AS a, 0e0 AS b
  UNION ALL SELECT i + 1, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1), b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1)
  FROM (SELECT i, a, b, sum(r) AS g0, sum(r * x) AS g1, sum(w) AS h0, sum(w * x) AS h1, sum(w * x * x) AS h2
    FROM (SELECT i, a, b, x, n * m * (1 - m) AS w, pos - n * m AS r
      FROM (SELECT i, a, b, x, pos, n, 1 / (1 + exp(-(a + b * x))) AS m FROM newton, t WHERE i < 30)) GROUP BY i, a, b))
SELECT round(b, 6) AS slope, round(a, 6) AS intercept FROM newton WHERE i = 30""",
)
def calibration_fit(spark, d):
    slope, intercept = M.calibration_fit(scores(spark, d))
    return rounded(spark.createDataFrame([(slope, intercept)], "slope double, intercept double"))


@add("a11_bootstrap")
def bootstrap(spark, d):
    return M.bootstrap(scores(spark, d), 2000)


@add(
    "a12_perplexity",
    "SELECT round(exp(-avg(ln((l_quantity + 1) / 60))), 6) AS perplexity FROM lineitem WHERE l_linenumber % 3 = 0",
)
def perplexity(spark, d):
    rows = A.table(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") % 3 == 0, F.col("l_linenumber")).otherwise(-100).alias("label_id"),
        F.log((F.col("l_quantity") + 1) / 60).alias("log_p"),
    )
    return rounded(M.perplexity(rows))


@add("a13_report")
def report(spark, d):
    return M.evaluate(cleaned(spark, d), cleaned(spark, d, "toxic"), n_resamples=2000)


# ---- table checks ------------------------------------------------------------------------------------------------


def _omop_folder(spark, d):
    """The test tables written under relational names, once as a folder and once as a single file."""
    root = new_folder(spark, "tables")
    people = A.people(spark, d).select("person_id", F.lit(0).alias("gender_concept_id"), F.year("birth").alias("year_of_birth"))
    io.write_table(people, f"{root}/person")
    visits = A.visits(spark, d).select(
        F.col("visit_id").alias("visit_occurrence_id"), "person_id", F.col("visit_type").alias("visit_concept_id"),
        F.to_date("visit_start").alias("visit_start_date"),
    )
    io.write_table(visits, f"{root}/visit_occurrence")
    io.write_table(A.conditions(spark, d), f"{root}/condition_occurrence.parquet")
    io.write_table(A.concepts(spark, d).select("concept_id"), f"{root}/concept")
    return root


@add(
    "v1_check_tables",
    """SELECT t || ' ' || part AS "check", CASE WHEN part = 'not empty' THEN (SELECT count(*) FROM customer) > 0 ELSE t || part <> 'conceptcolumns' END AS ok,
  'error' AS level FROM (SELECT unnest(['person', 'visit_occurrence', 'condition_occurrence', 'concept']) AS t)
  CROSS JOIN (SELECT unnest(['present', 'columns', 'not empty']) AS part)
UNION ALL SELECT unnest(['drug_exposure', 'procedure_occurrence', 'measurement']) || ' present', FALSE, 'warning'""",
)
def check_tables(spark, d):
    return Q.check_tables(spark, _omop_folder(spark, d)).select("check", "ok", "level")


@add(
    "v2_prediction_counts",
    f"""SELECT count(*) AS n, sum((predicted_boolean_probability IS NULL)::INT)::BIGINT AS missing_p,
  sum((predicted_boolean_probability NOT BETWEEN 0 AND 1)::INT)::BIGINT AS outside_p, sum(boolean_value::INT)::BIGINT AS positives,
  sum((NOT boolean_value)::INT)::BIGINT AS negatives FROM ({A.predictions_sql()})""",
)
def prediction_counts(spark, d):
    return Q.prediction_counts(A.predictions(spark, d))


@add(
    "v2_check_predictions",
    f"""WITH p AS ({A.predictions_sql()}) SELECT 'predictions not empty' AS "check", count(*) > 0 AS ok, count(*)::VARCHAR AS detail, 'error' AS level FROM p
UNION ALL SELECT 'probabilities present', count(*) FILTER (predicted_boolean_probability IS NULL) = 0, '0', 'error' FROM p
UNION ALL SELECT 'probabilities within 0 and 1', bool_and(predicted_boolean_probability BETWEEN 0 AND 1), '0', 'error' FROM p
UNION ALL SELECT 'both classes', count(DISTINCT boolean_value) = 2, (count(*) FILTER (boolean_value))::VARCHAR, 'error' FROM p""",
)
def check_predictions(spark, d):
    return Q.check_predictions(A.predictions(spark, d))


@add("v3_split_counts", f"WITH {SPLIT_CTE} SELECT split, count(*) AS n, 0::BIGINT AS missing_key FROM sp GROUP BY 1")
def split_counts(spark, d):
    return Q.split_counts(split_query(spark, d))


@add(
    "v3_check_splits",
    f"""WITH {SPLIT_CTE} SELECT 'split ' || s AS "check", count(person_id) > 0 AS ok, count(person_id)::VARCHAR AS detail, 'error' AS level
FROM (VALUES ('{"'), ('".join([*FRACTIONS, 'held_out'])}')) x(s) LEFT JOIN sp ON split = s GROUP BY s""",
)
def check_splits(spark, d):
    return Q.check_splits(split_query(spark, d), [*FRACTIONS, "held_out"])


def _schema_sql(cohort: str) -> str:
    return f"""WITH {COHORT_CTE}, c AS ({cohort})
SELECT 'cohort columns' AS "check", true AS ok, 'person_id, index_date, label' AS detail, 'error' AS level
UNION ALL SELECT unnest(['person_id type', 'index_date type', 'label type']), true, unnest(['bigint', 'date', 'int']), 'error'
UNION ALL SELECT 'cohort not empty', count(*) > 0, count(*)::VARCHAR, 'error' FROM c
UNION ALL SELECT 'person_id present', count(person_id) = count(*), (count(*) - count(person_id))::VARCHAR, 'error' FROM c
UNION ALL SELECT 'index_date present', count(index_date) = count(*), (count(*) - count(index_date))::VARCHAR, 'error' FROM c
UNION ALL SELECT 'label within 0 and 1', count(*) FILTER (label IN (0, 1)) = count(*), (count(*) - count(*) FILTER (label IN (0, 1)))::VARCHAR, 'error' FROM c"""


@add("v4_check_schema", _schema_sql("FROM cohort"))
def check_schema(spark, d):
    return Q.check_schema(cohort(spark, d))


@add(
    "v4_check_schema_faults",
    _schema_sql("""SELECT CASE WHEN person_id % 5 <> 0 THEN person_id END AS person_id, CASE WHEN person_id % 7 <> 0 THEN index_date END AS index_date,
  CASE person_id % 9 WHEN 0 THEN 2 WHEN 1 THEN NULL ELSE label END AS label FROM cohort"""),
)
def check_schema_faults(spark, d):
    """Some rows have lost their person, date or label."""
    key = F.col("person_id")
    faults = {
        "index_date": F.when(key % 7 != 0, F.col("index_date")),
        "label": F.when(key % 9 == 0, 2).when(key % 9 != 1, F.col("label")),
        "person_id": F.when(key % 5 != 0, key),
    }
    return Q.check_schema(cohort(spark, d).withColumns(faults))


@add("v5_check_nonempty", "SELECT 'sequences not empty' AS \"check\", count(*) > 0 AS ok, '' AS detail, 'error' AS level FROM events")
def check_nonempty(spark, d):
    return Q.check_nonempty(event_log_sequence(spark, d), "sequences")
