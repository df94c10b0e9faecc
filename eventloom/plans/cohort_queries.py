"""Queries on cohorts, index-dated extraction, splits and training batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches as B
from ..operators import cohort as C
from ..operators import features as L
from ..operators import sequence as S
from ..operators import tokens as T
from ..session import stage
from ..sources import adapters as A
from ..sources import io
from .sequences import EVENT_LOG_CTES, event_log_sequence
from .token_queries import LOG_VOCAB_CTE

QUERIES: dict = {}


def add(name, sql=None):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


def hash_sql(seed, *keys: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"({k})" for k in keys]])
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


# ---- cohorts -----------------------------------------------------------------------------------------------------

PATTERN = ["Brand#13:ECONOMY"]


def cohort(spark, d):
    visits = A.visits(spark, d).select("person_id", F.to_date("visit_start").alias("visit_start_date"))
    return C.case_control(
        A.people(spark, d), visits, A.conditions(spark, d), A.concepts(spark, d), PATTERN, gap_days=90, min_history_days=365
    )


COHORT_CTE = f"""fc AS (SELECT person_id, min(condition_start_date) AS f FROM ({A.CONDITIONS_SQL}) WHERE condition_concept_id IN
  (SELECT concept_id FROM ({A.CONCEPTS_SQL}) WHERE regexp_matches(concept_code, 'Brand#13:ECONOMY')) GROUP BY 1),
fv AS (SELECT person_id, min(CAST(visit_start AS DATE)) AS a, max(CAST(visit_start AS DATE)) AS z FROM ({A.visits_sql()}) GROUP BY 1),
c0 AS (SELECT p.person_id, CAST(coalesce(f, z) - INTERVAL 90 DAY AS DATE) AS index_date, (f IS NOT NULL)::INT AS label, a
  FROM ({A.PEOPLE_SQL}) p LEFT JOIN fv USING (person_id) LEFT JOIN fc USING (person_id)),
cohort AS (SELECT person_id, index_date, label FROM c0 WHERE a < index_date AND date_diff('day', a, index_date) >= 365)"""


@add("c1_case_control", f"WITH {COHORT_CTE} SELECT * FROM cohort")
def case_control(spark, d):
    return cohort(spark, d)


@add(
    "c2_restrict",
    f"WITH {COHORT_CTE} SELECT * FROM cohort WHERE person_id IN (SELECT CASE WHEN o_custkey % 5 < 3 THEN o_custkey END FROM orders)",
)
def restrict(spark, d):
    ids = A.visits(spark, d).withColumn("person_id", F.expr("if(person_id % 5 < 3, person_id, null)"))
    return C.restrict(cohort(spark, d), ids)


FRACTIONS = {"test": 0.2, "validation": 0.1, "train": 0.7}
SPLIT_CTE = f"""{COHORT_CTE}, hb AS (SELECT *, {hash_sql(42, 'person_id')} % 1000000 AS b FROM cohort),
sp AS (SELECT person_id, index_date, label, CASE WHEN b < 200000 THEN 'test' WHEN b < 300000 THEN 'validation' ELSE 'train' END AS split FROM hb)"""


@add("c3_hash_split", f"WITH {SPLIT_CTE} SELECT * FROM sp")
def hash_split(spark, d):
    return C.hash_split(cohort(spark, d), "person_id", FRACTIONS)


@add(
    "c4_split_stats",
    f"""WITH {SPLIT_CTE} SELECT split, count(*) AS size, sum(label)::BIGINT AS cases, sum(1 - label)::BIGINT AS controls,
  round(avg(label), 4) AS prevalence, min(index_date) AS first_date, max(index_date) AS last_date FROM sp GROUP BY 1""",
)
def split_stats(spark, d):
    return C.split_stats(C.hash_split(cohort(spark, d), "person_id", FRACTIONS))


@add(
    "c4_leaked_people",
    f"""WITH {SPLIT_CTE}, more AS (SELECT person_id, split FROM sp UNION ALL SELECT person_id, 'test' FROM sp WHERE person_id % 11 = 0)
SELECT person_id FROM more GROUP BY 1 HAVING count(DISTINCT split) > 1""",
)
def leaked(spark, d):
    """A sound split, and the people of one class in eleven put into the test part once more."""
    split = C.hash_split(cohort(spark, d), "person_id", FRACTIONS).select("person_id", "split")
    again = split.filter("person_id % 11 = 0").withColumn("split", F.lit("test"))
    return C.leaked(split.unionByName(again))


def log_index_dates(spark, d):
    """Two index dates for every user of the event log."""
    first = A.log_events(spark, d).groupBy("subject_id").agg(F.min("time").alias("t"))
    at = F.explode(F.array(*[F.col("t") + F.expr(f"INTERVAL {n} DAYS") for n in (10, 20)]))
    return first.select(
        F.col("subject_id").alias("person_id"), at.alias("index_date"), (F.col("subject_id") % 3 == 0).cast("int").alias("label")
    )


_INDEX = f"""SELECT subject_id AS person_id, unnest([t + INTERVAL 10 DAY, t + INTERVAL 20 DAY]) AS index_date, (subject_id % 3 = 0)::INT AS label
  FROM (SELECT subject_id, min(time) AS t FROM ({A.LOG_EVENTS_SQL}) GROUP BY 1)"""


def _log_tokens(spark, d):
    e = A.log_events(spark, d)
    return e.select(
        F.col("subject_id").alias("person_id"), F.col("event_id").alias("pos"), F.col("code").alias("token"),
        (F.unix_micros("time") / F.lit(1e6)).alias("epoch"),
    )


@add(
    "c5_cut_at_index",
    f"""WITH c AS ({_INDEX}) SELECT e.subject_id AS person_id, event_id AS pos, code AS token, index_date, label, -1 AS age_at_index
FROM ({A.LOG_EVENTS_SQL}) e JOIN c ON e.subject_id = c.person_id WHERE time <= index_date""",
)
def cut_at_index(spark, d):
    out = C.cut_at_index(_log_tokens(spark, d), log_index_dates(spark, d))
    return out.select("person_id", "pos", "token", "index_date", "label", "age_at_index")


@add(
    "c5_cut_at_index_window",
    f"""WITH c AS ({_INDEX}) SELECT e.subject_id AS person_id, event_id AS pos, code AS token, index_date, label
FROM ({A.LOG_EVENTS_SQL}) e JOIN c ON e.subject_id = c.person_id WHERE time BETWEEN index_date - INTERVAL 5 DAY AND index_date""",
)
def cut_at_index_window(spark, d):
    out = C.cut_at_index(_log_tokens(spark, d), log_index_dates(spark, d), 5)
    return out.select("person_id", "pos", "token", "index_date", "label")


@add(
    "c5_index_ranges",
    f"""WITH c AS ({_INDEX}), e AS (SELECT subject_id AS person_id, time FROM ({A.LOG_EVENTS_SQL}))
SELECT person_id, index_date, label, count(time) FILTER (time < index_date - INTERVAL 5 DAY) + 1 AS from_at, count(time) FILTER (time <= index_date) AS to_at
FROM c LEFT JOIN e USING (person_id) GROUP BY ALL""",
)
def index_ranges(spark, d):
    return C.index_ranges(_log_tokens(spark, d), log_index_dates(spark, d), 5)


@add(
    "c5_copy_ranges",
    f"""WITH c AS ({_INDEX}) SELECT e.subject_id AS person_id, event_id AS pos, code AS token, index_date, label
FROM ({A.LOG_EVENTS_SQL}) e JOIN c ON e.subject_id = c.person_id WHERE time BETWEEN index_date - INTERVAL 5 DAY AND index_date""",
)
def copy_ranges(spark, d):
    """As the windowed cut, by ranges of places."""
    seq = _log_tokens(spark, d)
    ranges = stage(C.index_ranges(seq, log_index_dates(spark, d), 5), "index-ranges")
    return C.copy_ranges(C.time_ranks(seq), ranges).select("person_id", "pos", "token", "index_date", "label")


@add(
    "c6_missing_subjects",
    f"WITH {COHORT_CTE} SELECT * FROM cohort WHERE person_id NOT IN (SELECT user_id FROM events)",
)
def missing_subjects(spark, d):
    return C.missing_subjects(cohort(spark, d), _log_tokens(spark, d))


@add(
    "c7_finetune_columns",
    f"""WITH {COHORT_CTE} SELECT person_id, date_sub('year', birth, CAST(index_date AS TIMESTAMP))::INT AS age_at_index, label AS classifier_label,
  epoch_us(CAST(index_date AS TIMESTAMP)) / 1e6 AS index_date FROM cohort JOIN ({A.PEOPLE_SQL}) p USING (person_id)""",
)
def finetune_columns(spark, d):
    c = cohort(spark, d).join(A.people(spark, d).select("person_id", "birth"), "person_id")
    age = C.completed_years(F.col("birth"), F.col("index_date").cast("timestamp"))
    return C.finetune_columns(c.withColumn("age", age))


@add(
    "p9_nullable_index_date",
    f"""WITH c AS ({_INDEX}) SELECT person_id, label, coalesce(CASE WHEN person_id % 4 <> 0 THEN epoch_us(index_date) / 1e6 END, -1) AS index_epoch FROM c""",
)
def nullable_index_date(spark, d):
    c = log_index_dates(spark, d).withColumn("index_date", F.when(F.col("person_id") % 4 != 0, F.col("index_date")))
    return c.select("person_id", "label", F.coalesce(C.to_epoch(F.col("index_date")), F.lit(-1.0)).alias("index_epoch"))


@add("c8_random_split")
def random_split(spark, d):
    parts = C.random_split(A.people(spark, d).select("person_id"), [0.8, 0.2], 42)
    train, val = (p.withColumn("split", F.lit(n)) for p, n in zip(parts, ("train", "validation")))
    return train.unionByName(val)


@add(
    "c8_split_by_patient",
    f"""SELECT o_orderkey, o_custkey, CASE WHEN {hash_sql(7, 'o_custkey')} % 1000000 < 800000 THEN 'train' ELSE 'validation' END AS split FROM orders""",
)
def split_by_patient(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return C.hash_split(o, "o_custkey", {"train": 0.8, "validation": 0.2}, 7)


@add(
    "c9_count_split",
    f"""SELECT c_custkey AS person_id, CASE WHEN row_number() OVER (ORDER BY {hash_sql(42, 'c_custkey')}, c_custkey) <= 100
  THEN 'validation' ELSE 'train' END AS split FROM customer""",
)
def count_split(spark, d):
    return C.count_split(A.people(spark, d).select("person_id"), "person_id", 100)


@add(
    "c10_patient_splits",
    f"""SELECT c_custkey AS person_id, CASE WHEN b < 700000 THEN 'train' WHEN b < 850000 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT c_custkey, {hash_sql(42, 'c_custkey')} % 1000000 AS b FROM customer)""",
)
def patient_splits(spark, d):
    people = A.people(spark, d).select("person_id")
    return C.hash_split(people, "person_id", {"train": 0.7, "validation": 0.15, "test": 0.15})


@add("c11_pool_splits", f"WITH {SPLIT_CTE} SELECT person_id, 'test' AS split FROM sp")
def pool_splits(spark, d):
    df = C.hash_split(cohort(spark, d), "person_id", FRACTIONS)
    return C.pool_splits(df).select("person_id", "split")


@add("c12_skip_done", f"WITH c AS ({_INDEX}) SELECT * FROM c WHERE NOT (person_id % 2 = 0 AND day(index_date) % 2 = 0)")
def skip_done(spark, d):
    c = log_index_dates(spark, d)
    done = c.filter((F.col("person_id") % 2 == 0) & (F.dayofmonth("index_date") % 2 == 0)).select("person_id", "index_date")
    return C.skip_done(c, done)


@add(
    "c13_outcome_cohort",
    f"""WITH i AS (SELECT person_id, CAST(visit_end AS DATE) AS index_date FROM ({A.visits_sql()}) WHERE visit_type = 'Visit/IP'),
o AS (SELECT person_id, CAST(visit_start AS DATE) AS outcome_date FROM ({A.visits_sql()}) WHERE visit_type IN ('Visit/IP', 'Visit/ER')),
f AS (SELECT person_id, min(CAST(visit_start AS DATE)) AS first FROM ({A.visits_sql()}) GROUP BY 1),
x AS (SELECT i.person_id, i.index_date, date_sub('year', birth, CAST(i.index_date AS TIMESTAMP))::INT AS age,
  (EXISTS (SELECT 1 FROM o WHERE o.person_id = i.person_id AND date_diff('day', i.index_date, o.outcome_date) BETWEEN 1 AND 90))::INT AS label, first
  FROM i JOIN f USING (person_id) JOIN ({A.PEOPLE_SQL}) p USING (person_id))
SELECT person_id, index_date, age, label FROM x WHERE date_diff('day', first, index_date) >= 360 AND age BETWEEN 18 AND 60
  AND index_date BETWEEN DATE '1996-01-01' AND DATE '2001-01-01'""",
)
def outcome_cohort(spark, d):
    v = A.visits(spark, d)
    index = v.filter("visit_type = 'Visit/IP'").select("person_id", F.to_date("visit_end").alias("index_date"))
    outcomes = v.filter("visit_type IN ('Visit/IP', 'Visit/ER')").select("person_id", F.to_date("visit_start").alias("outcome_date"))
    observed = v.select("person_id", F.to_date("visit_start").alias("observed_from"))
    return C.outcome_cohort(
        index, outcomes, A.people(spark, d), observed, obs_days=360, pred_start=0, pred_end=90, ages=(18, 60),
        dates=("1996-01-01", "2001-01-01"),
    )


_EARLY = 1_900_000_000  # seconds: moves the event log to before 1970


@add(
    "c5_cut_at_index_before_1970",
    f"""WITH c AS ({_INDEX}) SELECT e.subject_id AS person_id, event_id AS pos, label
FROM ({A.LOG_EVENTS_SQL}) e JOIN c ON e.subject_id = c.person_id WHERE time BETWEEN index_date - INTERVAL 15 DAY AND index_date""",
)
def cut_at_index_before_1970(spark, d):
    seq = _log_tokens(spark, d).withColumn("epoch", F.col("epoch") - _EARLY)
    index = log_index_dates(spark, d).withColumn("index_date", F.col("index_date") - F.make_dt_interval(secs=F.lit(_EARLY)))
    return C.cut_at_index(seq, index, 15).select("person_id", "pos", "label")


@add(
    "c15_stratified_split_unlabelled",
    f"""WITH {COHORT_CTE}, u AS (SELECT person_id, CASE WHEN person_id % 4 <> 0 THEN label END AS label FROM cohort),
r AS (SELECT person_id, label, row_number() OVER (PARTITION BY label ORDER BY {hash_sql(42, 'person_id')}, person_id) AS i,
  count(*) OVER (PARTITION BY label) AS n FROM u)
SELECT person_id, coalesce(label, -1) AS label, CASE WHEN i <= floor(n * 0.15::DOUBLE + 0.5) THEN 'test' ELSE 'train' END AS split FROM r""",
)
def stratified_split_unlabelled(spark, d):
    df = cohort(spark, d).withColumn("label", F.when(F.col("person_id") % 4 != 0, F.col("label")))
    out = C.stratified_split(df, "label", "person_id")
    return out.select("person_id", F.coalesce("label", F.lit(-1)).alias("label"), "split")


@add(
    "c16_chronological_split_undated",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 29 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders),
d AS (SELECT day, count(*) AS n FROM o WHERE day IS NOT NULL GROUP BY 1),
r AS (SELECT day, (sum(n) OVER (ORDER BY day) - n) / (SELECT sum(n) FROM d) AS before FROM d)
SELECT o_orderkey, CASE WHEN o.day IS NULL THEN NULL WHEN before < 0.7 THEN 'train' WHEN before < 0.85::DOUBLE THEN 'validation' ELSE 'test' END AS split
FROM o LEFT JOIN r ON o.day = r.day""",
)
def chronological_split_undated(spark, d):
    t = F.when(F.col("o_orderkey") % 29 != 0, F.col("o_orderdate").cast("timestamp"))
    o = A.table(spark, d, "orders").select("o_orderkey", t.alias("t"))
    return C.chronological_split(o, "t", {"train": 0.7, "validation": 0.15, "test": 0.15}).select("o_orderkey", "split")


@add("c14_subsample", f"SELECT o_orderkey FROM orders WHERE {hash_sql(42, 'o_orderkey')} % 1000000 < 50000")
def subsample(spark, d):
    return C.subsample(A.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.05)


@add(
    "c15_stratified_folds",
    f"""WITH {COHORT_CTE}, given AS (SELECT person_id, CASE WHEN person_id % 4 <> 0 THEN label END AS label FROM cohort)
SELECT person_id, coalesce(label, -1) AS label, ((row_number() OVER (PARTITION BY label ORDER BY {hash_sql(42, 'person_id')}, person_id) - 1) % 5)::INT
  AS fold FROM given""",
)
def stratified_folds(spark, d):
    """Some rows have no label."""
    some = cohort(spark, d).withColumn("label", F.when(F.col("person_id") % 4 != 0, F.col("label")))
    folds = C.stratified_folds(some, "label", "person_id", 5)
    return folds.select("person_id", F.coalesce("label", F.lit(-1)).alias("label"), "fold")


@add(
    "c15_stratified_split",
    f"""WITH {COHORT_CTE}, r AS (SELECT person_id, label, row_number() OVER (PARTITION BY label ORDER BY {hash_sql(42, 'person_id')}, person_id) AS i,
  count(*) OVER (PARTITION BY label) AS n FROM cohort)
SELECT person_id, label, CASE WHEN i <= floor(n * 0.15::DOUBLE + 0.5) THEN 'test' ELSE 'train' END AS split FROM r""",
)
def stratified_split(spark, d):
    return C.stratified_split(cohort(spark, d), "label", "person_id").select("person_id", "label", "split")


@add(
    "c16_chronological_split",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT day, (sum(n) OVER (ORDER BY day) - n) / (SELECT count(*) FROM orders) AS before FROM d)
SELECT o_orderkey, CASE WHEN before < 0.7 THEN 'train' WHEN before < 0.85::DOUBLE THEN 'validation' ELSE 'test' END AS split
FROM orders JOIN r ON day = CAST(o_orderdate AS DATE)""",
)
def chronological_split(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    out = C.chronological_split(o, "t", {"train": 0.7, "validation": 0.15, "test": 0.15})
    return out.select("o_orderkey", "split")


@add(
    "c17_named_split",
    "SELECT c_custkey AS person_id, CASE WHEN c_custkey IN (SELECT user_id FROM events) THEN 'test' ELSE 'train' END AS split FROM customer",
)
def named_split(spark, d):
    ids = A.table(spark, d, "events").select(F.col("user_id").alias("person_id"))
    return C.named_split(A.people(spark, d).select("person_id"), ids)


@add(
    "s8_cohort_source",
    f"""SELECT subject_id AS person_id, boolean_value::INT AS label, predicted_boolean_probability AS index_value
FROM ({A.predictions_sql()})""",
)
def cohort_source(spark, d):
    df = io.cohort_columns(A.predictions(spark, d), event_names=True)
    return df.select("person_id", "label", F.col("predicted_boolean_probability").alias("index_value"))


# ---- training batches --------------------------------------------------------------------------------------------


def _log_sequence(spark, d):
    return event_log_sequence(spark, d).withColumnRenamed("subject_id", "person_id")


_SEQ = f"{EVENT_LOG_CTES}, s AS (SELECT subject_id AS person_id, pos, token, max(pos) OVER (PARTITION BY subject_id) AS n FROM logseq)"
MAX_LEN = 65
_M = MAX_LEN - 1
_SEED_DRAW = hash_sql(42, "person_id", "pos")
_TAIL = f"coalesce(min(pos) FILTER (token = '[VS]' AND pos > n - {_M}), any_value(n) - {_M} + 1)"


def _truncate_sql(start: str, complete: bool = False) -> str:
    cut = (
        """, cuts AS (SELECT person_id, max(pos) - 1 AS c FROM s JOIN lim USING (person_id) WHERE token = '[VE]' AND pos > f AND pos <= t GROUP BY 1),
  fin AS (SELECT person_id, f, coalesce(c, t) AS t FROM lim LEFT JOIN cuts USING (person_id))"""
        if complete
        else ", fin AS (SELECT * FROM lim)"
    )
    return f"""WITH {_SEQ}, st AS (SELECT person_id, any_value(n) AS n, {start} AS f FROM s WHERE n > {_M} GROUP BY person_id),
  lim AS (SELECT person_id, f, least(f + {_M} - 1, n) AS t FROM st){cut}
SELECT s.person_id, pos - coalesce(f - 1, 0) AS pos, token FROM s LEFT JOIN fin USING (person_id) WHERE f IS NULL OR pos BETWEEN f AND t"""


_DRAWN = f"coalesce(arg_min(pos, {_SEED_DRAW}) FILTER (token = '[VS]' AND pos <= n - {_M}), {_TAIL})"


@add("b1_truncate_tail", _truncate_sql(_TAIL))
def truncate_tail(spark, d):
    return B.truncate(_log_sequence(spark, d), MAX_LEN).select("person_id", "pos", "token")


@add("b2_truncate_random", _truncate_sql(f"any_value({hash_sql(42, 'person_id')} % (n - {_M} + 1) + 1)"))
def truncate_random(spark, d):
    return B.truncate(_log_sequence(spark, d), MAX_LEN, "random").select("person_id", "pos", "token")


@add("b2_truncate_random_right", _truncate_sql(_DRAWN))
def truncate_random_right(spark, d):
    return B.truncate(_log_sequence(spark, d), MAX_LEN, "random_right").select("person_id", "pos", "token")


@add("b2_truncate_random_complete", _truncate_sql(_DRAWN, True))
def truncate_random_complete(spark, d):
    return B.truncate(_log_sequence(spark, d), MAX_LEN, "random_complete").select("person_id", "pos", "token")


@add(
    "b3_mask_tokens",
    f"""WITH {LOG_VOCAB_CTE}, m AS (SELECT subject_id AS person_id, pos, id AS token_id FROM logseq JOIN vocab USING (token)),
h AS (SELECT *, {hash_sql('42:choose', 'person_id', 'pos')} % 1000000 / 1e6 AS c, {hash_sql('42:kind', 'person_id', 'pos')} % 1000000 / 1e6 AS k,
  {hash_sql('42:word', 'person_id', 'pos')} % (SELECT max(id) + 1 FROM vocab) AS w FROM m)
SELECT person_id, pos, (CASE WHEN c < 0.15 THEN CASE WHEN k < 0.8 THEN 1 WHEN k < 0.9 THEN w ELSE token_id END ELSE token_id END)::INT AS masked_id,
  (CASE WHEN c < 0.15 THEN token_id ELSE -100 END)::INT AS label_id FROM h""",
)
def mask_tokens(spark, d):
    seq = stage(_log_sequence(spark, d), "log-sequence")
    vocab = stage(T.build_vocab(seq), "log-vocabulary")
    size = vocab.agg(F.max("id") + 1).first()[0]
    return B.mask_tokens(T.encode(seq, vocab), vocab_size=size).select("person_id", "pos", "masked_id", "label_id")


def _side_columns(spark, d):
    """Encoded event log tokens with simple side columns."""
    seq = stage(_log_sequence(spark, d), "log-sequence")
    ids = T.encode(seq, T.build_vocab(seq))
    return ids.select(
        "person_id", "pos", "token", "token_id", (F.col("visit_id") % 90).cast("int").alias("age"),
        (F.col("pos") % 7).cast("int").alias("week"), F.col("visit_id").alias("visit_order"),
        (F.col("pos") / 4).alias("value"), (F.col("pos") % 2).cast("int").alias("value_mask"),
        (1 + (F.col("visit_id") - 1) % 2).cast("int").alias("segment"),
    )


_SIDES = f"""{LOG_VOCAB_CTE}, side AS (SELECT subject_id AS person_id, pos, token, id AS token_id, visit_id % 90 AS age, pos % 7 AS week, visit_id AS visit_order,
  pos / 4 AS value, pos % 2 AS value_mask, 1 + (visit_id - 1) % 2 AS segment, max(pos) OVER (PARTITION BY subject_id) AS n FROM logseq JOIN vocab USING (token))"""

_SIDE_NAMES = {
    "input_ids": ("token_id", "3", "0"),
    "ages": ("age", None, "0"),
    "dates": ("week", None, "0"),
    "concept_value_masks": ("value_mask", "0", "0"),
    "visit_segments": ("segment", "0", "0"),
    "visit_concept_orders": ("visit_order", "greatest(first(visit_order ORDER BY pos) - 1, 0)", str(MAX_LEN - 1)),
}
_CUT = f"""lim AS (SELECT person_id, coalesce(min(pos) FILTER (token = '[VS]' AND pos > n - {_M}), any_value(n) - {_M} + 1) AS f FROM side WHERE n > {_M} GROUP BY 1),
cut AS (SELECT side.*, coalesce(f, 1) AS f FROM side LEFT JOIN lim USING (person_id) WHERE f IS NULL OR pos >= f)"""


@add(
    "b4_pad_rows",
    f"WITH {_SIDES}, {_CUT} SELECT person_id, "
    + ", ".join(
        f"{lead if lead is not None else f'first({c} ORDER BY pos)'} || ' ' || string_agg({c}, ' ' ORDER BY pos) || "
        f"repeat(' {pad}', {_M} - count(*)) AS {name}"
        for name, (c, lead, pad) in _SIDE_NAMES.items()
    )
    + f", '1' || repeat(' 1', count(*)) || repeat(' 0', {_M} - count(*)) AS attention_mask FROM cut GROUP BY person_id",
)
def pad_rows(spark, d):
    cut = B.truncate(_side_columns(spark, d), MAX_LEN)
    names = {"token_id": "input_ids", "age": "ages", "week": "dates", "visit_order": "visit_concept_orders", "value": "concept_values",
             "value_mask": "concept_value_masks", "segment": "visit_segments"}
    cut = cut.withColumnsRenamed(names)
    padded = B.pad_rows(S.to_arrays(cut, list(names.values())), MAX_LEN)
    cols = [*_SIDE_NAMES, "attention_mask"]
    return padded.select(
        "person_id", *[F.concat_ws(" ", F.transform(c, lambda x: x.cast("string"))).alias(c) for c in cols]
    )


def _lengths(spark, d):
    turns = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("person_id"))
    return turns.agg(F.sum("l_quantity").cast("long").alias("length"))


_LENGTHS = "SELECT l_orderkey AS person_id, sum(l_quantity)::BIGINT AS length FROM lineitem GROUP BY 1"
_PACK = dict(max_tokens=1024, max_pos=200, per_shard=2500)
_SHARDS = "(SELECT greatest(1, ceil(count(*) / {}::DOUBLE))::BIGINT FROM len)"
PACK_CTE = f"""len AS ({_LENGTHS}), dealt AS (SELECT *, {hash_sql(42, 'person_id')} AS h FROM len),
ord AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY h, person_id) AS i, least(length, 200) + 2 AS need
  FROM (SELECT *, h % {_SHARDS.format(2500)} AS shard FROM dealt)),
pk AS (SELECT person_id, length, shard, i, 0::BIGINT AS pack, 0 AS slot, need AS used FROM ord WHERE i = 1
  UNION ALL SELECT o.person_id, o.length, o.shard, o.i, p.pack + (p.used + o.need > 1024)::INT, CASE WHEN p.used + o.need > 1024 THEN 0 ELSE p.slot + 1 END,
    CASE WHEN p.used + o.need > 1024 THEN o.need ELSE p.used + o.need END FROM pk p JOIN ord o ON o.shard = p.shard AND o.i = p.i + 1)"""


@add("b5_pack", f"WITH RECURSIVE {PACK_CTE} SELECT person_id, length, shard::INT AS shard, pack, slot::INT AS slot FROM pk")
def pack(spark, d):
    return B.pack(_lengths(spark, d), **_PACK)


@add(
    "b6_estimate_packs",
    f"""SELECT count(*) AS n, sum(least(length, 200))::BIGINT // count(*) AS avg_len,
  greatest(count(*) // (1024 // (sum(least(length, 200))::BIGINT // count(*))), 1)::BIGINT * 2 AS packs FROM ({_LENGTHS})""",
)
def estimate_packs(spark, d):
    return B.estimate_packs(_lengths(spark, d), 1024, 200, replicas=2)


def _packed(spark, d):
    cut = stage(B.truncate(_side_columns(spark, d), 200, packing=True), "cut")
    lengths = cut.groupBy("person_id").agg(F.count(F.lit(1)).alias("length"))
    return B.packed_rows(cut, B.pack(lengths, 512, 200, per_shard=400))


_PACKED = f"""{_SIDES}, lim AS (SELECT person_id, coalesce(min(pos) FILTER (token = '[VS]' AND pos > n - 200), any_value(n) - 200 + 1) AS f FROM side
  WHERE n > 200 GROUP BY 1),
cut AS (SELECT side.* REPLACE (pos - coalesce(f - 1, 0) AS pos) FROM side LEFT JOIN lim USING (person_id) WHERE f IS NULL OR pos >= f),
len AS (SELECT person_id, count(*) AS length FROM cut GROUP BY 1), dealt AS (SELECT *, {hash_sql(42, 'person_id')} AS h FROM len),
ord AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY h, person_id) AS i, length + 2 AS need FROM (SELECT *, h % {_SHARDS.format(400)} AS shard FROM dealt)),
pk AS (SELECT person_id, length, shard, i, 0::BIGINT AS pack, need AS used FROM ord WHERE i = 1
  UNION ALL SELECT o.person_id, o.length, o.shard, o.i, p.pack + (p.used + o.need > 512)::INT,
    CASE WHEN p.used + o.need > 512 THEN o.need ELSE p.used + o.need END FROM pk p JOIN ord o ON o.shard = p.shard AND o.i = p.i + 1),
body AS (SELECT person_id, pos, token_id, 1 AS attention, age, week, visit_order, value, value_mask, segment FROM cut
  UNION ALL SELECT person_id, 0, 3, 1, first(age ORDER BY pos), first(week ORDER BY pos), greatest(first(visit_order ORDER BY pos) - 1, 0), -1, 0, 0 FROM cut GROUP BY 1
  UNION ALL SELECT person_id, max(pos) + 1, 0, 0, 0, 0, last(visit_order ORDER BY pos), -1, 0, 0 FROM cut GROUP BY 1),
packed AS (SELECT shard::INT AS shard, pack, row_number() OVER (PARTITION BY shard, pack ORDER BY i, pos) AS pack_pos, person_id, token_id::INT AS token_id, attention,
  age::INT AS age, week::INT AS week, visit_order, value::DOUBLE AS value, value_mask::INT AS value_mask, segment::INT AS segment
  FROM body JOIN pk USING (person_id))"""


@add("b7_packed_rows", f"WITH RECURSIVE {_PACKED} SELECT * FROM packed")
def packed_rows(spark, d):
    return _packed(spark, d)


@add(
    "b8_segment_ids",
    f"""WITH RECURSIVE {_PACKED} SELECT shard, pack, pack_pos, CASE WHEN attention = 1 THEN 1 + sum(1 - attention) OVER
  (PARTITION BY shard, pack ORDER BY pack_pos) ELSE 0 END::BIGINT AS sample FROM packed""",
)
def segment_ids(spark, d):
    return B.segment_ids(_packed(spark, d)).select("shard", "pack", "pack_pos", "sample")


@add("b8_is_packed", f"WITH RECURSIVE {_PACKED} SELECT shard, pack, count(DISTINCT person_id) > 1 AS packed FROM packed GROUP BY 1, 2")
def is_packed(spark, d):
    return B.is_packed(_packed(spark, d))


@add(
    "l1_packed_pool",
    f"""WITH RECURSIVE {_PACKED}, seg AS (SELECT shard, pack, pack_pos, person_id, token_id, attention,
  1 + sum(1 - attention) OVER (PARTITION BY shard, pack ORDER BY pack_pos) AS sample FROM packed),
cells AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT shard, pack, sample::BIGINT AS sample, person_id, dim::INT AS dim, round(avg(x), 6) AS mean FROM seg JOIN cells ON vec_id = token_id % 500
WHERE attention = 1 GROUP BY ALL""",
)
def packed_pool(spark, d):
    """A vector for each position of each pack, by its token; the mean of each member's."""
    packed = stage(_packed(spark, d), "packed")
    vectors = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("token"), F.col("embedding").alias("vector"))
    rows = packed.select("shard", "pack", "pack_pos", (F.col("token_id") % 500).cast("long").alias("token")).join(vectors, "token")
    cells = F.array_sort(F.collect_list(F.struct("pack_pos", "vector")))
    packs = rows.groupBy("shard", "pack").agg(F.transform(cells, S.field_of("vector")).alias("vectors"))
    pooled = L.pool_packed(packs, B.sample_ranges(packed))
    cells = pooled.select("shard", "pack", "sample", "person_id", F.posexplode("vector").alias("dim", "mean"))
    return cells.withColumn("mean", F.round("mean", 6))
