"""Queries on vocabulary, encoding and value statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence as S
from ..operators import tokens as T
from ..session import new_folder, stage
from ..sources import adapters as A
from ..sources import io
from .sequences import EVENT_LOG_CTES, event_log_sequence

QUERIES: dict = {}


def add(name, sql=None):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


def item_tokens(spark, d):
    """One token per order line: a wide vocabulary with ties."""
    return A.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("person_id"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("pos"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("token"),
    )


_ITEMS = """SELECT l_orderkey AS person_id, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS pos,
  'P' || l_partkey AS token FROM lineitem"""
_SPECIALS = "(VALUES ('[PAD]', 0, 0), ('[MASK]', 1, 0), ('[OOV]', 2, 0), ('[CLS]', 3, 0), ('[UNUSED]', 4, 0)) s(token, id, n)"


def vocab_cte(size: int, min_freq: int = 0) -> str:
    return f"""items AS ({_ITEMS}), words AS (SELECT token, count(*) AS n FROM items GROUP BY 1 HAVING count(*) >= {min_freq}
  ORDER BY n DESC, token LIMIT {size - 5}),
vocab AS (SELECT token, id::INT AS id, n::BIGINT AS n FROM {_SPECIALS}
  UNION ALL SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 4)::INT, n FROM words)"""


SIZE = 1500


@add("t1_vocabulary", f"WITH {vocab_cte(SIZE, 5)} SELECT * FROM vocab")
def vocabulary(spark, d):
    return T.build_vocab(item_tokens(spark, d), SIZE, 5)


@add(
    "t2_encode",
    f"WITH {vocab_cte(SIZE)} SELECT person_id, pos, i.token, coalesce(id, 2)::INT AS token_id FROM items i LEFT JOIN vocab v ON i.token = v.token",
)
def encode(spark, d):
    seq = item_tokens(spark, d)
    return T.encode(seq, T.build_vocab(seq, SIZE)).select("person_id", "pos", "token", "token_id")


@add(
    "t3_decode",
    f"""WITH {vocab_cte(SIZE)}, e AS (SELECT person_id, pos, coalesce(id, 2) AS token_id FROM items i LEFT JOIN vocab v ON i.token = v.token)
SELECT person_id, pos, token_id::INT AS token_id, v.token, coalesce(p_name, v.token) AS name FROM e JOIN vocab v ON e.token_id = v.id
LEFT JOIN part ON v.token = 'P' || p_partkey""",
)
def decode(spark, d):
    seq = item_tokens(spark, d)
    vocab = T.build_vocab(seq, SIZE)
    names = A.table(spark, d, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("token"), F.col("p_name").alias("name")
    )
    ids = T.encode(seq, vocab).select("person_id", "pos", "token_id")
    return T.decode(ids, vocab, names).select("person_id", "pos", "token_id", "token", "name")


def lab_values(spark, d):
    e = S.value_columns(A.visit_events(spark, d))
    return e.withColumn("concept_id", S.clean_code(F.col("code"))).select(
        "visit_id", "event_id", "concept_id", "unit", "value", "value_mask"
    )


_VALUES = f"""SELECT visit_id, event_id, regexp_replace(code, '\\s+', '_', 'g') AS concept_id, coalesce(unit, 'N/A') AS unit,
  coalesce(numeric_value, -1.0) AS value, (numeric_value IS NOT NULL)::INT AS value_mask FROM ({A.VISIT_EVENTS_SQL})"""
K = 2.0
_LO, _HI = T.normal_share(-K), T.normal_share(K)
STATS_CTE = f"""vals AS ({_VALUES}),
q AS (SELECT concept_id, unit, quantile_cont(value, {_LO!r}::DOUBLE) AS lo, quantile_cont(value, {_HI!r}::DOUBLE) AS hi FROM vals
  WHERE value_mask = 1 AND value <> 0 GROUP BY 1, 2),
stats AS (SELECT concept_id, unit, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS count FROM vals JOIN q USING (concept_id, unit)
  WHERE value_mask = 1 AND value <> 0 AND value BETWEEN lo AND hi GROUP BY 1, 2)"""


@add(
    "t4_value_statistics",
    f"""WITH {STATS_CTE} SELECT concept_id, unit, round(mean, 6) AS mean, round(std, 6) AS std, count, {K} ::DOUBLE AS value_outlier_std,
  round(mean - {K} * std, 6) AS lower_bound, round(mean + {K} * std, 6) AS upper_bound FROM stats""",
)
def value_statistics(spark, d):
    return _rounded(T.lab_stats(lab_values(spark, d), K), ["mean", "std", "lower_bound", "upper_bound"])


@add(
    "t4_value_statistics_log",
    f"""WITH vals AS (SELECT code AS concept_id, unit, numeric_value AS value FROM ({A.LOG_EVENTS_SQL})),
q AS (SELECT concept_id, unit, quantile_cont(value, {T.normal_share(-3.0)!r}::DOUBLE) AS lo, quantile_cont(value, {T.normal_share(3.0)!r}::DOUBLE) AS hi
  FROM vals WHERE value <> 0 GROUP BY 1, 2)
SELECT concept_id, unit, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS count FROM vals
JOIN q USING (concept_id, unit) WHERE value <> 0 AND value BETWEEN lo AND hi GROUP BY 1, 2""",
)
def value_statistics_log(spark, d):
    e = A.log_events(spark, d).select(
        F.col("code").alias("concept_id"), "unit", F.col("numeric_value").alias("value"), F.lit(1).alias("value_mask")
    )
    return _rounded(T.lab_stats(e, 3.0), ["mean", "std"]).select("concept_id", "unit", "mean", "std", "count")


@add(
    "t4_value_statistics_no_unit",
    f"""WITH vals AS (SELECT code AS concept_id, CASE WHEN event_id % 3 <> 0 THEN unit ELSE 'N/A' END AS unit, numeric_value AS value FROM ({A.LOG_EVENTS_SQL})),
q AS (SELECT concept_id, unit, quantile_cont(value, {T.normal_share(-3.0)!r}::DOUBLE) AS lo, quantile_cont(value, {T.normal_share(3.0)!r}::DOUBLE) AS hi
  FROM vals WHERE value <> 0 GROUP BY 1, 2)
SELECT concept_id, unit, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS count FROM vals
JOIN q USING (concept_id, unit) WHERE value <> 0 AND value BETWEEN lo AND hi GROUP BY 1, 2""",
)
def value_statistics_no_unit(spark, d):
    unit = F.when(F.col("event_id") % 3 != 0, F.col("unit"))
    e = A.log_events(spark, d).select(
        F.col("code").alias("concept_id"), unit.alias("unit"), F.col("numeric_value").alias("value"), F.lit(1).alias("value_mask")
    )
    return _rounded(T.lab_stats(e, 3.0), ["mean", "std"]).select("concept_id", "unit", "mean", "std", "count")


@add("t4_value_statistics_sketch")
def value_statistics_sketch(spark, d):
    return _rounded(T.lab_stats(lab_values(spark, d), K, exact=False), ["mean", "std", "lower_bound", "upper_bound"])


def _rounded(df, columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@add(
    "t6_normalize",
    f"""WITH {STATS_CTE} SELECT v.visit_id, v.event_id, v.concept_id, v.unit, round(CASE WHEN value_mask = 1 AND mean IS NOT NULL THEN
  CASE WHEN std > 0 THEN greatest(-{K}, least({K}, (value - mean) / std)) ELSE 0.0 END ELSE value END, 6) AS normalized
FROM vals v LEFT JOIN stats s ON v.concept_id = s.concept_id AND v.unit = s.unit""",
)
def normalize(spark, d):
    values = lab_values(spark, d)
    out = T.normalize(values, stage(T.lab_stats(values, K), "stats"))
    return out.select("visit_id", "event_id", "concept_id", "unit", F.round("normalized", 6).alias("normalized"))


def _md5_draw(seed, key):
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT % 1000000) / 1e6"


@add(
    "t7_denormalize",
    f"""WITH {STATS_CTE}, shares AS (SELECT *, sum(count) OVER (PARTITION BY concept_id ORDER BY unit)
  / sum(count) OVER (PARTITION BY concept_id) AS upto FROM stats),
z AS (SELECT l_orderkey * 100000 + l_partkey AS row_id, l_orderkey, l_suppkey, l_linenumber, 'Item_' || (l_partkey % 101) AS concept_id,
  l_discount * 10 AS normalized, {_md5_draw(42, 'l_orderkey * 100000 + l_partkey')} AS u FROM lineitem),
pick AS (SELECT k.concept_id, k.u, s.unit, s.mean, s.std FROM (SELECT DISTINCT concept_id, u FROM z) k JOIN shares s
  ON k.concept_id = s.concept_id AND s.upto > k.u QUALIFY row_number() OVER (PARTITION BY k.concept_id, k.u ORDER BY s.upto) = 1),
p AS (SELECT z.*, unit, mean, std FROM z LEFT JOIN pick ON z.concept_id = pick.concept_id AND z.u = pick.u)
SELECT row_id, l_suppkey, l_linenumber, concept_id, coalesce(unit, 'N/A') AS unit,
  round(CASE WHEN unit IS NULL THEN normalized ELSE normalized * std + mean END, 6) AS value FROM p""",
)
def denormalize(spark, d):
    rows = A.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 100_000 + F.col("l_partkey")).alias("row_id"), "l_suppkey", "l_linenumber",
        F.concat(F.lit("Item_"), (F.col("l_partkey") % 101).cast("string")).alias("concept_id"),
        (F.col("l_discount") * 10).alias("normalized"),
    )
    out = T.denormalize(rows, stage(T.lab_stats(lab_values(spark, d), K), "stats"), "row_id")
    return out.select("row_id", "l_suppkey", "l_linenumber", "concept_id", "unit", F.round("value", 6).alias("value"))


@add(
    "t8_unit_distribution",
    f"""WITH {STATS_CTE} SELECT concept_id, unit, round(count / sum(count) OVER (PARTITION BY concept_id), 6) AS probability,
  round(sum(count) OVER (PARTITION BY concept_id ORDER BY unit) / sum(count) OVER (PARTITION BY concept_id), 6) AS upto FROM stats""",
)
def unit_distribution(spark, d):
    return _rounded(T.unit_distribution(T.lab_stats(lab_values(spark, d), K)), ["probability", "upto"])


@add(
    "t9_labels",
    f"""WITH {vocab_cte(SIZE)} SELECT person_id, pos, coalesce(id, 2)::INT AS token_id, coalesce(id, 2)::INT AS label_id
FROM items i LEFT JOIN vocab v ON i.token = v.token""",
)
def labels(spark, d):
    seq = item_tokens(spark, d)
    return T.with_labels(T.encode(seq, T.build_vocab(seq, SIZE))).select("person_id", "pos", "token_id", "label_id")


@add("t9_length_violations", "SELECT DISTINCT user_id AS subject_id FROM events WHERE user_id % 5 = 0")
def length_violations(spark, d):
    seq = event_log_sequence(spark, d)
    ids = T.with_labels(T.encode(seq, T.build_vocab(seq)))
    arrays = S.to_arrays(ids, ["token_id", "label_id"], 4096, ["subject_id"])
    short = F.slice("label_id", 1, F.size("label_id") - 1)  # a fifth of the subjects have lost a label
    arrays = arrays.withColumn("label_id", F.when(F.col("subject_id") % 5 == 0, short).otherwise(F.col("label_id")))
    return T.check_lengths(arrays, "token_id", "label_id").select("subject_id")


@add(
    "s9_saved_artifacts",
    f"""WITH {vocab_cte(SIZE)}, {STATS_CTE} SELECT 'vocabulary' AS what, token AS name, id::DOUBLE AS x, n AS c FROM vocab
UNION ALL SELECT 'statistics', concept_id || '|' || unit, round(mean, 6), count FROM stats""",
)
def saved_artifacts(spark, d):
    folder = new_folder(spark, "artifacts")
    io.save_artifacts(T.build_vocab(item_tokens(spark, d), SIZE), T.lab_stats(lab_values(spark, d), K), folder)
    vocab, stats = io.load_artifacts(spark, folder)
    return vocab.select(
        F.lit("vocabulary").alias("what"), F.col("token").alias("name"), F.col("id").cast("double").alias("x"), F.col("n").alias("c")
    ).unionByName(
        stats.select(
            F.lit("statistics").alias("what"), F.concat_ws("|", "concept_id", "unit").alias("name"),
            F.round("mean", 6).alias("x"), F.col("count").alias("c"),
        )
    )


LOG_VOCAB_CTE = f"""{EVENT_LOG_CTES}, vocab AS (SELECT token, id::INT AS id FROM {_SPECIALS} UNION ALL
  SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 4)::INT FROM (SELECT token, count(*) AS n FROM logseq GROUP BY 1))"""
