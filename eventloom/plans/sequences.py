"""Queries that build token sequences, and their parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import timing
from ..functions.scan import FOLD_AT_ONCE, SPLIT_ABOVE, dealt, largest_group
from ..operators import clean as P
from ..operators import domains as D
from ..operators import sequence as S
from ..operators import visits as V
from ..session import session_within
from ..sources import adapters as A
from .sequence_sql import CLEAN, sequence_ctes, sequence_sql, token_sql

FULL = S.SequenceOptions(gap="day", stay="day", auxiliary=True, prompt=True)
PLAIN = S.SequenceOptions()
COLS = ", ".join(S.SEQUENCE_COLUMNS)
QUERIES: dict = {}


def add(name, sql=None):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


def full_sequence(spark, d, options=FULL):
    return S.build_sequence(A.visits(spark, d), A.visit_events(spark, d), A.people(spark, d), options)


# ---- flagship: an event log without visits ----------------------------------------------------------------------


def event_log_sequence(spark, d):
    """Day visits of the event log as long sequences: time gap, start, events, end.

    Positions come from day counts: events are ranked within their day, days are offset by the tokens before them.
    """
    ev = P.drop_untimed(A.log_events(spark, d))
    days = V.day_blocks(ev).withColumn("person_id", F.col("subject_id"))
    days = S.gap_days(
        days.withColumnRenamed("min_time", "visit_start"), F.col("visit_start")
    )  # all outpatient: the cursor is the start
    w = Window.partitionBy("subject_id").orderBy("visit_id")  # bounded: one row per day
    before = F.sum(F.col("n_events") + 3).over(w) - (F.col("n_events") + 3) - F.when(F.col("visit_id") > 1, 1).otherwise(0)
    days = days.withColumns({"offset": before, "has_gap": (F.col("visit_id") > 1).cast("long")})
    ranked = S.ordered_scan(
        ev.withColumn("day", F.to_date("time")),
        ["subject_id", "day"],
        S.time_levels(F.col("time")),
        [F.col("time"), F.col("event_id")],
        count="rank",
    )
    start = F.col("offset") + F.col("has_gap")
    attrs = days.select("subject_id", "day", "visit_id", "offset", "has_gap")
    events = ranked.join(attrs, ["subject_id", "day"]).select(
        "subject_id", (start + 1 + F.col("rank")).alias("pos"), S.clean_code(F.col("code")).alias("token"), "visit_id"
    )
    marks = F.array(
        F.when(
            F.col("has_gap") == 1,
            F.struct((F.col("offset") + 1).alias("pos"), timing.time_token(F.col("gap_days"), "week_month").alias("token")),
        ),
        F.struct((start + 1).alias("pos"), F.lit(S.VISIT_START).alias("token")),
        F.struct((start + 2 + F.col("n_events")).alias("pos"), F.lit(S.VISIT_END).alias("token")),
    )
    edges = days.select("subject_id", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m"), "visit_id")
    return events.unionByName(edges.select("subject_id", "m.pos", "m.token", "visit_id"))


EVENT_LOG_CTES = f"""ev AS ({A.LOG_EVENTS_SQL}),
blocks AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY day) AS visit_id FROM
  (SELECT subject_id, CAST(time AS DATE) AS day, min(time) AS t0, count(*) AS n FROM ev GROUP BY ALL)),
gaps AS (SELECT *, (epoch_us(t0) - epoch_us(lag(t0) OVER (PARTITION BY subject_id ORDER BY day))) // 86400000000 AS gap_days
  FROM blocks),
toks AS (
  SELECT subject_id, visit_id, 1 AS k, t0 AS t, 0 AS i, {token_sql('gap_days', 'week_month')} AS token FROM gaps WHERE visit_id > 1
  UNION ALL SELECT subject_id, visit_id, 2, t0, 0, '[VS]' FROM gaps
  UNION ALL SELECT ev.subject_id, visit_id, 3, time, event_id, {CLEAN.format('code')} FROM ev JOIN gaps
    ON ev.subject_id = gaps.subject_id AND CAST(time AS DATE) = day
  UNION ALL SELECT subject_id, visit_id, 4, t0, 0, '[VE]' FROM gaps),
logseq AS (SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY visit_id, k, t, i) AS pos, token, visit_id
  FROM toks)"""

add("entry_event_log_sequence", f"WITH {EVENT_LOG_CTES} SELECT * FROM logseq")(event_log_sequence)


@add("p1_nonempty", f"WITH {EVENT_LOG_CTES} SELECT subject_id AS person_id, count(*) AS num_of_concepts FROM logseq GROUP BY 1")
def nonempty(spark, d):
    seq = event_log_sequence(spark, d).withColumnRenamed("subject_id", "person_id")
    return P.keep_min_length(seq.groupBy("person_id").agg(F.count(F.lit(1)).alias("num_of_concepts")), 1)


@add(
    "p2_min_length",
    f"WITH {EVENT_LOG_CTES} SELECT subject_id AS person_id, pos, token FROM logseq WHERE subject_id IN "
    "(SELECT subject_id FROM logseq GROUP BY 1 HAVING count(*) >= 150)",
)
def min_length(spark, d):
    seq = event_log_sequence(spark, d).withColumnRenamed("subject_id", "person_id")
    return P.keep_long_people(seq, 150).select("person_id", "pos", "token")


# ---- sequences of visits with types ------------------------------------------------------------------------------


@add("q12_sequence_full", sequence_sql(FULL, f"SELECT {COLS} FROM seq"))
def sequence_full(spark, d):
    return full_sequence(spark, d)


@add("q12_sequence_plain", sequence_sql(PLAIN, f"SELECT {COLS} FROM seq"))
def sequence_plain(spark, d):
    return full_sequence(spark, d, PLAIN)


VISITS_CTE = f"v AS ({A.visits_sql()})"
ORDER = "OVER (PARTITION BY person_id ORDER BY visit_start, visit_id)"


@add("q1_visit_order", f"WITH {VISITS_CTE} SELECT person_id, visit_id, row_number() {ORDER} AS visit_order FROM v")
def visit_order(spark, d):
    return S.order_visits(A.visits(spark, d)).select("person_id", "visit_id", "visit_order")


@add(
    "q2_prompt",
    f"""WITH p AS ({A.PEOPLE_SQL}), {VISITS_CTE},
f AS (SELECT v.*, birth, gender, race FROM v JOIN p USING (person_id)
  QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY visit_start, visit_id) = 1)
SELECT person_id, 1 AS pos, 'year:' || year(visit_start) AS token FROM f
UNION ALL SELECT person_id, 2, 'age:' || date_sub('year', birth, visit_start) FROM f
UNION ALL SELECT person_id, 3, gender FROM f UNION ALL SELECT person_id, 4, race FROM f""",
)
def prompt(spark, d):
    visits = S.order_visits(A.visits(spark, d).join(A.people(spark, d), "person_id"))
    return S.prompt_tokens(visits).select("person_id", "pos", "token")


@add(
    "q3_gap_tokens",
    f"""WITH {VISITS_CTE}, g AS (SELECT person_id, visit_id, CAST(floor((epoch_us(visit_start) -
  epoch_us(lag(coalesce(visit_end, visit_start)) {ORDER})) / 86400e6) AS BIGINT) AS gap_days FROM v)
SELECT person_id, visit_id, gap_days, {token_sql('gap_days', 'week_month')} AS token FROM g WHERE gap_days IS NOT NULL""",
)
def gap_tokens(spark, d):
    v = S.gap_days(A.visits(spark, d), F.coalesce("visit_end", "visit_start")).filter("gap_days IS NOT NULL")
    return v.select("person_id", "visit_id", "gap_days", timing.time_token(F.col("gap_days"), "week_month").alias("token"))


_KINDS = [k for k in timing.TIME_TOKEN_KINDS if k != "none"]


@add(
    "q3a_time_token_kinds",
    "WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor((epoch_us(l_shipdate) - epoch_us(o_orderdate))"
    " / 86400e6) AS BIGINT) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT l_orderkey, l_linenumber, "
    "l_partkey, l_suppkey, days, " + ", ".join(f"{token_sql('days', k)} AS {k}_token" for k in _KINDS) + " FROM d",
)
def time_token_kinds(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    li = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    df = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn(
        "days", timing.floor_days(F.col("l_shipdate").cast("timestamp"), F.col("o_orderdate").cast("timestamp"))
    )
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "days",
        *[timing.time_token(F.col("days"), k).alias(f"{k}_token") for k in _KINDS],
    )


def _week_stays(spark, d):
    """The event log with one stay per user and week, so that stays hold many events at irregular times."""
    ev = A.log_events(spark, d).withColumn("visit_id", timing.week_index(F.col("time")).cast("long"))
    ev = ev.withColumnRenamed("subject_id", "person_id")
    starts = ev.groupBy("person_id", "visit_id").agg(F.min("time").alias("visit_start"))
    return ev.join(starts, ["person_id", "visit_id"])


_STAYS_CTE = f"""ev AS (SELECT subject_id AS person_id, time, CAST(floor(epoch_us(time) / 604800e6) AS BIGINT) AS visit_id
  FROM ({A.LOG_EVENTS_SQL})), st AS (SELECT person_id, visit_id, min(time) AS visit_start FROM ev GROUP BY ALL)"""


@add(
    "q4_stay_gap_exact",
    f"""WITH RECURSIVE {_STAYS_CTE}, mv AS (SELECT person_id, visit_id, visit_start AS cur, CAST(NULL AS TIMESTAMP) AS prev FROM st
  UNION ALL SELECT m.person_id, m.visit_id, min(t.time), m.cur FROM mv m JOIN ev t
  ON m.person_id = t.person_id AND m.visit_id = t.visit_id AND t.time >= m.cur + INTERVAL 1 DAY
  GROUP BY m.person_id, m.visit_id, m.cur)
SELECT person_id, visit_id, epoch_us(cur) AS t, (epoch_us(cur) - epoch_us(prev)) // 86400000000 AS move_days,
  'i-D' || ((epoch_us(cur) - epoch_us(prev)) // 86400000000) AS token FROM mv WHERE prev IS NOT NULL""",
)
def stay_gap_exact(spark, d):
    moves = S.stay_moves(_week_stays(spark, d))
    token = F.concat(F.lit("i-"), timing.time_token(F.col("move_days"), "day"))
    return moves.select("person_id", "visit_id", F.unix_micros("time").alias("t"), "move_days", token.alias("token"))


@add(
    "q4_stay_gap_by_day",
    f"""WITH {_STAYS_CTE}, dd AS (SELECT person_id, visit_id, CAST(time AS DATE) AS day, min(time) AS time FROM ev GROUP BY ALL),
l AS (SELECT *, lag(day) OVER (PARTITION BY person_id, visit_id ORDER BY day) AS before FROM dd)
SELECT person_id, visit_id, epoch_us(time) AS t, date_diff('day', before, day) AS move_days FROM l WHERE before IS NOT NULL""",
)
def stay_gap_by_day(spark, d):
    g = S.stay_gaps_by_day(_week_stays(spark, d))
    return g.select("person_id", "visit_id", F.unix_micros("time").alias("t"), "move_days")


@add(
    "q5_boundary_tokens",
    sequence_sql(FULL, "SELECT person_id, pos, kind, token, age, week FROM seq WHERE kind IN ('start', 'type', 'discharge', 'end')"),
)
def boundary_tokens(spark, d):
    seq = full_sequence(spark, d).filter(F.col("kind").isin("start", "type", "discharge", "end"))
    return seq.select("person_id", "pos", "kind", "token", "age", "week")


@add(
    "q6_segments",
    f"""WITH {VISITS_CTE}, w AS (SELECT v.* FROM v WHERE visit_id IN (SELECT l_orderkey FROM lineitem))
SELECT person_id, visit_id, (1 + (row_number() {ORDER} - 1) % 2)::INT AS segment FROM w""",
)
def segments(spark, d):
    with_events = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("visit_id"))
    v = A.visits(spark, d).join(with_events, "visit_id", "left_semi")
    return S.segments(v).select("person_id", "visit_id", "segment")


@add(
    "q7_age_and_week",
    f"""WITH p AS ({A.PEOPLE_SQL}), e AS ({A.VISIT_EVENTS_SQL})
SELECT e.person_id, event_id, visit_id, date_sub('year', birth, time)::INT AS age,
  floor(epoch_us(time) / 604800e6)::INT AS week FROM e JOIN p USING (person_id)""",
)
def age_and_week(spark, d):
    e = A.visit_events(spark, d).join(A.people(spark, d).select("person_id", "birth"), "person_id")
    return e.select(
        "person_id", "event_id", "visit_id",
        timing.completed_years(F.col("birth"), F.col("time")).alias("age"),
        timing.week_index(F.col("time")).alias("week"),
    )


@add(
    "q8_value_columns",
    f"""WITH e AS ({A.VISIT_EVENTS_SQL}) SELECT visit_id, event_id, coalesce(numeric_value, -1.0) AS value,
  (numeric_value IS NOT NULL)::INT AS value_mask, (numeric_value IS NOT NULL)::INT AS mlm_skip, coalesce(unit, 'N/A') AS unit FROM e""",
)
def value_columns(spark, d):
    e = S.value_columns(A.visit_events(spark, d))
    return e.select("visit_id", "event_id", "value", "value_mask", "mlm_skip", "unit")


_FOLD = f"""CASE WHEN numeric_value IS NULL AND text_value IS NOT NULL THEN {CLEAN.format('code')} || '//option:' ||
  {CLEAN.format('text_value')} ELSE {CLEAN.format('code')} END"""


@add("q9_fold_answers", f"WITH e AS ({A.VISIT_EVENTS_SQL}) SELECT visit_id, event_id, {_FOLD} AS token FROM e")
def fold_answers(spark, d):
    return S.fold_text(A.visit_events(spark, d)).select("visit_id", "event_id", "token")


@add(
    "q10_dedup_outpatient",
    f"""WITH {VISITS_CTE}, e AS (SELECT e.*, {_FOLD} AS token, coalesce(numeric_value, -1.0) AS value, visit_type <> 'Visit/OP' AS stay
  FROM ({A.VISIT_EVENTS_SQL}) e JOIN v USING (person_id, visit_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY person_id, visit_id, token, value ORDER BY time, code, event_id) AS i FROM e)
SELECT person_id, visit_id, event_id, token, value FROM r WHERE stay OR i = 1""",
)
def dedup_outpatient(spark, d):
    v = A.visits(spark, d).select("person_id", "visit_id", S.is_stay(F.col("visit_type")).alias("is_stay"))
    e = S.value_columns(S.fold_text(A.visit_events(spark, d)))
    e = e.select("person_id", "visit_id", "event_id", "time", "code", "token", "value")  # the first by (time, code, event_id)
    out = S.dedup_outpatient(e.join(v, ["person_id", "visit_id"]))
    return out.select("person_id", "visit_id", "event_id", "token", "value")


@add(
    "q11_counters",
    sequence_sql(
        FULL,
        "SELECT s.person_id, num_of_concepts, num_of_visits FROM (SELECT person_id, count(*) AS num_of_concepts FROM seq GROUP BY 1) s "
        "JOIN (SELECT person_id, count(*) AS num_of_visits FROM vis GROUP BY 1) n ON s.person_id = n.person_id",
    ),
)
def counters(spark, d):
    return S.counters(full_sequence(spark, d), A.visits(spark, d))


def _joined(c, t="string"):
    return F.concat_ws(" ", F.transform(c, lambda x: x.cast(t)))


@add(
    "q12_arrays",
    f"""WITH {EVENT_LOG_CTES} SELECT subject_id, ((pos - 1) // 64)::INT AS part, string_agg(token, ' ' ORDER BY pos) AS concept_ids,
  string_agg(visit_id, ' ' ORDER BY pos) AS visit_orders, (sum(count(*)) OVER (PARTITION BY subject_id))::INT AS num_of_concepts
FROM logseq GROUP BY 1, 2""",
)
def arrays(spark, d):
    out = S.to_arrays(event_log_sequence(spark, d), ["token", "visit_id"], 64, ["subject_id"])
    return out.select(
        "subject_id", "part", _joined("token").alias("concept_ids"), _joined("visit_id").alias("visit_orders"), "num_of_concepts"
    )


@add(
    "p1_min_length_of_long_histories",
    f"""WITH {EVENT_LOG_CTES} SELECT subject_id, ((pos - 1) // 16)::INT AS part, string_agg(token, ' ' ORDER BY pos) AS concept_ids FROM logseq
WHERE subject_id IN (SELECT subject_id FROM logseq GROUP BY 1 HAVING count(*) >= 40) GROUP BY 1, 2""",
)
def min_length_of_long_histories(spark, d):
    out = S.to_arrays(event_log_sequence(spark, d), ["token"], 16, ["subject_id"])
    return P.keep_min_length(out, 40).select("subject_id", "part", _joined("token").alias("concept_ids"))


@add(
    "q12_unequal_lengths",
    f"WITH {EVENT_LOG_CTES} SELECT DISTINCT subject_id, ((pos - 1) // 64)::INT AS part FROM logseq WHERE subject_id % 5 = 0",
)
def unequal_lengths(spark, d):
    """The arrays of a fifth of the subjects have lost an element."""
    out = S.to_arrays(event_log_sequence(spark, d), ["token", "visit_id"], 64, ["subject_id"])
    short = F.slice("visit_id", 1, F.size("visit_id") - 1)
    out = out.withColumn("visit_id", F.when(F.col("subject_id") % 5 == 0, short).otherwise(F.col("visit_id")))
    return S.equal_lengths(out, ["token", "visit_id"]).select("subject_id", "part")


@add(
    "q13_sort_sequence",
    """SELECT l_orderkey, string_agg(l_partkey, ' ' ORDER BY epoch_us(l_shipdate), l_partkey, l_quantity) AS concept_ids,
  string_agg(CAST(l_quantity AS BIGINT), ' ' ORDER BY epoch_us(l_shipdate), l_partkey, l_quantity) AS concept_values
FROM lineitem GROUP BY l_orderkey""",
)
def sort_sequence(spark, d):
    rows = A.table(spark, d, "lineitem").select(
        "l_orderkey", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("dates"), "l_partkey",
        F.col("l_quantity").cast("long").alias("q"),
    )
    arrays = rows.groupBy("l_orderkey").agg(F.collect_list(F.struct("dates", "l_partkey", "q")).alias("r")).select(
        "l_orderkey",
        *[F.transform("r", S.field_of(c)).alias(a) for a, c in
          (("dates", "dates"), ("concept_ids", "l_partkey"), ("concept_values", "q"))],
    )
    out = S.sort_sequence(arrays, ["concept_ids", "concept_values"], "dates")
    return out.select("l_orderkey", _joined("concept_ids").alias("concept_ids"), _joined("concept_values").alias("concept_values"))


@add(
    "q13_sort_sequences",
    """WITH r AS (SELECT l_suppkey AS person_id, l_partkey, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_suppkey
  ORDER BY epoch_us(l_shipdate), l_partkey, l_quantity, l_orderkey) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT person_id, (i // 64)::INT AS part, string_agg(l_partkey, ' ' ORDER BY i) AS concept_ids, string_agg(q, ' ' ORDER BY i) AS concept_values,
  any_value(n)::INT AS n FROM r GROUP BY ALL""",
)
def sort_sequences(spark, d):
    """Each supplier's lines, first by order in rows of 64, then by date over all its rows."""
    lines = A.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("person_id"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("dates"),
        F.col("l_partkey").alias("concept_ids"), F.col("l_quantity").cast("long").alias("concept_values"), "l_orderkey", "l_linenumber",
    )
    w = Window.partitionBy("person_id").orderBy("l_orderkey", "l_linenumber")
    arrays = S.to_arrays(lines.withColumn("pos", F.row_number().over(w)), ["dates", "concept_ids", "concept_values"], part_size=64)
    out = S.sort_sequences(arrays, ["concept_ids", "concept_values"], "dates", part_size=64)
    return out.select(
        "person_id", "part", _joined("concept_ids").alias("concept_ids"), _joined("concept_values").alias("concept_values"),
        F.col("num_of_concepts").alias("n"),
    )


@add(
    "q14_time_token_parser",
    f"""WITH {EVENT_LOG_CTES}, t AS (SELECT subject_id, pos, token FROM logseq UNION ALL SELECT subject_id, -pos, 'i-' || token FROM logseq
  WHERE regexp_matches(token, '^[DWM][0-9]+$'))
SELECT subject_id, pos, token, regexp_matches(token, '^[DWMY][0-9]+') OR token = 'LT' OR starts_with(token, 'i-') AS is_time,
  coalesce(CASE WHEN token = 'LT' THEN 1095 WHEN regexp_matches(token, '^W[0-9]+$') THEN 7 * substr(token, 2)::BIGINT
  WHEN regexp_matches(token, '^M[0-9]+$') THEN 30 * substr(token, 2)::BIGINT
  WHEN regexp_matches(token, '^i-.[0-9]+$') THEN substr(token, 4)::BIGINT END, -1) AS days FROM t""",
)
def time_token_parser(spark, d):
    seq = event_log_sequence(spark, d).select("subject_id", "pos", "token")
    inner = seq.filter(F.col("token").rlike("^[DWM][0-9]+$")).select(
        "subject_id", -F.col("pos"), F.concat(F.lit("i-"), F.col("token"))
    )
    t = seq.union(inner)
    return t.select(
        "subject_id", "pos", "token", timing.is_time_token(F.col("token")).alias("is_time"),
        F.coalesce(timing.token_days(F.col("token")), F.lit(-1)).alias("days"),
    )


@add(
    "q15_rebuild_times",
    sequence_sql(
        FULL,
        """, d AS (SELECT person_id, pos, CASE WHEN regexp_matches(token, '^D[0-9]+$') THEN substr(token, 2)::BIGINT
  WHEN regexp_matches(token, '^i-D[0-9]+$') THEN substr(token, 4)::BIGINT ELSE 0 END AS days,
  first_value(token) OVER (PARTITION BY person_id ORDER BY pos) AS y FROM seq)
SELECT person_id, pos, (epoch(make_date(substr(y, 6)::BIGINT, 1, 1)) + 86400 * sum(days) OVER (PARTITION BY person_id ORDER BY pos))::DOUBLE
  AS rebuilt_epoch FROM d""",
    ),
)
def rebuild_times(spark, d):
    seq = full_sequence(spark, d)
    return S.rebuild_times(seq.select("person_id", "pos", "token"), S.longest(seq)).select("person_id", "pos", "rebuilt_epoch")


@add(
    "q16_index_epoch",
    "SELECT o_orderkey, epoch_us(CAST(o_orderdate AS TIMESTAMP)) / 1e6 AS epoch, epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) / 1e6 "
    "AS day_epoch FROM orders",
)
def index_epoch(spark, d):
    t = F.col("o_orderdate").cast("timestamp")
    return A.table(spark, d, "orders").select(
        "o_orderkey", timing.to_epoch(t).alias("epoch"), timing.to_epoch(t.cast("date")).alias("day_epoch")
    )


def _domains(spark, d, orders=None, lines=None):
    return [
        D.Domain("condition", A.condition_records(spark, d, lines), "condition_concept_id", "condition_start_date", event_id="condition_occurrence_id"),
        D.Domain("drug", A.drug_records(spark, d, lines), "drug", "drug_time", visit_id="visit_id", event_id="drug_exposure_id"),
        D.Domain("procedure", A.procedure_records(spark, d, orders), "procedure_concept", "procedure_time", event_id="procedure_occurrence_id"),
        D.Domain(
            "measurement", A.measurement_records(spark, d, lines), "measurement_concept", "measurement_time",
            visit_id="visit_id", event_id="measurement_id", number="value_as_number", unit="unit_source",
        ),
    ]


def _domain_rows(spark, d):
    """Records of the four domains, from the footers of the tables: three per order line and one per order."""
    return 3 * A.table(spark, d, "lineitem").count() + A.table(spark, d, "orders").count()


_DOMAINS = " UNION ALL ".join([A.CONDITION_RECORDS_SQL, A.DRUG_RECORDS_SQL, A.PROCEDURE_RECORDS_SQL, A.MEASUREMENT_RECORDS_SQL])


@add(
    "q17_domain_events",
    f"""SELECT person_id, "table", code, coalesce(visit_id, 0) AS visit_id, time, coalesce(unit, '') AS unit, count(*) AS n,
coalesce(sum(numeric_value), 0) AS total FROM ({_DOMAINS}) WHERE time >= TIMESTAMP '1996-01-01' GROUP BY ALL""",
)
def domain_events(spark, d):
    e = D.domain_events(_domains(spark, d), "1996-01-01")
    e = e.withColumns({"visit_id": F.coalesce("visit_id", F.lit(0)), "unit": F.coalesce("unit", F.lit(""))})
    total = F.coalesce(F.sum("numeric_value"), F.lit(0.0)).alias("total")
    keys = ["person_id", "table", "code", "visit_id", "time", "unit"]
    return dealt(e, keys, _domain_rows(spark, d)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), total)


@add(
    "q18_qualified_concepts",
    f"SELECT code, count(DISTINCT person_id) AS n_people FROM ({_DOMAINS}) GROUP BY 1 HAVING count(DISTINCT person_id) >= 50",
)
def qualified_concepts(spark, d):
    return S.qualified_concepts(D.domain_events(_domains(spark, d)), 50, _domain_rows(spark, d))


# The first covering visit by a join of days and visits; loose days are numbered after the person's highest visit.
_PLACED = f"""rec AS ({_DOMAINS}), good AS (SELECT code FROM rec GROUP BY 1 HAVING count(DISTINCT person_id) >= 50),
gv AS ({A.visits_sql()}),
rec1 AS (SELECT r.*, g.visit_id IS NOT NULL AS listed, CAST(r.time AS DATE) AS day FROM rec r JOIN good USING (code)
  LEFT JOIN gv g ON g.person_id = r.person_id AND g.visit_id = r.visit_id WHERE r.time >= TIMESTAMP '1996-01-01'),
loose AS (SELECT DISTINCT person_id, day FROM rec1 WHERE NOT listed),
cover AS (SELECT l.person_id, l.day, arg_min(visit_id, (visit_start, visit_id)) AS visit_id FROM loose l JOIN gv ON gv.person_id = l.person_id
  AND CAST(visit_start AS DATE) <= l.day AND l.day <= CAST(coalesce(visit_end, visit_start) AS DATE) GROUP BY ALL),
own AS (SELECT person_id, day, coalesce(top, 0) + row_number() OVER (PARTITION BY person_id ORDER BY day) AS visit_id
  FROM (FROM loose ANTI JOIN cover USING (person_id, day)) LEFT JOIN (SELECT person_id, max(visit_id) AS top FROM gv GROUP BY 1) USING (person_id)),
placed AS (SELECT r.person_id, coalesce(c.visit_id, o.visit_id, r.visit_id) AS visit_id, event_id, time, code, numeric_value, text_value, unit,
  CASE WHEN listed THEN 'linked' WHEN c.visit_id IS NOT NULL THEN 'attached' ELSE 'orphan' END AS how, "table"
  FROM rec1 r LEFT JOIN cover c ON NOT listed AND c.person_id = r.person_id AND c.day = r.day
  LEFT JOIN own o ON NOT listed AND o.person_id = r.person_id AND o.day = r.day),
allv AS (SELECT person_id, visit_id, visit_type, visit_start, visit_end, discharge_facility FROM gv
  UNION ALL SELECT person_id, visit_id, 'Visit/OP', min(time), NULL, NULL FROM placed WHERE how = 'orphan' GROUP BY ALL),
died AS (SELECT d.person_id, max(v.visit_id) + 1 AS visit_id, greatest(d.time, max(greatest(visit_start, visit_end)),
  (SELECT max(p.time) FROM placed p WHERE p.person_id = d.person_id)) AS time FROM ({A.DEATHS_SQL}) d JOIN allv v USING (person_id) GROUP BY d.person_id, d.time)"""

_SEQ_VISITS = """SELECT * FROM allv UNION ALL SELECT person_id, visit_id, '[DEATH]', time, NULL, NULL FROM died"""
_SEQ_EVENTS = """SELECT person_id, visit_id, event_id, time, code, numeric_value, text_value, unit FROM placed
  UNION ALL SELECT person_id, visit_id, 0, time, '[DEATH]', NULL, NULL, NULL FROM died"""
DAYS = S.SequenceOptions(gap="day", stay="day")


@add(
    "q17_join_visits",
    f"""WITH {_PLACED} SELECT person_id, visit_id, event_id, "table", code, time, how FROM placed""",
)
def join_visits(spark, d):
    events = D.qualified_events(_domains(spark, d), "1996-01-01", 50)
    return D.place_events(events, A.visits(spark, d)).select("person_id", "visit_id", "event_id", "table", "code", "time", "how")


@add(
    "q17_domain_sequences",
    f"WITH RECURSIVE {_PLACED}, {sequence_ctes(DAYS, _SEQ_VISITS, _SEQ_EVENTS)} SELECT {COLS} FROM seq",
)
def domain_sequences(spark, d):
    """Four domains and deaths, day tokens, concepts of at least fifty people.

    Orders and their lines are dealt out by person once, and all steps stay within persons unless one has more records than a task sorts.
    """
    within = session_within(spark, -(-_domain_rows(spark, d) // FOLD_AT_ONCE))
    orders, lines = A.orders_by_person(within, d)
    by_person = 3 * largest_group(lines, ["o_custkey"]) + largest_group(orders, ["o_custkey"]) <= SPLIT_ABOVE
    if by_person:
        spark, domains, visits = within, _domains(within, d, orders, lines), A.visits(within, d, orders=orders)
    else:
        domains, visits = _domains(spark, d), A.visits(spark, d)
    return D.domain_sequences(
        domains, visits, A.people(spark, d), start_date="1996-01-01", min_patients=50, deaths=A.deaths(spark, d), options=DAYS, by_person=by_person
    )
