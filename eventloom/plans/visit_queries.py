"""Queries that turn flat events into visits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import timing
from ..operators import clean as P
from ..operators import sequence as S
from ..operators import visits as V
from ..sources import adapters as A
from .sequence_sql import CLEAN

QUERIES: dict = {}

# the event log has no clinical codes: three of its types play the roles of ED, admission and discharge events
LOG_RULES = V.VisitRules(
    ed=("signup",),
    admission=("purchase",),
    discharge=("error",),
    text=(
        V.TextRule("view", r"(\d)(\d)", ("view tens", "view ones")),
        V.TextRule("click", r"(\d+)", ("click k",)),
    ),
)


def add(name, sql=None):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


def log_with_tables(spark, d):
    """The event log with a source table and an end on some events, one visit per user and day."""
    e = A.log_events(spark, d)
    i = F.col("event_id")
    return e.withColumns(
        {
            "visit_id": F.unix_date(F.to_date("time")).cast("long"),
            "table": F.when(i % 7 == 0, "visit").when(i % 5 == 0, "measurement").when(i % 3 == 0, "drug_exposure"),
            "end": F.when(i % 14 == 0, F.col("time") + F.expr("INTERVAL 30 HOURS")),
        }
    )


LOG_TABLES_SQL = f"""SELECT *, CAST(floor(epoch_us(time) / 86400e6) AS BIGINT) AS visit_id,
  CASE WHEN event_id % 7 = 0 THEN 'visit' WHEN event_id % 5 = 0 THEN 'measurement' WHEN event_id % 3 = 0 THEN 'drug_exposure' END AS "table",
  CASE WHEN event_id % 14 = 0 THEN time + INTERVAL 30 HOUR END AS "end" FROM ({A.LOG_EVENTS_SQL})"""


# ---- cleaning ----------------------------------------------------------------------------------------------------


@add("p3_select_columns", "SELECT l_orderkey, l_quantity FROM lineitem")
def select_columns(spark, d):
    return P.select_columns(A.table(spark, d, "lineitem"), ["l_orderkey", "l_quantity", "no_such_column"])


@add(
    "p4_drop_tables",
    f"""SELECT event_id, coalesce("table", '-') AS "table" FROM ({LOG_TABLES_SQL}) WHERE "table" IS NULL OR "table" NOT IN ('visit', 'drug_exposure')""",
)
def drop_tables(spark, d):
    out = P.drop_tables(log_with_tables(spark, d), ["visit", "drug_exposure"])
    return out.select("event_id", F.coalesce("table", F.lit("-")).alias("table"))


@add(
    "p5_drop_unusable",
    f"""SELECT person_id, birth FROM (SELECT person_id, CASE WHEN person_id % 11 <> 0 THEN birth END AS birth FROM ({A.PEOPLE_SQL}))
WHERE birth IS NOT NULL AND person_id IN (SELECT CASE WHEN visit_id % 3 <> 0 AND person_id % 7 <> 0 THEN person_id END FROM ({A.visits_sql()}))""",
)
def drop_unusable(spark, d):
    people = A.people(spark, d).withColumn("birth", F.when(F.col("person_id") % 11 != 0, F.col("birth")))
    known = (F.col("visit_id") % 3 != 0) & (F.col("person_id") % 7 != 0)  # other visits have lost their person
    visits = A.visits(spark, d).withColumn("person_id", F.when(known, F.col("person_id")))
    return P.drop_unusable(people, visits).select("person_id", "birth")


@add("p6_drop_untimed", f"SELECT event_id FROM ({A.LOG_EVENTS_SQL}) WHERE event_id % 13 <> 0")
def drop_untimed(spark, d):
    e = A.log_events(spark, d).withColumn("time", F.when(F.col("event_id") % 13 != 0, F.col("time")))
    return P.drop_untimed(e).select("event_id")


@add("p7_clean_code", "SELECT doc_id, md5(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '_', 'g')) AS cleaned FROM documents")
def clean_code(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(X.clean_code(F.col("text"))).alias("cleaned"))


@add(
    "p8_match_concepts",
    f"SELECT concept_id, concept_code FROM ({A.CONCEPTS_SQL}) WHERE regexp_matches(concept_code, 'Brand#13:ECONOMY|STANDARD')",
)
def match_concepts(spark, d):
    return P.match_concepts(A.concepts(spark, d), ["Brand#13:ECONOMY", "STANDARD"])


@add(
    "p10_repair_values",
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE value END AS concept_values,
  CASE WHEN event_id % 9 = 0 THEN 0 ELSE 1 END AS concept_value_masks,
  CASE WHEN event_id % 4 = 0 THEN 'N/A' ELSE event_type END AS units FROM events""",
)
def repair_values(spark, d):
    i = F.col("event_id")
    e = A.table(spark, d, "events").select(
        "event_id",
        F.when(i % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("number_as_values"),
        F.lit(1).alias("concept_value_masks"),
        F.when(i % 4 != 0, F.col("event_type")).alias("units"),
    )
    return P.repair_values(e).select("event_id", "concept_values", "concept_value_masks", "units")


@add("p12_from_date", f"SELECT event_id, code FROM ({A.LOG_EVENTS_SQL}) WHERE time >= TIMESTAMP '2024-01-15'")
def from_date(spark, d):
    return P.from_date(A.log_events(spark, d), "2024-01-15").select("event_id", "code")


# ---- subjects ----------------------------------------------------------------------------------------------------


def demographic_events(spark, d):
    p = A.people(spark, d)
    key = F.col("person_id")
    none = F.lit(None).cast("timestamp")
    codes = (
        (F.col("birth"), F.lit("meds_birth//x")),
        (none, F.lit("RACE//old")),
        (none, F.when(key % 3 > 0, F.concat(F.lit("RACE//"), "race"))),
        (none, F.when(key % 5 > 0, F.col("gender"))),
        (none, F.lit("//ETHNICITY")),
    )
    rows = F.array(
        *[F.struct(F.lit(i).alias("i"), t.alias("time"), c.alias("code")) for i, (t, c) in enumerate(codes)]
    )
    out = p.select(key.alias("subject_id"), F.inline(rows)).filter("code IS NOT NULL")
    return out.withColumn("event_id", F.col("subject_id") * 10 + F.col("i"))


@add(
    "e1_demographics",
    f"""SELECT person_id AS subject_id, birth, CASE WHEN person_id % 3 > 0 THEN 'RACE//' || race ELSE 'RACE//old' END AS race,
  CASE WHEN person_id % 5 > 0 THEN gender ELSE 'Unknown' END AS gender, 'Unknown' AS ethnicity FROM ({A.PEOPLE_SQL})""",
)
def demographics(spark, d):
    return V.demographics(demographic_events(spark, d))


_COHORT = f"""SELECT subject_id, min(time) + to_days(CAST(10 + subject_id % 12 AS INTEGER)) AS prediction_time
  FROM ({A.LOG_EVENTS_SQL}) GROUP BY 1"""


def log_cohort(spark, d):
    first = A.log_events(spark, d).groupBy("subject_id").agg(F.min("time").alias("t"))
    return first.select(
        "subject_id", (F.col("t") + F.make_dt_interval((10 + F.col("subject_id") % 12).cast("int"))).alias("prediction_time")
    )


@add(
    "e2_observation_window",
    f"""WITH c AS ({_COHORT}) SELECT event_id, e.subject_id, code FROM ({A.LOG_EVENTS_SQL}) e JOIN c USING (subject_id)
WHERE time BETWEEN prediction_time - INTERVAL 7 DAY AND prediction_time""",
)
def observation_window(spark, d):
    return V.observation_window(A.log_events(spark, d), log_cohort(spark, d), 7).select("event_id", "subject_id", "code")


def _shipped(spark, d):
    return A.shipped_events(spark, d).withColumnRenamed("person_id", "subject_id")


def _visits(spark, d, stay="o_orderkey % 5"):
    return A.visits(spark, d, stay).withColumnRenamed("person_id", "subject_id")


_SHIPPED = f"SELECT person_id AS subject_id, visit_id, event_id, time, code FROM ({A.SHIPPED_EVENTS_SQL})"


def _visits_cte(stay="o_orderkey % 5"):
    return f"""SELECT person_id AS subject_id, visit_id, visit_type, visit_start, visit_end,
  coalesce(visit_end, date_trunc('day', visit_start) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND) AS end_at FROM ({A.visits_sql(stay)})"""


@add(
    "e3_link_visits",
    f"""SELECT subject_id, visit_id, min(time) AS min_time, max(time) AS max_time, count(*) AS n_events FROM ({_SHIPPED})
WHERE event_id % 4 <> 0 GROUP BY 1, 2""",
)
def link_visits(spark, d):
    e = _shipped(spark, d).withColumn("visit_id", F.when(F.col("event_id") % 4 != 0, F.col("visit_id")))
    return V.link_visits(e)


@add(
    "e4_day_blocks",
    f"""SELECT subject_id, day, row_number() OVER (PARTITION BY subject_id ORDER BY day) AS visit_id, min_time, max_time, n_events FROM
(SELECT subject_id, CAST(time AS DATE) AS day, min(time) AS min_time, max(time) AS max_time, count(*) AS n_events
 FROM ({A.LOG_EVENTS_SQL}) GROUP BY 1, 2)""",
)
def day_blocks(spark, d):
    return V.day_blocks(A.log_events(spark, d))


_OUT = """(CAST(floor((epoch_us(visit_start) - epoch_us(time)) / 86400e6) AS BIGINT) > 1
  OR CAST(floor((epoch_us(time) - epoch_us(end_at)) / 86400e6) AS BIGINT) > 1)"""
_LONG_STAY = "(o_orderkey * 7) % 400"


@add(
    "e5_detach_out_of_range",
    f"""WITH v AS ({_visits_cte(_LONG_STAY)}) SELECT e.subject_id, e.visit_id, event_id, {_OUT} AS detached FROM ({_SHIPPED}) e
JOIN v USING (subject_id, visit_id)""",
)
def detach(spark, d):
    out = V.detach_out_of_range(_shipped(spark, d), _visits(spark, d, _LONG_STAY))
    return out.select("subject_id", "visit_id", "event_id", "detached")


_ATTACH = """SELECT subject_id, day, visit_id FROM (SELECT q.subject_id, q.day, v.visit_id,
  row_number() OVER (PARTITION BY q.subject_id, q.day ORDER BY visit_start, v.visit_id) AS i
  FROM days q JOIN v ON q.subject_id = v.subject_id AND q.day BETWEEN CAST(visit_start AS DATE) AND CAST(end_at AS DATE)) WHERE i = 1"""


@add(
    "e6_attach_days",
    f"""WITH v AS ({_visits_cte(_LONG_STAY)}), days AS (SELECT DISTINCT subject_id, CAST(time AS DATE) AS day FROM ({_SHIPPED}))
{_ATTACH}""",
)
def attach_days(spark, d):
    days = _shipped(spark, d).select("subject_id", F.to_date("time").alias("day")).distinct()
    return V.attach_days(days, _visits(spark, d, _LONG_STAY))


@add(
    "e7_assign_events",
    f"""WITH v AS ({_visits_cte(_LONG_STAY)}), e AS ({_SHIPPED}),
m AS (SELECT e.*, {_OUT} AS detached FROM e JOIN v USING (subject_id, visit_id)),
loose AS (SELECT subject_id, event_id, CAST(time AS DATE) AS day, code FROM m WHERE detached),
days AS (SELECT DISTINCT subject_id, day FROM loose), att AS ({_ATTACH}),
top AS (SELECT subject_id, max(visit_id) AS t FROM v GROUP BY 1),
orp AS (SELECT subject_id, day, coalesce(t, 0) + row_number() OVER (PARTITION BY subject_id ORDER BY day) AS visit_id
  FROM (SELECT * FROM days d WHERE NOT EXISTS (SELECT 1 FROM att a WHERE a.subject_id = d.subject_id AND a.day = d.day))
  LEFT JOIN top USING (subject_id)),
x AS (SELECT *, 'attached' AS how FROM att UNION ALL SELECT *, 'orphan' FROM orp)
SELECT subject_id, event_id, code, visit_id, 'linked' AS how FROM m WHERE NOT detached
UNION ALL SELECT l.subject_id, l.event_id, l.code, x.visit_id, how FROM loose l JOIN x USING (subject_id, day)""",
)
def assign_events(spark, d):
    e = _shipped(spark, d).drop("numeric_value")  # the columns of the SQL
    out = V.assign_events(e, _visits(spark, d, _LONG_STAY))
    return out.select("subject_id", "event_id", "code", "visit_id", "how")


@add(
    "e7_assign_every_event",
    f"""WITH v AS (SELECT * FROM ({_visits_cte(_LONG_STAY)}) WHERE visit_id % 13 <> 0),
e AS (SELECT subject_id, event_id, code, CASE WHEN event_id % 5 <> 0 THEN visit_id END AS visit_id, CASE WHEN event_id % 41 <> 0 THEN time END AS time
  FROM ({_SHIPPED})),
m AS (SELECT e.*, coalesce({_OUT}, FALSE) AS detached FROM e LEFT JOIN v USING (subject_id, visit_id) WHERE e.time IS NOT NULL),
loose AS (SELECT subject_id, event_id, CAST(time AS DATE) AS day, code FROM m WHERE detached OR visit_id IS NULL),
days AS (SELECT DISTINCT subject_id, day FROM loose), att AS ({_ATTACH}),
top AS (SELECT subject_id, max(visit_id) AS t FROM (SELECT subject_id, visit_id FROM v UNION ALL
  SELECT subject_id, visit_id FROM m WHERE visit_id IS NOT NULL) GROUP BY 1),
orp AS (SELECT subject_id, day, coalesce(t, 0) + row_number() OVER (PARTITION BY subject_id ORDER BY day) AS visit_id
  FROM (SELECT * FROM days d WHERE NOT EXISTS (SELECT 1 FROM att a WHERE a.subject_id = d.subject_id AND a.day = d.day))
  LEFT JOIN top USING (subject_id)),
x AS (SELECT *, 'attached' AS how FROM att UNION ALL SELECT *, 'orphan' FROM orp)
SELECT subject_id, event_id, code, visit_id, 'linked' AS how FROM m WHERE NOT detached AND visit_id IS NOT NULL
UNION ALL SELECT l.subject_id, l.event_id, l.code, x.visit_id, how FROM loose l JOIN x USING (subject_id, day)
UNION ALL SELECT subject_id, event_id, code, coalesce(visit_id, -1), 'untimed' FROM e WHERE time IS NULL""",
)
def assign_every_event(spark, d):
    """Events without a time, without a visit, and of visits that the visit table does not list."""
    e = _shipped(spark, d).drop("numeric_value").withColumns(
        {
            "visit_id": F.when(F.col("event_id") % 5 != 0, F.col("visit_id")),
            "time": F.when(F.col("event_id") % 41 != 0, F.col("time")),
        }
    )
    out = V.assign_events(e, _visits(spark, d, _LONG_STAY).filter("visit_id % 13 <> 0"))
    return out.select("subject_id", "event_id", "code", F.coalesce("visit_id", F.lit(-1)).alias("visit_id"), "how")


@add(
    "e7_orphan_visits",
    f"""WITH v AS ({_visits_cte()}), top AS (SELECT subject_id, max(visit_id) AS t FROM v GROUP BY 1)
SELECT subject_id, day, coalesce(t, 0) + row_number() OVER (PARTITION BY subject_id ORDER BY day) AS visit_id
FROM (SELECT DISTINCT subject_id, CAST(time AS DATE) AS day FROM ({_SHIPPED})) LEFT JOIN top USING (subject_id)""",
)
def orphan_visits(spark, d):
    days = _shipped(spark, d).select("subject_id", F.to_date("time").alias("day"))
    return V.orphan_visits(days, _visits(spark, d))


@add(
    "e8_order_blocks",
    f"""SELECT subject_id, visit_id, row_number() OVER (PARTITION BY subject_id ORDER BY visit_start, visit_id) AS block_order
FROM ({_visits_cte()})""",
)
def order_blocks(spark, d):
    return V.order_blocks(_visits(spark, d)).select("subject_id", "visit_id", "block_order")


def _contained_blocks(spark, d):
    """Blocks with long overlapping stays."""
    v = _visits(spark, d, "(o_orderkey * 7) % 160")
    end = F.coalesce("visit_end", F.col("visit_start") + F.make_dt_interval((F.col("visit_id") % 60).cast("int")))
    return v.select(
        "subject_id", "visit_id", "visit_type", "visit_start", end.alias("visit_end"),
        (F.col("visit_type") == "Visit/ER").alias("has_ed"), (F.col("visit_type") == "Visit/IP").alias("has_admission"),
    )


_BLOCKS = f"""SELECT subject_id, visit_id, visit_type, visit_start,
  coalesce(visit_end, visit_start + to_days(CAST(visit_id % 60 AS INTEGER))) AS visit_end,
  visit_type = 'Visit/ER' AS has_ed, visit_type = 'Visit/IP' AS has_admission FROM ({_visits_cte('(o_orderkey * 7) % 160')})"""


@add(
    "e9_merge_contained",
    f"""WITH b AS ({_BLOCKS}), pairs AS (SELECT c.subject_id, c.visit_id, a.visit_id AS into_id, c.has_ed, a.visit_start AS a_start
  FROM b c JOIN b a ON a.subject_id = c.subject_id AND (a.visit_start, a.visit_id) < (c.visit_start, c.visit_id)
  AND c.visit_end <= a.visit_end),
firsts AS (SELECT * FROM pairs WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.subject_id = pairs.subject_id AND p.visit_id = pairs.into_id)
  QUALIFY row_number() OVER (PARTITION BY subject_id, visit_id ORDER BY a_start, into_id) = 1),
ed AS (SELECT DISTINCT subject_id, into_id FROM firsts WHERE has_ed),
m AS (SELECT b.subject_id, b.visit_id, coalesce(f.into_id, b.visit_id) AS container_id FROM b LEFT JOIN firsts f
  ON f.subject_id = b.subject_id AND f.visit_id = b.visit_id)
SELECT m.subject_id, m.visit_id, m.container_id,
  CASE WHEN ed.into_id IS NOT NULL AND c.has_admission THEN 'Visit/ERIP' ELSE c.visit_type END AS merged_type
FROM m JOIN b c ON c.subject_id = m.subject_id AND c.visit_id = m.container_id
LEFT JOIN ed ON ed.subject_id = m.subject_id AND ed.into_id = m.container_id""",
)
def merge_contained(spark, d):
    return V.merge_contained(_contained_blocks(spark, d))


# One step for each block of a subject, in order; the state is the list of places with end, opener, holder and type.
@add(
    "e9_merge_contained_swapping",
    f"""WITH RECURSIVE b AS (SELECT *, has_ed OR has_admission AS urgent, row_number() OVER (PARTITION BY subject_id ORDER BY visit_start, visit_id) AS n
  FROM ({_BLOCKS})),
walk AS (SELECT subject_id, 0::BIGINT AS n, [{{'e': visit_end, 'o': visit_id, 'h': visit_id, 'u': urgent, 'adm': has_admission, 'k': visit_type}}] AS places,
  NULL::BIGINT AS visit_id, NULL::BIGINT AS place FROM b WHERE n = 1
  UNION ALL SELECT subject_id, n + 1, CASE WHEN spot IS NULL THEN list_append(places, own)
    WHEN urgent AND NOT p.u THEN places[:spot - 1] || [{{'e': visit_end, 'o': p.o, 'h': visit_id, 'u': true, 'adm': has_admission, 'k': visit_type}}] || places[spot + 1:]
    WHEN p.adm AND has_ed THEN places[:spot - 1] || [{{'e': p.e, 'o': p.o, 'h': p.h, 'u': true, 'adm': true, 'k': 'Visit/ERIP'}}] || places[spot + 1:]
    ELSE places END, visit_id, coalesce(p.o, visit_id)
  FROM (SELECT *, places[spot] AS p FROM (SELECT w.subject_id, w.n, b.visit_id, urgent, has_ed, has_admission, visit_type, visit_end,
    CASE WHEN w.n = 0 THEN places[:0] ELSE places END AS places,
    {{'e': visit_end, 'o': b.visit_id, 'h': b.visit_id, 'u': urgent, 'adm': has_admission, 'k': visit_type}} AS own,
    nullif(coalesce(list_position([x.e >= visit_end AND x.e >= visit_start FOR x IN CASE WHEN w.n = 0 THEN places[:0] ELSE places END], true), 0), 0) AS spot
    FROM walk w JOIN b ON b.subject_id = w.subject_id AND b.n = w.n + 1))),
ends AS (SELECT subject_id, unnest(arg_max(places, n), recursive := true) FROM walk GROUP BY subject_id)
SELECT b.subject_id, b.visit_id, ends.h AS container_id, ends.k AS merged_type, CASE WHEN b.visit_id <> ends.h THEN b.visit_type END AS dropped_type
FROM walk w JOIN b USING (subject_id, visit_id) JOIN ends ON ends.subject_id = w.subject_id AND ends.o = w.place""",
)
def merge_contained_swapping(spark, d):
    return V.merge_contained_swapping(_contained_blocks(spark, d))


# ---- block attributes --------------------------------------------------------------------------------------------

_CLASSIFY = f"""SELECT subject_id, visit_id,
  bool_or(code = 'signup') AS has_ed, bool_or(code = 'purchase') AS has_admission,
  min(CASE WHEN code = 'error' THEN code END) AS discharged_to,
  CASE WHEN bool_or(code = 'purchase') THEN 'purchase' WHEN bool_or(code = 'signup') THEN 'signup'
    WHEN bool_or("table" = 'visit') THEN arg_min(code, time) FILTER ("table" = 'visit') ELSE 'Visit/OP' END AS visit_type,
  CASE WHEN bool_or(code = 'purchase') THEN min(time) FILTER (code = 'purchase')
    WHEN bool_or(code = 'signup') THEN min(time) FILTER (code = 'signup')
    ELSE coalesce(min(time) FILTER ("table" = 'visit'), min(time)) END AS visit_start,
  coalesce(CASE WHEN bool_or(code IN ('purchase', 'signup')) THEN min(time) FILTER (code = 'error') END,
    arg_min("end", time) FILTER ("table" = 'visit' AND "end" IS NOT NULL), max(time) FILTER ("table" = 'measurement'), max(time)) AS visit_end,
  min(time) AS min_time, max(time) AS max_time
FROM ({LOG_TABLES_SQL}) GROUP BY 1, 2"""


def classified(spark, d):
    return V.classify_blocks(log_with_tables(spark, d), LOG_RULES)


@add("e10_classify_blocks", f"SELECT subject_id, visit_id, has_ed, has_admission, coalesce(discharged_to, '-') AS discharged_to FROM ({_CLASSIFY})")
def classify(spark, d):
    return classified(spark, d).select(
        "subject_id", "visit_id", "has_ed", "has_admission", F.coalesce("discharged_to", F.lit("-")).alias("discharged_to")
    )


@add("e11_visit_type", f"SELECT subject_id, visit_id, visit_type FROM ({_CLASSIFY})")
def visit_type(spark, d):
    return classified(spark, d).select("subject_id", "visit_id", "visit_type")


@add("e12_visit_bounds", f"SELECT subject_id, visit_id, visit_start, visit_end FROM ({_CLASSIFY})")
def visit_bounds(spark, d):
    return classified(spark, d).select("subject_id", "visit_id", "visit_start", "visit_end")


_TEXT = f"SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN numeric_value END AS numeric_value) FROM ({A.LOG_EVENTS_SQL})"


@add(
    "e13_text_to_numeric",
    f"""WITH t AS ({_TEXT}), h AS (SELECT *, numeric_value IS NULL AND code = 'view' AND regexp_matches(text_value, '[0-9][0-9]') AS two,
  numeric_value IS NULL AND code = 'click' AND regexp_matches(text_value, '[0-9]+') AS one FROM t)
SELECT event_id, 'view tens' AS code, regexp_extract(text_value, '([0-9])([0-9])', 1)::DOUBLE AS numeric_value FROM h WHERE two
UNION ALL SELECT event_id, 'view ones', regexp_extract(text_value, '([0-9])([0-9])', 2)::DOUBLE FROM h WHERE two
UNION ALL SELECT event_id, 'click k', regexp_extract(text_value, '([0-9]+)', 1)::DOUBLE FROM h WHERE one
UNION ALL SELECT event_id, code, numeric_value FROM h WHERE NOT two AND NOT one""",
)
def text_to_numeric(spark, d):
    e = A.log_events(spark, d).withColumn("numeric_value", F.when(F.col("event_id") % 2 == 0, F.col("numeric_value")))
    return V.text_to_numeric(e, LOG_RULES.text).select("event_id", "code", "numeric_value")


@add(
    "e14_strip_structural",
    f"""WITH b AS ({_CLASSIFY}), e AS (SELECT subject_id, event_id, CASE WHEN event_id % 17 <> 0 THEN code END AS code,
  CASE WHEN event_id % 19 <> 0 THEN visit_id END AS visit_id FROM ({LOG_TABLES_SQL}))
SELECT event_id, coalesce(code, '-') AS code FROM e WHERE event_id NOT IN (SELECT event_id FROM e JOIN b
  ON e.subject_id = b.subject_id AND e.visit_id = b.visit_id AND b.visit_id % 5 <> 0 WHERE code = visit_type OR code = discharged_to)""",
)
def strip_structural(spark, d):
    """Some events have no code or no visit, and some visits are not listed."""
    i = F.col("event_id")
    e = log_with_tables(spark, d).withColumns(
        {"code": F.when(i % 17 != 0, F.col("code")), "visit_id": F.when(i % 19 != 0, F.col("visit_id"))}
    )
    out = V.strip_structural(e, classified(spark, d).filter("visit_id % 5 <> 0"))
    return out.select("event_id", F.coalesce("code", F.lit("-")).alias("code"))


def _stitched(spark, d, open_end=False):
    from pyspark.sql import Window

    w = Window.partitionBy("subject_id").orderBy("visit_id")  # bounded: one row per day
    blocks = classified(spark, d).withColumn("visit_id", F.row_number().over(w).cast("long"))
    return V.stitch_admissions(blocks, open_end=open_end)


def _stitch_sql(open_end: bool) -> str:
    last = "OR i = last_i" if open_end else ""
    return f"""c AS ({_CLASSIFY}),
b AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY visit_id) AS i, count(*) OVER (PARTITION BY subject_id) AS last_i FROM c),
sim AS (SELECT subject_id, 0::BIGINT AS i, CAST(NULL AS BIGINT) AS ed, CAST(NULL AS BIGINT) AS adm, CAST(NULL AS BIGINT) AS p_from,
    CAST(NULL AS TIMESTAMP) AS ed_max FROM (SELECT DISTINCT subject_id FROM b)
  UNION ALL
  SELECT subject_id, i, CASE WHEN dis THEN NULL WHEN has_admission AND ed1 IS NOT NULL AND near THEN NULL ELSE ed1 END,
    CASE WHEN dis THEN NULL ELSE adm2 END, CASE WHEN dis {last} THEN adm2 END, edmax1 FROM (
    SELECT *, CASE WHEN has_admission AND ed1 IS NULL THEN i WHEN has_admission AND near THEN ed1 ELSE adm END AS adm2 FROM (
      SELECT *, (ed1 = i OR epoch_us(min_time) - epoch_us(edmax1) <= 86400000000) AS near FROM (
        SELECT b.subject_id, b.i, b.last_i, b.has_admission, b.min_time, b.discharged_to IS NOT NULL AS dis, s.adm,
          CASE WHEN b.has_ed AND s.adm IS NULL THEN b.i ELSE s.ed END AS ed1,
          CASE WHEN b.has_ed AND s.adm IS NULL THEN b.max_time ELSE s.ed_max END AS edmax1
        FROM sim s JOIN b ON b.subject_id = s.subject_id AND b.i = s.i + 1)))),
pairs AS (SELECT subject_id, p_from, i AS p_to FROM sim WHERE p_from IS NOT NULL),
tails AS (SELECT p.subject_id, p.p_to + 1 AS i FROM pairs p JOIN b x ON x.subject_id = p.subject_id AND x.i = p.p_to
  JOIN b y ON y.subject_id = p.subject_id AND y.i = p.p_to + 1 WHERE epoch_us(y.min_time) - epoch_us(x.max_time) <= 43200000000),
opens AS (SELECT * FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM tails t WHERE t.subject_id = p.subject_id AND t.i = p.p_from)),
stitched AS (SELECT b.* REPLACE (
  CASE WHEN p.p_from IS NOT NULL OR t.i IS NOT NULL THEN (SELECT max(o.p_from) FROM opens o WHERE o.subject_id = b.subject_id AND o.p_from <= b.i)
    ELSE b.i END AS visit_id,
  CASE WHEN p.p_from IS NOT NULL OR t.i IS NOT NULL THEN 'Visit/IP' ELSE visit_type END AS visit_type)
  FROM b LEFT JOIN pairs p ON p.subject_id = b.subject_id AND b.i BETWEEN p.p_from AND p.p_to
  LEFT JOIN tails t ON t.subject_id = b.subject_id AND t.i = b.i)"""


@add("e15_stitch_admissions", f"WITH RECURSIVE {_stitch_sql(False)} SELECT subject_id, i AS block_id, visit_id, visit_type FROM stitched")
def stitch_admissions(spark, d):
    return _stitched(spark, d).select("subject_id", "block_id", "visit_id", "visit_type")


@add("e15_stitch_open_end", f"WITH RECURSIVE {_stitch_sql(True)} SELECT subject_id, i AS block_id, visit_id, visit_type FROM stitched")
def stitch_open_end(spark, d):
    return _stitched(spark, d, True).select("subject_id", "block_id", "visit_id", "visit_type")


@add(
    "e16_assemble_visits",
    f"""WITH RECURSIVE {_stitch_sql(False)} SELECT subject_id, visit_id, arg_min(visit_type, i) AS visit_type, min(visit_start) AS visit_start,
  max(visit_end) AS visit_end, count(*) AS n_blocks,
  coalesce(CASE WHEN bool_or(has_ed OR has_admission) THEN arg_min(discharged_to, i) FILTER (discharged_to IS NOT NULL) END, 'Unknown')
  AS discharge_facility FROM stitched GROUP BY 1, 2""",
)
def assemble_visits(spark, d):
    return V.assemble_visits(_stitched(spark, d))


@add(
    "e17_age_at_index",
    f"""WITH p AS ({A.PEOPLE_SQL}) SELECT o_orderkey, (CASE WHEN o_custkey % 11 = 0 THEN -1 ELSE year(o_orderdate) - year(birth) -
  (CASE WHEN month(o_orderdate) * 100 + day(o_orderdate) < month(birth) * 100 + day(birth) THEN 1 ELSE 0 END) END)::INT AS age_at_index
FROM orders JOIN p ON person_id = o_custkey""",
)
def age_at_index(spark, d):
    p = A.people(spark, d).withColumn("birth", F.when(F.col("person_id") % 11 != 0, F.col("birth")))
    o = A.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    out = o.join(p, F.col("o_custkey") == F.col("person_id"))
    return out.select("o_orderkey", timing.age_at(F.col("birth"), F.col("t")).alias("age_at_index"))


def _nested(spark, d):
    e = A.visit_events(spark, d).withColumnRenamed("person_id", "subject_id")
    return V.nest_patients(_visits(spark, d), e, ["code", "numeric_value"], part_size=1000)


@add(
    "e18_nested_text",
    f"""WITH e AS (SELECT person_id AS subject_id, visit_id, string_agg(code, ' ' ORDER BY time, event_id) AS codes FROM ({A.VISIT_EVENTS_SQL}) GROUP BY 1, 2)
SELECT subject_id, string_agg(visit_id || ':' || visit_type || ':' || coalesce(codes, ''), '; ' ORDER BY visit_start, visit_id) AS visits
FROM ({_visits_cte()}) v LEFT JOIN e USING (subject_id, visit_id) GROUP BY 1""",
)
def nested_text(spark, d):
    e = A.visit_events(spark, d).withColumnRenamed("person_id", "subject_id")
    rows = V.nest_patients(_visits(spark, d), e, ["code"], part_size=100_000)
    text = F.transform(
        "visits",
        lambda v: F.concat(v["visit_id"].cast("string"), F.lit(":"), v["visit_type"], F.lit(":"), F.array_join(v["events"]["code"], " ")),
    )
    return rows.select("subject_id", F.array_join(text, "; ").alias("visits"))


@add("e18_linked_patients")
def linked_patients(spark, d):
    """All shipped events, a quarter of them without a visit id, to nested patients."""
    e = _shipped(spark, d).withColumns(
        {
            "visit_id": F.when(F.col("event_id") % 4 != 0, F.col("visit_id")),
            "table": F.lit("measurement"),
            "end": F.lit(None).cast("timestamp"),
        }
    )
    return V.linked_patients(e, V.RULE_SETS["linked"], ["code"])


@add("e18_nest_patients")
def nest_patients(spark, d):
    return _nested(spark, d)


@add(
    "e19_split_membership",
    f"SELECT event_id, subject_id FROM ({A.LOG_EVENTS_SQL}) WHERE subject_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 < 7)",
)
def split_membership(spark, d):
    key = F.col("c_custkey")
    splits = A.table(spark, d, "customer").select(
        key.alias("subject_id"), F.when(key % 10 < 7, "train").when(key % 10 < 8, "tuning").otherwise("held_out").alias("split")
    )
    return V.in_split(A.log_events(spark, d), splits, "train").select("event_id", "subject_id")


@add(
    "e20_flatten_visits",
    f"""SELECT e.person_id AS subject_id, e.visit_id, visit_type, visit_start, time, event_id, code, coalesce(numeric_value, -1.0) AS numeric_value
FROM ({A.VISIT_EVENTS_SQL}) e JOIN ({A.visits_sql()}) v USING (person_id, visit_id)""",
)
def flatten_visits(spark, d):
    return V.flatten_visits(_nested(spark, d)).withColumn("numeric_value", F.coalesce("numeric_value", F.lit(-1.0)))
