"""The token sequence as plain SQL over the test tables, for checking the Spark build."""

from __future__ import annotations

from ..operators.sequence import SequenceOptions
from ..sources import adapters as A

CLEAN = "regexp_replace({}, '\\s+', '_', 'g')"


def token_sql(days: str, kind: str) -> str:
    d = f"greatest({days}, 0)"
    return {
        "week_month": f"CASE WHEN {d} < 28 THEN 'W' || ({d} // 7) "
        f"WHEN {d} <= 365 THEN 'M' || least(greatest({d} // 30, 1), 11) ELSE 'LT' END",
        "day": f"'D' || {d}",
        "week": f"'W' || ({d} // 7)",
        "month": f"'M' || ({d} // 30)",
        "mix": f"CASE WHEN {d} < 7 THEN 'D' || {d} WHEN {d} < 28 THEN 'W' || ({d} // 7) "
        f"WHEN {d} <= 365 THEN 'M' || ({d} // 30) ELSE 'LT' END",
        "none": "NULL",
    }[kind]


def sequence_ctes(
    options: SequenceOptions, visits: str | None = None, events: str = A.VISIT_EVENTS_SQL, stays: tuple[str, ...] = ("Visit/ER", "Visit/IP")
) -> str:
    """CTEs ``subj, vis0, evt, vis, …, seq`` over the given visits and events; start the statement with WITH RECURSIVE."""
    stay_types = "', '".join(stays)
    gap_tok, stay_tok = token_sql("gap_days", options.gap), token_sql("move_days", options.stay)
    blank = "0 AS week, -1 AS age, -1.0 AS value, 0 AS value_mask, 'N/A' AS unit"
    parts = [
        f"""SELECT person_id, visit_id, visit_type, visit_order, segment, 2 AS k, 0 AS r, 0 AS s, 'start' AS kind, '[VS]' AS token,
  floor(epoch_us(visit_start) / 604800e6)::INT AS week, date_sub('year', birth, visit_start)::INT AS age, -1.0 AS value,
  0 AS value_mask, 'N/A' AS unit, epoch_us(visit_start) / 1e6 AS epoch FROM v2""",
        """SELECT person_id, visit_id, visit_type, visit_order, segment, 6, 0, 0, 'end', '[VE]',
  floor(epoch_us(last_at) / 604800e6)::INT, date_sub('year', birth, last_at)::INT, -1.0, 0, 'N/A', epoch_us(end_cursor) / 1e6 FROM v2""",
        """SELECT e.person_id, e.visit_id, visit_type, visit_order, segment, 4, rank, 1, 'event', token,
  floor(epoch_us(CASE WHEN v2.is_stay THEN e.time ELSE v2.visit_start END) / 604800e6)::INT,
  date_sub('year', v2.birth, CASE WHEN v2.is_stay THEN e.time ELSE v2.visit_start END)::INT, value, value_mask, unit,
  epoch_us(CASE WHEN v2.is_stay THEN coalesce(e.cursor, v2.visit_start) ELSE v2.visit_start END) / 1e6
  FROM ev3 e JOIN v2 USING (person_id, visit_id)""",
    ]
    if options.gap != "none":
        parts.append(
            f"""SELECT person_id, visit_id, '0', visit_order, 0, 1, 0, 0, 'gap', {gap_tok}, {blank}, epoch_us(visit_start) / 1e6
  FROM v2 WHERE visit_seq > 1"""
        )
    if options.stay != "none":
        parts.append(
            f"""SELECT e.person_id, e.visit_id, visit_type, visit_order, segment, 4, rank, 0, 'stay_gap', 'i-' || {stay_tok}, {blank},
  epoch_us(e.time) / 1e6 FROM ev3 e JOIN v2 USING (person_id, visit_id) WHERE moved"""
        )
    if options.auxiliary:
        parts.append(
            """SELECT person_id, visit_id, visit_type, visit_order, segment, 3, 0, 0, 'type', visit_type,
  floor(epoch_us(visit_start) / 604800e6)::INT, date_sub('year', birth, visit_start)::INT, -1.0, 0, 'N/A',
  epoch_us(visit_start) / 1e6 FROM v2"""
        )
        parts.append(
            """SELECT person_id, visit_id, visit_type, visit_order, segment, 5, 0, 0, 'discharge', coalesce(discharge_facility, '0'),
  floor(epoch_us(last_at) / 604800e6)::INT, date_sub('year', birth, last_at)::INT, -1.0, 0, 'N/A', epoch_us(end_cursor) / 1e6
  FROM v2 WHERE is_stay"""
        )
    if options.prompt:
        for i, expr in enumerate(
            ["'year:' || year(visit_start)", "'age:' || date_sub('year', birth, visit_start)", "gender", "race"]
        ):
            parts.append(
                f"""SELECT person_id, 0, '0', 0, 0, 0, {i}, 0, 'prompt', {expr}, {blank}, epoch_us(visit_start) / 1e6
  FROM vis WHERE visit_order = 1"""
            )
    union = "\nUNION ALL ".join(parts)
    code, text = CLEAN.format("code"), CLEAN.format("text_value")
    return f"""
subj AS ({A.PEOPLE_SQL}), vis0 AS ({visits or A.visits_sql()}), evt AS ({events}),
vis AS (SELECT v.*, birth, gender, race, visit_type IN ('{stay_types}') AS is_stay,
  row_number() OVER (PARTITION BY v.person_id ORDER BY visit_start, visit_id) AS visit_order
  FROM vis0 v JOIN subj USING (person_id)),
ev1 AS (SELECT e.person_id, e.visit_id, event_id, e.time, code, is_stay, visit_start,
  CASE WHEN numeric_value IS NULL AND text_value IS NOT NULL THEN {code} || '//option:' || {text} ELSE {code} END AS token,
  coalesce(numeric_value, -1.0) AS value, (numeric_value IS NOT NULL)::INT AS value_mask, coalesce(unit, 'N/A') AS unit
  FROM evt e JOIN vis USING (person_id, visit_id) WHERE e.time IS NOT NULL),
ev2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id, visit_id, token, value
  ORDER BY time, code, event_id, unit) AS dup FROM ev1) WHERE is_stay OR dup = 1),
times AS (SELECT DISTINCT person_id, visit_id, visit_start, time FROM ev2 WHERE is_stay),
mv AS (SELECT DISTINCT person_id, visit_id, visit_start AS cur, CAST(NULL AS TIMESTAMP) AS prev FROM times
  UNION ALL SELECT m.person_id, m.visit_id, min(t.time), m.cur FROM mv m JOIN times t
  ON m.person_id = t.person_id AND m.visit_id = t.visit_id AND t.time >= m.cur + INTERVAL 1 DAY
  GROUP BY m.person_id, m.visit_id, m.cur),
moves AS (SELECT person_id, visit_id, cur AS time, (epoch_us(cur) - epoch_us(prev)) // 86400000000 AS move_days
  FROM mv WHERE prev IS NOT NULL),
ev3 AS (SELECT e.*, move_days,
  row_number() OVER (PARTITION BY e.person_id, e.visit_id ORDER BY e.time, code, event_id, token, value, unit) AS rank,
  max(m.time) OVER (PARTITION BY e.person_id, e.visit_id ORDER BY e.time, code, event_id, token, value, unit) AS cursor,
  m.time IS NOT NULL AND row_number() OVER (PARTITION BY e.person_id, e.visit_id, e.time ORDER BY code, event_id, token, value, unit) = 1 AS moved
  FROM ev2 e LEFT JOIN moves m ON e.person_id = m.person_id AND e.visit_id = m.visit_id AND e.time = m.time),
v1 AS (SELECT vis.*, last_time,
  CASE WHEN is_stay THEN coalesce(visit_end, last_cursor, visit_start) ELSE visit_start END AS end_cursor,
  CASE WHEN is_stay THEN coalesce(last_time, visit_start) ELSE visit_start END AS last_at
  FROM vis JOIN (SELECT person_id, visit_id, max(time) AS last_time, max(cursor) AS last_cursor FROM ev3 GROUP BY ALL)
  USING (person_id, visit_id)),
v2 AS (SELECT *, row_number() OVER w AS visit_seq, (1 + (row_number() OVER w - 1) % 2)::INT AS segment,
  CAST(floor((epoch_us(visit_start) - epoch_us(lag(end_cursor) OVER w)) / 86400e6) AS BIGINT) AS gap_days
  FROM v1 WINDOW w AS (PARTITION BY person_id ORDER BY visit_start, visit_id)),
tokens AS ({union}),
seq AS (SELECT person_id, row_number() OVER (PARTITION BY person_id ORDER BY visit_order, k, r, s) AS pos, kind, token,
  visit_id, visit_type, visit_order, segment, week, age, value, value_mask, value_mask AS mlm_skip, unit, epoch FROM tokens)"""


def sequence_sql(options: SequenceOptions, select: str) -> str:
    return f"WITH RECURSIVE {sequence_ctes(options)}\n{select}"
