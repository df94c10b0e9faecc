"""Domain tables to visits and sequences, on hand-made records."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.operators import domains as D
from eventloom.operators.sequence import SequenceOptions

DAY0 = datetime(2020, 1, 1)
VISITS = "person_id long, visit_id long, visit_type string, visit_start timestamp, visit_end timestamp, discharge_facility string"
RECORDS = "person_id long, visit_id long, id long, at timestamp, concept string, number double, unit string"


def at(day, hour=0):
    return DAY0 + timedelta(days=day, hours=hour)


def visits_of(spark, rows):
    return spark.createDataFrame([(p, v, kind, start, end, None) for p, v, kind, start, end in rows], VISITS)


def records_of(spark, rows):
    df = spark.createDataFrame([(*r, None, None) for r in rows], RECORDS)
    return D.Domain("lab", df, "concept", "at", visit_id="visit_id", event_id="id", number="number", unit="unit")


def place(visits, records):
    """Visit and way of each record, by looking at every visit of its person."""
    out, loose = {}, {}
    for p, v, i, when, _ in records:
        own = sorted((x for x in visits if x[0] == p), key=lambda x: (x[3], x[1]))
        if p is not None and v is not None and any(x[1] == v for x in own):
            out[i] = (p, v, "linked")
        elif p is not None and when is not None:
            day = when.date()
            hit = next((x for x in own if x[3].date() <= day <= (x[4] or x[3]).date()), None)
            if hit:
                out[i] = (p, hit[1], "attached")
            else:
                loose.setdefault(p, {}).setdefault(day, []).append(i)
    for p, days in loose.items():
        top = max((x[1] for x in visits if x[0] == p), default=0)
        for n, day in enumerate(sorted(days), 1):
            out.update({i: (p, top + n, "orphan") for i in days[day]})
    return out


def placed(spark, visits, records):
    events = D.domain_events([records_of(spark, records)])
    everything, got = D.join_visits(events, visits_of(spark, visits))
    rows = {r.event_id: (r.person_id, r.visit_id, r.how) for r in got.collect()}
    assert got.count() == len(rows)
    return everything, rows


def test_every_record_finds_its_visit(spark):
    visits = [
        (1, 5, "Visit/IP", at(0), at(9)),
        (1, 6, "Visit/OP", at(3), None),
        (1, 2, "Visit/IP", at(20), at(22, 5)),
        (2, 7, "Visit/OP", at(0), None),
    ]
    records = [
        (1, 6, 1, at(100), "a"),  # far from its visit, but it names it
        (1, None, 2, at(3, 4), "a"),  # two cover the day
        (1, 99, 3, at(22, 23), "a"),  # not a visit; the last day of a stay
        (1, None, 4, at(10), "a"),
        (1, None, 5, at(10, 3), "a"),
        (1, 7, 6, at(-3), "a"),  # another person's visit
        (2, None, 7, at(1), "a"),
        (3, None, 8, at(0), "a"),  # nobody's visits
        (3, None, 9, None, "a"),
        (2, 7, 10, None, "a"),  # untimed, in its visit
        (None, 7, 11, at(0), "a"),
    ]
    everything, rows = placed(spark, visits, records)
    assert rows == place(visits, records) and set(rows) == {1, 2, 3, 4, 5, 6, 7, 8, 10}
    made = {(r.person_id, r.visit_id): (r.visit_type, r.visit_start) for r in everything.collect() if r.visit_id not in (2, 5, 6, 7)}
    assert made[1, 9] == ("Visit/OP", at(10)) if (1, 9) in made else True
    assert ("Visit/OP", at(10)) in made.values() and everything.count() == len(visits) + len({v[:2] for v in rows.values() if v[2] == "orphan"})


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.integers(1, 3), st.integers(0, 30), st.none() | st.integers(0, 12)), max_size=9),
    st.lists(st.tuples(st.integers(1, 3), st.none() | st.integers(1, 12), st.integers(-2, 45), st.integers(0, 23)), min_size=1, max_size=25),
)
def test_places_match_a_search_of_all_visits(spark, visits, records):
    visits = [(p, i + 1, "Visit/IP", at(s), None if n is None else at(s + n, 7)) for i, (p, s, n) in enumerate(visits)]
    records = [(p, v, i, at(day, hour), "a") for i, (p, v, day, hour) in enumerate(records)]
    _, rows = placed(spark, visits, records)
    assert rows == place(visits, records)


@pytest.mark.parametrize("split", [False, True])
def test_a_person_with_most_records(spark, split, request):
    if split:
        request.getfixturevalue("split_everything")
    visits = [(1, v, "Visit/IP", at(10 * v), at(10 * v + 4)) for v in range(1, 60)]
    records = [(1 if i % 10 else 2, None, i, at(i % 700, i % 24), "a") for i in range(5000)]
    _, rows = placed(spark, visits, records)
    assert rows == place(visits, records)


PEOPLE = "person_id long, birth timestamp, gender string, race string"


def tokens(spark, visits, records, **options):
    people = spark.createDataFrame([(p, datetime(1980, 5, 5), "F", "R") for p in (1, 2, 3)], PEOPLE)
    seq = D.domain_sequences([records_of(spark, records)], visits_of(spark, visits), people, options=SequenceOptions(gap="day"), **options)
    out = {}
    for r in seq.orderBy("person_id", "pos").collect():
        out.setdefault(r.person_id, []).append(r.token)
    return out


def test_sequences_end_with_death(spark):
    visits = [(1, 1, "Visit/OP", at(0), None), (1, 2, "Visit/IP", at(5), at(8)), (2, 1, "Visit/OP", at(0), None)]
    records = [(1, 1, 1, at(0), "a"), (1, None, 2, at(6), "b"), (2, None, 3, at(4), "a"), (3, None, 4, at(0), "a")]
    deaths = spark.createDataFrame([(1, at(3)), (1, at(30)), (2, at(9)), (2, None), (3, None), (9, at(1))], "person_id long, time timestamp")
    got = tokens(spark, visits, records, min_patients=None, deaths=deaths)
    # person 1 died, by the table, before the end of a stay; visit 1 of person 2 has no events
    assert got[1] == ["[VS]", "a", "[VE]", "D5", "[VS]", "b", "[VE]", "D0", "[VS]", "[DEATH]", "[VE]"]
    assert got[2] == ["[VS]", "a", "[VE]", "D5", "[VS]", "[DEATH]", "[VE]"]
    assert got[3] == ["[VS]", "a", "[VE]"]


def test_only_qualified_concepts_take_part(spark):
    records = [(p, None, p * 10 + k, at(k), c) for p in (1, 2, 3) for k, c in enumerate("abc") if c != "b" or p == 1]
    records += [(1, None, 100, at(9), None), (1, None, 101, at(9), "b")]
    got = tokens(spark, [], records, min_patients=3)
    assert {t for ts in got.values() for t in ts} == {"[VS]", "[VE]", "a", "c", "D2"}
    # people are counted over all dates, records before the start date go
    assert set(tokens(spark, [], records, min_patients=3, start_date="2020-01-02")[1]) == {"[VS]", "c", "[VE]"}
    assert tokens(spark, [], [], min_patients=1) == {}


def test_domains_without_optional_columns(spark):
    df = spark.createDataFrame([(1, "x", at(0))], "person_id long, c string, t timestamp")
    row = D.domain_events([D.Domain("condition", df, "c", "t")]).first()
    assert row.asDict() == {
        "person_id": 1, "visit_id": None, "event_id": None, "time": at(0), "code": "x",
        "numeric_value": None, "text_value": None, "unit": None, "table": "condition",
    }
    assert D.domain_events([D.Domain("condition", df, "c", "t")], "2021-01-01").filter(F.col("code").isNotNull()).count() == 0
