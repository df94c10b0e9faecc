"""Relational domain tables (conditions, drugs, procedures, measurements, deaths) to visits and sequences.

Records of all domains become one table of events. Those that name a visit of their person go there; the others look for a visit
that covers their day, and what finds none becomes a visit of its own. Covering visits are found by a scan over record ends of
visits and days together (:func:`visits.place_days`), so no pair of a record and a visit is formed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, stage_within
from .sequence import SequenceOptions, build_sequence, qualified_concepts
from .visits import OUTPATIENT_TYPE, place_days

# Fixed value: the token that ends the sequence of a person who died.
DEATH = "[DEATH]"

PERSON_VISIT = ["person_id", "visit_id"]
EVENT_COLUMNS = ["person_id", "visit_id", "event_id", "time", "code", "numeric_value", "text_value", "unit", "table"]


@dataclass(frozen=True)
class Domain:
    """A domain table and the names of its columns; those left out are null for all its records."""

    name: str
    table: DataFrame
    concept: str
    time: str
    visit_id: str | None = None
    event_id: str | None = None
    number: str | None = None
    text: str | None = None
    unit: str | None = None


def domain_events(domains: Sequence[Domain], start_date: str | None = None) -> DataFrame:
    """Records of all domains in the columns ``EVENT_COLUMNS``, from ``start_date`` on; records without a time are events too.

    With ``start_date`` those without a time are left out.
    """
    out = None
    for d in domains:
        named = lambda column, kind: (F.col(column) if column else F.lit(None)).cast(kind)
        part = d.table.select(
            F.col("person_id"),
            named(d.visit_id, "long").alias("visit_id"),
            named(d.event_id, "long").alias("event_id"),
            F.col(d.time).cast("timestamp").alias("time"),
            F.col(d.concept).cast("string").alias("code"),
            named(d.number, "double").alias("numeric_value"),
            named(d.text, "string").alias("text_value"),
            named(d.unit, "string").alias("unit"),
            F.lit(d.name).alias("table"),
        )
        out = part if out is None else out.unionByName(part)
    return out if start_date is None else out.filter(F.col("time") >= F.lit(start_date).cast("timestamp"))


def qualified_events(
    domains: Sequence[Domain], start_date: str | None = None, min_patients: int = 100, by_person: bool = False
) -> DataFrame:
    """:func:`domain_events` from ``start_date`` on, of concepts seen in at least ``min_patients`` people at whatever date.

    The records of all dates are written once, for the count of people and for the events; ``by_person`` they are read from their tables.
    """
    records = domain_events(domains).filter(F.col("code").isNotNull())
    if not by_person:
        records = stage(records, "domain-records")
    concepts = qualified_concepts(records, min_patients, dealt_out=by_person)
    concepts = stage(concepts.select("code"), "qualified-concepts")
    events = records if start_date is None else records.filter(F.col("time") >= F.lit(start_date).cast("timestamp"))
    return events.join(concepts, "code", "left_semi")


def join_visits(
    events: DataFrame, visits: DataFrame, loose_type: str = OUTPATIENT_TYPE, by_person: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``visits`` with the visits made for loose records, and ``events`` with the visit each ends up in and ``how`` it got there.

    linked: the record names a visit of its person. attached: it names none, or one that is not listed, and its day lies within
    visits; the first of them by (start, id) takes it. orphan: no visit covers its day; the loose records of a day are a visit
    of ``loose_type``, numbered past the person's highest id, that starts with the first of them. A record without a time that
    names no listed visit has no place and is left out, as is one without a person.
    """
    placed = _kept(place_events(events, visits, by_person), "placed-events", by_person)
    made = placed.filter("how = 'orphan'").groupBy(*PERSON_VISIT).agg(F.min("time").alias("visit_start"))
    made = made.withColumn("visit_type", F.lit(loose_type))
    return visits.unionByName(made, allowMissingColumns=True), placed


def _kept(df: DataFrame, label: str, by_person: bool) -> DataFrame:
    return stage_within(df, "person_id", label) if by_person else stage(df, label)


def place_events(events: DataFrame, visits: DataFrame, by_person: bool = False) -> DataFrame:
    """The events of :func:`join_visits` with their visit and ``how``.

    ``events`` are scanned three times. Only those that name a visit meet the visits and are written; the others go by their day alone.
    """
    known = events.filter(F.col("person_id").isNotNull())
    listed = visits.select(*PERSON_VISIT, F.lit(True).alias("__listed"))
    marked = _kept(known.filter(F.col("visit_id").isNotNull()).join(listed, PERSON_VISIT, "left"), "domain-events", by_person)
    linked = marked.filter("__listed").drop("__listed").withColumn("how", F.lit("linked"))
    astray = marked.filter("__listed IS NULL").drop("__listed")
    loose = known.filter(F.col("visit_id").isNull()).unionByName(astray).filter(F.col("time").isNotNull()).drop("visit_id")
    loose = loose.withColumn("day", F.to_date("time"))
    days = _kept(loose.select("person_id", "day").distinct(), "loose-days", by_person).withColumnRenamed("person_id", "subject_id")
    taken = visits.withColumnRenamed("person_id", "subject_id")
    where = place_days(days, taken, taken)
    placed = loose.join(where.withColumnRenamed("subject_id", "person_id"), ["person_id", "day"]).drop("day")
    return linked.unionByName(placed)


def death_visits(deaths: DataFrame, visits: DataFrame, events: DataFrame, by_person: bool = False) -> tuple[DataFrame, DataFrame]:
    """A last visit with the single event ``DEATH`` for each person of ``deaths`` (person_id, time) who has visits.

    It stands at the first death date given, but not before the end of anything recorded. People with a null date have none.
    """
    last = visits.groupBy("person_id").agg(
        F.max(F.greatest("visit_start", "visit_end")).alias("__last"), F.max("visit_id").alias("__top")
    )
    seen = events.groupBy("person_id").agg(F.max("time").alias("__seen"))
    died = deaths.filter(F.col("time").isNotNull()).groupBy("person_id").agg(F.min("time").alias("time"))
    rows = died.join(last, "person_id").join(seen, "person_id", "left").select(
        "person_id",
        (F.col("__top") + 1).alias("visit_id"),
        F.greatest("time", "__last", "__seen").alias("visit_start"),
        F.lit(DEATH).alias("visit_type"),
    )
    rows = _kept(rows, "death-visits", by_person)
    event = rows.select(*PERSON_VISIT, F.lit(0).cast("long").alias("event_id"), F.col("visit_start").alias("time"), F.lit(DEATH).alias("code"))
    return rows, event


def domain_sequences(
    domains: Sequence[Domain],
    visits: DataFrame,
    people: DataFrame,
    *,
    start_date: str | None = None,
    min_patients: int | None = 100,
    deaths: DataFrame | None = None,
    options: SequenceOptions = SequenceOptions(gap="day", stay="day"),
    by_person: bool = False,
) -> DataFrame:
    """Token sequences from domain tables, in the columns of :func:`sequence.build_sequence`.

    Only records of concepts seen in at least ``min_patients`` people, at whatever date, take part (None: all). ``visits`` are those of
    ``build_sequence``; records are placed by :func:`join_visits`. With ``deaths`` the sequence of a person who died ends with a visit
    of its own that holds the death token, a time token in front of it like any visit.

    ``by_person``: the tables of the domains and the visits are dealt out by person, as :func:`session.stage_within` leaves them, in a
    :func:`session.session_within`, and all rows of a person fit a task. What is staged stays dealt out so, and only ``people`` and
    ``deaths`` are shuffled.
    """
    if min_patients is not None:
        events = qualified_events(domains, start_date, min_patients, by_person)
    else:
        events = _kept(domain_events(domains, start_date).filter(F.col("code").isNotNull()), "domain-records", by_person)
    visits, events = join_visits(events, visits, by_person=by_person)
    visits, events = visits if by_person else stage(visits, "domain-visits"), events.drop("table", "how")
    if deaths is not None:
        last_visits, last_events = death_visits(deaths, visits, events, by_person)
        visits = visits.unionByName(last_visits, allowMissingColumns=True)
        events = events.unionByName(last_events, allowMissingColumns=True)
    return build_sequence(visits, events, people, options, by_person)
