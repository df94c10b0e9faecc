"""Flat events to visits.

Two profiles share the block form: *linked* (events may carry a visit id) and *calendar day* (no visit ids; days are
stitched into stays). Blocks are rows ``(subject_id, visit_id, …)``; events are joined to them by key and never collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.scan import int_levels, largest_group, ordered_scan, time_levels
from ..functions.text import starts_with_any
from ..functions.timing import floor_days
from ..session import parts, stage, stage_by

# Names of visit types, source tables and demographic code prefixes.
UNKNOWN = "Unknown"
ED_TYPE, OUTPATIENT_TYPE, INPATIENT_TYPE, ED_TO_INPATIENT_TYPE = "Visit/ER", "Visit/OP", "Visit/IP", "Visit/ERIP"
VISIT_TABLES = ("visit", "visit_occurrence")
END_DATING_TABLES = (
    "measurement",
    "procedure",
    "procedure_occurrence",
    "observation",
)
DEMOGRAPHIC_PREFIXES = {"birth": "MEDS_BIRTH", "race": "RACE", "gender": "GENDER", "ethnicity": "ETHNICITY"}

BLOCK_KEY = ["subject_id", "visit_id"]


@dataclass(frozen=True)
class TextRule:
    """Text of ``code`` is searched for ``pattern``; each regex group becomes an event with the label at its place."""

    code: str
    pattern: str
    labels: tuple[str, ...]


@dataclass(frozen=True)
class VisitRules:
    """Literal code prefixes that mark visit events, and text-to-number rules."""

    visit: tuple[str, ...] = ()
    ed: tuple[str, ...] = ()
    admission: tuple[str, ...] = ()
    discharge: tuple[str, ...] = ()
    text: tuple[TextRule, ...] = field(default=())


# The two rule sets.
_PRESSURE = (
    "Blood Pressure",
    "Blood Pressure Lying",
    "Blood Pressure Sitting",
    "Blood Pressure Standing (1 min)",
    "Blood Pressure Standing (3 mins)",
)
RULE_SETS = {
    "hospital_day": VisitRules(
        ed=("ED_REGISTRATION//", "TRANSFER_TO//ED"),
        admission=("HOSPITAL_ADMISSION//",),
        discharge=("HOSPITAL_DISCHARGE//",),
        text=tuple(TextRule(c, r"(\d+)/(\d+)", (f"Systolic {c}", f"Diastolic {c}")) for c in _PRESSURE)
        + tuple(TextRule(c, r"(\d+)", (c,)) for c in ("Weight (Lbs)", "Height (Inches)", "BMI (kg/m2)"))
        + (TextRule("LAB//50827//UNK", r"(\d+)/(\d+)", ("LAB//50827//UNK//1", "LAB//50827//UNK//2")),),
    ),
    "linked": VisitRules(
        visit=("Visit/",),
        ed=("Visit/ER",),
        admission=("Visit/IP", "Visit/ERIP", "CMS Place of Service/51", "CMS Place of Service/61"),
        discharge=(
            "PCORNet/Generic-NI",
            "CMS Place of Service/12",
            "SNOMED/371827001",
            "CMS Place of Service/21",
            "NUCC/261Q00000X",
            "CMS Place of Service/31",
            "SNOMED/397709008",
            "Medicare Specialty/A4",
            "SNOMED/225928004",
            "CMS Place of Service/34",
            "CMS Place of Service/61",
            "CMS Place of Service/51",
            "CMS Place of Service/23",
            "PCORNet/Generic-OT",
            "CMS Place of Service/27",
            "CMS Place of Service/24",
            "CMS Place of Service/09",
            "CMS Place of Service/33",
            "SNOMED/34596002",
            "CMS Place of Service/25",
            "CMS Place of Service/32",
            "CMS Place of Service/20",
        ),
    ),
}


# ---- subjects --------------------------------------------------------------------------------------------------


def _is_demographic(code: Column) -> Column:
    return starts_with_any(F.upper(code), tuple(DEMOGRAPHIC_PREFIXES.values()))


def demographics(events: DataFrame) -> DataFrame:
    """``birth, race, gender, ethnicity`` per subject: the last in source order wins, missing ones are Unknown."""

    def last(prefix: str, what: Column) -> Column:
        return F.max_by(what, F.when(F.upper("code").startswith(prefix), F.col("event_id")))

    p = DEMOGRAPHIC_PREFIXES
    return events.groupBy("subject_id").agg(
        last(p["birth"], F.col("time")).alias("birth"),
        *[
            F.coalesce(last(p[c], F.col("code")), F.lit(UNKNOWN)).alias(c)
            for c in ("race", "gender", "ethnicity")
        ],
    )


def observation_window(events: DataFrame, cohort: DataFrame, days: int | None = None) -> DataFrame:
    """Events at or before ``prediction_time`` and within ``days`` before it; demographics are always kept."""
    out = events.join(cohort, "subject_id")
    inside = F.col("time") <= F.col("prediction_time")
    if days is not None:
        inside &= F.col("time") >= F.col("prediction_time") - F.make_dt_interval(F.lit(days))
    return out.filter(inside | _is_demographic(F.col("code")))


def in_split(df: DataFrame, splits: DataFrame, name: str, key: str = "subject_id") -> DataFrame:
    """Rows of the subjects that belong to a named split."""
    return df.join(splits.filter(F.col("split") == name).select(key), key, "left_semi")


# ---- linked profile --------------------------------------------------------------------------------------------


def link_visits(events: DataFrame) -> DataFrame:
    """One row per linked visit with its extent."""
    return (
        events.filter(F.col("visit_id").isNotNull())
        .groupBy(*BLOCK_KEY)
        .agg(F.min("time").alias("min_time"), F.max("time").alias("max_time"), F.count(F.lit(1)).alias("n_events"))
    )


def day_blocks(events: DataFrame) -> DataFrame:
    """One row per subject and calendar day, numbered from 1: ``day, visit_id, min_time, max_time, n_events``."""
    days = (
        events.filter(F.col("time").isNotNull())
        .groupBy("subject_id", F.to_date("time").alias("day"))
        .agg(F.min("time").alias("min_time"), F.max("time").alias("max_time"), F.count(F.lit(1)).alias("n_events"))
    )
    w = Window.partitionBy("subject_id").orderBy("day")  # bounded: one row per day
    return days.withColumn("visit_id", F.row_number().over(w).cast("long"))


def end_or_day_end(start: Column, end: Column) -> Column:
    """A visit without an end lasts to the end of its first day."""
    day_end = F.date_trunc("day", start) + F.expr("INTERVAL '0 23:59:59.999999' DAY TO SECOND")
    return F.coalesce(end, day_end)


def detach_out_of_range(events: DataFrame, visits: DataFrame, days: int = 1) -> DataFrame:
    """Adds ``detached``: the event lies more than ``days`` whole days outside its visit.

    An event without a time, or whose visit is not among ``visits``, is not detached.
    """
    bounds = visits.select(*BLOCK_KEY, "visit_start", "visit_end")
    out = events.join(bounds, BLOCK_KEY, "left")
    end = end_or_day_end(F.col("visit_start"), F.col("visit_end"))
    early = floor_days(F.col("visit_start"), F.col("time")) > days
    late = floor_days(F.col("time"), end) > days
    return out.withColumn("detached", F.coalesce(early | late, F.lit(False))).drop("visit_start", "visit_end")


def _record_ends(visits: DataFrame, end: Column, largest: int | None = None) -> DataFrame:
    """Visits that end later than every visit before them in (start, id) order.

    Whatever ``x`` is, the first visit in order with ``end >= x`` is one of these, and their ends increase, so
    looking for a first container is a search for the next record end: no pair of visits is ever formed.
    """
    out = ordered_scan(
        visits.withColumn("__end", end),
        ["subject_id"],
        time_levels(F.col("visit_start")),
        [F.col("visit_start"), F.col("visit_id")],
        before_max={"__end_before": F.col("__end")},
        largest=largest,
    )
    return out.withColumn("is_record", F.col("__end_before").isNull() | (F.col("__end_before") < F.col("__end")))


def attach_days(days: DataFrame, visits: DataFrame) -> DataFrame:
    """For each ``(subject_id, day)`` the first visit that covers the day: ``subject_id, day, visit_id``."""
    asked = stage(days.select("subject_id", "day").distinct(), "asked-days")
    return cover_days(asked, visits).filter("covered").drop("covered")


def cover_days(days: DataFrame, visits: DataFrame) -> DataFrame:
    """``days``, each given once, with the ``visit_id`` of the first visit that covers the day, and whether one is ``covered`` at all.

    ``days`` are scanned twice: for the size of the largest group and for the search.
    """
    most = largest_group(visits, ["subject_id"])
    end_day = F.to_date(end_or_day_end(F.col("visit_start"), F.col("visit_end")))
    records = _record_ends(visits.select(*BLOCK_KEY, "visit_start", "visit_end"), end_day, most).filter("is_record")
    points = records.select(
        "subject_id",
        F.col("__end").alias("day"),
        F.lit(0).alias("asks"),
        F.struct(F.col("visit_id"), F.to_date("visit_start").alias("from_day")).alias("visit"),
    ).unionByName(days.select("subject_id", "day", F.lit(1).alias("asks")), allowMissingColumns=True)
    most += largest_group(days, ["subject_id"])
    if most > scan.SPLIT_ABOVE:  # scanned more than once then
        points = stage(points, "covering-visits")
    back = -F.unix_date("day")  # scan from the last day to the first, records before questions
    found = ordered_scan(
        points, ["subject_id"], int_levels(back, (9,)), [back, F.col("asks")], fill={"hit": F.col("visit")}, largest=most
    )
    covers = F.coalesce(F.col("hit.from_day") <= F.col("day"), F.lit(False))
    return found.filter("asks = 1").select("subject_id", "day", F.when(covers, F.col("hit.visit_id")).alias("visit_id"), covers.alias("covered"))


def orphan_visits(days: DataFrame, visits: DataFrame) -> DataFrame:
    """New visit ids for the days given: past the subject's highest id, in day order (from 1 with no visits)."""
    distinct = days.select("subject_id", "day").distinct().select("*", F.lit(None).cast("long").alias("visit_id"), F.lit(False).alias("covered"))
    return _number_orphans(distinct, visits).select("subject_id", "day", "visit_id")


def _number_orphans(placed: DataFrame, visits: DataFrame) -> DataFrame:
    """The days of :func:`cover_days` with ids for those that are not covered, as :func:`orphan_visits`, and ``how``: attached or orphan."""
    top = visits.groupBy("subject_id").agg(F.max("visit_id").alias("__top"))
    w = Window.partitionBy("subject_id", "covered").orderBy("day")  # bounded: one row per day
    made = F.coalesce("__top", F.lit(0)) + F.col("__n")
    return placed.withColumn("__n", F.row_number().over(w)).join(top, "subject_id", "left").select(
        "subject_id",
        "day",
        F.when(F.col("covered"), F.col("visit_id")).otherwise(made).alias("visit_id"),
        F.when(F.col("covered"), "attached").otherwise("orphan").alias("how"),
    )


def place_days(days: DataFrame, visits: DataFrame, taken: DataFrame) -> DataFrame:
    """``days``, each given once, with ``visit_id`` and ``how``: attached to the first visit that covers the day, or an orphan.

    Orphans are numbered past the highest id in ``taken``. The days go from the search to their numbers without a further shuffle.
    """
    return _number_orphans(cover_days(days, visits), taken)


def assign_events(events: DataFrame, visits: DataFrame) -> DataFrame:
    """The linked profile end to end: every event gets the visit it ends up in.

    Out-of-range events are detached, unlinked days go to a covering visit, the rest become visits of their own.
    Adds ``visit_id`` (final) and ``how``: linked, attached, orphan or untimed. No event is lost: a visit id that ``visits`` does
    not list is a visit nevertheless, and an event without a time keeps the id it has, or none.
    """
    marked = stage(detach_out_of_range(events, visits), "marked-events")  # events are read once
    untimed = marked.filter("time IS NULL").drop("detached").withColumn("how", F.lit("untimed"))
    named = marked.filter("time IS NOT NULL AND visit_id IS NOT NULL")
    stays = named.filter(~F.col("detached")).drop("detached").withColumn("how", F.lit("linked"))
    loose = marked.filter("time IS NOT NULL AND (visit_id IS NULL OR detached)").drop("detached", "visit_id")
    loose = loose.withColumn("day", F.to_date("time"))
    days = stage(loose.select("subject_id", "day").distinct(), "loose-days")
    taken = visits.select(*BLOCK_KEY).union(named.select(*BLOCK_KEY))
    where = place_days(days, visits, taken)
    return stays.unionByName(loose.join(where, ["subject_id", "day"]).drop("day")).unionByName(untimed)


def order_blocks(blocks: DataFrame) -> DataFrame:
    """``block_order`` from 1 by (start, id)."""
    return ordered_scan(
        blocks,
        ["subject_id"],
        time_levels(F.col("visit_start")),
        [F.col("visit_start"), F.col("visit_id")],
        count="block_order",
    )


# ---- containment -----------------------------------------------------------------------------------------------


def merge_contained(blocks: DataFrame) -> DataFrame:
    """``container_id`` per block: the first block, in (start, id) order, that wholly contains it; else itself.

    ``merged_type`` is the survivor's type, or the ED-to-inpatient type where an admission contains an ED visit.
    Needs ``subject_id, visit_id, visit_type, visit_start, visit_end, has_ed, has_admission``.
    """
    largest = largest_group(blocks, ["subject_id"])
    marked = _record_ends(blocks, F.col("visit_end"), largest)
    own = F.when(F.col("is_record"), F.struct("visit_id", "visit_type", "has_admission"))
    back = -F.unix_micros("visit_end")
    order = [back, (~F.col("is_record")).cast("int"), F.col("visit_id")]
    # -2^42 and -2^31 microseconds: about 51 days and 36 minutes
    levels = int_levels(back, (42, 31))
    found = ordered_scan(marked, ["subject_id"], levels, order, fill={"__into": own}, largest=largest)
    found = found.select(
        *BLOCK_KEY,
        F.col("__into.visit_id").alias("container_id"),
        F.col("__into.visit_type").alias("__type"),
        F.col("__into.has_admission").alias("__adm"),
        (F.col("has_ed") & ~F.col("is_record")).alias("__brings_ed"),
    )
    found = stage(found, "containers")
    any_ed = (
        found.filter("__brings_ed").select("subject_id", "container_id").distinct().withColumn("__ed", F.lit(True))
    )
    both = F.coalesce(F.col("__ed") & F.col("__adm"), F.lit(False))
    return found.join(any_ed, ["subject_id", "container_id"], "left").select(
        *BLOCK_KEY,
        "container_id",
        F.when(both, F.lit(ED_TO_INPATIENT_TYPE)).otherwise(F.col("__type")).alias("merged_type"),
    )


# Blocks of a subject that one task takes at a time.
STRETCH = 200_000
_FOLDED = (
    "subject_id long, stretch long, visit_id long, opened_by long, role int, "
    "ends array<timestamp>, soft array<boolean>, openers array<long>"
)
_ABSORBED, _OPENED, _SWAPPED = 0, 1, 2


def merge_contained_swapping(blocks: DataFrame, stretch: int | None = None) -> DataFrame:
    """As :func:`merge_contained`, but an ED or admission block inside a block that is neither becomes the survivor.

    Blocks are taken in (start, id) order; each goes to the first open place whose holder ends no earlier, or opens one. An urgent
    block (ED or admission) takes over a place whose holder is not urgent, and the place then ends where it ends. So a place is taken over
    once at most, and the ends of places in the order of their opening always increase: the first place that holds a block is a
    binary search, blocks between two take-overs are searched together, and all that one stretch of blocks must know of those before it is
    the ends of the places still open, whether they can be taken over, and who opened them.

    A subject with more than ``stretch`` blocks is cut into stretches that are folded in parallel. Each starts from the open places that the
    stretch before it left in the last round, first from none; a stretch whose start has changed is folded again, until none has. Places
    close as time passes, so what a wrong start leaves behind is soon forgotten and a few rounds suffice; the result is
    that of one pass whatever their number. ``dropped_type`` is the type code to drop from an absorbed block's events.
    """
    stretch = stretch or STRETCH
    levels, order = time_levels(F.col("visit_start")), [F.col("visit_start"), F.col("visit_id")]
    largest = largest_group(blocks, ["subject_id"])
    ranked = ordered_scan(blocks, ["subject_id"], levels, order, count="__n", largest=largest)
    ranked = ranked.withColumn("stretch", F.floor((F.col("__n") - 1) / stretch)).drop("__n")
    ranked = stage(ranked.select(*BLOCK_KEY, "stretch", "visit_type", "visit_start", "visit_end", "has_ed", "has_admission"), "ordered-blocks")
    if largest > stretch:
        long = stage(ranked.filter("stretch = 1").select("subject_id").distinct(), "long-subjects")
        short = ranked.join(long, "subject_id", "left_anti")
        folded = _fold_stretches(short, None, False).unionByName(_settle(ranked.join(long, "subject_id", "left_semi")))
    else:
        folded = _fold_stretches(ranked, None, False)
    members = folded.select(*BLOCK_KEY, "opened_by", "role")
    members = stage(members.join(ranked.drop("visit_start", "visit_end", "stretch"), BLOCK_KEY), "placed-blocks")
    who = F.struct("visit_id", "visit_type", "has_admission")
    places = members.groupBy("subject_id", "opened_by").agg(
        F.max_by(who, F.col("role")).alias("holder"), F.bool_or(F.col("has_ed") & (F.col("role") == _ABSORBED)).alias("__ed")
    )
    both = F.col("holder.has_admission") & F.col("__ed")
    kind = F.when(both, F.lit(ED_TO_INPATIENT_TYPE)).otherwise(F.col("holder.visit_type"))
    places = places.select("subject_id", "opened_by", F.col("holder.visit_id").alias("container_id"), kind.alias("merged_type"))
    out = members.join(places, ["subject_id", "opened_by"])
    lost = F.when(F.col("visit_id") != F.col("container_id"), F.col("visit_type"))
    return out.select(*BLOCK_KEY, "container_id", "merged_type", lost.alias("dropped_type"))


def _settle(ranked: DataFrame) -> DataFrame:
    """The blocks of subjects of several stretches, folded until every stretch started from what the one before it left."""
    unit = ["subject_id", "stretch"]
    left = ["ends", "soft", "openers"]
    mark = F.xxhash64(*left).alias("mark")
    empty = F.xxhash64(*[F.array().cast(t) for t in ("array<timestamp>", "array<boolean>", "array<long>")])
    folded = stage(_fold_stretches(ranked, None, True), "folded-blocks")
    states = stage(folded.filter("visit_id IS NULL").select(*unit, *left).withColumn("turn", F.lit(0)), "open-places")
    started = stage(states.select(*unit, empty.alias("mark")), "starts")
    rounds, turn = [folded.filter("visit_id IS NOT NULL").withColumn("turn", F.lit(0))], 0
    while True:
        # what each stretch ought to start from, where that is not what it did start from
        due = states.select("subject_id", (F.col("stretch") + 1).alias("stretch"), *left, mark)
        due = due.join(started.withColumnRenamed("mark", "__mark"), unit).filter("mark <> __mark").drop("__mark")
        due = stage(due, "starts-due")
        if due.isEmpty():
            break
        turn += 1
        again = stage(_fold_stretches(ranked.join(due.select(*unit), unit, "left_semi"), due, True), "folded-blocks")
        rounds.append(again.filter("visit_id IS NOT NULL").withColumn("turn", F.lit(turn)))
        fresh = again.filter("visit_id IS NULL").select(*unit, *left).withColumn("turn", F.lit(turn))
        states = stage(states.join(due.select(*unit), unit, "left_anti").unionByName(fresh), "open-places")
        started = stage(started.join(due.select(*unit), unit, "left_anti").unionByName(due.select(*unit, "mark")), "starts")
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    return every.join(states.select(*unit, "turn"), [*unit, "turn"], "left_semi").drop("turn")


def _fold_stretches(blocks: DataFrame, starts: DataFrame | None, leave: bool) -> DataFrame:
    """Member rows (``visit_id, opened_by, role``) of all blocks, and with ``leave`` one row per stretch (no ``visit_id``) of its open places."""
    unit = ["subject_id", "stretch"]
    urgent = F.coalesce(F.col("has_ed") | F.col("has_admission"), F.lit(False)).alias("urgent")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ends", "array<timestamp>"), ("soft", "array<boolean>"), ("openers", "array<long>"))]
    rows = blocks.select(*unit, F.lit(1).alias("kind"), "visit_start", "visit_id", "visit_end", urgent, *none)
    if starts is not None:
        no_block = [F.lit(None).cast(t).alias(c) for c, t in (("visit_start", "timestamp"), ("visit_id", "long"), ("visit_end", "timestamp"), ("urgent", "boolean"))]
        rows = rows.unionByName(starts.select(*unit, F.lit(0).alias("kind"), *no_block, "ends", "soft", "openers"))
    rows = rows.repartition(*unit).sortWithinPartitions(*unit, "kind", "visit_start", "visit_id")
    return rows.mapInArrow(lambda batches: _fold_batches(batches, leave), _FOLDED)


def _fold_batches(batches: Iterator[pa.RecordBatch], leave: bool) -> Iterator[pa.RecordBatch]:
    """Folds sorted batches. Only the open places of the stretch in progress are carried from one batch to the next."""
    current, places = None, _NO_PLACES
    for batch in batches:
        number = lambda c, b=batch: b.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False)
        subject, stretch, seeded = number("subject_id"), number("stretch"), number("kind") == 0
        changed = (np.diff(subject) != 0) | (np.diff(stretch) != 0)
        # many subjects are one fold: the ends of each lie above those of all before; a row with a start cuts it
        cuts = np.flatnonzero(seeded)
        cuts = np.unique(np.concatenate(([0], cuts, cuts + 1, [batch.num_rows]))).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            if current is not None and current != (subject[a], stretch[a]):
                if leave:
                    yield _left_open(current, places)
                places = _NO_PLACES
            part = batch.slice(a, b - a)
            if seeded[a]:
                lists = [part.column(c).flatten() for c in ("ends", "soft", "openers")]
                places = (lists[0].cast(pa.int64()).to_numpy(), lists[1].to_numpy(zero_copy_only=False), lists[2].to_numpy())
                current = (subject[a], stretch[a])
                continue
            key = np.concatenate(([0], np.cumsum(changed[a : b - 1])))
            ends, starts, ids = (part.column(c).cast(pa.int64()).to_numpy() for c in ("visit_end", "visit_start", "visit_id"))
            opened, role, after = _fold_blocks(key, ends, part.column("urgent").to_numpy(zero_copy_only=False), ids, places)
            yield _rows(subject[a:b], stretch[a:b], ids, opened, role)
            last = np.append(np.flatnonzero(np.diff(key)), len(key) - 1)
            for end in last.tolist() if leave else last[-1:].tolist():
                low, high = np.searchsorted(after[0], [key[end], key[end] + 1])
                still = low + np.flatnonzero(after[1][low:high] >= starts[end])  # the others close before any later block
                places, current = tuple(c[still] for c in after[1:]), (subject[a + end], stretch[a + end])
                if leave and end < len(key) - 1:
                    yield _left_open(current, places)
    if leave and current is not None:
        yield _left_open(current, places)


_NO_PLACES = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))


def _rows(subject, stretch, ids, opened, role) -> pa.RecordBatch:
    n = len(ids)
    columns = [pa.array(c, pa.int64()) for c in (subject, stretch, ids, opened)] + [pa.array(role, pa.int32())]
    return _batch(columns + [pa.nulls(n, pa.list_(t)) for t in (_TIME, pa.bool_(), pa.int64())])


def _left_open(unit, places) -> pa.RecordBatch:
    ends, soft, openers = places
    lists = [pa.array([c.tolist()], pa.list_(t)) for c, t in ((ends, _TIME), (soft, pa.bool_()), (openers, pa.int64()))]
    key = [pa.array([int(k)], pa.int64()) for k in unit]
    return _batch([*key, pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), *lists])


_TIME = pa.timestamp("us", tz="UTC")


def _batch(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=["subject_id", "stretch", "visit_id", "opened_by", "role", "ends", "soft", "openers"])


def _fold_blocks(key: np.ndarray, ends: np.ndarray, urgent: np.ndarray, ids: np.ndarray, places: tuple):
    """Opener of each block's place, its role, and (key, end, soft, opener) of all places, ``places`` of the first key included.

    ``key`` numbers the stretches in the order of the blocks. There is a turn of the loop for each take-over, not for each block.
    """
    given, n = len(places[0]), len(ends)
    value = np.unique(np.concatenate((places[0], ends)), return_inverse=True)[1]
    x = key * (len(value) + 1) + value[given:]  # later keys lie above all earlier ones
    top = np.concatenate((value[:given], np.zeros(n, np.int64)))
    soft, opener = np.concatenate((places[1], np.zeros(n, bool))), np.concatenate((places[2], np.zeros(n, np.int64)))
    raw, of = np.concatenate((places[0], np.zeros(n, np.int64))), np.concatenate((np.zeros(given, np.int64), np.zeros(n, np.int64)))
    place, role = np.zeros(n, np.int64), np.zeros(n, np.int32)
    open_now, at, width = given, 0, 256
    while at < n:
        stop = min(at + width, n)
        here = x[at:stop]
        highest = np.maximum.accumulate(np.concatenate(([top[open_now - 1] if open_now else -1], here)))[:-1]
        opens = np.flatnonzero(here > highest)
        till = open_now + len(opens)
        top[open_now:till], soft[open_now:till] = here[opens], ~urgent[at + opens]
        raw[open_now:till], opener[open_now:till], of[open_now:till] = ends[at + opens], ids[at + opens], key[at + opens]
        found = np.searchsorted(top[:till], here)
        takes = urgent[at:stop] & soft[found]
        takes[opens] = False
        first = int(takes.argmax()) if takes.any() else len(here)
        place[at : at + first] = found[:first]
        mine = opens[opens < first]
        role[at + mine] = _OPENED
        open_now += len(mine)
        if first == len(here):
            at, width = stop, min(2 * width, 65536)
            continue
        p = found[first]
        top[p], raw[p], soft[p] = here[first], ends[at + first], False
        place[at + first], role[at + first] = p, _SWAPPED
        at, width = at + first + 1, max(64, 2 * first)
    return opener[place], role, tuple(c[:open_now] for c in (of, raw, soft, opener))


# ---- block attributes ------------------------------------------------------------------------------------------


def classify_blocks(events: DataFrame, rules: VisitRules) -> DataFrame:
    """First ED, admission and discharge event of each block, its visit type, start and end.

    Needs ``subject_id, visit_id, event_id, time, code, table, end``; one aggregation, combined on the map side.
    """
    code, table = F.col("code"), F.col("table")
    at = F.struct("time", "code", "event_id")
    visit_event = starts_with_any(code, rules.visit) | F.coalesce(table.isin(*VISIT_TABLES), F.lit(False))
    visit_end = F.coalesce(table.isin(*VISIT_TABLES), F.lit(False)) & F.col("end").isNotNull()

    def first(test: Column) -> Column:
        return F.min(F.when(test, at))

    out = events.groupBy(*BLOCK_KEY).agg(
        first(starts_with_any(code, rules.ed)).alias("ed"),
        first(starts_with_any(code, rules.admission)).alias("adm"),
        first(starts_with_any(code, rules.discharge)).alias("dis"),
        first(visit_event).alias("vis"),
        F.min(F.when(visit_end, F.struct("time", "code", "event_id", "end")))["end"].alias("table_end"),
        F.max(F.when(table.isin(*END_DATING_TABLES), F.col("time"))).alias("dated_end"),
        F.min("time").alias("min_time"),
        F.max("time").alias("max_time"),
    )
    has_adm, has_ed = F.col("adm").isNotNull(), F.col("ed").isNotNull()
    left = F.when((has_adm | has_ed), F.col("dis.time"))
    return out.select(
        *BLOCK_KEY,
        has_ed.alias("has_ed"),
        has_adm.alias("has_admission"),
        F.col("dis.code").alias("discharged_to"),
        F.coalesce("adm.code", "ed.code", "vis.code", F.lit(OUTPATIENT_TYPE)).alias("visit_type"),
        F.coalesce("adm.time", "ed.time", "vis.time", "min_time").alias("visit_start"),
        F.coalesce(left, "table_end", "dated_end", "max_time").alias("visit_end"),
        "min_time",
        "max_time",
    )


def text_to_numeric(events: DataFrame, rules: Sequence[TextRule]) -> DataFrame:
    """Events with text but no number, whose code has a rule that matches, become one event per captured number."""
    text = F.col("text_value")
    keep = F.array(F.struct(F.col("code").alias("code"), F.col("numeric_value").alias("numeric_value")))
    made = None
    for rule in rules:
        parts = F.array(
            *[
                F.struct(
                    F.lit(label).alias("code"),
                    F.regexp_extract(text, rule.pattern, i + 1).try_cast("double").alias("numeric_value"),
                )
                for i, label in enumerate(rule.labels)
            ]
        )
        parts = F.filter(parts, lambda e: e["numeric_value"].isNotNull())
        hit = (F.col("code") == rule.code) & F.col("numeric_value").isNull() & text.rlike(rule.pattern)
        made = F.when(hit, parts) if made is None else made.when(hit, parts)
    out = keep if made is None else made.otherwise(keep)
    rest = [c for c in events.columns if c not in ("code", "numeric_value")]
    return events.select(*rest, F.inline(out))


def strip_structural(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """Drop the events that only state their block's visit type or discharge.

    Every other event stays: those without a code, without a visit, or of a visit that ``blocks`` does not list.
    """
    marks = blocks.select(*BLOCK_KEY, F.col("visit_type").alias("__type"), F.col("discharged_to").alias("__to"))
    out = events.join(marks, BLOCK_KEY, "left")
    same = (F.col("code") == F.col("__type")) | (F.col("code") == F.col("__to"))
    return out.filter(~F.coalesce(same, F.lit(False))).drop("__type", "__to")


def stitch_admissions(
    blocks: DataFrame, ed_hours: float = 24, tail_hours: float = 12, open_end: bool = False
) -> DataFrame:
    """Join day blocks from admission to discharge into one inpatient visit.

    Needs ``subject_id, visit_id, min_time, max_time, has_ed, has_admission, discharged_to, visit_type`` with one block per
    day; rewrites ``visit_id`` and ``visit_type``. A discharge resets everything, so each stretch of blocks up to a
    discharge is decided on its own:

    * an admission takes hold if no ED block came before it in the stretch, or the latest ED block (possibly the
      same block) ended at most ``ed_hours`` before; the stay then starts at that ED block;
    * once one has taken hold, a later admission in the stretch replaces it.

    Windows run over blocks, of which a subject has at most one per day.
    """
    b = blocks.withColumnRenamed("visit_id", "idx").withColumn("dis", F.col("discharged_to").isNotNull())
    by_block = Window.partitionBy("subject_id").orderBy("idx")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("stretch", F.coalesce(F.sum(F.col("dis").cast("int")).over(before), F.lit(0)))
    inside = Window.partitionBy("subject_id", "stretch").orderBy("idx")
    b = b.withColumn("ed", F.last(F.when(F.col("has_ed"), F.struct("idx", "max_time")), True).over(inside))
    gap = F.unix_micros("min_time") - F.unix_micros("ed.max_time")
    near = (F.col("ed.idx") == F.col("idx")) | (gap <= int(ed_hours * 3_600_000_000))
    holds = F.col("has_admission") & (F.col("ed").isNull() | near)
    whole = Window.partitionBy("subject_id", "stretch")
    b = b.withColumns(
        {
            "taken": F.min(F.when(holds, F.struct("idx", F.coalesce("ed.idx", "idx").alias("start")))).over(whole),
            "last_adm": F.max(F.when(F.col("has_admission"), F.col("idx"))).over(whole),
            "dis_idx": F.max(F.when(F.col("dis"), F.col("idx"))).over(whole),
            "last_idx": F.max("idx").over(Window.partitionBy("subject_id")),
        }
    )
    stay_from = F.when(F.col("last_adm") > F.col("taken.idx"), F.col("last_adm")).otherwise(F.col("taken.start"))
    stay_to = F.coalesce("dis_idx", F.col("last_idx")) if open_end else F.col("dis_idx")
    in_stay = F.col("taken").isNotNull() & (F.col("idx") >= stay_from) & (F.col("idx") <= stay_to)
    b = b.withColumn("stay_from", F.when(in_stay, stay_from)).withColumn("stay_to", F.when(in_stay, stay_to))
    # the block after a discharge joins it within tail_hours; if that block opens the next stay, so does that whole stay
    prev_end = F.lag(F.when(F.col("idx") == F.col("stay_to"), F.col("max_time"))).over(by_block)
    tail = (F.unix_micros("min_time") - F.unix_micros(prev_end)) <= int(tail_hours * 3_600_000_000)
    b = b.withColumn("tail", F.coalesce(tail, F.lit(False)))
    opens = (F.col("idx") == F.col("stay_from")) & ~F.col("tail")
    b = b.withColumn("chain", F.last(F.when(opens, F.col("idx")), True).over(by_block))
    joined = F.col("stay_from").isNotNull() | F.col("tail")
    return b.select(
        *[c for c in blocks.columns if c not in ("visit_id", "visit_type")],
        F.col("idx").alias("block_id"),
        F.when(joined, F.col("chain")).otherwise(F.col("idx")).alias("visit_id"),
        F.when(joined, F.lit(INPATIENT_TYPE)).otherwise(F.col("visit_type")).alias("visit_type"),
    )


# ---- visits ----------------------------------------------------------------------------------------------------


def assemble_visits(blocks: DataFrame) -> DataFrame:
    """One row per visit id: type of its first block, extent, first discharge code if it has an ED or admission."""
    at = F.struct("min_time", "block_id")
    admitted = F.bool_or(F.col("has_ed") | F.col("has_admission"))
    out = blocks.groupBy(*BLOCK_KEY).agg(
        F.min_by("visit_type", at).alias("visit_type"),
        F.min("visit_start").alias("visit_start"),
        F.max("visit_end").alias("visit_end"),
        admitted.alias("__in"),
        F.min_by("discharged_to", F.when(F.col("discharged_to").isNotNull(), at)).alias("__to"),
        F.count(F.lit(1)).alias("n_blocks"),
    )
    facility = F.coalesce(F.when(F.col("__in"), F.col("__to")), F.lit(UNKNOWN))
    return out.withColumn("discharge_facility", facility).drop("__in", "__to")


def nest_patients(
    visits: DataFrame, events: DataFrame, event_columns: Sequence[str], part_size: int = 100_000
) -> DataFrame:
    """``visits`` arrays with their ``events`` arrays, one row per subject and about ``part_size`` events.

    A subject beyond ``part_size`` events continues on further rows. A visit goes to one row as a whole, unless it alone
    has more than ``part_size`` events: then it appears on several, each time with its share of the events, so a row
    holds less than twice ``part_size``. Visits without events have an empty array.
    """
    per_visit = stage(events.groupBy(*BLOCK_KEY).agg(F.count(F.lit(1)).alias("n")), "visit-sizes")
    placed = visits.join(per_visit, BLOCK_KEY, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    placed = ordered_scan(
        placed,
        ["subject_id"],
        time_levels(F.col("visit_start")),
        [F.col("visit_start"), F.col("visit_id")],
        sums={"__upto": F.col("n") + 1},
        largest=largest_group(visits, ["subject_id"]),
    )
    placed = placed.withColumn("part", F.floor((F.col("__upto") - F.col("n") - 1) / part_size)).drop("__upto")

    entries = F.array_sort(F.collect_list(F.struct("time", "event_id", *event_columns))).alias("events")
    largest = per_visit.agg(F.max("n")).first()[0] or 0
    if largest <= part_size:
        pieces = events.groupBy(*BLOCK_KEY).agg(entries).withColumn("piece", F.lit(0).cast("long"))
    else:
        by_time = [F.col("time"), F.col("event_id")]
        ranked = ordered_scan(events, BLOCK_KEY, time_levels(F.col("time")), by_time, count="__rank", largest=largest)
        pieces = ranked.groupBy(*BLOCK_KEY, F.floor((F.col("__rank") - 1) / part_size).alias("piece")).agg(entries)
    full = placed.join(pieces, BLOCK_KEY, "left").withColumn("part", F.col("part") + F.coalesce("piece", F.lit(0)))
    heads = [c for c in visits.columns if c not in ("subject_id", "visit_start", "visit_id")]
    of_visit = F.coalesce("events", F.expr("array()")).alias("events")
    rows = F.array_sort(F.collect_list(F.struct("visit_start", "visit_id", *heads, of_visit)))
    return full.groupBy("subject_id", "part").agg(rows.alias("visits"))


def flatten_visits(patients: DataFrame) -> DataFrame:
    """Event rows of nested patients: visit fields beside event fields."""
    rows = patients.select("subject_id", F.explode("visits").alias("v"))
    return rows.select(
        "subject_id",
        F.col("v.visit_id").alias("visit_id"),
        F.col("v.visit_type").alias("visit_type"),
        F.col("v.visit_start").alias("visit_start"),
        F.explode("v.events").alias("e"),
    ).select("subject_id", "visit_id", "visit_type", "visit_start", "e.*")


def _staged_by_block(events: DataFrame, label: str) -> DataFrame:
    """Events dealt out once by their block: they are classified, joined with blocks and told apart where they are."""
    return stage_by(events.repartition(parts(events.sparkSession), *BLOCK_KEY), BLOCK_KEY, label)


def linked_patients(
    events: DataFrame,
    rules: VisitRules,
    event_columns: Sequence[str] = ("code", "numeric_value"),
    part_size: int = 100_000,
) -> DataFrame:
    """The linked profile end to end: flat events to nested patients, as :func:`nest_patients` returns them.

    Events of a visit id form a block; out-of-range ones are detached, loose days go to a covering visit or become visits of
    their own; blocks are classified again with the events they have got; contained blocks are merged, their events
    re-keyed to the survivor; events that only state a block's type or discharge go, those of absorbed blocks too.
    Demographic events and events without a time take no part. Needs the columns of :func:`classify_blocks` and those of
    ``event_columns``.
    """
    events = events.filter(~F.coalesce(_is_demographic(F.col("code")), F.lit(False)) & F.col("time").isNotNull())
    events = text_to_numeric(events, rules.text) if rules.text else events
    fields = list(dict.fromkeys([*BLOCK_KEY, "time", "event_id", "code", *event_columns]))
    events = _staged_by_block(events.select(*dict.fromkeys([*fields, "table", "end"])), "unplaced-events")
    linked = classify_blocks(events.filter(F.col("visit_id").isNotNull()), rules)
    placed = _staged_by_block(assign_events(events, stage_by(linked, BLOCK_KEY, "linked-blocks")).drop("how"), "placed-events")
    blocks = stage_by(classify_blocks(placed, rules), BLOCK_KEY, "placed-blocks")
    merged = stage(merge_contained_swapping(blocks), "merged-blocks")
    kept = strip_structural(placed.select(*fields), blocks).join(merged.select(*BLOCK_KEY, "container_id"), BLOCK_KEY)
    kept = kept.drop("visit_id").withColumnRenamed("container_id", "visit_id")
    kept = kept.select(*dict.fromkeys([*BLOCK_KEY, "time", "event_id", *event_columns]))
    survivors = blocks.drop("visit_type").join(merged.filter("visit_id = container_id"), BLOCK_KEY)
    survivors = survivors.withColumnRenamed("merged_type", "visit_type").withColumn("block_id", F.col("visit_id"))
    visits = stage(assemble_visits(survivors).drop("n_blocks"), "linked-visits")
    return nest_patients(visits, stage(kept, "linked-events"), event_columns, part_size)
