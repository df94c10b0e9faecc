"""Visits to ordered token sequences.

The working form is long: one row per token, ``(person_id, pos, token, …)``. Positions are computed by
arithmetic from per-visit token counts and in-visit ranks, so no person's tokens are ever sorted in one place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import SPLIT_ABOVE, dealt, int_levels, largest_group, ordered_scan, time_levels
from ..functions.text import clean_code, fold_answer
from ..functions.timing import (
    DAY_US,
    completed_years,
    floor_days,
    floor_div,
    is_time_token,
    time_token,
    to_epoch,
    token_days,
    week_index,
)
from ..session import parts, stage, stage_by, stage_within

# Visit types whose events carry their own dates (hospital stays and emergency visits).
STAY_VISIT_TYPES = (
    "9201",
    "262",
    "8971",
    "8920",
    "38004311",
    "Visit/IP",
    "Visit/ERIP",
    "Visit/51",
    "Visit/61",
    "NUCC/315D00000X",
    "Visit/ER",
)
COPIES_AT_ONCE = 4096
NO_UNIT = "N/A"
NO_VALUE = -1.0
VISIT_START, VISIT_END = "[VS]", "[VE]"

VISIT_KEY = ["person_id", "visit_id"]

SEQUENCE_COLUMNS = [
    "person_id",
    "pos",
    "kind",
    "token",
    "visit_id",
    "visit_type",
    "visit_order",
    "segment",
    "week",
    "age",
    "value",
    "value_mask",
    "mlm_skip",
    "unit",
    "epoch",
]


@dataclass(frozen=True)
class SequenceOptions:
    """``gap`` and ``stay`` name a time-token kind; ``none`` leaves the tokens out."""

    gap: str = "week_month"
    stay: str = "none"
    auxiliary: bool = False
    prompt: bool = False


def is_stay(visit_type: Column) -> Column:
    return visit_type.isin(*STAY_VISIT_TYPES)


# ---- visit order, segments and cursors -------------------------------------------------------------------------


def order_visits(visits: DataFrame, largest: int | None = None) -> DataFrame:
    """``visit_order`` from 1 by start, visits without events included."""
    return ordered_scan(
        visits,
        ["person_id"],
        time_levels(F.col("visit_start")),
        [F.col("visit_start"), F.col("visit_id")],
        count="visit_order",
        largest=largest,
    )


def segments(visits: DataFrame) -> DataFrame:
    """Alternate 1, 2 over the visits given (those with events), with their rank ``visit_seq``."""
    ranked = ordered_scan(
        visits,
        ["person_id"],
        time_levels(F.col("visit_start")),
        [F.col("visit_start"), F.col("visit_id")],
        count="visit_seq",
    )
    return ranked.withColumn("segment", (1 + (F.col("visit_seq") - 1) % 2).cast("int"))


def gap_days(visits: DataFrame, cursor: Column) -> DataFrame:
    """``gap_days`` since the previous visit's ``cursor`` (its end, or start for outpatient visits); NULL on the first."""
    out = ordered_scan(
        visits,
        ["person_id"],
        time_levels(F.col("visit_start")),
        [F.col("visit_start"), F.col("visit_id")],
        before_last={"__cursor": cursor},
    )
    return out.withColumn("gap_days", floor_days(F.col("visit_start"), F.col("__cursor"))).drop("__cursor")


# ---- movement of the time cursor inside a stay ------------------------------------------------------------------


def stay_moves(times: DataFrame, largest: int | None = None) -> DataFrame:
    """Times at which the cursor of a stay moves: the next event at least one whole day after the last move.

    ``times`` has ``person_id, visit_id, visit_start, time``. The chain is greedy, so it is followed in order, but it
    restarts at any event a day or more after the event before it. Runs of closer events are independent of
    each other and are folded separately, over distinct times only (in a stream where a visit is very large).
    Returns ``person_id, visit_id, time, move_days, move_no``, moves of a visit numbered from 1.
    """
    if largest is None:
        largest = largest_group(times, VISIT_KEY) + 1  # and the start
    if largest <= SPLIT_ABOVE:
        return _moves_in_arrays(times)
    starts = times.select(*VISIT_KEY, F.col("visit_start").alias("time"))
    points = times.filter(F.col("time") > F.col("visit_start")).select(*VISIT_KEY, "time").union(starts).distinct()
    points = points.withColumn("t", F.unix_micros("time"))
    levels, order = time_levels(F.col("time")), [F.col("t")]
    linked = ordered_scan(points, VISIT_KEY, levels, order, before_last={"__prev": F.col("t")}, largest=largest)
    restart = F.col("__prev").isNull() | (F.col("t") - F.col("__prev") >= DAY_US)
    started = F.when(restart, 1).otherwise(0).cast("long")
    runs = ordered_scan(linked, VISIT_KEY, levels, order, sums={"__run": started}, largest=largest)
    ordered = runs.select(*VISIT_KEY, "__run", "t").repartition(*VISIT_KEY, "__run")
    ordered = ordered.sortWithinPartitions(*VISIT_KEY, "__run", "t")
    moves = ordered.mapInPandas(_fold_in_stream, "person_id long, visit_id long, t long")
    # at most one move per day of a stay
    w = Window.partitionBy(*VISIT_KEY).orderBy("t")
    moves = moves.withColumns({"__before": F.lag("t").over(w), "move_no": F.row_number().over(w).cast("long") - 1})
    return _move_columns(moves)


def _move_columns(moves: DataFrame) -> DataFrame:
    moves = moves.filter(F.col("__before").isNotNull())  # the first is the start of the visit
    return moves.select(
        *VISIT_KEY,
        F.timestamp_micros("t").alias("time"),
        floor_div(F.col("t") - F.col("__before"), DAY_US).alias("move_days"),
        "move_no",
    )


def _moves_in_arrays(times: DataFrame) -> DataFrame:
    """Moves of visits known to be small: the distinct times of a visit meet as one array, combined on the map side, and are folded there."""
    later = F.when(F.col("time") > F.col("visit_start"), F.unix_micros("time"))
    visits = times.groupBy(*VISIT_KEY).agg(F.collect_set(later).alias("later"), F.min(F.unix_micros("visit_start")).alias("start"))

    def step(found: Column, t: Column) -> Column:
        return F.when(t - F.element_at(found, -1) >= DAY_US, F.concat(found, F.array(t))).otherwise(found)

    folded = visits.select(*VISIT_KEY, F.aggregate(F.array_sort("later"), F.array("start"), step).alias("ts"))
    move = lambda t, i: F.struct(
        t.alias("t"), F.when(i > 0, F.get("ts", i - 1)).alias("__before"), i.cast("long").alias("move_no")
    )
    return _move_columns(folded.select(*VISIT_KEY, F.inline(F.transform("ts", move))))


def _fold_in_stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Greedy moves over sorted batches; the only state is the run in progress and its cursor.

    Inside a batch the next move is found by binary search, so a long run costs its moves and not its rows.
    """
    current, cursor = None, 0
    for pdf in batches:
        keys = pdf[[*VISIT_KEY, "__run"]].to_numpy()
        ts = pdf["t"].to_numpy()
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(ts)]
        out = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo == hi:
                continue
            at = lo
            if current is not None and current == tuple(keys[lo]):
                at = lo + int(np.searchsorted(ts[lo:hi], cursor + DAY_US))
            current = tuple(keys[lo])
            while at < hi:
                out.append(at)
                cursor = int(ts[at])
                at = lo + int(np.searchsorted(ts[lo:hi], cursor + DAY_US))
        yield pdf.iloc[out][[*VISIT_KEY, "t"]]


def stay_gaps_by_day(times: DataFrame) -> DataFrame:
    """Calendar-day variant: a move at the first event of each later day, measured from the previous event day."""
    days = (
        times.withColumn("day", F.to_date("time"))
        .groupBy(*VISIT_KEY, "day")
        .agg(F.min("time").alias("time"))
    )
    w = Window.partitionBy(*VISIT_KEY).orderBy("day")  # one row per day of a stay
    return (
        days.withColumn("__before", F.lag("day").over(w))
        .filter(F.col("__before").isNotNull())
        .select(*VISIT_KEY, "time", F.datediff("day", "__before").cast("long").alias("move_days"))
    )


# ---- event columns ---------------------------------------------------------------------------------------------


def value_columns(events: DataFrame) -> DataFrame:
    """``value, value_mask, mlm_skip, unit`` with fixed fillers where there is no number or unit."""
    has_value = F.col("numeric_value").isNotNull()
    return events.withColumns(
        {
            "value": F.coalesce(F.col("numeric_value"), F.lit(NO_VALUE)),
            "value_mask": has_value.cast("int"),
            "mlm_skip": has_value.cast("int"),
            "unit": F.when(F.col("unit") != "", F.col("unit")).otherwise(F.lit(NO_UNIT)),
        }
    )


def fold_text(events: DataFrame) -> DataFrame:
    """``token``: the cleaned code, with the categorical answer appended where there is no number."""
    token = fold_answer(clean_code(F.col("code")), F.col("numeric_value"), F.col("text_value"))
    return events.withColumn("token", clean_code(token))


def dedup_outpatient(events: DataFrame) -> DataFrame:
    """Keep the first of equal (token, value) in each outpatient visit; stays and untimed events keep everything.

    Copies are folded by one aggregation: events that are all kept have themselves as part of the key, and a count, by which equal ones come
    back. Events that are already together by visit are not moved again.
    """
    keys = [*VISIT_KEY, "token", "value"]
    rest = [c for c in events.columns if c not in keys]
    whole = F.struct("time", "code", "event_id", *[c for c in rest if c not in ("time", "code", "event_id")])
    kept = F.coalesce(F.col("is_stay") | F.col("time").isNull(), F.lit(False))
    # a row carries its columns once, as part of the key or as a candidate for the first: the rows are sorted
    events = events.select(*keys, F.when(kept, whole).alias("__own"), F.when(~kept, whole).alias("__copy"))
    folded = events.groupBy(*keys, "__own").agg(F.min("__copy").alias("__first"), F.count("__own").alias("__n"))
    folded = folded.withColumn("first", F.coalesce("__own", "__first"))
    n = F.greatest("__n", F.lit(1).cast("long"))
    for size in (COPIES_AT_ONCE, 1):  # in two steps, so that no array grows with the number of equal events
        part = F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / size))
        folded = folded.select(*keys, "first", n.alias("__n"), F.explode(part).alias("__i"))
        n = F.least(F.lit(size).cast("long"), F.col("__n") - F.col("__i") * size)
    return folded.select(*keys, *[F.col(f"first.{c}").alias(c) for c in rest])


# ---- the whole sequence ----------------------------------------------------------------------------------------


def build_sequence(
    visits: DataFrame, events: DataFrame, people: DataFrame, options: SequenceOptions = SequenceOptions(), by_person: bool = False
) -> DataFrame:
    """Long token sequence of every person, in the columns ``SEQUENCE_COLUMNS``.

    ``by_person``: visits and events are dealt out by person and stay so, and all rows of a person fit a task
    (:func:`domains.domain_sequences`). Events are then read several times and not staged.
    """
    per_person = largest_group(visits, ["person_id"])
    visits = visits.join(people, "person_id").withColumn("is_stay", is_stay(F.col("visit_type")))
    visits = order_visits(visits, per_person)
    if by_person:
        visits = stage_within(visits, "person_id", "ordered-visits")
        per_visit = largest_group(events, VISIT_KEY) + 1  # and the start of the visit
        tokens = _visit_events(visits, events, by_person)
        stays = visits.filter("is_stay").select(*VISIT_KEY, "visit_start")
        times = events.filter(F.col("time").isNotNull()).select(*VISIT_KEY, "time").join(stays, VISIT_KEY)
        ranked = _rank_events(tokens.filter(F.col("time").isNotNull()), per_visit, times)
        kept = stage_within(ranked, "person_id", "event-tokens")
        untimed = events.filter(F.col("time").isNull()).select(*VISIT_KEY)
        headed = stage_within(_visit_layout(visits, kept, untimed, options, per_person), "person_id", "visit-layout")
    else:
        visits = stage(visits, "ordered-visits")
        tokens = stage_by(_visit_events(visits, events), VISIT_KEY, "visit-events")
        per_visit = largest_group(tokens, VISIT_KEY) + 1  # and the start of the visit
        times = tokens.filter(F.col("time").isNotNull() & F.col("is_stay")).select(*VISIT_KEY, "visit_start", "time")
        ranked = _rank_events(tokens.filter(F.col("time").isNotNull()), per_visit, times)
        whole = 2 * per_visit <= SPLIT_ABOVE  # else visits are split, and no longer dealt out by their key
        kept = stage_by(ranked, VISIT_KEY, "event-tokens") if whole else stage(ranked, "event-tokens")
        untimed = tokens.filter(F.col("time").isNull()).select(*VISIT_KEY)
        headed = stage(_visit_layout(visits, kept, untimed, options, per_person), "visit-layout")

    parts = [_event_rows(headed, kept, options), _visit_rows(headed, options)]
    if options.prompt:
        parts.append(prompt_tokens(visits))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*SEQUENCE_COLUMNS)


def _visit_events(visits: DataFrame, events: DataFrame, by_person: bool = False) -> DataFrame:
    """Cleaned and de-duplicated events of known visits, dealt out by visit (``by_person``: as they are); untimed ones only show that a visit has events."""
    attrs = visits.select(*VISIT_KEY, "is_stay", "visit_start")
    ev = value_columns(fold_text(events)).drop("numeric_value", "text_value")
    if not by_person:
        ev = ev.repartition(parts(ev.sparkSession), *VISIT_KEY)
    return dedup_outpatient(ev.join(attrs, VISIT_KEY))


def _rank_events(ev: DataFrame, per_visit: int, times: DataFrame) -> DataFrame:
    """Events with their rank in the visit, the cursor at that event, and the moves up to it; ``times`` are those of the events of stays.

    Event ids may repeat: the order ends with everything else that tells two events apart, so only equal rows are interchangeable.
    """
    moves = stay_moves(times, per_visit)
    # a move is a row of its own in front of the events at its time: one scan places it, and the events are shuffled once
    is_move = F.col("move_no").isNotNull()
    order = [F.col("time"), (~is_move).alias("__event"), *[F.col(c) for c in ("code", "event_id", "token", "value", "unit")]]
    ev = ordered_scan(
        ev.drop("is_stay", "visit_start", "mlm_skip").unionByName(moves, allowMissingColumns=True),
        VISIT_KEY,
        time_levels(F.col("time")),
        order,
        sums={"rank": F.when(is_move, 0).otherwise(1).cast("long")},
        fill={"__move": F.when(is_move, F.struct(F.col("time").alias("__at"), "move_no"))},
        before_last={"__days_before": F.col("move_days")},
        largest=2 * per_visit,
    ).filter(~is_move)
    shift = F.coalesce("__move.move_no", F.lit(0).cast("long"))
    ev = ev.withColumns(
        {"moved": F.col("__days_before").isNotNull(), "move_days": F.col("__days_before"), "cursor": F.col("__move.__at"), "shift": shift}
    )
    return ev.select(
        *VISIT_KEY, "time", "token", "value", "value_mask", F.col("value_mask").alias("mlm_skip"), "unit",
        "rank", "cursor", "moved", "move_days", "shift",
    )


def _visit_layout(
    visits: DataFrame, kept: DataFrame, untimed: DataFrame, options: SequenceOptions, per_person: int
) -> DataFrame:
    """Visits that have events, with token counts, the offset of their first token, segment and time gap."""
    rows = kept.select(*VISIT_KEY, "time", "cursor", "moved").unionByName(untimed, allowMissingColumns=True)
    summary = rows.groupBy(*VISIT_KEY).agg(
        F.count("time").alias("n_events"),
        F.sum(F.col("moved").cast("long")).alias("n_moves"),
        F.max("time").alias("last_time"),
        F.max("cursor").alias("last_cursor"),
    )
    v = visits.join(summary, VISIT_KEY).withColumn("n_moves", F.coalesce("n_moves", F.lit(0)))
    stay_cursor = F.coalesce("visit_end", "last_cursor", "visit_start")
    v = v.withColumn("end_cursor", F.when(F.col("is_stay"), stay_cursor).otherwise(F.col("visit_start")))

    has_gap, aux, stay = options.gap != "none", int(options.auxiliary), int(options.stay != "none")
    discharge = F.when(F.col("is_stay"), F.lit(aux)).otherwise(F.lit(0))
    v = v.withColumn("n_base", F.col("n_events") + stay * F.col("n_moves") + 2 + aux + discharge)
    v = ordered_scan(
        v,
        ["person_id"],
        time_levels(F.col("visit_start")),
        [F.col("visit_start"), F.col("visit_id")],
        count="visit_seq",
        sums={"n_upto": F.col("n_base")},
        before_last={"prev_cursor": F.col("end_cursor")},
        largest=per_person,
    )
    gaps_before = F.greatest(F.col("visit_seq") - 2, F.lit(0)) if has_gap else F.lit(0)
    here = (F.col("visit_seq") > 1).cast("long") if has_gap else F.lit(0)
    offset = F.lit(4 if options.prompt else 0) + F.col("n_upto") - F.col("n_base") + gaps_before
    return v.withColumns(
        {
            "gap_days": floor_days(F.col("visit_start"), F.col("prev_cursor")),
            "segment": (1 + (F.col("visit_seq") - 1) % 2).cast("int"),
            "offset": offset.cast("long"),
            "has_gap": here.cast("int"),
        }
    )


def _event_rows(headed: DataFrame, kept: DataFrame, options: SequenceOptions) -> DataFrame:
    with_stay = options.stay != "none"
    attrs = headed.select(
        *VISIT_KEY, "visit_type", "visit_order", "visit_start", "segment", "offset", "has_gap", "is_stay", "birth"
    )
    ev = kept.join(attrs, VISIT_KEY)
    first = F.col("offset") + F.col("has_gap") + 1 + int(options.auxiliary)
    at = F.when(F.col("is_stay"), F.col("time")).otherwise(F.col("visit_start"))
    cursor = F.when(F.col("is_stay"), F.coalesce("cursor", "visit_start")).otherwise(F.col("visit_start"))
    ev = ev.withColumns(
        {
            "pos": first + F.col("rank") + (F.col("shift") if with_stay else 0),
            "kind": F.lit("event"),
            "week": week_index(at),
            "age": completed_years(F.col("birth"), at),
            "epoch": to_epoch(cursor),
        }
    )
    rows = ev.select(*SEQUENCE_COLUMNS)
    if not with_stay:
        return rows
    extra = ev.filter("moved").withColumns(
        {
            "pos": F.col("pos") - 1,
            "kind": F.lit("stay_gap"),
            "token": F.concat(F.lit("i-"), time_token(F.col("move_days"), options.stay)),
            **_blank(),
        }
    )
    return rows.unionByName(extra.select(*SEQUENCE_COLUMNS))


def _blank() -> dict[str, Column]:
    return {
        "week": F.lit(0),
        "age": F.lit(-1),
        "value": F.lit(NO_VALUE),
        "value_mask": F.lit(0),
        "mlm_skip": F.lit(0),
        "unit": F.lit(NO_UNIT),
    }


def _visit_rows(headed: DataFrame, options: SequenceOptions) -> DataFrame:
    """Gap, boundary, type and discharge tokens, exploded from one row per visit."""
    start, is_stay_col = F.col("visit_start"), F.col("is_stay")
    last_at = F.when(is_stay_col, F.coalesce("last_time", "visit_start")).otherwise(start)
    total = F.col("has_gap") + F.col("n_base")
    type_out = F.col("visit_type")

    def row(kind, pos, token, when, at, week, age, segment, visit_type):
        return F.when(
            when,
            F.struct(
                F.lit(kind).alias("kind"),
                (F.col("offset") + pos).cast("long").alias("pos"),
                clean_code(token).alias("token"),
                to_epoch(at).alias("epoch"),
                week.alias("week"),
                age.alias("age"),
                segment.cast("int").alias("segment"),
                visit_type.alias("visit_type"),
            ),
        )

    def dated(kind, pos, token, when, at, dated_by):
        return row(
            kind, pos, token, when, at, week_index(dated_by), completed_years(F.col("birth"), dated_by),
            F.col("segment"), type_out,
        )

    rows = [
        row(
            "gap", F.lit(1), time_token(F.col("gap_days"), options.gap), F.col("has_gap") == 1, start,
            F.lit(0), F.lit(-1), F.lit(0), F.lit("0"),
        ),
        dated("start", F.col("has_gap") + 1, F.lit(VISIT_START), F.lit(True), start, start),
        dated("end", total, F.lit(VISIT_END), F.lit(True), F.col("end_cursor"), last_at),
    ]
    if options.auxiliary:
        facility = F.when(F.col("discharge_facility") != "", F.col("discharge_facility")).otherwise(F.lit("0"))
        rows.append(dated("type", F.col("has_gap") + 2, type_out, F.lit(True), start, start))
        rows.append(dated("discharge", total - 1, facility, is_stay_col, F.col("end_cursor"), last_at))
    exploded = headed.select(
        *VISIT_KEY, "visit_order", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")
    ).select(*VISIT_KEY, "visit_order", "r.*")
    fillers = {k: v for k, v in _blank().items() if k not in ("week", "age")}
    return exploded.withColumns(fillers).select(*SEQUENCE_COLUMNS)


def prompt_tokens(visits: DataFrame) -> DataFrame:
    """Year, age, gender and race tokens at positions 1 to 4, dated by the first visit."""
    start = F.col("visit_start")
    tokens = F.array(
        F.concat(F.lit("year:"), F.year(start).cast("string")),
        F.concat(F.lit("age:"), completed_years(F.col("birth"), start).cast("string")),
        F.col("gender"),
        F.col("race"),
    )
    rows = visits.filter("visit_order = 1").select(
        "person_id", start, F.posexplode(tokens).alias("__i", "__token")
    )
    return rows.select(
        "person_id",
        (F.col("__i") + 1).cast("long").alias("pos"),
        F.lit("prompt").alias("kind"),
        clean_code(F.col("__token")).alias("token"),
        F.lit(0).cast("long").alias("visit_id"),
        F.lit("0").alias("visit_type"),
        F.lit(0).cast("long").alias("visit_order"),
        F.lit(0).alias("segment"),
        *[v.alias(k) for k, v in _blank().items()],
        to_epoch(start).alias("epoch"),
    ).select(*SEQUENCE_COLUMNS)


def field_of(name: str):
    """The function that takes one field out of a struct, for use with ``transform``."""
    return lambda r: r[name]


# ---- sequences at rest -----------------------------------------------------------------------------------------


def counters(seq: DataFrame, visits: DataFrame) -> DataFrame:
    """``num_of_concepts`` and ``num_of_visits`` (all visits, with events or without) per person."""
    n_tokens = seq.groupBy("person_id").agg(F.count(F.lit(1)).alias("num_of_concepts"))
    n_visits = visits.groupBy("person_id").agg(F.count(F.lit(1)).alias("num_of_visits"))
    return n_tokens.join(n_visits, "person_id")


def to_arrays(seq: DataFrame, columns: Sequence[str], part_size: int = 8192, by: Sequence[str] = ("person_id",)):
    """Parallel arrays in position order, one row per ``part_size`` positions.

    A person within ``part_size`` tokens is one row (part 0); a longer one continues on further rows, so nothing
    is cut off and no row or task grows with a person's history. ``num_of_concepts`` and ``n_parts`` are the person's on every row.
    """
    part = F.floor((F.col("pos") - 1) / part_size).cast("int")
    packed = (
        seq.groupBy(*by, part.alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("rows"))
    )
    totals = seq.groupBy(*by).agg(
        F.count(F.lit(1)).cast("int").alias("num_of_concepts"), (F.max(part) + 1).alias("n_parts")
    )
    return packed.join(totals, list(by)).select(
        *by, "part", *[F.transform("rows", field_of(c)).alias(c) for c in columns], "num_of_concepts", "n_parts"
    )


def from_arrays(arrays: DataFrame, columns: Sequence[str], part_size: int = 8192, by: Sequence[str] = ("person_id",)):
    """Inverse of :func:`to_arrays`."""
    return arrays.select(*by, "part", F.posexplode(F.arrays_zip(*columns)).alias("__i", "__r")).select(
        *by, (F.col("part") * part_size + F.col("__i") + 1).cast("long").alias("pos"), "__r.*"
    )


def equal_lengths(arrays: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that break the equal-length rule; empty when the table is sound."""
    n = F.size(columns[0])
    bad = F.lit(False)
    for c in columns[1:]:
        bad = bad | (F.size(c) != n)
    return arrays.filter(bad)


def sort_sequence(arrays: DataFrame, columns: Sequence[str], sort_by: str, token: str = "concept_ids") -> DataFrame:
    """Reorder the listed array columns of each row by (``sort_by``, token); other columns stay."""
    zipped = F.array_sort(
        F.transform(
            F.arrays_zip(*dict.fromkeys([sort_by, token, *columns])),
            lambda r: F.struct(
                r[sort_by].alias("__k"), r[token].alias("__t"), *[r[c].alias(c) for c in columns]
            ),
        )
    )
    return arrays.withColumn("__z", zipped).withColumns(
        {c: F.transform("__z", field_of(c)) for c in columns}
    ).drop("__z")


def sort_sequences(
    arrays: DataFrame,
    columns: Sequence[str],
    sort_by: str,
    token: str = "concept_ids",
    part_size: int = 8192,
    by: Sequence[str] = ("person_id",),
) -> DataFrame:
    """As :func:`sort_sequence`, but a person who takes several rows (``by``, part) is sorted as one.

    Positions are global ranks by (``sort_by``, token, the other columns in turn): each person's entries are ranked in ranges of
    ``sort_by``, so no row or task holds a person, and rows of ``part_size`` are made again from the ranks. Nulls come first.
    Returns the columns of :func:`to_arrays`.
    """
    named = list(dict.fromkeys([sort_by, token, *columns]))
    long = arrays.select(*by, F.inline(F.arrays_zip(*named)))
    number = F.floor(F.col(sort_by)).cast("long")  # the same order, for keys that are numbers
    levels = [F.coalesce(level, F.lit(-(1 << 62))) for level in int_levels(number, (45, 28, 12))]
    order = [F.col(c).asc_nulls_first() for c in named]
    ranked = ordered_scan(long, list(by), levels, order, count="pos")
    return to_arrays(ranked, list(columns), part_size, by)


def longest(seq: DataFrame) -> int:
    """Tokens of the longest sequence that :func:`build_sequence` made, from the ends of visits: no event is read."""
    return seq.filter("kind = 'end'").agg(F.max("pos")).first()[0] or 0


def rebuild_times(seq: DataFrame, largest: int | None = None) -> DataFrame:
    """``rebuilt_epoch``: 1 January of the ``year:`` token (1985 without one) plus the running days of time tokens.

    ``largest`` is an upper bound on the tokens of a person; without it they are counted.
    """
    year = F.regexp_extract("token", r"^year:(\d+)$", 1)
    bases = (
        seq.filter("pos = 1")
        .select("person_id", F.when(year != "", year.cast("int")).otherwise(F.lit(1985)).alias("__year"))
    )
    days = F.when(is_time_token(F.col("token")), token_days(F.col("token"))).otherwise(F.lit(0)).cast("long")
    run = ordered_scan(seq, ["person_id"], int_levels(F.col("pos")), [F.col("pos")], sums={"__days": days}, largest=largest)
    base = F.unix_date(F.make_date("__year", F.lit(1), F.lit(1)))
    return (
        run.join(bases, "person_id")
        .withColumn("rebuilt_epoch", ((base + F.col("__days")) * 86400).cast("double"))
        .drop("__year", "__days")
    )


# ---- relational records as events ------------------------------------------------------------------------------


def qualified_concepts(events: DataFrame, min_patients: int = 100, rows: int | None = None, dealt_out: bool = False) -> DataFrame:
    """Concepts seen in at least ``min_patients`` people.

    ``rows`` is an upper bound on the events; without it they are counted here, unless they come ``dealt_out`` by person.
    """
    pairs = events.select("code", "person_id")
    if not dealt_out:
        pairs = dealt(pairs, ["code", "person_id"], events.count() if rows is None else rows)
    return (
        pairs.distinct()
        .groupBy("code")
        .agg(F.count("person_id").alias("n_people"))
        .filter(F.col("n_people") >= min_patients)
    )
