"""Visits on streams: keyed state with event-time timers, append output, late events attached to visits already told.

A visit is a run of a subject's events less than ``gap`` apart. It is told once, when events ``delay`` past its end have been seen,
and is remembered ``grace`` longer: an event that comes in that time and lies in it is told as a further row of the same visit. Timers
tell and forget visits, so the state holds the visits of the last stretch of time only, and none once the log has been closed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import new_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: The time of the row that closes a log: later than any event.
CLOSING = datetime(2262, 1, 1, tzinfo=timezone.utc)
#: Neighbouring subjects that are held as one key, as a power of two: calls for state and timers are made per key.
BLOCK_BITS = 6
_VISITS = "timer long, subject array<long>, start array<long>, last array<long>, n array<long>, told array<boolean>"
_ROWS = "subject_id long, start long, last long, n_events long, late boolean"


def merge_runs(starts: np.ndarray, lasts: np.ndarray, counts: np.ndarray, gap: int):
    """Runs that start less than ``gap`` after the furthest end before them become one."""
    order = np.lexsort((lasts, starts))
    starts, lasts, counts = starts[order], lasts[order], counts[order]
    furthest = np.maximum.accumulate(lasts)
    cuts = np.flatnonzero(np.concatenate(([True], starts[1:] - furthest[:-1] >= gap)))
    return starts[cuts], np.maximum.reduceat(lasts, cuts), np.add.reduceat(counts, cuts)


class VisitState:
    """The remembered visits of one subject. Times are microseconds."""

    def __init__(self, gap: int, grace: int, held: tuple | None = None):
        self.gap, self.grace = gap, grace
        empty = np.zeros(0, np.int64)
        start, last, n, told = held or (empty, empty, empty, empty)
        self.start, self.last, self.n = (np.asarray(c, np.int64) for c in (start, last, n))
        self.told = np.asarray(told, bool)

    def take(self, times: np.ndarray) -> list[tuple[int, int, int]]:
        """Adds events; returns (start, last, events) of those that lie in visits already told."""
        late = []
        for i in np.flatnonzero(self.told).tolist():
            inside = (times >= self.start[i]) & (times < self.last[i] + self.gap)
            if inside.any():
                late.append((int(self.start[i]), int(self.last[i]), int(inside.sum())))
                times = times[~inside]
        if len(times):
            open_now = ~self.told
            runs = (self.start[open_now], self.last[open_now], self.n[open_now])
            runs = [np.concatenate((c, x)) for c, x in zip(runs, (times, times, np.ones(len(times), np.int64)))]
            merged = merge_runs(*runs, self.gap)
            self.start, self.last, self.n = (np.concatenate((c[self.told], m)) for c, m in zip((self.start, self.last, self.n), merged))
            self.told = np.concatenate((np.ones(self.told.sum(), bool), np.zeros(len(merged[0]), bool)))
        return late

    def tell(self, watermark: int) -> list[tuple[int, int, int]]:
        """Visits that end by now, each once; those that no event can reach any more are forgotten."""
        due = ~self.told & (self.last + self.gap - self.grace <= watermark)
        out = [tuple(int(x) for x in r) for r in zip(self.start[due], self.last[due], self.n[due])]
        self.told = self.told | due
        stay = ~(self.told & (self.last + self.gap <= watermark))
        self.start, self.last, self.n, self.told = (c[stay] for c in (self.start, self.last, self.n, self.told))
        return out

    def next_time(self) -> int | None:
        at = self.last + self.gap - np.where(self.told, 0, self.grace)
        return int(at.min()) if len(at) else None

    def held(self) -> tuple:
        return tuple(c.tolist() for c in (self.start, self.last, self.n, self.told))


class BlockState:
    """The remembered visits of the subjects of a block, a :class:`VisitState` each, and the time of the one timer that is set for all."""

    def __init__(self, gap: int, grace: int, held: tuple | None = None):
        self.gap, self.grace, self.timer, self.subjects = gap, grace, None, {}
        if held is not None:
            self.timer, subject, *columns = held
            subject, columns = np.asarray(subject, np.int64), [np.asarray(c) for c in columns]
            cuts = np.flatnonzero(np.diff(subject, prepend=subject[:1] - 1))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(subject)]):
                self.subjects[int(subject[lo])] = VisitState(gap, grace, tuple(c[lo:hi] for c in columns))

    def take(self, subject: np.ndarray, times: np.ndarray) -> list[tuple]:
        order = np.argsort(subject, kind="stable")
        subject, times = subject[order], times[order]
        cuts = np.flatnonzero(np.diff(subject, prepend=subject[:1] - 1))
        late = []
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(subject)]):
            key = int(subject[lo])
            state = self.subjects.setdefault(key, VisitState(self.gap, self.grace))
            late += [(key, *v) for v in state.take(times[lo:hi])]
        return late

    def tell(self, watermark: int) -> list[tuple]:
        out = [(key, *v) for key, state in self.subjects.items() for v in state.tell(watermark)]
        self.subjects = {key: state for key, state in self.subjects.items() if len(state.start)}
        return out

    def next_time(self) -> int | None:
        return min((t for t in (s.next_time() for s in self.subjects.values()) if t is not None), default=None)

    def held(self) -> tuple:
        subject = [key for key, state in self.subjects.items() for _ in range(len(state.start))]
        columns = zip(*(state.held() for state in self.subjects.values()))
        return (self.timer, subject, *([x for c in column for x in c] for column in columns))


class _VisitProcessor(StatefulProcessor):
    """The key is a block of subjects; one timer is set, for the first visit of the block that is due."""

    def __init__(self, gap: int, grace: int):
        self.gap, self.grace = gap, grace

    def init(self, handle) -> None:
        self.handle = handle
        self.visits = handle.getValueState("visits", _VISITS)

    def _load(self) -> BlockState:
        return BlockState(self.gap, self.grace, self.visits.get())

    def _keep(self, state: BlockState) -> None:
        """Writes the state. A timer that has just gone off is deleted by Spark once more, which does no harm."""
        at = state.next_time()
        timer = None if at is None else -(-at // 1000)  # milliseconds, not before the time
        if timer != state.timer:
            if state.timer is not None:
                self.handle.deleteTimer(state.timer)
            if timer is not None:
                self.handle.registerTimer(timer)
            state.timer = timer
        if timer is None:
            self.visits.clear()
        else:
            self.visits.update(state.held())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, late = self._load(), []
        for pdf in rows:
            late += state.take(pdf["subject_id"].to_numpy(np.int64), pdf["t"].to_numpy(np.int64))
        self._keep(state)
        if late:
            yield _frame(late, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._load()
        told = state.tell(timerValues.getCurrentWatermarkInMs() * 1000)
        self._keep(state)
        if told:
            yield _frame(told, False)

    def close(self) -> None:
        pass


def _frame(visits: list[tuple], late: bool) -> pd.DataFrame:
    columns = np.array(visits, np.int64).T
    return pd.DataFrame({**dict(zip(("subject_id", "start", "last", "n_events"), columns)), "late": late})


def open_to_closing(stream: DataFrame, delay: str, keep: Column) -> DataFrame:
    """``stream`` with a watermark on ``time`` and the rows that pass ``keep``; the row that closes a log reaches the watermark and no further.

    One condition that names the time stays above the watermark, where parts of a conjunction might not.
    """
    timed = stream.withWatermark("time", delay)
    return timed.filter(F.when(F.col("time") < F.lit(CLOSING), keep).otherwise(F.lit(False)))


def visits_stream(stream: DataFrame, gap_seconds: int = 43_200, delay_seconds: int = 3_600, grace_seconds: int = 86_400) -> DataFrame:
    """``subject_id, start, end, n_events, late`` in append mode; ``end`` is ``gap`` past the last event, as in session windows.

    ``stream`` has ``subject_id, time``; rows without either are left out. Events that come more than ``delay`` and ``grace`` behind the
    latest one are dropped. A visit is one row that is not late; rows that are ``late`` count further events of the visit with that
    start. Late events outside all visits told are visits of their own.
    """
    timed = open_to_closing(stream, f"{delay_seconds + grace_seconds} seconds", F.col("subject_id").isNotNull())
    subject = F.col("subject_id").cast("long")
    block = F.shiftright(subject, BLOCK_BITS)
    rows = timed.select(block.alias("block"), subject.alias("subject_id"), "time", F.unix_micros("time").alias("t"))
    gap = gap_seconds * 1_000_000
    out = rows.groupBy("block").transformWithStateInPandas(
        _VisitProcessor(gap, grace_seconds * 1_000_000), outputStructType=_ROWS, outputMode="Append", timeMode="EventTime"
    )
    return out.select(
        "subject_id", F.timestamp_micros("start").alias("start"), F.timestamp_micros(F.col("last") + gap).alias("end"), "n_events", "late"
    )


def run_closed(stream: DataFrame, build: Callable[[DataFrame], DataFrame], label: str) -> tuple[DataFrame, int]:
    """Drive ``build(stream)`` in append mode over all available input, close the log, and give the table and the rows left in state.

    The log is closed by a row of its own at a time past all events, which reaches the watermark in a second run of the same
    query; ``stream`` needs a ``time`` column.
    """
    spark = stream.sparkSession
    out, marks, closing = (new_folder(spark, f"{label}{part}") for part in ("", "-marks", "-closing"))
    fields = [F.lit(CLOSING).cast(f.dataType).alias(f.name) if f.name == "time" else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]
    end = spark.range(0, 1, 1, 1).select(*fields)
    end.limit(0).write.parquet(closing)
    both = build(stream.unionByName(spark.readStream.schema(stream.schema).parquet(closing)))
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        for last in (False, True):
            if last:
                end.write.mode("append").parquet(closing)
            writer = both.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks)
            query = writer.outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    state = query.lastProgress["stateOperators"]
    return spark.read.schema(both.schema).parquet(out), sum(s["numRowsTotal"] for s in state)
