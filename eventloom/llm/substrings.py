"""Removal of long repeated substrings, by run-length suffix indexes over content-partitioned segments.

Every window of ``length`` bytes is assigned to its anchor: the string of 32 bytes inside it with the smallest hash. Equal
windows have equal anchors at equal places, so repeats are found by dealing out anchors. The windows of one anchor are
consecutive and form a segment of the text.

1. Each task walks its texts, cuts them into segments and folds equal segments of one anchor as far as it sees them; what
   is left is dealt by anchor. A segment that occurs whole before repeats in all its windows.
2. The first occurrences of different segments with one anchor share some windows, or none. They are dealt by a
   longer key, and for each share of them a run-length index of the segments is built (``run_index``), lengths are streamed from
   it, and windows that also start earlier are marked. The parts of a key with more bytes than an index should hold are dealt on by
   a longer key, up to whole windows; parts that are one window many times over are dealt by chance, indexed, and the first of
   each share meet again. So every repeat is found by an index, and no index or task holds a large group.
3. The marks of a document meet its text again, and what they cover is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import stage
from .common import map_columns, mix64, pack, powers, read
from .run_index import repeated_windows

LENGTH, ANCHOR = 100, 32
REACH = 34  # bytes that a longer key adds on one side of the anchor
CHUNK = 1 << 20
BIN_BYTES = 1_500_000
FLUSH = 500_000
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

_rng = np.random.default_rng(77)
_letters = _rng.integers(0, 2**64, 256, np.uint64)
_steps = _rng.integers(0, 2**63, 8, np.uint64) * np.uint64(2) + np.uint64(1)

_LONG, _INT, _BOOL = T.LongType(), T.IntegerType(), T.BooleanType()
SEGMENTS = T.StructType(
    [T.StructField("whole", _BOOL), T.StructField("anchor", _LONG), T.StructField("segment", _LONG)]
    + [T.StructField("doc_id", _LONG), T.StructField("version", _LONG)]
    + [T.StructField(n, _INT) for n in ("low", "high", "at")]
)


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Segments of a text of at least ``length`` bytes: anchor, segment hash, first and last window, place of the anchor."""
    window = length - ANCHOR + 1
    hashed = _letters[data]
    width, k = 1, 0
    while width < ANCHOR:
        hashed = hashed[:-width] * _steps[k] + hashed[width:]
        width, k = width * 2, k + 1
    hashed = mix64(hashed)
    # the place breaks ties, so equal anchors in one window are told apart alike everywhere
    least = (hashed & ~np.uint64(CHUNK * 2 - 1)) | np.arange(len(hashed), dtype=np.uint64)
    width = 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = window - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    place = (least & np.uint64(CHUNK * 2 - 1)).astype(np.int64)
    low = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    high = np.concatenate((low[1:], [len(place)])) - 1
    place = place[low]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_letters[data] >> np.uint64(1)) * powers(BASE, len(data)))))
    inside = (sums[high + length] - sums[low]) * powers(INVERSE, len(data))[low]
    shape = ((place - low) << 20 | (high - low)).astype(np.uint64)
    return hashed[place].view(np.int64), mix64(inside + shape * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64), low, high, place


def segments_of(text: str | None, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    for start in range(0, max(1, len(data) - length + 1), CHUNK):
        part = data[start : start + CHUNK + length - 1]
        if len(part) >= length:
            anchor, segment, low, high, place = anchors(part, length)
            yield anchor, segment, low + start, high + start, place + start


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """Segments, each once for a stretch of a task; the rest are reported as whole repeats at once."""
    target = [f.name for f in SEGMENTS]

    def fold(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        anchor, segment, doc, version, low, high, at = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((low, version, doc, segment, anchor))
        twin = np.concatenate(([False], np.all([x[order][1:] == x[order][:-1] for x in (anchor, segment, doc, version, low)], axis=0)))
        order = order[~twin]  # a repeated row is the same document
        a, s = anchor[order], segment[order]
        whole = np.concatenate(([False], (a[1:] == a[:-1]) & (s[1:] == s[:-1])))
        # a repeat needs no partner any more: it is dealt by its place, away from its anchor
        place = doc[order].view(np.uint64) * np.uint64(3) + low[order].astype(np.uint64)
        a = np.where(whole, mix64(place ^ version[order].view(np.uint64)).view(np.int64), a)
        columns = [whole, a, s, doc[order], version[order], low[order].astype(np.int32), high[order].astype(np.int32), at[order].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for doc, version, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "text"))):
                for anchor, segment, low, high, at in segments_of(text, length):
                    held.append((anchor, segment, np.full(len(low), doc, np.int64), np.full(len(low), version, np.int64), low, high, at))
                    n += len(low)
                if n >= FLUSH:
                    yield fold(held)
                    held, n = [], 0
        if held:
            yield fold(held)

    return docs.mapInArrow(run, SEGMENTS)


NEEDS = T.StructType(
    [T.StructField("doc_id", _LONG), T.StructField("version", _LONG), T.StructField("whole", _BOOL), T.StructField("low", _INT), T.StructField("high", _INT)]
    + [T.StructField("anchor", _LONG), T.StructField("at", _INT)]
)


def _meet(segments: DataFrame) -> DataFrame:
    """Whole repeats, and first segments that share their anchor with another one.

    Rows come sorted by anchor and segment and are streamed: all that is kept of an anchor is the first row of the segment at
    hand and whether a second segment has been seen.
    """
    dealt = segments.repartition("anchor").sortWithinPartitions("anchor", "segment", "whole", "doc_id", "version", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shared, pending = None, False, None  # the row before, whether its anchor's rows are out, a row that waits
        names = [f.name for f in NEEDS]
        for batch in batches:
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            whole, rows = c["whole"].astype(bool), {n: c[n] for n in names if n != "whole"}
            mine = np.flatnonzero(~whole)
            out = [(np.flatnonzero(whole), True, None)]
            if len(mine):
                a, s = c["anchor"][mine], c["segment"][mine]
                same_anchor = np.concatenate(([last is not None and a[0] == last[0]], a[1:] == a[:-1]))
                same = same_anchor & np.concatenate(([last is not None and s[0] == last[1]], s[1:] == s[:-1]))
                place = [rows[n][mine] for n in ("doc_id", "version", "low")]
                twin = same & np.all(
                    [np.concatenate(([last is not None and x[0] == y], x[1:] == x[:-1])) for x, y in zip(place, last[2:] if last else (0, 0, 0))], axis=0
                )
                out.append((mine[same & ~twin], True, None))
                first = mine[~same]
                group = np.cumsum(~same_anchor)[~same]  # 0: the anchor carried over
                if len(first):
                    several = np.bincount(group, minlength=group[-1] + 1) > 1
                    several[0] = (group[0] == 0) and (shared or pending is not None)
                    if group[0] == 0 and pending is not None:
                        yield _need_rows([pending], names)
                        pending, shared = None, True
                    out.append((first[several[group]], False, None))
                    if group[-1] > 0:
                        shared = bool(several[group[-1]])
                        pending = None if shared else {n: rows[n][first[-1]] for n in rows} | {"whole": False}
                    # a last anchor that is alone here may meet another in the next batch; others alone are done with
                last = (a[-1], s[-1], *(x[-1] for x in place))
            for at, kind, _ in out:
                if len(at):
                    arrays = [np.full(len(at), kind) if n == "whole" else rows[n][at] for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], schema=_need_schema)

    return dealt.mapInArrow(run, NEEDS)


_need_schema = to_arrow_schema(NEEDS)


def _need_rows(rows, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _need_schema.field(n).type) for n in names], schema=_need_schema)


def parts_of(data: bytes, low: int, high: int, core: int, width: int, reach: int, length: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Windows ``low`` to ``high``, all of which hold the ``width`` bytes at ``core``, by the side on which they reach ``reach`` bytes beyond them.

    Key, first window, place of the longer core, and bytes of each side. A window that reaches far enough on both sides is on the left, so
    equal windows are on the same side and have the same key: a hash of the longer core.
    """
    side = core - reach  # windows up to here have the reach on the left
    for tag, a, b, k in ((b"l", low, min(high, side), side), (b"r", max(low, side + 1), high, core)):
        if a <= b:
            key = hashlib.blake2b(tag + data[k : k + width + reach], digest_size=8).digest()
            yield int.from_bytes(key, "big", signed=True), a, k, data[a : b + length]


def _reaches(length: int) -> list[int]:
    """By how much the core grows at each dealing: by half of what a window has beside it, as one side has at least that, up to the whole."""
    out, room = [REACH], length - ANCHOR - REACH
    while room:
        out.append(-(-room // 2))
        room -= out[-1]
    return out


def remove(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
    """Bytes removed, maximal runs removed, and the SHA-256 of the rest, for half-open byte ranges in any order."""
    kept, at, n, spans = hashlib.sha256(), 0, 0, 0
    order = np.argsort(starts, kind="stable")
    start = end = -1
    for a, b in zip(starts[order].tolist(), ends[order].tolist()):
        if a > end:
            if end >= 0:
                kept.update(data[at:start])
                at, n, spans = end, n + end - start, spans + 1
            start, end = a, b
        else:
            end = max(end, b)
    if end >= 0:
        kept.update(data[at:start])
        at, n, spans = end, n + end - start, spans + 1
    kept.update(data[at:])
    return n, spans, kept.hexdigest()


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeated_substrings(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """A row (doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs`` (doc_id, text).

    A byte is removed when it is inside a string of ``length`` bytes (at least 100) that also starts earlier: in a document with a
    smaller id or earlier in its own. Null ids come last. Null texts are empty; texts shorter than ``length`` lose nothing.
    Rows of equal id (or none) and text are the same document: they get equal results and are no repeats of each other. Different texts
    with one id, or without ids, are documents in the order of their 64-bit hashes (xxhash64).
    """
    if length < LENGTH:
        raise ValueError(f"strings of at least {LENGTH} bytes")
    last = (1 << 63) - 1
    docs = docs.select(F.coalesce("doc_id", F.lit(last)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("version", F.xxhash64("text"))
    needs = stage(_meet(_cut(docs, length)), "substring-needs")
    per_doc = needs.groupBy("doc_id", "version").agg(F.collect_list(F.struct("whole", "low", "high", "at")).alias("needs"))
    met = docs.join(per_doc.hint("shuffle_hash"), ["doc_id", "version"], "left")

    def settle(rows):
        made = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "marks", "parts")}
        for text, needs in zip(rows["text"], rows["needs"]):
            data = text.encode("utf-8", "surrogatepass")
            needs = needs or []
            whole = [(n["low"], n["high"]) for n in needs if n["whole"]]
            open_ = sorted({(n["low"], n["high"], n["at"]) for n in needs if not n["whole"]})
            marks = np.array(whole, np.int64).reshape(-1, 2)
            done = remove(data, marks[:, 0], marks[:, 1] + length) if not open_ else (None, None, None)
            for n, v in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), (len(data), *done)):
                made[n].append(v)
            made["text"].append(text if open_ else None)
            made["marks"].append(pack(marks.astype(np.int32)) if open_ else None)
            made["parts"].append(
                [
                    {"key": k, "low": a, "core": c, "bytes": b}
                    for lo, hi, at in open_
                    for k, a, c, b in parts_of(data, lo, hi, at, ANCHOR, REACH, length)
                ]
                if open_
                else None
            )
        return made

    schema = T.StructType.fromDDL(f"doc_id long, version long, {RESULT}, text string, marks binary, parts array<struct<key:long,low:int,core:int,bytes:binary>>")
    settled = stage(map_columns(met, settle, schema), "substring-settled")
    done = settled.filter("text IS NULL").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

    found = _index_parts(settled.filter("parts IS NOT NULL").select("doc_id", "version", F.explode("parts").alias("p")).select("doc_id", "version", "p.*"), length)
    found = found.groupBy("doc_id", "version").agg(F.collect_list(F.struct("low", "high")).alias("found"))
    rest = settled.filter("text IS NOT NULL").select("doc_id", "version", "n_bytes", "text", "marks")
    rest = rest.join(found.hint("shuffle_hash"), ["doc_id", "version"], "left")

    def finish(rows):
        made = {n: [] for n in ("n_removed", "n_spans", "kept_sha256")}
        for text, marks, found in zip(rows["text"], rows["marks"], rows["found"]):
            old = np.frombuffer(marks, np.int32).reshape(-1, 2).astype(np.int64)
            new = np.array([(f["low"], f["high"]) for f in found or []], np.int64).reshape(-1, 2)
            every = np.concatenate((old, new))
            for n, v in zip(made, remove(text.encode("utf-8", "surrogatepass"), every[:, 0], every[:, 1] + length)):
                made[n].append(v)
        return made

    finished = map_columns(rest, finish, T.StructType.fromDDL(f"doc_id long, {RESULT}"))
    every = done.unionByName(finished)
    return every.withColumn("doc_id", F.when(F.col("doc_id") != last, F.col("doc_id")))


_FOUND = T.StructType([T.StructField(n, _LONG) for n in ("doc_id", "version")] + [T.StructField(n, _INT) for n in ("low", "high")])


def _index_parts(parts: DataFrame, length: int) -> DataFrame:
    """Runs of windows (doc_id, version, low, high) of the parts that also start earlier in another part of their key, or in their own."""
    reaches, found = _reaches(length), None
    for depth, width in enumerate(np.cumsum([ANCHOR, *reaches])[1:].tolist()):
        small, large = _by_size(parts)
        found = _union(found, _indexed(small, length))
        if large is None:
            return found
        if depth + 1 < len(reaches):
            parts = stage(_dealt_on(large, width, reaches[depth + 1], length), "substring-parts")
    while True:  # each key is one window: shares of its parts are indexed, and the first of each share meet
        # never more shares than half of the parts, so that they get fewer
        shares = F.greatest(F.lit(1).cast("long"), F.least(F.ceil(F.col("size") / BIN_BYTES), F.floor(F.col("n") / 2)))
        shares = F.pmod(F.xxhash64("doc_id", "version", "low"), shares)
        dealt = stage(large.select("doc_id", "version", F.xxhash64("key", shares).alias("share"), "key", "low", "core", "bytes"), "substring-shares")
        found = _union(found, _indexed(dealt.drop("key").withColumnRenamed("share", "key"), length))
        first = F.min(F.struct("doc_id", "version", "low", "core", "bytes")).alias("p")
        small, large = _by_size(stage(dealt.groupBy("key", "share").agg(first).select("key", "p.*"), "substring-parts"))
        found = _union(found, _indexed(small, length))
        if large is None:
            return found


def _union(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.union(b)


def _by_size(parts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The parts of keys that fit an index, and those of larger keys, if any; ``n`` and ``size`` are parts and bytes of the key. Lone parts go."""
    keys = parts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("bytes")).alias("size")).filter("n > 1")
    keys = stage(keys, "substring-keys")
    small, large = (parts.join(keys.filter(test), "key") for test in (F.col("size") <= BIN_BYTES, F.col("size") > BIN_BYTES))
    return small, None if keys.filter(F.col("size") > BIN_BYTES).isEmpty() else large


def _dealt_on(parts: DataFrame, width: int, reach: int, length: int) -> DataFrame:
    """The parts under the keys of cores that are ``reach`` bytes longer than their ``width``."""

    def run(rows):
        made = []
        for low, core, data in zip(rows["low"], rows["core"], rows["bytes"]):
            last = len(data) - length
            made.append([{"key": k, "low": low + a, "core": low + c, "bytes": b} for k, a, c, b in parts_of(data, 0, last, core - low, width, reach, length)])
        return {"parts": made}

    schema = T.StructType.fromDDL("doc_id long, version long, parts array<struct<key:long,low:int,core:int,bytes:binary>>")
    longer = map_columns(parts.select("doc_id", "version", "low", "core", "bytes"), run, schema)
    return longer.select("doc_id", "version", F.explode("parts").alias("p")).select("doc_id", "version", "p.*")


def _indexed(parts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of parts whose keys are small; keys are binned into indexes of about ``BIN_BYTES``."""
    size = F.sum(F.octet_length("bytes"))
    bins = 1 + int(parts.agg(size).first()[0] or 0) // BIN_BYTES
    binned = parts.select("doc_id", "version", "low", "bytes", F.pmod(F.xxhash64("key"), F.lit(bins)).alias("bin"))

    def index(table: pa.Table) -> pa.Table:
        place = [table.column(n).to_numpy() for n in ("doc_id", "version", "low")]
        doc, version, low = place
        order = np.lexsort(place[::-1])
        twin = np.concatenate(([False], np.all([x[order][1:] == x[order][:-1] for x in place], axis=0)))
        order = order[~twin]
        texts = table.column("bytes")
        again = repeated_windows([texts[int(i)].as_py() for i in order], length)
        out = []
        for i, marks in zip(order, again):
            edge = np.diff(np.concatenate(([False], marks, [False])).astype(np.int8))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
            out.append((np.full(len(a), doc[i]), np.full(len(a), version[i]), a + low[i], b + low[i]))
        columns = [np.concatenate(c) for c in zip(*out)]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(_FOUND))], schema=to_arrow_schema(_FOUND))

    return binned.groupBy("bin").applyInArrow(index, _FOUND)


def op9_repeated_substrings(spark, sf_dir):
    return repeated_substrings(read(spark, sf_dir, "documents"))


QUERIES = {"op9_repeated_substrings": (op9_repeated_substrings, None)}
