"""Ordered scans (row number, running sum, previous row, fill forward) that split large groups.

A window over ``partitionBy(subject)`` sorts all rows of a subject in one task. When one subject may hold a
large share of a table that task never ends. Here each group is cut into buckets by order-preserving
functions of the sort key (the *levels*, coarse to fine): every bucket is scanned on its own, buckets are summarised
by an ordinary (map-side combined) aggregation, and the summaries of the preceding buckets are added to each row.
The rows are shuffled once, on (group, bucket); the fan-out of each level bounds every window over summaries.

Where the largest group is small, one plain window is the cheaper plan: no summaries and no join. The size of the
largest group is therefore checked first (a map-side combined count of the key columns alone) unless the caller
passes a bound it has already established.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Largest group, in rows, that one task sorts.
SPLIT_ABOVE = 1_000_000
# Rows of keys of their own that one task folds in memory.
FOLD_AT_ONCE = 500_000


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows in the largest group: one counting job that reads the key columns only."""
    if not by:
        return df.count()
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows, dealt out by ``keys`` before they are folded: for keys that hardly repeat.

    Folding such keys on the map side removes few rows, and the table of a task there grows with what the task reads. Dealt out first,
    a task folds about ``FOLD_AT_ONCE`` rows, however large ``df`` is.
    """
    parts = -(-rows // FOLD_AT_ONCE)
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def time_levels(time: Column) -> list[Column]:
    """Buckets of about 49 days, then of about 34 minutes."""
    seconds = F.unix_seconds(time)
    return [F.shiftright(seconds, 22), F.shiftright(seconds, 11)]


def int_levels(value: Column, bits: Sequence[int] = (24, 12)) -> list[Column]:
    """Buckets of 2^b consecutive integers for each b."""
    value = value.cast("long")
    return [F.shiftright(value, b) for b in bits]


def double_levels(value: Column) -> list[Column]:
    """Buckets by signed octave, then by 4096ths of the octave: follows the data over any range of magnitude."""
    size = F.abs(value)
    octave = F.when(size == 0, F.lit(-1100)).otherwise(F.least(F.floor(F.log2(size)), F.lit(1100))).cast("int")  # 1100: infinite
    part = F.when(size == 0, F.lit(0)).otherwise(F.floor(size / F.pow(F.lit(2.0), octave.cast("double")) * 4096))
    side = F.when(value < 0, F.lit(-1)).otherwise(F.lit(1))
    return [side * (octave + 1200), side * part.cast("long")]


def ordered_scan(
    df: DataFrame,
    by: Sequence[str],
    levels: Sequence[Column],
    order: Sequence[Column],
    *,
    count: str | None = None,
    sums: Mapping[str, Column] | None = None,
    before_max: Mapping[str, Column] | None = None,
    before_last: Mapping[str, Column] | None = None,
    fill: Mapping[str, Column] | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Add prefix results over the rows of each group, in ``order``.

    ``by`` must be non-null and ``order`` total. ``levels`` must be non-null, non-decreasing functions of ``order``;
    with no levels this is a plain window, for groups known to be small.

    count        row number from 1
    sums         running sum, the row included
    before_max   maximum over the rows before this one
    before_last  value in the row just before this one
    fill         last non-null value up to and including this row

    ``largest`` is an upper bound on the rows of a group; without it the bound is counted here.
    """
    by = list(by)
    if levels and (largest_group(df, by) if largest is None else largest) <= SPLIT_ABOVE:
        levels = []
    kinds: list[tuple[str, str, Column]] = []
    if count:
        kinds.append(("sum", count, F.lit(1).cast("long")))
    for kind, given in (("sum", sums), ("max", before_max), ("last", before_last), ("fill", fill)):
        kinds += [(kind, name, expr) for name, expr in (given or {}).items()]

    level_names = [f"__level{i}" for i in range(len(levels))]
    df = df.withColumns({**dict(zip(level_names, levels)), **{f"__v_{n}": e for _, n, e in kinds}})
    sort_key = F.struct(*order)

    prefix = _prefixes(df, by, level_names, kinds, sort_key) if levels else None
    w = Window.partitionBy(*by, *level_names).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    local = {}
    for kind, name, _ in kinds:
        v = F.col(f"__v_{name}")
        if kind == "sum":
            local[name] = F.coalesce(F.sum(v).over(upto), F.lit(0))
        elif kind == "max":
            local[name] = F.max(v).over(before)
        elif kind == "last":
            local[name] = F.lag(F.struct(v.alias("v"))).over(w)
        else:
            local[name] = F.last(v, ignorenulls=True).over(upto)
    out = df.withColumns(local)
    if prefix is not None:
        out = out.join(prefix, by + level_names, "left")
    final = {}
    for kind, name, _ in kinds:
        here, earlier = F.col(name), F.col(f"__p_{name}") if prefix is not None else None
        if kind == "sum":
            final[name] = here if earlier is None else here + F.coalesce(earlier, F.lit(0))
        elif kind == "max":
            final[name] = here if earlier is None else F.greatest(here, earlier)
        elif kind == "last":
            final[name] = (here if earlier is None else F.coalesce(here, earlier))["v"]
        else:
            final[name] = here if earlier is None else F.coalesce(here, earlier)
    drop = level_names + [f"__v_{n}" for _, n, _ in kinds] + [f"__p_{n}" for _, n, _ in kinds]
    return out.withColumns(final).drop(*drop)


def _prefixes(df, by, level_names, kinds, sort_key):
    """One row per finest bucket with the combined result of all earlier buckets of its group."""
    summaries = [None] * len(level_names)
    for depth in range(len(level_names) - 1, -1, -1):
        finest = depth == len(level_names) - 1
        source = df if finest else summaries[depth + 1]
        at = sort_key if finest else F.col(level_names[depth + 1])
        aggs = []
        for kind, name, _ in kinds:
            v = F.col(f"__v_{name}")
            if kind == "sum":
                agg = F.sum(v)
            elif kind == "max":
                agg = F.max(v)
            elif kind == "last":
                agg = F.max_by(F.struct(v.alias("v")) if finest else v, at)
            else:
                agg = F.max_by(v, F.when(v.isNotNull(), at))
            aggs.append(agg.alias(f"__v_{name}"))
        summaries[depth] = source.groupBy(*by, *level_names[: depth + 1]).agg(*aggs)

    prefix = None
    for depth, table in enumerate(summaries):
        w = (
            Window.partitionBy(*by, *level_names[:depth])
            .orderBy(level_names[depth])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        cols = {}
        for kind, name, _ in kinds:
            v = F.col(f"__v_{name}")
            cols[f"__p_{name}"] = {
                "sum": lambda v=v: F.sum(v).over(w),
                "max": lambda v=v: F.max(v).over(w),
                "last": lambda v=v: F.last(v).over(w),
                "fill": lambda v=v: F.last(v, ignorenulls=True).over(w),
            }[kind]()
        here = table.withColumns(cols).drop(*[f"__v_{n}" for _, n, _ in kinds])
        if prefix is None:
            prefix = here
            continue
        parent = prefix.withColumnsRenamed({f"__p_{n}": f"__q_{n}" for _, n, _ in kinds})
        keys = by + level_names[:depth]
        here = here.join(parent, keys, "left")
        merged = {}
        for kind, name, _ in kinds:
            p, q = F.col(f"__p_{name}"), F.col(f"__q_{name}")
            if kind == "sum":
                merged[f"__p_{name}"] = F.coalesce(p, F.lit(0)) + F.coalesce(q, F.lit(0))
            elif kind == "max":
                merged[f"__p_{name}"] = F.greatest(p, q)
            else:
                merged[f"__p_{name}"] = F.coalesce(p, q)
        prefix = here.withColumns(merged).drop(*[f"__q_{n}" for _, n, _ in kinds])
    return prefix
