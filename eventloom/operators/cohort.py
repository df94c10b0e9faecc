"""Cohorts, index-dated extraction and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bucket, hash32
from ..functions.scan import int_levels, ordered_scan
from ..functions.timing import completed_years, to_epoch
from .clean import match_concepts


def case_control(
    people: DataFrame,
    visits: DataFrame,
    conditions: DataFrame,
    concepts: DataFrame,
    patterns: Sequence[str],
    gap_days: int,
    min_history_days: int,
) -> DataFrame:
    """``person_id, index_date, label``.

    A case has a matching condition; its index date is the first one less the gap. A control's is its last visit less
    the gap. Both need a first visit before the index date and enough days of history.
    """
    matched = match_concepts(concepts, patterns).select(F.col("concept_id").alias("condition_concept_id"))
    first = (
        conditions.join(matched, "condition_concept_id", "left_semi")
        .groupBy("person_id")
        .agg(F.min("condition_start_date").alias("first_condition"))
    )
    seen = visits.groupBy("person_id").agg(
        F.min("visit_start_date").alias("first_visit"), F.max("visit_start_date").alias("last_visit")
    )
    is_case = F.col("first_condition").isNotNull()
    out = (
        people.select("person_id")
        .join(seen, "person_id", "left")
        .join(first, "person_id", "left")
        .withColumn("index_date", F.date_sub(F.when(is_case, F.col("first_condition")).otherwise(F.col("last_visit")), gap_days))
        .withColumn("label", is_case.cast("int"))
    )
    history = F.datediff("index_date", "first_visit")
    return out.filter((history > 0) & (history >= min_history_days)).select("person_id", "index_date", "label")


def restrict(df: DataFrame, ids: DataFrame, key: str = "person_id") -> DataFrame:
    """Rows whose key occurs in ``ids``."""
    return df.join(ids.select(key), key, "left_semi")


def hash_split(df: DataFrame, key: str, fractions: dict[str, float], seed: int = 42) -> DataFrame:
    """``split`` by a stable hash of the key: the first fractions in order, the last name takes the rest."""
    names = list(fractions)
    b = bucket(seed, F.col(key))
    out, edge = None, 0.0
    for name in names[:-1]:
        edge += fractions[name]
        test = b < int(edge * 1_000_000)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    last = F.lit(names[-1])
    return df.withColumn("split", last if out is None else out.otherwise(last))


def split_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum("label").cast("long").alias("cases"),
        F.sum(1 - F.col("label")).cast("long").alias("controls"),
        F.round(F.avg("label"), 4).alias("prevalence"),
        F.min("index_date").alias("first_date"),
        F.max("index_date").alias("last_date"),
    )


def leaked(df: DataFrame, key: str = "person_id") -> DataFrame:
    """Keys found in more than one split."""
    n = F.min("split") != F.max("split")
    return df.groupBy(key).agg(n.alias("leaks")).filter("leaks").select(key)


def cut_at_index(seq: DataFrame, cohort: DataFrame, window_days: int | None = None) -> DataFrame:
    """Tokens of each (person, index date) up to the index date, within ``window_days`` before it if given.

    Without a window the history is unbounded. ``age_at_index`` is read from an ``age:`` token at position 2, else -1.
    """
    cohort = cohort.select("person_id", "index_date", "label", to_epoch(F.col("index_date")).alias("__until"))
    ages = seq.filter("pos = 2").select(
        "person_id",
        F.regexp_extract("token", r"^[^:]*:(\d+)$", 1).try_cast("int").alias("age_at_index"),
    )
    cohort = cohort.join(ages, "person_id", "left").withColumn("age_at_index", F.coalesce("age_at_index", F.lit(-1)))
    inside = F.col("epoch") <= F.col("__until")
    if window_days is not None:
        inside &= F.col("epoch") >= F.col("__until") - F.lit(window_days * 86400.0)
    return seq.join(cohort, "person_id").filter(inside).drop("__until")


def time_ranks(seq: DataFrame) -> DataFrame:
    """``seq`` with ``at``, each token's place in its person's tokens by (epoch, pos); the tokens of any stretch of time are a range of places."""
    return ordered_scan(seq, ["person_id"], _epoch_levels(F.col("epoch")), [F.col("epoch"), F.col("pos")], count="at")


def _epoch_levels(epoch: Column) -> list[Column]:
    return int_levels(F.floor(epoch).cast("long"), (22, 11))


def index_ranges(seq: DataFrame, cohort: DataFrame, window_days: int | None = None) -> DataFrame:
    """``person_id, index_date, label, from_at, to_at`` for each row of ``cohort``: the places of :func:`time_ranks` it cuts out.

    Dates are laid among the token times of their person and one scan counts the tokens before each; only the two keys of a token
    move, once, whatever the number of index dates. A range is empty (``to_at`` below ``from_at``) where there are no tokens in it.
    """
    asked = cohort.select("person_id", "index_date", "label", to_epoch(F.col("index_date")).alias("epoch"))
    upper = asked.withColumn("side", F.lit(1))  # after the tokens of its second
    points = seq.select("person_id", "epoch", F.lit(0).alias("side")).unionByName(upper, allowMissingColumns=True)
    if window_days is not None:
        lower = asked.withColumns({"epoch": F.col("epoch") - F.lit(window_days * 86400.0), "side": F.lit(-1)})
        points = points.unionByName(lower, allowMissingColumns=True)
    order = [F.col("epoch"), F.col("side"), F.col("index_date"), F.col("label")]
    counted = ordered_scan(points, ["person_id"], _epoch_levels(F.col("epoch")), order, sums={"n": (F.col("side") == 0).cast("long")})
    ends = counted.filter("side <> 0").groupBy("person_id", "index_date", "label")
    before = F.max(F.when(F.col("side") == -1, F.col("n")))
    return ends.agg(
        (F.coalesce(before, F.lit(0)) + 1).alias("from_at"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("to_at")
    )


def copy_ranges(ranked: DataFrame, ranges: DataFrame) -> DataFrame:
    """The tokens of each range, with its index date and label: one lookup by (person, place) for each token written."""
    wanted = ranges.filter("from_at <= to_at").withColumn("at", F.explode(F.sequence("from_at", "to_at")))
    return wanted.drop("from_at", "to_at").join(ranked, ["person_id", "at"])


def missing_subjects(cohort: DataFrame, seq: DataFrame) -> DataFrame:
    """Cohort members without a sequence."""
    return cohort.join(seq.select("person_id"), "person_id", "left_anti")


def finetune_columns(df: DataFrame) -> DataFrame:
    """``age_at_index, classifier_label, index_date`` (seconds) from a cohort's own names."""
    age = F.col("age") if "age" in df.columns else F.col("age_at_index")
    return df.select(
        "person_id",
        age.alias("age_at_index"),
        F.col("label").alias("classifier_label"),
        to_epoch(F.col("index_date")).alias("index_date"),
    )


def random_split(df: DataFrame, fractions: Sequence[float], seed: int = 42) -> list[DataFrame]:
    """Spark's own seeded random split; :func:`hash_split` gives the same split on any partitioning."""
    return df.randomSplit(list(fractions), seed=seed)


def count_split(df: DataFrame, key: str, n: int, seed: int = 42, names=("validation", "train")) -> DataFrame:
    """The first ``n`` rows in hash order go to the first split, the rest to the second."""
    order = [hash32(seed, F.col(key)), F.col(key)]
    ranked = ordered_scan(df, [], int_levels(order[0], (22, 12)), order, count="__rank")
    return ranked.withColumn("split", F.when(F.col("__rank") <= n, names[0]).otherwise(names[1])).drop("__rank")


def pool_splits(df: DataFrame, name: str = "test") -> DataFrame:
    """All splits as one."""
    return df.withColumn("split", F.lit(name))


def skip_done(df: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose (person, index date in whole seconds) is not in ``done`` yet."""
    at = F.unix_seconds(F.col("index_date").cast("timestamp"))
    finished = done.select(F.col("person_id").alias("__p"), at.alias("__t"))
    return df.join(finished, (F.col("person_id") == F.col("__p")) & (at == F.col("__t")), "left_anti")


def outcome_cohort(
    index_events: DataFrame,
    outcomes: DataFrame,
    people: DataFrame,
    observed: DataFrame,
    obs_days: int,
    pred_start: int,
    pred_end: int,
    ages: tuple[int, int],
    dates: tuple[str, str],
) -> DataFrame:
    """``person_id, index_date, age, label`` for every index event with ``obs_days`` of observation before it.

    ``observed`` has ``person_id, observed_from``: the first visit, or the start of an observation period; the earliest counts.

    The label says whether an outcome falls ``pred_start`` to ``pred_end`` days after the index date (never on or before
    it). Events are scanned in time order: the first outcome at or after a date decides, so index events and
    outcomes are never paired with each other.
    """
    lo_date, hi_date = dates
    first_seen = observed.groupBy("person_id").agg(F.min("observed_from").alias("__first"))
    start = F.greatest(F.lit(pred_start), F.lit(1))
    asks = index_events.select("person_id", "index_date", F.date_add("index_date", start).alias("__from"))
    points = asks.select("person_id", "__from", "index_date", F.lit(1).alias("__ask")).unionByName(
        outcomes.select("person_id", F.col("outcome_date").alias("__from"), F.lit(0).alias("__ask")).distinct(),
        allowMissingColumns=True,
    )
    back = -F.unix_date("__from")
    order = [back, F.col("__ask"), F.coalesce(F.unix_date("index_date"), F.lit(0))]
    nxt = ordered_scan(
        points, ["person_id"], int_levels(back, (9,)), order, fill={"__next": F.when(F.col("__ask") == 0, F.col("__from"))}
    ).filter("__ask = 1")
    out = nxt.join(first_seen, "person_id").join(people.select("person_id", "birth"), "person_id")
    age = completed_years(F.col("birth"), F.col("index_date").cast("timestamp"))
    out = out.withColumn("age", age).withColumn(
        "label", F.coalesce((F.datediff("__next", "index_date") <= pred_end).cast("int"), F.lit(0))
    )
    return out.filter(
        (F.datediff("index_date", "__first") >= obs_days)
        & F.col("age").between(*ages)
        & F.col("index_date").between(F.lit(lo_date).cast("date"), F.lit(hi_date).cast("date"))
    ).select("person_id", "index_date", "age", "label")


def subsample(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """A share of the keys by seeded hash; a larger share contains the smaller ones."""
    return df.filter(bucket(seed, F.col(key)) < int(fraction * 1_000_000))


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """``fold`` 0..k-1, dealt out in hash order within each label; rows without a label are a label of their own."""
    order = [hash32(seed, F.col(key)), F.col(key)]
    df, by = _by_label(df, label)
    ranked = ordered_scan(df, by, int_levels(order[0], (22, 12)), order, count="__rank")
    return ranked.withColumn("fold", ((F.col("__rank") - 1) % k).cast("int")).drop("__rank", *by)


def _by_label(df: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    """``df`` with columns that group it by label and are not null, as a scan needs, and their names."""
    df = df.withColumns({"__label": F.coalesce(F.col(label).cast("string"), F.lit("")), "__unlabelled": F.col(label).isNull()})
    return df, ["__label", "__unlabelled"]


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.15, seed: int = 42) -> DataFrame:
    """``split``: the first ``test`` share of each label in hash order; rows without a label are a label of their own."""
    order = [hash32(seed, F.col(key)), F.col(key)]
    df, by = _by_label(df, label)
    ranked = ordered_scan(df, by, int_levels(order[0], (22, 12)), order, count="__rank")
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    cut = F.floor(F.col("__n") * test + F.lit(0.5))
    out = ranked.join(sizes, by)
    return out.withColumn("split", F.when(F.col("__rank") <= cut, "test").otherwise("train")).drop("__rank", "__n", *by)


def chronological_split(df: DataFrame, time: str, fractions: dict[str, float]) -> DataFrame:
    """``split`` by date: each split takes the share of rows with the earliest dates left; a date is never divided.

    Rows are counted per date first, so the ordering runs over distinct dates only. Shares are of the rows that have a date;
    the others have no place in time and get a null split.
    """
    day = F.to_date(time)
    per_day = df.filter(day.isNotNull()).groupBy(day.alias("__day")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = ordered_scan(
        per_day, [], int_levels(F.unix_date("__day"), (9,)), [F.col("__day")], sums={"__upto": F.col("__n")}
    )
    total = per_day.agg(F.sum("__n")).first()[0] or 0
    before = (F.col("__upto") - F.col("__n")) / F.lit(float(max(total, 1)))
    names = list(fractions)
    out, edge = None, 0.0
    for name in names[:-1]:
        edge += fractions[name]
        out = F.when(before < edge, F.lit(name)) if out is None else out.when(before < edge, F.lit(name))
    split = F.lit(names[-1]) if out is None else out.otherwise(F.lit(names[-1]))
    days = ranked.select("__day", split.alias("split"))
    return df.withColumn("__day", day).join(days, "__day", "left").drop("__day")


def named_split(df: DataFrame, test_ids: DataFrame, key: str = "person_id") -> DataFrame:
    """``split`` test for the listed keys, train for the others."""
    marks = test_ids.select(key).distinct().withColumn("__t", F.lit(True))
    return df.join(marks, key, "left").withColumn("split", F.when(F.col("__t"), "test").otherwise("train")).drop("__t")


def first_where(test: Column, value: Column) -> Column:
    """Smallest ``value`` among rows that pass ``test``."""
    return F.min(F.when(test, value))
