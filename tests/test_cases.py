"""Hand-built cases with known results."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import timing
from eventloom.functions.quantiles import exact_quantiles
from eventloom.functions.scan import double_levels, int_levels, ordered_scan
from eventloom.operators import batches as B
from eventloom.operators import clean as P
from eventloom.operators import cohort as C
from eventloom.operators import metrics as M
from eventloom.operators import quality as Q
from eventloom.operators import sequence as S
from eventloom.operators import tokens as T
from eventloom.operators import visits as V
from eventloom.sources import io
from eventloom.streaming import streams as X


def at(text):
    return dt.datetime.fromisoformat(text)


VISITS = "person_id long, visit_id long, visit_type string, visit_start timestamp, visit_end timestamp, discharge_facility string"
EVENTS = "person_id long, visit_id long, event_id long, time timestamp, code string, numeric_value double, text_value string, unit string"


# ---- sequences ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def patient(spark):
    visits = spark.createDataFrame(
        [
            (0, 2, "9201", at("2024-04-21"), at("2024-04-22"), "8536"),
            (0, 1, "9202", at("2024-04-14"), None, None),
        ],
        VISITS,
    )
    events = spark.createDataFrame(
        [
            (0, 1, 1, at("2024-04-14"), "320128", None, None, None),
            (0, 2, 2, at("2024-04-21"), "320128", None, None, None),
            (0, 2, 3, at("2024-04-22"), "4134120", 0.5, None, None),
        ],
        EVENTS,
    )
    people = spark.createDataFrame(
        [(0, at("1980-04-14"), "Gender/F", "Race/unknown")], "person_id long, birth timestamp, gender string, race string"
    )
    return visits, events, people


def rows(patient, **options):
    return S.build_sequence(*patient, S.SequenceOptions(**options)).orderBy("pos").collect()


CASES = [
    (dict(gap="week", auxiliary=True), "[VS] 9202 320128 [VE] W1 [VS] 9201 320128 4134120 8536 [VE]"),
    (dict(gap="week"), "[VS] 320128 [VE] W1 [VS] 320128 4134120 [VE]"),
    (
        dict(gap="day", stay="day", auxiliary=True, prompt=True),
        "year:2024 age:44 Gender/F Race/unknown [VS] 9202 320128 [VE] D7 [VS] 9201 320128 i-D1 4134120 8536 [VE]",
    ),
    (dict(gap="week_month", stay="day", auxiliary=True), "[VS] 9202 320128 [VE] W1 [VS] 9201 320128 i-D1 4134120 8536 [VE]"),
    (dict(gap="none"), "[VS] 320128 [VE] [VS] 320128 4134120 [VE]"),
]


@pytest.mark.parametrize("options, tokens", CASES)
def test_known_sequences(patient, options, tokens):
    got = rows(patient, **options)
    assert [r["token"] for r in got] == tokens.split()
    assert [r["pos"] for r in got] == list(range(1, len(got) + 1))


@pytest.mark.parametrize("options, tokens", CASES[2:3])
def test_known_sequences_when_split(patient, split_everything, options, tokens):
    assert [r["token"] for r in rows(patient, **options)] == tokens.split()


def test_side_columns(patient):
    got = rows(patient, gap="week", auxiliary=True)
    assert [r["age"] for r in got] == [44] * 4 + [-1] + [44] * 6
    assert [r["week"] for r in got] == [2832] * 4 + [0] + [2833] * 6
    assert [r["segment"] for r in got] == [1] * 4 + [0] + [2] * 6
    assert [r["visit_order"] for r in got] == [1] * 4 + [2] * 7
    assert [r["value_mask"] for r in got] == [0] * 8 + [1] + [0] * 2
    assert [r["value"] for r in got] == [-1.0] * 8 + [0.5] + [-1.0] * 2


def test_visit_with_untimed_events_only(spark, patient):
    visits, events, people = patient
    events = events.withColumn("time", F.when(F.col("visit_id") == 2, F.col("time")))
    got = S.build_sequence(visits, events, people, S.SequenceOptions(gap="week")).orderBy("pos").collect()
    assert [r["token"] for r in got] == "[VS] [VE] W1 [VS] 320128 4134120 [VE]".split()


def test_outpatient_copies_keep_the_first(spark):
    e = spark.createDataFrame(
        [(1, 1, i, at(f"2024-01-01 0{9 - i}:00"), "a b", None, None, f"u{i}") for i in range(4)], EVENTS
    ).withColumn("is_stay", F.lit(False))
    out = S.dedup_outpatient(S.value_columns(S.fold_text(e))).collect()
    assert [(r["event_id"], r["token"], r["unit"]) for r in out] == [(3, "a_b", "u3")]


def test_time_tokens(spark):
    days = [-3, 0, 6, 7, 27, 28, 30, 59, 360, 365, 366, 4000]
    df = spark.createDataFrame([(d,) for d in days], "d long")
    got = [r[0] for r in df.select(timing.time_token(F.col("d"), "week_month")).collect()]
    assert got == ["W0", "W0", "W0", "W1", "W3", "M1", "M1", "M1", "M11", "M11", "LT", "LT"]
    with pytest.raises(ValueError):
        timing.time_token(F.col("d"), "year")


def test_time_token_parser(spark):
    want = {
        "D7": (True, 7), "W2": (True, 14), "M3": (True, 90), "Y1": (True, 365), "LT": (True, 1095), "VS-D7-VE": (True, 7),
        "VS-LT-VE": (True, 1095), "i-D4": (True, 4), "i-W4": (True, 4), "i-LT": (True, 1095), "i-H3": (False, 3), "abc": (False, None),
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    got = df.select("t", timing.is_time_token(F.col("t")), timing.token_days(F.col("t"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == want
    with pytest.raises(Exception, match="invalid time token"):
        df.filter("t = 'abc'").select(timing.token_days(F.col("t"), strict=True)).collect()


def test_sort_sequence(spark):
    df = spark.createDataFrame(
        [([2, 1, 3], ["c", "b", "a"], [20, 10, 30], "x")], "orders array<int>, concept_ids array<string>, ages array<int>, other string"
    )
    r = S.sort_sequence(df, ["concept_ids", "ages"], "orders").first()
    assert (r["concept_ids"], r["ages"], r["other"]) == (["b", "c", "a"], [10, 20, 30], "x")


def test_arrays_continue_on_further_rows(spark):
    df = spark.range(25).select(F.lit(1).alias("person_id"), (F.col("id") + 1).alias("pos"), F.col("id").cast("string").alias("token"))
    arrays = S.to_arrays(df, ["token"], 10)
    got = sorted((r["part"], r["n_parts"], len(r["token"]), r["num_of_concepts"]) for r in arrays.collect())
    assert got == [(0, 3, 10, 25), (1, 3, 10, 25), (2, 3, 5, 25)]
    assert P.keep_min_length(arrays, 20).count() == 3  # the short last row belongs to a long history
    back = S.from_arrays(arrays, ["token"], 10).orderBy("pos").collect()
    assert [(r["pos"], r["token"]) for r in back] == [(i + 1, str(i)) for i in range(25)]


def greedy(times, start, day=timing.DAY_US):
    out, cursor = [], start
    for t in sorted(times):
        if t - cursor >= day:
            out.append((t, (t - cursor) // day))
            cursor = t
    return out


@pytest.mark.parametrize("split", [False, True])
def test_stay_moves_follow_the_greedy_rule(spark, monkeypatch, split):
    rng = random.Random(5)
    data, want = [], {}
    for v in range(12):
        start = rng.randrange(10**15)
        times = [start + rng.randrange(-timing.DAY_US, rng.choice([2, 9, 40]) * timing.DAY_US) for _ in range(30)]
        want[v] = greedy(times, start)
        data += [(1, v, start, t) for t in times]
    df = spark.createDataFrame(data, "person_id long, visit_id long, s long, t long").select(
        "person_id", "visit_id", F.timestamp_micros("s").alias("visit_start"), F.timestamp_micros("t").alias("time")
    )
    if split:
        from eventloom.functions import scan

        monkeypatch.setattr(scan, "SPLIT_ABOVE", -1)
        monkeypatch.setattr(S, "SPLIT_ABOVE", -1)
    got: dict = {v: [] for v in want}
    for r in S.stay_moves(df).select("visit_id", F.unix_micros("time").alias("t"), "move_days").collect():
        got[r["visit_id"]].append((r["t"], r["move_days"]))
    assert {v: sorted(x) for v, x in got.items()} == want


# ---- scans and quantiles -------------------------------------------------------------------------------------------


def test_scan_matches_plain_loop(spark, split_everything):
    rng = random.Random(3)
    data = [(k, i, rng.choice([None, rng.randrange(100)])) for k in range(3) for i in rng.sample(range(10**9), 200)]
    df = spark.createDataFrame(data, "k int, i long, v long")
    out = ordered_scan(
        df, ["k"], int_levels(F.col("i")), [F.col("i")], count="n", sums={"s": F.col("v")}, before_max={"m": F.col("v")},
        before_last={"p": F.col("v")}, fill={"f": F.col("v")},
    )
    got = {(r["k"], r["i"]): r for r in out.collect()}
    for k in range(3):
        n = s = 0
        m = p = f = None
        for _, i, v in sorted(x for x in data if x[0] == k):
            n, s, f = n + 1, s + (v or 0), v if v is not None else f
            r = got[k, i]
            assert (r["n"], r["s"], r["m"], r["p"], r["f"]) == (n, s, m, p, f)
            p = v
            m = v if m is None else m if v is None else max(m, v)


def test_double_levels_keep_order(spark):
    rng = random.Random(1)
    values = sorted({0.0, 1e-300, -1e-300, 0.5, 1.0, 2.0, np.nextafter(2.0, 0), *(rng.gauss(0, 1) * 10.0 ** rng.randrange(-9, 9) for _ in range(500))})
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    levels = double_levels(F.col("v"))
    keys = [(r[1], r[2]) for r in df.select("v", *levels).orderBy("v").collect()]
    assert keys == sorted(keys)


@pytest.mark.parametrize("split", [False, True])
def test_quantiles(spark, monkeypatch, split):
    from eventloom.functions import scan

    if split:
        monkeypatch.setattr(scan, "SPLIT_ABOVE", -1)
    values = np.random.default_rng(0).normal(size=501).round(2)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    r = exact_quantiles(df, [], "v", probs).first()
    assert [r[f"q{i}"] for i in range(len(probs))] == pytest.approx(np.quantile(values, probs).tolist())


# ---- visits ------------------------------------------------------------------------------------------------------

FLAT = "subject_id long, event_id long, code string, time timestamp, visit_id long"


def flat_events(spark, birth="MEDS_BIRTH"):
    data = [
        (birth, "1985-01-01", None), ("RACE_WHITE", None, None), ("GENDER_MALE", None, None), ("ETHNICITY_NON_HISPANIC", None, None),
        ("VS/IP", "2021-05-05 10:00", 1), ("EVENT_2", "2021-05-05 15:00", 1), ("EVENT_3", "2021-05-05 16:00", None),
        ("DISCHARGE", "2021-05-05 20:00", 1), ("EVENT_4", "2021-05-20 20:00", None), ("VS/OP", "2021-06-05 10:00", 2),
        ("EVENT_5", "2021-06-05 15:00", 2),
    ]
    return spark.createDataFrame([(9, i, c, at(t) if t else None, v) for i, (c, t, v) in enumerate(data)], FLAT)


def test_flat_events_to_visits(spark):
    ev = flat_events(spark)
    r = V.demographics(ev).first()
    assert (r["birth"], r["race"], r["gender"], r["ethnicity"]) == (at("1985-01-01"), "RACE_WHITE", "GENDER_MALE", "ETHNICITY_NON_HISPANIC")
    timed = ev.filter("event_id > 3")
    visits = V.link_visits(timed).withColumnsRenamed({"min_time": "visit_start", "max_time": "visit_end"})
    got: dict = {}
    for r in V.assign_events(timed, visits).collect():
        got.setdefault(r["visit_id"], set()).add(r["code"])
    assert got == {1: {"VS/IP", "EVENT_2", "EVENT_3", "DISCHARGE"}, 3: {"EVENT_4"}, 2: {"VS/OP", "EVENT_5"}}


def test_flat_events_to_patients(spark):
    ev = flat_events(spark).withColumns({"table": F.lit("measurement"), "end": F.lit(None).cast("timestamp")})

    def visits(rules):
        (row,) = V.linked_patients(ev, rules, ["code"]).collect()
        return [(v["visit_id"], v["visit_type"], [e["code"] for e in v["events"]]) for v in row["visits"]]

    plain = V.VisitRules(visit=("NONE",))
    assert [(i, len(e)) for i, _, e in visits(plain)] == [(1, 4), (3, 1), (2, 2)]
    rules = V.VisitRules(visit=("VS/",), admission=("VS/IP",), discharge=("DISCHARGE",))
    assert visits(rules)[0] == (1, "VS/IP", ["EVENT_2", "EVENT_3"]) and visits(rules)[2] == (2, "VS/OP", ["EVENT_5"])


def test_absorbed_blocks_bring_their_events(spark):
    """A contained block's events move to the survivor, without those that state its own type and discharge."""
    rows = [
        ("VS/OP", "2024-01-01", 1), ("a", "2024-01-09", 1), ("VS/IP", "2024-01-02", 2), ("b", "2024-01-03", 2), ("OUT", "2024-01-05", 2),
        ("VS/ER", "2024-01-03", 3), ("c", "2024-01-03", 3), ("OUT", "2024-01-04", 3), ("VS/OP", "2024-02-01", 4),
    ]
    flat = spark.createDataFrame([(9, i, c, at(t), v) for i, (c, t, v) in enumerate(rows)], FLAT)
    flat = flat.withColumns({"table": F.lit("measurement"), "end": F.lit(None).cast("timestamp")})
    rules = V.VisitRules(visit=("VS/",), ed=("VS/ER",), admission=("VS/IP",), discharge=("OUT",))
    (row,) = V.linked_patients(flat, rules, ["code"]).collect()
    got = {v["visit_id"]: (v["visit_type"], v["discharge_facility"], [e["code"] for e in v["events"]]) for v in row["visits"]}
    assert got == {2: (V.ED_TO_INPATIENT_TYPE, "OUT", ["b", "c", "a"]), 4: ("VS/OP", V.UNKNOWN, [])}


@pytest.mark.parametrize("code, found", [("MEDS_BIRTH//MODIFIER", True), ("//MEDS_BIRTH//MODIFIER", False)])
def test_birth_code_is_a_prefix(spark, code, found):
    assert (V.demographics(flat_events(spark, code)).first()["birth"] is not None) == found


BLOCKS = "subject_id long, visit_id long, visit_type string, visit_start timestamp, visit_end timestamp, has_ed boolean, has_admission boolean"


def block(i, kind, start, end, subject=1):
    day = dt.timedelta(days=1)
    t0 = at("2024-01-01")
    return (subject, i, kind, t0 + start * day, t0 + end * day, kind == "ED", kind == "INPATIENT")


@pytest.mark.parametrize("merge", [V.merge_contained, V.merge_contained_swapping])
def test_containment(spark, merge):
    blocks = [block(1, "INPATIENT", 0, 5), block(2, "OUTPATIENT", 1, 2), block(3, "ED", 10, 11), block(4, "OUTPATIENT", 3, 4)]
    got = {r["visit_id"]: (r["container_id"], r["merged_type"]) for r in merge(spark.createDataFrame(blocks, BLOCKS)).collect()}
    assert got == {1: (1, "INPATIENT"), 2: (1, "INPATIENT"), 3: (3, "ED"), 4: (1, "INPATIENT")}


def test_containment_swaps_for_admissions(spark):
    blocks = [block(1, "OUTPATIENT", 0, 5), block(2, "INPATIENT", 1, 4), block(3, "ED", 2, 3), block(4, "OUTPATIENT", 4.5, 5)]
    got = {r["visit_id"]: (r["container_id"], r["merged_type"], r["dropped_type"])
           for r in V.merge_contained_swapping(spark.createDataFrame(blocks, BLOCKS)).collect()}
    assert got == {
        1: (2, "Visit/ERIP", "OUTPATIENT"), 2: (2, "Visit/ERIP", None), 3: (2, "Visit/ERIP", "ED"), 4: (4, "OUTPATIENT", None),
    }


SWAPS = {
    "an admission takes the place, later blocks are held against it": (
        [block(1, "OUTPATIENT", 0, 9), block(2, "INPATIENT", 1, 4), block(3, "OUTPATIENT", 2, 6), block(4, "OUTPATIENT", 5, 6)],
        {1: (2, "OUTPATIENT"), 2: (2, None), 3: (3, None), 4: (3, "OUTPATIENT")},
    ),
    "the first open place takes a block, not the tightest": (
        [block(1, "INPATIENT", 0, 9), block(2, "OUTPATIENT", 1, 10), block(3, "OUTPATIENT", 2, 3)],
        {1: (1, None), 2: (2, None), 3: (1, "OUTPATIENT")},
    ),
    "a place closes when a block starts after its end": (
        [block(1, "OUTPATIENT", 0, 2), block(2, "ED", 2, 2), block(3, "OUTPATIENT", 3, 4), block(4, "INPATIENT", 3, 4)],
        {1: (2, "OUTPATIENT"), 2: (2, None), 3: (4, "OUTPATIENT"), 4: (4, None)},
    ),
    "an admission keeps its place against another": (
        [block(1, "INPATIENT", 0, 9), block(2, "INPATIENT", 1, 2), block(3, "ED", 3, 4)],
        {1: (1, None), 2: (1, "INPATIENT"), 3: (1, "ED")},
    ),
}


@pytest.mark.parametrize("case", SWAPS)
def test_containment_swaps_in_order(spark, case):
    blocks, want = SWAPS[case]
    got = V.merge_contained_swapping(spark.createDataFrame(blocks, BLOCKS)).collect()
    assert {r["visit_id"]: (r["container_id"], r["dropped_type"]) for r in got} == want and len(got) == len(want)


DAYS = "subject_id long, visit_id long, min_time timestamp, max_time timestamp, has_ed boolean, has_admission boolean, discharged_to string, visit_type string"


def days(*flags):
    out = []
    for i, (day, f) in enumerate(flags):
        t0 = at("2024-01-01") + dt.timedelta(days=day)
        out.append((1, i + 1, t0 + dt.timedelta(hours=8), t0 + dt.timedelta(hours=20), "e" in f, "a" in f, "HOME" if "d" in f else None, "Visit/OP"))
    return out


@pytest.mark.parametrize(
    "flags, open_end, want",
    [
        ([(0, "e"), (1, "a"), (2, ""), (3, "d"), (9, "")], False, [1, 1, 1, 1, 5]),
        ([(0, "e"), (3, "a"), (4, "d")], False, [1, 2, 3]),  # ED too early: the admission never takes hold
        ([(0, "a"), (2, "a"), (3, "d"), (4, "")], False, [1, 2, 2, 2]),  # replaced admission, then a block within 12 hours
        ([(0, "a"), (1, "")], False, [1, 2]),
        ([(0, "a"), (1, "")], True, [1, 1]),
        ([(0, "ad"), (1, "ad"), (2, "ad")], False, [1, 1, 1]),  # each stay follows the last within 12 hours
    ],
)
def test_stitching(spark, flags, open_end, want):
    out = V.stitch_admissions(spark.createDataFrame(days(*flags), DAYS), open_end=open_end).orderBy("block_id").collect()
    assert [r["visit_id"] for r in out] == want


def test_text_to_numeric(spark):
    schema = "event_id long, code string, numeric_value double, text_value string"
    data = [(1, "Blood Pressure", None, "120/80"), (2, "Blood Pressure", None, "high"), (3, "Weight (Lbs)", None, "150 lbs"), (4, "Weight (Lbs)", 3.0, "150"), (5, "x", None, None)]
    out = V.text_to_numeric(spark.createDataFrame(data, schema), V.RULE_SETS["hospital_day"].text)
    assert sorted((r["event_id"], r["code"], r["numeric_value"]) for r in out.filter("numeric_value IS NOT NULL").collect()) == [
        (1, "Diastolic Blood Pressure", 80.0), (1, "Systolic Blood Pressure", 120.0), (3, "Weight (Lbs)", 150.0), (4, "Weight (Lbs)", 3.0),
    ]
    assert out.count() == 6


def test_rule_prefixes_are_literal(spark):
    df = spark.createDataFrame([("a.b//x",), ("aXb//x",), ("xa.b",)], "code string")
    from eventloom.functions.text import starts_with_any

    assert [r[0] for r in df.select(starts_with_any(F.col("code"), ("a.b",))).collect()] == [True, False, False]


@pytest.mark.parametrize("part_size", [7, 3])
def test_nested_patients_round_trip(spark, part_size):
    events = spark.createDataFrame([(1, v, 10 * v + i, at("2024-01-01") + dt.timedelta(days=v, hours=i), f"c{i}") for v in range(1, 4) for i in range(5)],
                                   "subject_id long, visit_id long, event_id long, time timestamp, code string")
    visits = spark.createDataFrame([(1, v, "OP", at("2024-01-01") + dt.timedelta(days=v)) for v in range(1, 5)],
                                   "subject_id long, visit_id long, visit_type string, visit_start timestamp")
    nested = V.nest_patients(visits, events, ["code"], part_size=part_size)
    assert nested.count() > 1
    assert max(sum(len(v["events"]) for v in r["visits"]) for r in nested.collect()) < 2 * part_size
    assert sum(len(v["events"]) for r in nested.collect() for v in r["visits"]) == 15
    assert {v["visit_id"] for r in nested.collect() for v in r["visits"]} == {1, 2, 3, 4}
    flat = V.flatten_visits(nested).select("event_id").collect()
    assert sorted(r[0] for r in flat) == sorted(r["event_id"] for r in events.collect())


# ---- tokens and statistics -----------------------------------------------------------------------------------------

VALUES = "concept_id string, unit string, value double, value_mask int"


def test_lab_statistics(spark):
    values = [10, 12, 13, 14, 99999, 15, 16, 17, 18, -1000]
    df = spark.createDataFrame([("c", "u", float(v), 1) for v in values] + [("c", "u", 0.0, 1), ("c", "u", 5.0, 0)], VALUES)
    r = T.lab_stats(df, k=2.0).first()
    kept = [10, 12, 13, 14, 15, 16, 17, 18]
    assert (r["count"], r["mean"], r["std"]) == (8, pytest.approx(np.mean(kept)), pytest.approx(np.std(kept)))
    one_to_ten = spark.createDataFrame([("c", "u", float(v), 1) for v in range(1, 11)], VALUES)
    assert T.lab_stats(one_to_ten, k=2.0).first()["std"] == pytest.approx(np.std(range(2, 10)))


def test_normalize_and_back(spark):
    stats = spark.createDataFrame(
        [("concept_1", "unit_1", 10.0, 2.0, 100, 3.0, 4.0, 16.0), ("concept_2", "unit_1", 20.0, 5.0, 100, 2.5, 0.0, 0.0),
         ("concept_2", "unit_2", 15.0, 3.0, 200, 2.0, 0.0, 0.0), ("flat", "u", 7.0, 0.0, 5, 3.0, 7.0, 7.0)], io.STATS_SCHEMA)
    df = spark.createDataFrame(
        [("concept_1", "unit_1", 12.0, 1), ("concept_1", "unit_1", 20.0, 1), ("other", "unit_1", 15.0, 1), ("flat", "u", 9.0, 1), ("concept_1", "unit_1", 12.0, 0)], VALUES)
    got = sorted((r["concept_id"], r["value"], r["value_mask"], r["normalized"]) for r in T.normalize(df, stats).collect())
    assert got == [("concept_1", 12.0, 0, 12.0), ("concept_1", 12.0, 1, 1.0), ("concept_1", 20.0, 1, 3.0), ("flat", 9.0, 1, 0.0), ("other", 15.0, 1, 15.0)]
    shares = {(r["concept_id"], r["unit"]): r["probability"] for r in T.unit_distribution(stats).collect()}
    assert shares["concept_2", "unit_1"] == pytest.approx(1 / 3) and shares["concept_2", "unit_2"] == pytest.approx(2 / 3)
    z = spark.range(3000).select("id", F.lit("concept_2").alias("concept_id"), F.lit(0.5).alias("normalized"))
    back = {r["unit"]: (r["value"], r["n"]) for r in T.denormalize(z, stats, "id").groupBy("unit", "value").agg(F.count("*").alias("n")).collect()}
    assert back["unit_1"][0] == 22.5 and back["unit_2"][0] == 16.5
    assert abs(back["unit_1"][1] - 1000) < 120
    alone = spark.createDataFrame([(1, "concept_1", 1.0), (2, "nothing", 1.0)], "id long, concept_id string, normalized double")
    assert {r["id"]: (r["value"], r["unit"]) for r in T.denormalize(alone, stats, "id").collect()} == {1: (12.0, "unit_1"), 2: (1.0, S.NO_UNIT)}


def test_vocabulary(spark):
    df = spark.createDataFrame([(t,) for t in ["hello", "world", "hello", "b", "a", "[PAD]"]], "token string")
    vocab = T.build_vocab(df, size=8)
    assert {r["token"]: r["id"] for r in vocab.collect()} == {
        "[PAD]": 0, "[MASK]": 1, "[OOV]": 2, "[CLS]": 3, "[UNUSED]": 4, "hello": 5, "a": 6, "b": 7}
    ids = {r["token"]: r["token_id"] for r in T.encode(df, vocab).collect()}
    assert ids["hello"] == 5 and ids["world"] == 2 and ids["[PAD]"] == 0
    words = T.decode(spark.createDataFrame([(0,), (5,), (99,)], "token_id int"), vocab).collect()
    assert {r["token_id"]: r["token"] for r in words} == {0: "[PAD]", 5: "hello", 99: "[OOV]"}


def test_gated_state(spark):
    state = None
    for chunk in ([1.0, 2, 3, 4], [5.0, 6, 7, 8], [9.0, 10, 5, 500, float("nan"), 0]):
        state = X.gated_update(state, np.array(chunk), k=2.0, capacity=10)
    n, mean, m2, buffer = state
    kept = [2, 3, 4, 5, 6, 7, 8, 9, 5]
    assert (n, mean, buffer) == (9, pytest.approx(np.mean(kept)), [])
    assert math.sqrt(m2 / n) == pytest.approx(np.std(kept))


def test_gated_state_does_not_depend_on_batches():
    values = np.random.default_rng(3).normal(10, 2, 400)
    values[55::37] = 900.0  # after the seeds: the quantiles that three deviations mark are the ends of fifty of them
    ends = []
    for size in (1, 7, 400):
        state = None
        for i in range(0, 400, size):
            state = X.gated_update(state, values[i : i + size], k=3.0, capacity=50)
        ends.append(state[:3])
    assert ends[0] == pytest.approx(ends[1]) and ends[0] == pytest.approx(ends[2]) and ends[0][1] < 11


def test_moments_combine():
    a = X.combine(0, 0, 0, np.arange(1.0, 6))
    n, mean, m2 = X.combine(*a, np.arange(6.0, 11))
    assert (n, mean, math.sqrt(m2 / n)) == (10, pytest.approx(5.5), pytest.approx(np.std(np.arange(1, 11))))


# ---- cohorts -----------------------------------------------------------------------------------------------------


def test_cohort(spark):
    people = spark.createDataFrame([(i,) for i in range(1, 7)], "person_id long")
    seen = [(p, at(t).date()) for p in range(1, 6) for t in ("2015-01-01", "2021-01-01")]
    seen += [(6, at("2016-01-01").date()), (6, at("2016-02-01").date())]
    visits = spark.createDataFrame(seen, "person_id long, visit_start_date date")
    conditions = spark.createDataFrame(
        [(p, c, at(t).date()) for p, c, t in ((1, 1001, "2020-01-01"), (2, 1002, "2020-06-01"), (3, 2002, "2019-01-01"), (4, 2002, "2018-01-01"), (5, 2002, "2019-06-01"))],
        "person_id long, condition_concept_id long, condition_start_date date")
    concepts = spark.createDataFrame([(1001, "ICD-10-CM:G30.9"), (1002, "ICD-9-CM:331.0"), (2002, "ICD-10-CM:E11.9")], "concept_id long, concept_code string")
    out = C.case_control(people, visits, conditions, concepts, [r"ICD-9-CM:331\.0", r"ICD-10-CM:G30"], 90, 365)
    assert {r["person_id"]: r["label"] for r in out.collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    split = C.hash_split(out, "person_id", {"test": 0.4, "train": 0.6})
    assert split.count() == 5 and C.leaked(split).count() == 0


def test_extraction_reads_the_age_token(spark):
    seq = spark.createDataFrame([(1, 1, "year:2000", 10.0), (1, 2, "age:44", 10.0), (1, 3, "x", 5e8), (1, 4, "y", 2e9)], "person_id long, pos long, token string, epoch double")
    cohort = spark.createDataFrame([(1, at("2001-09-09"), 1), (1, at("1970-01-01"), 0)], "person_id long, index_date timestamp, label int")
    got = {(r["label"], r["token"], r["age_at_index"]) for r in C.cut_at_index(seq, cohort).collect()}
    assert got == {(1, "year:2000", 44), (1, "age:44", 44), (1, "x", 44)}
    assert {r["token"] for r in C.cut_at_index(seq, cohort, 10).collect()} == set()


# ---- batches -----------------------------------------------------------------------------------------------------


def long_form(spark, ids):
    names = {2: "[VS]", 3: "[VE]"}
    return spark.createDataFrame([(1, i + 1, names.get(t, str(t)), t) for i, t in enumerate(ids)], "person_id long, pos long, token string, token_id int")


def cut(df, *args, **kw):
    return [r["token_id"] for r in B.truncate(df, *args, **kw).orderBy("pos").collect()]


def test_truncation(spark):
    assert cut(long_form(spark, [13, 14, 15, 16, 2, 3, 4, 5, 6, 7]), 10) == [2, 3, 4, 5, 6, 7]
    for n in (5, 9):
        assert cut(long_form(spark, range(10, 10 + n)), 10) == list(range(10, 10 + n))
    ids = [2, 4, 3, 5, 2, 6, 7, 8, 9, 10, 3, 11, 2, 12, 3, 13, 2, 14, 3]
    for seed in range(4):
        got = cut(long_form(spark, ids), 10, "random_right", seed)
        assert len(got) == 9 and got[0] == 2
        assert len(cut(long_form(spark, ids), 10, "random", seed)) == 9
        whole = cut(long_form(spark, ids), 10, "random_complete", seed)
        assert whole[0] == 2 and len(whole) < 9
    with pytest.raises(ValueError):
        cut(long_form(spark, ids), 10, "middle")


def test_masking(spark):
    df = spark.range(20000).select(F.lit(1).alias("person_id"), F.col("id").alias("pos"), (F.when(F.col("id") % 10 == 0, 3).otherwise(50)).alias("token_id"))
    out = B.mask_tokens(df, vocab_size=40)
    shares = out.filter("token_id = 50").agg(F.avg((F.col("label_id") != -100).cast("int")), F.avg(F.when(F.col("label_id") != -100, (F.col("masked_id") == 1).cast("int")))).first()
    assert abs(shares[0] - 0.15) < 0.01 and abs(shares[1] - 0.8) < 0.03
    assert out.filter("token_id = 3 AND (masked_id <> 3 OR label_id <> -100)").count() == 0


def test_packing(spark):
    lengths = spark.range(300).select(F.col("id").alias("person_id"), (F.col("id") * 37 % 120 + 1).alias("length"))
    packs = B.pack(lengths, max_tokens=256, max_pos=100, shards=3)
    used = packs.groupBy("shard", "pack").agg(F.sum(F.least("length", F.lit(100)) + 2).alias("used"))
    assert packs.count() == 300 and used.agg(F.max("used")).first()[0] <= 256
    dropped = B.pack(lengths, max_tokens=256, max_pos=100, shards=3, drop_last=True)
    lost = packs.join(dropped, "person_id", "left_anti").select("shard", "pack").distinct().collect()
    assert [r["shard"] for r in lost] == [2]  # one pack of the one replica
    two = B.pack(lengths, max_tokens=256, max_pos=100, shards=3, drop_last=True, replicas=2)
    assert 0 < 300 - two.count() < 40 and {r["shard"] for r in two.select("shard").distinct().collect()} == {0, 1, 2, 3}
    assert B.default_shards(250_000) == 3


# ---- evaluation --------------------------------------------------------------------------------------------------


def score_df(spark, y, p):
    return M.score_table(spark.createDataFrame([(float(b), float(a)) for a, b in zip(y, p)], "p double, y double"))


def auc_by_pairs(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return float(((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean())


def test_metrics_on_separable_scores(spark):
    s = score_df(spark, [0, 1, 0, 1], [0.1, 0.9, 0.4, 0.7])
    assert M.roc_auc(s).first()[0] == 1 and M.average_precision(s).first()[0] == 1 and M.pr_auc(s).first()[0] == 1


def test_auc_reversed(spark):
    rng = np.random.default_rng(2)
    y, p = rng.integers(0, 2, 200), rng.random(200).round(2)
    assert M.roc_auc(score_df(spark, y, p)).first()[0] == pytest.approx(auc_by_pairs(y, p))
    assert M.roc_auc(score_df(spark, y, 1 - p)).first()[0] == pytest.approx(1 - auc_by_pairs(y, p))


def test_confusion(spark):
    s = score_df(spark, [1, 0, 1, 0, 1, 0], [0.9, 0.8, 0.4, 0.3, 0.6, 0.1])
    r = M.threshold_metrics(s, 0.5).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (2, 1, 1, 2)
    assert all(r[c] == pytest.approx(2 / 3) for c in ("sensitivity", "specificity", "ppv", "npv", "f1", "accuracy"))
    r = M.threshold_metrics(s, 0.95).first()
    assert r["ppv"] is None and r["sensitivity"] == 0 and r["specificity"] == 1


def test_thresholds(spark):
    s = score_df(spark, [0, 1, 0, 1], [0.1, 0.9, 0.4, 0.7])
    assert M.select_threshold(s).first()[0] == 0.7
    assert M.select_threshold(s, "high_sensitivity", 0.5).first()[0] == 0.9
    assert M.select_threshold(s, "best_f1").first()[0] == 0.7
    assert M.select_threshold(score_df(spark, [1, 0], [0.1, 0.9])).first()[0] == float("inf")
    with pytest.raises(ValueError):
        M.select_threshold(s, "other")


def test_calibration(spark):
    rng = np.random.default_rng(0)
    p = rng.random(4000)
    y = (rng.random(4000) < p).astype(int)
    s = score_df(spark, y, p)
    slope, intercept = M.calibration_fit(s)
    assert abs(slope - 1) < 0.15 and abs(intercept) < 0.15
    assert M.reliability(s).agg(F.sum("n")).first()[0] == 4000
    assert M.calibration_error(M.reliability(s)).first()[0] < 0.05
    assert math.isnan(M.calibration_fit(score_df(spark, [1, 1], [0.2, 0.3]))[0])


def test_bootstrap(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300)
    p = np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1).round(3)
    s = score_df(spark, y, p)
    rows = {r["metric"]: r for r in M.bootstrap(s, n=400, seed=1).collect()}
    draws = []
    for _ in range(400):
        i = rng.integers(0, 300, 300)
        draws.append(auc_by_pairs(y[i], p[i]))
    lo, hi = np.percentile(draws, [2.5, 97.5])
    assert rows["auroc"]["value"] == pytest.approx(auc_by_pairs(y, p))
    assert abs(rows["auroc"]["lo"] - lo) < 0.03 and abs(rows["auroc"]["hi"] - hi) < 0.03
    assert rows["auprc"]["lo"] < rows["auprc"]["value"] < rows["auprc"]["hi"]
    losses = [((p[i] - y[i]) ** 2).mean() for i in (rng.integers(0, 300, 300) for _ in range(400))]
    lo, hi = np.percentile(losses, [2.5, 97.5])
    assert rows["brier"]["value"] == pytest.approx(((p - y) ** 2).mean())
    assert abs(rows["brier"]["lo"] - lo) < 0.01 and abs(rows["brier"]["hi"] - hi) < 0.01
    again = {r["metric"]: r for r in M.bootstrap(s.repartition(3), n=400, seed=1).collect()}
    assert again["auroc"]["lo"] == pytest.approx(rows["auroc"]["lo"]) and again["auprc"]["hi"] == pytest.approx(rows["auprc"]["hi"])


def test_bootstrap_weights_of_one_are_the_plain_metric(spark, monkeypatch):
    """With every resampled count equal to the original, each replicate is the point estimate."""
    rng = np.random.default_rng(8)
    y, p = rng.integers(0, 2, 500), rng.random(500).round(2)
    s = score_df(spark, y, p)

    def same_counts(pdf, n, seed, part):
        pdf = pdf.sort_values("p", ascending=False)
        yield tuple(np.repeat(pdf[c].to_numpy(float)[:, None], n, axis=1) for c in ("pos", "neg"))

    monkeypatch.setattr(M, "_draw", same_counts)
    area, gain = M.roc_auc(s).first()[0], M.average_precision(s).first()[0]
    r = M.bootstrap_samples(s, n=3).agg(F.min("auroc"), F.max("auroc"), F.min("auprc"), F.max("auprc")).first()
    assert list(r) == pytest.approx([area, area, gain, gain])


def test_report(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0.001, 0.999), y)], "p double, y double")
    rows = {(r["section"], r["metric"]): r["value"] for r in M.evaluate(df, n_resamples=50).collect()}
    assert rows["thresholds", "thresholds_from_test"] == 1 and rows["fixed", "threshold"] == 0.5
    assert 0.5 < rows["discrimination", "auroc"] < 1
    assert sum(rows["reliability", f"bin_{i}_observed"] for i in range(10)) > 0


def test_rate_intervals():
    got = M.rate_intervals({"tp": 80, "fn": 20, "fp": 10, "tn": 90}, 4000)
    draws = np.random.default_rng(1).binomial(100, 0.8, 4000) / 100
    assert got["sensitivity"] == pytest.approx(tuple(np.quantile(draws, [0.025, 0.975])), abs=0.02)
    assert got["specificity"][0] < 0.9 < got["specificity"][1] and set(M.rate_intervals({"tp": 0, "fn": 5, "fp": 0, "tn": 5})) == {"sensitivity", "specificity"}


# ---- cleaning, sources and checks ----------------------------------------------------------------------------------


def test_clean_predictions(spark):
    df = spark.createDataFrame([(1, 0.1, False), (2, float("nan"), True), (3, None, True), (4, 0.7, None)], "subject_id long, predicted_boolean_probability double, boolean_value boolean")
    assert [(r["p"], r["y"]) for r in P.clean_predictions(df).collect()] == [(0.1, 0.0)]
    with pytest.raises(ValueError):
        P.clean_predictions(df.drop("boolean_value"))


def test_tables_on_disk(spark, tmp_path):
    root = str(tmp_path)
    io.write_table(spark.range(3).withColumnRenamed("id", "person_id"), f"{root}/person")
    spark.range(2).toPandas().to_parquet(f"{root}/concept.parquet")
    assert io.table_path(spark, root, "person") == f"{root}/person"
    assert io.table_path(spark, root, "concept") == f"{root}/concept.parquet"
    assert io.table_path(spark, root, "visit_occurrence") is None
    checks = {r["check"]: (r["ok"], r["level"]) for r in Q.check_tables(spark, root).collect()}
    assert checks["person present"] == checks["person columns"] == (True, "error") and checks["concept columns"] == (False, "error")
    assert checks["visit_occurrence present"] == (False, "error") and checks["measurement present"] == (False, "warning")


def test_cohort_source(spark, tmp_path):
    path = str(tmp_path / "c")
    io.write_table(spark.createDataFrame([(1, at("2020-01-01"))], "subject_id long, prediction_time timestamp"), path)
    r = io.read_cohort(spark, path, event_names=True).first()
    assert (r["person_id"], r["index_date"], r["label"]) == (1, at("2020-01-01"), 0)


def test_jdbc_options():
    props = {"url": "jdbc:x", "driver": "d"}
    assert io.jdbc_options("person", props) == {**props, "dbtable": "person"}
    assert io.jdbc_options("person", props, "person_id", 77) == {
        **props, "dbtable": "person", "partitionColumn": "person_id", "lowerBound": "1", "upperBound": "77", "numPartitions": "16"}


def test_prediction_checks(spark):
    df = spark.createDataFrame([(1, 1.5, True), (2, 0.2, True)], "subject_id long, predicted_boolean_probability double, boolean_value boolean")
    ok = {r["check"]: r["ok"] for r in Q.check_predictions(df).collect()}
    assert ok == {"predictions not empty": True, "probabilities present": True, "probabilities within 0 and 1": False, "both classes": False}
    assert not Q.check_predictions(df.drop("boolean_value")).first()["ok"]
    assert not Q.check_schema(df).first()["ok"]


def test_age_at_index(spark):
    df = spark.createDataFrame([(at("1980-05-02"), at("2020-05-01")), (at("1980-05-02"), at("2020-05-02")), (None, at("2020-05-02"))], "b timestamp, t timestamp")
    assert [r[0] for r in df.select(timing.age_at(F.col("b"), F.col("t"))).collect()] == [39, 40, -1]
