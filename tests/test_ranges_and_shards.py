"""Sorting over several rows of a person, index dates as ranges of places, shards written again, and joins of bucketed tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import cohort as C
from eventloom.operators import sequence as S
from eventloom.plans import source_queries as Q
from eventloom.session import new_folder
from eventloom.sources import io

from .conftest import DATA


def test_a_long_person_is_sorted_as_one(spark):
    rng = np.random.default_rng(2)
    rows = [(1, i + 1, float(rng.integers(-5000, 5000)) / 4, int(rng.integers(0, 50)), i) for i in range(20_000)]
    rows += [(2, 1, None, 3, 0), (2, 2, 1.0, None, 1), (2, 3, 1.0, 2, 2), (3, 1, 0.0, 1, 0)]
    seq = spark.createDataFrame(rows, "person_id long, pos long, dates double, concept_ids long, v long")
    arrays = S.to_arrays(seq, ["dates", "concept_ids", "v"])
    assert {(r.person_id, r.part) for r in arrays.collect()} == {(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)}
    key = lambda r: tuple((x is not None, x or 0) for x in (r[2], r[3], r[4]))
    got = {}
    for r in S.sort_sequences(arrays, ["concept_ids", "v"], "dates").orderBy("person_id", "part").collect():
        assert len(r.concept_ids) <= 8192 and r.num_of_concepts == {1: 20_000, 2: 3, 3: 1}[r.person_id]
        got.setdefault(r.person_id, []).extend(zip(r.concept_ids, r.v))
    for person in (1, 2, 3):
        want = sorted((r for r in rows if r[0] == person), key=key)
        assert got[person] == [(r[3], r[4]) for r in want]


def test_one_row_is_sorted_alike(spark):
    rows = [(p, i + 1, int(d), int(t), i) for p in (1, 2) for i, (d, t) in enumerate(np.random.default_rng(p).integers(0, 9, (30, 2)))]
    arrays = S.to_arrays(spark.createDataFrame(rows, "person_id long, pos long, dates long, concept_ids long, v long"), ["dates", "concept_ids", "v"])
    one = {r.person_id: (r.concept_ids, r.v) for r in S.sort_sequence(arrays, ["concept_ids", "v"], "dates").collect()}
    assert one == {r.person_id: (r.concept_ids, r.v) for r in S.sort_sequences(arrays, ["concept_ids", "v"], "dates").collect()}


@pytest.mark.parametrize("window", [None, 2])
def test_ranges_cut_what_the_filter_cuts(spark, window, split_everything):
    rng = np.random.default_rng(5)
    tokens = [(int(p), i + 1, f"t{i}", float(rng.integers(0, 40)) * 21_600) for p in range(4) for i in range(60)]
    tokens += [(9, 1, "t", -86_400.0)]  # before 1970
    dates = [(int(p), f"1970-01-{d:02d} 06:00:00", int(d % 2)) for p in (0, 1, 2, 9, 77) for d in (1, 3, 4, 9)] + [(0, "1970-01-03 06:00:00", 1)]
    seq = spark.createDataFrame(tokens, "person_id long, pos long, token string, epoch double")
    cohort = spark.createDataFrame(dates, "person_id long, index_date string, label int").withColumn("index_date", F.to_timestamp("index_date"))
    ranges = C.index_ranges(seq, cohort, window)
    assert ranges.count() == cohort.distinct().count()
    columns = ["person_id", "pos", "token", "index_date", "label"]
    want = C.cut_at_index(seq, cohort.distinct(), window).select(columns)
    got = C.copy_ranges(C.time_ranks(seq), ranges).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 50


def test_shards_are_replaced_once(spark):
    path = new_folder(spark, "shards")
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "shard string, v int")
    for df in (first, first.filter("shard = 'a'"), first.filter("shard = 'a'"), spark.createDataFrame([("b", 9), (None, 8)], "shard string, v int")):
        io.replace_shards(df, path, "shard")
    assert sorted((str(r.shard), r.v) for r in spark.read.parquet(path).collect()) == [("None", 8), ("a", 1), ("a", 2), ("b", 9)]


def test_bucketed_tables_join_without_a_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        people, orders = Q.bucketed(spark, DATA)
        joined = people.join(orders, people["c_custkey"] == orders["o_custkey"], "left").groupBy("c_custkey", "c_mktsegment").count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == people.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
