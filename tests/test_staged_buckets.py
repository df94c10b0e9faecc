"""Rows staged by a key are not shuffled by it again; the length of sequences is known without reading events."""

import __spark_entry__ as entry
from eventloom.functions import scan
from eventloom.operators import sequence as S
from eventloom.operators import visits as V
from eventloom.plans import sequences
from eventloom.session import stage_by

KEYS = ["a", "b"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_staged_by_a_key_stay_where_they_are(spark):
    rows = spark.range(1000).selectExpr("if(id % 9 = 0, null, id % 7) AS a", "id % 3 AS b", "id")
    staged = stage_by(rows.repartition(4, *KEYS), KEYS, "dealt")
    counts = staged.groupBy(*KEYS).count()
    assert "Exchange" not in _plan(counts)
    assert sorted(map(tuple, counts.collect()), key=str) == sorted(map(tuple, rows.groupBy(*KEYS).count().collect()), key=str)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("dealt")]
    assert staged.count() == 1000


def test_events_of_a_sequence_are_counted_and_placed_where_they_are(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(S, "largest_group", lambda df, by: plans.append((by, _plan(df.groupBy(*by).count()))) or 1000)
    entry.queries()["q12_sequence_plain"](spark, entry.ENTRY_DIR)
    (plan,) = [p for by, p in plans if by == S.VISIT_KEY]
    assert "Exchange" not in plan


def test_times_are_rebuilt_without_counting_tokens(spark, monkeypatch):
    def counted(df, by):
        assert "token" not in df.columns
        return 1

    seq = sequences.full_sequence(spark, entry.ENTRY_DIR)
    assert S.longest(seq) == scan.largest_group(seq, ["person_id"]) > 0
    monkeypatch.setattr(scan, "largest_group", counted)
    assert entry.queries()["q15_rebuild_times"](spark, entry.ENTRY_DIR).count() == seq.count()


def test_events_are_classified_where_they_are(spark, monkeypatch):
    plans = []
    classify = V.classify_blocks
    monkeypatch.setattr(V, "classify_blocks", lambda events, rules: plans.append(_plan(classify(events, rules))) or classify(events, rules))
    entry.queries()["e18_linked_patients"](spark, entry.ENTRY_DIR)
    assert len(plans) == 2 and not [p for p in plans if "Exchange" in p]
