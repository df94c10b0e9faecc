"""Memory of a task over tables of ids does not grow with the tables."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from eventloom.functions import scan
from eventloom.operators import sequence as S
from eventloom.plans import sequences


def test_tasks_over_ids_are_small_and_those_over_texts_as_set(spark):
    keys = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    entry.queries()["op12_merkle_manifest"](spark, entry.ENTRY_DIR)
    before = [spark.conf.get(k) for k in keys]
    for _ in range(2):
        entry.queries()["e6_attach_days"](spark, entry.ENTRY_DIR)
        assert [spark.conf.get(k) for k in keys] == ["8m", "32m"]
    entry.queries()["op12_merkle_manifest"](spark, entry.ENTRY_DIR)
    assert [spark.conf.get(k) for k in keys] == before
    entry.queries()["p1_nonempty"](spark, entry.ENTRY_DIR)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_people_of_concepts_are_dealt_out_before_they_are_folded(spark, monkeypatch):
    monkeypatch.setattr(scan, "FOLD_AT_ONCE", 10)
    rows = [(None if i % 10 == 9 else i % 5, c) for i in range(100) for c in (("a", None) if i < 90 else ("b",))]
    out = S.qualified_concepts(spark.createDataFrame(rows, "person_id long, code string"), 4)
    assert re.search(r"hashpartitioning\(code#\d+, person_id#\d+L, 19\)", _plan(out))
    assert {(r.code, r.n_people) for r in out.collect()} == {("a", 5), (None, 5), ("b", 5)}


def test_domain_records_are_dealt_out_before_they_are_folded(spark, monkeypatch):
    monkeypatch.setattr(scan, "FOLD_AT_ONCE", 1000)
    rows = 3 * spark.read.parquet(f"{entry.ENTRY_DIR}/lineitem.parquet").count() + spark.read.parquet(f"{entry.ENTRY_DIR}/orders.parquet").count()
    out = sequences.domain_events(spark, entry.ENTRY_DIR)
    assert re.search(rf"hashpartitioning\(person_id#.*, {-(-rows // 1000)}\)", _plan(out))
    assert out.agg(F.sum("n")).first()[0] <= rows
