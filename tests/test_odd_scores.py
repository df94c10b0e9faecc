"""Curves over scores and labels that are missing, NaN or infinite, against the SQL of the curve."""

import datetime as dt

import duckdb
import pytest

from eventloom.functions import scan
from eventloom.plans import model_queries as Q


def row(i):
    price = [None, float("nan"), -0.0, 0.0, float("inf"), float("-inf"), -5.0][i % 13] if i % 13 < 7 else 1000.0 + i % 60 / 4
    priority = None if i % 5 == 0 or price == 1000.0 + 59 / 4 else ["1-URGENT", "2-HIGH"][i % 3 == 0]
    return (i, i, "O", price, dt.datetime(1997, 1, 1), priority)


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("labelled", [False, True])
def test_odd_scores_and_labels_as_in_sql(spark, tmp_path, monkeypatch, labelled, split):
    if split:
        monkeypatch.setattr(scan, "SPLIT_ABOVE", -1)
    rows = [row(i) for i in range(400)]
    if not labelled:  # the highest score, NaN, has no label
        rows = [(*r[:5], None) if r[3] is not None and r[3] != r[3] else r for r in rows]
    path = f"{tmp_path}/orders.parquet"
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(path)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}/*.parquet'")
    run, sql = Q.QUERIES["a5_roc_points"]
    plain = lambda r: tuple(None if v is None else repr(v + 0.0) if isinstance(v, float) else v for v in r)
    got, want = [plain(r) for r in run(spark, str(tmp_path)).collect()], [plain(r) for r in duck.execute(sql).fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
