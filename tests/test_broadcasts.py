"""Tables of ids are small on disk and large in memory: the driver must not collect them for a broadcast."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from eventloom.session import ID_TABLE_FACTOR, TEXT_TABLE_FACTOR, stage


def _planned(spark, rows):
    people = stage(spark.range(rows).select(F.col("id").alias("person_id"), F.lit(7).alias("n")), "people")
    events = stage(spark.range(rows * 2).select((F.col("id") % rows).alias("person_id"), "id"), "events")
    return events.join(people, "person_id")._jdf.queryExecution().executedPlan().toString()


def test_staged_ids_are_not_broadcast_by_file_size(spark):
    entry.queries()["p1_nonempty"](spark, entry.ENTRY_DIR)  # sets the session up
    assert spark.conf.get("spark.sql.sources.fileCompressionFactor") == ID_TABLE_FACTOR
    assert "BroadcastExchange" not in _planned(spark, 1_000_000)  # tens of MB as rows, 4 in the file
    assert "BroadcastExchange" in _planned(spark, 1_000)


def test_text_queries_keep_their_estimates(spark):
    entry.queries()["op12_merkle_manifest"](spark, entry.ENTRY_DIR)
    assert spark.conf.get("spark.sql.sources.fileCompressionFactor") == TEXT_TABLE_FACTOR
    entry.queries()["p1_nonempty"](spark, entry.ENTRY_DIR)
