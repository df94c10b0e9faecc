"""What is shuffled for a staged result does not stay on disk."""

import glob
import time

import __spark_entry__ as entry
from eventloom.session import stage


def _shuffled():
    return set(glob.glob("/tmp/blockmgr-*/*/shuffle_*.data"))


def test_shuffle_files_go_with_the_write(spark):
    entry.queries()["op12_merkle_manifest"](spark, entry.ENTRY_DIR)  # sets the session up
    before = _shuffled()
    staged = stage(spark.range(200_000).repartition(3, "id"), "dealt")
    until = time.time() + 10
    while _shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not _shuffled() - before
    assert staged.count() == 200_000
    again = spark.range(1000).repartition(3, "id")  # a frame that is run twice is shuffled again
    assert len(again.collect()) == len(again.collect()) == 1000
