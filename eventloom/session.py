"""Session settings, and the shared folder in which intermediate tables are written."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join partition even when that costs an extra shuffle later on
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a staged result is in the shared folder: what was shuffled for it goes at once, not when the driver's garbage is collected
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

# Rows of ids, dates and counts are up to fifty times larger in memory than in their files. Planned by file size, tables of hundreds of
# MB are collected by the driver and broadcast; the factor lets only small ones be, the others join by a shuffle or by measured size.
ID_TABLE_FACTOR = "25"
TEXT_TABLE_FACTOR = "1.0"
# Shuffled and read by the planner's 64 and 128 MB, a task over such rows would sort and fold close to a GB of them.
_ID_TABLE_SETTINGS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m", "spark.sql.files.maxPartitionBytes": "32m"}
_BEFORE = "eventloom.before."

_local_roots: dict[str, str] = {}


def configure(spark: SparkSession, file_factor: str = TEXT_TABLE_FACTOR) -> SparkSession:
    """Apply the run-time SQL settings the operators rely on; sizes are left to the cluster.

    ``file_factor`` is the size of rows in memory by that in their files, as the planner takes it.
    """
    for key, value in {**_SQL_SETTINGS, "spark.sql.sources.fileCompressionFactor": file_factor}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in _ID_TABLE_SETTINGS.items():
        before = spark.conf.get(_BEFORE + key, None)  # kept in the session, for the queries over texts that follow
        if file_factor == ID_TABLE_FACTOR and before is None:
            spark.conf.set(_BEFORE + key, spark.conf.get(key))
            spark.conf.set(key, value)
        elif file_factor != ID_TABLE_FACTOR and before is not None:
            spark.conf.set(key, before)
            spark.conf.unset(_BEFORE + key)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("eventloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark, ID_TABLE_FACTOR)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only in local mode, where the driver is the only machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    root = root or _local_roots.get(spark.sparkContext.applicationId)
    if root:
        return root
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
    _local_roots[spark.sparkContext.applicationId] = root
    return root


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result feeds several branches: the branches then scan columnar files instead of
    recomputing the lineage, and the data survives the loss of the executors that produced it.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def session_within(spark: SparkSession, groups: int = 1) -> SparkSession:
    """A session beside ``spark``, with its settings and at least ``groups`` shuffle partitions, for work that stays within persons.

    Its joins take rows that are dealt out by a part of the join's keys as they are. Elsewhere they do not: a hot key would stay in one task.
    """
    beside = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            beside.conf.set(key, value)
    beside.conf.set("spark.sql.shuffle.partitions", str(max(parts(spark), groups)))
    beside.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return beside


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stage_by(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """As :func:`stage`, in buckets of ``keys``, one for each of :func:`parts`: joins and groups by them do not shuffle these rows again.

    ``df`` comes dealt out by ``keys``, since a task writes a file for each bucket of which it has rows.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").option("path", path).bucketBy(parts(spark), *keys).saveAsTable(name)
    staged = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # a name only: the files of a table with a path stay, and the frame knows them
    return staged


def stage_within(df: DataFrame, key: str, label: str) -> DataFrame:
    """As :func:`stage_by` with one key, for frames that meet in unions: those keep the rows dealt out by a name given after reading.

    A name from the files is lost to them as soon as a join asks for rows with a key.
    """
    named = f"__{key}"
    return stage_by(df.withColumnRenamed(key, named), [named], label).withColumnRenamed(named, key)
