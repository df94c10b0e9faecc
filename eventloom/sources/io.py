"""Reading and writing tables: parquet (batch and stream), event and cohort sources, JDBC import, artifacts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("subject_id", T.LongType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("code", T.StringType()),
        T.StructField("text_value", T.StringType()),
        T.StructField("numeric_value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("visit_id", T.LongType()),
        T.StructField("table", T.StringType()),
        T.StructField("end", T.TimestampType()),
    ]
)

VOCAB_SCHEMA = "token string, id int, n long"
STATS_SCHEMA = (
    "concept_id string, unit string, mean double, std double, count long, "
    "value_outlier_std double, lower_bound double, upper_bound double"
)

SPREAD_BYTES = 2_000_000

# The primary key that partitions each relational table on import.
TABLE_KEYS = {
    "person": "person_id",
    "visit_occurrence": "visit_occurrence_id",
    "condition_occurrence": "condition_occurrence_id",
    "procedure_occurrence": "procedure_occurrence_id",
    "drug_exposure": "drug_exposure_id",
    "measurement": "measurement_id",
    "observation": "observation_id",
    "device_exposure": "device_exposure_id",
}

# Column names of event-standard cohorts and ours.
COHORT_NAMES = {"prediction_time": "index_date", "subject_id": "person_id", "boolean_value": "label"}


def read_table(spark: SparkSession, path: str, streaming: bool = False, schema=None) -> DataFrame:
    """Parquet file or folder, as a batch or as a stream of files. A stream needs a schema."""
    if not streaming:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    if schema is None:
        schema = spark.read.parquet(path).schema  # footer only
    reader = spark.readStream.schema(schema)
    if path.endswith(".parquet"):  # a stream watches a folder; one file is picked out of it by name
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _file_status(spark: SparkSession, pattern: str) -> list:
    """Files and folders that match, by the file system Spark itself uses."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return list(found) if found is not None else []


def _row_groups(spark: SparkSession, file) -> int:
    """Row groups of a parquet file, from its footer."""
    parquet = spark.sparkContext._jvm.org.apache.parquet.hadoop
    reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromStatus(file, spark.sparkContext._jsc.hadoopConfiguration()))
    try:
        return reader.getRowGroups().size()
    finally:
        reader.close()


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table; one large file of fewer row groups than cores is dealt out to all cores.

    A row group is read by one task, and all work up to the next shuffle would stay in the tasks that have one. Tables of many files
    or row groups are already spread and are left alone: dealing them out would shuffle the whole table.
    """
    df = read_table(spark, path)
    files = _file_status(spark, path)
    if len(files) == 1 and files[0].isFile() and files[0].getLen() >= SPREAD_BYTES:
        cores = spark.sparkContext.defaultParallelism
        return df.repartition(cores) if _row_groups(spark, files[0]) < cores else df
    return df


def table_path(spark: SparkSession, root: str, table: str) -> str | None:
    """``root/table/`` when that folder holds parquet, else ``root/table.parquet``, else None.

    Asks the file system Spark itself uses, so it works on any storage.
    """
    for pattern, found in ((f"{root}/{table}/*.parquet", f"{root}/{table}"), (f"{root}/{table}.parquet",) * 2):
        if _file_status(spark, pattern):
            return found
    return None


def read_events(spark: SparkSession, path: str, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Flat events in the columns of ``EVENT_SCHEMA``; ``mapping`` gives a SQL expression per model column."""
    df = read_table(spark, path)
    mapping = dict(mapping or {})
    cols = []
    for field in EVENT_SCHEMA:
        if field.name in mapping:
            col = F.expr(mapping[field.name])
        elif field.name in df.columns:
            col = F.col(f"`{field.name}`")
        else:
            col = F.lit(None)
        cols.append(col.cast(field.dataType).alias(field.name))
    return df.select(*cols)


def read_cohort(spark: SparkSession, path: str, event_names: bool = False) -> DataFrame:
    """``person_id, index_date, label``; a missing label column counts as 0."""
    return cohort_columns(read_table(spark, path), event_names)


def cohort_columns(df: DataFrame, event_names: bool = False) -> DataFrame:
    if event_names:
        df = df.withColumnsRenamed(COHORT_NAMES)
    label = F.col("label").cast("int") if "label" in df.columns else F.lit(0)
    return df.withColumn("label", label)


def jdbc_options(
    table: str, props: Mapping[str, str], key: str | None = None, upper: int | None = None, partitions: int = 16
) -> dict[str, str]:
    options = {**props, "dbtable": table}
    if key is not None:
        options.update(partitionColumn=key, lowerBound="1", upperBound=str(upper), numPartitions=str(partitions))
    return options


def import_jdbc(
    spark: SparkSession, table: str, props: Mapping[str, str], key: str | None = None, partitions: int = 16
) -> DataFrame:
    """One table over JDBC; with ``key`` it is read by ``partitions`` connections over equal key ranges."""
    upper = None
    if key is not None:
        query = jdbc_options(f"(SELECT MAX({key}) AS max_key FROM {table}) t", props)
        upper = spark.read.format("jdbc").options(**query).load().first()[0]
        if upper is None:
            key = None
    return spark.read.format("jdbc").options(**jdbc_options(table, props, key, upper, partitions)).load()


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet sink. ``append`` adds shards to an existing folder."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def replace_shards(df: DataFrame, path: str, shard: str) -> None:
    """Writes the shards that ``df`` holds in place of those of the same name; other shards stay. Doing it twice does it once.

    Rows are dealt by shard and key order is left as it is; a null shard is a shard.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(shard).parquet(path)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str) -> DataFrame:
    """A table at ``path`` in ``buckets`` files' worth of hash buckets of ``key``, each sorted by it.

    Tables with equal numbers of buckets join on the key without a shuffle. An old table of the name is replaced.
    """
    dealt = df.repartition(buckets, key)  # one file a bucket
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def save_artifacts(vocab: DataFrame, stats: DataFrame, path: str) -> None:
    write_table(vocab, f"{path}/vocabulary")
    write_table(stats, f"{path}/value_statistics")


def load_artifacts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (
        read_table(spark, f"{path}/vocabulary", schema=VOCAB_SCHEMA),
        read_table(spark, f"{path}/value_statistics", schema=STATS_SCHEMA),
    )
