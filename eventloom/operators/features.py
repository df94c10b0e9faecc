"""Features from sequences and vectors, and the simple models trained on them."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEARCH_THREADS = 4


def mean_pool(vectors: DataFrame, by: Sequence[str], vector: str = "vector") -> DataFrame:
    """Mean vector per group, as rows ``(by, dim, mean)``; whole vectors are summed, on the map side first. Nulls are left out."""
    vectors = vectors.filter(F.col(vector).isNotNull())
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return vectors.groupBy(*by).agg(mean.alias("__m")).select(*by, F.posexplode(vector_to_array("__m")).alias("dim", "mean"))


def to_vectors(pooled: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows ``(by, dim, mean)`` as one array per group; its length is the number of dimensions."""
    cells = F.array_sort(F.collect_list(F.struct("dim", "mean")))
    return pooled.groupBy(*by).agg(F.transform(cells, lambda c: c["mean"]).alias("vector"))


def pool_packed(packs: DataFrame, ranges: DataFrame, key: str = "person_id") -> DataFrame:
    """``shard, pack, sample, key, vector``: the mean vector of each member of each pack.

    ``packs`` has a row per pack with ``vectors``, those of its positions from 1 on; ``ranges`` are those of
    :func:`batches.sample_ranges`. The ranges of a pack meet its array once and are reduced inside it, so no vector is copied; both are bounded by
    the budget of a pack. Null vectors are left out, and a member without any has an empty vector; positions past the end of the array
    are not there.
    """
    members = F.collect_list(F.struct("sample", key, "from_pos", "to_pos")).alias("__members")
    both = packs.join(ranges.groupBy("shard", "pack").agg(members), ["shard", "pack"])

    def mean(member: Column) -> Column:
        first, last = member["from_pos"].cast("int"), F.least(member["to_pos"].cast("int"), F.size("vectors"))
        own = F.filter(F.slice("vectors", first, F.greatest(last - first + 1, F.lit(0))), lambda v: v.isNotNull())
        add = lambda total, v: F.when(F.size(total) == 0, v).otherwise(F.zip_with(total, v, lambda x, y: x + y))
        total = F.aggregate(F.transform(own, lambda v: v.cast("array<double>")), F.array().cast("array<double>"), add)
        return F.transform(total, lambda x: x / F.size(own))

    pooled = F.transform("__members", lambda m: F.struct(m["sample"].alias("sample"), m[key].alias(key), mean(m).alias("vector")))
    return both.select("shard", "pack", F.inline(pooled))


def mean_over_sequence(vectors: DataFrame, by: Sequence[str], mask: Column, vector: str = "vector") -> DataFrame:
    """Mean vector over the valid positions only."""
    return mean_pool(vectors.filter(mask), by, vector)


def first_vector(vectors: DataFrame, token: str = "[CLS]") -> DataFrame:
    """Vectors of the leading token."""
    return vectors.filter(F.col("token") == token)


def concept_frequencies(seq: DataFrame) -> DataFrame:
    """``person_id, token, n, weight``: counts scaled to length 1 per person."""
    counts = seq.groupBy("person_id", "token").agg(F.count(F.lit(1)).alias("n"))
    norms = counts.groupBy("person_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("__norm"))
    return counts.join(norms, "person_id").withColumn("weight", F.col("n") / F.col("__norm")).drop("__norm")


def scale(df: DataFrame, column: str, out: str) -> DataFrame:
    """Standardised copy of a numeric column (population deviation; 0 where that is 0)."""
    mean, std = df.agg(F.avg(column), F.stddev_pop(column)).first()
    value = (F.col(column) - F.lit(mean)) / F.lit(std) if std else F.lit(0.0)
    return df.withColumn(out, value)


def assemble(df: DataFrame, vector: str, others: Sequence[str] = ()) -> DataFrame:
    """``features``: an array column and single numbers as one ML vector."""
    out = df.withColumn("__v", array_to_vector(F.col(vector)))
    return VectorAssembler(inputCols=["__v", *others], outputCol="features").transform(out).drop("__v")


def fit_logistic(
    df: DataFrame, c_values: Sequence[float], penalties: Sequence[float] = (0.0, 1.0), folds: int = 5, seed: int = 42
):
    """Cross-validated logistic regression over ``features, label``; ``penalties`` 0 is L2 and 1 is L1.

    The grid is searched in four threads, each with local properties of its own: those of a parallel ``CrossValidator`` share one set, and
    where one of them clears the id of its execution another fails on reading it. All draw the same folds from ``seed``.
    """
    n = df.count()
    model = LogisticRegression(featuresCol="features", labelCol="label", maxIter=50)
    grid = (
        ParamGridBuilder()
        .addGrid(model.regParam, [1.0 / (c * n) for c in c_values])
        .addGrid(model.elasticNetParam, list(penalties))
        .build()
    )
    parts = [grid[i::SEARCH_THREADS] for i in range(min(SEARCH_THREADS, len(grid)))]

    def search(part):
        return CrossValidator(
            estimator=model,
            estimatorParamMaps=part,
            evaluator=BinaryClassificationEvaluator(labelCol="label"),
            numFolds=folds,
            seed=seed,
            parallelism=1,
        ).fit(df)

    runs = [inheritable_thread_target(df.sparkSession)(search) for _ in parts]
    with ThreadPool(len(parts)) as pool:
        found = pool.starmap(lambda run, part: run(part), zip(runs, parts), chunksize=1)
    # the first of the best in the order of the grid
    order = [(-max(f.avgMetrics), f.avgMetrics.index(max(f.avgMetrics)) * len(parts) + i) for i, f in enumerate(found)]
    return found[order.index(min(order))].bestModel


def fit_gbt(df: DataFrame, rounds: int = 20, seed: int = 42):
    return GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, seed=seed).fit(df)


def predict(model, df: DataFrame, key: str) -> DataFrame:
    """``key, y, p`` from a fitted classifier."""
    return model.transform(df).select(
        key, F.col("label").cast("double").alias("y"), vector_to_array("probability")[1].alias("p")
    )


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def modes(df: DataFrame, column: str) -> DataFrame:
    """All most frequent values."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n").alias("n"))
    return counts.join(top, "n").select(column, "n")


def enrich(df: DataFrame, lookup_table: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left lookup of columns by keys; 0 where there is no match."""
    out = df.join(lookup_table.select(*keys, *columns), list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns})
