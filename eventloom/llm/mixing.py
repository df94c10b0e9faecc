"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source gets a target number of words. Words are allocated in equal blocks: seats go to the highest quotients
``target / (2 · seats + 1)``, first among sources, then among the shards of a source by their sizes, so that every shard has
a whole number of blocks to give. Inside a shard the documents are laid end to end in a seeded order, the run of words is
divided into equal blocks, and the quota is met by whole passes over all blocks plus a seeded choice of single blocks.

Shards hold a bounded number of words and of rows, so a source with most of the corpus is many tasks. Only sums of a source
(one row each) reach the driver, and only sums of shards meet in the task that apportions a source.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .common import read, word_count

WEIGHTS = (1.0, 2.0, 3.0)
RESULTS = ["size", "source_size", "target", "taken"]


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients ``votes / (2s + 1)``, none above ``most``; ties go to the earlier entry."""
    votes, most = np.asarray(votes, float), np.asarray(most, np.int64)
    seats = int(min(seats, most[votes > 0].sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)

    def given(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(votes / divisor + 0.5), most).astype(np.int64)

    low, high = 0.0, 2.0 * votes.max() + 1.0  # nobody gets a seat at ``high``; at ``low`` everybody is full
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if given(middle).sum() > seats else (low, middle)
    out = given(high * (1 + 1e-9))  # ties are left to the queue
    queue = [(-votes[i] / (2 * out[i] + 1), i) for i in np.flatnonzero((out < most) & (votes > 0))]
    heapq.heapify(queue)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(queue)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(queue, (-votes[i] / (2 * out[i] + 1), i))
    return out


def water_fill(sizes: np.ndarray, weights: np.ndarray, repeats: float) -> np.ndarray:
    """Shares of all words by weight; what lies above ``repeats`` times a size is reshared until nothing does."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    target, full = np.zeros(len(sizes)), np.zeros(len(sizes), bool)
    while not full.all():
        left = sizes.sum() - (repeats * sizes[full]).sum()
        target[~full] = left * weights[~full] / weights[~full].sum()
        above = ~full & (target > repeats * sizes)
        if not above.any():
            break
        full |= above
        target[full] = repeats * sizes[full]
    return target


def blocks_of(words: np.ndarray | int, block: int) -> np.ndarray:
    """Equal blocks that a run of words is divided into: about ``block`` words each."""
    words = np.asarray(words, np.int64)
    return np.where(words > 0, np.maximum(1, (2 * words + block) // (2 * block)), 0)


def take_blocks(sizes: np.ndarray, quota: int, block: int, seed: int) -> np.ndarray:
    """Words taken of each document, laid end to end in the given order, when ``quota`` blocks are taken."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    n = int(blocks_of(total, block))
    if not n:
        return np.zeros(len(sizes), np.int64)
    passes, rest = divmod(int(quota), n)
    bounds = np.arange(n + 1, dtype=np.int64) * total // n
    chosen = np.zeros(n, bool)
    chosen[np.random.default_rng(seed).permutation(n)[:rest]] = True
    before = np.concatenate(([0], np.cumsum(np.diff(bounds) * chosen)))

    def words_before(at: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(bounds, at, side="right") - 1, n - 1)
        return before[k] + np.where(chosen[k], at - bounds[k], 0)

    return passes * sizes + words_before(ends) - words_before(ends - sizes)


def mix_sources(
    docs: DataFrame,
    *,
    source: str = "source",
    doc_id: str = "doc_id",
    size: str | None = None,
    content: str | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    repeats: int = 3,
    block: int = 32,
    shard_words: int = 2_500_000,
    shard_rows: int = 5_000,
    seed: int = 17,
) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target`` (its source's) and ``taken``, all in words.

    Sources in code-point order, null last, weigh ``weights`` in turn. A null or empty text has size 0 and gives nothing; a
    source without words has target 0. Repeated rows are documents of their own. No document gives more than ``repeats``
    times its size. ``size`` names a column that already holds sizes; else words of ``text`` are counted. ``content`` names a column that
    tells rows of one id, or without, apart: a hash of the text, or ``text`` itself, which is taken if there is one. Input columns named
    like the results are replaced. Reruns agree, whatever the order of the rows: order and choice depend on ids, contents, sizes and
    ``seed`` only.
    """
    spark = docs.sparkSession
    sized = docs.withColumn("size", F.col(size) if size else word_count(F.col("text")))
    sized = sized.drop(*[c for c in RESULTS if c != "size"])
    known = sized.groupBy(source).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")).collect()
    known.sort(key=lambda r: (r[0] is None, r[0] or ""))
    words = np.array([r["words"] for r in known], np.int64)
    target = water_fill(words, np.resize(weights, len(known)), repeats)
    quota = sainte_lague(target, round(words.sum() / block), repeats * np.maximum(blocks_of(words, block), 1) * (words > 0))
    shards = [max(1, -(-int(r["words"]) // shard_words), -(-r["rows"] // shard_rows)) for r in known]
    table = spark.createDataFrame(
        [(r[0], int(r["words"]), float(t), int(q), s) for r, t, q, s in zip(known, target, quota, shards)],
        T.StructType(
            [T.StructField("__source", docs.schema[source].dataType), T.StructField("source_size", T.LongType())]
            + [T.StructField("target", T.DoubleType()), T.StructField("__quota", T.LongType()), T.StructField("__shards", T.LongType())]
        ),
    )
    content = content or ("text" if "text" in docs.columns else None)
    draw = F.xxhash64(F.lit(seed), F.col(doc_id), *([F.col(content)] if content else []))
    placed = sized.join(table, F.col(source).eqNullSafe(F.col("__source")), "left").drop("__source")
    placed = placed.withColumn("__draw", draw).withColumn("__shard", F.pmod(F.shiftright(draw, 8), F.col("__shards")))

    def apportion(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__shard", ignore_index=True)
        sizes = rows["__words"].to_numpy()
        most = repeats * blocks_of(sizes, block)
        return rows.assign(__take=sainte_lague(sizes, int(rows["__quota"].iloc[0]), most))[["__from", "__shard", "__take"]]

    kind = docs.schema[source].dataType.simpleString()
    per_shard = (
        placed.groupBy(F.col(source).alias("__from"), "__shard", "__quota")
        .agg(F.sum("size").alias("__words"))
        .groupBy("__from")
        .applyInPandas(apportion, f"__from {kind}, __shard long, __take long")
        .withColumnRenamed("__shard", "__part")
    )
    joined = placed.join(
        per_shard, F.col(source).eqNullSafe(F.col("__from")) & (F.col("__shard") == F.col("__part")), "left"
    ).drop("__from", "__part")
    out_schema = T.StructType([*sized.schema, *table.schema.fields[1:3], T.StructField("taken", T.LongType())])
    names = [f.name for f in out_schema]

    def select(table: pa.Table) -> pa.Table:
        sizes = table.column("size").to_numpy().astype(np.int64)
        draws = table.column("__draw").to_numpy()
        order = np.lexsort((sizes, draws))
        shard, quota = table.column("__shard")[0].as_py(), table.column("__take")[0].as_py()
        taken = np.empty(len(sizes), np.int64)
        taken[order] = take_blocks(sizes[order], quota, block, [seed, shard, int(sizes.sum())])
        return table.append_column("taken", pa.array(taken)).select(names)

    return joined.groupBy(source, "__shard").applyInArrow(select, out_schema)


def op6_source_mix(spark, sf_dir):
    sizes = read(spark, sf_dir, "documents").select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")
    )
    sizes = stage(sizes, "mix-sizes")  # ids, counts and hashes only: texts are read once
    return mix_sources(sizes, size="size", content="text_hash").select("doc_id", *RESULTS)


QUERIES = {"op6_source_mix": (op6_source_mix, None)}
