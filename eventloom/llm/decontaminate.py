"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item inside a long document has a Jaccard similarity near zero, so signatures of whole documents cannot find it. Here
items are partitioned by size (powers of two of their shingle counts), and each has a bottom-k MinHash sketch: its k
smallest shingle hashes, a uniform sample of the item, of size min(k, all). An item's containment in a document is estimated
by the share of its sketch that the document holds. A document's own sketch depends on the partition it is searched for: all
its shingle hashes up to the partition's ceiling, the largest hash in a sketch of that partition, so partitions of larger
items need sparser sketches, and documents too small to hold the smallest item of a partition are not searched for it.
Any sketch hit makes a candidate: an item contained to 0.8 misses all of k = 8 with probability 0.2^8 = 2.6e-6 (k is raised for
lower thresholds). Candidates are verified on the shingles themselves.

Only DataFrame expressions run on this path.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, read, words_of

SHINGLE = 5
#: Sketch rows up to this number (16 bytes each) are broadcast; above it the join shuffles.
BROADCAST_SKETCH_ROWS = 500_000
MISS = 1e-5


def shingles(words: Column, n: int = SHINGLE) -> Column:
    """Distinct runs of ``n`` words; a shorter text is one shingle of all its words, an empty one has none."""
    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
        all_runs = F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) > 0, F.array_distinct(all_runs)).otherwise(F.array().cast("array<string>"))

    return let(words, runs)


def shingle_hashes(words: Column, n: int = SHINGLE) -> Column:
    """Hashes of the runs of ``n`` words, repeats included; equal for equal shingles."""
    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
        all_runs = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) > 0, all_runs).otherwise(F.array().cast("array<long>"))

    return let(words, hashes)


def sketch_size(threshold: float, miss: float = MISS) -> int:
    """Sketch elements of which an item contained to ``threshold`` misses all with probability ``miss`` at most."""
    return 1 if threshold >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - threshold)))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    threshold: float = 0.8,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    item_text: str = "text",
) -> DataFrame:
    """Rows (doc_id, item_id, n_shingles, n_shared, containment) where at least ``threshold`` of an item's shingles are in a document.

    Words are split at blanks, A-Z in lower case. Null, empty and blank texts and items match nothing; an item shorter than a
    shingle is one shingle and matches only a document of just these words. Repeated ids give one row with the largest
    containment; a null id is an id. Other columns are not read.
    """
    k = sketch_size(threshold)
    items = items.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("item_shingles", shingles(F.col("words"))).withColumn("n_shingles", F.size("item_shingles").cast("long"))
    sketch = items.select(
        "item_id",
        F.floor(F.log2("n_shingles")).cast("int").alias("part"),
        "n_shingles",
        F.slice(F.array_sort(F.array_distinct(shingle_hashes(F.col("words")))), 1, k).alias("sketch"),
    )
    parts = sketch.groupBy("part").agg(
        F.max(F.element_at("sketch", -1)).alias("ceiling"), F.min("n_shingles").alias("least"), F.sum(F.size("sketch")).alias("rows")
    )
    parts = parts.collect()  # a row for each power of two
    if not parts:
        return docs.sparkSession.createDataFrame([], _result_schema(docs, doc_id, items))

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    hashed = texts.select("doc_id", shingle_hashes(words_of(F.col("text"))).alias("hashes"))
    # the widest ceiling among the partitions that a document of this size is searched for
    need = [(math.ceil(threshold * p["least"] - 1e-9), p["ceiling"]) for p in parts]
    ceiling = F.greatest(F.lit(None).cast("long"), *[F.when(F.size("hashes") >= n, F.lit(c)) for n, c in need])
    hashed = hashed.withColumn("ceiling", ceiling).filter("ceiling IS NOT NULL")
    probes = hashed.select("doc_id", F.explode(F.filter("hashes", lambda h: h <= F.col("ceiling"))).alias("hash"))
    entries = sketch.select("item_id", F.explode("sketch").alias("hash"))
    if sum(p["rows"] for p in parts) <= BROADCAST_SKETCH_ROWS:
        entries = F.broadcast(entries)
    candidates = probes.join(entries, "hash").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("hits"))

    # verification: the items of a document together, so that its shingles are made once
    by_doc = candidates.groupBy("doc_id").agg(F.collect_set(F.struct("item_id")).alias("found"))
    by_doc = by_doc.withColumnRenamed("doc_id", "__id").hint("shuffle_hash")
    held = texts.join(by_doc, F.col("doc_id").eqNullSafe(F.col("__id"))).select(
        "doc_id", "found", shingles(words_of(F.col("text"))).alias("doc_shingles")
    )
    pairs = held.select("doc_id", "doc_shingles", F.explode("found.item_id").alias("item_id"))
    sets = items.select(F.col("item_id").alias("__item"), "item_shingles", "n_shingles")
    shared = pairs.join(sets, F.col("item_id").eqNullSafe(F.col("__item"))).select(
        "doc_id",
        "item_id",
        "n_shingles",
        F.size(F.array_intersect("item_shingles", "doc_shingles")).cast("long").alias("n_shared"),
    )
    shared = shared.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(F.col("containment") >= threshold)
    best = F.max(F.struct("containment", "n_shared", "n_shingles")).alias("best")
    return shared.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_shingles", "best.n_shared", "best.containment")


def _result_schema(docs, doc_id, items):
    kind = docs.schema[doc_id].dataType.simpleString()
    return f"doc_id {kind}, item_id {items.schema['item_id'].dataType.simpleString()}, n_shingles long, n_shared long, containment double"


def decontaminate(docs: DataFrame, items: DataFrame, *, threshold: float = 0.8, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that contain an item; all columns stay as they are.

    Each row is judged by its own text: rows with the same id, or without one, stay when only another of them contains an item.
    """
    row = F.struct(F.col(doc_id).alias("id"), F.xxhash64("text").alias("text"))
    rows = docs.select(row.alias("row"), "text")
    leaks = contained_items(rows, items, threshold=threshold, doc_id="row").select(F.col("doc_id").alias("__row")).distinct()
    return docs.join(leaks, row.eqNullSafe(F.col("__row")), "left_anti")


def op7_benchmark_leaks(spark, sf_dir):
    return contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), split AS (
  SELECT side, id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM words
), shingle AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS s
  FROM split WHERE len(w) > 0
), sized AS (
  SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM shingle WHERE side = 'b'
)
SELECT d.id AS doc_id, b.id AS item_id, b.n AS n_shingles, count(*) AS n_shared, count(*) / b.n AS containment
FROM shingle d JOIN sized b ON d.s = b.s WHERE d.side = 'd'
GROUP BY d.id, b.id, b.n HAVING count(*) / b.n >= 0.8
"""

QUERIES = {"op7_benchmark_leaks": (op7_benchmark_leaks, ORACLE)}
