"""Helpers that several operators share: reading tables, folds, words, hashes of words and character n-grams."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# The blanks that separate words.
BLANKS = "[\\x20\\x09-\\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)

_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09], np.uint32)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, size: int = 5) -> Column:
    """crc32 of the id as text, modulo ``size``; null ids are in no fold."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % size).cast("int")


def lower_ascii(text: str) -> str:
    return text.translate(_FOLD)


def words_of(text: Column) -> Column:
    """Array of the words of a text, empty for null and blank texts; A-Z become a-z."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BLANKS), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where it is used inside a function of array elements."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")).cast("long")


def map_columns(df: DataFrame, function: Callable[[Mapping[str, list]], Mapping[str, list]], schema: StructType) -> DataFrame:
    """``function`` of the columns of each Arrow batch: it gets lists by name and returns those of ``schema`` that it makes.

    Columns it does not return are passed on from the batch untouched.
    """
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = function(_Lists(batch))
            arrays = [
                pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name).cast(f.type) for f in target
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


class _Lists(Mapping):
    """The columns of a batch as Python lists, made when asked for."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch

    def __getitem__(self, name: str) -> list:
        return self.batch.column(name).to_pylist()

    def __iter__(self):
        return iter(self.batch.schema.names)

    def __len__(self) -> int:
        return self.batch.num_columns


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mix32(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def blanks(points: np.ndarray) -> np.ndarray:
    return (points == 32) | ((points >= 9) & (points <= 13))


def word_bounds(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words among code points (or UTF-8 bytes)."""
    edge = np.diff(np.concatenate(([True], blanks(points), [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def word_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its code points, mixed with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    flat = np.repeat(starts, lengths) + (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths))
    at = flat - np.repeat(starts, lengths)
    terms = (points[flat].astype(np.uint64) + np.uint64(0x51ED27)) * powers(base, int(lengths.max()))[at]
    return mix64(np.add.reduceat(terms, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A 32-bit hash of each run of ``n`` code points."""
    if len(points) < n:
        return np.zeros(0, np.uint32)
    m = len(points) - n + 1
    h = points[:m] * _ODD[0]
    for k in range(1, n):
        h = h + points[k : k + m] * _ODD[k]
    return mix32(h + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF))


def pieces(text: str, size: int = 1 << 20, overlap: int = 0) -> Iterator[tuple[str, int]]:
    """The text in pieces of about ``size`` code points, cut before a blank where there is one, and the length of each.

    A piece is followed by the next ``overlap`` code points, for runs across the cut.
    """
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(" ", at + size // 2, at + size), text.rfind("\n", at + size // 2, at + size))
        cut = cut if cut > at else at + size
        yield text[at : cut + overlap], cut - at
        at = cut
    yield text[at:], len(text) - at


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """Texts and labels of up to ``per_class`` labelled training documents of each class, and the number there are of each.

    Rows of fold 0, rows without a 0/1 label and ids with contradicting labels are left out. Which rows are taken depends on ids and
    ``seed`` only; of an id with several texts one is taken, by their hashes.
    """
    known = labels.filter((fold(F.col("doc_id")) != 0) & F.col(label).isin(0, 1)).groupBy("doc_id")
    known = known.agg(F.min(label).alias("low"), F.max(label).alias("label")).filter("low = label").drop("low")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"))
    taken = [known.filter(F.col("label") == c).orderBy(draw, "doc_id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(taken[0].union(taken[1]))  # 2 * per_class ids
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "label")
    return texts.agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), sizes


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
