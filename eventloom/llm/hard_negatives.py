"""Hard-negative mining with Kronecker-packed products.

Vectors are integers. Several candidates are packed into one wide integer per component: each is biased to be non-negative and
laid into a bit field of its own, wide enough for any score, so that one multiplication by an anchor's component multiplies them
all and the sum over components carries their scores side by side. Taking the fields apart and the biases off again gives exact
scores. Wide integers of up to 53 bits are held in doubles, in which every step is exact, and are multiplied as matrices; where
not even one field fits, Python's integers of any size take their place.

The query set is the anchors. They are dealt into tiles of bounded size and all rows into shares; each pair of a tile and a share is a
unit of work that streams its rows past the tile's anchors and keeps, of each anchor, only the few best. Two passes: the first
finds the positives of each anchor, the second the negatives in the band that each positive sets. Only those shortlists are
shuffled, so what meets in one group is bounded by shares times the length of a list, whatever label or vector is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import read

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
LOW, HIGH = 80, 100
TILE = 4096
ANCHORS_AT_ONCE, ROWS_AT_ONCE = 512, 4096
EXACT_BITS, WIDE_FIELDS = 53, 64
LEAST, MOST = -(2**63) + 1, 2**63 - 1


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd


def packed_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The inner products of each anchor with each row, exact; those that no 64-bit integer holds become its nearest end."""
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    own, other = (max(abs(int(m.min())), abs(int(m.max()))) for m in (anchors, rows))
    if max(own, other) < 1 << 40:
        bias, shift = -int(rows.min()), -int(anchors.min())
        biased, shifted = rows + bias, anchors + shift
        bits = max(1, (int(shifted.sum(1).max()) * int(biased.max())).bit_length())
        fields = EXACT_BITS // bits
        if fields:
            return _in_doubles(anchors, rows, shifted, biased, shift, bias, bits, fields)
    return _in_wide_integers(anchors, rows)


def _in_doubles(anchors, rows, shifted, biased, shift, bias, bits, fields):
    """sum (a + shift)(r + bias) stands in a field; less bias * sum a, shift * sum r and shift * bias for each component, it is the score."""
    width = -(-len(rows) // fields)
    packed = np.zeros((width, rows.shape[1]))
    for k in range(fields):
        part = biased[k * width : (k + 1) * width]
        packed[: len(part)] += part * float(1 << bits * k)
    together = (shifted.astype(np.float64) @ packed.T).astype(np.int64)
    mask = np.int64((1 << bits) - 1)
    apart = np.concatenate([(together >> np.int64(bits * k)) & mask for k in range(fields)], axis=1)[:, : len(rows)]
    return apart - (bias * anchors.sum(1))[:, None] - (shift * rows.sum(1))[None, :] - rows.shape[1] * shift * bias


def _in_wide_integers(anchors, rows):
    dims = rows.shape[1]
    bias, shift = -int(rows.min()), -int(anchors.min())
    bits = max(1, (dims * (int(anchors.max()) + shift) * (int(rows.max()) + bias)).bit_length())
    out = np.zeros((len(anchors), len(rows)), np.int64)
    shifted = [[int(x) + shift for x in a] for a in anchors]
    sums = [sum(a) for a in shifted]
    for at in range(0, len(rows), WIDE_FIELDS):
        part = [[int(x) + bias for x in r] for r in rows[at : at + WIDE_FIELDS]]
        packed = [sum(r[d] << bits * k for k, r in enumerate(part)) for d in range(dims)]
        for i, a in enumerate(shifted):
            together = sum(x * p for x, p in zip(a, packed))
            for k, r in enumerate(part):
                # (a + shift)(r + bias) summed, less the terms with a bias
                score = (together >> bits * k & (1 << bits) - 1) - bias * sums[i] - shift * sum(r) + dims * shift * bias
                out[i, at + k] = min(max(score, LEAST), MOST)
    return out


def _best_of(allowed: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` highest allowed scores in each row; equal scores go to the earlier column."""
    at = np.flatnonzero(allowed.any(axis=1))
    if not len(at):
        return at, at
    allowed, scores = allowed[at], scores[at]
    n = scores.shape[1]
    if max(abs(int(scores.min())), abs(int(scores.max()))) < 1 << 49:
        keys = scores * np.int64(n) + np.arange(n - 1, -1, -1)
    else:
        keys = np.empty_like(scores)
        order = np.argsort(np.where(allowed, -scores, MOST), axis=1, kind="stable")
        np.put_along_axis(keys, order, np.broadcast_to(np.arange(n, 0, -1), scores.shape), axis=1)
    keys = np.where(allowed, keys, LEAST)
    bound = np.partition(keys, n - k, axis=1)[:, n - k] if n > k else np.full(len(at), LEAST)
    row, column = np.nonzero(allowed & (keys >= bound[:, None]))
    return at[row], column


class Shortlists:
    """For each of ``n`` lists the best ``k`` entries seen: higher score first, then smaller id (none last), then row."""

    NAMES = ("at", "score", "no_id", "id", "row")

    def __init__(self, n: int, k: int):
        self.k = k
        self.least = np.full(n, LEAST)
        self.held = {c: np.zeros(0, bool if c == "no_id" else np.int64) for c in self.NAMES}

    def offer(self, **entries: np.ndarray) -> None:
        if not len(entries["at"]):
            return
        all_of = {c: np.concatenate((self.held[c], entries[c])) for c in self.NAMES}
        order = np.lexsort((all_of["row"], all_of["id"], all_of["no_id"], -all_of["score"], all_of["at"]))
        all_of = {c: v[order] for c, v in all_of.items()}
        at = all_of["at"]
        fresh = np.ones(len(at), bool)  # equal rows count once
        fresh[1:] = np.any([v[1:] != v[:-1] for v in all_of.values()], axis=0)
        all_of = {c: v[fresh] for c, v in all_of.items()}
        at = all_of["at"]
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        last = rank == self.k - 1
        self.least[at[last]] = all_of["score"][last]
        self.held = {c: v[rank < self.k] for c, v in all_of.items()}


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The lists of a column as rows, missing components 0."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class _Unit:
    """One tile of anchors, and the rows of one share as they stream past."""

    def __init__(self, number: int, bands: int, k: int):
        self.number, self.bands, self.k = number, bands, k
        self.parts: list[pa.RecordBatch] = []
        self.anchors: pa.Table | None = None

    def anchor(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)

    def _ready(self) -> None:
        if self.anchors is not None:
            return
        self.anchors = pa.Table.from_batches(self.parts).combine_chunks()
        vectors = self.anchors.column("v").combine_chunks()
        self.dims = max([0, *vectors.value_lengths().to_pylist()])
        self.vectors = _matrix(vectors, self.dims)
        self.row, self.label = (self.anchors.column(c).to_numpy() for c in ("row", "label"))
        n = len(self.row)
        if self.bands:  # the scores of each anchor's positives, and the lowest score of a negative, in exact arithmetic
            tops = self.anchors.column("tops").to_pylist()
            self.have = np.array([[j < len(t) for j in range(self.bands)] for t in tops], bool).reshape(n, self.bands)
            self.high = np.array([[t[j] if j < len(t) else LEAST for j in range(self.bands)] for t in tops], np.int64).reshape(n, self.bands)
            self.low = np.array([[-(-LOW * int(s) // HIGH) for s in h] for h in self.high], np.int64).reshape(n, self.bands)
        self.lists = Shortlists(n * max(self.bands, 1), self.k)

    def rows(self, batch: pa.RecordBatch) -> None:
        if not self.parts:
            return
        self._ready()
        ids, no_id, row, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "no_id", "row", "label"))
        order = np.lexsort((row, ids, no_id))
        vectors = batch.column("v")
        width = max([self.dims, *vectors.value_lengths().to_pylist()])
        vectors = _matrix(vectors, width)[:, : self.dims]  # an anchor has nothing to multiply further components by
        for at in range(0, len(order), ROWS_AT_ONCE):
            part = order[at : at + ROWS_AT_ONCE]
            for start in range(0, len(self.row), ANCHORS_AT_ONCE):
                mine = np.arange(start, min(start + ANCHORS_AT_ONCE, len(self.row)))
                scores = packed_products(self.vectors[mine], vectors[part])
                same = self.label[mine][:, None] == label[part][None, :]
                for j in range(max(self.bands, 1)):
                    lists = mine * max(self.bands, 1) + j
                    allowed = scores >= self.lists.least[lists][:, None]
                    if self.bands:
                        allowed &= ~same & self.have[mine, j][:, None]
                        allowed &= (scores >= self.low[mine, j][:, None]) & (scores <= self.high[mine, j][:, None])
                    else:
                        allowed &= same & (self.row[mine][:, None] != row[part][None, :])
                    a, b = _best_of(allowed, scores, self.k)
                    c = part[b]
                    self.lists.offer(at=lists[a], score=scores[a, b], no_id=no_id[c], id=ids[c], row=row[c])

    def result(self) -> pa.RecordBatch | None:
        if self.anchors is None:
            return None
        held, bands = self.lists.held, max(self.bands, 1)
        columns = [self.row[held["at"] // bands], (held["at"] % bands).astype(np.int32)] + [held[c] for c in ("score", "no_id", "id", "row")]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "band", "score", "no_id", "id", "row"])


def _shortlist(anchors: DataFrame, rows: DataFrame, n_anchors: int, bands: int, k: int, tile: int) -> DataFrame:
    """Of each anchor (and band) and share of the rows the ``k`` best entries: anchor, band, score, no_id, id, row."""
    spark = rows.sparkSession
    tiles = max(1, -(-n_anchors // tile))
    shares = max(4, -(-2 * spark.sparkContext.defaultParallelism // tiles))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)).cast("int")
    unit = (F.col("tile") * shares + F.col("share")).alias("unit")
    columns = ["id", "no_id", "label", "row", "v"]
    own = anchors.select(*columns, "tops", place(1, tiles).alias("tile"), every(shares).alias("share"))
    others = rows.select(*columns, F.array().cast("array<bigint>").alias("tops"), place(2, shares).alias("share"), every(tiles).alias("tile"))
    dealt = own.select(unit, F.lit(0).alias("kind"), *columns, "tops").union(others.select(unit, F.lit(1).alias("kind"), *columns, "tops"))
    dealt = dealt.repartitionById(tiles * shares, F.col("unit")).sortWithinPartitions("unit", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            units, kinds = batch.column("unit").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(units) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(units)]):
                if start == end:
                    continue
                if now is None or now.number != units[start]:
                    if now is not None and (done := now.result()) is not None:
                        yield done
                    now = _Unit(int(units[start]), bands, k)
                part = batch.slice(start, end - start)
                now.rows(part) if kinds[start] else now.anchor(part)
        if now is not None and (done := now.result()) is not None:
            yield done

    return dealt.mapInArrow(run, "anchor long, band int, score long, no_id boolean, id long, row long")


def _first(shortlist: DataFrame, k: int) -> DataFrame:
    """The best ``k`` over all shares, with their rank; a group has at most ``k`` entries of each share."""
    w = Window.partitionBy("anchor", "band").orderBy(F.col("score").desc(), "no_id", "id", "row")
    return shortlist.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    tile: int = TILE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows where ``is_anchor``.

    Scores are inner products of components floor(256 * x), exact as 64-bit integers (beyond those, the nearest end). An anchor's
    positives are its best ``positives`` other rows of its label; the negatives of each are the best ``negatives`` rows of another
    label with a score from 80 to 100 % of the positive's. Equal scores go to the smaller id, null ids last, then by a hash of the row.

    Rows with a null label or vector, or with a component that is null or not finite, take no part. Equal rows count once; rows of one
    id that differ are rows of their own. Of vectors of different lengths the shorter is filled up with zeros. Anchors without a
    positive or without a negative in the band give no row, and so does an empty table. Other columns are ignored.
    """
    flag = F.coalesce(is_anchor, F.lit(False))
    rows = rows.filter(F.col(label).isNotNull() & usable(F.col(vector)))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec"), F.col(label).cast("long").alias("label"), integers(F.col(vector)).alias("v"), flag.alias("anchor"))
    rows = rows.select(
        F.coalesce("vec", F.lit(0)).alias("id"), F.col("vec").isNull().alias("no_id"), "label", F.xxhash64("vec", "label", "v").alias("row"), "v", "anchor"
    )
    rows = stage(rows, "negatives-rows")
    anchors = rows.filter("anchor").dropDuplicates(["row"]).drop("anchor")
    n_anchors = rows.filter("anchor").count()
    no_tops = F.array().cast("array<bigint>").alias("tops")

    found = _shortlist(anchors.select("*", no_tops), rows, n_anchors, 0, positives, tile)
    best = stage(_first(found, positives), "negatives-positives")
    tops = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("t"))  # at most ``positives``
    tops = tops.select(F.col("anchor").alias("row"), F.col("t.score").alias("tops"))
    found = _shortlist(anchors.join(tops, "row"), rows, n_anchors, positives, negatives, tile)
    chosen = _first(found, negatives)

    named = lambda name: F.when(~F.col("no_id"), F.col("id")).alias(name)
    negative = chosen.select("anchor", "band", "rank", named("negative_id"), F.col("score").alias("negative_score"))
    positive = best.select("anchor", (F.col("rank") - 1).alias("band"), named("positive_id"), F.col("score").alias("positive_score"))
    own = anchors.select(F.col("row").alias("anchor"), named("anchor_id"))
    joined = negative.join(positive, ["anchor", "band"]).join(own, "anchor")
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", noisy), F.col("vec_id") % 100 == 0)


_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), ranked AS (
    SELECT p.anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""

QUERIES = {"op11_hard_negatives": (op11_hard_negatives, _SQL)}
