"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and character n-grams; a softmax layer on it gives the
classes. Vectors and layer are trained by stochastic gradient descent in numpy on a bounded sample of labelled documents.
Since the layer is linear in the average, a trained model folds into one number for each bucket, so scoring a text is a
lookup and a mean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (
    blanks,
    code_points,
    fold,
    gram_hashes,
    labelled_sample,
    map_columns,
    pack,
    pieces,
    read,
    sigmoid,
    word_bounds,
    word_hashes,
)

BUCKET_BITS = 18
GRAMS = (3, 4)
REPEAT = (1 << BUCKET_BITS) - 1  # the bucket of a word that repeats the word before it


def buckets(text: str | None) -> list[np.ndarray]:
    """Buckets of the words and character n-grams of a whole text, each time they occur; case and marks count.

    A word that repeats the one before it is in a bucket of its own besides.
    """
    out = []
    for piece, own in pieces(text or "", overlap=max(GRAMS) - 1):
        points = code_points(piece)
        starts, ends = word_bounds(points[:own])
        words = word_hashes(points, starts, ends)
        out.append((words >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        out.append(np.full(int((words[1:] == words[:-1]).sum()), REPEAT, np.int32))
        points = np.where(blanks(points), np.uint32(32), points)
        out += [(gram_hashes(points[: own + n - 1], n) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32) for n in GRAMS]
    return out


@dataclass
class Model:
    """``logit = bias + mean of table[bucket]``; a text without words has the bias alone."""

    table: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        parts = buckets(text)
        n = sum(len(p) for p in parts)
        total = sum(float(self.table[p].sum(dtype=np.float64)) for p in parts)
        return float(sigmoid(self.bias + (total / n if n else 0.0)))


def train(
    documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, dim: int = 16, epochs: int = 12, rate: float = 0.8, seed: int = 1
) -> tuple[np.ndarray, np.ndarray]:
    """The folded table and the two biases of the softmax from (buckets, counts) of each document."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BUCKET_BITS, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    layer[1, :] = rng.normal(0, 0.1, dim)
    step, steps = 0, epochs * len(documents)
    for _ in range(epochs):
        for i in rng.permutation(len(documents)):
            pace, step = rate * (1 - step / steps), step + 1
            ids, counts = documents[i]
            if not len(ids):
                continue
            share = counts / counts.sum()
            hidden = share @ vectors[ids]
            odds = layer @ hidden + bias
            wrong = np.exp(odds - odds.max())
            wrong /= wrong.sum()
            wrong[labels[i]] -= 1
            back = wrong @ layer
            layer -= pace * np.outer(wrong, hidden)
            bias -= pace * 0.1 * wrong
            # a bucket moves by its share, scaled so that a step moves the average as far in a long text as in a short one
            vectors[ids] -= (pace * share / (share @ share) * 0.5)[:, None].astype(np.float32) * back
    return vectors @ (layer[1] - layer[0]), bias


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_class: int = 1500, seed: int = 5) -> Model:
    """Learn from at most ``per_class`` whole labelled documents of each class that are not in fold 0.

    The sample is balanced, so the bias is then shifted to the classes' shares among all labelled training rows. With one
    class only, or none, every text gets the same score.
    """
    sample, sizes = labelled_sample(docs, labels, label, per_class, seed)

    def count(rows):
        found = []
        for text in rows["text"]:
            parts = buckets(text)
            found.append(np.unique(np.concatenate(parts), return_counts=True))
        return {"ids": [pack(i.astype(np.int32)) for i, _ in found], "counts": [pack(n.astype(np.float32)) for _, n in found]}

    schema = T.StructType.fromDDL("doc_id long, label int, ids binary, counts binary")
    rows = map_columns(sample.select("doc_id", F.col("label").cast("int").alias("label"), "text"), count, schema).collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["ids"])))
    y = np.array([r["label"] for r in rows], int)
    n, m = int((y == 0).sum()), int((y == 1).sum())
    if not n or not m:
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), float(np.log((m + 1) / (n + 1))))
    table, bias = train([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in rows], y, seed=seed)
    prior = np.log(sizes[1] / sizes[0]) - np.log(m / n)
    return Model(table.astype(np.float32), float(bias[1] - bias[0] + prior))


def score_quality(
    docs: DataFrame, model: Model, *, threshold: float = 0.3, score: str = "score", predicted: str = "predicted"
) -> DataFrame:
    """``docs`` with columns ``score`` (0 to 1) and ``predicted`` in place of any of these names.

    Each row is scored on its whole text alone; null and empty texts get the score of the bias.
    """
    kept = docs.drop(score, predicted)
    schema = T.StructType([*kept.schema, T.StructField(score, T.DoubleType())])
    scored = map_columns(kept, lambda rows: {score: [model.score(t) for t in rows["text"]]}, schema)
    return scored.withColumn(predicted, (F.col(score) >= threshold).cast("int"))


def op1_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")  # rows without an id are not held out
    return score_quality(docs, model).select("doc_id", held, "score", "predicted")


QUERIES = {"op1_quality": (op1_quality, None)}
