"""Toxicity by weak supervision.

Many voters look at each document of a bounded labelled sample: a fixed insult lexicon, patterns (an insult after a direct
address, several insults), and lexicons induced from parts of the sample: words and word beginnings that occur mostly in
toxic documents. A generative label model estimates, without looking at labels again, how often each voter fires in toxic
and in clean documents and how the voters' errors correlate, and gives each document a posterior. A sparse linear classifier
on hashed words and word beginnings is trained on these posteriors and scores every text.

An induced lexicon abstains on the part it was made from, so its estimated accuracy is not that of its own examples.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import code_points, fold, labelled_sample, map_columns, pack, pieces, read, sigmoid, word_hashes

BITS = 22
PREFIXES = (3, 4, 5, 6, 7)
TIMES = (1, 2, 4)
KINDS = 1 + len(PREFIXES)
PARTS = 3

# Common insults and forms of direct address, as starting lexicons.
INSULTS = "idiot idiots moron morons stupid loser losers pathetic worthless scum trash clown disgusting dumb imbecile fool".split()
ADDRESS = "you your you're youre u du dein tu tes ton eres vous".split()

_letter = np.array([chr(c).isalpha() for c in range(0x3000)])


def _runs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters; everything from U+3000 on counts as a letter."""
    letters = _letter[np.minimum(points, 0x2FFF)] | (points >= 0x3000)
    edge = np.diff(np.concatenate(([False], letters, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _hash(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
    mixed = word_hashes(points, starts, ends) ^ np.uint64(kind * 0x9E3779B97F4A7C15 & (2**64 - 1))
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int32)


def term(word: str) -> int:
    points = code_points(word)
    return int(_hash(points, np.array([0]), np.array([len(points)]), 0)[0])


def features(text: str | None) -> list[np.ndarray]:
    """Hashed terms of a whole text by kind, repeats included: words, then beginnings of ``PREFIXES`` letters of longer words."""
    found = [[] for _ in range(KINDS)]
    for piece, _ in pieces((text or "").lower()):
        points = code_points(piece)
        starts, ends = _runs(points)
        found[0].append(_hash(points, starts, ends, 0))
        for k, n in enumerate(PREFIXES, 1):
            long = ends - starts > n
            found[k].append(_hash(points, starts[long], starts[long] + n, k))
    return [np.concatenate(f) if f else np.zeros(0, np.int32) for f in found]


def occurrences(terms: np.ndarray) -> np.ndarray:
    """One feature for each number of ``TIMES`` that a term occurs at least; for once it is the term itself."""
    found, n = np.unique(terms, return_counts=True)
    levels = [((found[n >= t].astype(np.int64) * (2 * t - 1) + (t - 1) * 0x2545F4) % (1 << BITS)).astype(np.int32) for t in TIMES]
    return np.unique(np.concatenate(levels))


_insults = np.array(sorted(term(w) for w in INSULTS), np.int32)
_address = np.array(sorted(term(w) for w in ADDRESS), np.int32)


def fixed_votes(words: np.ndarray) -> list[bool]:
    """Of the fixed voters: any insult, an insult within six words after a direct address, two insults or more."""
    insults, address = np.flatnonzero(np.isin(words, _insults)), np.flatnonzero(np.isin(words, _address))
    near = np.searchsorted(address, insults) - 1
    aimed = (near >= 0) & (insults - address[near] <= 6) if len(address) else np.zeros(len(insults), bool)
    return [len(insults) > 0, bool(aimed.any()), len(insults) > 1]


FIXED = 3


def surprise(bad: np.ndarray, good: np.ndarray, share: float) -> np.ndarray:
    """Bits of evidence (a log-likelihood ratio) that terms in ``bad`` toxic and ``good`` clean documents favour toxic ones.

    ``share`` is the share of toxic documents; terms that are rather clean have none.
    """
    p = bad / np.maximum(bad + good, 1e-9)
    ratio = lambda n, x, q: n * np.log2(np.maximum(x, 1e-12) / q)
    return np.where(p > share, ratio(bad, p, share) + ratio(good, 1 - p, 1 - share), 0.0)


def numbered(sets: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The terms that occur in ``sets``, in order, and the sets as places among them: what is learned from takes no room for other terms."""
    terms = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.int32)
    return terms, [np.searchsorted(terms, s).astype(np.int32) for s in sets]


def counts(places: list[np.ndarray], weight: np.ndarray, n: int) -> np.ndarray:
    """Documents that hold each of ``n`` numbered terms, weighted."""
    out = np.zeros(n)
    for s, w in zip(places, weight):
        out[s] += w
    return out


def induce(sets: list[np.ndarray], toxic: np.ndarray, margin: float = 4.0, odds: float = 8.0) -> np.ndarray:
    """Terms ``odds`` times as frequent in toxic as in clean documents, with more evidence than chance gives so many terms."""
    terms, places = numbered(sets)
    bad, good = counts(places, toxic * 1.0, len(terms)), counts(places, 1.0 - toxic, len(terms))
    n, m = max(toxic.sum(), 1), max((1 - toxic).sum(), 1)
    bits = surprise(bad, good, n / (n + m))
    often = (bad + 0.5) / (n + 1) >= odds * (good + 0.5) / (m + 1)
    return terms[often & (bits >= np.log2(max(np.count_nonzero(bad), 1)) + margin)]


def label_model(votes: np.ndarray, prior: float, rounds: int = 30) -> np.ndarray:
    """Posterior of each row from ``votes``: 1 toxic, 0 clean, -1 abstains.

    For each voter the rates of firing in toxic and in clean documents are estimated by expectation-maximisation. The
    correlations of the voters' errors, given the posterior, discount voters that repeat each other.
    """
    cast = votes >= 0
    fired = np.where(cast, votes, 0).astype(float)
    posterior = np.clip(fired.sum(1) / np.maximum(cast.sum(1), 1), 0.02, 0.98)
    for _ in range(rounds):
        rates = [((fired * p[:, None]).sum(0) + a) / ((cast * p[:, None]).sum(0) + a + b) for p, a, b in ((posterior, 2, 1), (1 - posterior, 0.1, 2))]
        hit, false = np.clip(rates[0], 0.02, 0.995), np.clip(rates[1], 0.0005, 0.98)
        hit = np.maximum(hit, false)  # a voter for toxic is never evidence against it
        expected = posterior[:, None] * hit + (1 - posterior)[:, None] * false
        error = np.where(cast, fired - expected, 0.0)
        spread = np.sqrt((error**2).sum(0)) + 1e-9
        alike = np.abs(error.T @ error) / np.outer(spread, spread)
        np.fill_diagonal(alike, 1.0)
        share = 1 / np.maximum(1.0, (alike * (alike > 0.1)).sum(0)) ** 0.5
        evidence = np.where(fired > 0, np.log(hit / false), np.log((1 - hit) / (1 - false))) * cast
        posterior = sigmoid(np.log(prior / (1 - prior)) + evidence @ share)
    return posterior


def train_linear(
    sets: list[np.ndarray], target: np.ndarray, *, epochs: int = 40, rate: float = 0.1, sparse: float = 1e-3, least: float = 10.0, seed: int = 3
) -> tuple[np.ndarray, np.ndarray, float]:
    """Terms, weights and bias of a logistic model of which terms a document holds.

    Terms with at least ``least`` bits of evidence for either side take part; small weights are driven to zero.
    """
    target = np.asarray(target)
    share = float(np.clip(target.mean(), 1e-3, 1 - 1e-3)) if len(target) else 0.5
    held, places = numbered(sets)
    bad, good = counts(places, target, len(held)), counts(places, 1 - target, len(held))
    bits = np.maximum(surprise(bad, good, share), surprise(good, bad, 1 - share))
    terms = held[bits >= least]
    place = np.full(len(held), -1, np.int32)
    place[bits >= least] = np.arange(len(terms))
    rows = [r[r >= 0] for r in (place[s] for s in places)]
    weight, bias, rng = np.zeros(len(terms)), 0.0, np.random.default_rng(seed)
    for epoch in range(epochs):
        pace = rate / (1 + epoch / 3)
        for i in rng.permutation(len(rows)):
            wrong = sigmoid(weight[rows[i]].sum() + bias) - target[i]
            bias -= 0.1 * pace * wrong
            moved = weight[rows[i]] - pace * wrong
            weight[rows[i]] = np.sign(moved) * np.maximum(np.abs(moved) - pace * sparse, 0)
    kept = np.abs(weight) > 0.02
    return terms[kept], weight[kept], bias


@dataclass
class Model:
    terms: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self._table = None

    def __getstate__(self):
        return {**self.__dict__, "_table": None}  # the sparse form travels

    def score(self, text: str | None) -> float:
        if self._table is None:
            self._table = np.zeros(1 << BITS, np.float32)
            self._table[self.terms] = self.weights
        held = np.unique(np.concatenate([occurrences(k) for k in features(text)]))
        return float(sigmoid(self.bias + float(self._table[held].sum())))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_class: int = 2500, seed: int = 9) -> Model:
    """Learn from at most ``per_class`` whole labelled documents of each class that are not in fold 0.

    The sample is balanced; the bias is then shifted to the classes' shares among all labelled training rows. Without toxic
    examples only the fixed lexicon counts.
    """
    sample, sizes = labelled_sample(docs, labels, label, per_class, seed)

    def terms_of(rows):
        kinds = [features(t) for t in rows["text"]]
        return {
            "sets": [[pack(occurrences(k)) for k in ks] for ks in kinds],
            "fixed": [fixed_votes(ks[0]) for ks in kinds],
        }

    schema = T.StructType.fromDDL("doc_id long, label int, sets array<binary>, fixed array<boolean>")
    rows = map_columns(sample.select("doc_id", F.col("label").cast("int").alias("label"), "text"), terms_of, schema).collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["sets"][0])))
    y = np.array([r["label"] for r in rows], int)
    if not (y == 1).any() or not (y == 0).any():
        return Model(_insults, np.full(len(_insults), 6.0), -4.0)
    sets = [[np.frombuffer(b, np.int32) for b in r["sets"]] for r in rows]
    part = np.arange(len(rows)) % PARTS
    votes = np.full((len(rows), FIXED + PARTS * KINDS), -1, np.int8)
    fixed = np.array([r["fixed"] for r in rows])
    votes[:, :FIXED] = np.where(fixed, 1, -1)  # silence of a fixed lexicon says nothing
    for p in range(PARTS):
        mine = np.flatnonzero(part == p)
        for k in range(KINDS):
            held = np.zeros(1 << BITS, bool)
            held[induce([sets[i][k] for i in mine], y[mine])] = True
            for i in np.flatnonzero(part != p):
                votes[i, FIXED + p * KINDS + k] = held[sets[i][k]].any()
    posterior = label_model(votes, float(y.mean()))
    terms, weights, bias = train_linear([np.unique(np.concatenate(s)) for s in sets], posterior)
    prior = np.log(sizes[1] / sizes[0]) - np.log(y.mean() / (1 - y.mean()))
    return Model(terms, weights, float(bias + prior))


def score_toxicity(
    docs: DataFrame, model: Model, *, threshold: float = 0.5, score: str = "score", predicted: str = "predicted"
) -> DataFrame:
    """``docs`` with columns ``score`` (0 to 1) and ``predicted`` in place of any of these names.

    Each row is scored on its whole text alone; null and empty texts get the score of the bias.
    """
    kept = docs.drop(score, predicted)
    schema = T.StructType([*kept.schema, T.StructField(score, T.DoubleType())])
    scored = map_columns(kept, lambda rows: {score: [model.score(t) for t in rows["text"]]}, schema)
    return scored.withColumn(predicted, (F.col(score) >= threshold).cast("int"))


def op3_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")  # rows without an id are not held out
    return score_toxicity(docs, model).select("doc_id", held, "score", "predicted")


QUERIES = {"op3_toxicity": (op3_toxicity, None)}
