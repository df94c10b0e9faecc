"""Scores and fingerprints against plain loops over characters, words and paragraphs."""

import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventloom.llm import common, fingerprints, language_model, quality, toxicity

from ..conftest import DATA

MASK = (1 << 64) - 1
TEXTS = [None, "", " \t", "one", "one one two three", "ab  cd\n\nef 😀 é", "x" * 50, "Same same same. Same, same!", "ひらがな 漢字 text"]


def texts(spark):
    return TEXTS + [r.text for r in common.read(spark, DATA, "documents").select("text").collect()]


def mix64(h):
    h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & MASK
    h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 & MASK
    return h ^ h >> 33


def mix32(h):
    h = (h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF
    return h ^ h >> 13


def plain_quality(table, bias, text):
    found, words = [], re.findall(r"[^\x20\x09-\x0D]+", text or "")
    hashes = []
    for w in words:
        h = sum((ord(c) + 0x51ED27) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(w))
        hashes.append(mix64((h + len(w)) & MASK))
    found += [h >> 64 - quality.BUCKET_BITS for h in hashes]
    found += [quality.REPEAT for a, b in zip(hashes, hashes[1:]) if a == b]
    points = [32 if c in "\x20\t\n\x0b\x0c\r" else ord(c) for c in text or ""]
    odd = [int(x) for x in common._ODD]
    for n in quality.GRAMS:
        for i in range(len(points) - n + 1):
            h = sum(points[i + k] * odd[k] for k in range(n)) + n * 0x3C6EF372
            found.append(mix32(h & 0xFFFFFFFF) >> 32 - quality.BUCKET_BITS)
    mean = sum(float(table[b]) for b in found) / len(found) if found else 0.0
    return 1 / (1 + np.exp(-(bias + mean)))


def test_quality_scores(spark):
    table = np.random.default_rng(1).normal(0, 3, 1 << quality.BUCKET_BITS).astype(np.float32)
    model = quality.Model(table, -0.3)
    for text in texts(spark):
        if len(text or "") < 20_000:
            assert model.score(text) == pytest.approx(plain_quality(table, -0.3, text), abs=1e-9)


def test_toxicity_scores(spark):
    """A text's logit is the bias and the weight of every (term, number of times) it reaches, once each."""
    rng = np.random.default_rng(2)
    terms = np.unique(rng.integers(0, 1 << toxicity.BITS, 60_000))
    weights = rng.normal(0, 0.2, len(terms))
    model = toxicity.Model(terms.astype(np.int32), weights, -1.0)
    weight = dict(zip(terms.tolist(), weights.astype(np.float32).tolist()))
    for text in texts(spark):
        held = set()
        for kind in toxicity.features(text):
            for term, n in Counter(kind.tolist()).items():
                for t in toxicity.TIMES:
                    if n >= t:
                        held.add((term * (2 * t - 1) + (t - 1) * 0x2545F4) % (1 << toxicity.BITS))
        logit = -1.0 + sum(weight.get(h, 0.0) for h in held)
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-np.clip(logit, -35, 35))), abs=1e-4)


def plain_paragraphs(text):
    return [p for p in re.split(r"[\n\r]+|(?<=[.!?])[ \t]+", text or "") if p.strip(" ")]


def plain_vector(text):
    total = [0] * fingerprints.WIDTH
    for p in plain_paragraphs(text):
        digest = hashlib.sha256(p.encode()).hexdigest().encode()
        hashes = [xxhash.xxh64_intdigest(digest, xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 42)) for i in range(fingerprints.LANES + 1)]
        one = [h & 0xFFFFFFFF for h in hashes[:-1]] + [hashes[-1] >> i & fingerprints.ONE_IN_EACH for i in range(fingerprints.COUNTERS)] + [1]
        total = [a + b for a, b in zip(total, one)]
    return [x % (1 << 32) if i < fingerprints.LANES else x % (1 << 60) for i, x in enumerate(total)]


def test_fingerprints_are_sums_of_hashed_paragraphs(spark):
    rows = [(i, t) for i, t in enumerate(texts(spark))]
    df = spark.createDataFrame(rows, "i long, text string").withColumn("vector", fingerprints.fingerprint(F.col("text")))
    for r in df.collect():
        assert r.vector == plain_vector(r.text)


def test_likeness_follows_the_shared_paragraphs(spark):
    rng = np.random.default_rng(3)
    pairs = []
    for i in range(120):
        n, shared = int(rng.integers(10, 60)), rng.random()
        a = [f"paragraph {i} number {k}" for k in range(n)]
        b = [p if rng.random() < shared else p + " changed" for p in a]
        rng.shuffle(b)
        both = sum((Counter(a) & Counter(b)).values())
        pairs.append(("\n".join(a), "\n".join(b), both / (2 * n - both)))
    v = [fingerprints.fingerprint(F.col(c)) for c in ("a", "b")]
    rows = spark.createDataFrame(pairs, "a string, b string, true double").select("true", fingerprints.likeness(*v).alias("said")).collect()
    apart = np.array([abs(r.true - r.said) for r in rows])
    assert apart.mean() < 0.1 and np.quantile(apart, 0.95) < 0.25
    assert np.corrcoef([r.true for r in rows], [r.said for r in rows])[0, 1] > 0.93


@pytest.mark.parametrize("size", [1, 3, 10, 1000])
def test_tokens_of_pieces(spark, monkeypatch, size):
    whole = [language_model.tokens_of(t) for t in texts(spark)]
    monkeypatch.setattr(language_model, "PIECE", size)
    for text, want in zip(texts(spark), whole):
        got = language_model.tokens_of(text)
        assert got.dtype == np.uint64 and len(got) == len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) + 1 and (got == want).all()


def test_learning_takes_room_for_the_terms_that_occur():
    rng = np.random.default_rng(4)
    toxic = np.arange(60) % 2
    sets = [np.unique(np.append(rng.integers(0, 1 << toxicity.BITS, 30), 77 + 11 * y)).astype(np.int32) for y in toxic]
    toxicity.train_linear(sets[:2], toxic[:2], epochs=1)
    tracemalloc.start()
    try:
        induced = toxicity.induce(sets, toxic)
        terms, weights, _ = toxicity.train_linear(sets, toxic)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert induced.tolist() == [88]
    assert terms.tolist() == [77, 88] and weights[0] < 0 < weights[1]
    assert most < 4 << 20  # an array of all terms alone is 32 MB
