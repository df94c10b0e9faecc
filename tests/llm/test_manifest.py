"""The Merkle manifest against a plain recursion, and on awkward rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from check import canonical
from eventloom.llm import common, manifest
from eventloom.llm.registry import registered

from ..conftest import DATA

FOLD = str.maketrans(common.UPPER, common.LOWER)
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root string, grp string, pos string, n int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(value):
    if value is None:
        return "-"
    return f"{len(str(value).encode())}:{value}"


def tree(leaves):
    """Root of a list of digests, and for each of them the (left, right) steps up."""
    paths = [[] for _ in leaves]
    owners = [[i] for i in range(len(leaves))]
    level = list(leaves)
    while len(level) > 1:
        parents, up = [], []
        for at in range(0, len(level), 8):
            run = level[at : at + 8]
            for k in range(len(run)):
                for i in owners[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            parents.append(h("".join(run)))
            up.append([i for o in owners[at : at + 8] for i in o])
        level, owners = parents, up
    return level[0], paths


def brute(rows):
    """doc_id, leaf, subroot, root, proof, folded root and verdict of (doc_id, source, lang, n_chars, text) rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], h("".join(enc(v) for v in r)), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        own[g] = tree([x[1] for x in groups[g]])
    root, above = tree([own[g][0] for g in names]) if names else (None, [])
    out = []
    for g, up in zip(names, above):
        for (doc_id, leaf, r), path in zip(groups[g], own[g][1]):
            path = path + up
            start = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                start = h("".join(enc(v) for v in (*r[:4], r[4] and r[4].translate(FOLD))))
            for left, right in path:
                start = h(left + start + right)
            out.append((doc_id, leaf, own[g][0], root, h("".join(a + b for a, b in path)), start, start == root))
    return sorted(out, key=str)


def run(spark, monkeypatch, df):
    monkeypatch.setattr(manifest, "read", lambda *_: df)
    return sorted((tuple(r) for r in manifest.op12_merkle_manifest(spark, DATA).collect()), key=str)


def rows_of(*rows):
    return [(*r, "x", "y", "z", "p", 3) for r in rows]


AWKWARD = [
    (1, "s", "en", 3, "One"),
    (1, "s", "en", 3, "Two"),  # one id, two texts
    (2, None, None, None, None),
    (3, "", "", 0, ""),  # the empty group is not the null one
    (4, "é", "Zz", 2, "ÀB😀"),
    (None, "s", "en", 1, "no id"),
    (None, "s", "en", 1, "no id"),
    (None, "s", None, 1, "NO ID"),
    (-5, "s", "en", 1, "negative"),
    (2**62, "s", "en", 1, "Large id"),
    (2**63 - 1, "s", "en", 1, "Largest id"),
    (-(2**63), "s", "en", 1, "Smallest id"),
    *[(i, "s", "de", 1, f"Text {i}") for i in range(100, 173)],  # two levels, a last run of one
    (999, "s", "é", 1, "lone " * 200_000),
]


def test_manifest_awkward_rows(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(*AWKWARD), SCHEMA)
    assert run(spark, monkeypatch, df) == brute(AWKWARD)


def test_manifest_of_many_groups(spark, monkeypatch):
    rows = [(i, "s", f"l{i % 70:02d}", i, "T" * i) for i in range(140)]
    assert run(spark, monkeypatch, spark.createDataFrame(rows_of(*rows), SCHEMA)) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 8, 9])
def test_manifest_of_few_rows(spark, monkeypatch, n):
    rows = [(i, "s", "en", i, "T") for i in range(n)]
    assert run(spark, monkeypatch, spark.createDataFrame(rows_of(*rows), SCHEMA)) == brute(rows)


def test_manifest_matches_sql(spark, duck):
    query, sql = registered()["op12_merkle_manifest"]
    got, want = query(spark, DATA).toPandas(), duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
    tampered = got[got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 0)]
    assert 0 < (~got["verified"]).sum() <= len(tampered)


def test_any_change_breaks_the_proof(spark):
    docs = common.read(spark, DATA, "documents")
    rows = manifest.manifest(docs, tampered=F.concat(F.coalesce("text", F.lit("")), F.lit(" ")))
    bad = rows.filter(manifest.fold(F.col("now_leaf"), F.col("path")) == F.col("root")).count()
    good = rows.filter(manifest.fold(F.col("leaf"), F.col("path")) == F.col("root")).count()
    assert bad == 0 and good == docs.count()
