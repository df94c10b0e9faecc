"""Documents to a training mix: stages applied one after another, each written as Parquet and reread.

Every stage works on all rows its predecessor kept and returns the columns of documents; the last adds the mix. Extra columns pass
through. Toxic documents go, one document of each class of near duplicates stays, documents that hold a benchmark item go,
secrets are replaced by a mark (no document goes), and every document left gets the words that the mix takes of it.
"""

from __future__ import annotations

from eventloom.llm import decontaminate, mixing, near_join, secrets, toxicity
from eventloom.llm.common import read
from eventloom.session import stage


def drop_toxic(spark, docs, sf_dir):
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, score="__toxicity", predicted="__toxic")
    return scored.filter("__toxic = 0").select(docs.columns)


def drop_near_duplicates(spark, docs, sf_dir):
    return near_join.keep_one(docs)


def drop_leaks(spark, docs, sf_dir):
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark, docs, sf_dir):
    return secrets.redact_secrets(docs)


def mix(spark, docs, sf_dir):
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secret_scan", redact_secrets),
    ("source_mix", mix),
]

#: The toxicity stage is a trained classifier, which SQL cannot express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
