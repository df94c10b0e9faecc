"""Queries of this subpackage: name → (Spark query, SQL for checking or None)."""

from __future__ import annotations

from . import (
    decontaminate,
    fingerprints,
    hard_negatives,
    html_text,
    language_model,
    manifest,
    mixing,
    near_join,
    quality,
    secrets,
    substrings,
    toxicity,
    warc,
)

MODULES = [
    quality,
    secrets,
    toxicity,
    near_join,
    language_model,
    mixing,
    decontaminate,
    warc,
    substrings,
    fingerprints,
    hard_negatives,
    manifest,
    html_text,
]


def registered():
    return {name: pair for module in MODULES for name, pair in module.QUERIES.items()}
