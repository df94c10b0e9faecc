"""Column functions for codes and patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ANSWER_MARK = "//option:"


def clean_code(code: Column) -> Column:
    """Runs of white space become one underscore."""
    return F.regexp_replace(code, r"\s+", "_")


def starts_with_any(code: Column, prefixes: Sequence[str]) -> Column:
    """True where the code starts with any of the literal prefixes."""
    if not prefixes:
        return F.lit(False)
    return code.rlike("^(?:" + "|".join(re.escape(p) for p in prefixes) + ")")


def contains_any(code: Column, patterns: Sequence[str]) -> Column:
    """True where any of the regular expressions matches anywhere in the code."""
    return code.rlike("|".join(patterns))


def fold_answer(code: Column, value: Column, text: Column) -> Column:
    """Append a categorical answer to the code where there is no numeric value."""
    has_answer = value.isNull() & text.isNotNull() & (text != "")
    return F.when(has_answer, F.concat(code, F.lit(ANSWER_MARK), clean_code(text))).otherwise(code)
