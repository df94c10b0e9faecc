"""Column functions for dates, ages and artificial time tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000

# Length in days of each token unit, and of the long-term token.
UNIT_DAYS = {"D": 1, "W": 7, "M": 30, "Y": 365}
LONG_TERM_DAYS = 3 * 365

TIME_TOKEN_KINDS = ("week_month", "day", "week", "month", "mix", "none")


def floor_div(value: Column, by: int) -> Column:
    """Integer division rounded towards minus infinity, exact for any long."""
    return ((value - F.pmod(value, F.lit(by))) / F.lit(by)).cast("long")


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole elapsed days, rounded down (negative when ``later`` comes first)."""
    return floor_div(F.unix_micros(later) - F.unix_micros(earlier), DAY_US)


def week_index(time: Column) -> Column:
    """Whole weeks since 1970-01-01."""
    return floor_div(F.unix_micros(time), 7 * DAY_US).cast("int")


def completed_years(birth: Column, time: Column) -> Column:
    """Completed years between two timestamps, time of day included."""
    years = F.year(time) - F.year(birth)
    anniversary = birth + F.make_ym_interval(years, F.lit(0))
    return (years - F.when(time < anniversary, 1).otherwise(0)).cast("int")


def age_at(birth: Column, time: Column) -> Column:
    """Age by (month, day) only; -1 where either side is missing."""
    years = F.year(time) - F.year(birth)
    early = F.month(time) * 100 + F.dayofmonth(time) < F.month(birth) * 100 + F.dayofmonth(birth)
    return F.coalesce(years - F.when(early, 1).otherwise(0), F.lit(-1)).cast("int")


def to_epoch(time: Column) -> Column:
    """Seconds since 1970 in UTC, for dates and timestamps."""
    return F.unix_micros(time.cast("timestamp")) / F.lit(1e6)


def time_token(days: Column, kind: str) -> Column:
    """Name of the token that stands for a gap of ``days``; NULL for kind ``none``."""
    d = F.greatest(days.cast("long"), F.lit(0).cast("long"))

    def named(unit: str, n: Column) -> Column:
        return F.concat(F.lit(unit), n.cast("string"))

    weeks, months = F.floor(d / 7), F.floor(d / 30)
    if kind == "week_month":
        clamped = F.least(F.greatest(months, F.lit(1)), F.lit(11))
        return F.when(d < 28, named("W", weeks)).when(d <= 365, named("M", clamped)).otherwise(F.lit("LT"))
    if kind == "day":
        return named("D", d)
    if kind == "week":
        return named("W", weeks)
    if kind == "month":
        return named("M", months)
    if kind == "mix":
        return (
            F.when(d < 7, named("D", d))
            .when(d < 28, named("W", weeks))
            .when(d <= 365, named("M", months))
            .otherwise(F.lit("LT"))
        )
    if kind == "none":
        return F.lit(None).cast("string")
    raise ValueError(f"unknown time token kind {kind!r}; one of {TIME_TOKEN_KINDS}")


def is_time_token(token: Column) -> Column:
    return token.rlike(r"^[DWMY]\d+") | (token == "LT") | token.startswith("VS-") | (
        token.startswith("i-") & ~token.startswith("i-H")
    )


def token_days(token: Column, strict: bool = False) -> Column:
    """Days a time token stands for. Prefixed tokens read their number as days whatever the unit letter.

    Anything else is NULL, or an error when ``strict``.
    """
    plain = F.regexp_extract(token, r"^[DWMY](\d+)$", 1)
    factor = F.element_at(F.create_map(*[F.lit(x) for kv in UNIT_DAYS.items() for x in kv]), F.substring(token, 1, 1))
    prefixed = token.startswith("VS-") | token.startswith("i-")
    part = F.split(token, "-")
    second = F.get(part, F.lit(1))
    number = F.regexp_extract(second, r"^.(\d+)$", 1)
    days = (
        F.when(plain != "", plain.cast("long") * factor)
        .when(token == "LT", F.lit(LONG_TERM_DAYS))
        .when(prefixed & second.startswith("LT"), F.lit(LONG_TERM_DAYS))
        .when(prefixed & (number != ""), number.cast("long"))
    )
    if strict:
        return F.coalesce(days, F.raise_error(F.concat(F.lit("invalid time token: "), token)).cast("long"))
    return days.cast("long")
