"""Number, money and rate expressions. All return Columns; nothing raises on bad text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tokens that mean "no value"
MISSING_NUMBER = ["", "NA", "N/A"]
MISSING_MONEY = ["", "-", "—", "–", "N/A", "NA"]

# fixed values: minimum salary in cents for seasons before each cut-off year,
# the last amount for every later one, and the relief added to it
RELIEF_MINIMUMS = [
    (2015, 55_000_000),
    (2017, 57_500_000),
    (2019, 65_000_000),
    (2021, 70_000_000),
    (2023, 75_000_000),
    (2026, 77_500_000),
]
RELIEF_LATEST_MINIMUM = 85_000_000
RELIEF_ALLOWANCE = 37_500_000
RELIEF_FIRST_SEASON = 2013

_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_NONFINITE = r"(?i)^[+-]?(inf|infinity|s?nan[0-9]*)$"


def _numeric_text(value: Column) -> Column:
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(_NUMBER), text)


def decimal_of(value: Column) -> Column:
    """Text as decimal(38,10), null when it is not a plain finite number."""
    return _numeric_text(value).try_cast("decimal(38,10)")


def parse_number(value: Column, integer: bool = False) -> Column:
    """Missing tokens, junk and non-finite values give null; integers truncate."""
    if integer:
        return decimal_of(value).try_cast("bigint")
    number = _numeric_text(value).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def parse_strict_integer(value: Column) -> Column:
    """Integer only when the number is integral ('12.0' is 12, '12.5' and '12.00000000001' are null)."""
    number = _numeric_text(value).try_cast("double")
    return F.when(number == F.rint(number), decimal_of(value).try_cast("bigint"))


def is_missing_number(value: Column) -> Column:
    return value.isNull() | value.cast("string").isin(MISSING_NUMBER)


def _money_text(value: Column) -> Column:
    return F.regexp_replace(F.trim(value.cast("string")), r"[$, ]", "")


def _is_missing_money(value: Column) -> Column:
    return value.isNull() | F.trim(value.cast("string")).isin(MISSING_MONEY)


def parse_money_cents(value: Column, rounding: str = "half_up") -> Column:
    """Dollars text to cents; missing tokens and rejected text give null."""
    text = _money_text(value)
    amount = F.when(text.rlike(_NUMBER), text).try_cast("decimal(30,8)")
    scaled = F.bround(amount * 100, 0) if rounding == "half_even" else F.round(amount * 100, 0)
    cents = scaled.try_cast("bigint")
    return F.when(~_is_missing_money(value) & (amount >= 0), cents)


def money_error(value: Column) -> Column:
    """Why money text is rejected: malformed, nonfinite, negative, unrepresentable."""
    text = _money_text(value)
    amount = F.when(text.rlike(_NUMBER), text).try_cast("decimal(30,8)")
    return (
        F.when(_is_missing_money(value), F.lit(None).cast("string"))
        .when(text.rlike(_NONFINITE), "nonfinite")
        .when(~text.rlike(_NUMBER), "malformed")
        .when(text.startswith("-") & ~text.rlike(r"^-[0.]*([eE].*)?$"), "negative")
        .when(amount.isNull() | (amount * 100).try_cast("bigint").isNull(), "unrepresentable")
    )


def positive(value: Column) -> Column:
    """The value where it is above zero, else null (a safe divisor)."""
    return F.when(value > 0, value)


def ratio(top: Column, bottom: Column) -> Column:
    return top / positive(bottom)


def per_60(value: Column, seconds: Column) -> Column:
    return value.cast("double") * 3600.0 / positive(seconds)


def above(value: Column, baseline: Column, higher_is_better: bool = True) -> Column:
    return value - baseline if higher_is_better else baseline - value


def finite(value: Column) -> Column:
    """Infinities and NaN become null."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def share_of(part: Column, *parts: Column) -> Column:
    """part / sum(parts), missing parts counting as 0; null when the sum is 0."""
    total = sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))
    return part / positive(total)


def buried_relief_cents(season: Column) -> Column:
    """Cap relief for a contract buried in the minors, by season."""
    expr = F.when(season < RELIEF_FIRST_SEASON, 0)
    for cutoff, minimum in RELIEF_MINIMUMS:
        expr = expr.when(season < cutoff, minimum + RELIEF_ALLOWANCE)
    return expr.otherwise(RELIEF_LATEST_MINIMUM + RELIEF_ALLOWANCE).cast("bigint")


def average_cents(total: Column, term: Column) -> Column:
    return F.floor(total / positive(term).cast("decimal(10,0)")).cast("bigint")


def cash_cents(base: Column, bonus: Column) -> Column:
    """Base plus bonus; the base alone when the bonus is unknown."""
    return F.coalesce(base + bonus, base)


def cap_share(hit: Column, cap: Column) -> Column:
    """Share of the cap as decimal(9,8); null for a null or zero cap."""
    share = hit.cast("decimal(20,0)") / F.nullif(cap.cast("decimal(20,0)"), F.lit(0))
    return share.try_cast("decimal(9,8)")


def cents_to_dollars(cents: Column) -> Column:
    return cents.cast("double") / 100.0
