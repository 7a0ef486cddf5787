"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creekline.functions import fixed_values as fixed

WHITESPACE = " \t\n\r\f\x0b"
POSITIVE_INFINITY = float("inf")


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.when(strip(text) != "", text)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(POSITIVE_INFINITY))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def finite_or_null(value: Column) -> Column:
    return F.when(is_finite(value), value)


def to_number(text: Column) -> Column:
    """Plain decimal text to a finite double, NULL otherwise.

    The pattern comes first because a bare cast also takes '1.0d', '2f' and 'inf'. Nearly all
    cells match the short pattern, whose values are finite, so each is matched and cast once.
    """
    clean = strip(text)
    number = clean.try_cast("double")
    return F.when(clean.rlike(fixed.SHORT_NUMBER_PATTERN), number).when(
        clean.rlike(fixed.NUMBER_PATTERN), finite_or_null(number)
    )


def to_sample_time(text: Column) -> Column:
    """Month/day/year with a time and a fraction of a second; anything else is NULL."""
    return F.when(
        text.rlike(fixed.SAMPLE_TIME_PATTERN), F.try_to_timestamp(text, F.lit("M/d/yyyy H:m:s.SSSSSS"))
    )


def to_sample_date(text: Column) -> Column:
    return F.to_date(to_sample_time(text))


def day_number(date: Column) -> Column:
    return F.unix_date(date)


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Tolerance relative to ``b``."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def divide(a: Column, b: Column) -> Column:
    """NULL when the denominator is zero or NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent_gain(error: Column, base: Column) -> Column:
    return divide(F.lit(100.0) * (base - error), base)


def null_if_outside(value: Column, low: float, high: float) -> Column:
    return F.when(value.between(low, high), value)


def text_key(text: Column) -> Column:
    """Letters and digits only, lower case: for finding candidates, never for merging."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def season(date: Column) -> Column:
    month = F.month(date)
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .when(month.isin(9, 10, 11), "autumn")
    )


def history_age_bucket(age: Column) -> Column:
    return (
        F.when((age > 0) & (age <= 35), "10–35 days")
        .when((age > 35) & (age <= 60), "36–60 days")
        .when((age > 60) & (age <= 120), "61–120 days")
    )


def event_group(event: Column) -> Column:
    return F.when(event == 1, "historical_tail_event").otherwise("ordinary_result")


def month_angle(date: Column) -> Column:
    return F.lit(2.0) * F.pi() * F.month(date) / F.lit(12.0)


def three_digits(value: Column) -> Column:
    """Three significant digits with trailing zeros dropped: 16.0 as 16, 1234 as 1.23e+03."""
    scientific = F.format_string("%.2e", value)
    power = F.regexp_extract(scientific, r"e([+-][0-9]+)$", 1).cast("int")
    plain = F.format_string("%.2f", value)
    for digits in range(-4, 3):
        plain = F.when(power == digits, F.format_string(f"%.{2 - digits}f", value)).otherwise(plain)
    trimmed = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    exponent = F.regexp_replace(scientific, r"\.?0+e", "e")
    return F.when(power.between(-4, 2), trimmed).otherwise(exponent)
