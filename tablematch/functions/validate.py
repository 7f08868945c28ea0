"""Datatype validators over a column: each returns the share of values that fit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tablematch.config import CURRENCY_PATTERN, DEFAULTS, EMAIL_PATTERN, IDENTIFIER_PATTERN, PHONE_PATTERN, Settings
from tablematch.functions.values import parse_date


def is_email(c: Column) -> Column:
    return c.rlike(EMAIL_PATTERN)


def is_phone(c: Column) -> Column:
    return c.rlike(PHONE_PATTERN) & (F.length(F.regexp_replace(c, "[^0-9]", "")) >= 7)


def is_currency(c: Column) -> Column:
    return c.rlike(CURRENCY_PATTERN)


def is_identifier(c: Column) -> Column:
    return c.rlike(IDENTIFIER_PATTERN)


def is_date(c: Column) -> Column:
    return parse_date(c).isNotNull()


def is_numeric(c: Column) -> Column:
    bare = F.regexp_replace(c, r"[^0-9.\-]", "")
    return bare.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$")


def share(test: Column) -> Column:
    """Average of a test; an aggregate expression."""
    return F.avg(test.cast("int"))


def validator_scores(c: Column, settings: Settings = DEFAULTS) -> dict[str, Column]:
    """Aggregate expressions, one per validator, over the non-blank values of `c`."""
    n = F.count(c)
    unique = F.count_distinct(c) / F.nullif(n, F.lit(0))
    enough = n >= settings.validator_min_samples
    identifier = F.when((unique >= settings.id_uniqueness) & (share(is_identifier(c)) >= settings.id_charset), unique)
    scores = {
        "date": share(is_date(c)),
        "numeric": share(is_numeric(c)),
        "email": share(is_email(c)),
        "phone": share(is_phone(c)),
        "currency": share(is_currency(c)),
        "identifier": identifier,
    }
    return {k: F.coalesce(F.when(enough, v), F.lit(0.0)) for k, v in scores.items()}
