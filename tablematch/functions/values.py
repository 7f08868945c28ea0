"""Cell values: canonical form, amounts, dates. All native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from tablematch.config import STRICT_NUMBER_PATTERN

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_PLAIN_NUMBER = r"^(-?[1-9][0-9]{0,17}|0)(\.[0-9]{1,12})?$"
_AMOUNT = r"-?([0-9]+\.?[0-9]*|\.[0-9]+)"
_CLOCK = r"([T ]([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?( ?([AaPp][Mm]|Z|[+-][0-9]{2}:?[0-9]{2}))?)?$"
_ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_NUMERIC_DATE = r"^([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})" + _CLOCK
_MONTHS = (
    "(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sep(t(ember)?)?"
    "|oct(ober)?|nov(ember)?|dec(ember)?)"
)
_NAMED_DATE = r"(?i)^([0-9]{1,2}[- ]" + _MONTHS + r"|" + _MONTHS + r"[- ][0-9]{1,2}),?[- ][0-9]{4}" + _CLOCK
_MONTH_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"
CANON_SCALE = "decimal(38,12)"
#: Characters of the shortest date, such as 1/1/2024.
_SHORTEST_DATE = 8


def as_text(c: Column, data_type: T.DataType | None = None) -> Column:
    """Cell as trimmed text, null as ''. Fractional numbers lose trailing zeros, nothing else."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        plain = _strip_zeros(c.try_cast(CANON_SCALE).cast("string"))
        text = F.when((c == 0) | (F.abs(c) >= 1e-6), F.coalesce(plain, c.cast("string"))).otherwise(c.cast("string"))
    else:
        text = c.cast("string")
    return F.coalesce(F.trim(text), F.lit(""))


def _strip_zeros(text: Column) -> Column:
    return F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)


def _bare_number(t: Column) -> Column:
    bare = F.translate(t, ",", "")
    return F.trim(F.when(bare.startswith("$"), F.substring(bare, 2, 2147483647)).otherwise(bare))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` computed once: an array of one element is mapped over. Without it, every mention of the
    value repeats its whole expression, and generated code grows past what the compiler takes."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _read_date(t: Column) -> Column:
    def numeric(part: Column) -> Column:
        mdy = F.concat_ws("-", part[2], part[0], part[1]).try_cast("date")
        dmy = F.concat_ws("-", part[2], part[1], part[0]).try_cast("date")
        return F.when(F.length(part[0]) == 4, F.concat_ws("-", part).try_cast("date")).otherwise(F.coalesce(mdy, dmy))

    def month_number(name: Column) -> Column:
        start = F.instr(F.lit(_MONTH_STARTS), F.lower(F.substring(name, 1, 3)))
        return F.floor((start + F.lit(2)) / F.lit(3)).cast("string")

    def named(part: Column) -> Column:
        day_first = part[0].rlike("^[0-9]")
        day, month = F.when(day_first, part[0]).otherwise(part[1]), F.when(day_first, part[1]).otherwise(part[0])
        return F.concat_ws("-", part[2], month_number(month), day).try_cast("date")

    return F.when(t.rlike(_ISO_DATE), t.try_cast("date")).when(t.rlike(_NUMERIC_DATE), bind(F.slice(F.split(t, "[-/. T]"), 1, 3), numeric)).when(
        t.rlike(_NAMED_DATE), bind(F.split(t, "[-, ]+"), named)
    )


def parse_date(c: Column) -> Column:
    """Date of a text in one of the accepted formats (year first, month/day/year with day/month/year as the second
    reading, or a month name), else null. A pattern test guards each cast, so plain texts cost two regexes."""
    t = F.trim(c.cast("string"))
    return F.coalesce(F.when(t.rlike(_ISO_DATE), t.try_cast("date")), bind(t, _read_date))


def canonical(c: Column) -> Column:
    """Tagged comparison form of a cell: '', 'number:…', 'date:…' or 'text:…'."""

    def number(bare: Column) -> Column:
        return F.when(
            bare.rlike(_NUMBER),
            F.concat(F.lit("number:"), F.coalesce(bind(bare.try_cast(CANON_SCALE).cast("string"), _strip_zeros), bare)),
        )

    def other(t: Column) -> Column:
        day = F.when(F.length(t) >= _SHORTEST_DATE, F.concat(F.lit("date:"), _read_date(t).cast("string")))
        return F.coalesce(day, F.concat(F.lit("text:"), F.lower(t)))

    # what most cells hold comes first, as generated code: plain numbers without a decimal, dates as they are written in the
    # result, and words without a digit (neither a number nor a date); only other cells go through the lambdas
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    iso = (F.length(t) == 10) & t.rlike(_ISO_DATE) & t.try_cast("date").isNotNull()
    rest = bind(t, lambda x: F.coalesce(bind(_bare_number(x), number), other(x)))
    return (
        F.when(t == "", F.lit("")).when(t.rlike(_PLAIN_NUMBER), F.concat(F.lit("number:"), _strip_zeros(t)))
        .when(iso, F.concat(F.lit("date:"), t)).when(~t.rlike("[0-9]"), F.concat(F.lit("text:"), F.lower(t))).otherwise(rest)
    )


def canonical_kind(canon: Column) -> Column:
    return F.when(canon == "", F.lit("blank")).otherwise(F.substring_index(canon, ":", 1))


def display_value(c: Column) -> Column:
    """Dates as ISO text, anything else unchanged."""
    return F.coalesce(parse_date(c).cast("string"), c.cast("string"))


def day_of(c: Column) -> Column:
    """ISO day of a cell or 'Undated'."""
    return F.coalesce(parse_date(c).cast("string"), F.lit("Undated"))


def clean_amount(c: Column, result: str = "decimal(18,2)") -> Column:
    """Amount of a text: currency signs and noise dropped, parentheses negate, unreadable is null."""
    t = F.trim(c.cast("string"))
    bare = F.regexp_replace(t, r"[^0-9.\-]", "")
    value = F.when(bare.rlike(f"^{_AMOUNT}$"), bare.try_cast(result))
    # most cells are nothing but a number, which needs neither the replacement nor the test for parentheses
    return (
        F.when(t.rlike(rf"^{_AMOUNT}\z"), t.try_cast(result))
        .when(t.startswith("(") & t.endswith(")"), -F.abs(value)).otherwise(value)
    )


def strict_number(c: Column) -> Column:
    """Number of a text that is nothing but a number (one leading $ and commas allowed), else null."""
    bare = F.translate(F.trim(c.cast("string")), ",", "")
    bare = F.when(bare.startswith("$"), F.substring(bare, 2, 2147483647)).otherwise(bare)
    return F.when(bare.rlike(STRICT_NUMBER_PATTERN), bare.try_cast("decimal(38,6)"))


def lenient_amount(c: Column, result: str = "decimal(18,2)") -> Column:
    """Amount with $ and commas dropped; whatever cannot be read counts as 0."""
    bare = F.trim(F.translate(c.cast("string"), "$,", ""))
    return F.coalesce(F.when(bare.rlike(_NUMBER), bare.try_cast(result)), F.lit(0).cast(result))


def within_tolerance(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= F.lit(str(tolerance)).cast("decimal(18,6)")


def signed_difference(source: Column, target: Column, has_source: Column, has_target: Column) -> Column:
    """Source minus target; a one-sided row contributes its own amount with the side's sign."""
    return F.when(has_source & has_target, source - target).when(has_source, source).when(has_target, -target)


def percent(part: Column, whole: Column) -> Column:
    """Part of whole in percent, one decimal, 0 when there is no whole."""
    share = part.cast("double") * F.lit(100.0) / F.nullif(whole.cast("double"), F.lit(0.0))
    return F.coalesce(F.round(share, 1), F.lit(0.0))
