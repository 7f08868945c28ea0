"""Texts: keys, lookup forms, name similarity, n-grams."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablematch.config import NULL_WORDS


def key_text(columns: list[Column], separator: str = "||") -> Column:
    """Key cells trimmed and joined. `||` for keys, ' ' for similarity, ' | ' in snapshots."""
    return F.concat_ws(separator, *[F.coalesce(F.trim(c.cast("string")), F.lit("")) for c in columns])


def row_text(names: list[str]) -> Column:
    """`name: value; name: value` of a row."""
    return F.concat_ws("; ", *[F.concat(F.lit(f"{n}: "), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in names])


def lookup_text(c: Column) -> Column:
    """Letters and digits only, lower case; null as ''."""
    return F.coalesce(F.regexp_replace(F.lower(c.cast("string")), "[^a-z0-9]", ""), F.lit(""))


def strip_suffix(c: Column) -> Column:
    """Number without its trailing '-digits'."""
    return F.regexp_replace(c, "-[0-9]+$", "")


def null_like(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*NULL_WORDS)


def flat_name(name: str) -> str:
    """Column name reduced to lower-case letters and digits."""
    return re.sub(r"[^a-z0-9]", "", str(name).lower())


def loose_name(name: str) -> str:
    """Column name without blanks, underscores and hyphens, lower case."""
    return str(name).lower().replace(" ", "").replace("_", "").replace("-", "")


def spaced_name(name: str) -> str:
    """Column name as lower-case words; camelCase is split."""
    split = re.sub(r"([a-z])([A-Z])", r"\1 \2", str(name))
    return " ".join(re.sub(r"[^a-zA-Z0-9\s]", " ", split).lower().split())


def name_ratio(a: str, b: str) -> float:
    """Share of characters that two names have in matching blocks."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def name_ratios(spark: SparkSession, left: list[str], right: list[str]) -> DataFrame:
    """(left_name, right_name, ratio) for the column names of two tables; as small as their schemas."""
    rows = [(a, b, name_ratio(spaced_name(a), spaced_name(b))) for a in left for b in right]
    return spark.createDataFrame(rows, "left_name string, right_name string, ratio double")


def contained_boost(ratio: float, a: str, b: str, floor: float, min_length: int = 1) -> float:
    """Raise the ratio to `floor` when one name contains the other."""
    if len(b) >= min_length and a and b and (a in b or b in a):
        return max(ratio, floor)
    return ratio


def token_overlap(left: Column, right: Column) -> Column:
    """Shared words of two names over all their words."""
    a, b = F.array_remove(F.split(left, " "), ""), F.array_remove(F.split(right, " "), "")
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def confidence_band(score: Column) -> Column:
    return (
        F.when(score >= 0.85, "VERY HIGH").when(score >= 0.70, "HIGH").when(score >= 0.50, "NEEDS REVIEW").otherwise("LOW")
    )


def char_grams(c: Column, low: int = 2, high: int = 4) -> Column:
    """All character n-grams of each word, the word padded with one blank on both sides."""
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 0)

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)

        def of_length(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1)))
            grams = F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))
            return F.when(size >= n, grams).otherwise(F.array().cast("array<string>"))

        return F.concat(*[of_length(n) for n in range(low, high + 1)])

    return F.flatten(F.transform(words, of_word))
