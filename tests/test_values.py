"""Cell functions on hand-picked texts."""

import pytest
from pyspark.sql import functions as F

from tablematch.functions import text as tx
from tablematch.functions import values as vl

CANON = {
    "": "", "  ": "", "1000": "number:1000", "1,000.00": "number:1000", "$1000": "number:1000", "1e3": "number:1000", "-12": "number:-12",
    ".5": "number:0.5", "0.0000": "number:0", "2024": "number:2024", "2026-11-01": "date:2026-11-01",
    "2026-11-01 00:00:00": "date:2026-11-01", "11/01/2026": "date:2026-11-01", "25/12/2024": "date:2024-12-25",
    "Nov 1, 2026": "date:2026-11-01", "1 November 2026": "date:2026-11-01", "2026-13-45": "text:2026-13-45", "12-34": "text:12-34",
    "ABC ": "text:abc", "1.2.3": "text:1.2.3", "-": "text:-", "May": "text:may", "2026-02-30": "text:2026-02-30",
}
AMOUNTS = {
    "$1,234.56": 1234.56, "(1,234.56)": -1234.56, "USD 5": 5.0, "-": None, ".": None, "1.2.3": None, "": None, "x": None, "-7.5": -7.5,
}


def apply(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def test_canonical(spark):
    assert dict(zip(CANON, apply(spark, list(CANON), vl.canonical))) == CANON


def test_clean_amount(spark):
    got = apply(spark, list(AMOUNTS), lambda c: vl.clean_amount(c).cast("double"))
    assert dict(zip(AMOUNTS, got)) == AMOUNTS


def test_null_is_blank(spark):
    assert apply(spark, [None], vl.canonical) == [""]
    assert apply(spark, [None], vl.day_of) == ["Undated"]


def test_display_value(spark):
    assert apply(spark, ["2026-11-01 00:00:00", "x 1", "2024"], vl.display_value) == ["2026-11-01", "x 1", "2024"]


def test_fractions_keep_their_digits(spark):
    df = spark.createDataFrame([(3.14,), (1000.0,), (12345678.9,), (1e-9,)], "x double")
    from pyspark.sql import types as T

    got = [r[0] for r in df.select(vl.as_text(F.col("x"), T.DoubleType())).collect()]
    assert got == ["3.14", "1000", "12345678.9", "1.0E-9"]


def test_char_grams_follow_words(spark):
    got = apply(spark, ["ab c"], tx.char_grams)[0]
    assert sorted(got) == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "])


@pytest.mark.parametrize("text,stem", [("123456-1", "123456"), ("INV-001", "INV"), ("A-1B", "A-1B"), ("7", "7")])
def test_strip_suffix(spark, text, stem):
    assert apply(spark, [text], tx.strip_suffix) == [stem]


def test_names():
    assert tx.flat_name("PARTY_NUMBER") == tx.flat_name("PartyNumber") == "partynumber"
    assert tx.spaced_name("personFull_name") == "person full name"
    assert tx.loose_name("Total-Amount x") == "totalamountx"
