"""Comparisons on small tables: the known cases, invariants, hot keys."""

import collections
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tablematch.config import DEFAULTS
from tablematch.operators import ledger as lg
from tablematch.operators import rowpairs as rw
from tablematch.operators.cells import changed_columns
from tablematch.operators.clean import normalize
from tablematch.operators.insights import clusters, narrative
from tablematch.operators.days import day_summary
from tablematch.operators.lines import compare_lines
from tablematch.operators.master import compare_master
from tablematch.operators.schema_match import column_signals, recommend, suggested_key

SMALL = replace(DEFAULTS, hot_group_rows=3)


def frame(spark, columns, rows):
    typed = ", ".join(f"{c} string" for c in columns)
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{typed}, _rid long")


# ---- known cases --------------------------------------------------------------------------------------------------


def test_suggested_keys_of_differently_named_tables(spark):
    s = spark.createDataFrame(
        [("501", "Ada Byron", "+441632960001", 120.5, 0), ("502", "Max Born", "+441632960002", 80.0, 1),
         ("503", "Emmy Noether", "+441632960003", 99.9, 2), ("504", "Karl Gauss", "+441632960004", 42.0, 3)],
        "client_identifier string, person_full_name string, telephone string, purchase_value double, _rid long",
    )
    t = s.toDF("cust_number", "customer", "mobile_contact", "transaction_amount", "_rid")
    assert suggested_key(s) == "client_identifier"
    assert suggested_key(t) == "cust_number"
    got = {r.source_column: r.recommended_target for r in recommend(column_signals(s, t)).collect()}
    assert got == dict(zip(s.columns[:4], t.columns[:4]))


def test_suggested_keys_of_staff_tables(spark):
    rows = [("W-7", "Sales", "2020-03-01", 51000, 0), ("W-8", "Legal", "2019-11-15", 64000, 1), ("W-9", "Sales", "2023-07-30", 48000, 2)]
    s = spark.createDataFrame(rows, "worker_code string, division string, hire_date string, compensation int, _rid long")
    assert suggested_key(s) == "worker_code"
    assert suggested_key(s.toDF("employee_number", "department_name", "joining_date", "annual_salary", "_rid")) == "employee_number"


def test_row_pairs(spark):
    schema = "name string, place string, units int, _rid long"
    s = spark.createDataFrame([("Oak", "Bonn", 7, 0), ("Elm", "Ulm", 8, 1), ("Ash", "Kiel", 9, 2)], schema)
    t = spark.createDataFrame([("Ash", "Kiel", 9, 0), ("Oak", "Bonn", 7, 1), ("Elm", "Ulm", 11, 2)], schema)
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "source_rid long, target_rid long")
    assert rw.pair_errors(pairs, s, t).count() == 0
    got = {(r.source_rid, r.target_rid): r.status for r in rw.compare_row_pairs(s, t, pairs).collect()}
    assert got == {(0, 1): "MATCHED", (1, 2): "MISMATCHED", (2, 0): "MATCHED"}


def test_name_lookup_with_city_tie_break(spark):
    s = frame(spark, ["entity", "city"], [("Oak & Co", "Bonn"), ("Elm Ltd.", "Ulm"), ("Ash AG", "Kiel"), ("Fir KG", "Trier")])
    t = frame(spark, ["party", "town"], [("ELM LTD", "Bonn"), ("Oak Co", "Bonn"), ("Ash AG", "Hof"), ("Elm Ltd", "Ulm")])
    got = {r.source_rid: (r.method, r.target_rid) for r in rw.lookup_names(s, t, "entity", "party", "city", "town").collect()}
    assert got == {0: ("Name Only", 1), 1: ("Name+City", 3), 2: ("Name Only", 2), 3: ("NO MATCH", None)}


# ---- master -------------------------------------------------------------------------------------------------------


def test_master_by_hand(spark):
    s = frame(spark, ["id", "amount", "d", "old"], [("1", "10", "2024-01-01", "x"), ("2", "20", "2024-01-02", "x"), ("3", "30", "", "x"), ("3", "31", "", "x"), ("", "5", "", "x"), ("Alpha Project", "7", "", "x"), ("9", "1", "", "x"), ("9", "2", "", "x")])
    t = frame(spark, ["id", "amount", "d", "new"], [("1", "$10.00", "01/01/2024", "y"), ("2", "21", "2024-01-02", "y"), ("3", "30", " ", "y"), ("", "5", "", "y"), ("Project Alpha", "7", "", "y"), ("8", "3", "", "y")])
    c = compare_master(normalize(s), normalize(t), ["id"], date="d")
    got = sorted((r.id, r.status, tuple(r.changed)) for r in c.rows.select("id", "status", changed_columns().alias("changed")).collect())
    assert got == sorted([
        ("1", "Format Only", ("amount", "d")), ("2", "Updated", ("amount",)), ("3", "Matched", ()), ("", "Matched", ()),
        ("Project Alpha", "Renamed", ()), ("9", "Deleted", ()), ("9", "Deleted", ()), ("8", "Added", ()),
    ])
    assert sorted(r.amount for r in c.duplicates_source.collect()) == ["1", "2", "30", "31"]
    assert c.layout.source_only == ["old"] and c.layout.target_only == ["new"]
    assert narrative(c, day_summary(c, "2030-01-01")).count() >= 4
    assert clusters(c.rows).count() == 0


def test_same_table_only_matches(spark):
    rows = [(str(i % 7), str(i)) for i in range(20)]
    s = normalize(frame(spark, ["k", "v"], rows))
    assert {r.status for r in compare_lines(s, s, ["k"]).rows.collect()} == {"Matched"}
    m = compare_master(s, s, ["k"])
    assert {r.status for r in m.rows.collect()} == {"Matched"}
    assert narrative(m, day_summary(m, "2030-01-01")).first().sentence.startswith("Source: ")


# ---- lines --------------------------------------------------------------------------------------------------------


def plain_lines(source, target):
    """Statuses of the line comparison by the plain rule, on (key, value) rows in file order."""
    out = []
    for key in {k for k, _ in source} | {k for k, _ in target}:
        left = [(i, v) for i, (k, v) in enumerate(source) if k == key]
        right = [(i, v) for i, (k, v) in enumerate(target) if k == key]
        rest = []
        for i, v in left:
            hit = next((j for j, w in right if float(w.strip("$")) == float(v.strip("$"))), None)
            if hit is None:
                rest.append(i)
                continue
            w = dict(right)[hit]
            right = [(j, x) for j, x in right if j != hit]
            out.append((i, hit, "Matched" if v == w else "Format Only"))
        for i, (j, _) in zip(rest, right):
            out.append((i, j, "Updated"))
        out += [(i, None, "Deleted") for i in rest[len(right):]]
        out += [(None, j, "Added") for j, _ in right[len(rest):]]
    return collections.Counter(out)


@pytest.mark.parametrize("settings", [DEFAULTS, SMALL], ids=["cold", "hot"])
def test_lines_against_the_plain_rule(spark, settings):
    rnd = random.Random(11)

    def rows(n):
        return [("big" if rnd.random() < 0.4 else f"k{rnd.randrange(6)}", rnd.choice(["1", "2", "$1", "3", "4.50", "4.5"])) for _ in range(n)]

    source, target = rows(60), rows(55)
    s, t = normalize(frame(spark, ["k", "v"], source)), normalize(frame(spark, ["k", "v"], target))
    got = compare_lines(s, t, ["k"], settings=settings).rows.select(F.col("src._rid").alias("a"), F.col("tgt._rid").alias("b"), "status")
    assert collections.Counter((r.a, r.b, r.status) for r in got.collect()) == plain_lines(source, target)
    back = compare_lines(t, s, ["k"], settings=settings).rows.groupBy("status").count().collect()
    forth = collections.Counter(st for _, _, st in plain_lines(source, target).elements())
    swapped = {r["status"]: r["count"] for r in back}
    assert swapped.get("Added", 0) == forth.get("Deleted", 0) and swapped.get("Deleted", 0) == forth.get("Added", 0)


# ---- ledger -------------------------------------------------------------------------------------------------------

LEDGER = "TxnNumber string, TxnType string, TxnDate date, Amount decimal(18,2), Customer string, _rid long"


def ledger_frame(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(n, ty, None, None if a is None else Decimal(a), c, i) for i, (n, ty, a, c) in enumerate(rows)], LEDGER)


def test_ledger_tiers_and_exceptions(spark):
    s = ledger_frame(spark, [("1", "I", "10", None), ("1", "I", "5", "Ann"), ("2", "I", "7", "Bob"), ("3-1", "I", "9", "Cid"), ("INV-1", "I", "1", "D"), ("INV-2", "I", "2", "D"), ("4", "I", "3", "E"), ("nan", "I", "1", "F"), ("5", "I", None, "G"), ("6", None, "1", "H")])
    t = ledger_frame(spark, [("1", "I", "15.01", "x"), ("2", "I", "8", "x"), ("3", "I", "9", "x"), ("INV-3", "I", "1", "x"), ("4-2", "I", "30", "x")])
    c = lg.compare_ledger(s, t)
    got = {(r.TxnNumber_Source, r.TxnNumber_Target): r.MatchStatus for r in c.groups.collect()}
    assert got == {
        ("1", "1"): "Matched", ("2", "2"): "Amount Mismatch", ("3-1", "3"): "Tier2 Match", ("4", "4-2"): "Tier2 Amount Mismatch",
        ("INV-1", None): "Only In Source", ("INV-2", None): "Only In Source", (None, "INV-3"): "Only In Target",
    }
    assert sorted(r.reason for r in c.exceptions_source.collect()) == ["blank number", "blank type", "no amount"]
    assert {r.Customer_Source for r in c.groups.where("TxnNumber_Source = '1'").collect()} == {"Ann"}
    summary = {r.metric: float(r.value) for r in lg.ledger_summary(c).collect()}
    assert summary["duplicate_keys_source"] == 2 and summary["tier2_matches"] == 2 and summary["source_exceptions"] == 3


def test_ledger_without_types_keys_on_number(spark):
    s = ledger_frame(spark, [("1", "", "10", "a"), ("2", None, "5", "b")])
    t = ledger_frame(spark, [("1", "I", "10", "a"), ("2", "C", "5", "b")])
    assert {r.MatchStatus for r in lg.compare_ledger(s, t).groups.collect()} == {"Matched"}


def test_required_fields():
    lg.require_fields({"TxnNumber": "a", "Amount": "b"})
    with pytest.raises(ValueError, match="Amount"):
        lg.require_fields({"TxnNumber": "a", "Amount": None})
