"""From raw grids to buckets, and row pairs from a profile."""

import pytest
from pyspark.sql import functions as F

from tablematch.functions.values import clean_amount
from tablematch.operators import align as al
from tablematch.operators.ledger_run import FieldsNotMapped, compare_grids
from tablematch.sources import catalog as ct
from tablematch.sources.readers import read_grid
from tablematch.streaming.compare import compare_rows


def grid(spark, path, lines):
    path.write_text("\n".join(lines) + "\n")
    return read_grid(spark, str(path))


def test_buckets_and_pages(spark, tmp_path):
    s = grid(spark, tmp_path / "s.csv", ["Export,,,", "Ref No,Type,Issue Date,Grand Total", "Reference,Type,Date,Amount",
             "1,INV,2024-01-01,10.00", "2,INV,2024-01-02,$5", "2,INV,2024-01-03,5", "3,INV,2024-01-04,7", "4,INV,2024-01-04,9", ",INV,2024-01-05,1", "6,INV,2024-01-06,n/a"])
    t = grid(spark, tmp_path / "t.csv", ["Invoice,Doc Type,Amount Due,Client", "1,INV,10,Acme", "2,INV,11,Acme", "3-1,INV,7,Acme", "8,INV,1,Acme", "8,INV,2,Acme"])
    run = compare_grids(s, t)
    totals = {r.bucket: r.total for r in run.totals().collect()}
    assert totals == {
        "matched": 1, "disputed": 1, "unmatched_source": 1, "unmatched_target": 1, "tier2_rows": 1, "duplicate_source_rows": 2,
        "duplicate_target_rows": 2, "source_exceptions": 2, "target_exceptions": 0,
    }
    assert [r.TxnNumber_Source for r in run.page("unmatched_source").items.collect()] == ["4"]
    page = run.page("duplicate_source_rows", text="2024-01-03")
    assert page.total == 1 and page.items.first()["TxnNumber"] == "2"
    assert run.page("source_exceptions", sort_by="reason").items.count() == 2
    assert [m.column for m in run.mappings["target"] if m.field == "TxnNumber"] == ["Invoice"]
    with pytest.raises(KeyError):
        run.page("other")


def test_required_fields(spark, tmp_path):
    s = grid(spark, tmp_path / "s.csv", ["Ref No,Something", "1,2"])
    t = grid(spark, tmp_path / "t.csv", ["Number,Amount", "1,2"])
    with pytest.raises(FieldsNotMapped) as failed:
        compare_grids(s, t)
    assert failed.value.missing == {"source": ["Amount"]} and set(failed.value.mappings) == {"source", "target"}
    # the other way to a field is an override
    assert compare_grids(s, t, source_overrides={"Amount": "Something"}).page("matched").total == 1


def test_saved_row_pairs(spark, tmp_path):
    s = spark.createDataFrame([(0, "a", "1"), (1, "b", "2"), (2, "c", "3")], "_rid long, name string, amount string")
    t = spark.createDataFrame([(0, "b", "2"), (1, "a", "5")], "_rid long, name string, amount string")
    path = str(tmp_path / "p")
    pairs = lambda *rows: spark.createDataFrame(rows, "source_rid long, target_rid long")
    assert [ct.save_row_pairs(pairs((0, 0)), path, "x"), ct.save_row_pairs(pairs((0, 1), (1, 0)), path, "x")] == [1, 2]
    compared, summary = compare_rows(s, t, ct.row_pairs(ct.load_profile(spark, path, "x")))
    assert {(r.source_rid, r.status) for r in compared.collect()} == {(0, "MISMATCHED"), (1, "MATCHED")}
    assert {r.metric: r.value for r in summary.collect()}["unmapped_source_count"] == 1
    for bad, why in (((0, 7), "does not exist"), ((None, 0), "needed")):
        with pytest.raises(ValueError, match=why):
            compare_rows(s, t, pairs((1, 1), bad))
    with pytest.raises(ValueError, match="no row pairs"):
        compare_rows(s, t, pairs((0, 0)).limit(0))


def test_a_grid_is_read_once(spark, tmp_path):
    """header, mapping, comparison and buckets use what one read of each side has written."""
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        reads.add(1)
        return x

    lines = ["Export,,", "Invoice No,Type,Amount", *[f"{i},INV,{i}.50" for i in range(8)]]
    sides = [grid(spark, tmp_path / f"{x}.csv", lines) for x in "st"]
    run = compare_grids(*[g.withColumn("_c0", seen("_c0")) for g in sides])
    assert {r.bucket: r.total for r in run.totals().collect()}["matched"] == 8
    assert reads.value == 2 * len(lines)


def counting(spark):
    """A column function that leaves a text as it is, and the counter of the texts that it was computed for."""
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        reads.add(1)
        return x

    return seen, reads


def test_only_unclaimed_columns_are_validated(spark):
    """no value of a column that a header word has claimed is read to find another field."""
    seen, reads = counting(spark)
    rows = spark.createDataFrame([(f"N{i}", f"2024-01-{i + 10}", str(i)) for i in range(9)], "ref string, x string, note string")
    fields = {"TxnNumber": ["ref"], "Currency": ["cur"], "TxnDate": ["date"], "Amount": ["note"], "DueDate": ["due"]}
    found = al.map_columns(rows.columns, fields, df=rows.withColumn("ref", seen("ref")))
    assert {m.field: m.column for m in found} == {"TxnNumber": "ref", "Currency": None, "TxnDate": "x", "Amount": "note", "DueDate": None}
    assert reads.value == 0
    # with every column claimed there is nothing to read at all
    seen, reads = counting(spark)
    al.map_columns(["ref", "x"], {"TxnNumber": ["ref"], "TxnType": ["x"], "DueDate": ["due"]}, df=rows.select(*[seen(c).alias(c) for c in ("ref", "x")]))
    assert reads.value == 0
    # later fields find theirs in the values read for the first
    late = al.map_columns(["x", "note"], {"PONumber": ["po"], "DueDate": ["due"], "Amount": ["sum"]}, df=rows)
    assert [(m.column, m.method, m.status) for m in late] == [
        (None, "datatype_validation", "REVIEW_REQUIRED"), ("x", "datatype_validation", "MAPPED"), ("note", "datatype_validation", "MAPPED")]


def test_second_header_is_looked_for_at_the_top(spark):
    """only the leading rows are read, and all rows when these are gone."""
    words = {"TxnNumber": ["invoice"], "Amount": ["amount"]}
    rows = spark.range(4000).select(F.when(F.col("id") % 2000 == 500, "Invoice").otherwise("7").alias("a"), F.when(F.col("id") % 2000 == 500, "Amount").otherwise("8").alias("b"), F.col("id").alias("_rid"))
    seen, reads = counting(spark)
    kept = lambda df: {r._rid for r in al.drop_repeated_header(df, words).select("_rid").collect()}
    assert kept(rows.where("_rid >= 500").withColumn("a", seen("a"))) == set(range(501, 4000))
    assert reads.value <= 500
    assert kept(rows.where("_rid >= 2500")) == set(range(2501, 4000))
    assert kept(rows.where("_rid > 2500")) == set(range(2501, 4000))
    assert kept(rows.where("_rid < 0")) == set()


def test_totals_come_from_the_groups(spark, tmp_path):
    """the totals of the pages and of the rows that share a key take one pass over the groups, no second join of the lines."""
    head = "Invoice No,Type,Amount"
    s = [f"{n},{t},{a}" for n, t, a in [("1", "INV", 5), ("1", "INV", 6), ("1", "CR", 7), ("2-1", "INV", 1), ("2-1", "INV", 1), ("3", "INV", 2), ("4-1", "INV", 3), ("4-2", "INV", 3), ("4-2", "INV", 3), ("", "INV", 9), ("", "INV", 9), (" 3", "INV", 2), ("5", "", 1), ("5", "", 1)]]
    t = [f"{n},{t},{a}" for n, t, a in [("1", "INV", 11), ("2", "INV", 1), ("2", "INV", 1), ("2", "INV", 0), ("4", "INV", 3), ("4", "INV", 3), ("9", "INV", 8), ("9", "CR", "x"), ("9", "CR", "x")]]
    for k, lines in enumerate(((s, t), (s, t[:1]), (s[2:3], t[:1]))):
        run = compare_grids(*[grid(spark, tmp_path / f"{i}{k}.csv", [head, *x]) for i, x in zip("st", lines)])
        assert "Join" not in run.totals()._jdf.queryExecution().optimizedPlan().toString()
        counts = {name: rows.count() for name, rows in run.buckets.items()}
        assert {r.bucket: r.total for r in run.totals().collect()} == counts
        for name in counts:
            assert (run.page(name).total, run.page(name, text="no such text").total) == (counts[name], 0)
            assert run.page(name, page_size=25).items.count() == counts[name]
    assert counts["duplicate_source_rows"] == 0


def test_amounts_that_are_nothing_but_a_number(spark):
    """the short way gives what the long way gives."""
    texts = ["12", "-3.", ".5", "-.5", " 7.005 ", "12\n", "1.2.3", "1-2", "--1", "-", ".", "", "  ", "(5)", "(-5)", "$1,234.50", "5 EUR", "+4", "007", "1e3", "99999999999999999999", "\u0663", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    long = F.regexp_replace(F.trim("x"), r"[^0-9.\-]", "")
    long = F.when(long.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), long.try_cast("decimal(18,2)"))
    long = F.when(F.trim("x").startswith("(") & F.trim("x").endswith(")"), -F.abs(long)).otherwise(long)
    got = rows.orderBy("i").select(clean_amount(F.col("x")).alias("a"), long.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
    assert [str(r.a) for r in got[:5]] == ["12.00", "-3.00", "0.50", "-0.50", "7.01"]
