"""Scans, alignment, detection, paging, stores, streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from tablematch.config import DEFAULTS
from tablematch.operators import align as al
from tablematch.operators import profile as pf
from tablematch.operators import search as se
from tablematch.sources import catalog as ct
from tablematch.sources import readers as rd
from tablematch.sources.ordinal import with_ordinal
from tablematch.streaming.compare import follow, store_version
from tablematch.vocabulary import default_vocabulary


def test_ordinal_is_file_order(spark, tmp_path):
    n = 0
    for name, rows in (("b", 700), ("a", 30), ("c", 5000)):
        (tmp_path / f"{name}.csv").write_text("v\n" + "".join(f"{name}{i:05d}\n" for i in range(rows)))
        n += rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        rows = with_ordinal(spark.read.option("header", True).csv(str(tmp_path))).orderBy("_rid").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["_rid"] for r in rows] == list(range(n))
    assert [r.v for r in rows] == sorted(r.v for r in rows)


def test_grid_with_banner_and_second_header(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text("Export,,,\nInvoice No,Invoice Date,Invoice Amount,\ninvoiceid,date,amount,\n7,2024-01-05,\"$1,000.50\",\n,,,\n8,05 Jan 2024,(3),\n")
    table, decisions = al.load_and_map(rd.read_grid(spark, str(path)), default_vocabulary()["transactional"])
    rows = sorted((r.TxnNumber, str(r.TxnDate), float(r.Amount)) for r in table.collect())
    assert rows == [("7", "2024-01-05", 1000.5), ("8", "2024-01-05", -3.0)]
    assert {d.field: d.method for d in decisions}["Currency"] == "NOT_FOUND"


def test_ambiguous_datatype_needs_review(spark):
    df = spark.createDataFrame([(f"2024-01-{i:02d}", f"2024-02-{i:02d}", i) for i in range(1, 9)], "a string, b string, _rid long")
    found = {d.field: d for d in al.map_columns(["a", "b"], {"TxnDate": ["date"], "Status": ["status"]}, df=df)}
    assert found["TxnDate"].status == "REVIEW_REQUIRED" and found["TxnDate"].candidates == ["a", "b"]
    assert found["Status"].status == "NOT_FOUND"


def test_a_column_is_claimed_once():
    found = al.as_mapping(al.map_columns(["ref"], {"A": ["ref"], "B": ["ref"]}))
    assert found == {"A": "ref", "B": None}


def test_renames():
    assert al.equivalent_renames(["PartyNumber", "x"], ["PARTY_NUMBER", "Party-Number", "X"]) == {"X": "x"}
    assert al.similar_renames(["Address1_original"], ["ADDRESS1", "zip"]) == [("ADDRESS1", "Address1_original", 0.85)]


def test_key_and_type_choice(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2")], "status string, invoice_no string")
    assert pf.guess_key_columns(df, df) == ["invoice_no"]
    assert pf.resolve_data_type("auto", df, df, ["invoice_no"]) == "master"
    assert pf.resolve_data_type("auto", df, df, ["status"]) == "transactional"
    with pytest.raises(ValueError):
        pf.resolve_data_type("other", df, df, ["status"])


def test_file_type(spark):
    rows = [(str(i), f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}", str(i * 1.5), f"c{i % 3}") for i in range(60)]
    txn = spark.createDataFrame(rows, "invoice_no string, due_date string, amount string, customer string")
    assert pf.detect_file_type(txn, default_vocabulary())["type"] == "transactional"
    master = spark.createDataFrame([(f"Name {i % 9}", "x") for i in range(40)], "account_name string, tax_id string")
    assert pf.detect_file_type(master, default_vocabulary())["type"] == "master"


def test_page_sizes_and_deep_pages(spark):
    from dataclasses import replace

    assert [se.snap_page_size(s) for s in (None, "x", 30, 60, 1000, 25)] == [50, 50, 25, 50, 250, 25]
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3) for i in range(120)], "_rid long, v int")
    for descending in (False, True):
        near = se.paginate(df, 3, 25, "v", descending)
        deep = se.paginate(df, 3, 25, "v", descending, settings=replace(DEFAULTS, top_rows=10))
        assert (near.total, near.total_pages) == (120, 5)
        assert [r["_rid"] for r in near.items.collect()] == [r["_rid"] for r in deep.items.orderBy(F.col("v").desc_nulls_first() if descending else F.col("v").asc_nulls_last(), "_rid").collect()]
    assert se.paginate(df, 99, 50).page == 3


def test_profile_store_versions(spark, tmp_path):
    path = str(tmp_path / "profiles")
    assert ct.save_profile(spark, path, "erp", "HEADER_COLUMN", [{"source_column": "a", "target_column": "b"}]) == 1
    assert ct.save_profile(spark, path, "erp", "HEADER_COLUMN", [{"source_column": "a", "target_column": "c"}]) == 2
    assert [r.target_column for r in ct.load_profile(spark, path, "erp").collect()] == ["c"]
    with pytest.raises(ValueError):
        ct.save_profile(spark, path, "erp", "OTHER", [])


def orders(spark, changes):
    rows = {i: ("x", str(i * 10)) for i in range(1, 6)}
    rows.update(changes)
    return spark.createDataFrame([(str(k), *v, k) for k, v in rows.items() if v], "order_id string, status string, amount string, _rid long")


def test_repeated_stream_batch_writes_one_version(spark, tmp_path):
    store = ct.VersionStore(spark, str(tmp_path / "store"))
    at = datetime.datetime(2024, 1, 1)
    assert store_version(store, "s", orders(spark, {}), "f0", at, batch_id=0, data_type="master") == 0
    for _ in range(2):
        assert store_version(store, "s", orders(spark, {1: ("y", "10"), 2: None}), "f1", at, batch_id=1, data_type="master", similar=False) == 1
    versions = store.versions().orderBy("version").collect()
    assert [(v.version, v.label, v.updated, v.deleted) for v in versions] == [(0, "Source", None, None), (1, "Day 1", 1, 1)]
    assert store.snapshots().where("version = 1").count() == 4
    assert store.read_diff("s", 1).count() == 5


def test_stream_restart_continues_the_chain(spark, tmp_path):
    inbox, store = str(tmp_path / "inbox"), ct.VersionStore(spark, str(tmp_path / "store"))
    schema = orders(spark, {}).schema
    for i, change in enumerate(({}, {1: ("y", "10")}, {2: None})):
        orders(spark, change).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        follow(stream, store, "s", str(tmp_path / "cp"), data_type="master", similar=False).awaitTermination()
    got = [(v.version, v.updated, v.deleted) for v in store.versions().orderBy("version").collect()]
    assert got == [(0, None, None), (1, 1, 0), (2, 1, 1)]


def test_a_batch_of_several_arrivals_runs_twice(spark, tmp_path):
    """One version per arrival, and the same versions when the batch comes again."""
    store = ct.VersionStore(spark, str(tmp_path / "store"))
    at = datetime.datetime(2024, 1, 1)
    for _ in range(2):
        for i, change in enumerate(({}, {1: ("y", "10")}, {2: None})):
            store_version(
                store, "s", orders(spark, change), "f", at, batch_id=0, arrival=f"a{i}", data_type="master", similar=False, report=i == 2,
            )
    got = [(v.version, v.arrival, v.updated, v.deleted, v.report_file) for v in store.versions().orderBy("version").collect()]
    assert got == [(0, "a0", None, None, None), (1, "a1", 1, 0, None), (2, "a2", 1, 1, "s_v2")]
    assert store.read_sheet("s_v2", "deleted").count() == 1


def test_quoted_cells(spark, tmp_path):
    from tablematch.sources.readers import read_grid, read_strings

    path = tmp_path / "q.csv"
    path.write_text('id,note,amount\n1,"He said ""a, b"" ok",5\n2,"two\nlines",6\n3,back\\slash,7\n')
    want = [(0, "1", 'He said "a, b" ok', "5"), (1, "2", "two\nlines", "6"), (2, "3", "back\\slash", "7")]
    rows = read_strings(spark, str(path), multi_line=True)
    assert sorted((r["_rid"], r["id"], r["note"], r["amount"]) for r in rows.collect()) == want
    grid = read_grid(spark, str(path), multi_line=True).collect()
    assert sorted((r["_rid"], r["_c0"], r["_c1"], r["_c2"]) for r in grid)[1:] == [(i + 1, *rest) for i, *rest in want]


def test_lines_of_another_width_are_reported(spark, tmp_path):
    import pytest
    from tablematch.sources.readers import read_strings

    path = tmp_path / "w.csv"
    path.write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_strings(spark, str(path), strict=True).collect()


def test_unsplit_jdbc_targets_are_refused(spark):
    import pytest
    from tablematch.sources.readers import Targets

    with pytest.raises(ValueError, match="partitionColumn"):
        Targets({"x": {"url": "jdbc:none", "dbtable": "t"}}, "x").read(spark, "x")


def test_all_values_decide(spark):
    """The first hundred values look like dates, the other thousands do not; two tables in opposite order share all values."""
    from pyspark.sql import functions as F
    from tablematch.operators.align import column_scores
    from tablematch.operators.profile import profile
    from tablematch.operators.schema_match import value_overlap

    rows = spark.range(5000).select(F.col("id").alias("_rid"), F.when(F.col("id") < 100, "2024-01-05").otherwise(F.concat(F.lit("text "), "id")).alias("c"))
    assert profile(rows).first()["inferred_logical_type"] not in ("Date", "Datetime")
    assert column_scores(rows, ["c"])["c"]["date"] < 0.05
    back = rows.select((F.lit(4999) - F.col("_rid")).alias("_rid"), "c")
    assert value_overlap(rows, back).first()["overlap"] == 1.0
    assert profile(spark.createDataFrame([(0, 1.0), (1, 2.0)], "_rid long, x double")).first()["median_val"] == 1.5


def test_file_numbers_past_five_digits(spark, tmp_path):
    from tablematch.sources.ordinal import with_ordinal

    for n, name in enumerate(("part-99999-a.snappy.parquet", "part-100000-a.snappy.parquet")):
        spark.createDataFrame([(n,)], "n int").coalesce(1).write.parquet(str(tmp_path / str(n)))
        found = next((tmp_path / str(n)).glob("part-*.parquet"))
        (tmp_path / "t").mkdir(exist_ok=True)
        (tmp_path / "t" / name).write_bytes(found.read_bytes())
    rows = with_ordinal(spark.read.parquet(str(tmp_path / "t")), numbered=True).collect()
    assert all(r["n"] == r["_rid"] for r in rows)
