"""The test tables that the queries compare are whole."""

import duckdb

from checks import fixtures as fx

SF_DIR = "/root/testdata/sf0.001"


def test_lines_are_numbered_over_the_whole_table(spark):
    """F4 to F8: positions come from one order of all lines, in Spark and in SQL, not from the order of one key."""
    source, _ = fx.b3_tables(spark, SF_DIR)
    mine = sorted((r["_rid"], r["order_no"], r["line"], r["price"]) for r in source.collect())
    assert [r[0] for r in mine] == list(range(len(mine)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{SF_DIR}/lineitem.parquet')")
    assert con.execute(fx.B3 + "SELECT rid, order_no, line, price FROM s0 ORDER BY rid").fetchall() == mine
