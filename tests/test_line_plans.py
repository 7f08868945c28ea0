"""Line comparison and ordinals shuffle the rows once."""

import re

from tablematch.operators.cells import layout_of
from tablematch.operators.lines import identical_lines, leftover_lines
from tablematch.sources.ordinal import with_ordinal


def _shuffles(df) -> int:
    return len(re.findall(r"Exchange (?:hash|range)partitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_lines_are_partitioned_once(spark):
    s = spark.createDataFrame([("a", "1", 0), ("a", "1.0", 1), ("a", "2", 2), ("b", "5", 3)], "k string, v string, _rid long")
    t = spark.createDataFrame([("a", "3", 10), ("a", "1", 11), ("b", "5", 12), ("b", "5", 13)], "k string, v string, _rid long")
    layout = layout_of(["k", "v"], ["k", "v"], ["k"])
    for carry in (None, []):
        found = identical_lines(s, t, layout, None, carry=carry)
        rest = leftover_lines(found.where("src is null or tgt is null"), layout, None)
        # broadcasts would hide the shuffles of a join at this size
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            assert _shuffles(found) == 1 and _shuffles(rest) == 1
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        ids = lambda df: sorted((r.k, r.src and r.src._rid, r.tgt and r.tgt._rid) for r in df.collect())
        assert ids(found.where("src is not null and tgt is not null")) == [("a", 0, 11), ("b", 3, 12)]
        assert sorted(ids(rest), key=str) == [("a", 1, 10), ("a", 2, None), ("b", None, 13)]


def test_rows_keep_their_place_when_numbered(spark, tmp_path):
    spark.range(0, 50, 1, 5).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        numbered = with_ordinal(spark.read.parquet(str(tmp_path / "t")), numbered=True)
        # only the counts of the splits are grouped, the rows are not shuffled
        assert _shuffles(numbered) == 1
        assert [(r.id, r._rid) for r in numbered.orderBy("_rid").collect()] == [(i, i) for i in range(50)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
