"""The history from stored changes equals the one from whole snapshots."""

import datetime
import random

from pyspark.sql import functions as F

from tablematch.operators import history as hs
from tablematch.sources.catalog import VersionStore

ROW = "series_id string, version int, row_key string, row_data map<string,string>"


def snapshots(rng, versions=9, keys=30):
    """Versions in which rows come and go, cells change, and texts of one value are written otherwise."""
    rows, now = [], {}
    for v in range(versions):
        for k in range(keys):
            if rng.random() < 0.15:
                now.pop(k, None)
            elif k not in now or rng.random() < 0.2:
                now[k] = {"a": rng.choice(["1", "1.0", "2", None, ""]), "b": rng.choice("xy"), **({"late": "z"} if v > 4 else {})}
        rows += [("s", v, f"k{k}", dict(d)) for k, d in now.items()]
    return rows


def test_equals_the_history_of_whole_snapshots(spark, tmp_path):
    rows = snapshots(random.Random(3))
    store = VersionStore(spark, str(tmp_path))
    spark.createDataFrame(rows, ROW).write.partitionBy("series_id", "version").parquet(str(tmp_path / "snapshots"))
    for v in range(1, 9):
        store.write_changes("s", v)
        if v in (3, 7):
            store.compact_changes("s")
    store.write_changes("s", 8)  # again, as after a failure
    assert store.runs("s") == [(1, 7), (8, 8)]
    changes = store.changes("s")
    before = {}
    wanted = 0
    for v in range(9):
        here = {(k, c): x for _, n, k, d in rows if n == v for c, x in d.items() if x is not None}
        wanted += v and len({c for c in before.keys() | here.keys() if before.get(c) != here.get(c)})
        before = here
    assert changes.count() == wanted  # one row per change
    every = spark.createDataFrame([(v,) for v in range(9)], "version int")
    got = hs.values_at(hs.value_intervals(changes), every).collect()
    old = hs.value_history(spark.createDataFrame(rows, ROW)).select("row_key", "column_name", F.explode("values").alias("version", "value")).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted((r.row_key, r.column_name, r.version, r.value) for r in old) and len(old) > 50
    assert all(r.version <= 4 for r in store.changes("s", 4).collect())


def test_a_value_that_stays_is_one_row(spark):
    changes = spark.createDataFrame([("s", "k", "a", 3, "1", "2"), ("s", "k", "a", 900, "2", "5")], hs.CHANGE_SCHEMA)
    got = [tuple(r)[3:6] for r in hs.value_intervals(changes).orderBy("valid_from").collect()]
    assert got == [(0, 3, "1"), (3, 900, "2"), (900, None, "5")]
    assert hs.value_intervals(changes.limit(0)).count() == 0


def test_versions_of_a_chain_store_their_changes(spark, tmp_path):
    from tablematch.streaming.compare import store_version

    store = VersionStore(spark, str(tmp_path))
    for v, rows in enumerate([[(0, "1", "a"), (1, "2", "b")], [(0, "1", "a"), (1, "2", "c")], [(0, "1", "a")]]):
        store_version(store, "s", spark.createDataFrame(rows, "_rid long, id string, x string"), "f", datetime.datetime(2024, 1, 1 + v), ["id"], similar=False)
    got = [tuple(r)[1:] for r in store.changes("s").orderBy("version", "column_name").collect()]
    assert got == [("2", "x", 1, "b", "c"), ("2", "id", 2, "2", None), ("2", "x", 2, "c", None)]
