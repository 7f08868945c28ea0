"""Comparison of arrivals with what is known of each key, without reading the version before.

Keys are dealt into buckets. The state of a bucket holds per key the fingerprint of its row and the version that had it last, so
that a batch is judged as it comes: rows are added, updated or unchanged. A marker row per version and bucket ends a version: keys that it
did not have are deleted. State and results survive a restart from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tablematch.functions.text import key_text
from tablematch.functions.values import canonical

#: The store that keeps state outside the heap, which keyed state asks for.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys that a bucket should hold: some tens of MB in its task.
BUCKET_KEYS = 50_000
CHANGES = "version long, row_key string, status string, previous_version long"


def buckets_for(keys: int, least: int = 8) -> int:
    """How many buckets hold so many keys, that the memory of a task does not grow with the table."""
    return max(least, -(-keys // BUCKET_KEYS))


def keyed_rows(df: DataFrame, keys: list[str], version: str, buckets: int) -> DataFrame:
    """(bucket, version, row_key, print, ends): the rows of a stream with key text and fingerprint of the other cells, in
    canonical form. A row whose key columns are all null marks the end of its version, in all buckets."""
    cells = [F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) if c in keys else canonical(F.col(c)) for c in df.columns if c != version]
    marker = F.coalesce(*[F.col(k).cast("string") for k in keys]).isNull()
    key = key_text([F.col(k) for k in keys], " | ")
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    bucket = F.explode(F.when(marker, every).otherwise(F.array(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))).alias("bucket")
    return df.select(bucket, F.col(version).cast("long").alias("version"), F.when(~marker, key).alias("row_key"), F.xxhash64(*cells).alias("print"), marker.alias("ends"))


class _Judge(StatefulProcessor):
    """Per bucket a table (row_key, print, seen): what each key had last, and in which version. It is one value, read and
    written once per batch, since an arrival touches nearly all keys. Rows of a version are judged before its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).astype({"print": "Int64", "ends": "bool"})
        known = _unpacked(self.known.get()[0]) if self.known.exists() else _unpacked(None)
        for version, part in batch.groupby("version", sort=True):
            # of a repeated key the first row of a version counts, in whichever batch it came
            came = part.loc[~part["ends"], ["row_key", "print"]].drop_duplicates("row_key").merge(known, on="row_key", how="left", suffixes=("", "_before"))
            came = came[~(came["seen"] >= version).fillna(False).astype(bool)]
            status = np.where(came["seen"].isna(), "Added", np.where((came["print"] == came["print_before"]).fillna(False), "Matched", "Updated"))
            yield _changes(version, came["row_key"], status, came["seen"])
            kept = known[~known["row_key"].isin(came["row_key"])]
            known = pd.concat([kept, came[["row_key", "print"]].assign(seen=pd.array([version] * len(came), "Int64"))], ignore_index=True)
            if part["ends"].any():
                gone = (known["seen"] < version).astype(bool)
                yield _changes(version, known.loc[gone, "row_key"], "Deleted", known.loc[gone, "seen"])
                known = known[~gone]
        self.known.update((_packed(known),))

    def close(self) -> None:
        pass


def _changes(version: int, keys: pd.Series, status, seen: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"version": version, "row_key": keys, "status": status, "previous_version": seen}).astype({"version": "int64"})


def _packed(known: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({"row_key": pa.array(known["row_key"], pa.string()), "print": pa.array(known["print"], pa.int64()), "seen": pa.array(known["seen"], pa.int64())})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes | None) -> pd.DataFrame:
    if data is None:
        columns = {"row_key": pd.array([], "object"), "print": pd.array([], "Int64"), "seen": pd.array([], "Int64")}
        return pd.DataFrame(columns)
    table = pa.ipc.open_stream(data).read_all()
    return pd.DataFrame({"row_key": table["row_key"].to_pylist(), "print": pd.array(table["print"].to_numpy(), "Int64"), "seen": pd.array(table["seen"].to_numpy(), "Int64")})


def judge_arrivals(df: DataFrame, keys: list[str], version: str = "version", buckets: int = 64) -> DataFrame:
    """(version, row_key, status, previous_version) of a stream of rows, each with the number of its version: what has
    become of each key since the version before. Versions come in rising order; a marker (`version`, keys null) ends one and
    gives the keys it lacks as deleted. State grows with the number of keys alone, by the key and two numbers each; choose
    `buckets` by `buckets_for`, from the keys to be expected, so that those of one fit a task. The number stays as long as the checkpoint. Needs `spark.sql.streaming.stateStore.providerClass` to be `STATE_STORE`."""
    rows = keyed_rows(df, keys, version, buckets)
    return rows.groupBy("bucket").transformWithStateInPandas(_Judge(), outputStructType=CHANGES, outputMode="Append", timeMode="None")
