"""Keyed state: the same changes as between whole versions, over restarts."""

import random

import pytest
from pyspark.sql import functions as F

from tablematch.streaming.keyed import CHANGES, STATE_STORE, judge_arrivals

SCHEMA = "version long, id string, amount string, note string"


def versions(rng, n=4):
    out, now = [], {}
    for v in range(n):
        for k in range(25):
            if rng.random() < 0.2:
                now.pop(k, None)
            elif k not in now or rng.random() < 0.3:
                now[k] = (str(rng.randrange(3)), rng.choice("ab"))
        out.append({f"k{k}": x for k, x in now.items()})
    return out


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    yield
    spark.conf.set(name, before)


def run(spark, tmp_path):
    stream = judge_arrivals(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), ["id"], buckets=3)
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).outputMode("append")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(CHANGES).parquet(str(tmp_path / "out"))


def test_equals_the_comparison_of_whole_versions(spark, tmp_path, rocks):
    chain = versions(random.Random(4))
    want, before = set(), {}
    for v, now in enumerate(chain):
        rows = [(v, k, x, y) for k, (x, y) in now.items()] + [(v, next(iter(now)), "again", "x")]
        frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        # the amounts are written otherwise in each version, which is no change
        frame = frame.withColumn("amount", F.concat("amount", F.lit("." + "0" * (v + 1))))
        frame.unionByName(spark.createDataFrame([(v, None, None, None)], SCHEMA)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        want |= {(v, k, "Added" if k not in before else "Matched" if before[k] == x else "Updated") for k, x in now.items()}
        want |= {(v, k, "Deleted") for k in before.keys() - now.keys()}
        before = now
        if v in (0, 2, 3):  # two versions in one batch, and a new start each time
            out = run(spark, tmp_path)
    got = [tuple(r)[:3] for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert all(r.previous_version == r.version - 1 for r in out.where("status <> 'Added'").collect())


def test_buckets_grow_with_the_keys():
    from tablematch.streaming.keyed import BUCKET_KEYS, buckets_for

    assert buckets_for(0) == buckets_for(BUCKET_KEYS) == 8
    for keys in (10**6, 54 * 10**6):
        assert keys / buckets_for(keys) <= BUCKET_KEYS


def test_an_arrival_is_written_by_many_tasks(spark, tmp_path):
    from checks.series import _arrive

    _arrive(spark.range(0, 100, 1, 4), str(tmp_path / "inbox"), 0)
    assert len(list((tmp_path / "inbox" / "part=0").glob("*.parquet"))) == 4
