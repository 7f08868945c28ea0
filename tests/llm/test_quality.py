"""Quality classifier: weights against plain Python, held-out accuracy, odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablematch.llm import quality
from tablematch.llm.queries import QUERIES


def test_weights_and_draw(spark):
    rng = np.random.default_rng(3)
    good, bad = ["alpha", "beta", "gamma", "delta"], ["zig", "zag", "zog", "beta"]
    rows, labels = [], []
    for i in range(600):
        fine = i % 4 > 0
        rows.append((i, " ".join(rng.choice(good if fine else bad, int(rng.integers(20, 60))))))
        if i % 2:
            labels.append((i, int(fine), None))
    rows += [(900, None), (901, ""), (902, " \n"), (None, "alpha beta gamma"), (5, rows[5][1])]
    labels += [(5000, 1, 0), (None, 1, 0), (7, None, 0), (9, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kept", "'x' AS _weight")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.classify(docs, table).collect()
    assert len(out) == len(rows)
    kept = {r.doc_id: r.kept for r in out}
    assert np.mean([kept[i] for i in range(600) if i % 4]) > 0.99 and not any(kept[i] for i in range(0, 600, 4))
    assert not kept[900] and not kept[901] and not kept[902]
    model, _ = quality.fit(docs, table)
    text = rows[10][1]
    bucket, _ = quality.features(pa.array([text]))
    want = model.ratios[bucket].sum()
    assert abs(next(r.log_weight for r in out if r.doc_id == 10) - want) < 1e-9
    left = quality.quality_filter(docs, table)
    assert left.columns == docs.columns and left.count() == sum(r.kept for r in out)
    assert quality.classify(docs.limit(0), table).count() == 0
    assert quality.classify(docs, table.limit(0)).count() == len(rows)


def test_query_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.1"
    out = QUERIES["op6_quality"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    share = {(r.quality, r.toxic): r.kept for r in out.join(labels, "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    print(share)
    assert share[1, 0] > 0.99 and share[0, 0] < 0.2


@pytest.mark.parametrize("sf, most", [("sf0.001", 2), ("sf0.01", 10)])
def test_query_rejects_at_small_sizes(spark, sf, most):
    """Labelled rejects (quality 0) go on small input too: 9 + 2 of them at sf0.001, 49 + 9 at sf0.01."""
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    rows = QUERIES["op6_quality"](spark, f"/root/testdata/{sf}").join(labels, "doc_id").select("quality", "toxic", "kept").collect()
    print(sf, {(q, t): sum(r.kept for r in rows if (r.quality, r.toxic) == (q, t)) for q in (0, 1) for t in (0, 1)})
    good = [r.kept for r in rows if (r.quality, r.toxic) == (1, 0)]
    assert np.mean(good) > 0.98
    assert sum(r.kept for r in rows if (r.quality, r.toxic) == (0, 0)) <= most


def test_length_does_not_decide(spark):
    """Long good texts with some bad words do not set a floor that all short bad texts pass."""
    rng = np.random.default_rng(4)
    good, bad = ["alpha", "beta", "gamma", "delta"], ["zig", "zag", "zog", "beta"]
    rows, labels = [], []
    for i in range(400):
        fine = i % 4 > 0
        rows.append((i, " ".join(rng.choice(good if fine else bad, 30))))
        labels.append((i, int(fine), 0))
    for i in range(400, 408):  # good by label, long, half the words of bad texts
        rows.append((i, " ".join(rng.choice(good + bad, 300))))
        labels.append((i, 1, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert sum(kept[i] for i in range(0, 400, 4)) <= 5
    assert np.mean([kept[i] for i in range(408) if i % 4 or i >= 400]) > 0.95
