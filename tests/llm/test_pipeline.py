"""Every stage of the pipeline on its own input, against the brute-force versions of the operators' tests."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import test_lines  # noqa: E402
import test_mixing  # noqa: E402
import test_packing  # noqa: E402
import test_simhash  # noqa: E402

import corpus_pipeline  # noqa: E402
from tablematch.llm import mixing, quality  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def test_columns_stay(steps):
    for before, after in steps[:-1]:
        assert after.dtypes == before.dtypes


def test_quality(spark, steps):
    before, after = steps[0]
    kept = {r.doc_id for r in quality.classify(before, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert {tuple(r) for r in after.collect()} == {tuple(r) for r in before.collect() if r.doc_id in kept}
    assert 0 < len(kept) < before.count()


def test_line_stage(steps):
    before, after = steps[1]
    rows = before.collect()
    want = {p[0]: p[5] for p in test_lines.plain([(r.doc_id, r.text) for r in rows], 2)}
    assert {r.doc_id: (r.text, r.lang, r.source, r.n_chars) for r in after.collect()} == {
        r.doc_id: (want[r.doc_id], r.lang, r.source, len(want[r.doc_id])) for r in rows
    }


def test_near_copies(steps):
    before, after = steps[2]
    rows = before.collect()
    prints = [(r.doc_id, test_simhash.plain_fingerprint(r.text, 5)) for r in rows]
    first = set(test_simhash.plain_components(prints, 4))
    assert {tuple(r) for r in after.collect()} == {tuple(r) for r in rows if r.doc_id in first}


def test_mixing_stage(steps):
    before, after = steps[3]
    rows = before.collect()
    chars = Counter()
    for r in rows:
        chars[r.source] += len(r.text)
    held = {s for s, n in chars.items() if n}
    want = Counter()
    for r in rows:
        if r.source in held:
            want[tuple(r)] += test_mixing.plain_count(sum(chars.values()) / len(held) / chars[r.source], r.doc_id, mixing.SEED)
    assert Counter(map(tuple, after.collect())) == +want


def test_sequences(steps):
    before, after = steps[4]
    rows = before.collect()
    lengths = Counter((r.doc_id, len(ids) + 1) for r, ids in zip(rows, test_packing.whole([r.text for r in rows])))
    placed, by_doc = defaultdict(list), defaultdict(int)
    for r in after.collect():
        placed[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id] += r.length
    want = defaultdict(int)
    for (d, n), times in lengths.items():
        want[d] += n * times
    assert by_doc == want
    for parts in placed.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 2048


def test_run(spark, steps):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(steps[4][1].collect())
