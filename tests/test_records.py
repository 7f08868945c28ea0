"""Records with quoted line breaks, read in splits of a few bytes, against a read of whole files by one task."""

import random

import pytest

from tablematch.sources import records
from tablematch.sources.readers import read_grid, read_strings


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def cell(rng):
    if rng.random() < 0.3:
        return "".join(rng.choices("abc ", k=rng.randrange(6)))
    long = 400 if rng.random() < 0.03 else 12
    return '"' + "".join(rng.choices(["a", "b", ",", '""', "\n", "\r\n", "\n\n", "é", "x y"], k=rng.randrange(long))) + '"'


ODD = ['5" pipe,a,b', '"a"b,c,d', "", "only", "a,b,c,d", 'x,"y"z "" q,w', '"",,""']


@pytest.mark.parametrize("seed,newline,odd", [(1, "\n", 0), (2, "\r\n", 0), (3, "\n", 0.1), (4, "\r\n", 0.1)])
def test_equals_the_read_of_whole_files(spark, tmp_path, small_splits, seed, newline, odd):
    rng = random.Random(seed)
    for f in range(3):
        rows = [rng.choice(ODD) if rng.random() < odd else ",".join(cell(rng) for _ in range(3)) for _ in range(40)]
        text = newline.join(['h1,"h ""2""",h3', *rows]) + (newline if f else "")
        (tmp_path / f"f{f}.csv").write_bytes(text.encode())
    plain = spark.read.options(quote='"', escape='"', multiLine=True)
    grid = read_grid(spark, str(tmp_path), multi_line=True)
    got, want = grid.collect(), plain.csv(str(tmp_path)).collect()
    assert sorted(r["_rid"] for r in got) == list(range(len(want)))
    assert sorted(map(str, (tuple(r)[1:] for r in got))) == sorted(str(tuple(r)) for r in want)
    # one task reads each file in order; files come in order of their names
    ordered = [tuple(r) for f in range(3) for r in plain.csv(str(tmp_path / f"f{f}.csv")).collect()]
    assert [tuple(r)[1:] for r in sorted(got)] == ordered
    table = read_strings(spark, str(tmp_path), multi_line=True)
    assert table.columns == ["_rid", "h1", 'h "2"', "h3"] and table.count() == len(want) - 3


def test_several_tasks_read_one_file(spark, tmp_path, small_splits):
    (tmp_path / "one.csv").write_text('a,b\n' + '"x\n""y""",z\n' * 500)
    scan = records._scan(spark, str(tmp_path))
    assert scan.rdd.getNumPartitions() > 3
    assert {tuple(r)[1:] for r in read_strings(spark, str(tmp_path), multi_line=True).collect()} == {('x\n"y"', "z")}


@pytest.mark.parametrize("text,want", [
    ("", []), ("a\n", ["a"]), ('a,"never closed\nb\nc', ["a,\"never closed\nb\nc"]), ('"' + "\n" * 2900 + '"\nend', ['"' + "\n" * 2900 + '"', "end"]),
    ("\n\n\r\na\n\n", ["a"]), ('"a\n"\n"b"', ['"a\n"', '"b"']),
])
def test_ends_of_files(spark, tmp_path, small_splits, text, want):
    (tmp_path / "t.csv").write_bytes(text.encode())
    found = records.read_records(spark, str(tmp_path)).collect()
    assert [r.text for r in sorted(found, key=lambda r: r.rid)] == want and [r.first for r in sorted(found, key=lambda r: r.rid)] == [i == 0 for i in range(len(want))]


def test_labels(spark):
    assert records.column_labels(["a", "A", "", None, "b"]) == ["a0", "A1", "_c2", "_c3", "b"]
    assert [records._width(x, ",") for x in ("", "a", "a,", '"x,y",z', ",,")] == [1, 1, 2, 2, 3]


def test_headers_of_later_files_leave_no_gap(spark, tmp_path, small_splits):
    """each file has its header, an empty file none."""
    for f, rows in enumerate(([1, 2], [], None, [3, 4, 5])):
        (tmp_path / f"f{f}.csv").write_text("" if rows is None else "a,b\n" + "".join(f'{x},"{"y" * 400}\n{"z" * 400}"\n' for x in rows))
    found = read_strings(spark, str(tmp_path), multi_line=True)
    assert sorted((r["_rid"], r["a"]) for r in found.collect()) == [(0, "1"), (1, "2"), (2, "3"), (3, "4"), (4, "5")]
