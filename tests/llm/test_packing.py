"""Packing: whole pieces, gapless sequences, few of them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablematch.llm import packing
from tablematch.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_encodes_as_the_plain_call():
    rng = random.Random(5)
    pieces = ["a", "b.", "Éc,;", "x!y", " d:?", "\ne", " ", "  ", "\n", "\t ", " \n", "É", "don't", "'LL", "<|endoftext|>", "<|endof", "12 3", "\xa0", "日本", ".", "\x1c", "   ", "🙂", "\x00", "²", "ʼ", "\u2028"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(3000)] + ["x" * 100 + " y" * 5, "a <|endoftext|> b", "ab" * 50_000]
    texts += [" " * 300_000 + "x", "\n" * 5000 + " y", "x \t" * 400]
    encoder = packing.Encoder(PATH)
    assert [np.frombuffer(encoder.encode(x), "<u4").tolist() for x in texts] == whole(texts)
    assert whole(["a <|endoftext|> b"]) == [[64, 220, 50256, 275]]


def test_every_character_encodes_as_by_the_plain_call():
    texts = [f"a{chr(c)}1{chr(c)}. {chr(c)}'s" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 97 == 0)]
    encoder = packing.Encoder(PATH)
    assert [np.frombuffer(encoder.encode(x), "<u4").tolist() for x in texts] == whole(texts)


def test_other_files_are_refused(tmp_path):
    from tokenizers import models, pre_tokenizers

    other = Tokenizer(models.BPE(vocab={"a": 0}, merges=[]))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        packing.Encoder(str(tmp_path / "t.json"))


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_each_piece_once(seed):
    rng = random.Random(seed)
    capacity = 60
    histogram = {s: rng.randint(0, 50) for s in rng.sample(range(1, capacity + 1), 25)}
    used, seen = defaultdict(list), defaultdict(set)
    for s, r0, n, first, each, offset in packing.plan(histogram, capacity):
        for i in range(n):
            assert r0 + i not in seen[s]
            seen[s].add(r0 + i)
            used[first + i // each].append((offset + i % each * s, s))
    assert {s: len(r) for s, r in seen.items()} == {s: n for s, n in histogram.items() if n}
    for parts in used.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + s == b for (a, s), (b, _) in zip(parts, parts[1:]))
        assert sum(s for _, s in parts) <= capacity
    # best-fit decreasing, piece by piece
    gaps = []
    for s in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        fit = [g for g in gaps if g >= s]
        g = min(fit) if fit else capacity
        if fit:
            gaps.remove(g)
        gaps.append(g - s)
    assert len(used) <= len(gaps)


def test_pack(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["the", "of", "ciónáé", "x1"], k=rng.randint(0, 90))), 1) for i in range(80)]
    rows += [(200, None, 1), (201, "", 1), (5, rows[5][1], 1), (None, "lone", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    out = packing.pack(docs, PATH, capacity=64, with_ids=True).collect()
    want = sorted(str((r[0], ids + [0])) for r, ids in zip(rows, whole([r[1] or "" for r in rows])))
    by_doc = defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) <= 64
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc[r.doc_id].append(r)
    assert sum(map(len, by_doc.values())) == len(out)
    for d, r in zip([r[0] for r in rows], rows):
        parts = sorted(by_doc[d], key=lambda p: p.piece)
        if d != 5:
            assert [p.piece for p in parts] == list(range(len(parts)))
            assert all(p.length == 64 for p in parts[1:])
            assert str((d, sum([list(p.ids) for p in parts], []))) in want
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 64
    assert packing.pack(docs.limit(0), PATH).count() == 0
    packed = {r.sequence_id: r.ids for r in packing.sequences(packing.pack(docs, PATH, capacity=64, with_ids=True)).collect()}
    assert sum(map(len, packed.values())) == sum(r.length for r in out)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r, ids in zip(rows, whole([r[1] for r in rows])):
        ids = ids + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r[0], k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    out = QUERIES["op3_packing"](spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want
    total = sum(r.length for r in out)
    assert len({r.sequence_id for r in out}) <= -(-total // 2048) * 1.02 + 1
