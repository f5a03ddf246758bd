import os
import random

import pytest

from graphloom.llm import packing

need = pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer files here")


def test_bins_hold_every_item_once():
    rnd = random.Random(1)
    for _ in range(20):
        sizes = [rnd.randint(1, 50) for _ in range(rnd.randint(0, 120))]
        bins = packing.best_two_fit(sizes, 50)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 50 for b in bins)


def test_two_fit_beats_greedy():
    # greedy: 6+3 | 5+4 | ...; exchanging the 3 for 2+2 fills the first bin
    assert packing.best_two_fit([6, 3, 2, 2], 10)[0] == [0, 2, 3]


@need
def test_cuts_only_long_documents(spark):
    docs = spark.createDataFrame([(1, "word " * 300, "x"), (2, "hello", "x"), (3, "", "x"), (4, None, "x"), (None, "a", "x"), (5, "a b", "x"), (5, "a b", "x")], "doc_id bigint, text string, position string")
    rows = packing.pack(spark, docs, "doc_id", "text", capacity=64, group=3).collect()
    enc = packing.encoding(packing.TOKENIZER)
    total = {1: len(enc.encode_ordinary("word " * 300)), 2: len(enc.encode_ordinary("hello")), 5: 2 * len(enc.encode_ordinary("a b"))}
    assert {d: sum(r.n_tokens for r in rows if r.doc_id == d) for d in {r.doc_id for r in rows}} == total
    assert len([r for r in rows if r.doc_id == 2]) == 1
    starts = sorted((r.start_token, r.n_tokens) for r in rows if r.doc_id == 1)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    assert all(sum(r.n_tokens for r in v) <= 64 for v in by.values())
    assert packing.pack(spark, docs.limit(0), "doc_id", "text").collect() == []


@need
def test_little_room_is_left(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = packing.pack(spark, docs, "doc_id", "text").collect()
    bins = len({r.sequence_id for r in rows})
    assert sum(r.n_tokens for r in rows) / (2048 * bins) > 0.9
