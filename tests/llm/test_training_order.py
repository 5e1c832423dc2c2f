from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from gridloom.llm import training_order
from gridloom.llm.shared import stage, stage_path

PATH, END = public_tokenizers.path("piece_bpe_32k.model"), 2


@pytest.mark.parametrize("count", [1, 2, 3, 7, 64, 1000, 65_537])
def test_feistel_is_a_permutation(count):
    slots = training_order.feistel(np.arange(count), count, b"k")
    assert sorted(slots.tolist()) == list(range(count))
    if count > 10:
        assert slots.tolist() != training_order.feistel(np.arange(count), count, b"other").tolist()
        assert slots.tolist() != list(range(count))


def test_round_trip(spark, odd):
    docs, path = stage(odd.repartition(3, "doc_id"), "docs"), stage_path(spark, "out")
    index = training_order.materialise(docs, PATH, END, path, length=64, per_shard=16).orderBy("slot").collect()
    n = len(index)
    assert [r.slot for r in index] == list(range(n)) and {r.n_bytes for r in index} == {128}
    assert all((r.shard, r.byte_offset) == (r.slot // 16, r.slot % 16 * 128) for r in index)
    records = training_order.read_slots(path, 0, n, 64, 16)
    assert [zlib.crc32(x.tobytes()) for x in records] == [r.crc32 for r in index]
    assert (training_order.read_slots(path, n // 2 - 3, 20, 64, 16) == records[n // 2 - 3 : n // 2 + 17]).all()
    # Every text's ids and end token come back, in the order of the sequences.
    numbers = {int(s): i for i, s in enumerate(training_order.feistel(np.arange(n), n, b"order"))}
    flat = []
    for r in sorted(index, key=lambda r: numbers[r.slot]):
        flat += records[r.slot][: r.n_tokens].tolist()
    plain = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = sorted(tuple(plain.encode(r.text or "")) for r in docs.collect())
    texts, open_ = [], []
    for t in flat:
        if t == END:
            texts.append(tuple(open_))
            open_ = []
        else:
            open_.append(t)
    assert sorted(texts) == want and not open_


def test_empty(spark, empty):
    assert training_order.materialise(empty, PATH, END, stage_path(spark, "out")).count() == 0
