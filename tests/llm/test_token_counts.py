from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

from gridloom.llm import bpe, token_counts

from .conftest import DOCS, document

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(texts):
    t = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_pieces_give_the_librarys_counts():
    hard = ["", " ", "áb é", "x ́y", "it's we'll 12,5 <|endoftext|> a<|startoftext|>b <|END", "a b c\u0085d\x1ce", "ΑΣ ΟΔΟΣ İstanbul ǅ", "한국어 日本 🙂🙃", "\x00\x07", "don't!?"]
    assert bpe.tokenizer(PATH).by_piece
    assert bpe.tokenizer(PATH).counts(hard) == plain(hard)
    assert [len(x) for x in bpe.tokenizer(PATH).ids(hard)] == plain(hard)
    assert not bpe.PieceTokenizer(public_tokenizers.path("byte_bpe_50k.json")).by_piece


def test_counts_and_cache(spark, odd):
    cache = token_counts.new_cache(spark)
    rows = token_counts.count_tokens(odd, PATH, cache).collect()
    source = odd.collect()
    expect = sorted((str(r.doc_id), len((r.text or "").encode()), n) for r, n in zip(source, plain(r.text for r in source)))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == expect
    stored = token_counts.read_cache(spark, cache).collect()
    assert len({r.digest for r in stored}) == len(stored)  # each distinct miss once
    more = spark.createDataFrame([document(50, "one"), document(51, "a new text"), document(52, " one  ")], DOCS)
    again = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(more, PATH, cache).collect()}
    assert again == dict(zip((50, 51, 52), plain(["one", "a new text", "one"])))
    assert token_counts.read_cache(spark, cache).count() == len(stored) + 1


def test_empty(spark, empty):
    assert token_counts.count_tokens(empty, PATH, token_counts.new_cache(spark)).count() == 0


def test_words_of_a_sentence_model_are_its_texts():
    rng, model = random.Random(3), bpe.SentenceTokenizer(public_tokenizers.path("piece_bpe_32k.model"))
    assert model.by_word
    parts = [*map(chr, range(1, 400)), "▁", "́", "中", "\U0001f600", "‍", "ﬁ", "the", "<s>", "</s>", "<unk>", "<0x0A>", "  ", ""]
    found = ["", " ", " a", "a ", "a  b", *("".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randrange(12))) for _ in range(3000))]
    assert [x.tolist() for x in model.ids(found)] == model.inner.encode(found)
