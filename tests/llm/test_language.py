from __future__ import annotations

import zlib

from gridloom.llm import language, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    said = queries.op10_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    held = [r for r in said if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in said)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in said)
    assert sum(r.rejected for r in said) <= 0.02 * len(said)


def test_scores_are_calibrated_and_gibberish_is_rejected():
    import random

    rng = random.Random(1)
    stock = {"en": ["the", "of", "and", "that", "with"], "de": ["der", "und", "nicht", "ein", "auch"], "fr": ["les", "une", "dans", "qui", "pour"]}
    noisy = lambda g: " ".join(rng.choice(stock[g if rng.random() < 0.6 else rng.choice(list(stock))]) for _ in range(8))
    rows = [(language.packed(noisy(g)), g) for g in stock for _ in range(300)]
    model = language.fit(rows)
    said = [(g, *model.predict(noisy(g))) for g in stock for _ in range(300)]
    right, confident = sum(g == p for g, p, *_ in said) / len(said), sum(s for *_, s, _ in said) / len(said)
    assert right > 0.8 and abs(right - confident) < 0.08
    assert model.predict("12 34 --")[2] and not model.predict("the of and that with the of and")[2]
    assert 0 < model.least < 0.5


def test_odd_rows(spark, odd, empty):
    model = language.train(odd)
    rows = language.identify(odd, model, keep=["doc_id", "text"]).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")), r
        assert r.rejected or r.lang_pred != "und"
    assert language.identify(odd, model).columns == [*odd.columns, "lang_pred", "score", "rejected"]
    assert language.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.train(empty)).collect()} == {"und"}


def test_blocks_do_not_change_a_long_text():
    model = language.fit([(language.packed("the of and to in"), "en"), (language.packed("der die das und"), "de")] * 10)
    text = "the of and " * 20_000
    whole = language.buckets(language.encoded(text))
    direct = model.table.astype(float)[whole].sum(0) / len(whole) + model.bias
    assert abs(direct - model.logits(text)).max() < 1e-3
