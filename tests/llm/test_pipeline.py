"""The pipeline's stages on small tables, each against a plain version over its own input."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from gridloom.llm import simhash
from gridloom.llm.queries import END_TOKEN, SEQUENCE_TOKENIZER
from gridloom.llm.shared import documents, stage

from .conftest import document

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = documents(spark, SF), []
    for name, work in corpus_pipeline.STAGES:
        found = stage(work(spark, docs, SF), name)
        out.append((name, docs, found))
        docs = found
    return {name: (before, after) for name, before, after in out}


def test_all_but_the_last_return_documents(spark, staged):
    names = documents(spark, SF).columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mixture", "token_output"]
    for name in list(staged)[:-1]:
        assert staged[name][1].columns == names


def test_language_id_keeps_clean_documents(staged):
    before, after = staged["language_id"]
    kept = {r.doc_id for r in after.collect()}
    assert all(r.doc_id in kept or len(r.text) < 40 for r in before.collect()) and len(kept) >= 0.98 * before.count()


def test_near_dedup(staged):
    before, after = staged["near_dedup"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    sets, root = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if not sets[i] | sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert {r.doc_id for r in after.collect()} == {rows[r][0] for r in root}
    assert len(set(root)) < len(rows)


def test_decontamination(spark, staged):
    before, after = staged["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    kept = {r.doc_id for r in after.collect()}
    assert len(kept) >= 0.8 * len(rows)
    for d, t in rows:
        held = any(" ".join((i or "").lower().split()) in " ".join(t.lower().split()) for _, i in items if i)
        assert not (held and d in kept)


def test_mixture_and_tokens(staged):
    before, mixed = staged["source_mixture"]
    size = Counter()
    for r in before.collect():
        size[r.source] += len(r.text.encode().split())
    taken = Counter()
    for r in mixed.collect():
        taken[r.source] += len(r.text.encode().split())
    assert all(taken[s] <= 3 * size[s] for s in size) and abs(sum(taken.values()) - sum(size.values())) <= len(size)
    plain = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(SEQUENCE_TOKENIZER))
    total = sum(len(plain.encode(r.text)) + 1 for r in mixed.collect())
    index = staged["token_output"][1].orderBy("slot").collect()
    assert sum(r.n_tokens for r in index) == total and [r.slot for r in index] == list(range(len(index)))
    assert {d for r in index for d in r.doc_ids} == {r.doc_id for r in mixed.collect()} and END_TOKEN == plain.eos_id()


def test_run_and_odd_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    text = "the same words of some language and the rest of them are here for the reader to see in a row"
    rows = [document(i, f"{text} {i} {i * 7}") for i in range(12)] + [document(None, None, None, None), document(50, "", None, None), document(50, "", None, None), document(51, "§§ 12", "de", "b")]
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (2, "no such words anywhere in it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
