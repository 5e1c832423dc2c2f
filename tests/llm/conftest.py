from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, fp int, digest string, level int"


def document(doc_id, text, lang="en", source="a"):
    """A row of documents with further columns whose names clash with the operators' own."""
    return (doc_id, text, lang, source, None if text is None else len(text), 7, "key", 3, "digest", 1)


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    stock = [f"w{rng.randrange(words)}" for _ in range(n)]
    return " ".join(stock)


def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = prose(random.Random(5), 30_000)
    return [
        document(None, "a text without an id", None, None),
        document(None, None, None, None),
        document(1, None), document(2, ""), document(3, " \n\t "), document(4, "one"), document(5, "one"),
        document(6, long), document(7, "Ünïcode ſtraße 𝔘 İ K token=abcdefghijklmnop"), document(8, "¿Qué?", "es", None),
        document(9, "same words here and there and everywhere"), document(9, "same words here and there and everywhere"),
    ]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
