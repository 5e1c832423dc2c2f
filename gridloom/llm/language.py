"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's features are the 1- to 4-grams of its lower-cased UTF-8 bytes, hashed
into ``BUCKETS``. The model averages their embeddings and applies a softmax
layer; both are trained by stochastic gradient descent in numpy. As the average
is linear, a trained model is one table of bucket scores, which workers get
whole (``BUCKETS`` x languages, bounded). A temperature fitted on rows left out of
the training calibrates the scores, and the threshold of the rejection is taken
from the same rows.

The training sample is bounded: the ``sample`` labelled rows of lowest hash, equal
rows once, whole texts. Tasks count their n-grams and pack the counts (``BUCKETS``
a row at most), one task fits them, and the driver gets the model. Predictions
read whole texts.

Defined results: a null or empty text, or one without a letter, is ``und`` with
score 0 and rejected; labels that are null are not learned; without any labelled
row everything is ``und``; equal texts get equal results; null ids and repeated
rows are kept; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_columns, texts

BUCKETS, WIDTH, GRAMS = 1 << 14, 16, (1, 2, 3, 4)
#: Bound of the training sample: rows.
SAMPLE = 6000
EPOCHS, RATE = 4, 0.5
#: Part of the left-out rows that the rejection may cost at most.
REJECTED = 0.001
LETTER = re.compile(r"[^\W\d_]")

_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def buckets(data: np.ndarray, most: int | None = None) -> np.ndarray:
    """Hashed n-grams of a byte array that start in its first ``most`` bytes, all orders joined."""
    wide, out, h = data.astype(np.uint32), [], np.zeros(len(data), np.uint32)
    for i, n in enumerate(GRAMS):
        if len(data) < n:
            break
        h = (h[: len(data) - n + 1] + wide[n - 1 :] + np.uint32(1)) * _MIX[i]
        h ^= h >> np.uint32(15)
        out.append(h[:most] & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def encoded(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode(), np.uint8)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and how often each occurs, in blocks: memory is bounded for any length."""
    data, total, block = encoded(text), np.zeros(BUCKETS, np.int64), 1 << 16
    for at in range(0, max(1, len(data)), block):
        total += np.bincount(buckets(data[at : at + block + GRAMS[-1] - 1], block), minlength=BUCKETS)
    ids = np.flatnonzero(total)
    return ids, total[ids]


def packed(text: str) -> bytes:
    ids, counts = features(text)
    return zstandard.compress(np.diff(ids, prepend=0).astype(np.uint16).tobytes() + counts.astype(np.uint32).tobytes())


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.decompress(blob)
    n = len(data) // 6
    return np.cumsum(np.frombuffer(data, np.uint16, n), dtype=np.int64), np.frombuffer(data, np.uint32, n, 2 * n)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language, float32
    bias: np.ndarray
    temperature: float
    least: float  # scores below are rejected

    def logits(self, text: str) -> np.ndarray:
        ids, counts = features(text)
        return self.averaged(ids, counts)

    def averaged(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts.astype(np.float32) @ self.table[ids] / max(counts.sum(), 1) + self.bias

    def predict(self, text: str) -> tuple[str, float, bool]:
        if not self.languages or not LETTER.search(text):
            return "und", 0.0, True
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.least)


def fit(rows: list[tuple[bytes, str]], seed: int = 7) -> Model:
    """``rows`` of (packed features, language); a fifth is left out for the calibration."""
    languages = sorted({g for _, g in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    label = np.array([languages.index(g) for _, g in rows])
    k = len(languages)
    embed, out, bias = rng.normal(0, 0.1, (BUCKETS, WIDTH)), np.zeros((WIDTH, k)), np.zeros(k)
    out += rng.normal(0, 0.1, out.shape)
    order = rng.permutation(len(rows))
    left, used = order[: len(rows) // 5], order[len(rows) // 5 :]
    steps, done = EPOCHS * max(1, len(used)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            ids, counts = unpacked(rows[i][0])
            share = (counts / counts.sum())[:, None]
            hidden = (embed[ids] * share).sum(0)
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            rate = RATE * (1 - done / steps)
            back = out @ p
            out -= 0.1 * rate * np.outer(hidden, p)
            bias -= 0.01 * rate * p
            embed[ids] -= rate * share * back * min(len(ids), 100)
            done += 1
    model = Model(languages, (embed @ out).astype(np.float32), bias, 1.0, 0.0)
    z = np.array([model.averaged(*unpacked(rows[i][0])) for i in left]) if len(left) else np.zeros((0, k))
    if len(left):
        loss = lambda t: -np.mean((z / t - np.logaddexp.reduce(z / t, axis=1, keepdims=True))[np.arange(len(left)), label[left]])
        model.temperature = float(min(np.geomspace(0.02, 500, 160), key=loss))
        best = np.exp((z / model.temperature).max(1) - np.logaddexp.reduce(z / model.temperature, axis=1))
        # Never above a tie of two languages: a document that one of them clearly leads is kept.
        model.least = float(min(np.quantile(best, REJECTED), 0.5) * 0.9)
    return model


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the ``sample`` labelled rows of lowest hash."""
    key = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(11))
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(key.alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # First the keys alone, then the texts of those: only the sample's texts travel.
    chosen = labelled.select("key").orderBy("key").limit(sample).agg(F.max("key")).collect()[0][0]
    if chosen is None:
        return fit([])

    def count(batches):
        for b in batches:
            yield {"key": b["key"], "features": [packed(t) for t in b["text"].to_pylist()], "lang": b["lang"]}

    def learn(batches):
        rows = [row for b in batches for row in zip(b["features"].to_pylist(), b["lang"].to_pylist(), strict=True)]
        yield {"model": [pickle.dumps(fit(rows[:sample]))]}

    rows = labelled.where(F.col("key") <= chosen).dropDuplicates(["key", "lang"])
    counted = map_columns(rows, count, "key long, features binary, lang string")
    fitted = map_columns(counted.repartition(1).sortWithinPartitions("key", "lang").select("features", "lang"), learn, "model binary")  # ``sample`` rows
    return pickle.loads(fitted.collect()[0][0])


PREDICTED = "lang_pred string, score double, rejected boolean"


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` (all, if not given) with ``lang_pred``, ``score`` and ``rejected``; whole texts are read."""
    fields = [f for f in docs.schema.fields if keep is None or f.name in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), PREDICTED])
    held = docs.sparkSession.sparkContext.broadcast(model)
    needed = dict.fromkeys([*(f.name for f in fields), text_col])

    def predict(batches):
        for b in batches:
            said = [held.value.predict(t) for t in texts(b[text_col])]
            yield {f.name: b[f.name] for f in fields} | {"lang_pred": [x[0] for x in said], "score": [x[1] for x in said], "rejected": [x[2] for x in said]}

    return map_columns(docs.select(*needed), predict, schema)
