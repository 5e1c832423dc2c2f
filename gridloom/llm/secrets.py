"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Candidates are runs of 20 or more characters of the usual encodings that no fixed
pattern has. The narrowest encoding that holds a candidate (hex, letters of one case, base32,
alphanumeric, base64) is inferred, and three tests ask whether its
symbols are random there:

* chi-squared uniformity over the alphabet;
* runs: the number of changes between lower case, upper case, digits and signs;
* serial correlation of neighbouring symbol values.

A candidate that fails one of them (at ``FIT``, shared among the three) is no
random key: patterns, counters and sorted or repeated symbols end there. What
passes is weighed against written text. There the chi-squared statistic is
noncentral, by at least what an index of coincidence of ``COINCIDENCE`` gives over
that alphabet and length, and kinds change at a rate of ``CHANGE_RATE`` at most;
the two tails are combined by Fisher's method to the p-value that text looks so
random. Base32 has a null of its own, capitals with few digits that stand together, against
which a likelihood ratio takes the place of the chi-squared tail. What decodes to
printable text is no key. It has the length in it, so short candidates can't be found on thin
evidence. Weighted Benjamini-Hochberg over all candidates of all documents
decides; weights grow with the length and average 1. Its threshold comes from a
histogram of the p-values in fixed bins.

Defined results: a null or empty text has no spans; repeated rows each get their
spans; ids of any type, nulls among them, are kept; an empty table gives an empty
result; other columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_columns, stage, texts

# The patterns of the base kinds and the least lengths.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    ("hex", _DIGITS + "abcdef"),
    ("hex", _DIGITS + "ABCDEF"),
    ("lower", _LOWER),
    ("upper", _LOWER.upper()),
    ("base32", _LOWER.upper() + "234567"),
    ("alnum", _DIGITS + _LOWER.upper() + _LOWER),
    ("base64", _DIGITS + _LOWER.upper() + _LOWER + "+/_-"),
)
#: Written text: its index of coincidence at least, over hex digits the divergence from uniformity, and the rate at which kinds of characters change at most.
COINCIDENCE, HEX_DIVERGENCE, CHANGE_RATE = 0.055, 1.0, 0.25
# Percent of the letters a to z in English, German, French and Spanish text.
LETTERS = (
    (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074),
    (6.5, 1.9, 2.7, 5.1, 16.4, 1.7, 3.0, 4.6, 6.6, 0.27, 1.4, 3.4, 2.5, 9.8, 2.6, 0.67, 0.02, 7.0, 7.3, 6.2, 4.2, 0.85, 1.9, 0.03, 0.04, 1.1),
    (7.6, 0.9, 3.3, 3.7, 14.7, 1.1, 0.87, 0.74, 7.5, 0.6, 0.07, 5.5, 3.0, 7.1, 5.8, 2.5, 1.4, 6.7, 7.9, 7.2, 6.3, 1.8, 0.05, 0.43, 0.13, 0.33),
    (11.5, 2.2, 4.0, 5.0, 12.2, 0.69, 1.8, 0.7, 6.2, 0.49, 0.01, 5.0, 3.2, 6.7, 8.7, 2.5, 0.88, 6.9, 8.0, 4.6, 2.9, 1.1, 0.02, 0.22, 1.0, 0.47),
)
#: Part of a written run of capitals and digits that is digits, at most, and the least percent that a letter counts with.
DIGIT_RATE, LEAST_PERCENT = 0.04, 0.07
#: Changes between capitals and digits in such a run, at most: digits stand together there.
BASE32_CHANGE_RATE = 0.12
#: Part of a decoded candidate that is UTF-8, and of that what is printable, if it is text; random bytes of candidates' lengths reach it in less than one case of 10,000.
PRINTABLE = 0.9
#: Part of random keys that the battery may lose.
FIT = 1e-3
#: Steps of -log10 p in the histogram.
BIN, BINS = 0.05, 800
FALSE_DISCOVERIES = 0.01
#: Length from which the weight of a candidate grows no more.
MOST_LENGTH = 128

SCANNED = "n_assign long, n_access long, n_hex long, base array<string>, candidates array<struct<start: int, stop: int, encoding: string, evidence: double>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_z(x: float, degrees: float) -> float:
    """Wilson and Hilferty's normal score of a chi-squared value."""
    return ((x / degrees) ** (1 / 3) - (1 - 2 / (9 * degrees))) / math.sqrt(2 / (9 * degrees))


def binomial_tail(least: int, n: int, p: float) -> float:
    """Of ``least`` or more successes."""
    return min(1.0, sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(least, n + 1)))


def kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


_kinds = {a: np.array([kind(c) for c in a]) for _, a in ALPHABETS}


def encoding(body: str) -> tuple[str, str] | None:
    """Name and alphabet of the narrowest encoding; none for digits alone, which tell nothing."""
    if len(body) < 2 or body.isdigit():
        return None
    return next(((name, a) for name, a in ALPHABETS if set(body) <= set(a)), None)


def battery(candidate: str) -> tuple[str, tuple[float, float, float], tuple[float, float]] | None:
    """Encoding; p-values of uniformity, runs and serial correlation for random symbols; those of uniformity and runs for written text."""
    body = candidate.rstrip("=")
    fits = encoding(body)
    if not fits:
        return None
    name, alphabet = fits
    n, k, kinds = len(body), len(alphabet), _kinds[alphabet]
    value = np.array([alphabet.index(c) for c in body])
    chi = float(((np.bincount(value, minlength=k) - n / k) ** 2).sum() * k / n)
    uniform = upper_tail(chi_z(chi, k - 1))
    shift = n * (HEX_DIVERGENCE if name == "hex" else k * COINCIDENCE - 1)  # noncentrality of text
    scale, degrees = (k - 1 + 2 * shift) / (k - 1 + shift), (k - 1 + shift) ** 2 / (k - 1 + 2 * shift)  # Patnaik's central equivalent
    text_uniform = upper_tail(-chi_z(chi / scale, degrees))

    of = kinds[value]
    changes, share = int((of[1:] != of[:-1]).sum()), np.bincount(kinds) / k
    same, thrice = float((share**2).sum()), float((share**3).sum())
    rate, both = 1 - same, 1 - 2 * same + thrice  # of a change, and of two in a row
    variance = (n - 1) * rate * (1 - rate) + 2 * (n - 2) * (both - rate * rate)
    runs = 1.0 if variance < 1e-9 else 2 * upper_tail(max(0.0, abs(changes - (n - 1) * rate) - 0.5) / math.sqrt(variance))
    text_runs = binomial_tail(changes, n - 1, BASE32_CHANGE_RATE if name == "base32" else CHANGE_RATE) if rate else 1.0

    x, y = value[:-1] - value[:-1].mean(), value[1:] - value[1:].mean()
    spread = math.sqrt(float((x * x).sum() * (y * y).sum()))
    r = float((x * y).sum()) / spread if spread else 1.0
    serial = 2 * upper_tail(abs(r + 1 / n) * math.sqrt(n))
    return name, (uniform, min(1.0, runs), serial), (text_uniform, text_runs)


_letter_logs = np.log(np.maximum(np.array(LETTERS), LEAST_PERCENT) / np.maximum(np.array(LETTERS), LEAST_PERCENT).sum(axis=1, keepdims=True))


def base32_text(body: str) -> float:
    """p-value that capitals and digits are written so: a likelihood ratio of random symbols to letters as the language that fits best has them (Markov's bound)."""
    letters = np.array([ord(c) - 65 for c in body if c.isalpha()], int)
    digits = len(body) - len(letters)
    written = float((_letter_logs[:, letters].sum(axis=1) + len(letters) * math.log(1 - DIGIT_RATE) + digits * math.log(DIGIT_RATE / 6)).max())
    return min(1.0, math.exp(max(-700.0, written + len(body) * math.log(32))))


def decoded_text(name: str, body: str) -> bool:
    """Whether a candidate is the encoding of printable text."""
    if name in ("alnum", "base64", "lower", "upper"):
        data = base64.b64decode(body[: len(body) // 4 * 4].replace("-", "+").replace("_", "/"))
    elif name == "base32":
        data = base64.b32decode(body[: len(body) // 8 * 8])
    else:
        return False
    text = data.decode(errors="ignore")
    return len(data) > 8 and len(text.encode()) >= PRINTABLE * len(data) and sum(c.isprintable() or c in "\t\n\r" for c in text) >= PRINTABLE * len(text)


def evidence(candidate: str) -> tuple[str, float] | None:
    """Encoding, and -log10 of the p-value that text looks so random: 0 for what isn't random."""
    tested = battery(candidate)
    if not tested:
        return None
    name, random, text = tested
    body = candidate.rstrip("=")
    if min(random) < FIT / len(random) or decoded_text(name, body):
        return name, 0.0
    if name == "base32":
        text = (base32_text(body), text[1])
    half = -sum(math.log(max(p, 1e-300)) for p in text)  # Fisher: two tests
    return name, max(0.0, (half - math.log1p(half)) / math.log(10))


def scan(batches):
    for b in batches:
        ids, rows = b["doc_id"], {k: [] for k in ("n_assign", "n_access", "n_hex", "base", "candidates")}
        for text in texts(b["text"]):
            base = base_spans(text)
            for kind, name in enumerate(("n_assign", "n_access", "n_hex")):
                rows[name].append(sum(x[1] == kind for x in base))
            rows["base"].append([f"{KINDS[k]}:{s}:{e}" for s, k, e in base])
            tried = []
            for m in CANDIDATE.finditer(text):
                if not any(x <= m.start() and m.end() <= e for x, _, e in base) and (result := evidence(m[0])):
                    tried.append({"start": m.start(), "stop": m.end(), "encoding": result[0], "evidence": result[1]})
            rows["candidates"].append(tried)
        yield {"doc_id": ids} | rows


def threshold(histogram: dict[int, int], rate: float = FALSE_DISCOVERIES) -> int:
    """Benjamini-Hochberg on binned p-values: the least bin whose upper p-value bounds the false discoveries."""
    total, found, best = sum(histogram.values()), 0, BINS + 1
    for at in sorted(histogram, reverse=True):
        found += histogram[at]
        if 10 ** (-at * BIN) <= rate * found / total:
            best = at
    return best


def find_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random`` for every row."""
    scanned = stage(map_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), scan, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {SCANNED}"), "secrets")
    weigh = lambda c: F.least(c["stop"] - c["start"], F.lit(MOST_LENGTH)).cast("double")
    each = scanned.select(F.explode("candidates").alias("c"))
    mean = each.agg(F.avg(weigh(F.col("c")))).collect()[0][0] or 1.0
    place = lambda c: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((c["evidence"] + F.log10(weigh(c) / mean)) / BIN))).cast("int")
    bins = each.groupBy(place(F.col("c")).alias("bin")).count()
    least = threshold({r[0]: r[1] for r in bins.collect()}, rate)  # at most BINS rows
    random = F.filter("candidates", lambda c: place(c) >= least)
    named = F.transform(random, lambda c: F.concat_ws(":", F.lit("random"), c["start"].cast("string"), c["stop"].cast("string")))
    order = lambda s: F.element_at(F.split(s, ":"), 2).cast("long") * 4 + F.array_position(F.array(*map(F.lit, KINDS)), F.element_at(F.split(s, ":"), 1)).cast("int") - 1
    spans = F.array_sort(F.concat("base", named), lambda a, b: F.when(order(a) < order(b), -1).when(order(a) > order(b), 1).otherwise(0))
    return scanned.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(F.concat_ws(",", "base").cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", spans).alias("spans"),
        F.size(random).cast("long").alias("n_random"),
    )


def secret_digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()
