from __future__ import annotations

import hashlib
import random
import re
import string

from gridloom.llm import secrets

from .conftest import DOCS, document


def literal(text):
    """The fixed patterns as they are stated, filtered after matching."""
    out = []
    for kind, pattern, fits in (
        (0, r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12),
        (1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        (2, r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if fits(m)]
    return sorted(out)


def test_base_spans():
    rng = random.Random(3)
    parts = ["password", "TOKEN", "api_key", "apikey", "ſecret", "secret", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH1234567890", "0123456789abcdef", "deadbeef", "abcdefghijkl", "token: secret = ", "é", "x.y/z-_", "toKen"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert secrets.base_spans(text) == literal(text), text


def test_battery_tells_random_from_language(spark):
    rng = random.Random(1)
    b64 = string.ascii_letters + string.digits + "+/"
    rows, n = [], 0
    for _ in range(60):
        key = "".join(rng.choice(b64) for _ in range(44))
        rows.append(document(n, f"before it {key} after"))
        n += 1
    for _ in range(300):
        word = "".join(rng.choice(["tion", "the", "en", "er", "ing", "ment", "ly"]) for _ in range(rng.randrange(6, 14)))
        rows.append(document(n, f"some {word} and {'=' * 40} {'abc_' * 12} more"))
        n += 1
    found = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(found[i].n_random > 0 for i in range(60)) >= 57
    assert sum(found[i].n_random > 0 for i in range(60, n)) <= 1
    hit = next(found[i] for i in range(60) if found[i].n_random)
    kind, start, stop = hit.spans.split(",")[-1].split(":")
    assert kind == "random" and int(stop) - int(start) == 44 and int(start) == 10


def test_odd_rows(spark, odd, empty):
    rows = {r.doc_id: r for r in secrets.find_secrets(odd).collect()}
    assert secrets.find_secrets(odd).count() == odd.count()
    assert rows[2].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[2].spans == "" and rows[1].n_hex == 0
    assert rows[7].n_assign == 1 and "assign:" in rows[7].spans
    assert secrets.find_secrets(empty).count() == 0


def test_threshold():
    assert secrets.threshold({}) > secrets.BINS
    assert secrets.threshold({0: 99}) > secrets.BINS
    assert secrets.threshold({0: 99, 100: 1}) == 100


def joined_words(rng, n):
    """Runs of a document's words without the spaces, 20 characters or more."""
    import pyarrow.parquet as pq

    out, texts = [], [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t and len(t) > 500]
    while len(out) < n:
        words = re.findall(r"[A-Za-z]+", rng.choice(texts))
        at = rng.randrange(max(1, len(words) - 12))
        run = rng.choice(["", "", "_", "-"]).join(words[at : at + rng.randrange(3, 9)])
        if len(run) >= 20:
            out.append(run)
    return out


def test_p_values_of_random_symbols_are_even():
    rng = random.Random(8)
    for name, alphabet in dict(secrets.ALPHABETS).items():
        found = [secrets.battery("".join(rng.choice(alphabet) for _ in range(rng.randrange(30, 90)))) for _ in range(1500)]
        tests = [t for got, t, _ in found if got == name]
        assert len(tests) > 1000
        for i, test in enumerate(("uniform", "runs", "serial")):
            low = sum(t[i] < 0.05 for t in tests) / len(tests)
            assert (low < 0.09 and (low > 0.02 or i == 1)), (name, test, low)
        assert sum(min(t) < secrets.FIT / 3 for t in tests) / len(tests) < 0.01


def test_text_is_no_evidence():
    tried = [secrets.evidence(x) for x in joined_words(random.Random(4), 3000)]
    scores = [x[1] for x in tried if x]
    assert len(scores) > 2500
    for level in (1, 2, 3, 4):
        assert sum(s >= level for s in scores) / len(scores) <= 10**-level


def test_few_keys_among_much_text(spark):
    rng = random.Random(9)
    b64 = string.ascii_letters + string.digits + "+/"
    keys = ["".join(rng.choice(b64) for _ in range(n)) for n in [32, 40, 44, 64] * 5]
    ordinary = joined_words(rng, 20_000)
    rows = [document(i, " ".join(ordinary[i::1000] + ([keys[i // 50]] if i % 50 == 0 else []))) for i in range(1000)]
    found = secrets.find_secrets(spark.createDataFrame(rows, DOCS)).collect()
    hits = [rows[r.doc_id][1][int(s.split(":")[1]) : int(s.split(":")[2])] for r in found for s in r.spans.split(",") if s.startswith("random")]
    assert len(set(keys) & set(hits)) >= 19 and len(set(hits) - set(keys)) <= 1


def test_base32_keys_and_encoded_text():
    import base64

    rng, upper = random.Random(12), string.ascii_uppercase + "234567"
    strong = lambda xs, least: sum((secrets.evidence(x) or ("", 0.0))[1] >= least for x in xs) / len(xs)
    for n, part in ((32, 0.85), (40, 0.9), (52, 0.95)):
        assert strong(["".join(rng.choice(upper) for _ in range(n)) for _ in range(600)], 4) >= part, n
    text = joined_words(rng, 2000)
    for way in (base64.b64encode, base64.urlsafe_b64encode, base64.b32encode):
        assert strong([way(f"{a} {b}"[: rng.randrange(24, 60)].encode()).decode() for a, b in zip(text, text[1:])], 1) < 0.01
    written = []
    for x in text:  # capitals with numbers in them
        y = re.sub("[_-]", "", x.upper())
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(y))
            y = y[:at] + "".join(rng.choice("234567") for _ in range(rng.randrange(1, 4))) + y[at:]
        written.append(y)
    for level in (1, 2, 3):
        assert strong(written, level) <= 10**-level
