"""Token counts and ids from public tokenizer files, as their libraries give them: tokenizers for .json, sentencepiece for .model.

A tokenizer whose rules never look across ASCII white space (it is dropped, and
no added token or pre-tokenizer pattern contains it) encodes a text as the
concatenation of its white-space separated pieces. Pieces recur, so each is
encoded once per worker and looked up after that. Likewise a sentencepiece model
whose pieces have the space mark in front only: no merge crosses from a
character to the space after it, so a text is the concatenation of its words.
Any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers; it starts anew beyond that, with the same results.
REMEMBERED = 400_000

_open: dict[str, PieceTokenizer | SentenceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer | SentenceTokenizer:
    """One per worker process and file."""
    if path not in _open:
        _open[path] = (SentenceTokenizer if path.endswith(".model") else PieceTokenizer)(path)
    return _open[path]


def version_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def drops_white_space(rules: dict) -> bool:
    """Whether pieces between ASCII white space are encoded independently."""
    steps = rules["normalizer"] or {}
    steps = steps.get("normalizers", [steps])
    split = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
    pattern = split.get("pattern", {}).get("Regex", "")
    removed = split.get("behavior") == "Removed" and split.get("invert")
    known = all(s.get("type") in ("NFC", "Lowercase") or s.get("pattern", {}).get("Regex") == r"\s+" for s in steps)
    apart = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]]) for t in rules["added_tokens"])
    # The pattern keeps no white space: its only negated class excludes it and it has no lookaround.
    return bool(known and removed and apart and r"[^\s" in pattern and "(?" not in pattern and " " not in pattern)


class PieceTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.by_piece = drops_white_space(json.load(f))
        self.inner = Tokenizer.from_file(path)
        self.size = self.inner.get_vocab_size()
        self.inner.no_truncation()
        self.inner.no_padding()
        self._lengths: dict[bytes, int] = {}
        self._ids: dict[bytes, np.ndarray] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.inner.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_piece:
            return [len(x) for x in self.encode(texts)]
        out, known = [], self._lengths
        for at in range(0, len(texts), 64):
            pieces = [t.encode().split() for t in texts[at : at + 64]]
            self._learn(pieces, known, len)
            out += [sum(map(known.__getitem__, p)) for p in pieces]
        return out

    def ids(self, texts: list[str], kind=np.uint16) -> list[np.ndarray]:
        if not self.by_piece:
            return [np.array(x, kind) for x in self.encode(texts)]
        out, known = [], self._ids
        for at in range(0, len(texts), 64):
            pieces = [t.encode().split() for t in texts[at : at + 64]]
            self._learn(pieces, known, lambda x: np.array(x, kind).tobytes())
            out += [np.frombuffer(b"".join(map(known.__getitem__, p)), kind) for p in pieces]
        return out

    def _learn(self, pieces: list[list[bytes]], known: dict, keep) -> None:
        seen = set().union(*pieces)
        if len(known) > REMEMBERED:
            known.clear()
        new = list(seen.difference(known))
        known.update(zip(new, (keep(x) for x in self.encode([p.decode() for p in new])), strict=True))


SPACE = "\u2581"
#: What normalisers change where they change anything: compatibility forms, marks, spaces and controls.
PROBES = "\ufb01 A\u030a \u2460 \uff71 \u00a0 \u200b \u0085 \t \r \x0b \x00 \u2028 \u212b e\u0301 \u1e9b\u0323 \u3000 \u00ad"


class SentenceTokenizer:
    by_piece = False  # what counts are asked by may keep its spaces: they are tokens here

    def __init__(self, path: str):
        import sentencepiece

        self.inner = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.inner.get_piece_size()
        pieces = map(self.inner.id_to_piece, range(self.size))
        plain = self.inner.normalize(PROBES) == SPACE + PROBES.replace(" ", SPACE)
        self.by_word = plain and all(SPACE not in p.lstrip(SPACE) for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.inner.encode(texts, num_threads=1) if texts else []

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.ids(texts)]

    def ids(self, texts: list[str], kind=np.uint16) -> list[np.ndarray]:
        """Each distinct word of the texts is encoded once."""
        apart = [i for i, t in enumerate(texts) if self._apart(t)]
        out = dict(zip(apart, self._by_word([texts[i] for i in apart], kind), strict=True))
        rest = [i for i in range(len(texts)) if i not in out]
        for at in range(0, len(rest), 64):
            some = rest[at : at + 64]
            out |= zip(some, (np.array(x, kind) for x in self.encode([texts[i] for i in some])), strict=True)
        return [out[i] for i in range(len(texts))]

    def _by_word(self, texts: list[str], kind) -> list[np.ndarray]:
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        found, at = self.encode(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), kind, int(sizes.sum()))
        many = sizes[at]
        stops = np.cumsum(many)
        # Each word's ids stand where its first does; the others follow.
        place = np.repeat((np.cumsum(sizes) - sizes)[at] - stops + many, many)
        place += np.arange(len(place))
        taken = ids[place]
        ends = np.r_[0, stops][split.offsets.to_numpy()]
        return np.split(taken, ends[1:-1])

    def _apart(self, text: str) -> bool:
        """Whether the words behind single spaces make up the text."""
        return self.by_word and "  " not in text and SPACE not in text and text[:1] != " " and text[-1:] != " "
