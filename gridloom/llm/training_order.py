"""Training-order materialisation of token ids in fixed-stride binary shards.

Documents are tokenised, joined with an end token and packed into sequences of
``length`` ids, split by split of the input; only a split's last sequence is
padded. A keyed Feistel permutation with cycle-walking sends each sequence's
number to its global slot. Range partitions of the slots write one binary file
a shard: record ``slot % per_shard`` starts at that many strides, so any run of
slots is read sequentially and a reader resumes anywhere.

Each document is tokenised once: sequences carry their split and their number in
it, are written to the shared folder, and counted there, which gives every split
its first number. Splits follow from the files and fixed settings (``settle``), so
the order is the same on every cluster that reads the same files. Shard files are
renamed into place when complete, so a repeated task can only write the same file
again.

Defined results: a null or empty text is an end token alone; null ids are kept
as null; repeated rows are repeated in the sequences; an empty table gives no
sequences and no shards; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import posixpath
import zlib
from functools import reduce

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .shared import file_system, map_columns, settle, stage, stage_path, texts, write_whole

LENGTH, PER_SHARD, ROUNDS = 2048, 4096, 6
#: Records in a batch, of which those of one shard travel together.
GATHERED = 8000


def feistel(numbers: np.ndarray, count: int, key: bytes) -> np.ndarray:
    """Permutation of ``range(count)``: a balanced Feistel network over the next even number of bits, walked until inside."""
    half = max(1, (max(1, int(count - 1).bit_length()) + 1) // 2)
    mask, half_bits = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(bytes([i]), key=key, digest_size=8).digest(), "big")) for i in range(ROUNDS)]

    def once(x):
        left, right = x >> half_bits, x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (f >> np.uint64(32)) & mask
        return left << half_bits | right

    out = once(numbers.astype(np.uint64))
    outside = np.flatnonzero(out >= count)
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= count]
    return out.astype(np.int64)


def packed(docs: DataFrame, tokenizer_path: str, end_token: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``split, number, n_tokens, doc_ids, ids``: sequences numbered within each split of the input; ids are little-endian uint16 or uint32."""
    kind, dtype = docs.schema[id_col].dataType.simpleString(), id_type(tokenizer_path)
    names = ("split", "number", "n_tokens", "doc_ids", "ids")

    def work(batches):
        split, number, end = TaskContext.get().partitionId(), 0, np.array([end_token], dtype)
        open_, open_ids, filled = [], [], 0

        def rows(full):
            nonlocal number
            numbers = range(number, number := number + len(full))
            padded = [np.concatenate([t, np.full(length - len(t), end_token, dtype)]).tobytes() for t, _ in full]
            return dict(zip(names, ([split] * len(full), list(numbers), [len(t) for t, _ in full], [d for _, d in full], padded), strict=True))

        for b in batches:
            full = []
            for doc_id, ids in zip(b["doc_id"].to_pylist(), bpe.tokenizer(tokenizer_path).ids(texts(b["text"]), dtype), strict=True):
                ids = np.concatenate([ids, end])
                while len(ids):
                    part, ids = ids[: length - filled], ids[length - filled :]
                    open_.append(part)
                    open_ids.append(doc_id)
                    filled += len(part)
                    if filled == length:
                        full.append((np.concatenate(open_), open_ids))
                        open_, open_ids, filled = [], [], 0
            yield rows(full)
        if open_:
            yield rows([(np.concatenate(open_), open_ids)])

    asked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_columns(asked, work, f"split int, number long, n_tokens int, doc_ids array<{kind}>, ids binary")


def sequences(docs: DataFrame, tokenizer_path: str, end_token: int, length: int = LENGTH, key: bytes = b"order", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """``slot, n_tokens, doc_ids, ids`` and the number of sequences."""
    spark = docs.sparkSession
    settle(spark)
    rows = stage(packed(docs, tokenizer_path, end_token, length, id_col, text_col), "sequences", "zstd")
    base, total = {}, 0
    for split, n in sorted(map(tuple, rows.groupBy("split").count().collect())):  # a row a split
        base[split] = total
        total += n
    held = spark.sparkContext.broadcast(base)

    def work(batches):
        for b in batches:
            first = np.array([held.value[s] for s in b["split"].to_pylist()], np.int64)
            yield {"slot": feistel(first + b["number"].to_numpy(), total, key)} | {n: b[n] for n in ("n_tokens", "doc_ids", "ids")}

    return map_columns(rows, work, f"slot long, n_tokens int, doc_ids {rows.schema['doc_ids'].dataType.simpleString()}, ids binary"), total


def id_type(tokenizer_path: str) -> np.dtype:
    return np.dtype("<u2" if bpe.tokenizer(tokenizer_path).size <= 1 << 16 else "<u4")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def gathered(rows: DataFrame, per_shard: int) -> DataFrame:
    """``shard, slots, n_tokens, doc_ids, blob``: a batch's records of one shard in slot order, compressed together, so that little is shuffled."""
    kind = rows.schema["doc_ids"].dataType.simpleString()

    def work(batches):
        for b in batches:
            slots = b["slot"].to_numpy()
            order = np.argsort(slots)
            shards = slots[order] // per_shard
            parts = np.split(order, np.flatnonzero(np.diff(shards)) + 1) if len(order) else []
            pick = lambda values: [[values[i] for i in part.tolist()] for part in parts]
            ids = b["ids"].to_pylist()
            yield {
                "shard": [int(slots[part[0]]) // per_shard for part in parts], "slots": [slots[part] for part in parts],
                "n_tokens": pick(b["n_tokens"].to_pylist()), "doc_ids": pick(b["doc_ids"].to_pylist()),
                "blob": [zstandard.compress(b"".join(ids[i] for i in part.tolist())) for part in parts],
            }

    return map_columns(rows, work, f"shard long, slots array<long>, n_tokens array<int>, doc_ids array<{kind}>, blob binary", GATHERED)


def write_shards(rows: DataFrame, total: int, path: str, per_shard: int = PER_SHARD) -> DataFrame:
    """Write the shards below ``path``; ``slot, shard, byte_offset, n_bytes, n_tokens, doc_ids, crc32`` of every record, staged.

    A task holds one shard at a time: ``per_shard`` records.
    """
    spark = rows.sparkSession
    kind = rows.schema["doc_ids"].dataType.simpleString()
    n_shards = max(1, -(-total // per_shard))
    # No more partitions than shards; a partition writes whole shards one after the other.
    parts = min(n_shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_shards // 8))
    dealt = gathered(rows, per_shard).repartitionById(parts, F.expr(f"cast(shard * {parts} div {n_shards} as int)")).sortWithinPartitions("shard")

    def written(shard, held):
        records = sorted((r for piece in held for r in piece), key=lambda r: r[0])
        if [r[0] for r in records] != list(range(shard * per_shard, shard * per_shard + len(records))):
            raise RuntimeError(f"shard {shard} lacks slots")
        write_whole(posixpath.join(path, shard_name(shard)), b"".join(r[3] for r in records))
        sizes = [len(r[3]) for r in records]
        return {
            "slot": [r[0] for r in records], "shard": [shard] * len(records), "byte_offset": [i * sizes[0] for i in range(len(records))], "n_bytes": sizes,
            "n_tokens": [r[1] for r in records], "doc_ids": [r[2] for r in records], "crc32": [zlib.crc32(r[3]) for r in records],
        }

    def work(batches):
        at, held = None, []
        for b in batches:
            for shard, slots, n_tokens, doc_ids, blob in zip(*(b[n].to_pylist() for n in ("shard", "slots", "n_tokens", "doc_ids", "blob")), strict=True):
                if shard != at:
                    if held:
                        yield written(at, held)
                    at, held = shard, []
                data = zstandard.decompress(blob)
                size = len(data) // len(slots)
                held.append([(s, n, d, data[i * size : (i + 1) * size]) for i, (s, n, d) in enumerate(zip(slots, n_tokens, doc_ids, strict=True))])
        if held:
            yield written(at, held)

    schema = f"slot long, shard long, byte_offset long, n_bytes int, n_tokens int, doc_ids {kind}, crc32 long"
    return stage(map_columns(dealt, work, schema, GATHERED), "shard-index")


def read_slots(path: str, first: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD, dtype="<u2") -> np.ndarray:
    """Records ``first`` and on, as an array of ``count`` rows; one seek a shard."""
    store, root = file_system(path)
    stride, out = length * np.dtype(dtype).itemsize, []
    while count:
        shard, record = divmod(first, per_shard)
        n = min(count, per_shard - record)
        with store.open_input_file(posixpath.join(root, shard_name(shard))) as f:
            f.seek(record * stride)
            out.append(np.frombuffer(f.read(n * stride), dtype).reshape(n, length))
        first, count = first + n, count - n
    return reduce(lambda a, b: np.vstack([a, b]), out) if out else np.empty((0, length), dtype)


def materialise(docs: DataFrame, tokenizer_path: str, end_token: int, path: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, key: bytes = b"order", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, permute and write all documents; the index of the written records."""
    rows, total = sequences(docs, tokenizer_path, end_token, length, key, id_col, text_col)
    return write_shards(rows, total, path or stage_path(docs.sparkSession, "shards"), per_shard)
