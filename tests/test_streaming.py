"""Streams over what a folder holds give what a batch gives."""

from __future__ import annotations

import datetime
import os
import random

from pyspark.sql import functions as F

from gridloom.operators import documents
from gridloom.streaming import arrivals, events, lists

SF = "/root/testdata/sf0.001"


def _folder(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(path)
    return path


def test_tumbling_windows_equal_the_batch(spark, tmp_path):
    path = _folder(spark, tmp_path)
    batch = spark.read.parquet(path)
    stream = events.event_stream(spark, path, batch.schema, late="40 days")
    got = events.once(events.tumbling(stream, "1 day"), "tumbled", str(tmp_path / "c1"), "complete")
    rows = lambda df: sorted((r.w.start, r.event_type, r.n, round(r.total, 4)) for r in df.collect())
    assert rows(got) == rows(events.tumbling(batch, "1 day"))


def test_sliding_windows_count_each_event_once_a_window(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    assert events.sliding(batch, "2 days", "1 day").agg(F.sum("n")).collect()[0][0] == 2 * batch.count()


def test_sessions_in_a_stream(spark, tmp_path):
    path = _folder(spark, tmp_path)
    batch = spark.read.parquet(path)
    stream = events.event_stream(spark, path, batch.schema, late="40 days")
    got = events.once(events.sessions(stream, "6 hours"), "sessions", str(tmp_path / "c2"), "complete")
    rows = lambda df: sorted((r.w.start, r.user_id, r.n) for r in df.collect())
    assert rows(got) == rows(events.sessions(batch, "6 hours"))


ITEMS = "doc string, ts timestamp, ord long, level int"


def _written(spark, tmp_path, batches):
    """Each batch as one file, in the order of their times."""
    path = tmp_path / "items"
    path.mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, ITEMS).coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        part = next(p for p in (tmp_path / f"w{n}").iterdir() if p.name.endswith(".parquet"))
        os.rename(part, path / f"{n}.parquet")
        os.utime(path / f"{n}.parquet", (1_700_000_000 + n * 10,) * 2)
    return str(path)


def test_list_counters_of_a_stream_equal_the_batch(spark, tmp_path):
    rng, start = random.Random(6), datetime.datetime(2024, 1, 1)
    at = lambda minute: start + datetime.timedelta(minutes=minute)
    rows = [(f"d{rng.randrange(4)}", at(n), n, rng.choice([0, 1, 1, 2])) for n in range(120)]
    late = [r for r in rows if r[2] % 10 == 3]  # ten minutes late: within the watermark
    batches = [[r for r in rows if lo <= r[2] < lo + 40 and r not in late] + [r for r in late if lo - 40 <= r[2] < lo] for lo in (0, 40, 80)]
    batches[-1] += [r for r in late if r[2] >= 80]
    gone = [("d0", at(1), 5000, 0)]  # after the watermark
    batches += [[("d9", at(100_000), 9000, 0)], [*gone, ("d9", at(200_000), 9001, 0)]]
    path = _written(spark, tmp_path, batches)
    stream = spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "60 minutes")
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", lists.STORE)
    try:
        got = events.once(lists.counted(stream, "doc"), "counted", str(tmp_path / "c3"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    batch = documents.list_counters(spark.createDataFrame(rows, ITEMS), ["doc"], "ord", "level", deepest=3)
    same = lambda df: sorted((r.doc, r.ord, r.level, r.counter) for r in df.collect())
    assert same(got.where("doc != 'd9'")) == same(batch) and got.where("ord = 5000").count() == 0


def test_copies_of_arriving_files(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for n, content in enumerate((b"a", b"b", b"a", b"c", b"b")):
        (folder / f"{n}.xlsx").write_bytes(content)
        os.utime(folder / f"{n}.xlsx", (1_700_000_000 + n,) * 2)
    stream = arrivals.first_copies(arrivals.arriving(spark, str(folder), a_time=1)).selectExpr("substring_index(path, '/', -1) as name")
    assert sorted(r.name for r in events.once(stream, "copies", str(tmp_path / "c4")).collect()) == ["0.xlsx", "1.xlsx", "3.xlsx"]


def test_events_that_come_too_late(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    at = lambda hour: start + datetime.timedelta(hours=hour)
    path = _written(spark, tmp_path, [[("d", at(0), 0, 0), ("d", at(1), 1, 0)], [("d", at(50), 2, 0), ("d", at(2), 3, 0)], [("d", at(100), 5, 0)], [("d", at(3), 4, 0)], [("d", at(200), 6, 0)]])
    stream = spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "5 hours").selectExpr("ts", "doc as event_type", "cast(ord as double) as value")
    got = {r.w.start: r.n for r in events.once(events.sliding(stream, "4 hours", "4 hours"), "slid", str(tmp_path / "c5")).collect()}
    assert got == {at(0): 3, at(48): 1, at(100): 1}  # what came at hour 3 after the watermark had passed 4 is gone
