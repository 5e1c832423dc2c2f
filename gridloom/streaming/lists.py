"""List counters over items that arrive out of order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Spark keeps lists and timers in this store only.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ITEMS = "ts long, ord long, level int"


class _Counters(StatefulProcessor):
    """Holds a document's items until the watermark has passed them, then counts them in order; what is kept of those counted is one number a level."""

    def __init__(self, document: str):
        self.document = document

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", ITEMS)
        self.counts = handle.getValueState("counts", "counts array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            times = frame["ts"].astype("datetime64[ms]").astype("int64")
            kept = [(int(t), int(o), int(level)) for t, o, level in zip(times, frame["ord"], frame["level"], strict=True) if t > passed]
            if kept:
                self.pending.appendList(kept)
                for t in {t for t, _, _ in kept}:
                    self.handle.registerTimer(t)
        yield from ()

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.pending.get())
        ready = [r for r in held if r[0] <= passed]
        if not ready:
            return
        rest = [r for r in held if r[0] > passed]
        if rest:
            self.pending.put(rest)
        else:
            self.pending.clear()
        counts = list(self.counts.get()[0]) if self.counts.exists() else []
        out = []
        for _, ord_, level in ready:
            counts = (counts + [0] * (level + 1))[: level + 1]
            counts[level] += 1
            out.append((key[0], ord_, level, counts[level]))
        self.counts.update((counts,))
        yield pd.DataFrame(out, columns=[self.document, "ord", "level", "counter"])


def counted(items: DataFrame, document: str) -> DataFrame:
    """``counter`` of list items (``document, ts, ord, level``) as :func:`gridloom.operators.documents.list_counters` gives it, for a stream with a watermark on ``ts``.

    Items are counted in the order of their times, and of ``ord`` at one time,
    once the watermark has passed them; those that come after that are dropped, as in any
    windowed aggregation.
    """
    kind = dict(items.dtypes)[document]
    return items.select(document, "ts", "ord", "level").groupBy(document).transformWithStateInPandas(
        _Counters(document), f"{document} {kind}, ord long, level int, counter int", outputMode="Append", timeMode="EventTime"
    )
