"""Typed state by key: what a stream remembers of a user, and timers in event time.

These run on ``transformWithStateInPandas``, whose state is kept by RocksDB: a task holds a key's rows of one batch, not the state of
all keys. ``jobs.run_once`` sets the store up for the query that it starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class PriceDrops(StatefulProcessor):
    """Rows (ts, event_id, cents) of a key that are cheaper than the one before: event_id, current, previous.

    The state is the last price. Rows of a batch are put in order; a row that is later than the ones of
    an earlier batch is compared in the order of arrival.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "cents long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        before = self.last.get()[0] if self.last.exists() else None
        prices = [int(c) for c in frame["cents"]]
        self.last.update((prices[-1],))
        ids = [int(i) for i in frame["event_id"]]
        hits = [(i, c, p) for i, c, p in zip(ids, prices, [before, *prices[:-1]], strict=True) if p is not None and p > 0 and c < p]
        yield pd.DataFrame({"user_id": [key[0]] * len(hits), **{c: [h[k] for h in hits] for k, c in enumerate(("event_id", "current", "previous"))}})

    def close(self) -> None:
        pass


class EndedKeys(StatefulProcessor):
    """The last row (event_id, millis) of each (user_id, event_type) once it hasn't been seen for ``hours``.

    The keys of this processor are buckets of such keys, so Python is called for each bucket of a batch and not for each key. The state
    is the last rows of a bucket's keys and one timer at the first of their ends; as it fires, the rows that have ended leave.
    """

    # A column with nulls would reach pandas as floats, so a null user is told by ``nobody``.
    KEY, LAST = ["user_id", "nobody", "event_type"], ["millis", "event_id"]
    COLUMNS = [*KEY, "event_id", "millis"]

    def __init__(self, hours: int) -> None:
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getListState("newest", "user_id long, nobody boolean, event_type string, event_id long, millis long")

    def _stored(self) -> pd.DataFrame:
        rows = list(self.newest.get()) if self.newest.exists() else []
        return pd.DataFrame(rows, columns=self.COLUMNS)

    def _store(self, rows: pd.DataFrame, watermark: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rows.empty:
            self.newest.clear()
            return
        self.newest.put(list(zip(*(rows[c].tolist() for c in self.COLUMNS), strict=True)))
        self.handle.registerTimer(max(int(rows["millis"].min()) + self.hours * 3_600_000, watermark + 1))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        newest = self._stored()
        for frame in rows:
            both = pd.concat([newest, frame[self.COLUMNS]]) if len(newest) else frame[self.COLUMNS]
            newest = both.sort_values(self.LAST).drop_duplicates(self.KEY, keep="last")
        self._store(newest, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        newest, watermark = self._stored(), timerValues.getCurrentWatermarkInMs()
        ended = newest["millis"] + self.hours * 3_600_000 < watermark
        self._store(newest[~ended], watermark)
        yield newest[ended].rename(columns={"millis": "last"})

    def close(self) -> None:
        pass
