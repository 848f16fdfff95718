"""Streams whose rows may arrive in any order within a bound: state, a reordering buffer in it, and event-time timers.

Rows wait in the state of their key until the watermark has passed their time, when nothing earlier can come; then they are
taken in order. A row that comes after the watermark has passed its time is late: it changes nothing and is told as late.
The last rows of a stream wait until later ones, of any key, move the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of a session that streams of a session made from it should have too.
CARRIED = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.checkpoint.dir")


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` for streams with state of several kinds, which only one kind of store can hold.

    ``spark`` itself is left as it is. Streams read by the new session are the ones to use; tables are shared.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    for key in CARRIED:
        value = spark.conf.get(key, None)
        if value is not None and key != "spark.checkpoint.dir":
            own.conf.set(key, value)
    return own


def grouped(rows: DataFrame, key: str, at: str, delay: str, payload: Iterable[str | Column]) -> GroupedData:
    """``rows`` by ``key`` for an :class:`InOrder` processor: event time ``at`` with a watermark ``delay`` behind, the rest as JSON.

    Rows without a time are late. The time is handed over as a number, so that Spark itself drops no late row.
    """
    told = rows.withWatermark(at, delay)
    return told.select(key, F.coalesce(F.unix_millis(at), F.lit(-1)).alias("event_ms"), F.to_json(F.struct(*payload)).alias("event_json")).groupBy(key)


class InOrder(StatefulProcessor):
    """Takes a key's rows in order. Subclasses say what that order is, what a row does, and what is told of a late one.

    The state is what waits, and one value that subclasses read and write as ``self.memory``.
    """

    #: The column of the key, and those of the output after it.
    key = "file_id"
    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, payload string")
        self.value = handle.getValueState("memory", "value string")

    def order(self, at: int, row: dict[str, Any]) -> Any:
        raise NotImplementedError

    def take(self, at: int, row: dict[str, Any]) -> Iterator[tuple]:
        raise NotImplementedError

    def late(self, row: dict[str, Any]) -> Iterator[tuple]:
        raise NotImplementedError

    def passed(self, mark: int) -> Iterator[tuple]:
        """Once the rows before ``mark`` have been taken."""
        yield from ()

    def wake(self) -> int | None:
        """When to be woken even if no row waits."""
        return None

    def told(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=[self.key, *self.columns], dtype=object)

    def load(self) -> None:
        self.memory: dict[str, Any] = json.loads(self.value.get()[0]) if self.value.exists() else {}

    def save(self) -> None:
        if self.memory:
            self.value.update((json.dumps(self.memory),))
        elif self.value.exists():
            self.value.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, fresh, out = timerValues.getCurrentWatermarkInMs(), [], []
        for batch in rows:
            for at, payload in zip(batch["event_ms"], batch["event_json"]):
                if at < mark or at < 0:
                    out.extend(self.late(json.loads(payload)))
                else:
                    fresh.append((int(at), payload))
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(at for at, _ in fresh) + 1)
        yield from self.told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        rest = [r for r in rows if r[0] >= mark]
        ready = [(int(r[0]), json.loads(r[1])) for r in rows if r[0] < mark]
        if ready:
            if rest:
                self.waiting.put([tuple(r) for r in rest])
            else:
                self.waiting.clear()
        self.load()
        out: list[tuple] = []
        for at, row in sorted(ready, key=lambda x: self.order(*x)):
            out.extend(self.take(at, row))
        out.extend(self.passed(mark))
        self.save()
        # one timer is enough, for the first of what is still to come
        ahead = [t for t in (min((r[0] + 1 for r in rest), default=None), self.wake()) if t is not None]
        if ahead:
            self.handle.registerTimer(max(min(ahead), mark + 1))
        yield from self.told(key, out)

    def close(self) -> None:
        pass


def milliseconds(span: timedelta) -> int:
    return span // timedelta(milliseconds=1)
