"""Memory from a live stream of exchanges: the rows of ``operators/builder.py`` with typed keyed state.

Of each sample the state holds its counter and last time (a value), its open trajectories and the claims they hold (two maps by
trajectory number). A micro-batch writes the trajectories that it changed and no others, and an event-time timer closes those of a
sample that has been idle. Exchanges behind the watermark are dropped, as in any stream. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.build import CONTINUE
from ..operators.builder import ROWS, MemoryBuilder, Trajectory, exchanges, frame

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class MemoryProcessor(StatefulProcessor):
    def __init__(self, most: int, least: float, idle: str):
        self.most, self.least, self.wait = most, least, pd.Timedelta(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "next long, last long, timer long")
        self.open = handle.getMapState("open", "n long", "words array<string>, latest array<string>, length int, message_id long")
        self.claims = handle.getMapState("claims", "n long", "ids array<string>, texts array<string>, statuses array<string>")

    def _load(self, sample: str) -> tuple[MemoryBuilder, int | None]:
        builder = MemoryBuilder(sample, self.most, self.least, self.wait)
        timer = None
        if not self.head.exists():
            return builder, timer
        builder.next, last, timer = self.head.get()
        builder.last = pd.Timestamp(last, unit="us")
        for (n,), (words, latest, length, message_id) in self.open.iterator():
            held = self.claims.getValue((n,)) if self.claims.containsKey((n,)) else ([], [], [])
            builder.open[n] = Trajectory(set(words), set(latest), length, message_id, list(zip(*held, strict=True)))
        return builder, timer

    def _store(self, builder: MemoryBuilder, timer: int | None, stored: set[int]) -> None:
        # each call crosses to the JVM: what opened and closed in between was never stored
        for n in builder.closed & stored:
            self.open.removeKey((n,))
            self.claims.removeKey((n,))
        for n in builder.touched:
            t = builder.open[n]
            self.open.updateValue((n,), (sorted(t.words), sorted(t.latest), t.length, t.message_id))
            self.claims.updateValue((n,), tuple([c[k] for c in t.claims] for k in range(3)))
        self.head.update((builder.next, builder.last.value // 1000, timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        builder, timer = self._load(key[0])
        stored, out = set(builder.open), []
        # in order of time, then id: the batches of one micro-batch come in any order
        for r in pd.concat(list(rows)).sort_values(["ts", "message_id"], kind="stable").itertuples(index=False):
            out += builder.add(r.message_id, r.ts, r.terms, r.names, [(c["text"], c["status"]) for c in r.claims])
        due = (builder.last.value // 1_000_000) + int(self.wait.total_seconds() * 1000) + 1
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        self._store(builder, due, stored)
        yield frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        builder, timer = self._load(key[0])
        if timer is not None and expiredTimerInfo.getExpiryTimeInMs() < timer:
            return
        stored = set(builder.open)
        out = builder.close_all("idle")
        self._store(builder, None, stored)
        yield frame(out)

    def close(self) -> None:
        pass


def stream_memory(table: DataFrame, most: int, least: float = CONTINUE, idle: str = "7 days") -> DataFrame:
    """A stream of exchanges with a watermark on ts -> the rows of ``build_memory``, trajectories as they close."""
    table.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return exchanges(table).groupBy("sample_id").transformWithStateInPandas(MemoryProcessor(most, least, idle), ROWS, "Append", "EventTime")
