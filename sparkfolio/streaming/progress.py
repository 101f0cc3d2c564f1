"""Progress streams as sessions: every session ends once, by a result, an error or a cancellation, or is told to be silent.

State is one row per session, kept by a stateful operator with event-time
timers, so that it outlives executors and goes when a session is long over.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Types of events, those that end a session last.
TERMINAL = ["result", "error", "cancelled"]
TYPES = ["stage", *TERMINAL]
EVENT = "session STRING, type STRING, stage STRING, round INT, query STRING, error STRING, ts TIMESTAMP"
OUT = "session STRING, kind STRING, type STRING, stages LONG, stage STRING, error STRING, ts TIMESTAMP"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(lines: DataFrame) -> DataFrame:
    """EVENT rows of JSON lines (value); lines that aren't events of a session with a time are left out."""
    e = F.from_json("value", EVENT)
    return lines.select(e.alias("e")).select("e.*").where(F.col("type").isin(TYPES) & F.col("session").isNotNull() & F.col("ts").isNotNull())


class Sessions(StatefulProcessor):
    """Of each session: ``closed`` with its first terminal event, ``refused`` for whatever comes later, ``silent`` if nothing came for too long.

    A silent session that speaks again goes on. A closed one is remembered for
    ``keep``, then forgotten.
    """

    def __init__(self, silence: timedelta, keep: timedelta):
        self.silence, self.keep = int(silence.total_seconds() * 1000), int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "closed BOOLEAN, stages LONG, stage STRING, last LONG, timer LONG")

    def _due(self, held: tuple, at: int) -> tuple:
        """The state with a timer at ``at`` instead of the one it has."""
        if held[4] is not None:
            self.handle.deleteTimer(held[4])
        self.handle.registerTimer(at)
        return (*held[:4], at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.state.get()) if self.state.exists() else (False, 0, None, None, None)
        out = []
        every = pd.concat(list(rows)).sort_values("ts", kind="stable")
        for e in every.itertuples(index=False):
            closed, stages, stage, last, timer = held
            ms = int(e.ts.timestamp() * 1000)
            if closed:
                out.append((key[0], "refused", e.type, stages, e.stage, e.error, e.ts))
                continue
            last = max(ms, last or ms)
            if e.type in TERMINAL:
                held = (True, stages, stage, last, timer)
                out.append((key[0], "closed", e.type, stages, stage, e.error, e.ts))
            else:
                held = (False, stages + 1, e.stage, last, timer)
        held = self._due(held, held[3] + (self.keep if held[0] else self.silence))
        self.state.update(held)
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed, stages, stage, last, _ = self.state.get()
        columns = [c.split(" ")[0] for c in OUT.split(", ")]
        if closed or expiredTimerInfo.getExpiryTimeInMs() - last >= self.silence + self.keep:
            self.state.clear()
            yield pd.DataFrame([], columns=columns)
            return
        # told once; if it stays silent, it is forgotten after a while
        self.handle.registerTimer(last + self.silence + self.keep)
        self.state.update((False, stages, stage, last, last + self.silence + self.keep))
        yield pd.DataFrame([(key[0], "silent", None, stages, stage, None, pd.Timestamp(last, unit="ms"))], columns=columns)

    def close(self) -> None:
        pass


def sessions(rows: DataFrame, silence: timedelta = timedelta(minutes=2), keep: timedelta = timedelta(hours=1), late: timedelta = timedelta(seconds=30)) -> DataFrame:
    """OUT rows of a stream of EVENT rows. Events later than ``late`` behind the newest are dropped by the watermark."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    marked = rows.withWatermark("ts", f"{int(late.total_seconds())} seconds")
    return marked.groupBy("session").transformWithStateInPandas(Sessions(silence, keep), OUT, "Append", "EventTime")
