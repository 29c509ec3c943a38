"""Keyed state machines over rows in event-time order, as a stream or over a finished log, with the same results.

A machine takes rows in order of (ts, ord) and gives rows: take(row), expire(now) for what
happens by time alone, due() for when that is next, dump() and load() for its state as
texts. In a stream rows wait in list state until the watermark has passed them, so neither
the cut into batches nor the order of arrival within the watermark changes a result; rows
behind the watermark are dropped by Spark. Timers run on event time.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from tidemark.functions.shipping import ship_package

#: The end of time.
NEVER = 1 << 62


class Machine(Protocol):
    def take(self, row: Row) -> list[tuple]: ...

    def expire(self, now: int) -> list[tuple]: ...

    def due(self) -> int | None: ...

    def dump(self) -> list[str]: ...

    def load(self, texts: list[str]) -> None: ...


class Ordered(StatefulProcessor):
    """Holds rows back until the watermark has passed them, then gives them to the key's machine."""

    def __init__(self, machine: Callable[[], Machine], rows: StructType, columns: list[str]):
        self.machine, self.rows, self.told = machine, rows, Row(*columns)

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.rows)
        self.held = handle.getListState("held", "item string")

    def _wake(self, times: list[int], now: int) -> None:
        """A timer for the earliest of these times, unless an earlier one is set; those that now go off don't count."""
        if times and min(times) < min((t for t in self.handle.listTimers() if t > now), default=NEVER):
            self.handle.registerTimer(min(times))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r) for r in rows]
        self.pending.appendList(new)
        at = self.rows.names.index("ts")
        self._wake([r[at] for r in new], timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [Row(*self.rows.names)(*r) for r in self.pending.get()]
        ready = sorted((r for r in rows if r.ts <= now), key=lambda r: (r.ts, r.ord))
        later = [tuple(r) for r in rows if r.ts > now]
        machine = self.machine()
        machine.load([r[0] for r in self.held.get()])
        out = [x for r in ready for x in machine.take(r)] + machine.expire(now)
        for state, values in ((self.pending, later), (self.held, [(t,) for t in machine.dump()])):
            if values:
                state.put(values)
            else:
                state.clear()
        due = machine.due()
        at = self.rows.names.index("ts")
        self._wake([r[at] for r in later] + ([] if due is None else [due]), now)
        for x in out:
            yield self.told(*key, *x)

    def close(self) -> None:
        pass


def columns_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(",")]


def streamed(rows: DataFrame, key: str, machine: Callable[[], Machine], schema: str, *, delay: str) -> DataFrame:
    """rows have key, ord, ts (milliseconds of event time) and what the machine reads; the schema starts with the key.

    The session needs the RocksDB state store.
    """
    ship_package(rows.sparkSession)
    timed = rows.withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", delay)
    return timed.groupBy(key).transformWithState(Ordered(machine, timed.schema, columns_of(schema)), schema, "append", "EventTime")


def logged(rows: DataFrame, key: str, machine: Callable[[], Machine], schema: str) -> DataFrame:
    """The same over a finished log: each key's rows come sorted, and only the machine of the key at hand is kept."""
    ship_package(rows.sparkSession)
    names = rows.columns
    columns = columns_of(schema)
    at = names.index(key)

    def plain(column: pd.Series) -> list:
        missing = column.isna()
        return [None if gone else v for v, gone in zip(column.tolist(), missing.tolist())] if missing.any() else column.tolist()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, held, told = None, machine(), namedtuple("Told", names)
        first = True
        for frame in frames:
            out = []
            for row in map(told, *(plain(frame[c]) for c in names)):
                if first or row[at] != own:
                    out += [(own, *x) for x in held.expire(NEVER)]
                    own, held, first = row[at], machine(), False
                out += [(own, *x) for x in held.take(row)]
            yield pd.DataFrame(out, columns=columns, dtype=object)
        yield pd.DataFrame([(own, *x) for x in held.expire(NEVER)], columns=columns, dtype=object)

    return rows.repartition(key).sortWithinPartitions(key, "ts", "ord").mapInPandas(run, schema)
