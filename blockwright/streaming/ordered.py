"""Rows of a key in the order of their event times, whatever batches they come in.

A stream hands over rows as they arrive. What a run's state becomes must not depend on how
the rows fall into batches, so each key's rows wait in state until the watermark has passed
them and are then folded in the order of (time, number). An event-time timer wakes the key
for its next rows, and once more when it has been silent for too long, which ends what it
has open and frees all of its state. Rows later than the watermark are dropped by Spark and
counted in the progress of the query.

Rows wait in pieces: sorted rows as one value of state, as a value costs a call whatever it
holds. What comes of a key in a batch is one piece where it is little, and cut by the hour
where it is much, so pieces that overlap in time are small; they are merged as they are
read, and a task holds what overlaps, not all rows of a key.
"""

from __future__ import annotations

import itertools
import pickle
import random
from collections import namedtuple
from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace
from operator import itemgetter
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


#: Rows that a task takes from a batch before it puts them into state; rows that are one piece, whatever times they have.
TAKEN, FEW = 1 << 16, 1 << 12
#: Microseconds of a piece of more rows.
PIECE_US = 3_600_000_000


class InOrder(StatefulProcessor):
    """Folds rows (key, ts, ord, ...) into a state of one row.

    Subclasses say what the state looks like (STATE, a DDL text) and give step(key, state,
    row) and ended(key, state); both return the new state, None when nothing is to be kept,
    and a list of output rows. state is None where nothing is open.
    """

    STATE = "seen long"

    def __init__(self, rows: StructType, idle_us: int | None = None):
        """rows: the columns ts_us (long), ord (long) and those that step() reads. idle_us: after so long without a row, what is open ends; None: never."""
        self.rows, self.idle_us = rows, idle_us
        self.kept = StructType.fromDDL(f"last_us long, {self.STATE}")  # here, as tasks have no parser

    def step(self, key: Any, state: tuple | None, row: Row) -> tuple[tuple | None, list[Row]]:
        raise NotImplementedError

    def ended(self, key: Any, state: tuple) -> tuple[tuple | None, list[Row]]:
        return None, []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first_us long, n long", "rows binary")
        self.state = handle.getValueState("state", self.kept)
        self.row = namedtuple("Waiting", self.rows.names, rename=True)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:  # only moves the watermark
            return iter(())
        first, whole, own = None, True, None
        while taken := list(itertools.islice(rows, TAKEN)):
            own = own or itemgetter(*map(taken[0].__fields__.index, self.rows.names))
            taken = sorted((own(tuple(r)) for r in taken), key=itemgetter(0, 1))
            first = taken[0][0] if first is None else min(first, taken[0][0])
            if whole and len(taken) <= FEW:
                self.put(taken)
            else:
                for _, piece in itertools.groupby(taken, lambda r: r[0] // PIECE_US):
                    self.put(list(piece))
            whole = False
        self.wake(first)
        return iter(())

    def put(self, rows: list[tuple]) -> None:
        """Keep sorted rows as a piece, under its first time and a number of its own."""
        self.waiting.updateValue((rows[0][0], random.getrandbits(62)), (pickle.dumps(rows, pickle.HIGHEST_PROTOCOL),))

    def ready(self, now: int) -> Iterator[tuple]:
        """Rows up to a time in their order, taken out of state. Pieces are read when their first row's turn has come."""
        starts, k, heap = sorted(self.waiting.keys()), 0, []
        while True:
            while k < len(starts) and starts[k][0] <= now and (not heap or starts[k][0] <= heap[0][0]):
                rows = pickle.loads(self.waiting.getValue(starts[k])[0])
                self.waiting.removeKey(starts[k])
                heappush(heap, (*rows[0][:2], k, 0, rows))
                k += 1
            if not heap or heap[0][0] > now:
                break
            *_, piece, at, rows = heap[0]
            yield self.row(*rows[at])
            if at + 1 < len(rows):
                heapreplace(heap, (*rows[at + 1][:2], piece, at + 1, rows))
            else:
                heappop(heap)
        for *_, at, rows in heap:
            self.put(rows[at:])
        if rest := [h[0] for h in heap] + [s[0] for s in starts[k : k + 1]]:
            self.wake(min(rest))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = 1000 * timerValues.getCurrentWatermarkInMs()
        last, *state = before = self.state.get() or (None,)
        state = tuple(state) or None
        for r in self.ready(now):
            if self.idle_us is not None and state and r[0] - last >= self.idle_us:
                state, out = self.ended(key[0], state)
                yield from out
            state, out = self.step(key[0], state, r)
            yield from out
            last = r[0]
        if self.idle_us is not None and state and last + self.idle_us <= now:
            state, out = self.ended(key[0], state)
            yield from out
        if state:
            self.state.update((last, *state))
        elif len(before) > 1:  # there is something to clear
            self.state.clear()
        if state and self.idle_us is not None:
            self.wake(last + self.idle_us)

    def wake(self, at_us: int) -> None:
        """When the watermark, which counts milliseconds, has passed a time."""
        self.handle.registerTimer(-(-at_us // 1000))

    def close(self) -> None:
        pass


def folded(rows: DataFrame, key: str, processor: type[InOrder], output: str, idle_us: int | None = None, delay: str = "10 minutes", **settings) -> DataFrame:
    """What a processor gives out over a stream with the columns key, ts (timestamp) and ord; it is given out once and never changes. Rows without a key only move the watermark. delay: how much later than younger rows a row may come."""
    if "RocksDB" not in (rows.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", None) or ""):
        rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    named = rows.withWatermark("ts", delay).withColumn("ts_us", F.unix_micros("ts"))
    read = StructType([named.schema[c] for c in ("ts_us", "ord", *(c for c in rows.columns if c not in (key, "ts", "ord")))])
    made = processor(read, idle_us, **settings)
    return named.groupBy(key).transformWithState(made, StructType.fromDDL(output), "append", "EventTime")


def dropped_rows(progress: list) -> int:
    """How many rows came later than the watermark, over the progress reports of a query (its recentProgress)."""
    return sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])
