"""Runs assembled from a stream of records.

A record stream has one row for each record as it arrives. Records of a run are checked one
by one (operators/checks.py, stateless), gathered in state by run, and the run is given out once: when it is complete, or when nothing came for
a while; then its state is freed. Event time, watermark and late rows are choices of this
engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from blockwright.operators.checks import WHOLE_RUN
from blockwright.streaming.ordered import InOrder, folded

#: Microseconds without a record after which a run ends.
TIMEOUT_US = 60_000_000


def first_of_slot(records: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One record for each run and slot while the watermark lasts: the first that arrives."""
    return records.withWatermark("arrival", delay).dropDuplicatesWithinWatermark(["run_id", "slot"])


#: What a record is made of, in the order in which it is sent.
PARTS = ("header", "payload", "telemetry")


class Assembly(InOrder):
    """A run's parts (slot, part, failed) put together. The run ends when every part of every slot is there, or when nothing came for too long."""

    STATE = "began_us long, until_us long, seen array<int>, failed long"

    def __init__(self, rows, idle_us, slots: int):
        super().__init__(rows, idle_us)
        self.slots = slots

    def step(self, key, state, row):
        began, _, seen, failed = state or (row.ts_us, row.ts_us, [0] * self.slots, 0)
        seen = list(seen)
        if 0 <= row.slot < self.slots and row.part in PARTS:
            bit = 1 << PARTS.index(row.part)
            failed += not seen[row.slot] & bit and row.failed
            seen[row.slot] |= bit
        state = began, row.ts_us, seen, int(failed)
        if min(seen) == 2 ** len(PARTS) - 1:
            return None, [self.run(key, state, False)]
        return state, []

    def ended(self, key, state):
        """What arrived is given out; a run of one record or none isn't worth it."""
        return None, [self.run(key, state, True)] if sum(x > 0 for x in state[2]) > 1 else []

    def run(self, key, state, partial: bool) -> Row:
        began, until, seen, failed = state
        return Row(run_id=key, began_us=began, until_us=until, slots=sum(x > 0 for x in seen), whole=sum(x == 7 for x in seen), parts=sum(x.bit_count() for x in seen), failed=failed, is_partial=partial)


def assemble(parts: DataFrame, idle_us: int = TIMEOUT_US, slots: int = WHOLE_RUN, delay: str = "10 minutes") -> DataFrame:
    """(run_id, began_us, until_us, slots, whole, parts, failed, is_partial): each run once.

    parts: run_id, ts, ord, slot, part (of PARTS), failed, one row for each header, payload
    and telemetry block. State holds one number for each slot, a bit for each part, while a
    run is open; a part that comes again changes nothing.
    """
    return folded(parts.select("run_id", "ts", "ord", F.col("slot").cast("int"), "part", "failed"), "run_id", Assembly, "run_id long, began_us long, until_us long, slots int, whole int, parts int, failed long, is_partial boolean", idle_us, delay, slots=slots)


class ExpectedOrder(InOrder):
    """Accepts the record that a run waits for; any other is skipped and waited for again. A run that is complete, or silent for too long, begins anew."""

    STATE = "wanted int"

    def __init__(self, rows, idle_us, slots: int):
        super().__init__(rows, idle_us)
        self.slots = slots

    def step(self, key, state, row):
        wanted = state[0] if state else 0
        accepted = row.order_index == wanted
        after = (wanted + accepted) % self.slots
        return (after,) if after else None, [Row(run_id=key, ord=row.ord, order_index=row.order_index, wanted=wanted, accepted=accepted)]


def in_order(records: DataFrame, idle_us: int | None = None, slots: int = WHOLE_RUN, delay: str = "10 minutes") -> DataFrame:
    """(run_id, ord, order_index, wanted, accepted) of each record (run_id, ts, ord, order_index), as it would be if records came in order of time."""
    return folded(records.select("run_id", "ts", "ord", F.col("order_index").cast("int")), "run_id", ExpectedOrder, "run_id long, ord long, order_index int, wanted int, accepted boolean", idle_us, delay, slots=slots)


class CurrentRun(InOrder):
    """Passes on statuses of the run that was last started; those of other runs, and before any start, are stale."""

    STATE = "run long"

    def step(self, key, state, row):
        if row.starts:
            return (row.run_id,), []
        return state, [Row(device=key, ord=row.ord, run_id=row.run_id)] if state and state[0] == row.run_id else []


def of_current_run(starts: DataFrame, statuses: DataFrame, idle_us: int | None = None, delay: str = "10 minutes") -> DataFrame:
    """(device, ord, run_id) of the statuses that belong to the run last started on their device.

    Both are streams with device, ts, ord, run_id. The join is by time: a status meets the
    last start before it, so a device keeps one run in state, and no start is joined to all
    later statuses.
    """
    names = ["device", "ts", "ord", "run_id"]
    both = starts.select(*names, F.lit(True).alias("starts")).unionByName(statuses.select(*names, F.lit(False).alias("starts")))
    return folded(both, "device", CurrentRun, "device long, ord long, run_id long", idle_us, delay)


def stretches(records: DataFrame, gap: str = "60 seconds") -> DataFrame:
    """(run_id, began, ended, records): a run ends when no record came for a while. On a stream with a watermark on ts each stretch is given out once, when it can't grow any more."""
    g = records.groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("records"))
    return g.select("run_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "records")


def finished(stretch: DataFrame, most: int = WHOLE_RUN) -> DataFrame:
    """Stretches of more than one record; those of fewer than a whole run's are partial."""
    return stretch.where("records > 1").withColumn("is_partial", F.col("records") < most)
