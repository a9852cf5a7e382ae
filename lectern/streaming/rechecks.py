"""A check some seconds after a membership's end: whoever has no other one by then has expired.

`rechecks` gives one row a check, from a table or from a stream. Of ends while a check is pending none begins another one.
In a table, ends are cut into runs without a gap as long as the delay, whose checks a fold decides, and what is active at a
check is a running sum over starts, ends and checks together. In a stream the same rules advance a user's state to the
watermark: it holds active memberships, a pending check, and the rows that are still ahead.

Defined cases: at one instant starts count before ends, ends before a check; an end without its start, and a second start
or end of the same membership, count as they come; rows without user or time are left out; in a stream, rows later than
`late` behind the newest are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

DELAY = 5
COLUMNS = "user string, due timestamp, active long, expired boolean"
STATE = "active long, pending long, at array<long>, step array<long>"


def advance(active: int, pending: int | None, rows: Iterable[tuple[int, int]], until: int | None, delay: int) -> tuple[list[tuple[int, int]], int, int | None]:
    """Checks (due, active) that are decided by `until` (None: all), and the state then; rows are (time, +1 or -1), all not later than until."""
    out: list[tuple[int, int]] = []
    for at, step in sorted(rows, key=lambda r: (r[0], -r[1])):
        if pending is not None and pending < at:
            out.append((pending, active))
            pending = None
        active += step
        if step < 0 and pending is None:
            pending = at + delay
    if pending is not None and (until is None or pending <= until):
        out.append((pending, active))
        pending = None
    return out, active, pending


def _stream(rows: DataFrame, delay: int, late: str) -> DataFrame:
    wait = delay * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, pending, at, steps = state.get if state.exists else (0, -1, [], [])
        ahead = list(zip(at, steps))
        for frame in () if state.hasTimedOut else frames:
            ahead += zip(frame["at"].tolist(), frame["step"].tolist())
        mark = state.getCurrentWatermarkMs() * 1000
        found, active, left = advance(active, None if pending < 0 else pending, [r for r in ahead if r[0] <= mark], mark, wait)
        ahead = sorted(r for r in ahead if r[0] > mark)
        state.update((active, -1 if left is None else left, [r[0] for r in ahead], [r[1] for r in ahead]))
        nexts = ([] if left is None else [left]) + [r[0] for r in ahead[:1]]
        if nexts:
            state.setTimeoutTimestamp(max(min(nexts) // 1000, mark // 1000) + 1)
        if found:
            yield pd.DataFrame({"user": key[0], "due": pd.to_datetime([d for d, _ in found], unit="us"), "active": [a for _, a in found], "expired": [a <= 0 for _, a in found]})

    marked = rows.withWatermark("ts", late).select("user", "ts", F.unix_micros("ts").alias("at"), "step")
    return marked.groupBy("user").applyInPandasWithState(step, COLUMNS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _table(rows: DataFrame, delay: int) -> DataFrame:
    timed = rows.select("user", F.unix_micros("ts").alias("at"), "step")
    wait = delay * 1_000_000
    order = Window.partitionBy("user").orderBy("at")
    ends = timed.where("step < 0").select("user", "at").distinct()
    runs = ends.withColumn("new", F.when(F.col("at") - F.lag("at").over(order) <= wait, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    # In a run an end begins a check if the one before it is over.
    times = runs.groupBy("user", "run").agg(F.array_sort(F.collect_list("at")).alias("at"))
    fold = F.aggregate("at", F.array().cast("array<bigint>"), lambda dues, a: F.when((F.size(dues) == 0) | (a > F.element_at(dues, -1)), F.concat(dues, F.array(a + wait))).otherwise(dues))
    dues = times.select("user", F.explode(fold).alias("at")).withColumns({"step": F.lit(0).cast("long"), "due": F.lit(True)})
    both = timed.select("user", "at", F.col("step").cast("long").alias("step"), F.lit(False).alias("due")).unionByName(dues.select("user", "at", "step", "due"))
    so_far = Window.partitionBy("user").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("active", F.sum("step").over(so_far)).where("due")
    return found.select("user", F.timestamp_micros("at").alias("due"), "active", (F.col("active") <= 0).alias("expired"))


def rechecks(events: DataFrame, user: str, ts: str, starts, delay: int = DELAY, late: str = "5 minutes") -> DataFrame:
    """(user, due, active, expired) of each check; starts is a column: true for a start, false for an end, null for neither."""
    rows = events.select(F.col(user).cast("string").alias("user"), F.col(ts).cast("timestamp").alias("ts"), F.when(starts, 1).when(~starts, -1).cast("long").alias("step"))
    rows = rows.where("user is not null and ts is not null and step is not null")
    return _stream(rows, delay, late) if events.isStreaming else _table(rows, delay)
