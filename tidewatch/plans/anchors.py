"""Windows that open where the last one closed, over each key, by composing maps of chunks.

The state between two rows is the time at which the open window began, or none. What a chunk does to it is a step function that
never falls: a window that began later closes at the same row or a later one. A chunk's map lists the times from which its result
changes and the results, equal neighbours merged; a window that no row of the chunk closes passes as it is. Maps of ``FAN``
chunks are composed into one, the composed maps give the start of each group, and those the start of each chunk, so the number of
jobs is fixed. A composed map has at most one entry for each millisecond of a window, however many rows it stands for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.plans.layout import Layout
from tidewatch.plans.memory import frugal
from tidewatch.plans.scans import INDEX, index_rows
from tidewatch.plans.store import materialise, nullable

#: Chunks whose maps are composed in one task.
FAN = 256
#: The state without an open window; earlier than any time.
NONE = np.iinfo(np.int64).min


class Steps:
    """A map of states: ``none`` where no window is open, ``after[i]`` for windows that began in ``(upto[i - 1], upto[i]]``, and the
    start itself beyond the last of ``upto``. ``top`` is the latest start that can come in, the time of the first row."""

    def __init__(self, top: int, none: int, upto: np.ndarray, after: np.ndarray) -> None:
        self.top, self.none, self.upto, self.after = top, none, upto, after

    @classmethod
    def of_rows(cls, ts: np.ndarray, window: int) -> "Steps":
        """The map of rows in time order: from every row at which a window could close to the state at the end."""
        n = len(ts)
        closing = np.searchsorted(ts, ts + window, "left")  # the row that closes a window which began at this one
        closing = np.maximum(closing, np.arange(n))  # windows of no length close with the row that opens them
        ends = np.empty(n + 1, np.int64)  # state at the end where a window opens at this row
        ends[n] = NONE
        own, into = ts.tolist(), closing.tolist()
        out = [NONE] * (n + 1)
        for i in range(n - 1, -1, -1):
            out[i] = own[i] if into[i] >= n else out[into[i] + 1]
        ends[:] = out
        return cls(int(own[0]), int(ends[0]), ts - window, ends[1:]).merged()

    def merged(self) -> "Steps":
        """Without steps that nothing reaches and with equal neighbours as one."""
        size = int(np.searchsorted(self.upto, self.top, "left")) + 1
        upto, after = self.upto[:size], self.after[:size]
        if not len(upto):
            return self
        # Of equal bounds the first counts: the first row that is late enough closes the window.
        first = np.r_[True, upto[1:] != upto[:-1]]
        upto, after = upto[first], after[first]
        last = np.r_[after[1:] != after[:-1], True]
        return Steps(self.top, self.none, upto[last], after[last])

    def __call__(self, states: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.upto, states, "left")
        out = np.where(at < len(self.upto), np.r_[self.after, NONE][at], states)
        return np.where(states == NONE, self.none, out)

    def then(self, other: "Steps") -> "Steps":
        """This map and then ``other``."""
        beyond = other.upto > (self.upto[-1] if len(self.upto) else NONE)
        upto = np.r_[self.upto, other.upto[beyond]]
        after = np.r_[other(self.after), other.after[beyond]]
        return Steps(self.top, int(other(np.array([self.none]))[0]), upto, after).merged()

    def packed(self) -> bytes:
        return np.r_[np.int64(self.top), np.int64(self.none), self.upto, self.after].astype(np.int64).tobytes()

    @classmethod
    def unpacked(cls, body: bytes) -> "Steps":
        x = np.frombuffer(body, np.int64)
        half = len(x) // 2 - 1
        return cls(int(x[0]), int(x[1]), x[2:2 + half], x[2 + half:])


def _run(ts: np.ndarray, window: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of the window of each row and whether the row closes it, from a state."""
    n, at = len(ts), 0
    opened, closes = np.empty(n, np.int64), np.zeros(n, bool)
    while at < n:
        begin = int(ts[at]) if start == NONE else start
        stop = max(at, int(np.searchsorted(ts, begin + window, "left")))
        opened[at:stop + 1] = begin
        if stop < n:
            closes[stop] = True
        at, start = stop + 1, NONE
    return opened, closes


def anchor_fold(df: DataFrame, layout: Layout, window_ms: int, *, opened: str, closes: str) -> DataFrame:
    """Add the time ``opened`` at which each row's window began and whether the row ``closes`` it. Times are whole and not null."""
    indexed = df if INDEX in df.columns else index_rows(df, layout)
    base = materialise(indexed.withColumn("_chunk", F.floor((F.col(INDEX) - 1) / F.lit(layout.fold_rows)).cast("long")))
    keys, chunk, ts = list(layout.keys), [*layout.keys, "_chunk"], layout.ts
    fields = {f.name: f for f in base.schema.fields}

    def table(*names: str, **more: T.DataType) -> T.StructType:
        return nullable(T.StructType([fields[n] for n in names] + [T.StructField(n, t) for n, t in more.items()]))

    kept = indexed.columns
    target = nullable(T.StructType([*indexed.schema.fields, T.StructField(opened, T.LongType()), T.StructField(closes, T.BooleanType())]))

    def one_map(rows: pa.Table) -> pa.Table:
        times = np.sort(rows[ts].to_numpy())
        return rows.slice(0, 1).select(chunk).append_column("_map", pa.array([Steps.of_rows(times, window_ms).packed()], pa.binary()))

    def compose(rows: pa.Table) -> pa.Table:
        rows, whole = rows.sort_by("_chunk"), None
        for body in rows["_map"]:
            each = Steps.unpacked(body.as_py())
            whole = each if whole is None else whole.then(each)
        return rows.slice(0, 1).select([*keys, "_group"]).append_column("_map", pa.array([whole.packed()], pa.binary()))

    def starts(rows: pa.Table, state: int) -> pa.Array:
        """The state before each row of maps, in order, from ``state``."""
        found = []
        for body in rows["_map"]:
            found.append(state)
            state = int(Steps.unpacked(body.as_py())(np.array([state]))[0])
        return pa.array(found, pa.int64())

    def group_starts(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_group")
        return rows.select([*keys, "_group"]).append_column("_start", starts(rows, NONE))

    def chunk_starts(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_chunk")
        return rows.select(chunk).append_column("_start", starts(rows, rows["_start"][0].as_py()))

    def emit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(INDEX)
        began, done = _run(rows[ts].to_numpy(), window_ms, rows["_start"][0].as_py())
        return rows.select(kept).append_column(opened, pa.array(began, pa.int64())).append_column(closes, pa.array(done, pa.bool_())).cast(to_arrow_schema(target))

    maps = base.select(*chunk, ts).groupBy(*chunk).applyInArrow(frugal(one_map), table(*chunk, _map=T.BinaryType()))
    maps = materialise(maps.withColumn("_group", F.floor(F.col("_chunk") / FAN).cast("long")))
    grouped = maps.groupBy(*keys, "_group").applyInArrow(frugal(compose), table(*keys, _group=T.LongType(), _map=T.BinaryType()))
    from_ = grouped.groupBy(*keys).applyInArrow(frugal(group_starts), table(*keys, _group=T.LongType(), _start=T.LongType()))
    entered = materialise(maps.join(from_, [*keys, "_group"]).groupBy(*keys, "_group").applyInArrow(frugal(chunk_starts), table(*chunk, _start=T.LongType())))
    return base.join(entered, chunk).groupBy(*chunk).applyInArrow(frugal(emit), target)
