"""State machines with finitely many states, run over each key by composing transition maps.

What a chunk of rows does to a machine is one map from its start state to its end state, whatever the start turns out to be. All chunks compute their
maps at once; maps of a thousand chunks are composed into one, the composed maps give the start of each thousand, and those the start of each chunk. So
the number of jobs is fixed, no chunk is run on a guess, and no task sees more of a key than a thousandth of its chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Sequence
from dataclasses import dataclass

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
FAN = 1_000


@dataclass(frozen=True)
class Machine:
    """States by number, the first one initial: ``moves[state, symbol]`` is the next state, ``shown[state]`` what a row shows."""

    moves: np.ndarray
    shown: tuple

    @classmethod
    def of(cls, initial: Hashable, symbols: Sequence, step: Callable, show: Callable) -> "Machine":
        """Enumerate what ``step(state, symbol)`` reaches from ``initial``."""
        states, moves = [initial], []
        known = {initial: 0}
        for state in states:  # grows as states are met
            row = []
            for symbol in symbols:
                after = step(state, symbol)
                if after not in known:
                    known[after] = len(states)
                    states.append(after)
                row.append(known[after])
            moves.append(row)
        return cls(np.array(moves, np.int32), tuple(show(s) for s in states))

    def map_of(self, symbols: np.ndarray) -> np.ndarray:
        """End state for every start state. Maps of neighbouring rows are composed pair by pair, so a chunk takes log2(rows) vector steps."""
        size = len(self.moves)
        maps = self.moves.T[symbols]
        while len(maps) > 1:
            if len(maps) % 2:
                maps = np.vstack([maps, np.arange(size, dtype=np.int32)[None]])
            maps = np.take_along_axis(maps[1::2], maps[::2], axis=1)
        return maps[0] if len(maps) else np.arange(size, dtype=np.int32)

    def run(self, start: int, symbols: Iterable[int]) -> list:
        """What each row shows after its move."""
        moves, out = self.moves.tolist(), []
        for symbol in symbols:
            start = moves[start][symbol]
            out.append(self.shown[start])
        return out


def _composed(maps: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(m, np.int32) for m in maps["_map"].to_pylist()]


def machine_fold(df: DataFrame, layout: Layout, machine: Machine, symbol: str, out: str) -> DataFrame:
    """Add ``out``: what ``machine`` shows after each row of a key, in order, moved by the numbers in ``symbol``."""
    indexed = df if INDEX in df.columns else index_rows(df, layout)
    base = materialise(indexed.withColumn("_chunk", F.floor((F.col(INDEX) - 1) / F.lit(layout.fold_rows)).cast("long")))
    keys, chunk = list(layout.keys), [*layout.keys, "_chunk"]
    fields = {f.name: f for f in base.schema.fields}

    def table(*names: str, **more: T.DataType) -> T.StructType:
        return nullable(T.StructType([fields[n] for n in names] + [T.StructField(n, t) for n, t in more.items()]))

    map_schema = table(*chunk, _map=T.BinaryType())
    group_schema = table(*keys, _group=T.LongType(), _map=T.BinaryType())
    group_start = table(*keys, _group=T.LongType(), _start=T.IntegerType())
    chunk_start = table(*chunk, _start=T.IntegerType())
    kept = indexed.columns
    target = nullable(T.StructType([*indexed.schema.fields, T.StructField(out, T.StringType())]))

    def first(rows: pa.Table, names: list[str], **more) -> pa.Table:
        table_ = rows.slice(0, 1).select(names)
        for name, value in more.items():
            table_ = table_.append_column(name, value)
        return table_

    def one_map(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(INDEX)
        return first(rows, chunk, _map=pa.array([machine.map_of(rows[symbol].to_numpy()).tobytes()], pa.binary()))

    def compose(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_chunk")
        end = np.arange(len(machine.moves), dtype=np.int32)
        for each in _composed(rows):
            end = each[end]
        return first(rows, [*keys, "_group"], _map=pa.array([end.astype(np.int32).tobytes()], pa.binary()))

    def starts(rows: pa.Table, state: int) -> pa.Array:
        """The state before each row of maps, in order, from ``state``."""
        found = []
        for each in _composed(rows):
            found.append(state)
            state = int(each[state])
        return pa.array(found, pa.int32())

    def group_starts(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_group")
        return rows.select([*keys, "_group"]).append_column("_start", starts(rows, 0))

    def chunk_starts(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_chunk")
        return rows.select(chunk).append_column("_start", starts(rows, rows["_start"][0].as_py()))

    def emit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(INDEX)
        shown = machine.run(rows["_start"][0].as_py(), rows[symbol].to_pylist())
        return rows.select(kept).append_column(out, pa.array(shown, pa.string())).cast(to_arrow_schema(target))

    maps = base.select(*chunk, INDEX, symbol).groupBy(*chunk).applyInArrow(frugal(one_map), map_schema)
    maps = materialise(maps.withColumn("_group", F.floor(F.col("_chunk") / FAN).cast("long")))
    grouped = maps.groupBy(*keys, "_group").applyInArrow(frugal(compose), group_schema)
    from_ = grouped.groupBy(*keys).applyInArrow(frugal(group_starts), group_start)
    entered = maps.join(from_, [*keys, "_group"]).groupBy(*keys, "_group").applyInArrow(frugal(chunk_starts), chunk_start)
    return base.join(entered, chunk).groupBy(*chunk).applyInArrow(frugal(emit), target)
