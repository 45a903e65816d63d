"""How an ordered stream of rows is cut so that no key has to fit into one task."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Ordering and splitting of a keyed event table.

    ``keys`` name the series, ``order`` its total order: first a numeric event time, then tie-breaks that make the
    order unique. One key may hold a large part of the table, so work is never partitioned by ``keys`` alone:

    * time slots ``floor(order[0] / slot_ms)`` bound the group of a running (unbounded) scan,
    * chunks of ``chunk_rows`` consecutive rows bound the group of a bounded frame or a recurrence,
    * chunks of ``fold_rows`` consecutive rows bound the group of a fold, which is cheap per row but costs a round per
      chunk whose start was guessed wrong.

    Choose ``slot_ms`` so that the densest slot of the busiest key sorts comfortably in one task. A slot with few rows costs
    one summary row, so it is safe to choose it for the largest volume expected. Frames over a time range are cut at the longer
    of a slot and the range.
    """

    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts_ms", "tick_id")
    slot_ms: int = 3_600_000
    chunk_rows: int = 50_000
    fold_rows: int = 500_000

    @property
    def ts(self) -> str:
        return self.order[0]

    def slot(self) -> Column:
        return F.floor(F.col(self.ts) / F.lit(self.slot_ms)).cast("long")

    def with_(self, **changes) -> "Layout":
        return replace(self, **changes)


TICKS = Layout()
