"""Linear recurrences ``y[t] = a * y[t-1] + b[t]`` over long series.

A start value fades by ``a`` per row, so after ``horizon(a)`` rows its weight is below the smallest normal double and a
chunk that begins that many rows early reproduces the full recurrence. This keeps every chunk independent: one shuffle,
no sequential pass over a key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.plans.layout import Layout
from tidewatch.plans.memory import frugal
from tidewatch.plans.scans import INDEX, index_rows, split_rows
from tidewatch.plans.store import nullable

_FADED = 1e-300


def horizon(a: float) -> int:
    """Rows after which ``a ** n`` no longer reaches any double."""
    return int(math.ceil(math.log(_FADED) / math.log(a)))


@dataclass(frozen=True)
class Recurrence:
    """``value`` names the column holding ``b``; null until the seed row, whose value is the seed itself."""

    value: str
    a: float


def _scan(b: list[float | None], a: float) -> list[float | None]:
    out: list[float | None] = []
    y: float | None = None
    for x in b:
        if x is not None:
            y = x if y is None else a * y + x
        out.append(y)
    return out


def recur(df: DataFrame, layout: Layout, **specs: Recurrence) -> DataFrame:
    """Add one column per recurrence; null before its seed row."""
    indexed = df if INDEX in df.columns else index_rows(df, layout)
    # A chunk that starts beyond the seed row must start from a value, not from a seed: its first b stands in for
    # it, which is off by a fading amount only, gone when the halo ends.
    split, _ = split_rows(indexed, layout, max(horizon(s.a) for s in specs.values()))
    names = indexed.columns
    schema = nullable(T.StructType([*indexed.schema.fields, *[T.StructField(n, T.DoubleType()) for n in specs]]))

    target = to_arrow_schema(schema)

    def scan(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(INDEX)
        for name, spec in specs.items():
            rows = rows.append_column(name, pa.array(_scan(rows[spec.value].to_pylist(), spec.a), pa.float64()))
        return rows.filter(pc.invert(rows["_halo"])).select([*names, *specs]).cast(target)

    return split.groupBy(*layout.keys, "_chunk").applyInArrow(frugal(scan), schema)
