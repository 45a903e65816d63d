"""Folds of a state machine over each key, split into chunks that run in parallel.

Every chunk first runs from the initial state. A chunk whose predecessor ended in another state than it assumed runs
again from that state, until nothing changes; machines that forget their start (a gate, a reset accumulator) settle in a
round or two. Only one row per chunk moves between rounds. The result equals the sequential fold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.plans.layout import Layout
from tidewatch.plans.memory import frugal
from tidewatch.plans.scans import INDEX, index_rows
from tidewatch.plans.store import materialise, nullable

Fold = Callable[[dict[str, list], str], tuple[dict[str, list], str]]


def keyed_fold(
    df: DataFrame, layout: Layout, fold: Fold, initial: str, needs: Sequence[str], adds: str
) -> DataFrame:
    """Add the columns ``adds`` (DDL) that ``fold(columns, state) -> (new columns, state)`` computes in key order.

    ``fold`` sees the columns ``needs`` of at most ``layout.fold_rows`` consecutive rows; its state is a string (JSON
    where it has parts), so it can be compared and stored.
    """
    indexed = df if INDEX in df.columns else index_rows(df, layout)
    base = materialise(
        indexed.withColumn("_chunk", F.floor((F.col(INDEX) - 1) / F.lit(layout.fold_rows)).cast("long"))
    )
    group = [*layout.keys, "_chunk"]
    kept = indexed.columns
    added = T.StructType.fromDDL(adds)
    arrow_types = to_arrow_schema(added)
    schema = nullable(T.StructType([*indexed.schema.fields, *added.fields]))
    target = to_arrow_schema(schema)
    summary = T.StructType(
        [*[f for f in base.schema.fields if f.name in group], T.StructField("_from", T.StringType()), T.StructField("_to", T.StringType())]
    )
    summary_names = summary.names
    by_chunk = Window.partitionBy(*layout.keys).orderBy("_chunk")

    def columns(rows: pa.Table) -> dict[str, list]:
        return {n: rows[n].to_pylist() for n in needs}

    def end_state(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(INDEX)
        _, end = fold(columns(rows), rows["_from"][0].as_py())
        return rows.slice(0, 1).append_column("_to", pa.array([end], pa.string())).select(summary_names)

    def emit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(INDEX)
        new, _ = fold(columns(rows), rows["_from"][0].as_py())
        rows = rows.select(kept)
        for field in arrow_types:
            rows = rows.append_column(field.name, pa.array(new[field.name], field.type))
        return rows.cast(target)

    narrow = base.select(*dict.fromkeys([*group, INDEX, *needs]))
    starts = base.select(*group).distinct().withColumn("_from", F.lit(initial))
    runs = materialise(narrow.join(starts, group).groupBy(*group).applyInArrow(frugal(end_state), summary))
    while True:
        wanted = runs.withColumn("_want", F.coalesce(F.lag("_to").over(by_chunk), F.lit(initial)))
        stale = materialise(
            wanted.where(F.col("_want") != F.col("_from")).select(*group, F.col("_want").alias("_from"))
        )
        if stale.isEmpty():
            break
        again = narrow.join(stale, group).groupBy(*group).applyInArrow(frugal(end_state), summary)
        runs = materialise(runs.join(stale.select(*group), group, "left_anti").unionByName(again))
    return base.join(runs.select(*group, "_from"), group).groupBy(*group).applyInArrow(frugal(emit), schema)
