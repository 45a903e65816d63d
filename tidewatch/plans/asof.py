"""As-of join without a range condition: one union, one running scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.layout import Layout
from tidewatch.plans.scans import Scan, running


def asof_join(
    left: DataFrame,
    right: DataFrame,
    layout: Layout,
    columns: dict[str, str],
    *,
    strict: bool = False,
    tolerance_ms: int | None = None,
    right_ts: str | None = None,
    age: str | None = None,
) -> DataFrame:
    """Give every left row the latest right row of its key at or before (``strict``: before) its time.

    ``columns`` maps output names to right columns. Right rows at the same time as a left row are sorted before it,
    or after it when ``strict``. Rows older than ``tolerance_ms`` do not match. Right times should be unique per key;
    where they are not, the largest column struct wins, so the result stays deterministic.
    """
    rts = right_ts or layout.ts
    payload = F.struct(F.col(rts).alias("_ts"), *[F.col(src).alias(out) for out, src in columns.items()])
    facts = right.select(
        *layout.keys, F.col(rts).alias(layout.ts), F.lit(2 if strict else 0).alias("_side"), payload.alias("_fact")
    )
    rows = left.withColumn("_side", F.lit(1)).unionByName(facts, allowMissingColumns=True)
    # Right rows have no tie-break columns: nulls sort first, their payload decides.
    scan = layout.with_(order=(layout.ts, "_side", *layout.order[1:], "_fact"))
    out = running(rows, scan, _hit=Scan("last", F.col("_fact"))).where(F.col("_side") == 1)
    gap = F.col(layout.ts) - F.col("_hit._ts")
    found = F.col("_hit").isNotNull()
    if tolerance_ms is not None:
        found = found & (gap <= F.lit(tolerance_ms))
    for name in columns:
        out = out.withColumn(name, F.when(found, F.col(f"_hit.{name}")))
    if age:
        out = out.withColumn(age, F.when(found, gap))
    return out.drop("_side", "_fact", "_hit")
