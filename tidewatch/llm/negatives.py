"""Hard negatives by slot-decomposed selection: one set of disjoint score slots per anchor answers all its windows.

Every anchor is scored against all rows, block by block: rows are bundled into matrices, anchors into blocks, and a cell of the
grid is one matrix product. The first pass keeps each anchor's best rows of its own label, the positives. A positive of score p
admits negatives between ``low * p / 100`` and ``high * p / 100``. The upper limits of an anchor's positives cut the scores into
disjoint slots: slot j lies above the limit j + 1 and not above limit j, the last one has no lower end. The second pass
keeps the ``k`` best rows of another label in each slot; a task does so over all its cells, and what tasks found is merged
per slot. As a window is everything up to one limit, its best rows are the first of its own slot and of those below: merging
the slots from the lowest up gives the answer to every window, which is then cut at its lower limit.

Defined results: rows without id or label, without a vector, or with a null or non-finite component take no part. A component
x counts as ``floor(scale * x)``; a missing component of a shorter vector as 0. Rows with the anchor's own id are never its
positives or negatives. Equal scores: the smaller id first. Of anchors that repeat an id one counts, the least by
(label, vector); other repeated rows count each. An anchor without positives gives no rows, a positive without negatives
neither; a positive of negative score has an empty window. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.memory import released
from tidewatch.plans.store import materialise

#: Rows of a bundle, anchors of a block, and blocks a task keeps results of before it hands them on.
BUNDLE, BLOCK, HELD = 4_096, 1_024, 4
_NONE = -(1 << 62)


@dataclass(frozen=True)
class Mining:
    """Parameters of the selection; limits are per cent of a positive's score."""

    positives: int = 5
    k: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256


def usable(rows: DataFrame, cfg: Mining, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``(id, label, q)``: the rows that take part, with whole-numbered vectors."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    q = F.transform(vector_col, lambda x: F.floor(F.lit(cfg.scale) * x.cast("double")))
    rows = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(fine)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), q.alias("q"))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix, short rows filled up with 0."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _bundles(rows: DataFrame, size: int, limits: bool = False) -> DataFrame:
    """A stored table ``(name, ids, labels, kind, vectors[, uppers, lowest])``: at most ``size`` rows each, in the order of ids.

    Vectors are packed in the narrowest whole numbers that hold them, named by ``kind``.
    """
    names = ["ids", "labels", "kind", "vectors", *(["uppers", "lowest"] if limits else [])]
    schema = pa.schema([(n, pa.string() if n == "kind" else pa.binary()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = pa.Table.from_batches([batch.slice(at, size)]).sort_by("id").combine_chunks().to_batches()[0]
                q = _matrix(part.column("q"))
                q = q.astype(np.min_scalar_type(-int(np.abs(q).max(initial=0)) - 1))
                values = [part.column("id").to_numpy().tobytes(), part.column("label").to_numpy().tobytes(), q.dtype.str, q.tobytes()]
                if limits:
                    values += [_matrix(part.column("uppers")).tobytes(), part.column("lowest").to_numpy().tobytes()]
                yield pa.record_batch([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)

    packed = rows.mapInArrow(run, ", ".join(f"{n} {'string' if n == 'kind' else 'binary'}" for n in names))
    return materialise(packed.withColumn("name", F.monotonically_increasing_id()))


def _grid(bundles: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every bundle beside every block: the stated query set against all rows, cell by cell.

    Bundles have a line of the grid by the hash of their name and blocks a column; each side is repeated along the other, so a pair meets
    once, by an equi-join on line and column, and any number of tasks share the grid.
    """
    lines, columns = (max(1, x.count()) for x in (bundles, blocks))
    line, column = (F.pmod(F.xxhash64("name"), F.lit(n)) for n in (lines, columns))
    spread = bundles.withColumn("line", line).withColumn("column", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long")))).drop("name")
    dealt = blocks.select(column.alias("column"), F.col("name").alias("block"), *[F.col(c).alias(f"a_{c}") for c in blocks.columns if c != "name"])
    dealt = dealt.withColumn("line", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lines - 1).cast("long"))))
    return spread.join(dealt, ["line", "column"])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows, exact: in floating point only where every partial sum is a whole number it can hold."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = int(np.abs(a.astype(np.int64)).max(initial=0)) * int(np.abs(b.astype(np.int64)).max(initial=0)) * max(width, 1)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (a.astype(kind) @ b.T.astype(kind)).astype(np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first by falling score and rising id; ids rise already."""
    if len(scores) > 4 * k:  # only what reaches the k-th score needs sorting
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= limit)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _numbers(row: dict, *names: str) -> list[np.ndarray]:
    return [np.frombuffer(row[n], np.int64) for n in names]


def _vectors(row: dict, side: str, n: int) -> np.ndarray:
    values = np.frombuffer(row[f"{side}vectors"], np.dtype(row[f"{side}kind"]))
    return values.reshape(n, len(values) // n)


def _best(cells: DataFrame, k: int, slots: int) -> DataFrame:
    """``(anchor_id, slot, id, score)``: each task's first ``k`` per anchor and slot; without slots, of the anchor's own label."""
    schema = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def cell(row: dict) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        ids, labels, anchors, own = _numbers(row, "ids", "labels", "a_ids", "a_labels")
        scores = _product(_vectors(row, "a_", len(anchors)), _vectors(row, "", len(ids)))
        if slots:
            uppers = np.frombuffer(row["a_uppers"], np.int64).reshape(len(anchors), -1)
            lowest = np.frombuffer(row["a_lowest"], np.int64)
        for i, anchor in enumerate(anchors):
            if not slots:
                at = np.flatnonzero((labels == own[i]) & (ids != anchor))
                at = at[_first(scores[i, at], ids[at], k)]
                yield anchor, 0, ids[at], scores[i, at]
                continue
            limit = uppers[i][uppers[i] > _NONE]
            at = np.flatnonzero((labels != own[i]) & (scores[i] <= limit[0]) & (scores[i] >= lowest[i]) & (ids != anchor))
            place = np.searchsorted(-limit, -scores[i, at], side="right") - 1  # limits fall; the last one not below the score
            for j in np.unique(place):
                here = at[place == j]
                here = here[_first(scores[i, here], ids[here], k)]
                yield anchor, int(j), ids[here], scores[i, here]

    def emit(held: dict) -> pa.RecordBatch:
        rows = [(a, j, x, s) for (a, j), (xs, ss) in held.items() for x, s in zip(xs, ss)]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blocks = {}, set()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if row["block"] not in blocks and len(blocks) == HELD:
                    yield emit(held)
                    held, blocks = {}, set()
                blocks.add(row["block"])
                for anchor, j, x, s in cell(row):
                    if (anchor, j) in held:
                        x, s = (np.concatenate(p) for p in zip(held[anchor, j], (x, s)))
                        keep = np.lexsort((x, -s))[:k]
                        x, s = x[keep], s[keep]
                    held[anchor, j] = x, s
        yield emit(held)

    found = cells.mapInArrow(released(run), "anchor_id long, slot int, id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", rank).where(F.col("place") <= k)


def _suffixes(arrays: list[Column], k: int) -> list[Column]:
    """The first ``k`` of each slot and all slots below it, merged from the lowest slot up."""
    merged = []
    below = F.array()
    for own in reversed(arrays):
        below = F.slice(F.concat(own, below) if merged else own, 1, k)
        merged.append(below)
    return merged[::-1]


def hard_negatives(rows: DataFrame, is_anchor: Column, cfg: Mining = Mining(), *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``; ``is_anchor`` is a condition on ``id``."""
    table = usable(rows, cfg, id_col, label_col, vector_col)
    bundles = _bundles(table, BUNDLE)
    least = F.min(F.struct("label", "q")).alias("a")
    anchors = materialise(table.where(is_anchor).groupBy("id").agg(least).select("id", "a.label", "a.q"))
    best = _best(_grid(bundles, _bundles(anchors, BLOCK)), cfg.positives, 0)
    upper = F.expr(f"(score * {cfg.high} - pmod(score * {cfg.high}, 100)) div 100").alias("upper")
    positives = best.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), upper)
    positives = materialise(positives)
    limits = positives.groupBy("anchor_id").agg(
        F.reverse(F.array_sort(F.collect_set("upper"))).alias("limits"), F.min(F.expr(f"-((-{cfg.low} * positive_score - pmod(-{cfg.low} * positive_score, 100)) div 100)")).alias("lowest"))
    limits = materialise(limits)
    filled = F.concat("limits", F.array_repeat(F.lit(_NONE), cfg.positives - F.size("limits"))).alias("uppers")
    limited = anchors.join(limits.select(F.col("anchor_id").alias("id"), filled, "lowest"), "id")
    found = _best(_grid(bundles, _bundles(limited, BLOCK, limits=True)), cfg.k, cfg.positives)
    ordered = F.array_sort(F.collect_list(F.struct("slot", (-F.col("score")).alias("down"), "id")))
    slots = found.groupBy("anchor_id").agg(ordered.alias("rows"))
    arrays = [F.expr(f"filter(rows, x -> x.slot = {j})") for j in range(cfg.positives)]
    slots = slots.select("anchor_id", F.array(*_suffixes(arrays, cfg.k)).alias("windows"))
    own = F.array_position("limits", F.col("upper")).cast("int")
    windows = positives.join(limits, "anchor_id").join(slots, "anchor_id").withColumn("window", F.element_at("windows", own))
    inside = F.filter("window", lambda x: -x["down"] * 100 >= F.col("positive_score") * cfg.low)
    return windows.select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "n")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.down")).alias("negative_score"))
