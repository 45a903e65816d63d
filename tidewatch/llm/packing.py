"""Packing documents into as few token sequences of a fixed capacity as a swap-based local search finds.

Documents are tokenised once and cut into pieces (only those longer than the capacity); the table of pieces, without texts,
is stored in the shared folder. Pieces that fill a sequence are done. The others are dealt at random into groups of about
``group_pieces`` rows, so the work of a task does not grow with the table; each group is packed by best fit and then
improved: a piece moves to a fuller bin, or one or two pieces change places with one or two smaller ones of a fuller bin.
Every step raises the sum of squared fills, until bins run empty. Bins that stay underfull in their groups are dealt into
new, fewer groups, round after round, so the waste per group vanishes from the whole.

Defined results: a null or empty text is a document of the end token alone; repeated rows are packed once each; a null id is
kept as null; an empty table gives no pieces; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.memory import released
from tidewatch.llm.tokens import Units, text_bytes, token_ids, tokenizer_path
from tidewatch.plans.store import materialise

#: Rows of a packing group.
GROUP_PIECES = 2_000
#: A bin with this share of its capacity free goes into the next round.
OPEN_SHARE = 1 / 64
MAX_ROUNDS = 6
#: Pairs of bins that the local search looks at for each bin of a group, at most.
LOOKS = 40

_PIECE = "id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, *, capacity: int, end_id: int, id_col: str, text_col: str, path: str, with_ids: bool) -> DataFrame:
    """One row per piece: where it starts, its length and the checksum of its ids."""
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Units(path, True)
        for batch in batches:
            rows: list[tuple] = []
            for key, ids in zip(batch.column("id").to_pylist(), token_ids(table, text_bytes(batch.column("text")))):
                data = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                for n, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at:at + 4 * capacity]
                    rows.append((key, n, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, schema.types)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(released(run), _PIECE)


class Bins:
    """Bins of one group: the sizes in each, by index."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity, self.bins, self.fill = sizes, capacity, [], []

    def best_fit(self) -> None:
        """Largest first, each into the bin with the least room that is enough."""
        room: list[tuple[int, int]] = []  # (room, bin), sorted
        for i in sorted(range(len(self.sizes)), key=lambda k: -self.sizes[k]):
            size = self.sizes[i]
            at = bisect_left(room, (size, -1))
            if at < len(room):
                free, b = room.pop(at)
            else:
                free, b = self.capacity, len(self.bins)
                self.bins.append([])
                self.fill.append(0)
            self.bins[b].append(i)
            self.fill[b] += size
            if free > size:
                insort(room, (free - size, b))

    def spare(self) -> int:
        """Bins that could go if all pieces were liquid; pieces over half the capacity need a bin each."""
        used = [f for f in self.fill if f]
        large = sum(1 for s in self.sizes if 2 * s > self.capacity)
        return len(used) - max(-(-sum(used) // self.capacity), large)

    def exchange(self, a: int, b: int) -> bool:
        """The change that moves most from bin ``a`` to the fuller bin ``b``: a move, or a swap of one or two for one or two."""
        room = self.capacity - self.fill[b]
        out, back = self._sums(a), [(0, ()), *self._sums(b)]
        back_sizes = np.array([s for s, _ in back])
        order = np.argsort(back_sizes, kind="stable")
        best, change = 0, None
        for size, items in out:
            # the smallest return so that no more than the room is added
            at = int(np.searchsorted(back_sizes[order], size - room))
            if at < len(order):
                gain = size - int(back_sizes[order[at]])
                given = back[order[at]][1]
                if best < gain <= room and len(items) + len(given) <= 3:
                    best, change = gain, (items, given)
        if change is None:
            return False
        for i in change[0]:
            self.bins[a].remove(i)
            self.bins[b].append(i)
        for i in change[1]:
            self.bins[b].remove(i)
            self.bins[a].append(i)
        self.fill[a] -= best
        self.fill[b] += best
        return True

    def _sums(self, b: int, most: int = 24) -> list[tuple[int, tuple[int, ...]]]:
        """Singles, and pairs of the ``most`` largest pieces of a bin."""
        items = self.bins[b]
        singles = [(self.sizes[i], (i,)) for i in items]
        top = sorted(items, key=lambda i: -self.sizes[i])[:most]
        return singles + [(self.sizes[x] + self.sizes[y], (x, y)) for k, x in enumerate(top) for y in top[k + 1:]]

    def search(self, looks: int = LOOKS) -> None:
        """Empty the least filled bins into fuller ones; a change always goes to the fuller bin, so squared fill rises."""
        left = looks * len(self.bins)
        done: set[int] = set()
        while self.spare() > 0 and left > 0:
            rest = [b for b in range(len(self.bins)) if self.fill[b] and b not in done]
            if not rest:
                return
            a = min(rest, key=lambda b: self.fill[b])
            changed = False
            for b in sorted((b for b in range(len(self.bins)) if b != a and self.fill[a] <= self.fill[b] < self.capacity), key=lambda b: -self.fill[b]):
                left -= 1
                while self.fill[a] and self.fill[b] >= self.fill[a] and self.exchange(a, b):
                    changed = True
                if not self.fill[a] or left <= 0:
                    break
            if changed:
                done.clear()  # other bins may have new partners now
            else:
                done.add(a)


def _pack_group(number: int, capacity: int):
    """Packs one group; bins with much room are marked open."""

    def run(rows: pa.Table) -> pa.Table:
        sizes = rows["length"].to_pylist()
        bins = Bins(sizes, capacity)
        bins.best_fit()
        bins.search()
        group = rows["group"][0].as_py()
        sequence, offset, open_ = [0] * len(sizes), [0] * len(sizes), [False] * len(sizes)
        for b, items in enumerate(bins.bins):
            at = 0
            for i in items:
                sequence[i], offset[i], open_[i] = (number << 56) + (group << 24) + b, at, capacity - bins.fill[b] >= capacity * OPEN_SHARE
                at += sizes[i]
        rows = rows.drop_columns(["group", "sequence_id", "offset", "open"])
        for name, values, kind in (("sequence_id", sequence, pa.int64()), ("offset", offset, pa.int64()), ("open", open_, pa.bool_())):
            rows = rows.append_column(name, pa.array(values, kind))
        return rows

    return run


def pack(
    docs: DataFrame, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
    with_ids: bool = False, group_pieces: int = GROUP_PIECES, max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` where asked for)."""
    path = path or tokenizer_path()
    cut = pieces(docs, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, path=path, with_ids=with_ids)
    stored = materialise(cut)
    full = stored.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    done = [full]
    rest = stored.where(F.col("length") < capacity).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "open": F.lit(True)})
    last = None
    for number in range(1, max_rounds + 1):
        groups = max(1, -(-rest.count() // group_pieces))
        if last is not None and groups >= last:
            break
        # the row's place in the stored table deals also repeated rows evenly
        dealt = rest.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        columns = [f"{n} {t}" for n, t in dealt.drop("group", "sequence_id", "offset", "open").dtypes]
        packed = materialise(dealt.groupBy("group").applyInArrow(_pack_group(number, capacity), ", ".join([*columns, "sequence_id long, offset long, open boolean"])))
        done.append(packed.where(~F.col("open")))
        rest, last = packed.where(F.col("open")), groups
        if groups == 1:
            break
    done.append(rest)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part.drop("open"))
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
