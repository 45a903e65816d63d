"""Words of documents that stand in passages of benchmark items: a prefix-filtered join of shingle sets.

The windows of an item are its runs of ``window`` consecutive words (an item with fewer words is one window). A window is the
set of its shingles of ``width`` words with their places. To hold the whole window a document must hold every shingle of it,
so one token of the prefix is enough to find all candidates: the shingle that is rarest in the documents, counted over all of
them. A window with a shingle that no document has is dropped. A document place with a prefix shingle gives the start of
the window (place less offset); it must lie within the document (positional bound) and leave room for the whole window
(length bound); then the words are compared byte by byte.

The windows are a query set against all documents. They are taken in blocks of at most ``block_windows`` (window, item) rows,
so what is sent to a task is bounded; every block goes over all documents, and nothing of a document leaves its task.

Words are the runs of ``[0-9a-z]`` and characters beyond ASCII after A-Z are lowered.

Defined results: null or empty text has no words and is not hit; an item with no words has no windows; an item with a null id
marks words but is not listed; repeated items count once, repeated documents give a row each; without items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import words as W
from tidewatch.llm.memory import released
from tidewatch.llm.tokens import text_bytes
from tidewatch.plans.store import materialise

WINDOW = 10
WIDTH = 3
#: (window, item) rows that are sent to a task at once.
BLOCK_WINDOWS = 200_000
_BITS = 20
_STATE = "id long, text string, n_words long, n_hit long, items array<string>, spans array<struct<first:long,last:long>>"


def _ranges(lows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``low, low + 1, ...`` of each range, in a row."""
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(lows - first, counts)


class Lookup:
    """Sorted 64-bit keys behind a bit table that turns most strangers away."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places whose hash is a key, and the range of equal keys of each."""
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        low = np.searchsorted(self.keys, hashes[at])
        high = np.searchsorted(self.keys, hashes[at], side="right")
        real = high > low
        return at[real], low[real], high[real] - low[real]


def windows(items: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct ``(words, n, item)``: the words of each window joined by single spaces, and how many there are."""
    schema = pa.schema([("words", pa.string()), ("n", pa.int32()), ("item", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column("item").to_pylist(), text_bytes(batch.column("text"))):
                data, starts, ends, _ = W.text_words(text, W.ALNUM)
                found = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
                size = min(window, len(found))
                out += [(" ".join(found[i:i + size]), size, item) for i in range(len(found) - size + 1) if size]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, schema.types)], schema=schema)

    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "words string, n int, item string").distinct()


@dataclass
class Block:
    """Windows of one block: their words, sizes, items, and the shingles of each with offsets."""

    words: list[str]
    sizes: np.ndarray
    items: list[list[str]]
    shingle: np.ndarray  # hash of every shingle of every window, with its window, offset and width
    owner: np.ndarray
    offset: np.ndarray
    width: np.ndarray

    @classmethod
    def of(cls, rows: list, width: int) -> "Block":
        by_words: dict[str, tuple[int, list[str]]] = {}
        for r in rows:
            known = by_words.setdefault(r["words"], (r["n"], []))
            if r["item"] is not None:
                known[1].append(r["item"])
        words = list(by_words)
        parts = []
        for k, text in enumerate(words):
            _, _, _, h = W.text_words(text.encode(), W.ALNUM)
            w = min(width, len(h))
            s = W.shingles(h, w)
            parts.append((s, np.full(len(s), k), np.arange(len(s)), np.full(len(s), w)))
        shingle, owner, offset, widths = (np.concatenate(c) for c in zip(*parts)) if parts else [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 3
        return cls(words, np.array([by_words[t][0] for t in words], np.int64), [sorted(set(by_words[t][1])) for t in words], shingle, owner, offset, widths)


def _blocks_of_docs(texts: list[bytes]) -> Iterator[tuple]:
    """Word hashes of blocks of texts with the text of each word and where that text ends."""
    for i, data, s, e, h, first in W.batch_words(texts, W.ALNUM):
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        yield i, data, s, e, h, first, row


def _shingles(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and whether the shingle lies within one text."""
    s = W.shingles(h, width)
    return s, row[: len(s)] == row[width - 1:] if len(s) else np.zeros(0, bool)


def shingle_counts(docs: DataFrame, block: Block) -> np.ndarray:
    """How often each shingle of the block occurs in all documents, by its place in ``block.shingle``."""
    tables = [(int(w), np.unique(block.shingle[block.width == w])) for w in np.unique(block.width)]
    schema = pa.schema([("width", pa.int32()), ("place", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = [(w, Lookup(keys)) for w, keys in tables]
        counts = [np.zeros(len(keys), np.int64) for _, keys in tables]
        for batch in batches:
            for _, _, _, _, h, _, row in _blocks_of_docs(text_bytes(batch.column("text"))):
                for (w, lookup), n in zip(lookups, counts):
                    s, whole = _shingles(h, row, w)
                    at, low, _ = lookup.find(s)
                    n += np.bincount(low[whole[at]], minlength=len(n))
        for (w, _), n in zip(tables, counts):
            there = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(there), w), pa.int32()), pa.array(there, pa.int64()), pa.array(n[there], pa.int64())], schema=schema)

    counted = docs.select("text").mapInArrow(released(run), "width int, place long, n long").groupBy("width", "place").agg(F.sum("n").alias("n"))
    out = np.zeros(len(block.shingle), np.int64)
    by_width = {w: np.zeros(len(keys), np.int64) for w, keys in tables}
    for r in counted.collect():  # at most one row per shingle of the block
        by_width[r["width"]][r["place"]] = r["n"]
    for w, keys in tables:
        own = block.width == w
        out[own] = by_width[w][np.searchsorted(keys, block.shingle[own])]
    return out


class Marker:
    """Finds the windows of a block in texts: prefix lookup, bounds, then the words themselves."""

    def __init__(self, block: Block, counts: np.ndarray):
        # order the shingles of each window by rarity; the first is the prefix, and a window with a shingle that never occurs is out
        order = np.lexsort((block.shingle, counts, block.owner))
        prefix = order[np.flatnonzero(np.diff(block.owner[order], prepend=-1))]
        prefix = prefix[counts[prefix] > 0]
        self.tables = []
        for w in np.unique(block.width[prefix]):
            own = prefix[block.width[prefix] == w]
            own = own[np.argsort(block.shingle[own], kind="stable")]
            self.tables.append((int(w), block.shingle[own], block.owner[own], block.offset[own]))
        self.words, self.sizes, self.items = block.words, block.sizes, block.items

    def lookups(self) -> list[Lookup]:
        return [Lookup(keys) for _, keys, _, _ in self.tables]

    def occurrences(self, lookups: list[Lookup], data, s, e, h, first, row) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Window starts and windows that are there word by word."""
        for lookup, (w, _, owner, offset) in zip(lookups, self.tables):
            keys, whole = _shingles(h, row, w)
            at, low, n = lookup.find(keys)
            low, n, at = low[whole[at]], n[whole[at]], at[whole[at]]
            entry = _ranges(low, n)
            place, which = np.repeat(at, n), owner[entry]
            begin = place - offset[entry]
            inside = (begin >= first[row[place]]) & (begin + self.sizes[which] <= first[row[place] + 1])
            begin, which = begin[inside], which[inside]
            same = np.fromiter(
                (b" ".join([data[s[k]:e[k]].tobytes() for k in range(b, b + self.sizes[x])]) == self.words[x].encode() for b, x in zip(begin, which)), bool, len(begin))
            yield begin[same], which[same]

    def mark(self, lookups: list[Lookup], texts: list[bytes], found: list, runs: list) -> tuple[np.ndarray, np.ndarray]:
        """Words and hit words of each text; adds to its items and replaces its runs of hit words."""
        n_words, n_hit = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, data, s, e, h, first, row in _blocks_of_docs(texts):
            m = len(first) - 1
            n_words[i:i + m] = np.diff(first)
            edge = np.zeros(len(h) + 1, np.int64)
            for begin, which in self.occurrences(lookups, data, s, e, h, first, row):
                edge += np.bincount(begin, minlength=len(edge)) - np.bincount(begin + self.sizes[which], minlength=len(edge))
                for d, x in np.unique(np.stack([row[begin], which]), axis=1).T:
                    found[i + d] = [*(found[i + d] or []), *self.items[x]]
            for d in range(i, i + m):  # what earlier blocks have marked
                for r in runs[d] or []:
                    edge[first[d - i] + r["first"]] += 1
                    edge[first[d - i] + r["last"] + 1] -= 1
            hit = np.cumsum(edge)[:-1] > 0
            n_hit[i:i + m] = np.bincount(row[hit], minlength=m)
            for d in np.flatnonzero(n_hit[i:i + m]):
                own = np.concatenate([[False], hit[first[d]:first[d + 1]], [False]]).astype(np.int8)
                turn = np.flatnonzero(np.diff(own))
                runs[i + d] = [{"first": a, "last": b - 1} for a, b in zip(turn[::2].tolist(), turn[1::2].tolist())]
        return n_words, n_hit


def _marked(docs: DataFrame, marker: Marker, keep_text: bool) -> DataFrame:
    """Add what the block's windows hit to the state of every document; the last block drops the texts."""
    schema = pa.schema([
        ("id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = marker.lookups()
        for batch in batches:
            texts, found, runs = text_bytes(batch.column("text")), batch.column("items").to_pylist(), batch.column("spans").to_pylist()
            n_words, n_hit = marker.mark(lookups, texts, found, runs)
            text = batch.column("text") if keep_text else pa.nulls(len(texts), pa.string())
            columns = [batch.column("id"), text, pa.array(n_words), pa.array(n_hit), pa.array([sorted(set(f or [])) for f in found], schema.types[4]), pa.array([r or [] for r in runs], schema.types[5])]
            yield pa.record_batch([c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)

    return docs.mapInArrow(released(run), _STATE)


def markers(docs: DataFrame, items: DataFrame, *, window: int, width: int, block_windows: int, item_col: str, item_text_col: str) -> Iterator[tuple[Marker, bool]]:
    """One marker per block of windows, and whether it is the last; each is made when it is asked for, so the driver holds one block.

    ``docs`` has a column ``text`` in which shingles are counted.
    """
    found = materialise(windows(items, window, item_col, item_text_col))
    blocks = max(1, -(-found.count() // block_windows))
    for k in range(blocks):
        block = Block.of(found.where(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == k).collect(), width)
        yield Marker(block, shingle_counts(docs, block)), k + 1 == blocks


def without_items(
    docs: DataFrame, items: DataFrame, *, window: int = WINDOW, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that no window of an item hits, with all their columns; what one block leaves is stored before the next."""
    texts = docs.select(F.col(text_col).alias("text"))
    for marker, last in markers(texts, items, window=window, width=width, block_windows=block_windows, item_col=item_col, item_text_col=item_text_col):
        def run(batches: Iterator[pa.RecordBatch], marker: Marker = marker) -> Iterator[pa.RecordBatch]:
            lookups = marker.lookups()
            for batch in batches:
                plain = text_bytes(batch.column(text_col))
                _, hit = marker.mark(lookups, plain, [None] * len(plain), [None] * len(plain))
                yield batch.filter(pa.array(np.asarray(hit) == 0))

        docs = docs.mapInArrow(released(run), docs.schema)
        docs = docs if last else materialise(docs)
    return docs


def contamination(
    docs: DataFrame, items: DataFrame, *, window: int = WINDOW, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``id_col, n_words, n_hit, items, spans`` of each document: hit words, items with occurring windows, runs of hit words."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    empty = {"n_words": "0L", "n_hit": "0L", "items": "cast(array() as array<string>)", "spans": "cast(array() as array<struct<first:bigint,last:bigint>>)"}
    state = plain.withColumns({k: F.expr(v) for k, v in empty.items()})
    for marker, last in markers(plain, items, window=window, width=width, block_windows=block_windows, item_col=item_col, item_text_col=item_text_col):
        state = _marked(state, marker, not last)
        state = state if last else materialise(state)
    return state.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", "spans")
