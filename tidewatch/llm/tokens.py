"""Token counts and token ids of whole texts with a public tokenizer, in Arrow batches balanced by bytes.

``word_bpe_49k.json`` turns every run of white space into one space, drops it, and takes letters, single digits and other
signs apart, so no token reaches across ASCII white space or across the border between an ASCII letter or digit and one of
the ``MARKS``. Texts are cut at these safe boundaries into units, and the tokens of a text are those of its units in order.
Rows are taken in blocks of about the same number of bytes; of each block, the units that the task has not met go to the
library in one batch, and only lengths (or ids) are kept, in a table of bounded size keyed by a 64-bit hash of the unit.

Defined results: a null or empty text has 0 tokens and 0 bytes; a null id is returned as null; repeated rows are counted
one by one; a text without any safe boundary is one unit and goes to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import words as W
from tidewatch.llm.memory import released

TOKENIZER = "word_bpe_49k.json"
#: Bytes of text in a block.
BLOCK_BYTES = 2 << 20
#: Units a task remembers (some 100 bytes each, ids included); beyond it the table starts anew.
REMEMBERED = 400_000
#: Signs that the tokenizer always parts from letters and digits: no apostrophe, and none of ``<|>``.
MARKS = b".,!?;:#$%&*"

_CLASS = np.full(256, 3, np.uint8)
_CLASS[list(W.SPACE)] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_CLASS[list(MARKS)] = 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units of a block."""
    kind = np.zeros(len(data) + 2, np.uint8)
    kind[1:-1] = _CLASS[data]
    before, after = kind[:-1], kind[1:]
    cut = (before == 0) | (after == 0) | (before + after == 3) & (before != after)
    edge = np.flatnonzero(cut)
    inside = kind[edge[:-1] + 1] != 0
    return edge[:-1][inside], edge[1:][inside]


class Units:
    """Lengths, and where asked for ids, of the units that a task has met."""

    def __init__(self, path: str, with_ids: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.with_ids = Tokenizer.from_file(path), with_ids
        self.forget()

    def forget(self) -> None:
        self.keys, self.sizes, self.at, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        coded = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        at = np.cumsum(sizes) - sizes + len(self.ids)
        if self.with_ids:
            self.ids = np.concatenate([self.ids, np.fromiter((i for ids in coded for i in ids), "<u4", int(sizes.sum()))])
        order = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[order])
        self.keys, self.sizes, self.at = (np.insert(old, place, new[order]) for old, new in ((self.keys, keys), (self.sizes, sizes), (self.at, at)))

    def entries(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the units of a block, and the place of each unit in the table."""
        data = np.frombuffer(raw, np.uint8)
        if b"<|" not in raw:  # special strings are told by their case
            data = W.LOWER[data]
        starts, ends = units(data)
        codes, keys = W.factorize(W.hashes(data, starts, ends))
        if len(self.keys) > REMEMBERED:
            self.forget()
        place = np.searchsorted(self.keys, keys)
        there = place < len(self.keys)
        there[there] = self.keys[place[there]] == keys[there]
        if not there.all():
            first = np.zeros(len(keys), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            text = data.tobytes()
            self.learn(keys[~there], [text[starts[i]:ends[i]].decode() for i in first[~there]])
            place = np.searchsorted(self.keys, keys)
        return starts, place[codes]


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, bytes]]:
    """``(row, bytes)``: texts joined by spaces up to about ``limit`` bytes; a longer text is cut at white space."""
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j]) <= limit):
            held += len(texts[j]) + 1
            j += 1
        if j > i + 1:
            yield i, j, b" ".join(texts[i:j])
        else:
            data = np.frombuffer(texts[i], np.uint8)
            for a, b in W.segments(data, W.NON_SPACE, limit):
                yield i, j, texts[i][a:b]
        i = j


def _rows_of(texts: list[bytes], i: int, j: int, starts: np.ndarray) -> np.ndarray:
    """Which text each unit of a block of several texts belongs to."""
    sizes = np.fromiter((len(t) + 1 for t in texts[i:j]), np.int64, j - i)
    return np.searchsorted(np.cumsum(sizes), starts, side="right")


def count_tokens(table: Units, texts: list[bytes]) -> np.ndarray:
    counts = np.zeros(len(texts), np.int64)
    for i, j, raw in blocks(texts):
        starts, place = table.entries(raw)
        sizes = table.sizes[place]
        if j == i + 1:
            counts[i] += int(sizes.sum())
        else:
            counts[i:j] += np.bincount(_rows_of(texts, i, j, starts), sizes, j - i).astype(np.int64)
    return counts


def token_ids(table: Units, texts: list[bytes]) -> list[np.ndarray]:
    """The ids of each text as little-endian unsigned 32-bit numbers."""
    out: list = [[] for _ in texts]
    for i, j, raw in blocks(texts):
        starts, place = table.entries(raw)
        sizes = table.sizes[place]
        first = np.cumsum(sizes) - sizes
        ids = table.ids[np.arange(int(sizes.sum())) + np.repeat(table.at[place] - first, sizes)]
        if j == i + 1:
            out[i].append(ids)
        else:
            ends = np.cumsum(np.bincount(_rows_of(texts, i, j, starts), sizes, j - i)).astype(np.int64)
            for k, part in enumerate(np.split(ids, ends[:-1])):
                out[i + k].append(part)
    return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, "<u4"), *x]) for x in out]


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col``, ``n_bytes`` and ``n_tokens`` of every row of ``docs``; other columns are not read."""
    path = path or tokenizer_path()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Units(path, False)
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.record_batch([batch.column("id").cast(pa.int64()), sizes, pa.array(count_tokens(table, texts), pa.int64())], schema=schema)

    return rows.mapInArrow(released(run), "id long, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
