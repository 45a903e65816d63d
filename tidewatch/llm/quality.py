"""Quality scores from a generalised additive model with pairwise interactions (an explainable boosting machine).

Every feature is a number that numpy reads off the bytes of a whole text. The model is a sum of lookup tables: one per feature
over quantile bins, and one per chosen pair over coarser bins. The tables are learned by cyclic boosting: in every round each
feature in turn gets a shallow tree on the gradient of the logistic loss, shrunk and added to its table; then the pairs
with the largest gain on what is left are boosted the same way with one cut in either feature. A score is the sum of the
looked-up values, added for whole batches at once.

Training uses a bounded sample: at most ``PER_CLASS`` labelled ids of each class outside the held-out part; only their features
travel to the driver. Scoring covers every row and whole text.

Defined results: null and empty texts have all features 0 and are scored by them; repeated rows are scored each; null ids are
never trained on; without labelled rows of both classes every score is the share of positive labels (0 without labels);
columns other than id, text and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import labelled as L
from tidewatch.llm import words as W
from tidewatch.llm.memory import released
from tidewatch.llm.tokens import text_bytes

PER_CLASS = 4_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 6
LEAVES = 3
RATE = 0.1

_COUNTS = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "stop": b".", "comma": b",", "shout": b"!?", "sign": b"#$%&*@^~|\\<>+=_/",
    "quote": b"\"'()[]{}:;-", "line": b"\n", "beyond": bytes(range(128, 256)),
}
_KIND = np.full(256, len(_COUNTS), np.int64)
for _i, _bytes in enumerate(_COUNTS.values()):
    _KIND[list(_bytes)] = _i
FEATURES = ["size", *_COUNTS, "words", "word_size", "word_spread", "distinct", "top_word", "long_words", "repeated_runs", "line_words", "repeated_lines", "doubled"]


def features(texts: list[bytes]) -> np.ndarray:
    """One row per text, one column per name in ``FEATURES``."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        if text:
            out[i] = _features(text)
    return out


def _features(text: bytes) -> list[float]:
    data = np.frombuffer(text, np.uint8)
    share = np.zeros(len(_COUNTS) + 1)
    doubled = 0
    for a in range(0, len(data), 1 << 20):  # the temporary arrays of a long text stay small
        part = data[a:a + (1 << 20)]
        share += np.bincount(_KIND[part], minlength=len(_COUNTS) + 1)
        doubled += int((part[1:] == part[:-1]).sum())
    lines = [x for x in text.split(b"\n") if x]
    row = [np.log1p(len(data)), *(share[:-1] / len(data))]
    _, starts, ends, h = W.text_words(text, W.NON_SPACE)
    if not len(h):
        return [*row, *[0.0] * 9, doubled / len(data)]
    sizes = ends - starts
    _, times = np.unique(h, return_counts=True)
    runs = W.shingles(h, 3)
    return [
        *row, np.log1p(len(h)), sizes.mean(), sizes.std(), len(times) / len(h), times.max() / len(h), (sizes > 15).mean(),
        1 - len(np.unique(runs)) / len(runs) if len(runs) else 0.0, np.log1p(len(h) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), doubled / len(data),
    ]


@dataclass
class Additive:
    """Lookup tables over bins; small enough to travel with the tasks."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]) if edges else np.zeros((len(x), 0), np.int64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        fine, coarse = self.bins(x, self.edges), self.bins(x, self.coarse)
        for j, table in enumerate(self.tables):
            total += table[fine[:, j]]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[:, a], coarse[:, b]]
        return L.sigmoid(total)


def _tree(slope: np.ndarray, curve: np.ndarray, leaves: int) -> np.ndarray:
    """Values per bin of a tree with up to ``leaves`` leaves on binned sums of gradients and curvatures."""
    cuts = [0, len(slope)]
    gs, cs = np.append(0, np.cumsum(slope)), np.append(0, np.cumsum(curve))

    def worth(a, b):
        return (gs[b] - gs[a]) ** 2 / (cs[b] - cs[a] + 1.0)

    while len(cuts) <= leaves:
        best, where = 1e-9, None
        for a, b in zip(cuts[:-1], cuts[1:]):
            k = np.arange(a + 1, b)
            if len(k):
                gain = worth(a, k) + worth(k, b) - worth(a, b)
                if gain.max() > best:
                    best, where = float(gain.max()), int(k[gain.argmax()])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.zeros(len(slope))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = -(gs[b] - gs[a]) / (cs[b] - cs[a] + 1.0)
    return out


def _quadrants(slope: np.ndarray, curve: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values per cell of the best tree with one cut in either feature."""
    g, c = slope.cumsum(0).cumsum(1), curve.cumsum(0).cumsum(1)
    best, table = 0.0, np.zeros_like(slope)
    parts = lambda s, i, j: (s[i, j], s[i, -1] - s[i, j], s[-1, j] - s[i, j], s[-1, -1] - s[i, -1] - s[-1, j] + s[i, j])
    for i in range(len(slope) - 1):
        for j in range(slope.shape[1] - 1):
            gp, cp = parts(g, i, j), parts(c, i, j)
            gain = sum(a * a / (b + 1.0) for a, b in zip(gp, cp))
            if gain > best:
                best, (w, x, y, z) = gain, [-a / (b + 1.0) for a, b in zip(gp, cp)]
                table = np.empty_like(slope)
                table[:i + 1, :j + 1], table[:i + 1, j + 1:], table[i + 1:, :j + 1], table[i + 1:, j + 1:] = w, x, y, z
    return best, table


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(x.shape[1])]


def train(x: np.ndarray, y: np.ndarray, shares: tuple[int, int]) -> Additive:
    """Boost the tables on a sample; ``shares`` are the numbers of negative and positive labels in all."""
    rate = shares[1] / max(1, sum(shares))
    n = (int((y == 0).sum()), int((y == 1).sum()))
    if not all(n):
        return Additive(40.0 if rate == 1 else -40.0 if rate == 0 else float(np.log(rate / (1 - rate))))
    weight = np.where(y == 1, shares[1] / n[1], shares[0] / n[0])
    weight = weight / weight.mean()
    mean = float((weight * y).sum() / weight.sum())
    model = Additive(float(np.log(mean / (1 - mean))), _edges(x, BINS), coarse=_edges(x, PAIR_BINS))
    fine, coarse = model.bins(x, model.edges), model.bins(x, model.coarse)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(x), model.base)

    def gradient():
        p = L.sigmoid(total)
        return weight * (p - y), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, c = gradient()
            step = RATE * _tree(np.bincount(fine[:, j], g, len(table)), np.bincount(fine[:, j], c, len(table)), LEAVES)
            table += step
            total += step[fine[:, j]]

    shapes = [len(e) + 1 for e in model.coarse]

    def cells(a, b, v):
        return np.bincount(coarse[:, a] * shapes[b] + coarse[:, b], v, shapes[a] * shapes[b]).reshape(shapes[a], shapes[b])

    g, c = gradient()
    gains = sorted(((-_quadrants(cells(a, b, g), cells(a, b, c))[0], a, b) for a in range(len(shapes)) for b in range(a + 1, len(shapes)) if shapes[a] > 1 and shapes[b] > 1))
    model.pairs = [(a, b) for gain, a, b in gains[:PAIRS] if gain < 0]
    model.pair_tables = [np.zeros((shapes[a], shapes[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            g, c = gradient()
            step = RATE * _quadrants(cells(a, b, g), cells(a, b, c))[1]
            table += step
            total += step[coarse[:, a], coarse[:, b]]
    return model


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Additive:
    """Train on the features of at most ``per_class`` labelled rows of each class outside the held-out part."""
    schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(text_bytes(batch.column("text")))
            yield pa.record_batch([batch.column("id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array(list(x), schema.types[2])], schema=schema)

    sample = L.labelled_texts(docs, labels, label, per_class, id_col, text_col).select("id", "text", "label")
    rows = sorted(sample.mapInArrow(run, "id long, label int, x array<double>").collect(), key=lambda r: (r["id"], r["x"]))
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return train(x, np.array([r["label"] for r in rows], np.int64), L.class_shares(labels, label))


def quality(docs: DataFrame, model: Additive, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``id_col, score, predicted`` of every row of ``docs``."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("id").cast(pa.int64()), pa.array(model.scores(features(text_bytes(batch.column("text")))))], schema=schema)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(released(run), "id long, score double")
    return rows.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
