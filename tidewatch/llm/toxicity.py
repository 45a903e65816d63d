"""Toxicity by compression distance: windows of a text compress to fewer bytes with the dictionary of the class they resemble.

*Training.* Two zstandard dictionaries are trained on the whole texts of a bounded sample of labelled rows (``PER_CLASS`` ids of each class). Both
hold the words that most ordinary texts share, so these cost the same with either; the rest of the toxic dictionary are
the strings (words, and beginnings of words) that stand in significantly more toxic texts than their share, by a likelihood
ratio test over all strings tried, counted without near copies; the rest of the ordinary one are further words of ordinary texts up to the same size.

*Scoring.* A text is lowered, its white space made single spaces, and cut into windows at spaces, in two window sizes. The
difference of the two compressed lengths of each window is summed up over the whole text (mean, positive part, largest),
and a logistic curve fitted on the training sample turns it into a probability with a calibrated threshold. Windows are
compressed without entropy coding of literals, so a difference counts matches and not letter statistics.

Defined results: null and empty texts have no windows and get the score of a text without any difference; null ids are
never trained on; repeated rows are scored each; with no labelled rows of both classes every score is the share of toxic
labels (0 without labels); columns other than id, text and label are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import labelled as L
from tidewatch.llm import words as W
from tidewatch.llm.memory import released
from tidewatch.llm.tokens import text_bytes
from tidewatch.plans.store import materialise

#: Labelled rows of each class that a model is trained on, at most.
PER_CLASS = 2_000
#: Window sizes in bytes with the least match of the compressor.
WINDOWS = ((160, 4), (400, 5))
COMMON_WORDS = 300
DICTIONARY_BYTES = 4096
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain(text: bytes) -> bytes:
    """A-Z lowered, words between single spaces; empty for a text without words."""
    words = text.translate(_LOWER).split()
    return b" " + b" ".join(words) + b" " if words else b""


def windows(text: bytes, size: int) -> list[bytes]:
    """Parts of at most ``size`` bytes, cut before a space where there is one."""
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            gap = text.rfind(b" ", at + 1, end)
            end = gap if gap > at else end
        out.append(text[at:end])
        at = end
    return out


def strings(text: bytes) -> set[bytes]:
    """The words of a text, and their beginnings from three bytes on, each behind a space."""
    found = set()
    for word in set(text.split()):
        found.update(b" " + word[:k] for k in range(3, min(len(word), 9)))
        if len(word) <= 32:
            found.add(b" " + word + b" ")
    return found


def signature(text: bytes) -> list[int]:
    """Four minimum hashes of the five-word runs of a text; empty for a text without words."""
    _, _, _, h = W.text_words(text, W.NON_SPACE)
    runs = W.shingles(h, min(5, len(h))) if len(h) else h
    return [int(W.mix(runs ^ np.uint64(k + 1) << np.uint64(56)).min().view(np.int64)) for k in range(4)] if len(runs) else []


def distinct(signatures: list[list[int]]) -> list[int]:
    """Places of texts but for copies and near copies of earlier ones, which would make their own rare words look like a mark of the class.

    A copy shares three of four minimum hashes with a text that is kept; of texts without words the first is kept.
    """
    kept, by = [], {}
    for i, own in enumerate(signatures):
        least = list(enumerate(own)) or [(4, 0)] * 3
        met = Counter(j for m in least for j in by.get(m, ()))
        if not met or max(met.values()) < 3:
            kept.append(i)
            for m in least:
                by.setdefault(m, []).append(i)
    return kept


def _ratio(a: Column, b: Column, na: int, nb: int) -> Column:
    """Likelihood ratio statistic of a of na against b of nb."""
    p = (a + b) / F.lit(float(na + nb))
    cells = ((a, p * na), (F.lit(na) - a, (1 - p) * na), (b, p * nb), (F.lit(nb) - b, (1 - p) * nb))
    return 2 * sum((F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0)) for o, e in cells), F.lit(0.0))


@dataclass
class Model:
    """Dictionaries and calibration; small enough to travel with the tasks."""

    base_rate: float
    toxic: bytes = b""
    ordinary: bytes = b""
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def compressors(self) -> list[tuple[int, object, object]]:
        import zstandard as Z

        made = []
        for size, least in WINDOWS:
            how = Z.ZstdCompressionParameters(window_log=13, chain_log=10, hash_log=12, search_log=1, min_match=least, target_length=1, strategy=Z.STRATEGY_FAST, write_content_size=False)
            pair = [Z.ZstdCompressor(dict_data=Z.ZstdCompressionDict(d, dict_type=Z.DICT_TYPE_RAWCONTENT), compression_params=how) for d in (self.ordinary, self.toxic)]
            made.append((size, *pair))
        return made

    def features(self, made, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), 3 * len(WINDOWS)))
        for i, text in enumerate(texts):
            text = plain(text)
            for k, (size, ordinary, toxic) in enumerate(made):
                parts = windows(text, size)
                if parts:
                    gain = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in parts])
                    out[i, 3 * k:3 * k + 3] = gain.mean(), np.maximum(gain, 0).sum() / math.sqrt(len(gain)), gain.max()
        return out

    def scores(self, made, texts: list[bytes]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.base_rate)
        x = (self.features(made, texts) - self.centre) / self.scale
        return L.sigmoid(self.weights[0] + x @ self.weights[1:])


def dictionaries(counts: DataFrame, n: tuple[int, int]) -> tuple[bytes, bytes]:
    """``(toxic, ordinary)`` from rows ``(s, a, b)``: how many of the ``n[1]`` toxic and ``n[0]`` ordinary texts hold string ``s``."""
    a, b = F.col("a"), F.col("b")
    tried = counts.where(a > 0).count()
    least = 3 * math.log(max(2, tried))  # well above the largest of that many chance values
    marks = counts.where((a >= 3) & (a * n[0] > 3 * (b + 0.5) * n[1])).withColumn("g", _ratio(a, b, n[1], n[0])).where(F.col("g") > least)
    held = {bytes(r["s"]): (r["g"], r["a"]) for r in marks.select("s", "a", "g").collect()}
    marked: list[bytes] = []
    for s in sorted(held, key=lambda s: (-held[s][0], -len(s), s)):
        # the longest string that stands in nearly all the same texts gains most when it is matched
        s = max((t for t in held if t.startswith(s) and held[t][1] >= 0.85 * held[s][1]), key=lambda t: (len(t), -held[t][0], t))
        if not any(s.rstrip() in m or m.rstrip() in s for m in marked) and sum(map(len, marked)) + len(s) <= DICTIONARY_BYTES:
            marked.append(s)
    words = counts.where((b > 0) & (F.substring("s", -1, 1) == F.lit(b" ")))
    common = [bytes(r["s"]) for r in words.orderBy(F.desc("b"), "s").limit(COMMON_WORDS).select("s").collect()]
    rare = [bytes(r["s"]) for r in words.orderBy("b", F.desc("s")).limit(DICTIONARY_BYTES).select("s").collect()]
    base = b"".join(reversed(common))
    own = b"".join(reversed(marked)) + b" "
    rest = b"".join(s for s in reversed(rare) if s not in set(common))
    return base + own, base + rest[-len(own):]


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on the whole texts of at most ``per_class`` labelled rows of each class outside the held-out part.

    Texts stay with the tasks: signatures, counts of strings that pass the test, and features travel to the driver.
    """
    shares = L.class_shares(labels, label)
    model = Model(shares[1] / max(1, sum(shares)))
    if not all(shares):
        return model
    texts = L.labelled_texts(docs, labels, label, per_class, id_col, text_col)
    sample = materialise(texts.select("id", "label", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).withColumn("h", F.xxhash64("text")))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([signature(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column("id").cast(pa.int64()), batch.column("h"), batch.column("label").cast(pa.int32()), found], names=["id", "h", "label", "signature"])

    rows = sorted(sample.mapInArrow(sign, "id long, h long, label int, signature array<long>").collect(), key=lambda r: (r["id"], r["h"]))
    rows = [rows[i] for i in distinct([r["signature"] for r in rows])]
    n = (sum(r["label"] == 0 for r in rows), sum(r["label"] == 1 for r in rows))
    if not all(n):
        return model
    own = docs.sparkSession.createDataFrame([(r["id"], r["h"]) for r in rows], "id long, h long")
    sample = sample.join(F.broadcast(own), ["id", "h"])  # no more rows than the sample has

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                found = pa.array(list(strings(plain(text))), pa.binary())
                yield pa.record_batch([found, pa.array(np.full(len(found), toxic, np.int32))], names=["s", "label"])

    told = sample.mapInArrow(tell, "s binary, label int")
    counts = materialise(told.groupBy("s").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b")))
    model.toxic, model.ordinary = dictionaries(counts, n)
    if len(model.toxic) < 16:
        return model

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = model.compressors()
        for batch in batches:
            x = model.features(made, batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("id").cast(pa.int64()), batch.column("h"), batch.column("label").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "h", "label", "x"])

    rows = sorted(sample.mapInArrow(measure, "id long, h long, label int, x array<double>").collect(), key=lambda r: (r["id"], r["h"]))
    x, toxic = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows])
    model.centre, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weight = np.where(toxic == 1, shares[1] / n[1], shares[0] / n[0])
    model.weights = L.fit_logistic((x - model.centre) / model.scale, toxic.astype(float), weight / weight.mean())
    return model


def without_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = model.compressors() if len(model.weights) else []
        for batch in batches:
            yield batch.filter(pa.array(model.scores(made, text_bytes(batch.column(text_col))) < threshold))

    return docs.mapInArrow(released(run), docs.schema)


def toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_col, score, predicted`` of every row of ``docs``, scored over its whole text."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = model.compressors() if len(model.weights) else []
        for batch in batches:
            yield pa.record_batch([batch.column("id").cast(pa.int64()), pa.array(model.scores(made, text_bytes(batch.column("text"))))], schema=schema)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(released(run), "id long, score double")
    return rows.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
