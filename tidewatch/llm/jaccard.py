"""Near-duplicate classes by an exact Jaccard join of word shingles with partition signatures (PartEnum).

Documents with the same set of shingles form a class, named by a 64-bit hash of the set; everything after that works on
classes. Two sets of sizes a and b link when their symmetric difference is at most ``k = (a + b)(1 - s) / (1 + s)``.

*Signatures.* Set sizes are cut into bands of ratio ``BAND``. In a band the domain of shingles is hashed into P parts; the
signature of a part is a hash of what a set has there. Each of the k differing shingles spoils at most one part, so two
linked sets agree in all but k of the parts that are not empty, and of any k + 1 of them in one order common to all sets
they share one: a set gives the k + 1 first of its parts, those with the most rare shingles first. A set near the upper edge of
its band also gives signatures of the next band. A set with fewer than k + 1 filled parts gives signatures of finer
partitions too, down to single shingles, where it always has enough. So no link is lost. Which shingles are frequent is
counted over all documents, and only steers the order: passages that many documents share do not fill buckets.

*Candidates.* Sets that share a signature form a bucket. No bucket is paired out: the members are first compared with one
pivot, the member that meets most others in all its buckets, and links join them into components. Members of a component need
no comparison among each other. Buckets that still hold several components are merged into clusters, and each member
outside the largest component of its cluster is counted against the others through an inverted index of shingles; a cluster
of more than ``BLOCK`` shingles is cut into blocks, and every pair of blocks is a task of its own.

Shingles are told apart by a 64-bit hash. Defined results: null, empty or white-space texts have no shingles and link with
nothing; with fewer words than ``width`` the whole sequence is the one shingle; repeated rows and equal texts share a class;
rows with a null id are counted in their class but never name it; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import words as W
from tidewatch.llm.components import components
from tidewatch.llm.memory import released
from tidewatch.llm.tokens import text_bytes
from tidewatch.plans.store import materialise

WIDTH = 5
#: Links need ``100 * intersection >= SIMILARITY * union``.
SIMILARITY = 80
#: Ratio of the largest to the smallest size of a band.
BAND = 2.5
#: Shingles per part for the largest sets of a band.
PART = 3.0
#: Frequent shingles that steer the order of signatures; the bound of what is sent to tasks.
FREQUENT = 200_000
#: A batch of documents reports a shingle from so many of its sets on.
BATCH_SEEN = 4
#: Shingles in a block of a cluster.
BLOCK = 1 << 18
_FILTER_BITS = 24


@dataclass(frozen=True)
class Join:
    """Parameters of the join."""

    width: int = WIDTH
    similarity: int = SIMILARITY

    def differing(self, a, b):
        """The largest symmetric difference of linked sets of sizes a and b."""
        return (a + b) * (100 - self.similarity) // (100 + self.similarity)

    def most_differing(self, n: int) -> int:
        """The same over all partners of a set of size n."""
        return int(self.differing(n, n * 100 // self.similarity))

    def shingle_set(self, hashes: np.ndarray) -> np.ndarray:
        """Sorted distinct shingle hashes of a sequence of word hashes."""
        if not len(hashes):
            return hashes
        return np.unique(W.shingles(hashes, min(self.width, len(hashes))))

    def bands(self, n: int) -> list[int]:
        """The band of a size, and the next one where a larger partner may stand in it."""
        own = _band(n)
        return [own, own + 1] if _band(n * 100 // self.similarity) > own else [own]


def _lowest(band: int) -> int:
    return int(np.ceil(BAND**band))


def _band(n: int) -> int:
    band = max(0, int(np.log(max(n, 1)) / np.log(BAND)) - 1)
    while _lowest(band + 1) <= n:
        band += 1
    return band


def parts(shingles: np.ndarray, rare: np.ndarray, band: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the parts that are not empty, and how many rare shingles each holds. Level 2 has a part for each shingle."""
    seed = np.uint64(band * 3 + level + 1)
    if level == 2:
        return W.mix(shingles + seed * np.uint64(0xD6E8FEB86659FD93)), rare
    count = np.uint64(max(1, int(_lowest(band + 1) / PART)) * (1, 8)[level])
    part = (W.mix(shingles ^ (seed << np.uint64(32))) >> np.uint64(16)) % count
    order = np.argsort(part, kind="stable")
    first = np.flatnonzero(np.diff(part[order].astype(np.int64), prepend=-1))
    sums = np.add.reduceat(W.mix(shingles[order] * np.uint64(2) + np.uint64(1)), first)
    filled = part[order][first]
    return W.mix(sums + W.mix(filled + (seed << np.uint64(40)))), np.add.reduceat(rare[order], first)


def chosen_parts(join: Join, shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The signatures that a set gives; ``frequent`` is sorted."""
    rare = np.ones(len(shingles), np.int64)
    if len(frequent):
        rare -= frequent[np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)] == shingles
    out = []
    need = join.most_differing(len(shingles)) + 1
    for band in join.bands(len(shingles)):
        for level in range(3):
            signs, held = parts(shingles, rare, band, level)
            out.append(signs[np.lexsort((signs, -held))[:need]])
            if len(signs) >= need:
                break
    return np.concatenate(out)


def set_key(shingles: np.ndarray) -> int:
    """Name of the class of sets equal to this one."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def shingle_sets(join: Join, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """The shingle set of each text, in order."""
    for i, _, _, _, h, first in W.batch_words(texts, W.NON_SPACE):
        for d in range(len(first) - 1):
            yield i + d, join.shingle_set(h[first[d]:first[d + 1]])


def _described(docs: DataFrame, join: Join) -> DataFrame:
    """Rows of two kinds: members (id, size of the set, class, hash of the text), and how often a shingle (``key``) was seen."""
    schema = pa.schema([("seen", pa.bool_()), ("id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("text_hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sets = [], [], {}
            for _, s in shingle_sets(join, text_bytes(batch.column("text"))):
                sizes.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                if len(s):
                    sets[keys[-1]] = s
            size = len(sizes)
            yield pa.record_batch([pa.array(np.zeros(size, bool)), batch.column("id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), batch.column("text_hash")], schema=schema)
            if sets:
                all_, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                often = counts >= BATCH_SEEN
                k = int(often.sum())
                yield pa.record_batch([pa.array(np.ones(k, bool)), pa.nulls(k, pa.int64()), pa.array(counts[often], pa.int64()), pa.array(all_[often].view(np.int64)), pa.nulls(k, pa.int64())], schema=schema)

    return docs.mapInArrow(released(run), "seen boolean, id long, n long, key long, text_hash long")


def _signatures(docs: DataFrame, join: Join, frequent: np.ndarray) -> DataFrame:
    """``(sign, key, n)``: the signatures each class gives; a task gives those of a class once."""
    schema = pa.schema([("sign", pa.int64()), ("key", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in batches:
            signs, keys, sizes = [], [], []
            for _, s in shingle_sets(join, text_bytes(batch.column("text"))):
                if len(s) and (key := set_key(s)) not in met:
                    met.add(key)
                    signs.append(chosen_parts(join, s, frequent))
                    keys.append(key)
                    sizes.append(len(s))
            if signs:
                counts = [len(x) for x in signs]
                yield pa.record_batch([pa.array(np.concatenate(signs).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), counts)), pa.array(np.repeat(np.array(sizes, np.int32), counts))], schema=schema)

    return docs.select("text").mapInArrow(released(run), "sign long, key long, n int")


def _buckets(signatures: DataFrame) -> DataFrame:
    """``(sign, key, n)`` of the members of buckets with two classes or more.

    Rows are sorted by signature and class, so buckets of any size stream through; the first member is held back until a
    second one shows that the bucket has several.
    """
    schema = pa.schema([("sign", pa.int64()), ("key", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32)]  # the last bucket's first row, while it is alone
        open_sign = None  # the last bucket's signature, once it has several
        for batch in batches:
            sign, key, n = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("sign", "key", "n")))
            if not len(sign):
                continue
            fresh = np.concatenate([[True], (sign[1:] != sign[:-1]) | (key[1:] != key[:-1])])
            sign, key, n = sign[fresh], key[fresh], n[fresh]
            same = sign[1:] == sign[:-1]
            out = np.concatenate([same, [False]]) | np.concatenate([[False], same]) | (sign == open_sign if open_sign is not None else False)
            alone = not out[-1]
            open_sign = None if alone else sign[-1]
            held = [x[-1:] if alone else x[:0] for x in (sign, key, n)]
            yield pa.record_batch([pa.array(sign[out]), pa.array(key[out]), pa.array(n[out])], schema=schema)

    return signatures.repartition("sign").sortWithinPartitions("sign", "key").mapInArrow(run, "sign long, key long, n int")


def sets_of(docs: DataFrame, join: Join, members: DataFrame, keys: DataFrame) -> DataFrame:
    """``(key, shingles)`` of the given classes, read from one text of each; others are turned away by a bit table of fixed size."""
    texts = members.where("key is not null").groupBy("key").agg(F.min("text_hash").alias("text_hash")).join(keys, "key")
    bit = F.col("text_hash").bitwiseAND((1 << _FILTER_BITS) - 1)
    rows = texts.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    packed = np.zeros(((1 << _FILTER_BITS) >> 3) + 4096, np.uint8)
    for r in rows:  # bucket k holds the bits for the values (k - 1) * 32768 + 1 to k * 32768
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        if r["at"] > 0:
            packed[(r["at"] - 1) * len(own):r["at"] * len(own)] |= own
    zero = any(r["at"] == 0 for r in rows)  # value 0 has a bucket of its own

    schema = pa.schema([("key", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in batches:
            bit = (batch.column("text_hash").to_numpy() & np.int64((1 << _FILTER_BITS) - 1)) - 1
            wanted = np.where(bit < 0, zero, packed[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
            mine = batch.filter(pa.array(wanted.astype(bool)))
            keys, sets = [], []
            for _, s in shingle_sets(join, text_bytes(mine.column("text"))):
                if len(s) and (key := set_key(s)) not in met:
                    met.add(key)
                    keys.append(key)
                    sets.append(s.view(np.int64))
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    return docs.mapInArrow(released(run), "key long, shingles array<long>").join(keys, "key", "left_semi").dropDuplicates(["key"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, same, either)`` for distinct pairs: sizes of intersection and union."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("same", pa.int32()), ("either", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            same, either = [], []
            for i in range(batch.num_rows):
                s, t = x[i].values.to_numpy(), y[i].values.to_numpy()
                both = len(np.intersect1d(s, t, assume_unique=True))
                same.append(both)
                either.append(len(s) + len(t) - both)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(same, pa.int32()), pa.array(either, pa.int32())], schema=schema)

    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(released(run), "a long, b long, same int, either int")


def _links_in(join: Join, rows: pa.Table) -> list[tuple[int, int, int, int]]:
    """Links of members outside the largest component to other components, one for each member and component."""
    keys, roots, block = (rows[c].to_numpy() for c in ("key", "root", "block"))
    low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
    shingles = rows["shingles"].combine_chunks()
    sizes = np.diff(shingles.offsets.to_numpy())
    code, _ = W.factorize(shingles.flatten().to_numpy())
    owner = np.repeat(np.arange(len(keys)), sizes)
    order = np.argsort(code, kind="stable")
    owners, count = owner[order], np.bincount(code)
    first, at = np.cumsum(count) - count, np.append(0, np.cumsum(sizes))
    values, times = np.unique(roots, return_counts=True)
    out = []
    for u in np.flatnonzero(roots != values[np.argmax(times)]):
        own = code[at[u]:at[u + 1]]
        place = np.arange(int(count[own].sum())) + np.repeat(first[own] - (np.cumsum(count[own]) - count[own]), count[own])
        same = np.bincount(owners[place], minlength=len(keys))
        either = sizes[u] + sizes - same
        hit = (100 * same >= join.similarity * either) & (roots != roots[u]) & (low == high or block != block[u])
        for x in np.flatnonzero(hit)[np.unique(roots[hit], return_index=True)[1]]:
            out.append((min(keys[u], keys[x]), max(keys[u], keys[x]), same[x], either[x]))
    return out


class _Search:
    """The rounds of comparison, with the links found so far and their components."""

    def __init__(self, join: Join, sets: DataFrame):
        self.join, self.sets, self.seen, self.roots = join, sets, None, None

    def add(self, compared: DataFrame) -> None:
        """Keep what was compared, and renew the components."""
        new = materialise(compared)
        self.seen = new if self.seen is None else self.seen.unionByName(new)
        self.roots = materialise(components(self.links()))

    def links(self) -> DataFrame:
        return self.seen.where(F.expr(f"100L * same >= {self.join.similarity}L * either"))

    def with_roots(self, rows: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            rows = rows.join(self.roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
        return rows

    def run(self, buckets: DataFrame) -> None:
        self.stars(buckets)
        self.clusters(buckets)

    def stars(self, buckets: DataFrame) -> None:
        """Members against the pivots of their buckets: first the pivot met most often, then the others unless connected by now."""
        sized = buckets.join(buckets.groupBy("sign").agg(F.count("*").alias("size")), "sign")
        weight = sized.groupBy("key").agg(F.sum("size").alias("weight"))
        pivots = buckets.join(weight, "key").groupBy("sign").agg(F.max(F.struct("weight", "key", "n")).alias("p"))
        met = buckets.join(pivots.select("sign", F.col("p.key").alias("pivot"), F.col("p.n").alias("pivot_n")), "sign").where("key <> pivot")
        met = met.where(F.expr(f"100L * least(n, pivot_n) >= {self.join.similarity}L * greatest(n, pivot_n)"))
        best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("times"), "pivot"))
        ranked = met.groupBy("key", "pivot").agg(F.count("*").alias("times")).withColumn("rank", best)
        ranked = materialise(ranked.select(F.least("pivot", "key").alias("a"), F.greatest("pivot", "key").alias("b"), "rank"))
        self.add(compared(ranked.where("rank = 1").select("a", "b").distinct(), self.sets))
        rest = ranked.where("rank > 1").select("a", "b").distinct().join(self.seen, ["a", "b"], "left_anti")
        self.add(compared(self.with_roots(rest, "a", "b").where("a_root <> b_root").select("a", "b"), self.sets))

    def clusters(self, buckets: DataFrame) -> None:
        """Buckets with several components, merged where they share members, and compared block by block."""
        state = self.with_roots(buckets, "key")
        span = state.groupBy("sign").agg(F.min("key_root").alias("low"), F.max("key_root").alias("high"), F.min("key").alias("first")).where("low <> high")
        members = materialise(state.join(span.select("sign", "first"), "sign").select("sign", "key", "key_root", "n", "first"))
        cluster = components(members.select(F.col("first").alias("a"), F.col("key").alias("b"))).withColumnsRenamed({"node": "key", "root": "cluster"})
        rows = materialise(members.select("key", F.col("key_root").alias("root"), "n").distinct().join(cluster, "key"))
        blocks = rows.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
        rows = rows.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).join(self.sets, "key")
        join, schema = self.join, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("same", pa.int32()), ("either", pa.int32())])

        def run(group: pa.Table) -> pa.Table:
            found = _links_in(join, group)
            return pa.table([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 4, schema.types)], schema=schema)

        group = rows.select("cluster", "low", "high", "block", "key", "root", "shingles").groupBy("cluster", "low", "high")
        self.add(group.applyInArrow(run, "a long, b long, same int, either int").distinct())


def near_duplicates(docs: DataFrame, *, width: int = WIDTH, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(classes, links)``.

    ``classes`` has a row per document: ``id_col, n_shingles, key`` (name of its set), ``root`` (name of its component),
    ``component_id`` (smallest id of the component) and ``text_hash`` (xxhash64 of the text). ``links`` are the compared pairs of classes that link: ``a, b, same, either``;
    with the members of the classes they span every component.
    """
    join = Join(width, similarity)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    described = materialise(_described(rows, join))
    members = described.where("not seen").drop("seen")
    top = described.where("seen").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(FREQUENT).collect()
    frequent = np.sort(np.array([r["key"] for r in top], np.int64).view(np.uint64))
    buckets = materialise(_buckets(_signatures(rows, join, frequent)))
    keys = materialise(buckets.select("key").distinct())
    search = _Search(join, materialise(sets_of(rows, join, members, keys)))
    search.run(buckets)
    rooted = members.join(search.roots.withColumnsRenamed({"node": "key"}), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = rooted.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    classes = rooted.join(named, "root", "left").withColumn("component_id", F.coalesce(F.when(F.col("root").isNotNull(), F.col("component_id")), F.col("id")))
    return classes.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "key", "root", "component_id", "text_hash"), search.links()
