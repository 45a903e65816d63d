"""Near-duplicates by an inverted join over the coordinates of MinHash signatures.

Documents with the same set of word shingles form a class. A class has a signature of ``COORDINATES`` minima; a coordinate with its
value is a token, and two sets of similarity s agree in each coordinate with chance s. Pairs that collide in at least ``MATCHES``
coordinates are candidates, and a link is confirmed on the full sets. With 64 coordinates and 36 matches, a pair at exactly 0.8
is missed with a chance of 4e-6.

*Prefix.* Two signatures with MATCHES tokens in common share one of the first ``COORDINATES - MATCHES + 1`` tokens of each in any order common to
all. Only these are posted, rare ones first: tokens are ordered by the number of classes that hold them, counted over all. Passages that
many documents share come last, and a class with that many tokens of its own has no partner and posts none.

*Stars.* The posting list of a token is not paired out. Its members are first compared with one pivot each, the member that meets most others; links
make components, and members of one component need no comparison among each other.

*Skip merging.* Lists that still hold several components are merged into clusters. There an inverted index holds the list of each token.
A member outside the largest component merges its ``COORDINATES - MATCHES + 1`` shortest lists, and probes the long ones, shortest first, only for those
that can still reach MATCHES collisions: the rest of the long lists is skipped. A cluster of more than ``BLOCK`` shingles is cut into blocks and
each pair of blocks is a task; this work is quadratic in the members outside the largest component.

Defined results: null, empty or white-space texts have no shingles and link with nothing; with fewer words than ``width`` the whole
sequence is the one shingle; texts of any length give whole sets; repeated rows and equal sets share a class; a null id is counted in
its class but never names it, and stands as its own null component where no id can; empty tables give no rows; other columns are not read.
Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import words as W
from tidewatch.llm.components import components
from tidewatch.llm.jaccard import Join, compared, set_key, sets_of, shingle_sets
from tidewatch.llm.memory import released
from tidewatch.llm.tokens import text_bytes
from tidewatch.plans.store import materialise

WIDTH, SIMILARITY = 4, 80
COORDINATES, MATCHES = 64, 36
PREFIX = COORDINATES - MATCHES + 1
#: Shingles whose signatures are computed together.
WAITING = 1 << 17
#: Shingles in a block of a cluster, and members of a star that share one copy of the pivot.
BLOCK, STAR = 1 << 18, 1_000
_RANDOM = np.random.Generator(np.random.PCG64(20250811)).integers(1, 1 << 63, (2, COORDINATES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``COORDINATES`` 32-bit minima for each set; sets must not be empty."""
    sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    first, all_ = np.cumsum(sizes) - sizes, np.concatenate(sets)
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for c in range(COORDINATES):
        out[:, c] = np.minimum.reduceat((all_ * _RANDOM[0, c] + _RANDOM[1, c]) >> np.uint64(32), first)
    return out


def tokens(signs: np.ndarray) -> np.ndarray:
    """A 64-bit name for each coordinate with its value."""
    return W.mix((np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(32)) ^ signs.astype(np.uint64))


def _described(docs: DataFrame, join: Join) -> DataFrame:
    """``(id, n, key, text_hash, sign)``: documents, with the signature where a task meets the class first."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("text_hash", pa.int64()), ("sign", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in batches:
            sizes, keys, signs, fresh, held = [], [], [], [], 0

            def flush() -> None:
                if fresh:
                    for place, sign in zip([p for p, _ in fresh], signatures([s for _, s in fresh])):
                        signs[place] = sign.tobytes()
                    fresh.clear()

            for _, s in shingle_sets(join, text_bytes(batch.column("text"))):
                key = set_key(s) if len(s) else None
                if key is not None and key not in met:
                    met.add(key)
                    fresh.append((len(signs), s))
                    held += len(s)
                sizes.append(len(s))
                keys.append(key)
                signs.append(None)
                if held > WAITING:
                    flush()
                    held = 0
            flush()
            yield pa.record_batch([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), batch.column("text_hash"), pa.array(signs, pa.binary())], schema=schema)

    return docs.mapInArrow(released(run), "id long, n long, key long, text_hash long, sign binary")


def _matrix(signs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signs.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _lists(classes: DataFrame) -> DataFrame:
    """``(token, key, n)``: the posting lists of prefix tokens that several classes post.

    The order of tokens is that of how many classes hold them, counted over all. A token of one class only comes first and makes no list, so
    a class with ``PREFIX`` such tokens posts nothing.
    """
    schema = pa.schema([("token", pa.int64()), ("key", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names = tokens(_matrix(batch.column("sign"))).ravel().view(np.int64)
                yield pa.record_batch([pa.array(names), pa.array(np.repeat(batch.column("key").to_numpy(), COORDINATES)), pa.array(np.repeat(batch.column("n").to_numpy().astype(np.int32), COORDINATES))], schema=schema)

    posts = classes.select("key", "n", "sign").mapInArrow(run, "token long, key long, n int")
    shared = posts.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    own = posts.join(shared, "token").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("size", "token"))).alias("held"))
    prefix = F.slice("held", F.lit(1), F.lit(PREFIX - COORDINATES) + F.size("held"))
    rows = own.where(F.size("held") > COORDINATES - PREFIX).select("key", "n", F.explode(prefix).alias("p")).select("p.token", "key", "n")
    rows = materialise(rows)
    return materialise(rows.join(rows.groupBy("token").count().where("count > 1").select("token"), "token"))


def _collided(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (member, pivot) whose signatures collide in at least ``MATCHES`` coordinates; a pivot of many members is repeated."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                match = (_matrix(batch.column("x")) == _matrix(batch.column("y"))).sum(axis=1) >= MATCHES
                yield batch.select(["a", "b"]).filter(pa.array(match)).cast(schema)

    copies = pairs.groupBy("pivot").agg(F.floor(F.count("*") / STAR).alias("copies"))
    pivots = copies.join(classes.select(F.col("key").alias("pivot"), F.col("sign").alias("y")), "pivot")
    pivots = pivots.select("pivot", "y", "copies", F.explode(F.sequence(F.lit(0).cast("long"), "copies")).alias("salt")).drop("copies")
    dealt = pairs.join(classes.select("key", F.col("sign").alias("x")), "key")
    dealt = dealt.join(copies, "pivot").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("copies") + 1)).drop("copies")
    both = dealt.join(pivots, ["pivot", "salt"]).select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b"), "x", "y")
    return both.mapInArrow(run, "a long, b long").distinct()


def merged(own: int, lists: np.ndarray, starts: np.ndarray, members: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Members that collide with member ``own`` in at least ``MATCHES`` tokens, by merging short lists and skipping in long ones.

    ``lists[m]`` names the lists of member m; list l is ``members[starts[l]:starts[l + 1]]``, in rising order. ``others`` marks members that count.
    """
    mine = lists[own]
    sizes = starts[mine + 1] - starts[mine]
    mine = mine[np.argsort(sizes, kind="stable")]
    found, count = np.unique(np.concatenate([members[starts[x]:starts[x + 1]] for x in mine[:PREFIX]]), return_counts=True)
    keep = others[found]
    found, count = found[keep], count[keep]
    for left, x in zip(range(MATCHES - 1, 0, -1), mine[PREFIX:]):
        alive = count + left >= MATCHES
        found, count = found[alive], count[alive]
        if not len(found):
            break
        run = members[starts[x]:starts[x + 1]]
        count = count + (run[np.minimum(np.searchsorted(run, found), len(run) - 1)] == found)
    return found[count >= MATCHES]


def _links_in(join: Join, rows: pa.Table) -> list[tuple[int, int, int, int]]:
    """Links of members outside the largest component to other components, one for each member and component."""
    keys, roots, block = (rows[c].to_numpy() for c in ("key", "root", "block"))
    low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
    shingles = rows["shingles"].combine_chunks()
    sets = [shingles[i].values.to_numpy() for i in range(len(keys))]
    code, _ = W.factorize(tokens(_matrix(rows["sign"].combine_chunks())).ravel())
    owner = np.repeat(np.arange(len(keys)), COORDINATES)
    members, starts = owner[np.argsort(code, kind="stable")], np.append(0, np.cumsum(np.bincount(code)))
    lists = code.reshape(len(keys), COORDINATES)
    values, times = np.unique(roots, return_counts=True)
    out = []
    for u in np.flatnonzero(roots != values[np.argmax(times)]):
        others = (roots != roots[u]) & ((block != block[u]) if low != high else True)
        linked = set()
        for x in merged(u, lists, starts, members, others):
            a, b = len(sets[u]), len(sets[x])
            if roots[x] in linked or 100 * min(a, b) < join.similarity * max(a, b):
                continue
            same = len(np.intersect1d(sets[u], sets[x], assume_unique=True))
            if 100 * same >= join.similarity * (a + b - same):
                linked.add(roots[x])
                out.append((min(keys[u], keys[x]), max(keys[u], keys[x]), same, a + b - same))
    return out


def _similar(links: DataFrame, join: Join) -> DataFrame:
    return links.where(F.expr(f"100L * same >= {join.similarity}L * either"))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def _star_pairs(lists: DataFrame) -> DataFrame:
    """``(key, pivot)``: the pivots of the lists a class stands in."""
    sized = lists.join(lists.groupBy("token").agg(F.count("*").alias("size")), "token")
    weight = sized.groupBy("key").agg(F.sum("size").alias("weight"))
    pivots = lists.join(weight, "key").groupBy("token").agg(F.max(F.struct("weight", "key", "n")).alias("p"))
    met = lists.join(pivots.select("token", F.col("p.key").alias("pivot"), F.col("p.n").alias("pivot_n")), "token").where("key <> pivot")
    met = met.where(F.expr(f"100L * least(n, pivot_n) >= {SIMILARITY}L * greatest(n, pivot_n)"))
    return materialise(met.select("key", "pivot").distinct())


def _clusters(lists: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """``(cluster, low, high, block, key, root, sign)``: members of lists with several components, dealt to pairs of blocks."""
    state = _rooted(lists, roots)
    span = state.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("key").alias("first")).where("low <> high")
    open_ = materialise(state.join(span.select("token", "first"), "token").select("key", "root", "n", "first").distinct())
    cluster = components(open_.select(F.col("first").alias("a"), F.col("key").alias("b"))).withColumnsRenamed({"node": "key", "root": "cluster"})
    rows = materialise(open_.select("key", "root", "n").distinct().join(cluster, "key"))
    blocks = rows.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    rows = rows.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    rows = rows.join(classes.select("key", "sign"), "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).select("cluster", "low", "high", "block", "key", "root", "sign")


def coordinate_duplicates(docs: DataFrame, *, width: int = WIDTH, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(classes, links)``: per document ``id_col, n_shingles, key, component_id``, and the confirmed links ``a, b, same, either`` between classes that join components."""
    join = Join(width, similarity)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    described = materialise(_described(rows, join))
    members = described.select("id", "n", "key", "text_hash")
    classes = materialise(described.where("sign IS NOT NULL").select("key", "n", "sign").dropDuplicates(["key"]))
    lists = _lists(classes)
    sets = materialise(sets_of(rows, join, members, lists.select("key").distinct()))

    links = materialise(_similar(compared(_collided(_star_pairs(lists), classes), sets), join))
    roots = materialise(components(links))

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("same", pa.int32()), ("either", pa.int32())])

    def run(group: pa.Table) -> pa.Table:
        found = _links_in(join, group)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 4, schema.types)], schema=schema)

    dealt = _clusters(lists, roots, classes).join(sets, "key").groupBy("cluster", "low", "high")
    links = links.unionByName(materialise(dealt.applyInArrow(run, "a long, b long, same int, either int").distinct()))
    roots = components(links)

    own = members.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least"))
    rooted = materialise(_rooted(own, roots))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = materialise(rooted.join(named, "root").select("key", "component_id"))
    found = members.join(names, "key", "left").withColumn("component_id", F.when(F.col("key").isNotNull(), F.col("component_id")).otherwise(F.col("id")))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "key", "component_id"), links
