"""Exact duplicates through an extendible-hash index kept as tables in the shared folder; DataFrame operations only.

*Directory.* The first bits of the 64-bit hash of a normalised text name its slot. The directory starts with about two slots for each
``bucket_bytes`` of distinct hashes and is doubled, bit by bit, where a bucket is overfull, until every bucket fits or holds a single
hash. Only the slots that were split are stored, a table for each bit, so the directory is small whatever the input; a row is routed by
asking these tables how deep its prefix was split.

*Owners.* Texts are shuffled once, to the task that owns their bucket. There, rows with an equal hash form a chain, in which texts are
compared byte by byte (they are grouping keys of an aggregate inside the owner); the place in the chain is kept. Documents are routed by the
same directory and look up their entry by bucket, hash, SHA-256 and size.

*Hot groups.* A hash of more than ``hot_rows`` rows, or whose copies alone would overfill a bucket, is merged before its texts go to the
owner: an aggregate with map-side combine compares them byte by byte, and a group of any size costs a row per task.

A very long text is one row of its owner and, beyond ``bucket_bytes``, a bucket of its own.

Defined results: null counts as empty, and all empty texts are equal; among rows of a group the one with the most code points
stays, then the smallest id (null ids last); rows that repeat the id that stays are all marked kept; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.plans.store import broadcast_if_small, materialise

#: Bytes of distinct texts in a bucket.
BUCKET_BYTES = 8 << 20
#: Rows of one hash that go to its owner without being merged before.
HOT_ROWS = 1000
#: A bucket is named by the least hash it can hold. One column, as a constant beside it would cost a second shuffle of the texts.
BUCKET = "bucket"


def normalised(text: Column) -> Column:
    """The text without white space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), normalised(text).alias("norm"), F.char_length(F.coalesce(text, F.lit(""))).alias("points"), F.xxhash64(text).alias("text_hash")).withColumn("hash", F.xxhash64("norm"))


def prefix(depth: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - depth) if depth else F.lit(0).cast("long")


@dataclass(frozen=True)
class Directory:
    """Bits of an unsplit slot, and for each further bit the slots that were split there."""

    first: int
    splits: list[DataFrame]

    def route(self, rows: DataFrame) -> DataFrame:
        """Add ``depth`` and ``bucket`` of ``hash``."""
        rows = rows.withColumn("depth", F.lit(self.first))
        for depth, full in enumerate(self.splits, self.first):
            rows = rows.join(full.select(F.col("slot").alias("_slot")), prefix(depth) == F.col("_slot"), "left")
            rows = rows.withColumn("depth", F.when(F.col("_slot").isNotNull(), depth + 1).otherwise(F.col("depth"))).drop("_slot")
        return rows.withColumn(BUCKET, F.expr("CASE WHEN depth = 0 THEN 0L ELSE shiftleft(shiftrightunsigned(hash, 64 - depth), 64 - depth) END"))


def directory(heads: DataFrame, bucket_bytes: int) -> Directory:
    """The directory of distinct hashes ``(hash, size)``."""
    total = heads.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    first = max(0, math.ceil(math.log2(max(1, 2 * total / bucket_bytes))))
    live, splits = heads, []
    while True:  # a slot of 64 bits holds a single hash, so this ends
        depth = first + len(splits)
        load = live.groupBy(prefix(depth).alias("slot")).agg(F.sum("size").alias("bytes"), F.count("*").alias("hashes"))
        full = materialise(load.where((F.col("bytes") > bucket_bytes) & (F.col("hashes") > 1)).select("slot"))
        if full.isEmpty():
            return Directory(first, splits)
        splits.append(broadcast_if_small(full))
        live = heads.join(splits[-1], prefix(depth) == F.col("slot"), "left_semi")


def build_index(rows: DataFrame, facts: DataFrame, bucket_bytes: int, hot_rows: int) -> tuple[DataFrame, Directory]:
    """``(bucket, hash, chain, sha, size, keep_id, keep_points, group_size)``, written by the owners of the buckets, and the directory."""
    heads = materialise(facts.groupBy("hash").agg(F.max("size").alias("size"), F.count("*").alias("n")))
    slots = directory(heads, bucket_bytes)
    hot = materialise(heads.where((F.col("n") > hot_rows) | ((F.col("n") > 1) & (F.col("n") * F.col("size") > bucket_bytes))).select("hash"))
    texts, same = rows.select("hash", "norm", "points", "id"), ["hash", "norm", "points"]
    merge = [F.sum("n").alias("n"), F.min("id").alias("id")]
    entries = texts.withColumn("n", F.lit(1).cast("long"))
    if not hot.isEmpty():
        listed = broadcast_if_small(hot)
        entries = entries.join(listed, "hash", "left_anti").unionByName(entries.join(listed, "hash", "left_semi").groupBy(*same).agg(*merge))
    owned = slots.route(entries).repartition(BUCKET).groupBy(BUCKET, *same).agg(*merge)
    told = owned.select(BUCKET, "hash", F.sha2("norm", 256).alias("sha"), F.octet_length("norm").alias("size"), "points", "id", "n")
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("unnamed"), F.col("id")))
    groups = told.groupBy(BUCKET, "hash", "sha", "size").agg(best.alias("best"), F.sum("n").alias("group_size"))
    chain = F.row_number().over(Window.partitionBy(BUCKET, "hash").orderBy("sha", "size"))
    index = groups.select(BUCKET, "hash", chain.alias("chain"), "sha", "size", F.col("best.id").alias("keep_id"), (-F.col("best.points")).alias("keep_points"), "group_size")
    return materialise(index), slots


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``id_col, keep_id, group_size, kept, text_sha256, text_hash, depth, bucket, chain`` of every row; ``text_hash`` is xxhash64 of the text as it is."""
    rows = _rows(docs, id_col, text_col)
    facts = materialise(rows.select("id", "hash", F.sha2("norm", 256).alias("sha"), F.octet_length("norm").alias("size"), "points", "text_hash"))
    index, slots = build_index(rows, facts, bucket_bytes, hot_rows)
    found = slots.route(facts).join(index, [BUCKET, "hash", "sha", "size"])
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"), "text_hash", "depth", BUCKET, "chain")
