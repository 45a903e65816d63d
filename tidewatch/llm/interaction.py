"""Audit of how filters interact, by a stream that retracts what later files disprove.

A document's failures are bits of a mask. All but one depend on its text alone; the last one, "a smaller id has the same text",
may change whenever a file arrives. The files are taken as available-now micro-batches. State is a table keyed by the digest of a text: the smallest id
seen so far and what its rows add to the counters. A batch first counts all its rows as copies, then gives the smallest
of each text back its clean mask if no earlier batch knows a smaller or equal id. If an earlier batch knows the text with a
larger id, the rows counted there as first are retracted and counted again as copies. Counters per part, mask and label
are sums of such deltas, so any order of files and any cut into batches gives the same counters, and from at most
2**filters masks per part follow the results of every order of the filters.

A batch writes its state and its deltas into folders of its own, which a repeated batch replaces, and reads only the state of earlier
batches; a lost executor or a restarted query changes nothing. Copies of one text are combined before they are shuffled.

Defined results: null text counts as empty; a null part is the empty string; rows with a null id are no one's copy and make no
copies; repeated rows with the same id and text are not copies of each other; a document that repeats in ``labels`` has a label
if any of its rows does; an empty table gives no rows; other columns are not read. Texts of any length are judged whole; equality is that of
their SHA-256 digests.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans.store import broadcast_if_small, materialise, run_folder

#: At most so many micro-batches, however many files there are.
BATCHES = 4
#: Values that rows with a null id are dealt out over in the join with labels.
_SPREAD = 1_000
#: Marks the filter "a smaller id has the same text".
COPY = None

_STATE = "key binary, id long, mask int, cells array<struct<part:string,good:int,toxic:int,n:bigint>>"
_DELTAS = "part string, mask int, good int, toxic int, n long"


def default_filters() -> dict[str, Column | None]:
    """The five filters: short, repetitive, shouting, holding symbols, copied."""
    text = F.coalesce("text", F.lit(""))
    words = F.col("_words")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
        "E": COPY,
    }


def _facts(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column | None], part_col: str) -> DataFrame:
    """One narrow row per document: digest of the text, id, part, mask without the copy bit, and the labels."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters.values()) if c is not COPY), F.lit(0))
    rows = docs.select("doc_id", "text", part_col).withColumn("_words", words)
    rows = rows.select(
        F.unhex(F.sha2(text, 256)).alias("key"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"))
    rows = rows.withColumn("_salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("key"), F.lit(_SPREAD)) + 1).otherwise(0))
    marks = labels.select("id", "good", "toxic", F.lit(0).cast("long").alias("_salt"))
    joined = rows.join(marks, ["id", "_salt"], "left")
    zero = F.lit(0)
    return joined.select("key", "id", "part", "mask", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"), F.lit(1).cast("long").alias("n"))


def _marks(labels: DataFrame) -> DataFrame:
    """``(id, good, toxic)``, one row per labelled id."""
    rows = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.expr("int(quality <=> 1)").alias("good"), F.expr("int(toxic <=> 1)").alias("toxic"))
    return rows.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))


def _firsts(rows: DataFrame) -> DataFrame:
    """The smallest id of each text and its rows, counted by part and labels: partial sums, then partial minima."""
    cells = rows.groupBy("key", "id", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"))
    per_id = cells.groupBy("key", "id", "mask").agg(F.array_sort(F.collect_list(F.struct("part", "good", "toxic", "n"))).alias("cells"))
    least = per_id.groupBy("key").agg(F.min(F.struct("id", "mask", "cells")).alias("least"))
    return least.select("key", "least.*")


def _deltas(rows: DataFrame, copy: int, sign: int) -> DataFrame:
    """The rows of ``cells`` that stop (-1) or start (1) being counted as copies."""
    cells = rows.select("mask", F.explode("cells").alias("c"))
    flip = lambda mask, n: cells.select("c.part", mask.alias("mask"), "c.good", "c.toxic", (F.col("c.n") * n).alias("n"))
    return flip(F.col("mask").bitwiseOR(copy), sign).unionByName(flip(F.col("mask"), -sign))


def counters(
    spark: SparkSession, path: str, labels: DataFrame, filters: Mapping[str, Column | None] | None = None, *,
    part_col: str = "lang", files_per_batch: int | None = None,
) -> DataFrame:
    """``(part, mask, good, toxic, n)`` over all files at ``path``, counted by the stream. Bit i of a mask is the i-th filter."""
    filters = filters or default_filters()
    copy = next((1 << i for i, c in enumerate(filters.values()) if c is COPY), 0)
    base = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    for name, schema in (("state", _STATE), ("deltas", _DELTAS)):
        spark.createDataFrame([], schema).write.parquet(f"{base}/{name}/batch=-1")
    marks = broadcast_if_small(materialise(_marks(labels)), 200_000)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files_per_batch is None:
        files_per_batch = max(1, -(-store.getContentSummary(place).getFileCount() // BATCHES))
    # A stream reads folders or patterns, so a table of a single file is named by a pattern that only it meets.
    files = path if store.getFileStatus(place).isDirectory() else f"{path[:-1]}[{path[-1]}]"

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession

        def stored(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch_id}")
            return session.read.schema(df.schema).parquet(f"{base}/{name}/batch={batch_id}")

        rows = stored(_facts(batch, marks, filters, part_col), "rows")
        named = rows.where("id IS NOT NULL")
        firsts = _firsts(named)
        history = session.read.schema(f"{_STATE}, batch int").parquet(f"{base}/state").where(F.col("batch") < batch_id)
        known = history.groupBy("key").agg(F.max(F.struct("batch", "id", "cells")).alias("k")).select("key", F.col("k.id").alias("old_id"), F.col("k.cells").alias("old"))
        met = stored(firsts.join(known, "key", "left"), "met")
        fresh = met.where("old_id IS NULL OR id <= old_id")
        cells = F.when(F.col("id") == F.col("old_id"), F.concat("old", "cells")).otherwise(F.col("cells"))
        stored(fresh.select("key", "id", "mask", cells.alias("cells")), "state")
        beaten = met.where("id < old_id").select("mask", F.col("old").alias("cells"))
        as_copies = named.select("part", F.col("mask").bitwiseOR(copy).alias("mask"), "good", "toxic", "n")
        unnamed = rows.where("id IS NULL").select("part", "mask", "good", "toxic", "n")
        changes = as_copies.unionByName(unnamed).unionByName(_deltas(fresh, copy, -1)).unionByName(_deltas(beaten, copy, 1))
        stored(changes.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")), "deltas")

    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(files)
    writer = source.select("doc_id", "text", part_col).writeStream.foreachBatch(handle)
    writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    deltas = spark.read.schema(f"{_DELTAS}, batch int").parquet(f"{base}/deltas")
    return deltas.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def steps(names: str) -> list[dict]:
    """Every order of the filters, step by step: the filter's bit and the bits of those before it."""
    bit = {f: 1 << i for i, f in enumerate(names)}
    return [
        {"filter_order": "".join(order), "step": i + 1, "bit": bit[f], "before": sum(bit[x] for x in order[:i])}
        for order in itertools.permutations(names) for i, f in enumerate(order)]


def interactions(counts: DataFrame, names: str = "ABCDE") -> DataFrame:
    """Per part, order and step: documents kept, removed, redundant, failing this filter only, good and toxic lost, Shapley share.

    A part has at most 2**filters masks, so its counters are one short array. A filter's share sums what it removes over all orders: of n! orders
    a document with m failures meets this filter first among them in n!/m.
    """
    orders = len(steps(names)) // len(names)
    one = F.struct("mask", "n", "good", "toxic")
    masks = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    plan = F.from_json(F.lit(json.dumps(steps(names))), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    rows = masks.groupBy("part").agg(F.collect_list(one).alias("cells")).select("part", "cells", F.explode(plan).alias("s")).select("part", "cells", "s.*")
    bit, before = F.col("bit"), F.col("before")

    def total(when, value=lambda c: c["n"]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(when(c["mask"]), value(c)).otherwise(F.lit(0).cast("long")))

    fails = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    removed = lambda m: fails(m) & ~gone(m)
    return rows.select(
        "part", "filter_order", "step", total(lambda m: ~fails(m) & ~gone(m)).alias("kept"), total(removed).alias("removed"),
        total(lambda m: fails(m) & gone(m)).alias("redundant"), total(lambda m: m == bit).alias("unique_fails"), total(removed, lambda c: c["good"]).alias("good_lost"),
        total(removed, lambda c: c["toxic"]).alias("toxic_lost"), total(fails, lambda c: (c["n"] * orders / F.bit_count(c["mask"])).cast("long")).alias("shapley"))


def filter_audit(spark: SparkSession, path: str, labels: DataFrame, **options) -> DataFrame:
    """The audit of the default filters over all files at ``path``."""
    return interactions(counters(spark, path, labels, **options))
