"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Stages that judge a row by itself filter in place. Stages that compare rows return the rows to drop by id and text hash, which are
taken out by an anti-join; no row is told by its id alone, so null and repeated ids are safe. Of rows that repeat both id and
text one stays in the two stages that remove copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import toxicity as tox
from tidewatch.llm.decontaminate import without_items
from tidewatch.llm.exact import exact_duplicates
from tidewatch.llm.jaccard import near_duplicates
from tidewatch.llm.memory import small_batches
from tidewatch.llm.packing import pack
from tidewatch.plans.store import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Training, compression and similarity have no SQL form; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def _without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """``docs`` without the rows judged ``drop``, and with one row of those judged to stay that repeat id and text."""
    judged = materialise(judged.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "drop"))
    same = docs["doc_id"].eqNullSafe(judged["_id"]) & (F.xxhash64(docs["text"]) == judged["_hash"])
    stay = docs.join(judged.where("drop"), same, "left_anti")
    repeated = materialise(judged.where("not drop").groupBy("_id", "_hash").count().where("count > 1").select("_id", "_hash"))
    if repeated.isEmpty():
        return stay
    same = stay["doc_id"].eqNullSafe(repeated["_id"]) & (F.xxhash64(stay["text"]) == repeated["_hash"])
    return stay.join(repeated, same, "left_anti").unionByName(stay.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't call toxic."""
    model = tox.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return tox.without_toxic(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _without(docs, exact_duplicates(docs).select("doc_id", "text_hash", (~F.col("kept")).alias("drop")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of similar texts; texts without words all stay."""
    classes, _ = near_duplicates(docs)
    classes = materialise(classes.select("doc_id", "text_hash", "root").where("root IS NOT NULL"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    best = classes.groupBy("root").agg(first.alias("best"))
    drop = ~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash")))
    return _without(docs, classes.join(best, "root").select("doc_id", "text_hash", drop.alias("drop")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup), ("benchmark decontamination", decontamination), ("best-fit packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
