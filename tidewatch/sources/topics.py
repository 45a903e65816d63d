"""JSON topics. The connector ships separately with Spark; encoding and decoding work on any frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_json(messages: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Message bytes to typed rows; undecodable messages come out as null fields with their text."""
    text = F.col(column).cast("string")
    parsed = messages.withColumn("_r", F.from_json(text, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}))
    return parsed.select(*[c for c in messages.columns if c != column], "_r.*")


def encode_json(rows: DataFrame, columns: list[str] | None = None, key: Column | None = None) -> DataFrame:
    """Rows to ``key, value``: compact JSON with sorted names. Keying by symbol keeps a symbol's messages in order."""
    names = sorted(columns or rows.columns)
    value = F.to_json(F.struct(*names)).alias("value")
    return rows.select((F.lit(None).cast("string") if key is None else key).alias("key"), value)


def kafka_json_source(spark: SparkSession, servers: str, topic: str, schema: str, *, max_offsets: int | None = None, streaming: bool = True) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return decode_json(reader.load().select("value", "timestamp"), schema)


def kafka_json_sink(rows: DataFrame, servers: str, topic: str, checkpoint: str, *, key: Column | None = None):
    """At-least-once stream into a topic; returns the unstarted writer."""
    return (
        encode_json(rows, key=key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("topic", topic).option("checkpointLocation", checkpoint)
    )
