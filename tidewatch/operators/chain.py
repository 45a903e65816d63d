"""Hash-chained logs: building segments, verifying them in parallel, rotation and retention."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.scalar import canonical_json, micros
from tidewatch.plans.layout import Layout
from tidewatch.plans.scans import Scan, following, index_rows, previous, running
from tidewatch.plans.store import materialise, nullable

GENESIS = "0" * 64


def entry_text(previous_hash: Column | None = None) -> Column:
    """Canonical text of a tick entry; prices and scores as millionths so that every engine writes the same digits."""
    fields = {
        "symbol": F.col("symbol"), "primary_exchange": F.col("primary_exchange"), "primary_mid_price": micros("primary_mid_price"),
        "consensus_mid": micros("consensus_mid"), "used_sources": F.col("used_sources"), "divergent_sources": F.col("divergent_sources"),
        "trust_score": micros("trust_score"), "received_timestamp_ms": F.col("ts_ms"),
    }
    if previous_hash is not None:
        fields["previous_hash"] = previous_hash
    return canonical_json(**fields)


def tick_hash(previous_hash: Column) -> Column:
    return F.sha2(F.concat_ws("|", previous_hash, entry_text()), 256)


def audit_hash(df: DataFrame, leave_out: tuple[str, ...] = ("current_hash",)) -> Column:
    """Hash of every field but the hash itself."""
    return F.sha2(canonical_json(**{c: F.col(c) for c in df.columns if c not in leave_out}), 256)


PIECES = 1_000_000  # segment numbers kept free for the pieces of one time bucket


def cut_segments(entries: DataFrame, layout: Layout, *, segment_ms: int = 86_400_000, segment_rows: int = 100_000, bucket: Column | None = None) -> DataFrame:
    """Add ``segment``: the bucket (of time, or the one given) times ``PIECES`` plus the piece of ``segment_rows`` entries inside it."""
    rows = entries.withColumn("_bucket", (F.floor(F.col(layout.ts) / segment_ms) if bucket is None else bucket).cast("long"))
    rows = index_rows(rows, layout.with_(keys=(*layout.keys, "_bucket")), "_n")
    piece = F.floor((F.col("_n") - 1) / F.lit(segment_rows)).cast("long")
    return rows.withColumn("segment", F.col("_bucket") * PIECES + piece).drop("_bucket", "_n")


def segment_digests(rows: DataFrame, layout: Layout, text: Column) -> DataFrame:
    """One row per segment: its number of entries and the hash of their texts in order. A segment is bounded, so a task holds it."""
    keys = [*layout.keys, "segment"]
    order = [(c, "ascending") for c in layout.order]
    schema = nullable(T.StructType([*[rows.schema[c] for c in keys], T.StructField("entries", T.LongType()), T.StructField("digest", T.StringType())]))

    def digest(table: pa.Table) -> pa.Table:
        body = hashlib.sha256()
        for line in table.sort_by(order)["_text"].to_pylist():
            body.update(f"{line}\n".encode())
        return table.select(keys).slice(0, 1).append_column("entries", pa.array([table.num_rows], pa.int64())).append_column("digest", pa.array([body.hexdigest()]))

    return rows.select(*keys, *layout.order, text.alias("_text")).groupBy(*keys).applyInArrow(digest, schema)


def next_header(header: Column, digest: Column) -> Column:
    """Header of the segment after one with this header and digest."""
    return F.sha2(F.concat_ws("|", header, digest), 256)


def segment_headers(digests: DataFrame, layout: Layout, start: DataFrame | None = None) -> DataFrame:
    """Add ``header`` and ``tip``: a running hash over the digests of each key, from its row in ``start`` (keys, ``head``) or the genesis hash.

    The only sequential step of a chain. It sees one short row per segment, in order, and keeps a single hash per task.
    """
    keys = list(layout.keys)
    rows = digests.withColumn("head", F.lit(GENESIS)) if start is None else digests.join(start.select(*keys, "head"), keys, "left").fillna(GENESIS, ["head"])
    names = [*keys, "segment", "entries", "digest"]
    schema = nullable(T.StructType([*[rows.schema[c] for c in names], *[T.StructField(n, T.StringType()) for n in ("header", "tip")]]))

    def link(batches):
        last, tip = None, None
        for batch in batches:
            headers, tips = [], []
            ids = list(zip(*[batch.column(c).to_pylist() for c in keys])) if keys else [()] * batch.num_rows
            for key, head, digest in zip(ids, batch.column("head").to_pylist(), batch.column("digest").to_pylist()):
                if key != last:
                    last, tip = key, head
                headers.append(tip)
                tip = hashlib.sha256(f"{tip}|{digest}".encode()).hexdigest()
                tips.append(tip)
            out = batch.select(names)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(headers, pa.string()), pa.array(tips, pa.string())], names=[*names, "header", "tip"])

    ordered = (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*keys, "segment")
    return ordered.mapInArrow(link, schema)


def chain_segments(rows: DataFrame, headers: DataFrame, layout: Layout, text: Column) -> DataFrame:
    """Chain the entries of every segment from its header, all segments at once."""
    keys = [*layout.keys, "segment"]
    work = rows.withColumn("_text", text)
    kept = rows.columns
    schema = nullable(T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(n, T.StringType()) for n in ("previous_hash", "current_hash")]]))
    order = [(c, "ascending") for c in layout.order]

    def chain(table: pa.Table, head: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        tip, before, after = (head["header"][0].as_py() if head.num_rows else None), [], []
        for body in table["_text"].to_pylist():
            before.append(tip)
            tip = hashlib.sha256(f"{tip}|{body}".encode()).hexdigest()
            after.append(tip)
        return table.select(kept).append_column("previous_hash", pa.array(before, pa.string())).append_column("current_hash", pa.array(after, pa.string()))

    return work.groupBy(*keys).cogroup(headers.select(*keys, "header").groupBy(*keys)).applyInArrow(chain, schema)


def build_chain(entries: DataFrame, layout: Layout, text: Column, *, segment_ms: int = 86_400_000, segment_rows: int = 100_000,
                bucket: Column | None = None, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(chained entries, segments)``: every entry hashes its predecessor's hash and its own text; every segment starts from its header.

    A hash chain is sequential by nature, so it has two levels. Segments (a time bucket, or ``segment_rows`` entries of it) are
    hashed on their own; a running hash over these digests gives each its header (:func:`segment_headers`); then all segments are
    chained at once from their headers. A header depends on every entry before it, so a segment that is changed or taken away
    breaks the next one. Order must be unique per key and never null; no entries give no segments.
    """
    rows = materialise(cut_segments(entries, layout, segment_ms=segment_ms, segment_rows=segment_rows, bucket=bucket))
    segments = materialise(segment_headers(segment_digests(rows, layout, text), layout, start))
    return chain_segments(rows, segments, layout, text), segments


def chain_ok(chained: DataFrame, layout: Layout, segments: DataFrame) -> DataFrame:
    """Whether each entry's previous hash is its predecessor's hash, or the header for the first of a segment. ``layout`` has the segment as a key."""
    out = previous(chained, layout, _tip="current_hash").join(segments.select(*layout.keys, "header"), list(layout.keys), "left")
    return out.withColumn("chain_ok", F.coalesce(F.col("previous_hash") == F.coalesce("_tip", "header"), F.lit(False))).drop("_tip", "header")


def check_chain(chained: DataFrame, layout: Layout, text: Column) -> DataFrame:
    """Add ``problem`` per entry: missing field, broken link or hash mismatch. The first previous hash is trusted.

    Every hash is recomputed from its own row and compared with its neighbour only, so the check is fully parallel.
    """
    out = previous(chained, layout, _tip="current_hash")
    problem = (
        F.when(F.col("previous_hash").isNull() | F.col("current_hash").isNull(), "missing_field")
        .when(F.col("_tip").isNotNull() & (F.col("_tip") != F.col("previous_hash")), "broken_link")
        .when(F.sha2(F.concat_ws("|", "previous_hash", text), 256) != F.col("current_hash"), "hash_mismatch")
    )
    return out.withColumn("problem", problem).drop("_tip")


def verify_chain(chained: DataFrame, layout: Layout, text: Column) -> DataFrame:
    """Per chain: number of entries and its first bad one."""
    rank = F.struct(*layout.order)
    bad = F.col("problem").isNotNull()
    return check_chain(chained, layout, text).groupBy(*layout.keys).agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(bad).alias("bad_entries"),
        F.min_by("problem", F.when(bad, rank)).alias("first_problem"), F.min(F.when(bad, rank))[layout.order[-1]].alias("first_bad"))


def verify_recent(chained: DataFrame, layout: Layout, text: Column, *, last: int = 1000) -> DataFrame:
    """The same over the last entries of each chain only."""
    numbered = index_rows(chained, layout, "_n")
    totals = numbered.groupBy(*layout.keys).agg(F.max("_n").alias("_all"))
    recent = numbered.join(totals, list(layout.keys)).where(F.col("_n") > F.col("_all") - last).drop("_n", "_all")
    return verify_chain(recent, layout, text)


def segment_links(chained: DataFrame, layout: Layout, text: Column, *, start: str | None = GENESIS) -> DataFrame:
    """One row per segment: first and last hash, the header it starts from, and whether that follows from the segment before it.

    Each link is checked on its own: the stored header must be the hash of the stored header and the recomputed digest of the
    segment before. ``start`` is what the first segment of a key must start from; None trusts it, as after retention. What was
    taken off the end is seen only against a tip that was kept elsewhere.
    """
    rank = F.struct(*layout.order)
    tips = chained.groupBy(*layout.keys, "segment").agg(
        F.min_by("current_hash", rank).alias("first_hash"), F.max_by("current_hash", rank).alias("last_hash"), F.min_by("previous_hash", rank).alias("header"))
    tips = tips.join(segment_digests(chained, layout, text).drop("entries"), [*layout.keys, "segment"])
    # A slot holds the pieces of a thousand buckets at most.
    linked = previous(tips, layout.with_(order=("segment",), slot_ms=1000 * PIECES), previous_tip="last_hash", _header="header", _digest="digest")
    wanted = F.when(F.col("_digest").isNotNull(), next_header(F.col("_header"), F.col("_digest"))).otherwise(F.lit(start) if start else F.col("header"))
    return linked.withColumn("linked", F.coalesce(F.col("header") == wanted, F.lit(False))).drop("_header", "_digest", "digest")


def verify_segments(chained: DataFrame, layout: Layout, text: Column, *, start: str | None = GENESIS) -> DataFrame:
    """Verdict per segment (file) and its link to the segment before: a segment that was taken away leaves the next one unlinked."""
    inner = layout.with_(keys=(*layout.keys, "segment"))
    verdict = verify_chain(chained, inner, text).join(segment_links(chained, layout, text, start=start), list(inner.keys))
    return verdict.withColumn("passed", (F.col("bad_entries") == 0) & F.col("linked"))


def segment_by_size(entries: DataFrame, layout: Layout, text: Column, *, limit: int = 100 * 1024 * 1024) -> DataFrame:
    """Rotation number of each entry: bytes written before it, divided by the size limit."""
    sized = entries.withColumn("bytes", F.octet_length(text))
    out = running(sized, layout, _before=Scan("sum", F.col("bytes"), exclusive=True))
    return out.withColumn("rotation", F.floor(F.coalesce("_before", F.lit(0)) / F.lit(limit)).cast("long")).drop("_before")


def rotation_markers(rotated: DataFrame, layout: Layout) -> DataFrame:
    """Open and close marker of every rotation, linked by a hash of what the previous one held."""
    rank = F.struct(*layout.order)
    parts = rotated.groupBy(*layout.keys, "rotation").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("bytes").alias("bytes"), F.min(rank)[layout.ts].alias("opened_ms"), F.max(rank)[layout.ts].alias("closed_ms"))
    parts = parts.withColumn("_id", F.sha2(F.concat_ws("|", *layout.keys, "rotation", "entries", "bytes"), 256))
    linked = following(previous(parts, layout.with_(order=("rotation",), slot_ms=4096), previous_hash="_id"), layout.with_(order=("rotation",), slot_ms=4096), _next="rotation")
    both = F.explode(F.array(
        F.struct(F.lit("open").alias("marker"), F.col("opened_ms").alias("ts_ms"), F.coalesce("previous_hash", F.lit(GENESIS)).alias("hash")),
        F.struct(F.lit("close").alias("marker"), F.when(F.col("_next").isNotNull(), F.col("closed_ms")).alias("ts_ms"), F.col("_id").alias("hash"))))
    return linked.select(*layout.keys, "rotation", "entries", both.alias("m")).select(*layout.keys, "rotation", "entries", "m.*").where(F.col("ts_ms").isNotNull())


def retention(segments: DataFrame, now_ms: int | Column, *, ts: str = "ts_ms", days: int = 7) -> DataFrame:
    """Keep what is young enough: a filter that prunes partitions written by date."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return segments.where(F.col(ts) >= now - days * 86_400_000)


AUDIT_SCHEMA = "event_type string, source string, timestamp_ms long, payload struct<trust_score: double, anomaly_score: double, system_state: string, symbol: string>"


def audit_enrich(messages: DataFrame, column: str = "value") -> DataFrame:
    """Audit envelope (JSON) to entry fields, with defaults for what the payload leaves out."""
    from tidewatch.functions.scalar import source_layer

    e = F.from_json(F.col(column), AUDIT_SCHEMA)
    rows = messages.withColumn("_e", e)
    return rows.select(
        *[c for c in messages.columns if c != column], F.col("_e.event_type"), source_layer("_e.source").alias("source_layer"),
        F.col("_e.timestamp_ms").alias("ts_ms"), F.coalesce("_e.payload.trust_score", F.lit(1.0)).alias("trust_score"),
        F.coalesce("_e.payload.anomaly_score", F.lit(0.0)).alias("anomaly_score"), F.coalesce("_e.payload.system_state", F.lit("NORMAL")).alias("system_state"))
