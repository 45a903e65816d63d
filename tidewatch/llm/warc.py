"""WARC archives of pages, and their capture index by an external merge of sorted runs.

*Archives.* Every row becomes one WARC/1.1 record. Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with
the smallest id is the response, the others are revisits without a payload that refer to it. Spark writes the records as
text files of about ``ARCHIVE_BYTES`` each into a folder that all executors share; nothing is written elsewhere.

*Index.* Reading goes by the lengths in the headers, so payloads may hold anything. Each archive gives a run of captures sorted
by URL key, time and id. The runs are dealt by ranges of that order, so a host or URL of any size is split over many
tasks; the task of a range merges its slices of the runs with a loser tree, and the ranges follow each other, which gives
every capture its place in the one global order.

Defined results: a null payload is empty; a null URL has the empty key; rows without an id are written with an empty one and
never serve as the response of others; rows that repeat the id of a response are responses too; an empty table gives
no archives and no captures; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans.store import materialise, shared_folder

REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20
#: Captures that one task merges.
RANGE_ROWS = 20_000
#: Time of the capture of id 0 where no time is given; each id is a second later.
FIRST_SECOND = 1_704_067_200
_END = "\r\n\r\n"
CAPTURE = "url_key string, ts string, id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long, intact boolean"


def _header(fields: Sequence[tuple[str, object]], payload: str, size: int) -> str:
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {size}"]) + _END + payload


def write_archives(pages: DataFrame, *, id_col: str, url_col: str, payload_col: str, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write the records and return the folder of the archives."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
    repeated = rows.where((F.col("size") >= revisit_bytes) & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # stored first, so the planner knows its size: it is broadcast if small, and payloads need no shuffle then
    rows = rows.join(materialise(repeated.select("digest", "first")), "digest", "left")
    rows = rows.select("id", "url", "payload", "digest", "size", "first", F.date_format(F.timestamp_seconds(F.lit(FIRST_SECOND) + F.coalesce("id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    schema = pa.schema([("value", pa.string()), ("archive", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            values, names = [], []
            for r in batch.to_pylist():
                revisit = r["first"] is not None and r["id"] != r["first"]
                name = "" if r["id"] is None else r["id"]
                fields = [
                    ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", r["date"]),
                    ("WARC-Target-URI", "".join(c for c in r["url"] if c > " ") if r["url"] is not None else None), ("WARC-Payload-Digest", f"sha256:{r['digest']}"), ("X-Payload-Length", r["size"]),
                    ("WARC-Refers-To", f"<urn:page:{r['first']}>" if revisit else None), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
                    ("Content-Type", "text/html; charset=utf-8"),
                ]
                size = 0 if revisit else r["size"]
                if held and held + size > archive_bytes:
                    number, held = number + 1, 0
                held += size + 500
                values.append(_header(fields, "" if revisit else r["payload"], size))
                names.append(f"{part:06d}-{number:05d}")
            yield pa.record_batch([pa.array(values, pa.string()), pa.array(names, pa.string())], schema=schema)

    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows.mapInArrow(run, "value string, archive string").write.partitionBy("archive").option("lineSep", _END).text(folder)
    return folder


def url_key(uri: str | None) -> str:
    """Host labels in reverse, then path and query: pages of a host sort together."""
    try:
        parts = urlsplit(uri or "")
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return (uri or "").lower()
    if not host:
        return uri or ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def records(data: bytes) -> Iterator[tuple[dict[str, str], int, int, int]]:
    """``(headers, start of the record, start of the payload, end of the payload)`` of each record of an archive."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        end = head + 4 + int(fields["Content-Length"])
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield fields, at, head + 4, end
        at = end + 4


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def order_of(row: dict) -> tuple:
    return row["url_key"], row["ts"], row["id"] is not None, row["id"] or 0


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of every archive as one sorted run each."""
    schema = pa.schema([
        ("url_key", pa.string()), ("ts", pa.string()), ("id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("intact", pa.bool_()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                data, rows = content.as_py(), []
                for f, start, begin, end in records(data):
                    revisit = f["WARC-Type"] == "revisit"
                    said = f["WARC-Payload-Digest"].removeprefix("sha256:")
                    digest = said if revisit else hashlib.sha256(memoryview(data)[begin:end]).hexdigest()
                    uri = f.get("WARC-Target-URI")
                    rows.append({
                        "url_key": url_key(uri), "ts": f["WARC-Date"], "id": _page(f["WARC-Record-ID"]), "uri": uri, "record_type": f["WARC-Type"], "payload_bytes": int(f["X-Payload-Length"]) if revisit else end - begin,
                        "payload_digest": digest, "refers_to": _page(f.get("WARC-Refers-To")), "archive": path.as_py(), "offset": start, "length": end + 4 - start, "intact": digest == said,
                    })
                yield pa.RecordBatch.from_pylist(sorted(rows, key=order_of), schema=schema)

    # a folder of archives without a file (of an empty table) has nothing that could be read
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(run, CAPTURE)


class LoserTree:
    """Merges sorted runs: the tree keeps the loser of every match, so a new head plays one match per level."""

    def __init__(self, runs: Sequence[Sequence], key):
        self.runs, self.key, self.at = runs, key, [0] * len(runs)
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.heads = [self._head(k) for k in range(self.size)]
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (b, a) if self.heads[b] < self.heads[a] else (a, b)
        self.winner = winners[1] if self.size > 1 else 0

    def _head(self, k: int) -> tuple:
        if k < len(self.runs) and self.at[k] < len(self.runs[k]):
            return (0, self.key(self.runs[k][self.at[k]]), k)
        return (1, (), k)

    def __iter__(self) -> Iterator:
        while self.heads[self.winner][0] == 0:
            k = self.winner
            yield self.runs[k][self.at[k]]
            self.at[k] += 1
            self.heads[k] = self._head(k)
            node = (k + self.size) // 2
            while node:
                if self.heads[self.losers[node]] < self.heads[k]:
                    self.losers[node], k = k, self.losers[node]
                node //= 2
            self.winner = k


def merge_runs(runs: DataFrame, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in one global order: ``order_no`` counts from 0 over all ranges, ``range_no`` names the range."""
    stored = materialise(runs)
    ranges = max(1, -(-stored.count() // range_rows))
    schema = pa.schema([*_arrow(stored), pa.field("range_no", pa.int32()), pa.field("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                slices.setdefault(row["archive"], []).append(row)
        # a shuffle may hand over the blocks of a run in any order; a slice in order costs one pass here
        own = [sorted(slices[name], key=order_of) for name in sorted(slices)]
        part, place, held = TaskContext.get().partitionId(), 0, []
        for row in LoserTree(own, order_of):
            held.append({**row, "range_no": part, "place": place})
            place += 1
            if len(held) == 10_000:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    merged = materialise(stored.repartitionByRange(ranges, "url_key", "ts", "id").mapInArrow(run, CAPTURE + ", range_no int, place long"))
    before, starts = 0, []
    for r in sorted(merged.groupBy("range_no").count().collect()):  # one row per range
        starts.append((r["range_no"], before))
        before += r["count"]
    first = merged.sparkSession.createDataFrame(starts, "range_no int, first long")
    return merged.join(first, "range_no").withColumn("order_no", F.col("first") + F.col("place")).drop("first", "place")


def _arrow(df: DataFrame) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(df.schema))


def capture_index(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Archive the rows, read the archives back and return their merged index."""
    spark = pages.sparkSession
    folder = write_archives(pages, id_col=id_col, url_col=url_col, payload_col=payload_col, archive_bytes=archive_bytes)
    return merge_runs(read_runs(spark, folder), range_rows=range_rows)
