"""WARC archives: writing captures, reading them back, assembling transactions.

Each page is written as three records, its response (or a revisit of an equal
payload), the request and the metadata; the latter two name the first in
``WARC-Concurrent-To``.  Records end with two line ends, the last byte of
which is the text writer's line separator, so Spark's own committed writer
makes the files.  They are read record by record by ``Content-Length``, and one
nested row a capture is assembled by joining through those names.

Of records with equal payloads of at least ``least`` bytes, that with the
smallest page_id is the response and the others revisit it.

Defined cases: null html is an empty payload; null urls give records without
a target; page_ids that repeat stay apart, and all rows of the smallest id
are responses; a null page_id is kept, and never referred to unless equal
payloads have no other; an empty table gives an empty archive and result;
other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bloom_flag, materialize, pick, scratch_path

LEAST = 100
#: Three records a capture; keeps archives to some megabytes.
RECORDS_A_FILE = 6000
#: Shares of the pages of one payload, where they meet the page that has it first.
SHARES = 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NL = "\r\n"

RECORDS = "record_id string, warc_type string, concurrent_to string, target_uri string, payload_digest string, refers_to_page long, fields map<string,string>, payload_bytes long, payload binary"


def captures(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: a response)."""
    body = F.coalesce("html", F.lit(""))
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"), F.sha2(F.encode(body, "UTF-8"), 256).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    # only digests, not payloads, are grouped; only pages of repeated digests are joined
    groups = rows.where(F.col("size") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1").select("digest", "first")
    groups = materialize(groups, "groups")
    flagged = bloom_flag(rows, "digest", groups.select("digest"), "hit")
    alone = flagged.where("NOT hit").select("page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("refers_to"))
    revisits = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    # a payload that many pages share is dealt out: its group's row is repeated once a share
    dealt = groups.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    shared = flagged.where("hit").withColumn("share", F.pmod(F.xxhash64("page_id", "url"), F.lit(SHARES)).cast("int")).join(dealt, ["digest", "share"], "left").select("page_id", "url", "payload", "digest", revisits.alias("refers_to"))
    return alone.union(shared)


def _uuid(kind: str) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.col("row"), F.col("page_id").cast("string"), F.col("digest")))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n, end in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, ">")) for x in (F.substring(h, a, n), F.lit(end))])


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(NL)), F.lit(""))


def _record(kind: Column, own: Column, content: str, block: Column, *headers: Column) -> Column:
    """A whole record but for its last byte, which the writer's line separator is."""
    return F.concat(
        F.lit("WARC/1.0" + NL), _header("WARC-Type", kind), _header("WARC-Record-ID", own), _header("WARC-Date", F.lit(DATE)), *headers,
        _header("Content-Type", F.lit(content)), _header("Content-Length", F.octet_length(block).cast("string")), F.lit(NL), block, F.lit(NL + "\r"),
    )


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Write the pages' archives; gzip, by Spark's text writer."""
    rows = captures(pages, least).withColumn("row", F.monotonically_increasing_id().cast("string"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    main, digest = _uuid("main"), F.concat(F.lit("sha256:"), F.col("digest"))
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=utf-8{NL}"), _header("Content-Length", F.octet_length("payload").cast("string")), F.lit(NL))
    target = _header("WARC-Target-URI", url)
    response = _record(
        F.when(revisit, "revisit").otherwise("response"), main, "application/http; msgtype=response", F.when(revisit, head).otherwise(F.concat(head, F.col("payload"))), target,
        _header("WARC-Payload-Digest", digest), _header("WARC-Profile", F.when(revisit, PROFILE)), _header("WARC-Refers-To-Date", F.when(revisit, DATE)), _header("X-Refers-To-Page", F.col("refers_to").cast("string")),
    )
    where = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]+://([^/?#]*)([^#]*)", 1)
    what = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]+://([^/?#]*)([^#]*)", 2)
    request = _record(F.lit("request"), _uuid("request"), "application/http; msgtype=request", F.concat(F.lit("GET "), F.when(what == "", "/").otherwise(what), F.lit(f" HTTP/1.1{NL}Host: "), where, F.lit(NL + NL)), target, _header("WARC-Concurrent-To", main))
    metadata = _record(F.lit("metadata"), _uuid("metadata"), "application/warc-fields", F.concat(_header("page_id", F.col("page_id").cast("string")), F.lit(NL)), target, _header("WARC-Concurrent-To", main))
    text = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    text.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def parse(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record, one in memory at a time; raises on what is no WARC."""
    while line := archive.readline():
        if not line.strip(b"\r\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:20]!r}")
        headers = {}
        while line := archive.readline().rstrip(b"\r\n"):
            name, _, value = line.partition(b":")
            headers[name.decode().strip().lower()] = value.decode("utf-8", "replace").strip()
        size = int(headers["content-length"])
        block = archive.read(size)
        if len(block) < size:
            raise ValueError("a record is cut off")
        yield headers, block


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> dict:
    kind = headers.get("warc-type")
    row = dict.fromkeys(("record_id", "warc_type", "concurrent_to", "target_uri", "payload_digest", "refers_to_page", "fields", "payload_bytes", "payload"))
    row |= {"record_id": headers.get("warc-record-id"), "warc_type": kind, "concurrent_to": headers.get("warc-concurrent-to"), "target_uri": headers.get("warc-target-uri")}
    if kind == "metadata":
        row["fields"] = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(NL)) if k.strip()]
    elif kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        row |= {"payload_digest": hashlib.sha256(payload).hexdigest(), "payload_bytes": len(payload), "payload": payload if payloads else None}
        named = headers.get("warc-payload-digest", "")
        if named.startswith("sha256:") and named[7:] != row["payload_digest"]:
            raise ValueError(f"{row['record_id']}: the payload's digest differs")
    elif kind == "revisit":
        row |= {"payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha256:"), "refers_to_page": int(headers["x-refers-to-page"]) if "x-refers-to-page" in headers else None}
    elif kind == "request":
        row["payload"] = block if payloads else None
    return row


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path``, with or without payloads."""
    schema = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to_page", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                archive: BinaryIO = io.BytesIO(data)
                if data[:2] == b"\x1f\x8b":
                    archive = io.BufferedReader(gzip.GzipFile(fileobj=archive), 1 << 20)
                rows = []
                for headers, block in parse(archive):
                    rows.append(_row(headers, block, payloads))
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: response, request, metadata (the latter two null where missing)."""
    columns = [F.col(c) for c in records.columns]
    main = records.where("warc_type IN ('response', 'revisit')").select(F.col("record_id").alias("id"), F.struct(*columns).alias("response"))
    request = records.where("warc_type = 'request'").select(F.col("concurrent_to").alias("id"), F.struct(*columns).alias("request"))
    metadata = records.where("warc_type = 'metadata'").select(F.col("concurrent_to").alias("id"), F.struct(*columns).alias("metadata"))
    return main.join(request, "id", "left").join(metadata, "id", "left").select("response", "request", "metadata")


def round_trip(pages: DataFrame, path: str | None = None, least: int = LEAST) -> DataFrame:
    """Write the pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write(pages, path, least)
    records = materialize(read(spark, path, payloads=False).drop("payload"), "records")
    whole = assemble(records).select(
        F.col("metadata.fields")["page_id"].cast("long").alias("page_id"), F.col("response.payload_bytes").alias("own_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.warc_type").alias("record_type"), F.col("response.refers_to_page").alias("refers_to")
    )
    revisits = whole.where("record_type = 'revisit'")
    digests = revisits.select(F.col("payload_digest").alias("d")).distinct()
    sizes = records.where("warc_type = 'response'").join(digests, F.col("payload_digest") == F.col("d"), "left_semi").groupBy(F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("full_bytes"))
    out = whole.where("record_type = 'response'").withColumn("full_bytes", F.col("own_bytes")).unionByName(revisits.join(sizes, F.col("payload_digest") == F.col("d"), "left").drop("d"))
    return out.select("page_id", F.col("full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
