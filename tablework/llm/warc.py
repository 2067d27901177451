"""WARC archives: writing with revisits, reading, transaction assembly (operator 10).

``write_archives`` writes a request, a response or revisit and a metadata
record for each page.  Of pages with equal payloads (of ``min_bytes`` or
more) the one with the largest page_id is the response, the others are
revisits that refer to it.  ``read_records`` parses archives by their
Content-Length fields; ``assemble`` joins the three records of a capture
through WARC-Concurrent-To and gives one nested row per capture.

Payloads move once, by page_id.  Equal payloads are found on (digest,
page_id) rows: grouped maxima are combined before the shuffle, and the join
back is against payloads that occur more than once.  Files hold at most
``CAPTURES`` captures, so that a reader holds one bounded file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm.store import materialise, prepare, table
from tablework.session import shared_dir

CAPTURES = 5_000             # captures of a file at most
FILE_BYTES = 256 << 20       # payload bytes of a file at most (of one capture, if that is larger)
DATE = "2024-01-01T00:00:00Z"  # the pages have no capture time
_END = "\r\n\r\n"
_RECORD = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()),
    ("refers_to_id", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
    ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
RECORD_DDL = ("record_id string, record_type string, concurrent_to string, target_uri string, refers_to_id string, "
              "payload_digest string, payload_bytes long, fields map<string,string>, payload binary")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, sha1: str, copy: int, part: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}|{sha1}|{copy}|{part}'.encode()).hexdigest())}>"


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def _record(kind: str, fields: list[tuple[str, str]], block: str) -> str:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {_clean(v)}" for k, v in fields), f"Content-Length: {len(block.encode())}"]
    return "WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n" + block


def capture(page_id, url: str | None, html: str | None, copy: int, head) -> list[str]:
    """The records of one page; ``head`` is the page_id it revisits or None."""
    body = html or ""
    raw = body.encode()
    sha1 = digest(raw)
    uri = url or ""
    name = page_id if page_id is not None else f"null {uri}"
    main = record_id(name, sha1, copy, "response")
    base = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    host, path = (uri.split("://", 1)[-1].split("/", 1) + [""])[:2]
    request = _record("request", [("WARC-Record-ID", record_id(name, sha1, copy, "request")), ("WARC-Concurrent-To", main), *base,
                                  ("Content-Type", "application/http; msgtype=request")],
                      f"GET /{_clean(path)} HTTP/1.1\r\nHost: {_clean(host)}\r\n\r\n")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(raw)}\r\n\r\n"
    told = [("WARC-Record-ID", main), *base, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1}")]
    if head is None:
        answer = _record("response", told, http + body)
    else:
        answer = _record("revisit", told + [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(head, sha1, 0, "response"))], http)
    note = {"pageId": page_id, "payloadLength": len(raw), "hasUrl": int(url is not None), "refersToPage": head}
    metadata = _record("metadata", [("WARC-Record-ID", record_id(name, sha1, copy, "metadata")), ("WARC-Concurrent-To", main), *base,
                                    ("Content-Type", "application/warc-fields")],
                       "".join(f"{k}: {v}\r\n" for k, v in note.items() if v is not None))
    return [request, answer, metadata]


def _render(batches) -> Iterator[pa.RecordBatch]:
    copies: dict = {}
    last = None
    yield pa.RecordBatch.from_arrays([pa.array([_record("warcinfo", [
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")],
        "format: WARC File Format 1.1\r\n")])], names=["value"])
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["key"] != last:  # rows of a key are next to each other
                copies, last = {}, r["key"]
            head = dict(r["heads"] or []).get(r["hex"])
            same = (r["url"], r["hex"]) if r["page_id"] is None else r["hex"]
            n = copies[same] = copies.get(same, -1) + 1
            out += capture(r["page_id"], r["url"], r["html"], n, head if head != r["page_id"] else None)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """pages(page_id, url, html) -> gzip WARC files below ``path``.  Null html
    is an empty payload and a null url an empty target.  Rows repeating the
    response's page_id and payload are responses too; a null page_id is never
    referred to (it revisits an equal payload that has an id)."""
    spark = pages.sparkSession
    prepare(spark, 200)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
    body = F.coalesce("html", F.lit(""))
    pages = pages.withColumn("hex", F.sha1(body))
    # rows that need one place: those of a page, or those of a payload without page_id
    key = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("n"), "hex"))
    sizes = pages.where(F.octet_length(body) >= min_bytes).select("page_id", "hex", key.alias("key"))
    heads = materialise(sizes.groupBy("hex").agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
                        .where("n > 1 and head is not null").select("hex", "head"), "heads")
    # a page's revisits by payload: one for each row but repeated page_ids
    again = sizes.join(heads, "hex").where("not page_id <=> head").select("key", "hex", "head").distinct() \
        .groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("hex", "head"))).alias("heads"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    captures = max(1, min(CAPTURES, FILE_BYTES // max(largest, 1)))
    # payloads are shuffled once: the join keeps the partitions by key
    pages.withColumn("key", key).repartition(parts, "key").join(again, "key", "left").sortWithinPartitions("key") \
        .mapInArrow(_render, "value string") \
        .write.mode("overwrite").option("lineSep", _END).option("maxRecordsPerFile", 3 * captures).option("compression", "gzip").text(path)


def parse(raw: bytes) -> Iterator[dict]:
    """Records of one archive (gzip or plain).  A record that breaks off ends it."""
    f = gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
    while True:
        line = f.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue  # the empty lines between records
        fields: dict[str, str] = {}
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        n = int(fields.get("content-length", 0))
        block = f.read(n)
        if len(block) < n:
            return
        yield {"fields": fields, "block": block}


def _parsed(batches, payloads: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column(0):
            rows = []
            for r in parse(raw.as_py()):
                f, block = r["fields"], r["block"]
                kind = f.get("warc-type")
                note, body, sha1 = {}, block, None
                if kind in ("response", "revisit", "request"):
                    body = block.partition(b"\r\n\r\n")[2]
                if kind == "response":
                    sha1 = digest(body)
                elif kind == "revisit":
                    sha1 = f.get("warc-payload-digest", "").removeprefix("sha1:")
                elif kind == "metadata":
                    note = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines()) if k}
                rows.append({"record_id": f.get("warc-record-id"), "record_type": kind, "concurrent_to": f.get("warc-concurrent-to"),
                             "target_uri": f.get("warc-target-uri"), "refers_to_id": f.get("warc-refers-to"), "payload_digest": sha1,
                             "payload_bytes": len(body), "fields": list({**f, **note}.items()), "payload": body if payloads else None})
                if len(rows) == 200:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _RECORD)


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives below ``path`` (RECORD_DDL).  A
    response's digest is of the payload as read; a revisit's is the declared one."""
    prepare(spark, 1)  # a batch is one file
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(lambda it: _parsed(it, payloads), RECORD_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit with its record, its request and its
    metadata as structs (null where there is none); several requests or
    metadata records of one capture give a row each."""
    nested = ["record_id", "target_uri", "refers_to_id", "payload_digest", "payload_bytes", "fields", "payload"]

    def side(kind: str) -> DataFrame:
        return records.where(F.col("record_type") == kind).select(
            F.col("concurrent_to").alias("record_id"), F.struct(*nested).alias(kind))

    main = records.where("record_type in ('response', 'revisit')").select(
        "record_id", "record_type", F.struct(*nested).alias("response"))
    return main.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every row of ``pages`` written, read back and assembled."""
    path = shared_dir(spark, "llm", "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = materialise(read_records(spark, path, payloads=False), "records")
    prepare(spark)
    note = F.col("metadata.fields")
    return assemble(records).select(
        note["pageId"].cast("long").alias("page_id"),
        F.when(F.col("record_type") == "response", F.col("response.payload_bytes"))
        .otherwise(note["payloadLength"].cast("long")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), "record_type",
        note["refersToPage"].cast("long").alias("refers_to"))
