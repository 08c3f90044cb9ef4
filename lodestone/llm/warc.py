"""WARC: a deterministic sharded writer with manifests, and its reader."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, tasks_for, text_of

VERSION = b"WARC/1.1\r\n"
#: Date of all records unless the caller gives one: reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6c1f7e0a-53b5-4d57-9d3c-1c2b7a6f0e11")
_MANIFEST = "shard string, attempt string, first_id long, last_id long, records long, bytes long, sha256 string"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One record with fresh headers and digests. A revisit holds the response's HTTP header and no payload."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c for c in url or "" if c > " ") or "urn:lodestone:unknown"
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", "" if refers_to is None else str(refers_to))]
    headers.append(("Content-Length", str(len(block))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A record as a gzip member of its own; no time stamp, so equal records give equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def revisits(pages: DataFrame, payload: str = "html", key: str = "page_id", least: int = 100) -> DataFrame:
    """Key, digest and first key (refers_to) of each page that revisits another: the smallest key with an equal payload
    is the response. Only digests move: they are grouped with map-side combine, and joined back on the digest where
    Spark can split a digest that many pages share."""
    body = F.encode(text_of(payload), "UTF-8")
    digests = pages.where(F.octet_length(body) >= least).select(F.col(key).alias("page_id"), F.sha2(body, 256).alias("payload_digest"))
    groups = digests.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return digests.join(groups, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "payload_digest", "refers_to").distinct()


def write(pages: DataFrame, uri: str, payload: str = "html", key: str = "page_id", url: str = "url", roll_bytes: int = 32 << 20, task_bytes: int = 64 << 20, least: int = 100) -> DataFrame:
    """Writes archives below `uri` and returns the manifest (a row per file).

    Pages are range-sorted by key; each task starts a new file when the current one passes `roll_bytes` compressed.
    A file is written under a name with its attempt, and only the attempts that Spark reports as done are renamed to
    their final names; then the manifest and, last, the file _SUCCESS appear. A lost executor or a second attempt leaves
    temporary files that no manifest names; they are deleted at the commit. Names and bytes depend on the rows and the
    number of tasks alone.
    """
    spark = pages.sparkSession
    narrow = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("html"))
    # Pages move once, into ranges of keys; which of them are revisits comes as marks that sort just before the page.
    body = F.encode(text_of("html"), "UTF-8")
    marks = revisits(narrow, "html", "page_id", least).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to", "payload_digest", F.lit(True).alias("mark"))
    rows = narrow.select("*", F.lit(None).cast("long").alias("refers_to"), F.sha2(body, 256).alias("payload_digest"), F.lit(False).alias("mark")).unionByName(marks)
    total = narrow.agg(F.sum(F.octet_length("html"))).head()[0] or 0
    ranged = rows.repartitionByRange(tasks_for(spark, total, task_bytes), "page_id", "payload_digest").sortWithinPartitions("page_id", "payload_digest", F.desc("mark"), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, (store, root) = TaskContext.get(), _store(uri)
        store.create_dir(f"{root}/_temporary", recursive=True)
        part, attempt, count, out, rows, sink, digest, marked = context.partitionId(), uuid.uuid4().hex, 0, [], None, None, None, None

        def close() -> None:
            sink.close()
            out.append({"shard": f"part-{part:06}-{count:05}.warc.gz", "attempt": f"part-{part:06}-{count:05}-{attempt}", "first_id": rows[0], "last_id": rows[1], "records": rows[2], "bytes": rows[3], "sha256": digest.hexdigest()})

        for batch in batches:
            for x in range(batch.num_rows):
                page, address, html, refers, payload_digest, mark = (batch.column(k)[x].as_py() for k in range(6))
                if mark:
                    marked = (page, payload_digest, refers)
                    continue
                refers = marked[2] if marked and marked[:2] == (page, payload_digest) else None
                if sink is None:
                    sink, digest, rows = store.open_output_stream(f"{root}/_temporary/part-{part:06}-{count:05}-{attempt}", compression=None), hashlib.sha256(), [page, page, 0, 0]
                raw = member(record(page, address, (html or "").encode(), refers, refers is not None))
                sink.write(raw)
                digest.update(raw)
                rows = [rows[0], page, rows[2] + 1, rows[3] + len(raw)]
                if rows[3] >= roll_bytes:
                    close()
                    sink, count = None, count + 1
        if sink is not None:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("shard", pa.string()), ("attempt", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    manifest = materialize(ranged.mapInArrow(run, _MANIFEST))
    store, root = _store(uri)
    store.create_dir(root, recursive=True)
    # Files, not records: at 100 TB and a GB each, a hundred thousand rows.
    files = sorted((r.asDict() for r in manifest.toLocalIterator()), key=lambda r: r["shard"])
    for r in files:
        store.move(f"{root}/_temporary/{r['attempt']}", f"{root}/{r['shard']}")
    if store.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
        store.delete_dir(f"{root}/_temporary")
    with store.open_output_stream(f"{root}/MANIFEST.json", compression=None) as f:
        f.write("".join(json.dumps({k: v for k, v in r.items() if k != "attempt"}) + "\n" for r in files).encode())
    with store.open_output_stream(f"{root}/_SUCCESS"):
        pass
    return manifest.drop("attempt")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzipped archive, read a piece at a time."""
    z, raw, rest = zlib.decompressobj(31), b"", b""
    while True:
        piece = rest or stream.read(1 << 20)
        if not piece:
            break
        raw += z.decompress(piece)
        rest = z.unused_data
        if z.eof:
            head, _, body = raw.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if lines[0] + "\r\n" != VERSION.decode():
                raise ValueError(f"not a WARC record: {lines[0]!r}")
            headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            yield headers, body[: int(headers["Content-Length"])]
            z, raw = zlib.decompressobj(31), b""
    if raw:
        raise ValueError("the archive ends within a record")


def read(spark: SparkSession, uri: str, with_payload: bool = False) -> DataFrame:
    """Records of the archives that the manifest below `uri` names; refuses a folder without _SUCCESS.

    Block and payload digests are computed afresh, and a mismatch raises an error. Returns page_id, url, payload_bytes,
    payload_digest, record_type and refers_to; with_payload adds html (null for revisits). A task streams one archive
    at a time, record by record.
    """
    store, root = _store(uri)
    if store.get_file_info(f"{root}/_SUCCESS").type != fs.FileType.File:
        raise FileNotFoundError(f"{uri} holds no committed archives")
    with store.open_input_stream(f"{root}/MANIFEST.json", compression=None) as f:
        shards = [(json.loads(x)["shard"],) for x in f.read().decode().splitlines()]
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    fields += [("html", pa.string())] * with_payload
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(uri)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                out, held = [], 0
                with store.open_input_stream(f"{root}/{shard}", compression=None) as stream:
                    for headers, block in parse(stream):
                        kind = headers["WARC-Type"]
                        said = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        body = block.partition(b"\r\n\r\n")[2]
                        if "sha256:" + hashlib.sha256(block).hexdigest() != headers["WARC-Block-Digest"] or kind == "response" and hashlib.sha256(body).hexdigest() != said:
                            raise ValueError(f"{shard}: a digest of {headers['WARC-Record-ID']} does not match")
                        page, refers = headers["X-Page-ID"], headers.get("X-Refers-To-Page", "")
                        size = len(body) if kind == "response" else int(headers["X-Payload-Length"])
                        row = {"page_id": int(page) if page else None, "url": headers["WARC-Target-URI"], "payload_bytes": size, "payload_digest": said, "record_type": kind, "refers_to": int(refers) if refers else None}
                        if with_payload:
                            row["html"] = body.decode() if kind == "response" else None
                        out.append(row)
                        held += len(block)
                        if held > 4 << 20 or len(out) >= 4096:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    frame = spark.createDataFrame(shards, "shard string").repartition(max(1, len(shards)))
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * with_payload
    return frame.mapInArrow(run, ddl)


def round_trip(pages: DataFrame, uri: str | None = None, **options) -> DataFrame:
    """Writes the pages and reads the archives back.

    A null html is the empty payload and a response; rows that share the smallest key of a payload are all responses;
    null keys sort first and come back as null. Payloads shorter than `least` bytes never become revisits. An empty
    table writes a manifest without files.
    """
    uri = uri or shared_dir(pages.sparkSession)
    write(pages, uri, **options)
    return read(pages.sparkSession, uri)
