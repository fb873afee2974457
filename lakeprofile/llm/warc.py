"""WARC archives, index first.

Records are written by tasks, one archive per task, straight through pyarrow's
file systems into the shared folder; a record's offset, length, URL and digest
are the task's output rows.  That index, written as a table, is the commit: an
archive that a failed attempt left is in no index row and so does not exist.
To read, selected index rows are dealt to tasks by archive and stretch of
``READ_BYTES`` in it, as many tasks as their bytes ask for, and sorted by offset;
ranges that touch or nearly touch are coalesced up to a bound, and each is read at once.

Of records with equal payloads of at least ``REVISIT_BYTES``, that with the
largest page id is the response; the others are revisit records that refer to
it and hold no payload.  A record's id names its archive and place and so is
unique; the page ids stand, percent-encoded, in fields of their own.

Defined cases: a page id may be of any type that casts to a string and back; a null payload is an empty one; a null URL is written as
``urn:page:`` and the id; repeated rows are records of their own, and those that
equal the response are responses too; rows without an id are responses; an
empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm.common import materialise, prepare, scratch

REVISIT_BYTES = 1000
#: Ranges at most so far apart are read as one, up to so many bytes; a task reads about so many.
GAP, READ_BYTES, TASK_BYTES = 64 << 10, 4 << 20, 64 << 20
_LEVEL = 1
_EPOCH = "2020-01-01T00:00:00Z"
_PAGE, _PAGE_REFERRED = "X-Page-ID", "X-Refers-To-Page-ID"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to, refers_url): what each record is to be; refers_to is null for responses."""
    column = lambda c: F.col(f"`{c}`")
    plain = pages.select(column(id_col).alias("page_id"), column(url_col).cast("string").alias("url"), F.coalesce(column(payload_col).cast("string"), F.lit("")).alias("payload"))
    large = plain.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "url", F.sha1("payload").alias("digest"))
    # Rows without text from here: a group of equal payloads of any size is summed before the shuffle.
    groups = large.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    others = large.select("page_id", "digest").join(groups, "digest").where("page_id < top.page_id").select(F.col("page_id").alias("id"), "digest", F.col("top.page_id").alias("refers_to"), F.col("top.url").alias("refers_url")).distinct()
    on = (F.col("page_id") == F.col("id")) & (F.sha1("payload") == F.col("digest"))
    return plain.join(others, on, "left").select("page_id", "url", "payload", "refers_to", "refers_url")


def _record(name: str, page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, refers_url: str | None) -> tuple[bytes, str, str]:
    digest = hashlib.sha1(payload).hexdigest()
    uri = url if url else f"urn:page:{quote(page_id or '', safe='')}"
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        f"WARC-Date: {_EPOCH}",
        "WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"{_PAGE}: {quote(page_id, safe='')}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"{_PAGE_REFERRED}: {quote(refers_to, safe='')}"]
        if refers_url:
            head.append("WARC-Refers-To-Target-URI: " + refers_url.replace("\r", "%0D").replace("\n", "%0A"))
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", kind, digest


def write(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``decide``'s rows as gzip-per-record archives below ``folder``; returns the index, already stored.

    The index has page_id, url, digest, record_type, archive, offset, length.
    """
    spark = records.sparkSession
    folder = folder or scratch(spark)
    id_type = records.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, out, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for b in batches:
                if out is None:
                    system, path = _open(archive)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)  # records are compressed one by one
                rows = []
                for page_id, url, payload, to, to_url in zip(*(c.to_pylist() for c in (b.column(5), b.column(1), b.column(2).cast(pa.binary()), b.column(3), b.column(4)))):
                    record, kind, digest = _record(f"{archive}#{at}", page_id, url, payload, to, to_url)
                    packed = gzip.compress(record, _LEVEL, mtime=0)
                    out.write(packed)
                    rows.append((digest, kind, at, len(packed)))
                    at += len(packed)
                digest, kind, offset, length = map(list, zip(*rows)) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest, pa.string()), pa.array(kind, pa.string()), pa.array([archive] * len(rows), pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["page_id", "url", "digest", "record_type", "archive", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    prepare(spark)
    spelled = F.col("page_id").cast("string").alias("spelled")
    index = records.select("page_id", "url", "payload", F.col("refers_to").cast("string"), "refers_url", spelled).mapInArrow(run, f"page_id {id_type}, url string, digest string, record_type string, archive string, offset long, length long")
    return materialise(index)


def coalesce_ranges(rows: list[tuple[int, int]], gap: int = GAP, most: int = READ_BYTES) -> Iterator[list[tuple[int, int]]]:
    """Runs of sorted (offset, length) whose gaps are at most ``gap`` and whose extent is at most ``most``, single records excepted."""
    run: list[tuple[int, int]] = []
    for offset, length in rows:
        if run and (offset - (run[-1][0] + run[-1][1]) > gap or offset + length - run[0][0] > most):
            yield run
            run = []
        run.append((offset, length))
    if run:
        yield run


def parse(record: bytes) -> dict:
    """A record's type, target, payload length and digest, what it refers to, and its payload (None for a revisit)."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    revisit = fields["WARC-Type"] == "revisit"
    ident = lambda name: unquote(fields[name]) if name in fields else None
    return {
        "page_id": ident(_PAGE),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": length if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"][5:] if revisit else hashlib.sha1(payload).hexdigest(),
        "record_type": fields["WARC-Type"],
        "refers_to": ident(_PAGE_REFERRED),
        "payload": None if revisit else payload,
    }


def read(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the selected ``index`` rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to and the payload."""
    fields = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())] + [("payload", pa.binary())] * payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # rows come sorted by archive and offset
            at = 0
            archives, ranges = b.column(0).to_pylist(), list(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
            while at < len(archives):
                end = at
                while end < len(archives) and archives[end] == archives[at]:
                    end += 1
                system, path = _open(archives[at])
                with system.open_input_file(path) as f:
                    for group in coalesce_ranges(ranges[at:end]):
                        first = group[0][0]
                        data = f.read_at(group[-1][0] + group[-1][1] - first, first)
                        found = [parse(zlib.decompress(data[o - first : o - first + n], 31)) for o, n in group]
                        yield pa.RecordBatch.from_pylist([{k: x[k] for k in fields} for x in found], schema=schema)
                at = end

    spark = index.sparkSession
    prepare(spark)
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(-(-total // READ_BYTES), max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))))
    stretch = F.floor(F.col("offset") / READ_BYTES)
    placed = index.select("archive", "offset", "length").repartition(tasks, "archive", stretch).sortWithinPartitions("archive", "offset")
    found = placed.mapInArrow(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payload)
    kind = index.schema["page_id"].dataType
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as read from the archives."""
    return read(write(decide(pages, id_col, url_col, payload_col)), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < top THEN top END AS refers_to
FROM r
"""
