"""WARC archives: one gzip member per record, written by tasks and read back in sequence.

The writer's tasks make archives of a bounded size, and the archives of the
attempts that succeeded are committed together as an index.  The reader streams
an archive, decompresses member by member, frames each record by its content
length and verifies its digests.  It reads archives of other writers too.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.llm.common import materialise, new_path, table

#: Payloads from this size on are written once; equal ones are revisits.
MIN_REVISIT_BYTES = 1_000
#: Bytes from which on an archive is closed and another begun.
ARCHIVE_BYTES = 128_000_000
#: Table, in the archives' folder, of those that count.
INDEX = "_index"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16
READ_SCHEMA = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, record_id string, refers_to_record string, payload binary"


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def b32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """The gzip member of one page: a response with its payload, or a revisit with the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: {b32_sha1(payload)}", f"WARC-Block-Digest: {b32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


# --- reading ------------------------------------------------------------------


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The decompressed gzip members of an archive, one at a time; a cut-off archive raises."""
    unpack, parts, open_ = zlib.decompressobj(31), [], False
    for chunk in chunks:
        while chunk:
            open_ = True
            parts.append(unpack.decompress(chunk))
            chunk = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts, open_ = zlib.decompressobj(31), [], False
            else:
                break
    if open_:
        raise ValueError("the archive ends inside a gzip member")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record; wrong framing or a wrong block digest raises."""
    head, found, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not found or not first.startswith("WARC/1."):
        raise ValueError("a member doesn't begin with a WARC header")
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"{fields.get('warc-record-id')}: content length {size} doesn't frame its block")
    block = rest[:size]
    if (want := fields.get("warc-block-digest")) and want != b32_sha1(block):
        raise ValueError(f"{fields.get('warc-record-id')}: block digest differs")
    return fields, block


def sha1_of(value: str | None) -> str | None:
    """A labelled SHA-1 digest, in base 32 or hex, as hex; None for another algorithm or none."""
    label, _, code = (value or "").partition(":")
    if label.lower() != "sha1":
        return None
    if re.fullmatch(r"[0-9a-fA-F]{40}", code):
        return code.lower()
    if not re.fullmatch(r"[A-Z2-7]{32}", code.upper()):
        raise ValueError(f"{value} is no SHA-1 digest")
    return base64.b32decode(code.upper()).hex()


def dechunked(body: bytes) -> bytes:
    """A body of chunks as one; one that isn't cut in chunks, or ends inside one, raises."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        m = re.fullmatch(rb"\s*([0-9a-fA-F]+)\s*(?:;.*)?", body[at:end] if end >= 0 else b"")
        if not m:
            raise ValueError("a chunked body is cut off")
        size, at = int(m[1], 16), end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunked body is cut off")
        out.append(body[at : at + size])
        at += size + 2


def pages_of(chunks: Iterable[bytes]) -> Iterator[tuple]:
    """The page records of an archive, as rows of READ_SCHEMA; other records are passed over."""
    for raw in members(chunks):
        fields, block = parse(raw)
        kind = fields.get("warc-type")
        if kind not in ("response", "revisit"):
            continue
        name, refers = fields.get("warc-record-id"), fields.get("warc-refers-to") if kind == "revisit" else None
        http, _, raw_body = block.partition(b"\r\n\r\n")
        told = sha1_of(fields.get("warc-payload-digest"))
        length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size, payload = int(length[1]) if length else None, None
        if kind == "response":
            chunked = re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", http)
            payload = dechunked(raw_body) if chunked else raw_body
            # a digest may have been taken before or after the chunks were put together
            if not chunked and size not in (None, len(payload)) or told and told not in (hashlib.sha1(payload).hexdigest(), hashlib.sha1(raw_body).hexdigest()):
                raise ValueError(f"{name}: payload length or digest differs")
            size, told = len(payload), hashlib.sha1(payload).hexdigest()
        yield page_of(name), kind, size, told, page_of(refers), fields.get("warc-target-uri"), name, refers, payload


def filesystem(uri: str):
    """(file system, path) of a URI; Hadoop's names of object stores are put into their common form."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/(?!/)", "file:///", uri)))


def _chunks(uri: str) -> Iterator[bytes]:
    store, name = filesystem(uri)
    with store.open_input_stream(name, compression=None) as stream:
        while chunk := stream.read(CHUNK):
            yield chunk


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(uri) of the archives of a folder: those its index lists or, where it has none, all ``*.warc.gz`` files."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{INDEX}")
    if jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
        return spark.read.schema("name string, records long").parquet(f"{path}/{INDEX}").where("records > 0").select(F.concat(F.lit(f"{path}/"), "name").alias("uri"))
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(F.col("path").alias("uri"))


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All page records of a folder's archives, streamed: a task holds one record and a bounded batch of rows.

    Archives of other writers: record ids that aren't pages of this writer give
    a null ``page_id`` and ``refers_to`` and stand in ``record_id`` and
    ``refers_to_record``; a chunked response is put together; a response
    without a payload digest, or with one of another algorithm, gets the SHA-1
    of what was read; a revisit without digest or length has nulls there.
    Records of other types are passed over.  A folder without archives gives
    an empty table.
    """
    keep = 9 if payloads else 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
        names = ("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "record_id", "refers_to_record", "payload")
        rows: list[tuple] = []
        held = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds[:keep])], names=names[:keep])

        for b in batches:
            for uri in b.column(0).to_pylist():
                for row in pages_of(_chunks(uri)):
                    rows.append(row[:keep])
                    held += len(row[8] or b"") if payloads else 0
                    if len(rows) >= 4096 or held > 8_000_000:
                        yield full()
                        rows, held = [], 0
        if rows:
            yield full()

    schema = READ_SCHEMA if payloads else READ_SCHEMA.removesuffix(", payload binary")
    files = archives(spark, path)
    # one archive a task, as far as tasks go round
    return files.repartition(max(1, min(files.count(), 4_096)), "uri").mapInArrow(run, schema)


# --- writing ------------------------------------------------------------------


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, refers_to: the largest page_id of equal payloads, where this row isn't that one.

    Only digests that repeat are joined.  Rows with a null id count as smaller
    than any other; rows that repeat the largest id are all responses.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.when(F.length("payload") >= min_bytes, F.sha1("payload")))
    most = p.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("most"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("same"), "most")
    # stored first, so that its size is known and payloads aren't shuffled to meet a small table
    most = materialise(most, "payload-repeats")
    # payloads without a digest get keys of their own, so that they don't meet under null where the join shuffles
    key = F.coalesce("digest", F.concat(F.lit("small:"), F.xxhash64("page_id", "url").cast("string")))
    out = p.withColumn("key", key).join(most, F.col("key") == F.col("same"), "left")
    first = F.coalesce(F.col("page_id") == F.col("most"), F.lit(False))
    return out.select("page_id", "url", "payload", F.when(~first, F.col("most")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write each row of ``pages`` (page_id, url, html) as a record into archives under ``path``, and an index of them.

    A task begins a new archive once one has ``archive_bytes``, so an archive is
    larger by one record at most.  Names hold the attempt, and the index, a
    table that Spark commits as a whole, lists the archives of attempts that
    succeeded: a task that runs again, or twice, adds nothing.  Null payloads
    are empty, null ids and urls are kept as such, repeated rows are records of
    their own, payloads of any length are one record, an empty table gives an
    empty index; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(path)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        row, k = next(rows, None), 0
        while row is not None:
            name, n, size = f"pages-{task.partitionId():06d}-{k:04d}-{task.taskAttemptId()}.warc.gz", 0, 0
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                while row is not None and size < archive_bytes:
                    data = member(*row)
                    out.write(data)
                    size += len(data)
                    n, row = n + 1, next(rows, None)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([n], pa.int64())], names=["name", "records"])
            k += 1

    revisits(pages).mapInArrow(run, "name string, records long").write.parquet(f"{path}/{INDEX}")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as payload_bytes, sha1(b) as payload_digest from p),
m as (select *, max(page_id) over (partition by payload_digest) as most from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {MIN_REVISIT_BYTES} and page_id < most then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {MIN_REVISIT_BYTES} and page_id < most then most end as refers_to
from m
"""
