"""WARC archives of pages: a writer with revisits, and a reader that salvages.

Records are gzip members of their own. The reader checks every member: that it
inflates, that its record is whole, and that the payload has the digest its header
gives. After a failed check it searches for the next member or version line from
which a record can be read again and logs the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanepulse.joins import small_side
from lanepulse.llm.common import keyed
from lanepulse.staging import session_folder, stage

FILE_BYTES = 32 << 20
_DATE = "2020-01-01T00:00:00Z"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_STEP = 1 << 13


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: int, ident, url, payload: bytes, digest: str, first: int, first_id) -> bytes:
    """One record; a revisit keeps the HTTP head, which gives the payload's full length."""
    revisit = first != key
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{key}>", f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if ident is not None:
        lines.append(f"X-Page-ID: {ident}")
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{first}>",
        ]
        if first_id is not None:
            lines.append(f"X-Refers-To-Page-ID: {first_id}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _writer(folder: str, file_bytes: int):
    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        out, size, n, names = [], 0, 0, []

        def close():
            nonlocal out, size, n
            # Every attempt has names of its own; the manifest tells which count.
            name = f"pages-{task.partitionId():06d}-{len(names):04d}-{task.taskAttemptId()}.warc.gz"
            with system.open_output_stream(f"{root}/{name}", compression=None) as file:
                file.write(b"".join(out))
            names.append((name, n, size))
            out, size, n = [], 0, 0

        for batch in batches:
            columns = ("key", "id", "url", "text", "first", "first_id")
            for key, ident, url, text, first, first_id in zip(*(batch.column(c) for c in columns)):
                payload = (text.as_py() or "").encode()
                raw = _member(record(
                    key.as_py(), ident.as_py(), url.as_py(), payload, base32_sha1(payload),
                    first.as_py(), first_id.as_py(),
                ))
                out.append(raw)
                size += len(raw)
                n += 1
                if size >= file_bytes:
                    close()
        if out:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.int64()),
             pa.array([x[2] for x in names], pa.int64())], names=["name", "records", "bytes"],
        )

    return run


def write_archives(
    pages: DataFrame, folder: str | None = None, id_column: str = "page_id", text_column: str = "html",
    url_column: str = "url", *, least: int = 0, file_bytes: int = FILE_BYTES,
) -> tuple[str, DataFrame]:
    """Write one record per row; returns the folder and a manifest of (name, records, bytes).

    Of equal payloads of at least `least` bytes the row of the smallest id is the
    response and the others revisit it. NULL payloads count as empty, NULL ids come
    first, and rows that share an id are pages of their own in the order of their
    payload. The folder has to be one that every executor reaches; by default a new
    one beside the staged tables. An empty table writes no file.
    """
    spark = pages.sparkSession
    folder = folder or f"{session_folder(spark)}/warc-{uuid.uuid4().hex[:12]}"
    if "://" not in folder:
        folder = f"file://{folder}" if not folder.startswith("file:") else folder.replace("file:", "file://", 1)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    # The address travels beside the payload, so it needs no second look-up.
    url = F.col(url_column) if url_column in pages.columns else F.lit(None).cast("string")
    body = F.struct(F.coalesce(F.col(text_column), F.lit("")).alias("text"), url.alias("url"))
    rows = keyed(pages.select(F.col(id_column), body.alias("body")), id_column, "body")
    rows = rows.select("key", "id", F.col("text.text").alias("body"), F.col("text.url").alias("url"))
    rows = rows.withColumnRenamed("body", "text")
    payload = F.col("text").cast("binary")
    named = rows.withColumn("digest", F.when(F.octet_length("text") >= least, F.sha1(payload)))
    first = named.where("digest is not null").groupBy("digest").agg(
        F.min("key").alias("first"), F.min_by("id", "key").alias("first_id"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("digest", "first", "first_id")
    first = small_side(stage(first, "repeated-payloads"))
    told = named.join(first, "digest", "left").select(
        "key", "id", "text", F.coalesce("first", "key").alias("first"),
        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first_id")).alias("first_id"),
        "url",
    )
    manifest = stage(
        told.mapInArrow(_writer(folder, file_bytes), "name string, records long, bytes long"), "manifest"
    )
    return folder, manifest


def _inflated(data, at: int) -> tuple[bytes, int]:
    """The member at `at` and where it ends."""
    unpack, parts, end = zlib.decompressobj(31), [], at
    while not unpack.eof:
        chunk = data[end : end + _STEP]
        if not chunk:
            raise ValueError("member is cut off")
        parts.append(unpack.decompress(chunk))
        end += len(chunk)
    return b"".join(parts), end - len(unpack.unused_data)


def _head(raw: bytes, at: int) -> tuple[dict[str, str], int]:
    stop = raw.find(b"\r\n\r\n", at)
    if stop < 0 or not raw.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n"), at):
        raise ValueError("no record head")
    fields = {}
    for line in raw[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("broken header line")
        fields[name.strip().lower().decode()] = value.strip().decode()
    return fields, stop + 4


def _one(raw: bytes, at: int) -> tuple[dict, int]:
    """The checked record at `at` of uncompressed bytes and where it ends."""
    fields, body = _head(raw, at)
    length = int(fields.get("content-length", "-1"))
    end = body + length
    if length < 0 or end + 4 > len(raw) or raw[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record has another length than its head says")
    block = raw[body:end]
    want = fields.get("warc-block-digest")
    if want and want != "sha1:" + base32_sha1(block):
        raise ValueError("block digest differs")
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type", "")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    size = len(payload)
    told = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    if kind == "revisit" and told:
        size = int(told[1])
    elif kind == "response" and digest and base32_sha1(payload) != digest:
        raise ValueError("payload digest differs")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "record_id": fields.get("warc-record-id"), "record_type": kind, "id": number("x-page-id"),
        "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest or None,
        "refers_to": number("x-refers-to-page-id"), "payload": payload if kind == "response" else None,
    }, end + 4


def salvage(data: bytes):
    """(kind, offset, length, record or reason) over an archive, damaged or not.

    Kind is record or gap. Gaps are maximal and, with the records, cover every byte.
    """
    at, lost, reason = 0, None, ""
    size = len(data)
    while at < size:
        try:
            if data[at : at + 3] == b"\x1f\x8b\x08":
                raw, end = _inflated(data, at)
                found, inside = _one(raw, 0)
                if inside != len(raw):
                    raise ValueError("bytes after the record in its member")
            else:
                found, end = _one(data, at)
        except (ValueError, zlib.error) as error:
            if lost is None:
                lost, reason = at, str(error)
            next_start = _START.search(data, at + 1)
            at = next_start.start() if next_start else size
            continue
        if lost is not None:
            yield "gap", lost, at - lost, reason
            lost = None
        yield "record", at, end - at, found
        at = end
    if lost is not None:
        yield "gap", lost, size - lost, reason


_READ = pa.schema([
    ("kind", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ("reason", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("id", pa.int64()),
    ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("refers_to", pa.int64()), ("payload", pa.binary()),
])
READ = (
    "kind string, path string, offset long, length long, reason string, record_id string, record_type string, "
    "id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def _reader(with_payload: bool):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows = []
                for kind, offset, length, what in salvage(content.as_py()):
                    row = {"kind": kind, "path": path.as_py(), "offset": offset, "length": length}
                    row |= {"reason": what} if kind == "gap" else what
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    if len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return run


def read_archives(
    spark: SparkSession, folder: str, manifest: DataFrame | None = None, *, with_payload: bool = True
) -> DataFrame:
    """Records and quarantined gaps of the archives in `folder`, gzip or plain.

    With a manifest only files named there are read, which leaves out what failed
    task attempts wrote. Each row is a record (kind `record`) or a gap (kind `gap`
    with its reason). A folder without archives gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    if manifest is not None:
        name = F.element_at(F.split("path", "/"), -1)
        files = files.join(small_side(manifest.select("name")), name == F.col("name"), "left_semi")
    return files.select("path", "content").mapInArrow(_reader(with_payload), READ)
