"""WARC archives as a chunked record table (operator 6).

A record is a run of rows (record_id, chunk_no): row 0 carries the WARC header
block and the HTTP head, rows 1, 2, ... carry payload pieces of at most
``chunk_bytes``. Each row holds the SHA-1 of its own piece, checked when it is
read, and the running SHA-1 of the payload so far, so that the last row has the
digest of the whole payload though no step ever holds the whole record. The
bytes of a record's rows in order, a blank line after the last, are the record
as it stands in a .warc file; ``write_warc_files`` and ``read_warc_files`` move
between the two, record by record and piece by piece.

Reading back takes everything from the record's own bytes: kind, target, digest
and length of a revisit from its header, digest and length of a response from its
payload pieces, hashed again in order. Where they differ from the header, or a
row is missing or damaged, the record is not ``intact``.

Of records with equal payloads of at least ``min_revisit_bytes`` the one with
the largest id is the response and the others are revisits of it without
payload. Null payloads are empty payloads. Rows that repeat the largest id are
all responses. Rows that share an id are judged each by its own payload. Rows without an id are responses unless an equal payload has one.
Columns other than id, URL and payload are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, salted_left_join, slices, table

CHUNK_SCHEMA = (
    "record_id string, page_id long, url string, chunk_no int, last boolean, data binary, chunk_sha1 binary, payload_sha1 binary, payload_bytes long"
)
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD_SPACE = uuid.UUID("5f0c5f1e-5a39-4c0e-8f65-0d5b2a3f9a10")


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def header_block(kind: str, record_id: str, url: str | None, page_id, digest: str, length: int, refers_to, payload_bytes: int) -> bytes:
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {payload_bytes}", f"X-Source-Row: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Row: {refers_to}"]
    return ("\r\n".join([*lines, "Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]) + "\r\n\r\n").encode()


def payload_digests(pages: DataFrame, chunk_bytes: int) -> DataFrame:
    """(page_id, sha1, n): digests are fed piece by piece."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "payload", 16 << 20):
                sha, n = [], []
                for value in batch.column("payload"):
                    view, h = memoryview(value.as_buffer() or b""), hashlib.sha1()
                    for at in range(0, len(view), chunk_bytes):
                        h.update(view[at : at + chunk_bytes])
                    sha.append(h.digest())
                    n.append(len(view))
                yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "sha1": pa.array(sha, pa.binary()), "n": pa.array(n, pa.int64())})

    return pages.select("page_id", "payload").mapInArrow(digest, "page_id long, sha1 binary, n long")


def find_revisits(digests: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """(page_id, sha1, refers_to) of every row that revisits another; a hot payload is spread over tasks."""
    groups = (
        digests.where(F.col("n") >= min_revisit_bytes).groupBy("sha1", "n").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies"))
        .where((F.col("copies") > 1) & F.col("refers_to").isNotNull()).select("sha1", "refers_to")
    )
    joined = salted_left_join(digests.where(F.col("page_id").isNotNull()), groups, "sha1", "page_id")
    return joined.where(F.col("refers_to").isNotNull() & (F.col("page_id") != F.col("refers_to"))).select("page_id", "sha1", "refers_to").distinct()


def make_records(pages: DataFrame, chunk_bytes: int) -> DataFrame:
    """Chunk rows of pages (page_id, url, payload, refers_to, seq)."""

    def pieces(row_id, url, view: memoryview, refers_to, seq) -> Iterator[tuple]:
        kind = "response" if refers_to is None else "revisit"
        record_id = str(uuid.uuid5(RECORD_SPACE, f"{row_id}:{seq}"))
        h = hashlib.sha1()
        if kind == "revisit" or len(view) <= chunk_bytes:
            h.update(view)
        else:  # the header needs the digest: a first pass over the pieces, nothing is copied
            for at in range(0, len(view), chunk_bytes):
                h.update(view[at : at + chunk_bytes])
        length = len(HTTP_HEAD) + (len(view) if kind == "response" else 0)
        head = header_block(kind, record_id, url, row_id, base32(h.digest()), length, refers_to, len(view)) + HTTP_HEAD
        if kind == "revisit":
            yield record_id, row_id, url, 0, True, head, hashlib.sha1(head).digest(), h.digest(), len(view)
            return
        running, at, no = hashlib.sha1(), 0, 1
        yield record_id, row_id, url, 0, not len(view), head, hashlib.sha1(head).digest(), running.digest(), 0
        while at < len(view):
            piece = bytes(view[at : at + chunk_bytes])
            running.update(piece)
            at += len(piece)
            yield record_id, row_id, url, no, at >= len(view), piece, hashlib.sha1(piece).digest(), running.digest(), at
            no += 1

    names = [part.split()[0] for part in CHUNK_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            ids, urls, refs, seqs = (batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "seq"))
            for i, value in enumerate(batch.column("payload")):
                for row in pieces(ids[i], urls[i], memoryview(value.as_buffer() or b""), refs[i], seqs[i]):
                    rows.append(row)
                    held += len(row[5])
                    if held > 8 << 20:
                        yield emit(rows)
                        rows, held = [], 0
        if rows:
            yield emit(rows)

    return pages.select("page_id", "url", "payload", "refers_to", "seq").mapInArrow(run, CHUNK_SCHEMA)


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk_bytes: int = 1 << 20, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the record table to the shared folder; returns it as read back."""
    pages = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    digests = materialize(payload_digests(pages, chunk_bytes), "payload-digests")
    revisits = find_revisits(digests, min_revisit_bytes)
    keyed = pages.withColumn("seq", F.monotonically_increasing_id()).withColumn("sha1", F.unhex(F.sha1("payload")))
    joined = keyed.join(revisits, ["page_id", "sha1"], "left")
    return materialize(make_records(joined, chunk_bytes), "warc-records")


def field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"\r\n{name}: ?([^\r\n]*)", 1)


def sha1_text(digest: Column) -> Column:
    """Upper-case base32 of a 20-byte digest: eight groups of 20 bits, four letters each."""
    hexed, letters = F.hex(digest), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for g in range(8):
        bits = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substr(F.lit(letters), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*out)


def long_digests(archive: DataFrame) -> DataFrame:
    """(record_id, long_sha1) of payloads of several pieces, hashed piece by piece in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for batch in batches:
            done = []
            for record, piece in zip(batch.column("record_id").to_pylist(), batch.column("data")):
                if record != now:
                    if now is not None:
                        done.append((now, h.digest()))
                    now, h = record, hashlib.sha1()
                h.update(memoryview(piece.as_buffer()))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.string(), pa.binary()))], names=["record_id", "long_sha1"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([h.digest()], pa.binary())], names=["record_id", "long_sha1"])

    several = archive.where("chunk_no = 2").select("record_id").distinct()
    pieces = archive.where("chunk_no > 0").select("record_id", "chunk_no", "data").join(several, "record_id", "left_semi")
    return pieces.repartition("record_id").sortWithinPartitions("record_id", "chunk_no").select("record_id", "data").mapInArrow(run, "record_id string, long_sha1 binary")


def read_records(archive: DataFrame) -> DataFrame:
    """One row a record from its chunk rows; only headers, sizes and digests are shuffled, and payloads of several pieces."""
    first = F.col("chunk_no") == 0
    rows = archive.select(
        "record_id", "chunk_no", "last", F.when(first, F.col("data").cast("string")).alias("head"), F.when(~first, F.octet_length("data")).otherwise(0).alias("piece"),
        F.unhex(F.sha1("data")).alias("own"), "chunk_sha1",
    )
    records = rows.groupBy("record_id").agg(
        F.max("head").alias("head"), F.sum("piece").alias("held"), F.max("chunk_no").alias("top"), F.count(F.lit(1)).alias("parts"),
        F.max(F.when(F.col("chunk_no") == 1, F.col("own"))).alias("one"), F.every(F.col("own") == F.col("chunk_sha1")).alias("sound"), F.max("last").alias("ended"),
    )
    records = records.join(long_digests(archive), "record_id", "left")
    head = F.col("head")
    kind, said = field(head, "WARC-Type"), F.regexp_replace(field(head, "WARC-Payload-Digest"), "^sha1:", "")
    revisit = kind == "revisit"
    found = sha1_text(F.when(F.col("top") == 0, F.lit(hashlib.sha1(b"").digest())).when(F.col("top") == 1, F.col("one")).otherwise(F.col("long_sha1")))
    size = F.when(revisit, field(head, "X-Payload-Bytes").try_cast("long")).otherwise(F.col("held"))
    whole = (F.col("parts") == F.col("top") + 1) & F.col("ended") & F.col("sound") & (revisit | ((found == said) & (size == field(head, "X-Payload-Bytes").try_cast("long"))))
    return records.select(
        "record_id", field(head, "X-Source-Row").try_cast("long").alias("page_id"), field(head, "WARC-Target-URI").alias("url"), size.cast("long").alias("payload_bytes"),
        F.when(revisit, said).otherwise(found).alias("payload_digest"), kind.alias("record_type"), field(head, "X-Refers-To-Row").try_cast("long").alias("refers_to"), whole.alias("intact"),
    )


def write_warc_files(archive: DataFrame, folder: str, files: int) -> DataFrame:
    """Write .warc files to a folder that all executors reach; returns (path, records, bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, records, size = None, "", 0, 0
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for data, last, part in zip(batch.column("data").to_pylist(), batch.column("last").to_pylist(), batch.column("part").to_pylist()):
                if out is None:
                    path = f"{root}/part-{part:05d}.warc"
                    store.create_dir(root, recursive=True)
                    temporary = f"{path}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                for piece in (data, b"\r\n\r\n") if last else (data,):
                    out.write(piece)
                    size += len(piece)
                records += last
        if out is not None:  # a retried task replaces the file as a whole
            out.close()
            store.move(temporary, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

    dealt = archive.repartition(files, "record_id").sortWithinPartitions("record_id", "chunk_no").withColumn("part", F.spark_partition_id())
    return dealt.select("data", "last", "part").mapInArrow(write, "path string, records long, bytes long")


def parse_warc(stream, chunk_bytes: int = 1 << 20) -> Iterator[tuple[dict, int, bytes]]:
    """(headers, chunk_no, piece) of every record of a WARC byte stream, read piece by piece."""
    left = b""

    def fill(n: int) -> bool:
        nonlocal left
        while len(left) < n:
            more = stream.read(max(n - len(left), 65536))
            if not more:
                return False
            left += more
        return True

    while True:
        while fill(1) and left[:1] in b"\r\n":
            left = left[1:]
        if not left:
            return
        while (end := left.find(b"\r\n\r\n")) < 0:
            if not fill(len(left) + 1):
                return
        head, left = left[:end].decode("utf-8", "replace"), left[end + 4 :]
        lines = head.split("\r\n")
        headers = {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        todo, no = int(headers.get("content-length", 0)), 0
        if not todo:
            yield headers, 0, b""
        while todo:
            fill(min(todo, chunk_bytes))
            piece, left = left[: min(todo, chunk_bytes)], left[min(todo, chunk_bytes) :]
            if not piece:
                return
            todo -= len(piece)
            yield headers, no, piece
            no += 1


def read_warc_files(spark: SparkSession, paths: list[str], chunk_bytes: int = 1 << 20) -> DataFrame:
    """(path, record_id, warc_type, target_uri, chunk_no, data) of .warc and .warc.gz files, one task a file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as raw:
                    stream = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw
                    for headers, no, piece in parse_warc(stream, chunk_bytes):
                        row = [path, headers.get("warc-record-id"), headers.get("warc-type"), headers.get("warc-target-uri"), no, piece]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([v], k) for v, k in zip(row, (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary()))],
                            names=["path", "record_id", "warc_type", "target_uri", "chunk_no", "data"],
                        )

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return listed.mapInArrow(read, "path string, record_id string, warc_type string, target_uri string, chunk_no int, data binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_records(write_archive(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


OP6_SQL = r"""
WITH digests AS (
    SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
), groups AS (
    SELECT h, n, max(page_id) AS top FROM digests WHERE n >= 0 GROUP BY h, n HAVING count(*) > 1
)
SELECT page_id, CAST(d.n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(d.h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
       CASE WHEN top IS NOT NULL AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to, true AS intact
FROM digests d LEFT JOIN groups g ON d.h = g.h AND d.n = g.n
"""
