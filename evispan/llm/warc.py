"""WARC archives: capture, and the normaliser of monolithic gzip streams.

Capture writes records as whole-file gzip streams through Spark's own writer, payloads that occur
before as revisits. The normaliser inflates each file's stream once, rewrites every record as a
gzip member of its own, and keeps a sidecar index of member offsets, so that any record can be
read alone. Files are streamed, never held: memory is bounded by the largest record, however large
the file.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispan.llm.common import delete_path, fresh_path, read_table, settle

LEAST_BYTES = 1000
FILE_RECORDS = 4096
SALTS = 16
#: Repeated payloads that are broadcast at most (about 100 bytes each); beyond that a salted join.
MOST_SENT = 200_000
END = b"\r\n\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.0"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long"


def decide(pages: DataFrame, *, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html and payload_bytes, payload_digest, record_type, refers_to.

    Of payloads with equal SHA-1 and at least `least_bytes` bytes the largest page_id is the
    response; a null id revisits it too, and where all ids are null all are responses.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1("html"))
    seen = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("_keep"), F.count("*").alias("_n"))
    seen = settle(seen.where("_n > 1 and _keep is not null").select("payload_digest", "_keep"))
    if seen.count() <= MOST_SENT:
        met = rows.join(F.broadcast(seen), "payload_digest", "left")
    else:  # a hot payload's rows are dealt over SALTS tasks
        salted = seen.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["payload_digest", "_salt"], "left").drop("_salt")
    again = F.col("_keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keep"))
    return met.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("_keep"))).drop("_keep")


def capture(decided: DataFrame, path: str, *, file_records: int = FILE_RECORDS) -> None:
    """Write the records as monolithic gzip files under path."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    again = F.col("record_type") == "revisit"
    body = F.when(again, F.lit("")).otherwise(F.col("html"))
    record = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(again, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )
    decided.select(record.alias("value")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records).text(path)


def inflated(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or more members, a piece of at most `step` bytes at a time; `stream` is read once."""
    z, rest = None, stream.read(step)
    while rest:
        if z is None:
            z = zlib.decompressobj(31)
        piece = z.decompress(rest, step)
        if piece:
            yield piece
        if z.eof:
            rest, z = z.unused_data or stream.read(step), None
        else:
            rest = z.unconsumed_tail or stream.read(step)
    if z is not None:
        raise ValueError("the gzip stream ends early")


def members(stream, step: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, inflated bytes) of each gzip member of a stream; memory holds one member."""
    at, rest = 0, stream.read(step)
    while rest:
        z, got, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not rest:
                raise ValueError("the gzip stream ends early")
            got.append(z.decompress(rest))
            used += len(rest) - len(z.unused_data)
            rest = z.unused_data if z.eof else stream.read(step)
        yield at, used, b"".join(got)
        at, rest = at + used, rest or stream.read(step)


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields, payload, the whole record's bytes) of a WARC stream."""
    buffer = bytearray()

    def fill(n: int | None = None) -> bool:
        for piece in pieces:
            buffer.extend(piece)
            if n is None or len(buffer) >= n:
                return True
        return n is not None and len(buffer) >= n

    while True:
        while (cut := buffer.find(END)) < 0:
            if not fill():
                if buffer.strip():
                    raise ValueError("a record has no end of its header")
                return
        head = bytes(buffer[:cut])
        fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
        start = cut + len(END)
        stop = start + int(fields["Content-Length"])
        if len(buffer) < stop + len(END) and not fill(stop + len(END)):
            raise ValueError("a record is cut short")
        payload = bytes(buffer[start:stop])
        yield fields, payload, bytes(buffer[: stop + len(END)])
        del buffer[: stop + len(END)]


def member(record: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _page(urn: str | None) -> int | None:
    value = urn[len("<urn:page:") : -1] if urn else "null"
    return None if value == "null" else int(value)


def _row(archive: str, offset: int, length: int, fields: dict[str, str], payload: bytes) -> tuple:
    kind = fields["WARC-Type"]
    digest, size = (hashlib.sha1(payload).hexdigest(), len(payload)) if kind == "response" else (fields["WARC-Payload-Digest"][5:], int(fields["X-Payload-Length"]))
    if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't have its digest")
    return archive, offset, length, _page(fields["WARC-Record-ID"]), kind, _page(fields.get("WARC-Refers-To")), digest, size


_ARROW = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def normalise(spark, source: str, target: str) -> DataFrame:
    """Rewrite every *.gz file under source as a file of one member per record under target; the sidecar index, also at target/index.

    An archive gets its final name only when whole, and has the same name and bytes when a lost
    executor's task runs again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (whence, top), (store, root) = pafs.FileSystem.from_uri(source), pafs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                raw = path.rsplit("/", 1)[1]
                name = raw.split(".")[0] + ".warc.gz"
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                rows, at = [], 0
                with whence.open_input_stream(f"{top}/{raw}", compression=None) as stream, store.open_output_stream(part, compression=None) as out:
                    for fields, payload, whole in records(inflated(stream)):
                        packed = member(whole)
                        out.write(packed)
                        rows.append(_row(name, at, len(packed), fields, payload))
                        at += len(packed)
                if store.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound:
                    store.delete_file(f"{root}/{name}")
                store.move(part, f"{root}/{name}")
                for k in range(0, len(rows), 10_000):
                    yield _batch(rows[k : k + 10_000])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    files.mapInArrow(run, INDEX).write.parquet(f"{target}/index")
    return spark.read.schema(INDEX).parquet(f"{target}/index")


def read_back(spark, target: str) -> DataFrame:
    """The index's columns as the archives under target themselves have them, every payload's digest computed anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(target)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name, rows = path.rsplit("/", 1)[1], []
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for at, size, whole in members(stream):
                        fields, payload, _ = next(records(iter([whole])))
                        rows.append(_row(name, at, size, fields, payload))
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(target).select("path")
    return files.mapInArrow(run, INDEX)


def read_record(target: str, archive: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index, reading nothing else."""
    store, root = pafs.FileSystem.from_uri(target)
    with store.open_input_file(f"{root}/{archive}") as f:
        data = f.read_at(length, offset)
    fields, payload, _ = next(records(inflated(io.BytesIO(data))))
    return fields, payload


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """A row per page, read from the archives themselves and held against the sidecar index; nulls and repeated rows as in decide()."""
    raw, target = fresh_path(spark, "capture"), fresh_path(spark, "warc")
    capture(decide(read_table(spark, sf_dir, "pages")), raw)
    index = normalise(spark, raw, target)
    delete_path(spark, raw)
    listed = index.select("archive", "offset", "length")
    found = settle(read_back(spark, target).join(listed, ["archive", "offset", "length"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    delete_path(spark, target)
    return found


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keep FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM d LEFT JOIN k ON k.payload_digest = d.payload_digest AND payload_bytes >= 1000
"""
