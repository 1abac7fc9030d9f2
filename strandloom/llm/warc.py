"""WARC archives, and a normaliser of monolithic gzip ones.

Pages are written as records of archives that are one gzip stream each, as crawlers leave them that compress the whole file:
no record of these can be read without inflating all before it. The normaliser inflates such a stream once, from start to
end, rewrites every record as a gzip member of its own, turns records whose payload another record has into revisits, and
writes a sidecar index of offsets (one JSON line a record). Readers then fetch any record by its offset and length.

Payloads never pass a shuffle: the writer's tasks return slim rows (archive, number of the record, page, digest), by which
the responses of equal payloads are found, and each archive's normaliser gets the list of its revisits. Files have names of
their own for each attempt, and a lost attempt's files are in no result.

Defined cases: a null html is an empty payload; payloads under MIN_REVISIT bytes are always responses; of rows with equal
page_id and payload one is the response and the others are revisits of it; a null page_id comes after all others and its
revisits refer to null; a null url is left out of the record; an empty table gives an empty result; only page_id, url and html
are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, read_table, scratch_path

MIN_REVISIT = 100
ARCHIVE_BYTES = 64 << 20  # raw bytes at which a writer starts the next archive
LEVEL = 3
READ = 1 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to: list | None = None, size: int | None = None) -> bytes:
    """A response record, or with refers_to (a list of the page_id) a revisit without the payload, which size then describes."""
    block = HTTP + (b"" if refers_to else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Page-ID: {json.dumps(page_id)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload) if size is None else size}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To-Page: {json.dumps(refers_to[0])}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(x.split(": ", 1) for x in lines[1:] if x)


def target(head: dict[str, str]) -> str | None:
    u = head.get("WARC-Target-URI")
    return None if u is None else u.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def inflate(stream, size: int = READ):
    """The bytes of a gzip file of one or many members, piece by piece."""
    d = zlib.decompressobj(31)
    while data := stream.read(size):
        while data:
            out = d.decompress(data, size)
            if out:
                yield out
            if d.eof:
                data, d = d.unused_data, zlib.decompressobj(31)
            else:
                data = d.unconsumed_tail
    yield d.flush()


def records(pieces):
    """(headers, block) of the records in a stream of bytes, with one record in memory at a time."""
    buf = bytearray()
    pieces = iter(pieces)

    def fill(n: int) -> bool:
        while len(buf) < n:
            x = next(pieces, None)
            if x is None:
                return False
            buf.extend(x)
        return True

    while True:
        end, seen = -1, 0
        while end < 0:
            end = buf.find(b"\r\n\r\n", max(0, seen - 3))
            if end < 0:
                seen = len(buf)
                if not fill(len(buf) + 1):
                    if buf.strip():
                        raise ValueError("a record is cut off")
                    return
        head = parse_head(bytes(buf[:end]))
        n = int(head["Content-Length"])
        if not fill(end + 4 + n + 4):
            raise ValueError("a record is cut off")
        yield head, bytes(buf[end + 4 : end + 4 + n])
        del buf[: end + 4 + n + 4]


def _writer(root: str):
    def run(batches):
        place, base = open_fs(root)
        place.create_dir(base, recursive=True)
        out, packer, name, number, held = None, None, None, 0, 0
        rows: list[tuple] = []

        def close():
            nonlocal out
            if out:
                out.write(packer.flush())
                out.close()
                out = None

        for batch in batches:
            for page_id, url, page in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html")]):
                payload = (page or "").encode()
                if out is None or held > ARCHIVE_BYTES:
                    close()
                    name, number, held = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, packer = place.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                digest = hashlib.sha256(payload).hexdigest()
                raw = record(page_id, url, payload, digest)
                out.write(packer.compress(raw))
                held += len(raw)
                rows.append((name, number, page_id, digest, len(payload)))
                number += 1
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], batch.schema.field("page_id").type), pa.array(cols[3]), pa.array(cols[4], pa.int64())], ["archive", "number", "page_id", "digest", "size"])
                rows = []
        close()

    return run


def write_monolithic(pages: DataFrame, root: str) -> DataFrame:
    """Writes archives below root; archive, number, page_id, digest and size of every record."""
    kind = pages.schema["page_id"].dataType
    pages = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    written = pages.mapInArrow(_writer(root), "archive string, number bigint, page_id string, digest string, size bigint")
    return materialize(written.withColumn("page_id", F.col("page_id").cast(kind)), "written")


def revisits(written: DataFrame) -> DataFrame:
    """archive, number and refers_to (the response's page_id) of all records that become revisits."""
    big = written.where(F.col("size") >= MIN_REVISIT)
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "archive", "number")
    first = big.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    x = big.join(first, "digest").where((F.col("archive") != F.col("first.archive")) | (F.col("number") != F.col("first.number")))
    return x.select("archive", "number", F.col("first.page_id").alias("refers_to"))


def _normaliser(source: str, root: str):
    def run(batches):
        place, base = open_fs(source)
        to, out_base = open_fs(root)
        to.create_dir(out_base, recursive=True)
        for batch in batches:
            done = []
            for archive, changes in zip(batch.column("archive").to_pylist(), batch.column("revisits").to_pylist()):
                refers = {x["number"]: x["refers_to"] for x in changes or ()}
                name = uuid.uuid4().hex
                offset, index = 0, []
                with place.open_input_stream(f"{base}/{archive}", compression=None) as src, to.open_output_stream(f"{out_base}/{name}.warc.gz", compression=None) as dst:
                    for i, (head, block) in enumerate(records(inflate(src))):
                        page_id, digest = json.loads(head["WARC-Page-ID"]), head["WARC-Payload-Digest"].removeprefix("sha256:")
                        ref = [refers[i]] if i in refers else None
                        raw = record(page_id, target(head), block[len(HTTP) :], digest, ref)
                        packed = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = packed.compress(raw) + packed.flush()
                        dst.write(member)
                        index.append(json.dumps({"page_id": page_id, "offset": offset, "length": len(member), "type": "revisit" if ref else "response", "digest": digest}))
                        offset += len(member)
                with to.open_output_stream(f"{out_base}/{name}.idx", compression=None) as dst:
                    dst.write("\n".join(index).encode())
                done.append((f"{name}.warc.gz", f"{name}.idx", len(index)))
            if done:
                cols = list(zip(*done))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int64())], ["archive", "index", "records"])

    return run


def normalise(written: DataFrame, source: str, root: str) -> DataFrame:
    """Rewrites the archives of written below root with a member for each record; archive, index and records of each."""
    changes = revisits(written).groupBy("archive").agg(F.collect_list(F.struct("number", F.col("refers_to").cast("string").alias("refers_to"))).alias("revisits"))
    names = materialize(written.select("archive").distinct(), "archives")
    todo = names.join(changes, "archive", "left").repartition(max(1, names.count()))  # a task for each archive
    return materialize(todo.mapInArrow(_normaliser(source, root), "archive string, index string, records bigint"), "normalised")


def read_member(stream, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    stream.seek(offset)
    return next(records(inflate_bytes(stream.read(length))))


def inflate_bytes(data: bytes):
    yield zlib.decompress(data, 31)


def _reader(root: str):
    def run(batches):
        place, base = open_fs(root)
        for batch in batches:
            for archive, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist()):
                with place.open_input_stream(f"{base}/{index}", compression=None) as src:
                    lines = src.read().decode().splitlines()
                with place.open_input_file(f"{base}/{archive}") as src:
                    for at in range(0, len(lines), 512):
                        rows = []
                        for line in lines[at : at + 512]:
                            x = json.loads(line)
                            head, block = read_member(src, x["offset"], x["length"])
                            what, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["WARC-Payload-Length"])
                            if what == "response":
                                payload = block[len(HTTP) :]
                                size, found = len(payload), hashlib.sha256(payload).hexdigest()
                                if found != digest:
                                    raise ValueError(f"payload of {x} does not have its digest")
                            rows.append((json.loads(head["WARC-Page-ID"]), size, digest, what, json.loads(head.get("WARC-Refers-To-Page", "null"))))
                        cols = list(zip(*rows))
                        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4], pa.string())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read_archives(archives: DataFrame, root: str, kind: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of all records, fetched one by one by their offsets.

    kind is the SQL type of page_id; records hold it as a string. A task reads one archive."""
    rows = archives.repartition(max(1, archives.count())).mapInArrow(_reader(root), "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    return rows.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    source, root = scratch_path(spark, "monolithic"), scratch_path(spark, "warc")
    archives = normalise(write_monolithic(pages, source), source, root)
    discard(spark, [source])
    return read_archives(archives, root, dict(pages.dtypes)["page_id"])


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM r
"""
