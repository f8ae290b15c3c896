"""WARC archives of pages, found again through an index.

Writing gives one row of index for each record: file, offset, length, URL and digest. Reading starts at the
index: the rows that a condition selects are sorted by file and offset, neighbours are read by one request,
and each record is cut out, unpacked and checked against its digest.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import frugal, materialize, shared_path, table, text_slices

#: Equal payloads of fewer bytes are written out each time.
LEAST_BYTES = 100
#: An archive file is closed once it has so many bytes.
FILE_BYTES = 1 << 30
#: One read takes records until it has so many bytes, and reads over gaps of this size.
READ_BYTES, GAP_BYTES = 8 << 20, 64 << 10
#: Bytes of archive that one task reads.
CHUNK_BYTES = 64 << 20
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

INDEX_SCHEMA = "file string, offset bigint, length bigint, url string, digest string, record_type string, page_id bigint"
RECORD_SCHEMA = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the path there, named as Hadoop or as Arrow names them."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{row}')}>"


def record(page: dict, date: str) -> bytes:
    """One WARC record. A revisit has the HTTP header of its page, with the full length, and no payload."""
    payload = page["html"].encode()
    revisit = page["first_row"] is not None and page["first_row"] != page["row"]
    block = HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page['page_id'], page['row'])}", f"WARC-Date: {date}"]
    if page["url"] is not None:
        head.append(f"WARC-Target-URI: {quote(page['url'], safe=SAFE)}")
    if page["page_id"] is not None:
        head.append(f"WARC-Page-ID: {page['page_id']}")
    head.append(f"WARC-Payload-Digest: sha256:{page['digest']}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(page['first_id'], page['first_row'])}"]
        if page["first_id"] is not None:
            head.append(f"WARC-Refers-To-Page-ID: {page['first_id']}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: What stays as it is in a target URI; blanks, controls and what isn't ASCII are escaped.
SAFE = "!#$%&'()*+,/:;=?@[]~"


def _write(folder: str, date: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        out, name, at = None, "", 0
        try:
            for batch in text_slices(batches, "html"):
                found = []
                for page in batch.to_pylist():
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0  # an attempt that fails leaves a file that no index names
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    member = gzip.compress(record(page, date), level, mtime=0)
                    out.write(member)
                    kind = "response" if page["first_row"] in (None, page["row"]) else "revisit"
                    found.append((name, at, len(member), page["url"], page["digest"], kind, page["page_id"]))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), INDEX_TYPES)], names=INDEX_NAMES)
        finally:
            if out is not None:
                out.close()

    return write


INDEX_NAMES = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]
INDEX_TYPES = [pa.int64() if x.endswith("bigint") else pa.string() for x in INDEX_SCHEMA.split(", ")]


def write_archive(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path``, and their index as Parquet beside them.

    Of rows with equal payloads of ``LEAST_BYTES`` or more, the one with the smallest page_id is a response
    and the others revisit it; null ids come last, and of rows that share the id the one with the least URL
    is first, of equal rows any one. Null html is an empty payload, a null URL or id has no header line.
    Columns beside these three aren't written. An empty table gives an empty index. Digests stand for
    payloads. Members are packed one by one, so each can be read alone; files of tasks that were lost or
    run twice aren't named by the index, which Spark commits. Returns the index.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "digest": F.sha2(F.col("html").cast("binary"), 256)})
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "warc-pages")  # numbers stay as they are from here on
    order = F.struct(F.col("page_id").isNull(), "page_id", "url", "row")
    firsts = rows.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"))
    marked = rows.join(materialize(firsts, "warc-firsts"), "digest", "left")  # Spark knows the table's size and chooses the join
    folder = f"{path}/records"
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    written = marked.select("page_id", "url", "html", "digest", "row", "first_id", "first_row").mapInArrow(frugal(_write(folder, date, level)), INDEX_SCHEMA)
    written.write.parquet(f"{path}/index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")


def parse(member: bytes) -> dict:
    """The fields of one packed record; its payload is checked against its digest."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = next(int(x.split(": ")[1]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} differs from its header")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("WARC-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": digest, "refers_to": number("WARC-Refers-To-Page-ID"), "payload": payload}


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """file, begin, end and the records' places of each read; ``rows`` (file, offset, length) ascend."""
    name, begin, end, held = None, 0, 0, []
    for file, offset, length in rows:
        if held and (file != name or offset > end + GAP_BYTES or offset + length > begin + READ_BYTES):
            yield name, begin, end, held
            held = []
        if not held:
            name, begin, end = file, offset, offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield name, begin, end, held


def _read(folder: str, payload: bool):
    schema = pa.schema([(x.split()[0], pa.int64() if x.endswith("bigint") else pa.string()) for x in RECORD_SCHEMA.split(", ")] + [("payload", pa.binary())] * payload)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        name, source = None, None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")))
            for file, begin, end, held in ranges(list(rows)):
                if file != name:
                    name, source = file, system.open_input_file(f"{root}/{file}")
                data = memoryview(source.read_at(end - begin, begin))
                yield pa.RecordBatch.from_pylist([parse(data[a - begin : a - begin + n]) for a, n in held], schema)

    return read


def read_archive(spark: SparkSession, path: str, where: Column | str = "true", payload: bool = True) -> DataFrame:
    """The records whose index rows fulfil ``where``: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    A revisit has no payload of its own; its bytes and digest are those of the full payload.
    """
    chosen = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index").where(where)
    total = chosen.agg(F.sum("length")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // CHUNK_BYTES))
    chunk = F.floor(F.col("offset") / READ_BYTES)
    dealt = chosen.select("file", "offset", "length").repartition(parts, "file", chunk).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(frugal(_read(f"{path}/records", payload)), RECORD_SCHEMA + ", payload binary" * payload)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
ranked AS (
  SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first_id FROM p
  WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS FIRST)
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND place > 1 THEN first_id END AS refers_to
FROM ranked
"""
