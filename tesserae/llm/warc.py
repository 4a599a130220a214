"""WARC archives: a writer, and a normaliser for archives that are one gzip stream.

Writer: every task writes its rows as archives of one gzip stream each (*monolithic*: small, but no
record can be read without inflating all before it).  Normaliser: each such archive is inflated
once, as a stream, and every record is written again as a gzip member of its own, while a sidecar
file gets a line ``offset<TAB>length<TAB>record id`` for it.  Reader: records are read through the
sidecar, each by its own offset, and parsed from the stored bytes.

Archives live in the folder that driver and executors share, through ``pyarrow.fs`` (local, HDFS or
object stores).  A task writes under a name of its own and reports it; files of attempts that were
lost are never reported, hence never read.  Memory holds one record and one gzip window.

Copies: among records with equal payload (SHA-1 and length) of at least ``min_bytes`` bytes the one
with the smallest page id is a *response*; the others are *revisit* records without payload that
name it.  Defined results: a null or empty html is an empty payload; a null page id sorts last; of
repeated rows one is the response; a null url becomes an empty target; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import frugal, materialise, remove, remove_later, shared_dir, table

MIN_BYTES, ARCHIVE_BYTES, LEVEL, CHUNK = 0, 256 << 20, 3, 1 << 20
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, sha1: str, size: int, refers_to, is_revisit: bool) -> bytes:
    """The bytes of one WARC 1.1 record; a revisit has an empty block but keeps digest and length of the full payload."""
    url = "".join(c for c in url if c >= " " and c != "\x7f")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else quote(str(page_id), safe='')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Length: {size}",
    ]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else quote(str(refers_to), safe='')}>"]
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated archive, cut by their Content-Length."""
    data, at = bytearray(), 0
    more = True
    while more or at < len(data):
        end = data.find(b"\r\n\r\n", at)
        need = end + 8 + int(parse_head(bytes(data[at:end]))["content-length"]) if end >= 0 else 0
        if need and need <= len(data):
            yield bytes(data[at:need])
            at = need
            continue
        if not more:
            raise ValueError("the archive ends inside a record")
        del data[:at]
        at = 0
        wanted = max(need - len(data), 1)
        while wanted > 0 and more:
            part = next(stream, None)
            more = part is not None
            if more:
                data += part
                wanted -= len(part)


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, streamed."""
    z = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            if z.eof:
                z = zlib.decompressobj(31)
            yield z.decompress(chunk, CHUNK)
            while z.unconsumed_tail:
                yield z.decompress(z.unconsumed_tail, CHUNK)
            chunk = z.unused_data
    if not z.eof:
        raise ValueError("the gzip stream is cut off")


def _file(f) -> Iterator[bytes]:
    while part := f.read(CHUNK):
        yield part


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def normalise(source, target, index, level: int = LEVEL) -> int:
    """Rewrites the monolithic archive ``source`` (a file object) record by record; returns the number of records."""
    at = n = 0
    for n, rec in enumerate(records(filter(None, inflate(_file(source)))), 1):  # noqa: B007
        out = member(rec, level)
        target.write(out)
        name = parse_head(rec[: rec.find(b"\r\n\r\n")])["warc-record-id"]
        index.write(f"{at}\t{len(out)}\t{name}\n".encode())
        at += len(out)
    return n


def roles(pages: DataFrame, id_col: str, payload_col: str, url_col: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``page_id, url, html, sha1, size, refers_to, is_revisit`` by native grouping on the payload digest; only narrow rows are shuffled but for the join back."""
    html = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("hex"), F.octet_length(html).cast("long").alias("size"))
    narrow = rows.select("page_id", "hex", "size").filter(F.col("size") >= min_bytes)
    first = narrow.groupBy("hex", "size").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id")).alias("k"), F.count(F.lit(1)).alias("n"))
    met = materialise(first.filter("n > 1").select("hex", "size", F.col("k.page_id").alias("first_id"), F.lit(True).alias("met")))
    small = met.count() <= 500_000
    return rows.join(F.broadcast(met) if small else met, ["hex", "size"], "left").withColumn("met", F.coalesce("met", F.lit(False)))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """``(page_id, url, html, refers_to, is_revisit)`` to monolithic archives; one row ``archive, n_records`` each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        out = None
        done: list[tuple[str, int]] = []
        for b in batches:
            for row in b.to_pylist():
                payload = row["html"].encode()
                if out is None:
                    name, n, held, z = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0, zlib.compressobj(level, zlib.DEFLATED, 31)
                    out = fs.open_output_stream(name, compression=None)
                out.write(z.compress(record(row["page_id"], row["url"], b"" if row["is_revisit"] else payload, digest(payload), len(payload), row["refers_to"], row["is_revisit"])))
                n, held = n + 1, held + len(payload)
                if held >= archive_bytes:
                    out.write(z.flush())
                    out.close()
                    done, out = [*done, (name, n)], None
        if out is not None:
            out.write(z.flush())
            out.close()
            done.append((name, n))
        yield pa.RecordBatch.from_pydict({"archive": pa.array([a for a, _ in done], pa.string()), "n_records": pa.array([n for _, n in done], pa.int64())})

    return rows.select("page_id", "url", "html", "refers_to", "is_revisit").mapInArrow(frugal(run), "archive string, n_records long")


def normalise_archives(archives: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """One row ``archive, index, n_records`` for each rewritten archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        for b in batches:
            for name in b.column(0).to_pylist():
                to = f"{root}/{uuid.uuid4().hex}.warc.gz"
                with fs.open_input_stream(name, compression=None) as f, fs.open_output_stream(to, compression=None) as out, fs.open_output_stream(f"{to}.idx", compression=None) as idx:
                    n = normalise(f, out, idx, level)
                yield pa.RecordBatch.from_pydict({"archive": [to], "index": [f"{to}.idx"], "n_records": pa.array([n], pa.int64())})

    return archives.select("archive").mapInArrow(frugal(run), "archive string, index string, n_records long")


def read_records(archives: DataFrame, folder: str) -> DataFrame:
    """``record_id, record_type, target, payload_digest, payload_bytes, refers_to, payload`` of every record, each through its sidecar entry.

    A response's digest and length are computed from the payload read back and must match its header.
    """
    schema = "record_id string, record_type string, target string, payload_digest string, payload_bytes long, refers_to string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(folder)
        for b in batches:
            for name, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(index, compression=None) as f:
                    entries = [x.split("\t") for x in f.read().decode().splitlines()]
                rows, held = [], 0
                with fs.open_input_file(name) as f:
                    for at, length, record_id in entries:
                        f.seek(int(at))
                        rec = zlib.decompress(f.read(int(length)), 31)
                        end = rec.find(b"\r\n\r\n")
                        head = parse_head(rec[:end])
                        payload = rec[end + 4 : end + 4 + int(head["content-length"])]
                        if head["warc-record-id"] != record_id:
                            raise ValueError(f"the sidecar of {name} does not fit at {at}")
                        if head["warc-type"] == "response":
                            size, sha1 = len(payload), digest(payload)
                            if f"sha1:{sha1}" != head["warc-payload-digest"]:
                                raise ValueError(f"the payload of {record_id} in {name} is damaged")
                        else:
                            size, sha1 = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:")
                        rows.append((unquote(record_id[10:-1]), head["warc-type"], head["warc-target-uri"], sha1, size, unquote(head["warc-refers-to"][10:-1]) if "warc-refers-to" in head else None, payload))
                        held += len(payload)
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["record_id", "record_type", "target", "payload_digest", "payload_bytes", "refers_to", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return archives.select("archive", "index").mapInArrow(frugal(run), schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes, normalises and reads back; see :func:`read_records` for the columns (ids as text)."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/tesserae-warc/{uuid.uuid4().hex}"
    rows = roles(pages, id_col, payload_col, url_col, min_bytes)
    remove_later(spark, folder)
    first = F.col("met") & F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.withColumn("_id", F.coalesce(F.col("page_id").cast("string"), F.lit("\0")))  # a null id is an id like any other
    # Rows that repeat the first page's id and payload: one of them, the first written, is the response.
    again = materialise(rows.filter(first).groupBy("_id", "hex", "size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_id", "hex", "size"))
    plain = rows.withColumn("is_revisit", F.col("met") & ~F.col("page_id").eqNullSafe(F.col("first_id")))
    if again.count():
        doubled = materialise(plain.join(again, ["_id", "hex", "size"], "left_semi"))
        plain = plain.join(again, ["_id", "hex", "size"], "left_anti")
        one = doubled.dropDuplicates(["_id", "hex", "size"])
        copies = doubled.groupBy("_id", "hex", "size").agg(F.count(F.lit(1)).alias("n"), F.first("url").alias("url"), F.first("page_id").alias("page_id"), F.first("first_id").alias("first_id"), F.first("met").alias("met"))
        copies = copies.withColumn("i", F.explode(F.sequence(F.lit(2), F.col("n").cast("int")))).join(one.select("_id", "hex", "size", "html"), ["_id", "hex", "size"]).withColumn("is_revisit", F.lit(True))
        plain = plain.unionByName(one.select(plain.columns)).unionByName(copies.select(plain.columns))
    plain = plain.withColumn("refers_to", F.when(F.col("is_revisit"), F.col("first_id")))
    whole = materialise(write_archives(plain, f"{folder}/whole"))
    members = materialise(normalise_archives(whole.repartition(max(1, whole.count())), f"{folder}/members"))
    remove(spark, f"{folder}/whole")
    return read_records(members.repartition(max(1, members.count())), folder)


def op2_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    page = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    out = archive_pages(pages)
    return out.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


ORACLE_OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS k FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = k THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = k THEN NULL ELSE k END AS refers_to
FROM x
"""
