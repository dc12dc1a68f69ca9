"""WARC archives compressed record by record with a Zstandard dictionary built from their own records.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; every record behind it is a
frame of its own that needs only that dictionary, as in the public ``.warc.zst`` convention. Equal payloads are stored once: the
record with the smallest page id is the response, the others are revisits that refer to it.

Archives are written by tasks straight to the given folder, under names of their own until they are whole, so a rerun
of a lost task replaces its files. Pages meet their roles by page id, in one shuffle; payloads are never grouped.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, written

#: Fixed value: the skippable frame that carries a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: Pages carry no time of their own.
DATE = "1970-01-01T00:00:00Z"
#: Records that a task holds back to build an archive's dictionary from, and the size at which it starts another archive.
SAMPLE_BYTES = 2 << 20
ARCHIVE_BYTES = 64 << 20
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WRITTEN = "file string, bytes long, records long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324


def _uri(url: str) -> str:
    """The url with what no URI may hold in percent form; what is in that form already stays."""
    return quote(url, safe="%/:?#[]@!$&'()*+,;=~")


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str) -> bytes:
    """The warcinfo record that starts the archive ``name``."""
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(name, "info")), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return _record(fields, b"format: WARC File Format 1.1\r\nsoftware: stayflow\r\n")


def _record_id(archive: str, place: int | str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}/{place}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, own_digest: str, refers_url: str | None = None, record_id: str | None = None) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit of page ``refers_to`` (at ``refers_url``) without one.

    The page's own id and url, from which it is read back, are fields of our own beside the standard ones.
    """
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id or _record_id("page", str(page_id))),
        ("WARC-Target-URI", _uri(url) if url else f"urn:page:{'none' if page_id is None else page_id}"), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{own_digest}"),
        ("WARC-Refers-To-Target-URI", (_uri(refers_url) if refers_url else f"urn:page:{refers_to}") if revisit else None), ("WARC-Refers-To-Date", DATE if revisit else None),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("X-Page-ID", page_id), ("X-Page-URL", None if url is None else quote(url, safe="", errors="surrogatepass")), ("X-Page-Refers-To", refers_to), ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(fields, http + (b"" if revisit else payload))


def parse(raw: bytes) -> dict:
    """A record's page_id, url, record_type, digest, refers_to, payload_bytes and payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    page = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": page("X-Page-ID"), "url": unquote(fields["X-Page-URL"], errors="surrogatepass") if "X-Page-URL" in fields else None,
        "record_type": fields["WARC-Type"], "payload_digest": fields["WARC-Payload-Digest"][5:], "refers_to": page("X-Page-Refers-To"),
        "payload_bytes": size, "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the records; None where they are too few or too small for one."""
    if len(records) < 8 or sum(map(len, records)) < 4096:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, records)) // 8), records, k=256, d=8)
    except zstandard.ZstdError:
        return None  # records without anything in common


def archive(records: Iterator[bytes], out, limit: int, name: str = "archive") -> tuple[int, int]:
    """Writes a warcinfo record and records to ``out`` until it holds ``limit`` bytes and all records that the dictionary was built from: (bytes, records without the first)."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    own = _dictionary(held)
    content = own.as_bytes() if own else b""
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
    done, n = 8 + len(content), 0
    packer = zstandard.ZstdCompressor(level=3, dict_data=own, write_checksum=True) if own else zstandard.ZstdCompressor(level=3, write_checksum=True)

    first = packer.compress(info(name))
    out.write(first)
    done += len(first)
    # a chain, unlike a generator, can be dropped without closing ``records``, from which the next archive goes on
    for r in chain(held, records):
        frame = packer.compress(r)
        out.write(frame)
        done, n = done + len(frame), n + 1
        if done >= limit and n >= len(held):
            break
    return done, n


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of one archive, in order."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    own = zstandard.ZstdCompressionDict(data[8 : 8 + size]) if size else None
    at = 8 + size
    unpack = zstandard.ZstdDecompressor(dict_data=own) if own else zstandard.ZstdDecompressor()
    while at < len(data):
        one = unpack.decompressobj()
        # a frame's end is known only after it is read; the window grows until the frame fits
        got, width = [], 1 << 16
        while not one.eof:
            chunk = data[at : at + width]
            if not chunk:
                raise ValueError("the archive ends within a record")
            got.append(one.decompress(chunk))
            at += len(chunk)
        at -= len(one.unused_data)
        yield b"".join(got)


def write_warc(df: DataFrame, path: str, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record per row of ``df`` to archives in the folder ``path``: a table of (file, bytes, records), written when this returns.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of ``least`` bytes or more the one
    with the smallest key is the response (a null key counts as largest; of rows with that key, the one whose url
    hashes lowest; rows that repeat even that are all responses), and the others are revisits of it. Smaller ones are
    all responses. Tasks write with pyarrow's file systems, so ``path`` may be a URI of any of them that all executors
    reach. An empty table writes no archive; other columns are not read.
    """
    spark = df.sparkSession
    pages = df.select(
        df[key].cast("long").alias("page_id"), df[url].cast("string").alias("url"), F.coalesce(df[html], F.lit("")).alias("html")
    ).withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("bytes", F.octet_length("html").cast("long")).withColumn("url_key", F.xxhash64("url"))
    same = ["page_id", "url_key", "digest"]
    narrow = written(pages.select(*same, "url", "bytes"))
    own = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("p"), F.col("url_key").alias("u"), F.col("url"))
    firsts = narrow.where(F.col("bytes") >= least).groupBy("digest").agg(F.min(own).alias("f"), F.count("*").alias("n")).where("n > 1 AND f.p IS NOT NULL").drop("n")
    revisits = narrow.where(F.col("bytes") >= least).withColumn("own", own).join(firsts, "digest").where("NOT (own <=> f)")
    roles = written(revisits.select(*same, F.col("f.p").alias("refers_to"), F.col("f.url").alias("refers_url")).distinct())
    meet = F.expr("p.page_id <=> r.page_id AND p.url_key = r.url_key AND p.digest = r.digest")
    placed = pages.alias("p").join(roles.alias("r"), meet, "left").select("p.page_id", "p.url", "p.html", "p.digest", "r.refers_to", "r.refers_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pyarrow.fs.FileSystem.from_uri(path)

        def records() -> Iterator[bytes]:
            for batch in batches:
                for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to", "refers_url")), strict=True):
                    page_id, link, page, sha, refers_to, refers_url = (x.as_py() for x in row)
                    yield record(page_id, link, page.encode("utf-8", "surrogatepass"), refers_to, base64.b32encode(sha).decode(), refers_url, f"<urn:uuid:{uuid.uuid4()}>")

        rows, source = [], records()
        first = next(source, None)
        while first is not None:
            name = uuid.uuid4().hex
            with files.open_output_stream(f"{folder}/.{name}.tmp") as out:
                size, count = archive(chain([first], source), out, ARCHIVE_BYTES, f"{name}.warc.zst")
            files.move(f"{folder}/.{name}.tmp", f"{folder}/{name}.warc.zst")
            rows.append((f"{name}.warc.zst", size, count))
            first = next(source, None)
        f, b, c = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["file", "bytes", "records"])

    files, folder = pyarrow.fs.FileSystem.from_uri(path)
    files.create_dir(folder, recursive=True)
    return written(placed.mapInArrow(run, WRITTEN))


def read_warc(spark: SparkSession, path: str, listing: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in ``listing`` (file): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Only files that the listing names are read, so what a failed task left behind is not. Each response's payload is
    checked against its digest. ``payload`` is null for revisits, and for all if ``payloads`` is false.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pyarrow.fs.FileSystem.from_uri(path)
        names = [c.split()[0] for c in READ.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in READ.split(", ")]
        for batch in batches:
            for file in batch.column("file").to_pylist():
                with files.open_input_file(f"{folder}/{file}") as f:
                    data = f.read()
                rows: list[tuple] = []
                for raw in read_archive(data):
                    if raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo"):
                        continue
                    r = parse(raw)
                    if r["payload"] is not None and (digest(r["payload"]) != r["payload_digest"] or len(r["payload"]) != r["payload_bytes"]):
                        raise ValueError(f"{file}: page {r['page_id']} does not match its digest")
                    r["payload"] = r["payload"].decode() if payloads and r["payload"] is not None else None
                    rows.append(tuple(r[c] for c in names))
                    if len(rows) == 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    n = max(1, min(listing.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return listing.select("file").repartition(n).mapInArrow(run, READ)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
