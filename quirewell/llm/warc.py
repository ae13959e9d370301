"""WARC archives with a Zstandard dictionary, written and read from executors.

An archive starts with a skippable frame that holds a dictionary trained on its
first records; every record is a frame of its own, compressed with it. Records
whose payload another page has become revisits of the page with the smallest id.

Archives lie in a shared folder that ``pyarrow.fs`` can open (local, HDFS, S3,
GCS). Each attempt of a task writes files of its own; only those that the
committed manifest names count, so a lost or repeated task leaves no gap and no
double.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, keep, partitions, pieces, work_dir

#: Magic of the skippable frame with the dictionary, as the WARC-zstd convention has it.
DICTIONARY_MAGIC = 0x184D2A5D
#: Uncompressed bytes of an archive, of the records a dictionary is trained on, and of the dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 64 << 20, 2 << 20, 32 << 10
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:quirewell:page")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def _uri(url: str | None, page: int | None) -> str:
    """The target URI; what may not stand in a header line is percent-encoded."""
    if not url:
        return f"urn:quirewell:page:{page}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One response, or a revisit where ``payload`` is None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    fields = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, str(page)) if page is not None else uuid.uuid4()}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url, page)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
    ]
    if payload is None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(SPACE, str(refers_to))}>"), ("X-Refers-To-Page", str(refers_to))]
    if page is not None:
        fields.append(("X-Page", str(page)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _head(fields) + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the records; of too few or too short ones, their bytes themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-DICTIONARY_BYTES:] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """One archive being written."""

    def __init__(self, folder: str, date: str) -> None:
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.path, self.waiting, self.size, self.records, self.out = f"{root}/{self.name}", [], 0, 0, None
        info = b"software: quirewell\r\nformat: WARC File Format 1.1\r\n"
        self._put(_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]) + info + b"\r\n\r\n")

    def add(self, data: bytes) -> None:
        self.records += 1
        self._put(data)

    def _put(self, data: bytes) -> None:
        self.size += len(data)
        if self.out is None:
            self.waiting.append(data)
            if self.size >= SAMPLE_BYTES:
                self._begin()
        else:
            self.out.write(self.compressor.compress(data))

    def _begin(self) -> None:
        trained = dictionary(self.waiting)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
        self.out = self.fs.open_output_stream(self.path, compression=None)
        held = trained.as_bytes()
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(held)) + held)
        for data in self.waiting:
            self.out.write(self.compressor.compress(data))
        self.waiting = []

    def close(self) -> tuple[str, int]:
        if self.out is None:
            self._begin()
        self.out.close()
        return self.name, self.records


def read_archive(folder: str, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record, streamed."""
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/{name}", compression=None) as file:
        magic, size = struct.unpack("<II", file.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError("an archive starts with its dictionary")
        held = file.read(size)
        trained = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_AUTO)
        with zstandard.ZstdDecompressor(dict_data=trained).stream_reader(file, read_across_frames=True) as stream:
            yield from _records(stream)


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    rest = bytearray()

    def more() -> bool:
        data = stream.read(1 << 20)
        rest.extend(data)
        return bool(data)

    at = 0
    while True:
        while (end := rest.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if bytes(rest[at:]).strip():
                    raise ValueError("the archive ends within a record")
                return
        lines = rest[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record here: {lines[0][:40]}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin, size = end + 4, int(fields["content-length"])
        while len(rest) < begin + size + 4:
            if not more():
                raise ValueError("the archive ends within a record")
        yield fields, bytes(rest[begin : begin + size])
        at = begin + size + 4
        if at > 4 << 20:
            del rest[:at]
            at = 0


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row as a record; returns the manifest ``file, records`` of the archives in ``folder``/archives.

    The manifest lies in ``folder``/manifest. Null html is an empty payload; a
    null url gets a URN. Of rows with equal payloads of ``min_revisit_bytes`` or
    more, those with the smallest id are responses, the others revisits; a null
    id is never the smallest unless the group has no other. Repeated rows of
    the smallest id are all responses. An empty table gives no archive.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    keys = rows.select("page_id", F.octet_length("html").cast("bigint").alias("size"), F.sha1("html").alias("sha"))
    keys = keep(keys.where(F.col("size") >= min_revisit_bytes), f"{folder}/keys")
    groups = keys.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    later = keys.join(keep(groups, f"{folder}/groups"), "sha").where("page_id IS NULL OR page_id > first")
    # revisits need no payload: they are matched by page and digest, so that other rows of the page stay as they are
    later = keep(later.select("page_id", "sha", "first").distinct(), f"{folder}/revisits")
    small = later.count() <= BROADCAST_IDS // 4
    marked = rows.withColumn("sha", F.sha1("html")).alias("r").join((F.broadcast(later) if small else later).alias("l"), F.expr("r.sha = l.sha AND r.page_id <=> l.page_id"), "left")
    marked = marked.select("r.page_id", "r.url", F.octet_length("r.html").cast("bigint").alias("size"), "r.sha", F.col("first").alias("refers_to"), F.when(F.col("first").isNull(), F.col("r.html")).alias("html"))
    archives = f"{folder}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for whole in batches:
            for batch in pieces(whole, "html"):
                for page, url, size, sha, refers, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    archive = archive or Archive(archives, date)
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    archive.add(record(page, url, text.encode() if text is not None else None, size, digest, refers, date))
                    if archive.size >= ARCHIVE_BYTES:
                        done.append(archive.close())
                        archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["file", "records"])

    return keep(marked.mapInArrow(run, "file string, records bigint"), f"{folder}/manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per response and revisit of the archives: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    A response's length and digest are taken of the payload that was read; it
    is an error if its header differs.
    """
    archives = f"{folder}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows: list[tuple] = []
                for fields, block in read_archive(archives, name):
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x for x in http.lower().split(b"\r\n") if x.startswith(b"content-length:"))[15:])
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
                        raise ValueError(f"a payload of {name} is damaged")
                    to_int = lambda x: int(x) if x is not None else None
                    rows.append((to_int(fields.get("x-page")), size, digest, fields["warc-type"], to_int(fields.get("x-refers-to-page"))))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spread = manifest.select("file").repartition(partitions(manifest.sparkSession), "file")
    return spread.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark)
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder)


OP10_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS lead FROM p),
b AS (SELECT *, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST(list_sum(list_transform(range(0, 5), lambda j:
          (((('0x' || substr(sha, 1 + (5 * i + j) // 4, 1))::INTEGER) >> (3 - (5 * i + j) % 4)) & 1) * (1 << (4 - j)))) AS INTEGER), 1)),
        lambda x, y: x || y) AS digest FROM f)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM b
"""
