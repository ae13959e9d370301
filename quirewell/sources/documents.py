"""Document sources: encyclopedia dumps, EPUB, PDF and HTML, and the checks before them."""

from __future__ import annotations

import bz2
import html
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from ipaddress import ip_address
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits of archives and pages, containers that are dropped, bytes of a batch of pages, and tags that end a line.
MAX_FILE, MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL, MAX_PAGE_TEXT, MIN_CHAPTER = 200 << 20, 5000, 8 << 20, 256 << 20, 4 << 20, 20
DROPPED = {"script", "style", "noscript", "head", "title", "nav", "header", "footer", "aside", "iframe", "svg"}
BATCH_BYTES = 512 << 10
LINES = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article", "blockquote", "pre"}

PAGE = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("ns", T.LongType()), T.StructField("id", T.LongType()),
    T.StructField("redirect", T.StructType([T.StructField("_title", T.StringType())])),
    T.StructField("revision", T.StructType([T.StructField("id", T.LongType()), T.StructField("timestamp", T.StringType()), T.StructField("text", T.StructType([T.StructField("_VALUE", T.StringType())]))])),
])


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a dump (XML, bz2 or plain): splittable, with a fixed schema; other namespaces and oversized pages are left out."""
    raw = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(PAGE).load(path)
    pages = raw.where("ns = 0").select(
        F.col("id").alias("page_id"), F.col("title").alias("raw_title"), F.col("redirect._title").alias("redirect_title"),
        F.col("revision.id").alias("revision_id"), F.unix_timestamp(F.col("revision.timestamp").cast("timestamp")).alias("revised_at"), F.col("revision.text._VALUE").alias("text"),
    )
    return pages.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_PAGE_TEXT)


#: Bytes that a dump may produce, how many times its own size, and how often that is looked at.
MOST_PRODUCED, MOST_RATIO, LOOK = 64 << 30, 200, 32 << 20
#: Columns of a guarded dump: a page, or an issue where ``issue`` isn't null.
DUMP = "path string, page_id bigint, raw_title string, redirect_title string, revision_id bigint, revised_at string, text string, issue string"
_FIELD = {
    "raw_title": rb"<title>([^<]*)</title>", "page_id": rb"<id>(\d+)</id>", "redirect_title": rb'<redirect title="([^"]*)"', "ns": rb"<ns>(-?\d+)</ns>",
    "revision_id": rb"<revision>\s*<id>(\d+)</id>", "revised_at": rb"<timestamp>([^<]*)</timestamp>",
}
_FIELD = {k: re.compile(v) for k, v in _FIELD.items()}
_TEXT = re.compile(rb"<text[^>]*>")


def _page_text(page: bytes) -> bytes | None:
    m = _TEXT.search(page)
    end = page.find(b"</text>", m.end()) if m and not m[0].endswith(b"/>") else -1
    return page[m.end() : end] if end >= 0 else None


class Guard:
    """Chunks of an archive, counted as they go in and come out; ends with a ``reason`` where too much comes out or it can't be read."""

    def __init__(self, most: int = MOST_PRODUCED, ratio: float = MOST_RATIO, look: int = LOOK) -> None:
        self.most, self.ratio, self.look, self.reason = most, ratio, look, None
        self.came = self.produced = 0

    def _unpacked(self, read, size: int) -> Iterator[bytes]:
        """bz2, several streams one after another too, ``size`` bytes at most at once."""
        unpack = bz2.BZ2Decompressor()
        while True:
            data = b""
            if unpack.eof and unpack.unused_data:
                data, unpack = unpack.unused_data, bz2.BZ2Decompressor()
            elif unpack.eof or unpack.needs_input:
                data = read(size)
                if not data:
                    self.reason = None if unpack.eof else "unreadable"
                    return
                self.came += len(data)
                unpack = bz2.BZ2Decompressor() if unpack.eof else unpack
            try:
                yield unpack.decompress(data, size)
            except OSError:
                self.reason = "unreadable"
                return

    def _plain(self, read, size: int) -> Iterator[bytes]:
        while data := read(size):
            self.came += len(data)
            yield data

    def chunks(self, read, packed: bool, size: int = 1 << 20) -> Iterator[bytes]:
        """What ``read`` gives, unpacked if it is ``packed``."""
        seen = 0
        for out in (self._unpacked if packed else self._plain)(read, size):
            self.produced += len(out)
            if self.produced > self.most:
                self.reason = "too much comes out"
                return
            if self.produced - seen >= self.look:
                seen = self.produced
                if self.produced > self.ratio * self.came:
                    self.reason = "too much comes out of little"
                    return
            if out:
                yield out


def dump_pages(chunks: Iterator[bytes], most: int) -> Iterator[dict]:
    """Articles of a stream of XML; a page with more than ``most`` bytes of text is an issue, and no more of it than that is held."""
    rest, at, skipping = b"", 0, None
    room = most + (1 << 16)
    for chunk in chunks:
        rest, at = rest[at:] + chunk, 0
        while True:
            if skipping is not None:
                end = rest.find(b"</page>", at)
                if end < 0:
                    at = max(at, len(rest) - 6)
                    break
                at, page = end + 7, skipping
                skipping = None
                yield page
                continue
            begin = rest.find(b"<page>", at)
            if begin < 0:
                at = max(at, len(rest) - 5)
                break
            end = rest.find(b"</page>", begin)
            size = (end if end >= 0 else len(rest)) - begin
            if end < 0 and size <= room:
                at = begin
                break
            whole = rest[begin : begin + min(size, room)]
            found = {k: (m[1] if (m := p.search(whole)) else None) for k, p in _FIELD.items()}
            found["text"] = _page_text(whole)
            plain = {k: html.unescape(v.decode("utf-8", "replace")) if v is not None else None for k, v in found.items()}
            page = {k: int(v) if v is not None and k in ("page_id", "ns", "revision_id") else v for k, v in plain.items()}
            big = end < 0 or len(found["text"] or b"") > most or size > room
            page |= {"issue": "oversized", "text": None} if big else {"issue": None, "text": page["text"] or ""}
            if page.pop("ns") != 0:
                page = None
            if end < 0:
                at, skipping = len(rest) - 6, page or {}  # its end may have begun
                continue
            at = end + 7
            if page:
                yield page


def read_guarded_dump(spark: SparkSession, path: str, most_page: int = MAX_PAGE_TEXT, most: int = MOST_PRODUCED, ratio: float = MOST_RATIO, look: int = LOOK) -> DataFrame:
    """Articles of dumps that aren't trusted, and what is wrong with them as rows beside them (``issue``).

    Each file is streamed by one task, so memory doesn't grow with it: a page
    with more than ``most_page`` bytes of text is an issue (oversized), as is a
    file of which more than ``most`` bytes or ``ratio`` times its own size come
    out, or that can't be unpacked; what came before stays. There are as many
    tasks as files. For trusted dumps ``read_dump`` splits files over tasks.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    tasks = max(1, files.count())  # without a number small partitions are put together, and paths are small

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.fs as pafs

        kinds = {"string": pa.string(), "bigint": pa.int64()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in DUMP.split(", "))])
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                fs, at = pafs.FileSystem.from_uri(uri)
                guard = Guard(most, ratio, look)
                rows, size = [], 0
                with fs.open_input_stream(at, compression=None) as f:
                    for page in dump_pages(guard.chunks(f.read, at.endswith(".bz2")), most_page):
                        if page:
                            rows.append({"path": uri, **page})
                            size += len(page["text"] or "")
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if guard.reason:
                    rows.append({"path": uri, "issue": guard.reason})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.repartitionByRange(tasks, "path").mapInArrow(run, DUMP)


def file_gate(files: DataFrame) -> DataFrame:
    """``path, kind, fingerprint`` of binary files that may be imported: by extension and first bytes, 200 MB at most."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    magic = F.substring("content", 1, 4)
    kind = F.when((ext == "pdf") & (magic == F.lit(b"%PDF")), "pdf").when((ext == "epub") & (F.substring("content", 1, 2) == F.lit(b"PK")), "epub")
    return files.where(F.col("length") <= MAX_FILE).select("path", kind.alias("kind"), F.md5("content").alias("fingerprint")).where("kind IS NOT NULL")


def allowed_url(url: str) -> bool:
    """HTTPS to a public host: no private, loopback or shortened addresses."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return False
    if parts.scheme != "https" or not host or host == "localhost" or host.endswith((".localhost", ".local", ".internal")):
        return False
    try:
        return ip_address(host).is_global
    except ValueError:
        return not re.fullmatch(r"(0x[0-9a-f]+|\d+)(\.(0x[0-9a-f]+|\d+))*", host.lower())


class _Lines(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.inside.append(tag)
        elif tag in LINES:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass
        elif tag in LINES:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.inside:
            self.out.append(data)


def clean_text(text: str) -> str:
    """Single blanks, and two line ends at most."""
    lines = [re.sub(r"[^\S\n]+", " ", x).strip() for x in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_text(source: str | None) -> str:
    p = _Lines()
    p.feed(source or "")
    p.close()
    return clean_text("".join(p.out))


def html_documents(pages: DataFrame) -> DataFrame:
    """``page_id, title, text`` of ``page_id, html``.

    From here on the session's Arrow batches hold BATCH_BYTES each: with Spark's
    10000 rows or 64 MB a worker's memory grows with the pages up to these.
    """
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            text = pa.array([html_text(x) for x in b.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("title"), text], names=["page_id", "title", "text"])

    return pages.select("page_id", html_title(F.col("html")).alias("title"), "html").mapInArrow(run, "page_id bigint, title string, text string")


def html_title(source: Column) -> Column:
    """The first of title, og:title and h1 that isn't blank, as written."""
    found = [F.trim(F.regexp_replace(F.regexp_extract(source, p, 1), r"<[^>]*>|\s+", " ")) for p in (r"(?is)<title[^>]*>(.*?)</title>", r"""(?is)<meta[^>]*property=["']og:title["'][^>]*content=["']([^"']*)""", r"(?is)<h1[^>]*>(.*?)</h1>")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def epub_chapters(content: bytes) -> list[tuple[int, str]]:
    """Text of the spine's items in order; an error beyond the limits."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        entries = z.infolist()
        if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_TOTAL:
            raise ValueError("the archive is too large")
        read = lambda name: z.read(name) if z.getinfo(name).file_size <= MAX_ENTRY else b""
        if read("mimetype").strip() != b"application/epub+zip":
            raise ValueError("no EPUB")
        root = re.search(rb'full-path="([^"]+)"', read("META-INF/container.xml"))[1].decode()
        package = read(root).decode("utf-8", "replace")
        tags = [dict(re.findall(r'([\w:-]+)="([^"]*)"', t)) for t in re.findall(r"<item\b[^>]*>", package)]
        items = {t["id"]: html.unescape(t["href"]) for t in tags if "id" in t and "href" in t}
        base = root.rpartition("/")[0]
        out = []
        for ref in re.findall(r'<itemref\b[^>]*idref="([^"]+)"', package):
            name = f"{base}/{items.get(ref, '')}".lstrip("/")
            if name in z.namelist():
                text = html_text(read(name).decode("utf-8", "replace"))
                if len(text) >= MIN_CHAPTER:
                    out.append((len(out), text))
        return out


def _pdf_string(raw: bytes) -> str:
    plain = re.sub(rb"\\([nrtbf()\\]|[0-7]{1,3})", lambda m: {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1]), raw)
    return plain.decode("utf-16") if plain.startswith((b"\xfe\xff", b"\xff\xfe")) else plain.decode("latin-1")


def pdf_pages(content: bytes) -> list[tuple[int, str]]:
    """Text of the content streams, one by one: Flate or plain, shown by Tj, TJ and quotes."""
    if not content.startswith(b"%PDF-"):
        raise ValueError("no PDF")
    if b"/Encrypt" in content:
        raise ValueError("the PDF is encrypted")
    out = []
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", content, re.S):
        data = m[2]
        if b"FlateDecode" in m[1]:
            try:
                data = zlib.decompressobj().decompress(data, MAX_TOTAL)
            except zlib.error:
                continue
        parts = []
        for t in re.finditer(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[((?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ|(T\*|T[dD]\b|ET\b)", data, re.S):
            if t[1] is not None:
                parts.append(_pdf_string(t[1]))
            elif t[2] is not None:
                parts += [_pdf_string(x) for x in re.findall(rb"\(((?:\\.|[^\\()])*)\)", t[2])]
            else:
                parts.append("\n")
        text = clean_text("".join(parts))
        if text:
            out.append((len(out), text))
    return out


def file_documents(files: DataFrame) -> DataFrame:
    """``path, position, text, error`` of binary files that pass ``file_gate``: a row for each chapter or page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, kind, content in f.itertuples(index=False):
                try:
                    rows += [(path, i, t, None) for i, t in (pdf_pages if kind == "pdf" else epub_chapters)(content)]
                except (ValueError, KeyError, TypeError, zipfile.BadZipFile) as e:
                    rows.append((path, 0, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "position", "text", "error"])

    passed = files.join(file_gate(files).select("path", "kind"), "path").select("path", "kind", "content")
    return passed.mapInPandas(run, "path string, position int, text string, error string")


def garbled(text: Column) -> Column:
    """Whether too little of a text is printable, or too much of it replaced or control characters."""
    n = F.char_length(text).cast("double")
    bad = F.regexp_count(text, F.lit("�"))
    control = F.regexp_count(text, F.lit(r"[\p{Cntrl}&&[^\n\r\t]]"))
    return (n > 0) & (((n - bad - control) / n < 0.80) | (bad / n > 0.05) | (control / n > 0.10))


def manifest(lines: DataFrame) -> DataFrame:
    """``md5, file`` of a checksum manifest's lines."""
    m = lambda i: F.regexp_extract("value", r"^([0-9a-fA-F]{32})\s+\*?(\S+)\s*$", i)
    return lines.select(F.lower(m(1)).alias("md5"), m(2).alias("file")).where("md5 <> ''")
