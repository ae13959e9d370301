"""Sources on files made here."""

import bz2
import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quirewell.sources import documents as D

DUMP = """<mediawiki><page><title>A</title><ns>0</ns><id>1</id><revision><id>9</id><timestamp>2026-09-01T02:03:04Z</timestamp><text> some text </text></revision></page>
<page><title>B</title><ns>0</ns><id>2</id><redirect title="A"/><revision><id>8</id><timestamp>2026-09-01T02:03:04Z</timestamp><text>#R</text></revision></page>
<page><title>T</title><ns>10</ns><id>3</id><revision><id>7</id><text>x</text></revision></page></mediawiki>"""


def epub(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<rootfile full-path="o/p.opf"/>')
        z.writestr("o/p.opf", '<item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/><itemref idref="b"/><itemref idref="a"/>')
        z.writestr("o/a.xhtml", f"<p>{text}</p>")
        z.writestr("o/b.xhtml", "<p>short</p>")
    return out.getvalue()


def test_dump(spark, tmp_path):
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(DUMP.encode()))
    got = {r["page_id"]: r for r in D.read_dump(spark, str(tmp_path / "d.xml.bz2")).collect()}
    assert set(got) == {1, 2} and got[1]["text"] == " some text " and got[2]["redirect_title"] == "A" and got[1]["revised_at"] == 1788228184


def test_files(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub("a chapter that is long enough"))
    stream = zlib.compress(b"BT (Hello \\(pdf\\)) Tj T* [(wor) -20 (ld)] TJ ET")
    (tmp_path / "b.pdf").write_bytes(b"%%PDF-1.4\n1 0 obj << /Filter /FlateDecode /Length %d >>\nstream\n" % len(stream) + stream + b"\nendstream endobj")
    (tmp_path / "c.pdf").write_bytes(b"no pdf")
    rows = D.file_documents(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted(r["text"] for r in rows) == ["Hello (pdf)\nworld", "a chapter that is long enough"]


@pytest.mark.parametrize("url,ok", [("https://example.org/a", True), ("http://example.org", False), ("https://127.0.0.1", False), ("https://127.1", False), ("https://10.0.0.1/", False), ("https://[::1]/", False), ("https://localhost", False), ("https://8.8.8.8", True)])
def test_urls(url, ok):
    assert D.allowed_url(url) is ok


def test_html(spark):
    assert D.html_text("<p>a &amp; b</p><script>'</p>'</script><nav>x</nav><div>c   d</div>") == "a & b\n\nc d"
    df = spark.createDataFrame([(1, "<title> T </title><h1>H</h1>"), (2, "<h1>H</h1>")], "page_id bigint, html string")
    assert [r["title"] for r in D.html_documents(df).orderBy("page_id").collect()] == ["T", "H"]


def test_garbled_and_manifest(spark):
    df = spark.createDataFrame([("plain",), ("��ab",)], "t string")
    assert [r[0] for r in df.select(D.garbled(F.col("t"))).collect()] == [False, True]
    lines = spark.createDataFrame([("0" * 32 + "  a.bz2",), ("no",)], "value string")
    assert [tuple(r) for r in D.manifest(lines).collect()] == [("0" * 32, "a.bz2")]


def _page(i, text, ns=0):
    return f"<page><title>T{i} &amp; &lt;b&gt;</title><ns>{ns}</ns><id>{i}</id><revision><id>{i + 100}</id><timestamp>2024-01-01T00:00:00Z</timestamp><text>{text}</text></revision></page>\n"


def test_guarded_dump(spark, tmp_path):
    """Oversized pages and archives of which too much comes out are rows beside what is good."""
    import bz2

    good = "<mediawiki>" + _page(1, "one &amp; two\n") + _page(2, "x" * 90_000) + _page(3, "other", 10) + "<page><title>T4</title><ns>0</ns><id>4</id><revision><id>5</id><text/></revision></page>" + _page(5, "five") + "</mediawiki>"
    half = len(good) // 2
    (tmp_path / "good.xml.bz2").write_bytes(bz2.compress(good[:half].encode()) + bz2.compress(good[half:].encode()))
    (tmp_path / "plain.xml").write_text(_page(6, "six"))
    (tmp_path / "bomb.xml.bz2").write_bytes(bz2.compress((_page(7, "seven") + " " * 6_000_000 + _page(8, "never")).encode()))
    (tmp_path / "broken.xml.bz2").write_bytes(bz2.compress(_page(9, "y" * 10).encode())[:-8] + b"no archive")
    rows = D.read_guarded_dump(spark, str(tmp_path), most_page=1000, ratio=50, look=2 << 20).collect()
    got = {(r["path"].rsplit("/", 1)[1], r["page_id"]): (r["text"], r["issue"]) for r in rows}
    want = {("good.xml.bz2", 1): ("one & two\n", None), ("good.xml.bz2", 2): (None, "oversized"), ("good.xml.bz2", 4): ("", None), ("good.xml.bz2", 5): ("five", None), ("plain.xml", 6): ("six", None), ("bomb.xml.bz2", 7): ("seven", None), ("bomb.xml.bz2", None): (None, "too much comes out of little")}
    assert {k: v for k, v in got.items() if not k[0].startswith("broken")} == want
    assert got["broken.xml.bz2", None] == (None, "unreadable")
    assert next(r["raw_title"] for r in rows if r["page_id"] == 1) == "T1 & <b>"
    few = D.read_guarded_dump(spark, f"{tmp_path}/good.xml.bz2", most_page=1000, most=50_000).collect()
    assert [r["issue"] for r in few if r["page_id"] is None] == ["too much comes out"]


def test_long_page_is_not_held():
    """A page of which the text never ends is read past in bounded memory."""
    chunks = iter([b"<page><title>a</title><ns>0</ns><id>1</id><revision><id>2</id><text>", *[b"z" * 1000] * 500, b"</te", b"xt></revision></pa", b"ge>", _page(2, "two").encode()])
    assert [(p["page_id"], p["issue"]) for p in D.dump_pages(chunks, 2000)] == [(1, "oversized"), (2, None)]
