"""Main text of web pages by paths that the pages of a host agree on.

Each page scores its containers by the text that stands in them; the best one's
generalised path (tags and classes from the root, digits made equal) is a vote.
Votes are counted per host in Spark, and every page is extracted again along the
winning paths of its host.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, pieces, work_dir

#: A path wins if it has this share of its host's votes; pages without a winning path use their own.
WIN_SHARE = 0.05
#: Elements of a path that are spelled out, from the innermost up.
MOST_DEEP = 64
#: Bytes of hosts and winning paths that may be broadcast.
BROADCAST_BYTES = 8 << 20

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noframes noembed".split())
DROP = frozenset("head nav footer aside form button select option datalist fieldset svg math canvas object audio video picture dialog menu map".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the first ends an open element of the second, up to the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCK - {"br", "body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "summary", "figcaption"}
#: An inline end tag ends nothing outside the innermost of these.
SCOPE = frozenset("article body main section div table td button".split())
#: Words of classes, ids and roles of what is no article.
OTHER = frozenset(
    "nav navbar navigation menu footer contentinfo sidebar aside complementary widget cookie cookies consent gdpr notice notification banner alert popup modal overlay"
    " newsletter subscribe subscription signup promo promotion advert adverts advertisement ad ads adsense sponsor sponsored share sharing social related recommended"
    " recommendations comment comments commentlist disqus respond replies reply breadcrumb breadcrumbs pagination pager login search searchbox form toolbar masthead topbar".split()
)
HEADER = frozenset("header masthead banner".split())
KEEP = frozenset("html body main article".split())
GOOD = re.compile(r"article|content|entry|main|post|story|text|body", re.I)
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Page:
    """Elements of a page in arrays, and its texts in order."""

    def __init__(self, source: str) -> None:
        self.tag, self.name, self.parent, self.drop, self.other, self.good = ["#root"], [""], [-1], [False], [False], [False]
        self.inside, self.depth = [False], [0]  # of an article or main, and number of ancestors
        self.texts: list[tuple[int, str]] = []  # of an element; a None text is a break
        self._parse(source)
        if any(self.other):
            self._drop_other()

    def _open(self, at: int, tag: str, attributes: str) -> int:
        name, other, hidden, good = tag, False, False, False
        if attributes and attributes != "/":
            words: list[str] = []
            for k, a, b, c in ATTRIBUTE.findall(attributes):
                k, v = k.lower(), a or b or c
                if k == "class" and v:
                    name = tag + "".join("." + re.sub(r"\d+", "#", x) for x in sorted(html.unescape(v).split()))
                if k in ("class", "id", "role"):
                    words += [x.lower() for x in WORDS.findall(v)]
                    good = good or bool(GOOD.search(v))
                elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
                    hidden = True
            other = not OTHER.isdisjoint(words) or (not HEADER.isdisjoint(words) and not self._within_article(at))
        if tag in KEEP:
            other = False
        self.tag.append(tag)
        self.name.append(name)
        self.inside.append(self.inside[at] or self.tag[at] in ("article", "main"))
        self.depth.append(self.depth[at] + 1)
        self.parent.append(at)
        self.good.append(good)
        self.other.append(other)
        self.drop.append(self.drop[at] or tag in DROP or hidden or (tag == "header" and not self._within_article(at)))
        return len(self.tag) - 1

    def _drop_other(self) -> None:
        """Containers go by their words, but for those around main, or around the largest article if every article would go; if no text were left, none goes."""
        hard, n = self.drop, len(self.tag)
        size = [0] * n
        for at, text in self.texts:
            if not hard[at]:
                size[at] += len(text.strip())
        for x in range(n - 1, 0, -1):
            size[self.parent[x]] += size[x]
        spared: set[int] = set()

        def spare(x: int) -> None:
            while x > 0:
                spared.add(x)
                x = self.parent[x]

        def dropped() -> list[bool]:
            drop = [False] * n
            for x in range(1, n):
                drop[x] = hard[x] or drop[self.parent[x]] or (self.other[x] and x not in spared)
            return drop

        found = [x for x in range(n) if self.tag[x] in ("article", "main") and size[x]]
        for x in found:
            if self.tag[x] == "main":
                spare(x)
        self.drop = dropped()
        if found and all(self.drop[x] for x in found):
            spare(max(found, key=lambda x: (size[x], -x)))
            self.drop = dropped()
        if not any(text.strip() and not self.drop[at] for at, text in self.texts):
            self.drop = hard

    def _within_article(self, at: int) -> bool:
        return self.inside[at] or self.tag[at] in ("article", "main")

    def path(self, at: int) -> str:
        """The generalised path of an element from the root; beyond MOST_DEEP elements their digest stands for the upper ones."""
        names = []
        while at > 0:
            names.append(self.name[at])
            at = self.parent[at]
        names.reverse()
        if len(names) > MOST_DEEP:
            above = hashlib.blake2b(">".join(names[:-MOST_DEEP]).encode(), digest_size=8).hexdigest()
            names = ["#" + above, *names[-MOST_DEEP:]]
        return "".join(">" + x for x in names)

    def having(self, paths: list[str]) -> tuple[str | None, set[int]]:
        """The first of the paths that the page has, and the elements it leads to."""
        ends = {(p.rpartition(">")[2], min(p.count(">"), MOST_DEEP + 1)) for p in paths}
        at: dict[str, set[int]] = {}
        for x in range(1, len(self.tag)):
            if (self.name[x], min(self.depth[x], MOST_DEEP + 1)) in ends:
                at.setdefault(self.path(x), set()).add(x)
        found = next((p for p in paths if p in at), None)
        return found, at.get(found, set())

    def _close(self, at: int, tags: set[str] | frozenset[str], until: set[str]) -> int:
        """The parent of the outermost open element of ``tags`` below ``until``."""
        found, x = at, at
        while x > 0 and self.tag[x] not in until:
            if self.tag[x] in tags:
                found = self.parent[x]
            x = self.parent[x]
        return found

    def _parse(self, source: str) -> None:
        """Read the tags. What is open is counted, for the page and for the innermost container, so that no end tag is looked for in vain."""
        at = pos = 0
        whole, texts = len(source), self.texts
        n = source.rfind(">") + 1  # no tag ends beyond it
        count: Counter[str] = Counter()
        scopes: list[Counter[str]] = [Counter()]

        def leave(x: int, to: int) -> int:
            while x != to:
                t = self.tag[x]
                count[t] -= 1
                if t in SCOPE:
                    scopes.pop()
                else:
                    scopes[-1][t] -= 1
                x = self.parent[x]
            return to

        def enter(x: int, t: str, attributes: str) -> int:
            count[t] += 1
            if t in SCOPE:
                scopes.append(Counter())
            else:
                scopes[-1][t] += 1
            return self._open(x, t, attributes)

        while pos < n:
            m = TOKEN.search(source, pos, n)
            if m is None:
                break
            if m.start() > pos:
                texts.append((at, source[pos : m.start()]))
            pos = m.end()
            tag = m[2]
            if not tag:
                if m[0].startswith("<![CDATA["):
                    texts.append((at, html.escape(m[0][9:].removesuffix("]]>"))))
                    pos = pos if m[0].endswith("]]>") else whole
                elif m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")) and len(m[0]) > 5:
                    pos = whole
                continue
            tag = tag.lower()
            if m[1]:
                if (count if tag in BLOCK else scopes[-1])[tag] > 0 or tag in SCOPE and count[tag] > 0:
                    x = at
                    while self.tag[x] != tag:
                        x = self.parent[x]
                    at = leave(at, self.parent[x])
                if tag in BLOCK:
                    texts.append((at, ""))
                continue
            if tag in ENDS_P and scopes[-1]["p"] > 0:
                at = leave(at, self._close(at, {"p"}, SCOPE))
            if tag in ENDS and any(count[t] > 0 for t in ENDS[tag][0]):
                at = leave(at, self._close(at, *ENDS[tag]))
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, pos)
                pos = end.end() if end else whole
                continue
            if tag in BLOCK:
                texts.append((at, ""))
            if tag not in VOID and not m[3].endswith("/"):
                at = enter(at, tag, m[3])
            elif tag not in VOID and tag in BLOCK:
                at = enter(at, tag, m[3][:-1])  # HTML knows no <div/>
            if tag in BLOCK:
                texts.append((at, ""))
        if pos < whole:  # a comment or declaration that is never closed takes the rest
            rest = source[pos:]
            texts.append((at, rest if "<!" not in rest else rest[: rest.index("<!")]))

    def best(self) -> int:
        """The container with most article text: 0, the root, if there is none."""
        score: dict[int, float] = {}
        links: dict[int, float] = {}
        for at, text in self.texts:
            size = len(text.strip())
            if not size or self.drop[at]:
                continue
            linked, x = False, at
            while x > 0 and self.tag[x] not in BLOCK:
                linked = linked or self.tag[x] == "a"
                x = self.parent[x]
            if self.tag[x] in ("p", "li", "td", "pre", "blockquote", "dd", "h1", "h2", "h3", "h4", "h5", "h6") and self.parent[x] >= 0:
                x = self.parent[x]
            for share in (1.0, 0.5, 0.25):
                score[x] = score.get(x, 0.0) + (0 if linked else size * share)
                links[x] = links.get(x, 0.0) + (size * share if linked else 0)
                x = self.parent[x]
                if x < 0:
                    break
        if not score:
            return 0
        worth = lambda x: score[x] * score[x] / (score[x] + links[x] + 1e-9) * (1.3 if self.tag[x] in ("article", "main") or self.good[x] else 1)
        top = max(score, key=lambda x: (worth(x), -x))
        for wanted in ("article", "main"):
            x = top
            while x > 0:
                if self.tag[x] == wanted:
                    return x
                x = self.parent[x]
        return top

    def text(self, inside: set[int]) -> str:
        """The text in these elements: blocks in page order, each with single spaces, joined by one."""
        member = [False] * len(self.tag)
        for x in range(len(self.tag)):
            member[x] = x in inside or (x > 0 and member[self.parent[x]])
        parts = [(t if t else " ") for at, t in self.texts if member[at] and (not self.drop[at] or not t)]
        return " ".join(html.unescape("".join(parts)).split())


def _read(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    # a page without a host in its address votes with those like it
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))


def votes(rows: DataFrame) -> DataFrame:
    """``host, path``: the best container's path for each page that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "html"):
                paths = []
                for source in batch.column("html").to_pylist():
                    page = Page(source)
                    paths.append(page.path(page.best()))
                yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], ["host", "path"])

    return rows.select("host", "html").mapInArrow(run, "host string, path string").where("path <> ''")


def winners(voted: DataFrame) -> DataFrame:
    """``host, paths``: the host's winning paths, most votes first, ties in order.

    A host's votes are summed up apart from its paths, so that a host with very
    many of them makes no large group: only the few that win are gathered.
    """
    home = work_dir(voted.sparkSession)
    counts = keep(voted.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), f"{home}/counts")
    totals = keep(counts.groupBy("host").agg(F.sum("n").alias("all")), f"{home}/totals")
    small = _bytes(totals, F.octet_length("host")) <= BROADCAST_BYTES
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))  # 1 / WIN_SHARE at most
    won = counts.where("path IS NOT NULL").join(F.broadcast(totals) if small else totals, "host").where(F.col("n") >= WIN_SHARE * F.col("all"))
    return won.groupBy("host").agg(ordered.alias("x")).select("host", F.col("x.path").alias("paths"))


def _bytes(rows: DataFrame, each: Column) -> int:
    """About how much memory a broadcast of the rows takes."""
    return rows.agg(F.sum(each + 64)).first()[0] or 0


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars``.

    A page is extracted along the first winning path of its host that it has,
    else from its own best container. Null, empty and tagless html is taken as
    it is; a page without text outside menus and the like has an empty one. Pages with a null url,
    or one without a host, form a host of their own. Repeated rows and null ids
    are kept; other columns are not read. An empty table gives an empty result.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = _read(pages, id_col, url_col, html_col)
    won = keep(winners(votes(rows)), f"{work_dir(pages.sparkSession)}/paths")
    small = _bytes(won, F.octet_length("host") + F.octet_length(F.array_join("paths", " "))) <= BROADCAST_BYTES
    joined = rows.join(F.broadcast(won) if small else won, "host", "left").select("page_id", "url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "html"):
                out = []
                for source, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True):
                    page = Page(source)
                    inside = {x for x in page.having(paths)[1] if not page.drop[x]} if paths else set()
                    text = page.text(inside) if inside else ""
                    out.append(text or page.text({page.best()}))
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
