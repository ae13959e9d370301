"""Plain text and summaries of wiki markup: brackets are resolved from the inside out."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Namespaces whose links show nothing, tags whose content goes, sentence ends, redirect markers.
SILENT = (
    "file", "image", "media", "video", "文件", "檔案", "图像", "圖像", "媒体", "category", "分类", "分類", "categorytree", "主题分类", "mediawiki",
    "template", "模板", "module", "模块", "help", "帮助", "wikipedia",
)
NOTES = (
    "references-list|references|reflist|ref|gallery|imagemap-inline|imagemapframe|imagemap|math|syntaxhighlight|source|pre|nowiki|timeline|score|templatestyles|poem|graph|mapframe|maplink|section"
    "|includeonly|noinclude|onlyinclude|sup|sub"
)
ENDS = "。！？；!?;\n"
REDIRECTS = ("#redirect", "#重定向", "#轉向")

PARAMETER = re.compile(r"\{\{\{([^{}|]*)(?:\|([^{}]*))?\}\}\}")
TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
TABLE = re.compile(r"\{\|(?:(?!\{\||\|\}).)*\|\}", re.S)
NOTE = re.compile(rf"<({NOTES})\b[^<>]*(?<!/)>(?:(?!<(?:{NOTES})\b).)*?</\1\s*>", re.S | re.I)
LINK = re.compile(r"\[\[([^\[\]]*)\]\]")
HEADING = re.compile(r"^=+[^=\n].*?=+[ \t]*$", re.M)


def _shown(m: re.Match) -> str:
    """What a template shows: a few that only mark up their text, else nothing."""
    name, *rest = (x.strip() for x in m[1].split("|"))
    name, plain = name.lower(), [x for x in rest if not re.match(r"[\w-]+\s*=", x)]
    if name == "lang" and len(plain) > 1:
        return plain[1]
    if (name.startswith("lang-") or name in ("nowrap", "nobr", "small")) and plain:
        return plain[0]
    if name in ("birth date", "death date", "start date") and len(plain) >= 3:
        return f"{plain[0]}年{plain[1]}月{plain[2]}日"
    return ""


def _link(m: re.Match) -> str:
    target, _, label = m[1].partition("|")
    if target.strip().lower().lstrip(":").split(":")[0] in SILENT and ":" in target:
        return ""
    return label.rpartition("|")[2] if label else target.split("#")[0]


def _settle(pattern: re.Pattern, put, text: str) -> str:
    """Replace until nothing changes: each round resolves the innermost brackets."""
    while True:
        new = pattern.sub(put, text)
        if new == text:
            return text
        text = new


def plain_text(source: str) -> str:
    """The lead section's text without markup."""
    t = re.sub(r"<!--.*?(?:-->|\Z)", "", source, flags=re.S)
    before = None
    while before != t:  # a table ends only where no template is open: what "{{x|}}" ends is none
        before = t
        t = TABLE.sub("", _settle(TEMPLATE, _shown, _settle(PARAMETER, lambda m: m[2] or "", t)))
    t = re.sub(r"\{[{|].*\Z", "", t, flags=re.S)  # never closed
    head = HEADING.search(t)
    t = t[: head.start()] if head else t
    t = re.sub(rf"<(?:{NOTES})\b[^<>]*/>", "", t, flags=re.I)
    t = _settle(NOTE, "", t)
    t = _settle(LINK, _link, t)
    t = re.sub(r"\[(?:https?:)?//\S+\s+([^\]]*)\]", r"\1", t)
    t = re.sub(r"\[((?:https?:)?//[^\s\]?]*)[^\]]*\]|\[\d+\]", lambda m: m[1] or "", t)
    t = re.sub(r"'{2,}|__[A-Z]+__|<[^<>]*>", "", t)
    t = re.sub(r"^[*#:;]+[ \t]*", "", t, flags=re.M)
    t = html.unescape(t)
    return "\n".join(x for x in (re.sub(r"[^\S\n]+", " ", x).strip() for x in t.split("\n")) if x)


def summarize(source: str | None, least: int = 300, most: int = 600) -> tuple[str, str, float]:
    """Summary, quality (degraded, truncated, short, complete) and the share of the source that was no text.

    Paragraphs are taken until there are ``least`` characters (0: all); beyond
    ``most`` the text ends after its last sentence, or right there if it has none.
    """
    raw = source or ""
    plain = plain_text(raw)
    lost = 1 - len(plain) / max(1, len(raw))
    taken: list[str] = []
    for p in plain.split("\n") if plain else []:
        if taken and least > 0 and len("\n".join(taken)) >= least:
            break
        taken.append(p)
    text = "\n".join(taken)
    cut = len(text) > most
    if cut:
        text = text[:most]
        end = max(text.rfind(c) for c in ENDS)
        text = text[: end + 1] if end >= 0 else text
    n = max(1, len(raw))
    if n > 400 and lost > 0.6 and len(text) * 100 // n < 40:
        return text, "degraded", lost
    return text, "truncated" if cut else "short" if len(text) < least else "complete", lost


def soft_redirect(source: str | None) -> str | None:
    """The target named on a first line that is a redirect marker."""
    line = (source or "").split("\n", 1)[0].strip()
    mark = next((m for m in REDIRECTS if line.lower().startswith(m)), None)
    if mark is None:
        return None
    target = re.split(r"[|#]", line[len(mark) :].strip().removeprefix("[[").removesuffix("]]"))[0].strip()
    return target or None


def summaries(pages: DataFrame, least: int = 300, most: int = 600) -> DataFrame:
    """``page_id, summary, quality, soft_target`` of ``page_id, text``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [summarize(t, least, most) for t in f["text"]]
            yield pd.DataFrame({"page_id": f["page_id"], "summary": [x[0] for x in done], "quality": [x[1] for x in done], "soft_target": [soft_redirect(t) for t in f["text"]]})

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select(F.col("page_id"), F.col("text")).mapInPandas(run, f"page_id {kind}, summary string, quality string, soft_target string")
