"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: The unicode classes that search keeps, and where a title's core ends.
NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]"
CORE_END = r"[：:（(【\[]"
#: Two-character words that say nothing of a book.
STOP_PAIRS = """
我们 你们 他们 这个 那个 一个 什么 就是 因为 所以 但是 如果 可以 没有 不是 已经 自己 这种 这样 以及 对于 进行 需要 可能 时候 这里 其中 那些 这些 问题 认为 关系 之后 之前 只是 还是 很多 一些 一种
如何 为什么 其实 非常 现在 发现 开始 能够 通过 方式 部分 一部 根据 有关 相关 方面 一定 不同 而且 并且 或者 应该 虽然 由于 因此 比如 例如 说明 表示 事实 情况 内容 作者 本书 书中 来说 关于 之间 主要 基本
一般 整个 所有 其他 同时 甚至 仍然 如此 当时 后来 最后 第一 第二
""".split()

#: What a title's key goes without: marks, runs of numbers, words for an edition.
TITLE_MARKS = r"[《》〈〉「」『』【】()（）\[\]\s·:：,，.。!！?？\-—_]"
TITLE_NUMBERS = r"第?[一二三四五六七八九十百千万\d]+[册卷部]?"
TITLE_EDITIONS = r"全[一二三四五六七八九十百千万\d]+册|全集|全本|珍藏版|典藏版|精装版|新版|修订版|插图版|青少版|少儿版|人民文学版|电子书"
#: Han characters with their punctuation and symbols, and the marks before which no blank stands.
HAN = r"\x{3000}-\x{303F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
HAN_MARKS = "。，、；：？！“”‘’（）《》【】…—·"


def normalize_search(text: Column) -> Column:
    """Lower case, letters and numbers only."""
    return F.regexp_replace(F.lower(text), NOT_ALNUM, "")


def char_pairs(text: Column) -> Column:
    """All two-character windows in turn, by splitting once: a substring at each place would be quadratic."""
    letters = F.split(text, "")
    n = F.size(letters)
    pairs = F.zip_with(F.slice(letters, F.lit(1), n - 1), F.slice(letters, F.lit(2), n - 1), lambda a, b: F.concat(a, b))
    return F.when(F.char_length(text) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def bigrams(text: Column) -> Column:
    """Distinct two-character windows in order; none for shorter texts."""
    return F.array_sort(F.array_distinct(char_pairs(text)))


def occurrences(text: Column, term: str | Column, most: int = 4) -> Column:
    """Occurrences side by side, ``most`` at most."""
    term = F.lit(term) if isinstance(term, str) else term
    n = F.char_length(term)
    return F.least(F.lit(most), F.floor((F.char_length(text) - F.char_length(F.replace(text, term, F.lit("")))) / F.when(n > 0, n))).cast("bigint")


def contains_folded(text: Column, part: str) -> Column:
    """Whether the text has ``part``, ASCII letters of either case."""
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(part.lower()))


def core_title(title: Column) -> Column:
    """The title before a bracket or colon."""
    return F.trim(F.element_at(F.split(title, CORE_END), 1))


def snippet(text: Column, most: int = 160) -> Column:
    short = F.trim(text)
    return F.when(F.char_length(short) > most, F.concat(F.substring(short, 1, most), F.lit("…"))).otherwise(short)


def normalize_name(name: Column, most: int = 40) -> Column:
    return F.substring(F.trim(F.regexp_replace(name, r"\s+", " ")), 1, most)


@pandas_udf(StringType())
def nfc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical composition, which has no built-in."""
    for x in parts:
        yield x.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def wiki_title(title: Column, compose: bool = True) -> Column:
    """Blanks for underscores, one blank each, first letter upper; composed unless the caller knows it is."""
    t = F.trim(F.regexp_replace(F.replace(title, F.lit("_"), F.lit(" ")), r"\s+", " "))
    t = nfc(t) if compose else t
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))


def page_url(title: Column, base: str) -> Column:
    """Percent-encoded UTF-8; underscores for blanks."""
    x = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.concat(F.lit(base), x)


def isbn(text: Column) -> tuple[Column, Column]:
    """ISBN-10 and ISBN-13 of a text without what is no letter or digit."""
    x = F.upper(F.regexp_replace(text, "[^0-9A-Za-z]", ""))
    return F.when(F.char_length(x) == 10, x), F.when(F.char_length(x) == 13, x)


def when_text(seconds: Column) -> Column:
    """Epoch seconds in the session's time zone; empty if null."""
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if lengths differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def reader_id(book_id: Column) -> Column:
    """The id of a book in reader addresses: parts of the MD5 around the id in hex, padded, with a checksum.

    Digits go in groups of nine, other ids as the code points of their characters.
    """
    digest, text = F.md5(book_id), F.coalesce(book_id, F.lit(""))
    digits = text.rlike("^[0-9]*$")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.char_length(text), F.lit(1)) - 1) / 9).cast("int")), lambda i: F.lower(F.conv(F.substring(text, i * 9 + 1, F.lit(9)), 10, 16)))
    letters = F.array(F.array_join(F.transform(F.split(text, ""), lambda c: F.lower(F.hex(F.ascii(c)))), ""))
    parts = F.when(digits, groups).otherwise(letters)
    body = F.array_join(F.transform(parts, lambda p: F.concat(F.lpad(F.lower(F.hex(F.char_length(p))), 2, "0"), p)), "g")
    whole = F.concat(F.substring(digest, 1, 3), F.when(digits, "3").otherwise("4"), F.lit("2"), F.substring(digest, 31, 2), body)
    padded = F.concat(whole, F.substring(digest, F.lit(1), F.greatest(F.lit(0), 20 - F.char_length(whole))))
    return F.concat(padded, F.substring(F.md5(padded), 1, 3))


def title_key(title: Column) -> Column:
    """A work's name without marks, then without numbers of volumes, then without words for an edition."""
    x = F.lower(title)
    for what in (TITLE_MARKS, TITLE_NUMBERS, TITLE_EDITIONS):
        x = F.regexp_replace(x, what, "")
    return x


def clean_cjk_space(text: Column) -> Column:
    """No blanks between Han characters, before Han punctuation, or between it and a Han character."""
    return F.regexp_replace(text, rf"(?<=[{HAN}{HAN_MARKS}]) +(?=[{HAN}])| +(?=[{HAN_MARKS}])", "")


def graph_words(text: Column) -> Column:
    """Words of a relation graph, repeated ones too: pairs of Han characters but those that say nothing, then Latin words of three letters or more."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{P}\p{S}\d]+", " ")
    runs = F.regexp_extract_all(clean, F.lit(r"[\u3400-\u9fff]{2,}"), F.lit(0))
    pairs = F.filter(F.flatten(F.transform(runs, char_pairs)), lambda w: ~w.isin(STOP_PAIRS))
    return F.concat(pairs, F.regexp_extract_all(clean, F.lit("[a-z]{3,}"), F.lit(0)))


def same_work(a: Column, b: Column) -> Column:
    """Whether two titles' keys (``title_key``) of three characters or more are equal, or of four or more one within the other."""
    n = F.least(F.char_length(a), F.char_length(b))
    return (n >= 3) & ((a == b) | ((n >= 4) & (F.contains(a, b) | F.contains(b, a))))


def version_key(title: Column) -> Column:
    """The title up to a bracket or colon, without title marks and blanks; null if shorter than three characters."""
    x = F.element_at(F.split(F.regexp_replace(F.lower(title), "[《》 ]", ""), r"[（(:：]"), 1)
    return F.when(F.char_length(x) >= 3, x)


def search_key(title: Column, compose: bool = True) -> Column:
    return F.lower(wiki_title(title, compose))


def split_list(text: Column, marks: str = r"[/,、·]") -> Column:
    """The parts between the marks, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), marks), lambda x: F.trim(x)), lambda x: x != "")


def translators(raw: Column) -> Column:
    """Names of a JSON list of strings, or of a text with 、 , or / between them."""
    listed = F.from_json(raw, "array<string>")
    return F.when(F.startswith(F.trim(raw), F.lit("[")), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(split_list(raw, "[、,/]"))


def highlighted(query: Column) -> Column:
    """What a page marks of a query: its words, and the pairs of characters of words of three letters or more, longest first, else as they come."""
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    plain = F.filter(F.transform(words, lambda w: F.regexp_replace(w, NOT_ALNUM, "")), lambda w: F.char_length(w) > 2)
    each = F.concat(words, F.flatten(F.transform(plain, char_pairs)))
    placed = F.transform(each, lambda t, i: F.struct((-F.char_length(t)).alias("n"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(placed), lambda x: x["t"])


def first_line_title(text: Column, most: int = 60) -> Column:
    """The first line that is no page number or page header, cut; null if there is none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    told = F.filter(lines, lambda x: ~F.rlike(F.regexp_replace(x, r"\s", ""), F.lit("^([0-9]*|第[0-9页]*页)$")))
    return F.substring(F.get(told, F.lit(0)), 1, most)
