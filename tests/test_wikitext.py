"""Wiki markup by kind: what a reader of a rendered lead section would see."""

import time

import pytest

from quirewell.operators.wikitext import plain_text, soft_redirect, summarize

LINKS = [
    ("The [[river]]s meet.", "The rivers meet."),
    ("[[Lake Geneva|The lake]] is deep; [[Rhône]] leaves it.", "The lake is deep; Rhône leaves it."),
    ("[[Mountain#Height|high]] and [[:Hill]]", "high and :Hill"),
    ("Seen [[Image:view.jpg|200px|from [[Bern]] at night]]here.", "Seen here."),
    ("[[Category:Lakes]]Water", "Water"),
    ("An [[unclosed link", "An [[unclosed link"),
    ("Read [https://example.org/paper the paper] or [https://example.org/a].", "Read the paper or https://example.org/a."),
]
TEMPLATES = [
    ("{{Short description|Body of water}}A lake.", "A lake."),
    ("{{Infobox lake\n| name = {{lang|fr|Léman}}\n| area = {{convert|580|km2}}\n}}Deep.", "Deep."),
    ("Word {{nowrap|stays {{lang|de|hier}}}}.", "Word stays hier."),
    ("{{{title|Untitled}}} page", "Untitled page"),
    ("Kept {{cut off\nnever ends", "Kept"),
]
TABLES = [
    ("Before\n{| class=\"wikitable\"\n! Year\n|-\n| 1871\n|}\nAfter", "Before\nAfter"),
    ("{{Box|\n{|\n| inner {{x|{{y}}}}\n|}\n}}Left", "Left"),
]
TAGS = [
    ("Fact<ref name=\"b\">Book, p. 3</ref> stands<ref name=\"b\" />.", "Fact stands."),
    ("<b>bold<i>both</b></i> plain<br>next", "boldboth plainnext"),
    ("x<poem>\nroses\n</poem>y<nowiki>[[z]]</nowiki>", "xy"),
    ("<!-- draft -->Shown<!-- rest", "Shown"),
    ("a<math>x^2</math>b<references />c", "abc"),
]
LINES = [
    ("'''Bern''' is ''a'' city.\n== History ==\nOld.", "Bern is a city."),
    ("# first\n## second\n; term\n: text", "first\nsecond\nterm\ntext"),
    ("A   B\t C\n\n\nD __NOTOC__", "A B C\nD"),
    ("&copy; 2020 &ndash; &#x4E2D;", "© 2020 – 中"),
]


@pytest.mark.parametrize("source,want", LINKS + TEMPLATES + TABLES + TAGS + LINES)
def test_what_is_seen(source, want):
    assert plain_text(source) == want


def test_deep_nesting_ends():
    began = time.process_time()
    plain_text("{{a|" * 300 + "x" + "}}" * 300 + "[[b|" * 300 + "y" + "]]" * 300)
    assert time.process_time() - began < 5


def test_summary_takes_whole_paragraphs():
    paragraphs = [f"Paragraph {i} has some words in it." for i in range(6)]
    text, quality, _ = summarize("\n\n".join(paragraphs), 60, 400)
    assert text == "\n".join(paragraphs[:2]) and quality == "complete"
    assert summarize("\n".join(paragraphs), 0, 1000)[0] == "\n".join(paragraphs)


def test_summary_is_cut_at_a_sentence():
    text, quality, _ = summarize("湖水很深！风很大？" * 40, 100, 103)
    assert quality == "truncated" and text == "湖水很深！风很大？" * 11
    assert len(summarize("words without any end " * 30, 10, 77)[0]) == 77


def test_summary_of_markup_only_is_degraded():
    assert summarize("{{Navbox|" + "[[x]] " * 200 + "}}Few words.", 0, 600)[1] == "degraded"
    assert summarize("", 300, 600)[:2] == ("", "short")


@pytest.mark.parametrize("source,target", [("#redirect [[Lake Léman]]", "Lake Léman"), ("#REDIRECT [[A|b]]\n[[Category:R]]", "A"), ("Not one. #redirect [[A]]", None), ("#redirect", None)])
def test_redirects(source, target):
    assert soft_redirect(source) == target
