"""HTML extraction value by value: the given pages by another parser, and pages built from known parts."""

from __future__ import annotations

import html
import random
from html.parser import HTMLParser

import pytest
from conftest import SF01

from ordersight.llm import html_text


class ArticleBlocks(HTMLParser):
    """Blocks of the one article of a page, by the standard library's parser."""

    CUTS = {"article", "h1", "h2", "h3", "p", "li", "ul", "div"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.parts, self.inside = [], [], False

    def cut(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        if tag == "br" and self.inside:
            self.parts.append(" ")
        if tag in self.CUTS:
            self.cut()

    def handle_endtag(self, tag):
        if tag in self.CUTS:
            self.cut()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_given_pages_by_another_parser(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    got = {r.page_id: (r.url, r.text) for r in html_text.extract_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows) > 0
    for r in rows:
        parser = ArticleBlocks()
        parser.feed(r.html or "")
        parser.cut()
        assert got[r.page_id] == (r.url, "\n".join(parser.blocks))


STOPS = "the of and to in a is that for it was on with as his they at be this from or had by not but we".split()
WORDS = "river stone window garden letter market winter bridge engine paper silver morning harbour captain forest".split()


def sentence(rng, n, stops=0.6):  # far above the rule's threshold, so no paragraph is poor by chance
    w = [rng.choice(STOPS) if rng.random() < stops else rng.choice(WORDS) for _ in range(n)]
    return " ".join(w).capitalize() + "."


def paragraph(rng):
    """(html, text) of a paragraph rich in stop words: references, inline tags, white space, at times unclosed."""
    words = sentence(rng, rng.randint(60, 120)).split()
    source = []
    for w in words:
        style = rng.random()
        if style < 0.05:
            w, shown = f"{w} & <so>", f"{html.escape(w)} &amp; &lt;so&gt;"
        elif style < 0.1:
            shown = f"<b>{w}</b>"
        elif style < 0.13:
            w, shown = f"{w} é—x", f"{w} &eacute;&#8212;&#x78;"
        else:
            shown = w
        source.append((shown, w))
    blank = lambda: rng.choice([" ", " ", "\n ", "\t", "<br>", "  "])
    page = "".join(s + blank() for s, _ in source)
    return f"<p>{page}" + rng.choice(["</p>", ""]), " ".join(w for _, w in source)


def boilerplate(rng):
    links = "".join(f'<li><a href="/{k}">{rng.choice(WORDS)} {k}</a></li>' for k in range(rng.randint(3, 9)))
    rich = sentence(rng, 70)
    return rng.choice(
        [
            f"<nav><ul>{links}</ul></nav>",
            f"<div class='menu'><ul>{links}</ul></div>",
            f"<header><p>{sentence(rng, 6)}</p></header>",
            f"<footer><p>&copy; {sentence(rng, 8)}</p></footer>",
            f"<aside class='sidebar'><p>{sentence(rng, 8)}</p><ul>{links}</ul></aside>",
            f"<div class=\"ad\">{sentence(rng, 9)}</div>",
            f"<form action=/s><label>{rng.choice(WORDS)}</label><input name=q><button>Go</button></form>",
            f"<script>var x = '<p>{rich}</p>';</script>",
            f"<style>p::after {{ content: '{rich}' }}</style>",
            f"<!-- <p>{rich}</p> -->",
            f"<div id=cookie><p>{sentence(rng, 10)}</p></div>",
            f"<noscript><p>{rich}</p></noscript>",
            f"<div hidden style='display: none'><p>{rich}</p></div>",
        ]
    )


@pytest.mark.parametrize("kind", ["article", "main", "div"])
def test_built_pages(kind):
    """Main text known by construction: paragraphs between any boilerplate, with and without article marks."""
    rng = random.Random(kind)
    tag, attribute = html_text.compiled()
    for _ in range(150):
        parts = [paragraph(rng) for _ in range(rng.randint(1, 6))]
        before = "".join(boilerplate(rng) for _ in range(rng.randint(0, 4)))
        behind = "".join(boilerplate(rng) for _ in range(rng.randint(0, 4)))
        body = "".join(p for p, _ in parts)
        page = f"<!DOCTYPE html><html><head><title>{sentence(rng, 5)}</title></head><body>{before}<{kind}>{body}</{kind}>{behind}</body></html>"
        assert html_text.main_text(page, tag, attribute) == "\n".join(t for _, t in parts), page
