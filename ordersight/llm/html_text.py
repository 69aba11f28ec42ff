"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags.  Pass one labels every block of every
page by length, stop-word density and link density: long blocks rich in stop words
are good, linked or stop-word-poor ones bad, the rest ``near`` or ``short``.  Two
priors shift that label by a step:

- boilerplate containers (menus, headers, footers, sidebars, notices, adverts,
  forms, reader comments; by tag, role, class or id): a good block becomes
  ``marked``, any other bad; hidden ones are bad;
- article or main elements, if they hold at least as much text as the good blocks
  outside them: ``near`` inside becomes good, ``short`` and stop-word-poor blocks
  become ``near``; outside ``near`` becomes ``short`` and ``short`` bad.  If they hold
  less (teasers, cards, reader comments) they say nothing.

Pass two gives the ambiguous blocks the label of their nearest decided neighbours:
good if both sides agree on good (or the only decided side is good); a ``near``
block needs one good side, a ``marked`` one two.

The text of the good blocks is joined by one newline each; character references
are decoded and white space inside a block becomes one space.  Pages are
independent: no shuffle, one batch of rows in memory at a time.

Defined cases: null or empty html gives an empty text; an unclosed head ends at the
body or its first element, unclosed menus and the like at the next article; script,
style and textarea without an end run to the end of the page, of other skipped
elements without one (or self-closing) only the tag goes; repeated rows and null ids each give a
row; empty tables give no rows; other input columns are ignored.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordersight.llm.common import col

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that are followed on a stack; all others only cut blocks.
CONTAINERS = frozenset(
    "address article aside blockquote details dialog div dl fieldset figure footer form header li main menu nav ol "
    "section table td th ul p h1 h2 h3 h4 h5 h6 span".split()
)
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog header fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Elements without text of the page; raw ones run to the end of the page if they are not closed.
RAW = "script style textarea".split()
SKIPPED = "noscript template svg math iframe object select button canvas audio video".split()
#: Of these, the ones that may hold others of their kind.
NESTED = frozenset("noscript template svg math object".split())
#: Of these, the ones that never hold an article.
SMALL = frozenset(SKIPPED) - {"noscript", "template"}
#: What a head may hold; any other element ends it.
HEAD_TAGS = frozenset("title meta link base basefont bgsound".split()) | frozenset(SKIPPED[:2])
#: Words in a class or id that mark boilerplate.
MARKS = frozenset(
    "ad ads advert advertisement adverts adbox banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination popup promo promoted promotion related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget".split()
)
CONTENT_TAGS = frozenset(("article", "main"))
#: Inside an article these are boilerplate only if a whole class name or the id is one of STRICT_MARKS.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li td th span blockquote figure".split())
STRICT_MARKS = frozenset(
    "ad ads advert advertisement adverts adbox breadcrumb breadcrumbs cookie cookies newsletter pager pagination promo "
    "promoted promotion signup skip sponsor sponsored subscribe subscription".split()
)
#: Whole class names that mark an article element as a reader's comment.
COMMENT_MARKS = frozenset("comment comments reply replies respond disqus".split())
#: Weight of a hidden container among the open boilerplate ones.
HIDDEN = 1 << 20
#: Stop words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this "
    "to was we were which who will with you "
    "als auf auch aus bei das dem den der des die ein eine einer es für ist im in mit nicht sich sie sind und von war "
    "werden wie zu zum zur "
    "au aux avec ce cette dans de des du elle en est et il je la le les mais ne nous ou par pas pour que qui sa se son "
    "sont sur un une vous "
    "al como con de del el en es esta fue ha la las lo los más no para pero por que se ser su sus un una y".split()
)
MIN_SHORT, MIN_LONG = 70, 200
STOPS_LOW, STOPS_HIGH = 0.30, 0.32
MAX_LINKS = 0.5

ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
CUT = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(?P<raw>%s)\b(?:%s(?<=[\s\"'])/>|(?:%s|[^>]*)>.*?(?:</(?P=raw)\s*>|\Z))" % ("|".join(RAW), ATTRS, ATTRS)
TAG = CUT + r"|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>%s)>" % ATTRS
ATTRIBUTE = r"""\b(class|id|role|hidden|style)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""


def _marked(attrs: str, attribute, content_tag: bool, strict: bool) -> int:
    """1 if class, id or role make an element boilerplate, ``HIDDEN`` if its style hides it, else 0."""
    mark = 0
    for m in attribute.finditer(attrs):
        name, value = m.group(1).lower(), m.group(2).strip("\"'").lower()
        if name == "role":
            mark |= not content_tag and value in ROLES
        elif name == "style":
            if "display:none" in value.replace(" ", ""):
                return HIDDEN
        elif name in ("class", "id"):
            if content_tag or strict:
                mark |= not (COMMENT_MARKS if content_tag else STRICT_MARKS).isdisjoint(value.split())
            else:
                mark |= not MARKS.isdisjoint(re.split(r"[^a-z]+", value))
    return int(mark)


def closable(page: str) -> str:
    """The page with every ``<`` that opens no tag written as ``&lt;``, in one run over it.

    A tag ends at the first ``>`` outside quotes.  Where it ends follows from the next quote or
    ``>`` alone, so the ends are found from the last of them to the first.  Without this a
    page full of unclosed tags is searched to its end for each of them.
    """
    marks = [m.start() for m in re.finditer("[>\"']", page)]
    closed = [False] * (len(marks) + 1)
    following = {'"': None, "'": None}
    for k in range(len(marks) - 1, -1, -1):
        c = page[marks[k]]
        if c == ">":
            closed[k] = True
        else:
            pair = following[c]
            closed[k] = pair is not None and closed[pair + 1]
            following[c] = k
    last = page.rfind(">")
    raw = frozenset(RAW)
    out, at = [], 0
    for m in re.finditer(r"<(?!!--)(?:/?([a-zA-Z][a-zA-Z0-9:-]*))?", page):
        start, name = m.start(), m.group(1)
        if start > last or (name and name.lower() not in raw and not closed[bisect.bisect(marks, start)]):
            out += [page[at:start], "&lt;"]
            at = start + 1
    page = "".join([*out, page[at:]]) if out else page
    # sections that nothing ends are no sections
    ended = page.rfind("]]>")
    return page[: ended + 1] + page[ended + 1 :].replace("<![", "<!")


def _skip_ends(page: str, tag) -> dict[int, int]:
    """Start -> end of the skipped elements that are closed, in one run over the tags."""
    ends: dict[int, int] = {}
    open_tags: dict[str, list[tuple[int, int]]] = {}
    articles = 0
    for m in tag.finditer(page):
        name = (m.group("name") or "").lower()
        articles += name in CONTENT_TAGS and not m.group("close")
        if name not in SKIPPED:
            continue
        opened = open_tags.setdefault(name, [])
        if not m.group("close"):
            if not m.group("attrs").endswith("/"):
                if name not in NESTED:
                    opened.clear()
                opened.append((m.start(), articles))
        elif opened:
            start, before = opened.pop()
            if name not in SMALL or before == articles:
                ends[start] = m.end()
    return ends


def blocks(page: str, tag, attribute) -> list[tuple[str, int, int, bool]]:
    """(text, characters inside links, open boilerplate, in an article) per block, in page order."""
    out: list[tuple[str, int, int, bool]] = []
    stack: list[tuple[str, int]] = []  # open containers and the boilerplate mark of each
    parts: list[str] = []
    linked = bad = content = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, min(linked, len(text)), bad, content > 0))
        parts.clear()
        linked = 0

    at = 0
    skip_ends = None
    in_head = in_title = False
    while m := tag.search(page, at):
        if m.start() > at:
            raw = page[at : m.start()]
            if in_head and not in_title and raw.strip():
                in_head = False
            if not in_head:
                parts.append(raw)
                if in_link:
                    linked += len(" ".join(raw.split()))
        at = m.end()
        name = m.group("name")
        if name is None:
            continue
        name = name.lower()
        closing = bool(m.group("close"))
        if name == "head":
            in_head, in_title = not closing, False
        elif in_head:
            in_title = name == "title" and not closing
            in_head = name in HEAD_TAGS
        if name in SKIPPED:
            if not closing and not m.group("attrs").endswith("/"):
                if skip_ends is None:
                    skip_ends = _skip_ends(page, tag)
                at = skip_ends.get(m.start(), at)
            continue
        if name == "a":
            in_link = not closing
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK_TAGS:
            flush()
            in_link = False
        if name not in CONTAINERS or m.group("attrs").endswith("/"):
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for open_name, open_bad in stack[k:]:
                        bad -= open_bad
                        content -= open_name in CONTENT_TAGS
                    del stack[k:]
                    break
            continue
        if name in CONTENT_TAGS and not content:
            # an article ends menus and the like that were left open before it
            while stack and stack[-1][1] and stack[-1][0] in BOILERPLATE_TAGS:
                bad -= stack.pop()[1]
        if name in ("p", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"):
            # these close an open one of their kind by themselves
            if stack and stack[-1][0] == name:
                bad -= stack.pop()[1]
        strict = content > 0 and name in TEXT_TAGS
        mark = _marked(m.group("attrs"), attribute, name in CONTENT_TAGS, strict) if m.group("attrs") else 0
        mark = max(mark, int(name in BOILERPLATE_TAGS))
        if mark and name == "span":
            flush()
        stack.append((name, mark))
        bad += mark
        content += name in CONTENT_TAGS
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def _first_label(text: str, density: float) -> str:
    """Label of a block by its own links, length and stop words."""
    if density > MAX_LINKS:
        return "bad"
    if len(text) < MIN_SHORT:
        return "bad" if density > 0.2 else "short"
    stops = [w.strip(".,;:!?()\"'") in STOP_WORDS for w in text.lower().split()]
    rich = sum(stops) / len(stops)
    if rich >= STOPS_HIGH:
        return "good" if len(text) >= MIN_LONG else "near"
    return "near" if rich >= STOPS_LOW else "poor"


#: Label by the prior: in a boilerplate container, inside and outside the article or main element.
MARKED = {"good": "marked", "near": "bad", "short": "bad", "poor": "bad", "bad": "bad"}
INSIDE = {"good": "good", "near": "good", "short": "near", "poor": "near", "bad": "bad"}
OUTSIDE = {"good": "good", "near": "short", "short": "bad", "poor": "bad", "bad": "bad"}
NO_PRIOR = {"good": "good", "near": "near", "short": "short", "poor": "bad", "bad": "bad"}


def classify(found: list[tuple[str, int, int, bool]]) -> list[bool]:
    """Whether each block belongs to the main text."""
    first = [_first_label(text, linked / len(text)) for text, linked, _, _ in found]
    plain = [(label, len(text), content) for label, (text, _, bad, content) in zip(first, found) if not bad]
    inside = sum(size for label, size, content in plain if content and label != "bad")
    trusted = 0 < inside >= sum(size for label, size, content in plain if not content and label == "good")
    labels = []
    for label, (_, _, bad, content) in zip(first, found):
        if bad >= HIDDEN:
            labels.append("bad")
        elif bad:
            labels.append(MARKED[label])
        elif trusted:
            labels.append((INSIDE if content else OUTSIDE)[label])
        else:
            labels.append(NO_PRIOR[label])
    if "good" not in labels:  # a page of short blocks only: what is not bad is all there is
        rest = ("near", "short") if {"near", "short"} & set(labels) else ("marked",)
        return [x in rest for x in labels]
    before, after = [None] * len(labels), [None] * len(labels)
    for order, side in ((range(len(labels)), before), (range(len(labels) - 1, -1, -1), after)):
        seen = None
        for k in order:
            side[k] = seen
            if labels[k] in ("good", "bad"):
                seen = labels[k]
    keep = []
    for label, left, right in zip(labels, before, after):
        if label in ("good", "bad"):
            keep.append(label == "good")
        elif label == "near":
            keep.append("good" in (left, right))
        elif label == "marked":
            keep.append(left == right == "good")
        else:
            keep.append({left, right} <= {"good", None} and "good" in (left, right))
    return keep


def main_text(page: str, tag, attribute) -> str:
    found = blocks(closable(page), tag, attribute)
    return "\n".join(block[0] for block, keep in zip(found, classify(found)) if keep)


def compiled():
    return re.compile(TAG, re.IGNORECASE | re.DOTALL), re.compile(ATTRIBUTE, re.IGNORECASE)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per input row: id, url and the main ``text`` of the page."""
    rows = pages.select(col(id_col).alias("id"), col(url_col).alias("url"), F.coalesce(col(html_col), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, attribute = compiled()
        for batch in batches:
            texts = [main_text(page.as_py(), tag, attribute) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, type=pa.string())], names=["id", "url", "text"]
            )

    schema = T.StructType([rows.schema["id"], rows.schema["url"], T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
