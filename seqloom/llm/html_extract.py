"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text blocks, each under its path of tags from the root. Text length, punctuation and link
text are aggregated per path and smoothed along the page; their logarithms are fused with what tags and class words say
for or against a path, and with the ratio of the element that a block lies in. Blocks near the page's level are the content.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, release

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements whose inside is no text of the page: up to the first end tag, or with inner ones of the same name.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
_NESTED = {"template", "svg", "math"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
_SCOPE = {"html", "body", "div", "section", "article", "main", "aside", "nav", "header", "footer", "table", "ul", "ol", "dl", "td", "th", "form", "blockquote"}
#: Elements that never show prose, those that are beside a page's main text by definition, and others that speak against what is in them.
_GONE = {"head", "button", "select", "object", "canvas", "audio", "video"}
_BESIDE = {"nav", "aside", "footer", "dialog", "menu"}
_AGAINST_TAGS = {"form", "fieldset"}
#: What may stand in <head>; anything else closes it.
_IN_HEAD = {"base", "link", "meta", "title", "style", "script", "noscript", "template"}
_AGAINST_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adslot sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay sidebar side nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer foot masthead header topbar toolbar "
    "comment comments commentlist respond reply replies discussion disqus share sharing social related recommended recommendations newsletter subscribe "
    "subscription signup login search widget widgets skip skiplink tags legal copyright".split()
)
_AGAINST_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "note", "status"}
#: Words that speak against an article element itself.
_AGAINST_ARTICLES = {"comment", "comments", "reply", "related", "recommended", "ad", "ads", "advert", "sponsored", "promo", "promotion", "widget"}
#: Words that name topics or parts of an article when they stand inside one.
_TOPICS = set("header footer foot discussion legal copyright search notice notices tags alert banner comment reply replies menu menus side respond login signup subscription skip widget widgets".split())
#: Words of layout. Inside an article a name speaks against its element only if it has no other words than these and _AGAINST_WORDS.
_LAYOUT_WORDS = set(
    "area article bar block blocks body bottom box button buttons container content entry footer form group header inner item items left link links list main "
    "outer page panel post posts right row section site slot text top unit wrap wrapper".split()
)
_ABOUT_PAGE = re.compile(r"(?:has|with|without|no|is|not)[-_]", re.I)
_DIGIT = re.compile(r"[0-9]")
_NEVER_BY_CLASS = {"html", "body", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PAGE_WIDE = {"", "html", "body"}
#: Elements that hold blocks together: a block takes over the ratio of the box it is in, less STEP for each box between.
_BOXES = {"div", "section", "td", "th", "center", "article", "main"}
_CELLS = {"td", "th"}
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؟]")
#: All scores are natural logarithms. Evidence for what lies in an article or main, and against each element that a tag, role or word speaks against.
FOR, AGAINST = 4.0, -6.0
#: A block is content if its score is at most BELOW under the page's level.
BELOW, STEP, HEADING_STEP = 2.5, 0.5, 0.5
#: Characters and punctuation marks per block, from which more say nothing more.
LONG_TEXT, MANY_MARKS = 400, 10
LINK_SHARE = 0.6


class _Tree:
    """The open elements of a page as a tree: element 0 is the page, a parent comes before its children. Each element knows the number of its path."""

    def __init__(self):
        self.up, self.path, self.tag, self.against, self.inside, self.beside = [-1], [0], [""], [0], [False], [False]
        self._number: dict[tuple, int] = {}

    def child(self, parent: int, name: tuple, against: bool, inside: bool, beside: bool) -> int:
        """A new element; name is its tag and classes, against whether it is spoken against itself, the others whether it lies in what they name."""
        self.up.append(parent)
        self.path.append(self._number.setdefault((self.path[parent], name, against), len(self._number) + 1))
        self.tag.append(name[0])
        self.against.append(self.against[parent] + against)
        self.inside.append(inside)
        self.beside.append(beside)
        return len(self.up) - 1


def _blocks(page: str) -> tuple[list[tuple[int, str, int]], _Tree]:
    """The blocks (element, text, characters in links) of a page in order, and its tree of elements.

    A path is a sequence of tags with their classes, without ids and numbers, so that sections of one kind share it. An element
    knows how many elements around it are spoken against, and whether an article or main is among them.
    """
    tree = _Tree()
    stack: list[tuple[str, int, bool, bool]] = []  # tag, element, not shown, in a link
    frames: list[tuple[int, dict[str, int]]] = [(-1, {})]  # place of each open element of _SCOPE, and other tags open since
    opened: dict[str, int] = {}
    out, parts, links, at = [], [], 0, 0
    closed: dict[str, bool] = {}  # whether an end tag may still come

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((stack[-1][1] if stack else 0, text, min(links, len(text))))
        parts, links = [], 0

    def say(raw: str) -> None:
        nonlocal links
        if raw and stack and stack[-1][0] == "head" and not raw.isspace():
            pop_to(len(stack) - 1)
        if raw and not (stack and stack[-1][2]):
            text = entities.unescape(raw)
            parts.append(text)
            if stack and stack[-1][3]:
                links += len(text.strip())

    def pop_to(k: int) -> None:
        if any(s[0] not in _INLINE for s in stack[k:]):
            flush()
        for s in reversed(stack[k:]):
            opened[s[0]] -= 1
            if s[0] in _SCOPE:
                frames.pop()
            else:
                frames[-1][1][s[0]] -= 1
        del stack[k:]

    def last_of(tags: tuple) -> int:
        return next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in tags)

    def skip(tag: str, nested: bool) -> int:
        """Where an element ends whose inside is left out: behind its end tag; without one, behind its start tag if it may hold elements, else at the page's end."""
        if closed.get(tag) is False:
            return at if nested else end
        deep, here = 1, at
        for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
            deep += -1 if m[1] else 0 if not nested or m[0].endswith("/>") else 1
            if not deep:
                return m.end()
            if m[1]:
                here = m.end()
        closed[tag] = False
        return here if nested else end

    find, end = _TOKEN.search, len(page)
    last = page.rfind(">") + 1  # no tag ends behind it
    while at < end:
        m = find(page, at, last) if at < last else None
        if m is None:
            rest = page[at:]
            say(rest[: rest.find("<!--")] if "<!--" in rest else rest)
            break
        say(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        closing, tag, attrs = (m[1] or m[4]) == "/", tag.lower(), m[3] or m[6] or ""
        if closing:
            if frames[-1][1].get(tag) if tag in _INLINE else opened.get(tag):
                pop_to(last_of((tag,)))
            continue
        if stack and stack[-1][0] == "head" and tag not in _IN_HEAD:
            pop_to(len(stack) - 1)  # </head> may be left out
        if tag in _RAW or tag in _NESTED:
            if not attrs.endswith("/"):
                at = skip(tag, tag in _NESTED)
            if tag not in ("svg", "math"):
                flush()
            continue
        if tag in _VOID:
            if tag == "br":
                say(" ")
            elif tag == "hr":
                flush()
            continue
        if tag not in _INLINE:
            closes, (place, since) = _CLOSES.get(tag, ("p",)), frames[-1]
            if any(since.get(c) for c in closes):
                pop_to(last_of(closes))
            elif place >= 0 and stack[place][0] in closes:
                pop_to(place)
            flush()
        if attrs.endswith("/") and tag in _INLINE:
            continue
        a = {k.lower(): x or y or z for k, x, y, z in _ATTR.findall(attrs)} if attrs and not attrs.isspace() else {}
        _, node, gone, linked = stack[-1] if stack else ("", 0, False, False)
        inside = tree.inside[node]
        beside, kinds = tag in _BESIDE or tag == "header" and not inside, ()
        against = beside or tag in _AGAINST_TAGS
        gone = gone or tag in _GONE
        if a:
            kinds = tuple(x for x in a.get("class", "").split() if not _DIGIT.search(x))
            style = a.get("style", "").replace(" ", "").lower()
            gone = gone or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
            against = against or a.get("role", "").lower() in _AGAINST_ROLES
            against = against or tag not in _NEVER_BY_CLASS and _spoken_against(f"{a.get('class', '')} {a.get('id', '')}", tag, inside)
        if tag not in _INLINE or against:
            node = tree.child(node, (tag, *kinds), bool(against), inside or tag in ("article", "main"), tree.beside[node] or beside)
        opened[tag] = opened.get(tag, 0) + 1
        if tag in _SCOPE:
            frames.append((len(stack), {}))
        else:
            frames[-1][1][tag] = frames[-1][1].get(tag, 0) + 1
        stack.append((tag, node, gone, linked or tag == "a"))
    flush()
    return out, tree


def _spoken_against(said: str, tag: str, inside: bool) -> bool:
    """Whether class or id names speak against an element. Names like has-sidebar tell of the page and not of the element; inside an article a name must have no word of its own."""
    for name in said.split():
        if _ABOUT_PAGE.match(name):
            continue
        pieces = {x for x in re.split(r"[^a-z]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower()) if x}
        if tag == "article":
            found = pieces & _AGAINST_ARTICLES
        elif inside:
            found = (pieces & _AGAINST_WORDS) - _TOPICS if pieces <= _AGAINST_WORDS | _LAYOUT_WORDS else None
        else:
            found = pieces & _AGAINST_WORDS
        if found:
            return True
    return False


def _smooth(values: list[float]) -> list[float]:
    """A [1 2 1] filter along the page; the ends repeat."""
    ext = [values[0], *values, values[-1]]
    return [(a + 2 * b + c) / 4 for a, b, c in zip(ext, ext[1:], ext[2:], strict=False)]


def ratios(blocks: list[tuple[int, str, int]], path: list[int]) -> dict[int, float]:
    """Per path the logarithm of its text ratio times its punctuation ratio, smoothed along the page.

    The text ratio is the number of characters outside links per block of the path, the punctuation ratio that of marks.
    """
    totals: dict[int, list[float]] = {}  # characters outside links, punctuation, blocks
    for e, text, links in blocks:
        t = totals.setdefault(path[e], [0, 0, 0])
        t[0] += len(text) - links
        t[1] += len(_PUNCTUATION.findall(text))
        t[2] += 1
    fused = {p: math.log1p(min(LONG_TEXT, c / n)) + math.log1p(min(MANY_MARKS, marks / n)) for p, (c, marks, n) in totals.items()}
    out = dict.fromkeys(totals, 0.0)
    for (e, _, _), x in zip(blocks, _smooth([fused[path[e]] for e, _, _ in blocks]), strict=True):
        out[path[e]] += x / totals[path[e]][2]
    return out


def block_scores(blocks: list[tuple[int, str, int]], tree: _Tree) -> list[float]:
    """The score of each block.

    It is the ratio of the block's path, or that of a box around it if that is greater, and the evidence of tags and words. A box has
    the mean ratio of the text right in it, an article or main that of all its text; what is spoken against in a box doesn't count
    there. A block of links takes over from an article or its own box only. Headings go with the blocks after them.
    """
    ratio = ratios(blocks, tree.path)
    n, up, tag, against = len(tree.up), tree.up, tree.tag, tree.against
    box, whole = [0] * n, [-1] * n  # nearest box; nearest article or main
    for k in range(1, n):
        box[k] = k if tag[k] in _BOXES or tag[k] in _PAGE_WIDE else box[up[k]]
        whole[k] = k if tag[k] in ("article", "main") else whole[up[k]]
    mass, size = [0.0] * n, [0] * n
    for e, text, _ in blocks:
        r = ratio[tree.path[e]]
        for b in (box[e],) if box[e] == whole[e] else (box[e], whole[e]):
            if b >= 0 and against[b] == against[e]:
                mass[b] += r * len(text)
                size[b] += len(text)
    for k in range(n - 1, 0, -1):  # an article's text is also that of the article or main around it
        if whole[k] == k and (w := whole[up[k]]) >= 0 and against[w] == against[k]:
            mass[w] += mass[k]
            size[w] += size[k]
    mean = [a / c if c else 0.0 for a, c in zip(mass, size, strict=True)]
    best, article = mean[:], [0.0] * n  # what a block takes over: from any box, and from articles
    for k in range(1, n):
        if box[k] != k:
            best[k] = best[up[k]]
        elif tag[k] not in _PAGE_WIDE:
            apart = tag[box[up[k]]] in _PAGE_WIDE and tag[k] not in _CELLS  # boxes right in the page stand for themselves
            best[k] = max(mean[k], 0.0 if apart else best[up[k]] - STEP)
        article[k] = max(mean[k] if tag[k] == "article" else 0.0, article[up[k]])
    scores = []
    for e, text, links in blocks:
        took = best[e]
        if links >= LINK_SHARE * len(text):
            took = max(article[e], 0.0 if tag[box[e]] in _PAGE_WIDE else mean[box[e]])
        scores.append(max(ratio[tree.path[e]], took) + FOR * tree.inside[e] + AGAINST * against[e])
    after = None
    for k in range(len(blocks) - 1, -1, -1):
        e = blocks[k][0]
        if tag[e] not in _HEADINGS:
            after = scores[k]
        elif after is not None and not against[e]:
            scores[k] = max(scores[k], after - HEADING_STEP)
    return scores


def main_text(page: str | None) -> str:
    """The text of the content nodes of a page, one line per block; empty for a null page or one without text.

    The page's level is the mean score of its text, weighted by length and by the square of what the score is the logarithm of, so that a
    short article counts more than a long list of comments. Every block at most BELOW under the level is kept. If even the best block lies in a
    menu, footer, header or the like by its tag, the page has no main text.
    """
    blocks, tree = _blocks(page) if page else ([], None)
    if not blocks:
        return ""
    scores = block_scores(blocks, tree)
    top = max(scores)
    if tree.beside[blocks[scores.index(top)][0]]:
        return ""
    weights = [len(text) * math.exp(2 * (s - top)) for (_, text, _), s in zip(blocks, scores, strict=True)]
    level = sum(w * s for w, s in zip(weights, scores, strict=True)) / sum(weights)
    return "\n".join(text for (_, text, _), s in zip(blocks, scores, strict=True) if s >= level - BELOW)


def extract(df: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """df with the main text of each page in out_col, which replaces a column of that name in any case of letters.

    Rows stay in their partitions, repeated rows too; other columns pass through. A null or empty page, or one without text, has an empty text.
    Very long and deeply nested pages take time in proportion to their length. An empty table gives an empty one.
    """
    bound_batches(df.sparkSession)

    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        out = pa.array([main_text(p) for p in pages.to_pylist()], pa.string())
        release()
        return out

    kept = [c for c in df.columns if c.lower() != out_col.lower()]
    return df.select(*[F.col(f"`{c}`") for c in kept], run(F.col(html_col).cast("string")).alias(out_col))


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
