"""Main-text extraction from HTML by tree scoring.

A page is read once into a tree of elements; menus, page headers, footers, asides, forms, scripts, styles,
adverts, notices and comment threads are left out by element, role, class or id. Names that only say how a page is laid
out (has-sidebar, no-ads, ad-free) do not count, and what is left out by class or id stays if it holds an article or main
element where no other is left, or more than half of the points of the page (comment threads: nine tenths). Every paragraph
passes points for its length and commas to its parent, half to the next ancestor and a third to the one
above. A container's points are discounted by its link density; the best container is kept, together with
siblings that score near it or are plain paragraphs. If it stands in an <article> or <main>, that whole element is kept, with the articles beside it that hold
a fifth as many points at least; an article inside another stands for the outer one where that has text of its own. Scripts, styles and the like end at their
end tags alone, whatever their own tag ends with. Labels stay inside paragraphs, formulas everywhere.

A class or id leaves an element out only if all words of the name are such words (share-buttons, not share-price), never for a
part of it. Quotes hide a tag's end only as values after an equals sign; tags that never end are text.

Null, empty and text-free pages: text '', 0 characters. Character references are decoded, white
space inside a block becomes one space, blocks are joined by an empty line. Unclosed and stray tags
are borne as browsers bear them. Nothing is capped; time grows with the length of the page, also for broken ones. Repeated rows come out alike, an empty
table stays empty, and of containers with equal points the first is kept. Only the html column is looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import give_back

_OPEN = re.compile(r"<!--|<!\[CDATA\[|<[!?]|</?[a-zA-Z]")
#: What ends a tag or begins a quoted value in it: quotes count after an equals sign alone.
_STOP = re.compile(r">|=\s*([\"'])")
_NAME = re.compile(r"[^\s/>]*")
_RAW = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "select", "title", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("nav footer aside form button menu dialog object canvas video audio head label fieldset datalist annotation annotation-xml".split())
#: Elements in which a label is part of the text.
_PROSE = ("p", "li", "td", "dd", "blockquote", "figcaption")
_BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption blockquote pre figure figcaption address "
    "header footer nav aside form hr fieldset details summary center hgroup".split())
_PARAGRAPH = frozenset("p li pre blockquote h1 h2 h3 h4 h5 h6 dd dt tr figcaption".split())
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_WALL = frozenset("ul ol dl table td th div section article main body".split())
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: A class or id is that of a menu, advert, notice and so on if all its words are of the two lists, and one of the first.
_AWAY = frozenset((
    "ad ads adbox adsense adslot advert adverts advertisement advertisements advertising advertorial sponsor sponsors sponsored promo promos promotion promotions banner banners "
    "comment comments commentlist disqus replies respond responses discussion discussions talkback outbrain taboola promoted sidebar sidebars menu menus navbar navigation nav breadcrumb breadcrumbs footer cookie cookies cookiebar consent gdpr notice notices "
    "popup popups modal overlay newsletter newsletters subscribe subscription signup login share sharing social related recommend recommended recommendations widget widgets "
    "toolbar pager pagination skip skiplink alert alerts masthead search paywall tags siteheader pageheader topbar").split())
_NEUTRAL = frozenset((
    "box list bar left right top bottom block container wrapper wrap item items link links button buttons area section post posts thread group panel form field inner outer "
    "row col column slot unit zone main global site page reader user header head icons icon title heading body count tools by line google dfp x article articles stories").split())
_SIDE = frozenset("header side aside meta".split())
_COMMENTS = frozenset(("comment", "comments"))
#: Names that say what an element has or lacks, not what it is.
_LAYOUT = re.compile(r"(?:(?<=[\s_-])|^)(?:has|with|without|no)[_-]\S+|[^\s_-]+[_-]free(?=[\s_-]|$)", re.I)
#: A thread of comments may be longer than its article, so it must hold nearly all points to be taken for a wrapper.
_THREAD = re.compile(r"comment|disq|discuss|talkback|repl|respon", re.I)
_GOOD = re.compile(r"article|content|main|story|entry|post|body|text", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _words(name: str) -> list[str]:
    return [w for w in re.split(r"[_\d-]+", name.lower()) if w]


def _away(names: list[str], among: frozenset = _AWAY) -> bool:
    """Whether one of the names is made of words to leave out, whole words all of them."""
    return any(among.intersection(words) and _AWAY.union(_NEUTRAL).issuperset(words) for words in map(_words, names))


def _unwanted(tag: str, attrs: str, in_article: bool, in_text: bool) -> int:
    """0: wanted, 1: left out for its class or id, 2: left out for good. ``in_text``: in an article or main element."""
    if tag in _DROP or (tag == "header" and not in_article):
        return 2
    if not attrs or tag in ("html", "body"):
        return 0
    got = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(attrs)}
    if "hidden" in got or got.get("aria-hidden") == "true" or _NONE.search(got.get("style", "")) or got.get("role", "").lower() in _ROLES:
        return 2
    if tag in ("article", "main"):
        return 2 * _away(got.get("class", "").split(), _COMMENTS)
    names = _LAYOUT.sub("", f"{got.get('class', '')} {got.get('id', '')}").split()
    side = not in_text and tag in ("div", "section", "ul") and any(_SIDE.issuperset(w) for n in names if (w := _words(n))) and not _GOOD.search(" ".join(names))
    return int(_away(names) or side)


def _tag_ends(html: str):
    """A function of a place inside a tag: the place after the tag, or -1 if none ends it.

    Every stop is looked for and followed once, so unclosed tags and quotes cost no more than the page is long.
    """
    ends: dict[int, int] = {}
    nowhere = {'"': len(html) + 1, "'": len(html) + 1}  # from where on there is no such quote
    last: tuple[int, re.Match | None] = (0, None)

    def end(at: int) -> int:
        nonlocal last
        chain, out = [], -1
        while True:
            since, m = last
            if m is None or not since <= at <= m.start():
                m = _STOP.search(html, at)
                if m is None:
                    break
                last = (at, m)
            if m.start() in ends:
                out = ends[m.start()]
                break
            chain.append(m.start())
            if m[1] is None:
                out = m.end()
                break
            close = html.find(m[1], m.end()) if m.end() < nowhere[m[1]] else -1
            if close < 0:  # no quote then
                nowhere[m[1]] = min(nowhere[m[1]], m.end())
                at = m.end()
            else:
                at = close + 1
        ends.update(dict.fromkeys(chain, out))
        return out

    return end


def main_text(html: str | None) -> str:
    """The article of one page: blocks in page order, joined by two line feeds."""
    if not html:
        return ""
    text, doubted = _read(html, frozenset(), False)
    if doubted and (spared := _read(html, frozenset(), True)[1]):
        text = _read(html, spared, False)[0]
    return text


def _read(html: str, spared: frozenset, trial: bool) -> tuple[str, frozenset]:
    """The article, and the elements left out for their class or id. A trial leaves none of them out and gives those to be spared."""
    parent, tags, good = [-1], ["#"], [0.0]
    stack, owners, opened = [0], [0], Counter()  # owners: the nearest block element of each stack entry
    blocks: list[tuple[int, str, int]] = []  # owner, text, characters in links
    words: list[str] = []
    doubted: dict[int, float] = {}  # elements unwanted for their class or id: share of the points beyond which they stay
    articled: list[int] = []  # article and main elements that are wanted
    endless: set[str] = set()  # raw elements without a further end tag
    links = away = articles = texts = 0  # away: node whose subtree is left out

    def flush() -> None:
        nonlocal links
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            if text:
                blocks.append((owners[-1], text, min(links, len(text))))
            words.clear()
        links = 0

    def pop(depth: int) -> None:
        nonlocal away, articles, texts
        while len(stack) > depth:
            n = stack.pop()
            owners.pop()
            opened[tags[n]] -= 1
            texts -= tags[n] in ("article", "main")
            if n == away:
                away = 0
            articles -= tags[n] == "article"

    at, size, in_link, tag_end = 0, len(html), 0, _tag_ends(html)
    while at < size:
        m = _OPEN.search(html, at)
        end = m.start() if m else size
        tag, closing, attrs = "", False, ""
        if m and m[0][-1].isalpha():
            stop = tag_end(m.end())
            if stop < 0:  # no tag ends any more: text
                m, end, stop = None, size, size
            else:
                closing = html[m.start() + 1] == "/"
                begin = m.end() - 1
                name = _NAME.match(html, begin, stop - 1)
                tag, attrs = name[0].lower(), html[name.end():stop - 1]
        elif m:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            stop = html.find(close, m.end())
            stop = stop + len(close) if stop >= 0 else size
        if end > at and not away:
            words.append(html[at:end])
            if in_link:
                links += len(html[at:end].strip())
        if not m:
            break
        at = stop
        if not tag:
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in _BLOCK and not away:
            flush()
        elif tag in ("br", "td", "th") and not away:
            words.append(" ")
        if closing:
            for depth in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if tags[stack[depth]] == tag:
                    pop(depth)
                    break
                if tags[stack[depth]] in ("table", "article") and tag in ("p", "b", "i", "a", "span", "li"):
                    break
            continue
        if tag in _RAW and not (tag == "svg" and attrs.rstrip().endswith("/")):
            stop = _RAW[tag].search(html, at) if tag not in endless else None
            if not stop:
                endless.add(tag)
            if not stop and attrs.rstrip().endswith("/"):  # no end tag follows: the tag closes itself
                continue
            at = html.find(">", stop.end()) + 1 if stop else 0
            at = at or size
            continue
        if tag in _VOID or attrs.endswith("/"):
            continue
        if tag in _CLOSES or tag in _BLOCK:
            shut = _CLOSES.get(tag, ("p",))
            for depth in range(len(stack) - 1, 0, -1) if any(opened[t] > 0 for t in shut) else ():
                t = tags[stack[depth]]
                if t in shut:
                    pop(depth)
                    break
                if t in _WALL:
                    break
        if tag in _BLOCK and away and tags[away] == "head":  # an unclosed head ends where the body begins
            pop(stack.index(away))
        parent.append(stack[-1])
        tags.append(tag)
        good.append({"article": 10.0, "main": 8.0, "div": 5.0, "section": 4.0, "td": 3.0, "blockquote": 3.0}.get(tag, 0.0) + (5.0 if attrs and _GOOD.search(attrs) else 0.0))
        stack.append(len(tags) - 1)
        owners.append(len(tags) - 1 if tag in _BLOCK else owners[-1])
        opened[tag] += 1
        texts += tag in ("article", "main")
        articles += tag == "article"
        if not away and not (tag == "label" and any(opened[t] > 0 for t in _PROSE)):
            n, unwanted = len(tags) - 1, _unwanted(tag, attrs, articles > 0, texts > (tag in ("article", "main")))
            if unwanted == 1:
                doubted[n] = 0.9 if _THREAD.search(attrs) else 0.5
            if unwanted == 2 or (unwanted and not trial and n not in spared):
                away = n
            elif tag in ("article", "main"):
                articled.append(n)
    flush()
    if trial:
        return "", _spared(doubted, articled, parent, blocks)
    if not blocks:
        return "", frozenset(doubted)
    count = len(tags)
    chars, linked, points = [0] * count, [0] * count, [0.0] * count
    for owner, text, in_links in blocks:
        chars[owner] += len(text)
        linked[owner] += in_links
        worth = _worth(text, in_links)
        n = parent[owner] if tags[owner] in _PARAGRAPH and owner else owner
        for share in (1, 2, 3):
            if n <= 0:
                break
            points[n] += worth / share
            n = parent[n]
    for n in range(count - 1, 0, -1):
        chars[parent[n]] += chars[n]
        linked[parent[n]] += linked[n]
    score = [(points[n] + good[n]) * (1 - linked[n] / chars[n]) if points[n] and chars[n] else 0.0 for n in range(count)]
    best = max(range(count), key=lambda n: (score[n], -n))
    kept = [False] * count
    n = best
    while n > 0 and tags[n] not in ("article", "main"):
        n = parent[n]
    if n > 0:
        worths, own = _article_worths(tags, parent, blocks)
        up = parent[n]
        while up > 0:  # the outer article, if it is more than a frame around this one
            if tags[up] == "article" and own[up] >= 2.0:
                n = up
            up = parent[up]
        kept[n] = True
        for k in range(1, count) if tags[n] == "article" else ():
            kept[k] = kept[k] or (tags[k] == "article" and parent[k] == parent[n] and worths[k] >= max(2.0, 0.2 * worths[n]))
    elif best == 0:
        kept[0] = True
    else:
        least = max(2.0, 0.2 * score[best])
        for k in range(1, count):
            if parent[k] == parent[best]:
                density = linked[k] / chars[k] if chars[k] else 1.0
                plain = tags[k] in _PARAGRAPH and tags[k] != "li" and (density < 0.25 if chars[k] > 80 else density == 0 and chars[k] > 0)
                kept[k] = k == best or score[k] >= least or plain
    for k in range(1, count):
        kept[k] = kept[k] or kept[parent[k]]
    return "\n\n".join(text for owner, text, _ in blocks if kept[owner]), frozenset(doubted)


def _article_worths(tags: list[str], parent: list[int], blocks: list[tuple[int, str, int]]) -> tuple[list[float], list[float]]:
    """By element: the points of the paragraphs in it, and of those that lie in no article inside it."""
    worths = [0.0] * len(tags)
    for owner, text, in_links in blocks:
        worths[owner] += _worth(text, in_links)
    own = worths.copy()
    for n in range(len(tags) - 1, 0, -1):
        worths[parent[n]] += worths[n]
        own[parent[n]] += 0.0 if tags[n] == "article" else own[n]
    return worths, own


def _worth(text: str, in_links: int) -> float:
    return (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - in_links / len(text))


def _spared(doubted: dict[int, float], articled: list[int], parent: list[int], blocks: list[tuple[int, str, int]]) -> frozenset:
    """The doubted elements that hold the page's articles or most of its points."""
    points, holds = [0.0] * len(parent), [False] * len(parent)
    for owner, text, in_links in blocks:
        points[owner] += _worth(text, in_links)
    for n in articled:
        holds[n] = True
    under = [False] * len(parent)  # in a doubted element
    for n in range(1, len(parent)):
        under[n] = n in doubted or under[parent[n]]
    for n in range(len(parent) - 1, 0, -1):
        points[parent[n]] += points[n]
        holds[parent[n]] |= holds[n]
    lost = bool(articled) and all(under[n] for n in articled)
    return frozenset(n for n, share in doubted.items() if points[n] > share * points[0] or (lost and holds[n]))


def main_text_of(html: Column | str) -> Column:
    """The main text of an HTML column; '' where there is none."""

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(None if x is None or x is np.nan else x) for x in s], dtype=object)
        give_back()

    return extracted(html)
