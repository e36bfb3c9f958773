"""HTML extraction by line-block distribution.

Markup is stripped into lines, one for each stretch of text between block tags, blank where two block tags meet.
The text lengths over a sliding window of lines surge where running text begins and dive to nothing where it ends;
the lines between a surge and its dive are kept. Text in links adds no length, nor do lines of elements that say
they are no article (navigation, header, footer, aside, forms, adverts, notices, comments); where a page names its
article, lines outside add none either. Script, style and other unseen elements are no text at all.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame

from .common import with_columns

#: Lines in a window; its length that makes a surge: the smaller of so many characters and this share of the peak.
WINDOW, SURGE, SHARE = 3, 60, 0.1

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'<>]++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
#: Element names by what they do.
UNSEEN = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "head"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: What an opening tag ends of the items it stands beside, also past inline elements left open.
ENDS = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
ENDS |= dict.fromkeys(("thead", "tbody", "tfoot"), {"td", "th", "tr", "thead", "tbody", "tfoot"})
BESIDE = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset"}
BESIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Role words of classes and ids. A name tells a role only if all its parts are role or layout words: a
#: share-bar is one, a share-price is not.
ROLE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "paywall", "newsletter", "subscribe", "signup", "login",
    "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "topbar", "toc",
    "sidebar", "aside", "widget", "widgets", "related", "recommended", "share", "sharing", "social", "header", "masthead", "footer", "copyright", "legal", "disclaimer",
    "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "discussion", "form", "search",
}
LAYOUT_WORDS = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "center", "col", "column", "container", "content", "first", "fixed", "global", "group",
    "holder", "inner", "item", "items", "last", "left", "link", "links", "list", "main", "middle", "outer", "page", "panel", "post", "posts", "primary", "reader", "region",
    "right", "row", "secondary", "section", "site", "slot", "sticky", "thread", "top", "unit", "user", "wrap", "wrapper", "zone",
}
ARTICLE_WORDS = {"articlebody", "article-body", "post-content", "entry-content", "article-content", "story-body", "post-body"}
#: Words of comment blocks: an article inside is a reader's. Teasers: a mere <article> inside is about another page.
COMMENT_WORDS = {"comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "discussion"}
TEASERS, TEASER_WORDS = {"nav", "footer", "aside", "menu"}, {"related", "recommended", "promo", "promotion", "sponsor", "sponsored", "ad", "ads", "advert", "adverts", "widget", "widgets"}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
CONTAINERS = {"article", "content", "post", "entry", "main", "story", "page", "wrapper", "container", "layout"}
#: How firmly an element is beside: if it holds no more than half of the page's text, till a named article opens, till
#: <main> or an article body opens, for good.
LOOSE, WEAK, TEASER, FIRM = 1, 2, 3, 4


def roles_in(held: dict[str, str]) -> set[str]:
    """The role words of those names in class and id that hold nothing but role and layout words."""
    found: set[str] = set()
    for key in ("class", "id"):
        for name in held.get(key, "").split():
            parts = {w.lower() for w in WORDS.findall(name) if not w.isdigit()}
            if parts and parts <= ROLE_WORDS | LAYOUT_WORDS:
                found |= parts & ROLE_WORDS
    return found


def containers_in(held: dict[str, str]) -> set[str]:
    """The container words that are names or parts of names in class and id."""
    return {w.lower() for key in ("class", "id") for w in WORDS.findall(held.get(key, ""))} & CONTAINERS


def beside(name: str, attributes: str, in_article: bool) -> int:
    """How firmly an element says that it is no article text, or 0."""
    by_name = TEASER if name in TEASERS else LOOSE if name in ("form", "fieldset") else WEAK if name in BESIDE or name == "header" and not in_article else 0
    if not attributes.strip() or name in ("html", "body", "main", "h1"):
        return by_name
    held = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    if held.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|$)", ATTRIBUTE.sub(" ", attributes)):
        return FIRM
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", held.get("style", ""), re.I):
        return FIRM
    own, loose = roles_in(held) - ({"form"} if by_name == LOOSE else set()), False
    if in_article:
        own -= {"header", "toc", "legal", "discussion", "alert", "notice"} if {"article", "post", "entry", "content"} & containers_in(held) else set()
    elif containers_in(held):
        loose = True
    if own & COMMENT_WORDS:
        return FIRM
    if not loose and own & (TEASER_WORDS | {"sidebar"}):
        return TEASER
    if loose and own:
        return max(by_name, LOOSE)
    return max(by_name, WEAK if own or held.get("role", "").lower() in BESIDE_ROLES else 0)


def names_article(name: str, attributes: str) -> int:
    """The firmest mark of being beside that an element lifts as it names an article; 0 if it names none."""
    if name in ("article", "main"):
        return TEASER if name == "main" or "articlebody" in attributes.lower() else WEAK
    held = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)}
    if held.get("role") == "main" or held.get("itemprop") == "articlebody" or {*held.get("class", "").split(), held.get("id", "")} & ARTICLE_WORDS:
        return TEASER
    return WEAK if held.get("role") == "article" else 0


def strip_markup(page: str) -> list[tuple[str, int, bool, bool]]:
    """The page's lines: text, its length outside links, beside the article or not, in a named article or not."""
    lines: list[tuple[str, int, int, bool, int]] = []  # text, length, how firmly beside, article, loose
    outer = [0]  # for each loose element the one around it; 0 is none
    parts: list[str] = []
    links = pos = 0  # links: characters of the line so far that stand in links
    opened: list[tuple[str, bool, int, bool, bool, int]] = [("", False, 0, False, False, 0)]  # name, unseen, beside, article, link, loose
    places: defaultdict[str, list[int]] = defaultdict(list)  # where in opened each name stands
    solid = [0]  # where in opened what isn't inline stands

    def close(at: int) -> None:
        while len(opened) > at:
            places[opened.pop()[0]].pop()
        while solid[-1] >= at:
            solid.pop()

    def end_line() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(parts)).split())
        lines.append((text, max(0, len(text) - links), opened[-1][2], opened[-1][3], opened[-1][5]))
        parts.clear()
        links = 0

    while pos <= len(page):
        tag = TAG.search(page, pos)
        text = page[pos : tag.start() if tag else len(page)]
        _, unseen, _, _, link, _ = opened[-1]
        if text and not unseen:
            parts.append(text)
            links += len(text.strip()) if link else 0
        if not tag:
            break
        pos = tag.end()
        closing, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        if name not in INLINE:
            end_line()
        if closing:
            if places[name]:
                close(places[name][-1])
            continue
        if name in VOID or attributes.endswith("/") and (name in ("svg", "math") or places["svg"] or places["math"]):
            continue
        while opened[solid[-1]][0] in ENDS.get(name, ()):
            close(solid[-1])
        if name in ("p", "li", "option", "a", "b", "i") and opened[-1][0] == name:
            close(len(opened) - 1)
        places[name].append(len(opened))
        if name not in INLINE:
            solid.append(len(opened))
        _, unseen, aside, article, link, loose = opened[-1]
        lifts, own = names_article(name, attributes), beside(name, attributes, article)
        # an article that opens here is no longer beside, but for what its own element says
        if lifts and aside <= lifts:
            aside = loose = 0
        if own == LOOSE:
            outer.append(loose)
            loose = len(outer) - 1
        aside = max(aside, own)
        opened.append((name, unseen or name in UNSEEN, aside, article or lifts > 0, link or name == "a", loose))
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}", re.I).search(page, pos)
            pos = end.start() if end else len(page)
    end_line()
    held = [0] * len(outer)
    for _, n, _, _, loose in lines:
        held[loose] += n
    for i in range(len(outer) - 1, 0, -1):
        held[outer[i]] += held[i]
    most = [True]  # whether a loose element and all around it hold most of the page's text
    for i in range(1, len(outer)):
        most.append(most[outer[i]] and 2 * held[i] > held[0])
    return [(text, n, aside > LOOSE or not most[loose], article) for text, n, aside, article, loose in lines]


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE, share: float = SHARE) -> str:
    """The lines between surges and dives, joined by one space."""
    if not page:
        return ""
    lines = strip_markup(page)
    named = any(article and not aside and n for _, n, aside, article in lines)
    # inside a named article neither blank lines nor what is dropped leave a gap; elsewhere they part what stands around
    inside = [line for line in lines if line[3] and line[0] and not line[2]] if named else lines
    kept = surged(np.array([0 if aside else n for _, n, aside, _ in inside], np.int64), window, surge, share)
    return " ".join(text for (text, _, aside, _), k in zip(inside, kept, strict=True) if text and not aside and k)


def surged(lengths: np.ndarray, window: int = WINDOW, surge: int = SURGE, share: float = SHARE) -> np.ndarray:
    """Whether a line lies between a surge of the window's text and the dive that ends it.

    A window is a line and those after it. It dives where all its lines are blank; of the lines between two dives all are
    kept if some window among them reaches the smaller of surge and the share of the longest window's text.
    """
    if not lengths.any():
        return np.zeros(len(lengths), bool)
    padded = np.concatenate([lengths, np.zeros(window, np.int64)])
    blocks = sum(padded[k : len(lengths) + k] for k in range(window))
    least = min(surge, share * int(blocks.max()))
    run = np.cumsum(np.concatenate([[False], (blocks[:-1] == 0)]))  # a new run after each line that a dive begins at
    reached = np.zeros(run[-1] + 1, bool)
    np.logical_or.at(reached, run, blocks >= max(1, least))
    return reached[run]


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html, with text (the article, empty if none) and n_chars (its code points) added.

    A null or empty page has the empty text. Pages of any length are read whole. Repeated pages give the same text;
    columns named text or n_chars are replaced; an empty table gives an empty result.
    """

    def found(pages: list[str | None]) -> list[tuple[str, int]]:
        texts = [main_text(p) for p in pages]
        return [(t, len(t)) for t in texts]

    return with_columns(pages, html_col, lambda: found, "text string, n_chars long")
