"""Main text of web pages by tree scoring.

The page is read as a tree that tolerates missing end tags. Text blocks pass points for their
length and commas to their ancestors, less to farther ones; a container's points are
discounted by its share of link text. An element whose text is all in one child is a mere
wrapper and counts as no step on the way up. The container with the most points is kept, or the
article around it, with those siblings, of it and of its ancestors, that score or read like
article text. Menus, page headers, footers, sidebars, notices, adverts, forms, comments and
hidden parts, told by tag, role or the names in class and id, are left out wherever they stand;
but names never leave out an element that is the container of most of the page's text. An
article whose headline is a link announces another page, unless it holds most of the text.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SENTENCE = re.compile(r"""[.!?\u2026\u3002\uff01\uff1f\u061f\u0964]["'\u201d\u2019\u00bb)\]]*(?:\s|\Z)""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Never article text, with all they hold.
DROPPED = frozenset(
    "script style textarea title xmp iframe noembed noframes noscript template head nav footer aside form button select input dialog menu svg math canvas object audio video map search fieldset".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form tablist toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner sidebar sidebars menu navbar nav navigation breadcrumb breadcrumbs "
    "footer masthead comment comments disqus respond replies cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing "
    "social related recommended pagination pager toolbar widget widgets skip hidden".split()
)
#: Words that leave out a block, an article too, whatever stands beside them in its name.
COMMENT_WORDS = frozenset("comment comments disqus".split())
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertisements adsense adslot sponsor sponsored promo promoted newsletter popup teaser teasers".split())
RELATED_WORDS = frozenset("related recommended recommendations".split())
#: But not beside these: ``comments-open`` and ``no-ads`` tell a state, ``related-work`` is a section's subject.
STATES = frozenset("has no not without with open opened closed enabled disabled off free allow allowed".split())
SUBJECTS = frozenset("work works literature research theory concepts terms methods".split())
#: Words that may stand beside a dropped one in a name: ``site-footer`` is one, ``has-sidebar`` and ``social-policy`` are not.
QUALIFIERS = frozenset(
    "left right top bottom site main area list box container wrapper bar block section inner outer slot unit primary secondary global page post "
    "link links button buttons body div even odd depth icons item items panel group sticky mobile desktop form".split()
)
#: Share of the page's text that makes an element its container, with a heading or an article inside and without.
MOST, NEARLY_ALL = 0.5, 0.9
#: A start tag ends these open elements, if no element of the second set lies between.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table".split())
#: Siblings that a long text makes part of the article.
TEXTUAL = frozenset("p section div article blockquote pre figure details center".split()) | LISTS
#: Ancestors that a block's points reach.
REACH = 5


def attributes(source: str) -> dict[str, str]:
    found = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def named(names: str, words: frozenset[str]) -> bool:
    """Whether a whole name consists of ``words``, with no more than qualifiers beside them."""
    for name in names.split():
        parts = set(_WORD.findall(name))
        if not words.isdisjoint(parts) and parts <= words | QUALIFIERS:
            return True
    return False


def mentioned(names: str, words: frozenset[str], but: frozenset[str]) -> bool:
    """Whether a name holds one of ``words`` and none of ``but``; capitals start words, too."""
    for name in names.split():
        parts = set(_WORD.findall(name.lower())) | {w.lower() for w in _CAMEL.findall(name)}
        if not words.isdisjoint(parts) and but.isdisjoint(parts):
            return True
    return False


def unwanted(tag: str, source: str, in_article: bool, in_code: bool = False) -> str:
    """Whether an element is left out with all it holds: "" or the reason, "part", "name" or "comments".

    Names inside of preformatted text are a highlighter's, and leave out nothing.
    """
    if tag in DROPPED:
        return "part"
    if tag == "header" and not in_article:
        return "part"
    if not source.strip() or tag in ("html", "body"):
        return ""
    own = attributes(source)
    if "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower():
        return "part"
    if own.get("role", "").lower() in DROPPED_ROLES:
        return "part"
    names = f"{own.get('class', '')} {own.get('id', '')}"
    if in_code or names == " ":
        return ""
    block = tag in BLOCK or "-" in tag
    if block and tag not in HEADINGS and tag != "main":
        if mentioned(names, COMMENT_WORDS, STATES):
            return "comments"
        if mentioned(names, ADVERT_WORDS, STATES) or mentioned(names, RELATED_WORDS, STATES | SUBJECTS):
            return "name"
    if tag in ("article", "main"):
        return ""
    return "name" if named(names.lower(), DROPPED_WORDS if in_article else DROPPED_WORDS | {"header"}) else ""


class Page:
    """Elements in page order, and text blocks with the element that holds them."""

    def __init__(self, source: str, containers: frozenset[int] = frozenset()):
        """``containers`` are elements that names do not leave out."""
        self.containers = containers
        self.named: list[tuple[int, str]] = []  # elements left out by name, and the reason
        self.part, self.own, self.heads = [False], [0], [0]  # left out otherwise; letters, headings (2) or articles (1), names aside
        self.code = [False]
        self.tag, self.parent, self.dropped, self.article, self.linked = ["#"], [-1], [False], [False], [False]
        self.end = [0]
        self.blocks: list[tuple[int, str, int]] = []  # (element, text, letters in links)
        self.stack, self.open_tags = [0], Counter("#")
        self.pieces: list[str] = []
        self.holder = 0
        self.in_links = 0
        at = 0
        while True:
            found = _TOKEN.search(source, at)
            self.text(source[at : found.start() if found else len(source)])
            if not found:
                break
            at = found.end()
            slash, name, rest = found.groups()
            if name is None:
                continue
            tag = name.lower()
            if slash:
                self.close(tag)
                continue
            self.open(tag, rest)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
                at = close.start() if close else len(source)
        self.flush()
        while self.stack:
            self.pop()

    def text(self, piece: str) -> None:
        if not self.part[self.stack[-1]]:
            self.own[self.stack[-1]] += len(piece.strip())
        if piece and not self.dropped[self.stack[-1]]:
            piece = html.unescape(piece) if "&" in piece else piece
            self.pieces.append(piece)
            if self.linked[self.stack[-1]]:
                self.in_links += len(piece.strip())

    def flush(self) -> None:
        """A block ends here."""
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append((self.holder, text, self.in_links))
            self.pieces, self.in_links = [], 0

    def block_holder(self) -> int:
        return next((k for k in reversed(self.stack) if self.tag[k] in BLOCK), 0)

    def pop(self) -> None:
        k = self.stack.pop()
        self.end[k] = len(self.tag)
        self.open_tags[self.tag[k]] -= 1

    def open(self, tag: str, rest: str) -> None:
        if tag in BLOCK:
            self.flush()
            self.implied(tag)
        if tag in VOID:
            if tag in ("br", "hr"):
                self.text(" ")
            return
        top = self.stack[-1]
        k = len(self.tag)
        self.tag.append(tag)
        self.parent.append(top)
        self.article.append(self.article[top] or tag in ("article", "main"))
        reason = unwanted(tag, rest, self.article[top], self.code[top])
        by_name = reason in ("name", "comments")
        if by_name:
            self.named.append((k, reason))
        self.code.append(self.code[top] or tag in ("pre", "code"))
        self.part.append(self.part[top] or reason == "part")
        self.dropped.append(self.dropped[top] or reason == "part" or (by_name and k not in self.containers))
        self.own.append(0)
        self.heads.append(0 if self.part[k] or reason else 2 if tag in ("h1", "main") else int(tag == "article"))
        self.linked.append(self.linked[top] or tag == "a")
        self.end.append(k + 1)
        self.stack.append(k)
        self.open_tags[tag] += 1
        if tag in BLOCK:
            self.holder = k

    def implied(self, tag: str) -> None:
        """End the elements that a block's start tag ends: an open paragraph, a list item, a cell."""
        closed, within = CLOSES.get(tag, (frozenset(), frozenset()))
        depth = None
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.tag[self.stack[k]]
            if name == "p" or name in closed:
                depth = k
                if name != "p":
                    break
            elif name in within or (name in BLOCK and name not in closed):
                break
        if depth is not None:
            while len(self.stack) > depth:
                self.pop()

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if not self.open_tags[tag]:
            return
        depth = next(k for k in range(len(self.stack) - 1, 0, -1) if self.tag[self.stack[k]] == tag)
        if tag not in BLOCK and any(self.tag[k] in BLOCK for k in self.stack[depth + 1 :]):
            return  # a stray end of an inline element does not end blocks
        while len(self.stack) > depth:
            self.pop()
        if tag in BLOCK:
            self.holder = self.block_holder()


def read_page(source: str) -> Page:
    """The page, with those elements in that a name leaves out although they hold most of its text."""
    page = Page(source)
    if not page.named:
        return page
    held, heads = page.own[:], page.heads[:]
    for k in range(len(page.tag) - 1, 0, -1):
        held[page.parent[k]] += held[k]
        heads[page.parent[k]] = max(heads[page.parent[k]], heads[k])

    def holds_most(k: int, reason: str) -> bool:
        if reason == "comments":  # readers may write more than the author: a title or all of the text
            return held[k] > MOST * held[0] if heads[k] == 2 else held[k] == held[0]
        return held[k] > (MOST if heads[k] else NEARLY_ALL) * held[0]

    containers = frozenset(k for k, reason in page.named if holds_most(k, reason))
    return Page(source, containers) if containers else page


def main_text(source: str | None) -> str:
    """Main text of one page: its blocks, joined by line breaks."""
    page = read_page(source or "")
    blocks = page.blocks
    if not blocks:
        return ""
    n = len(page.tag)
    points, letters, linked, sentences = [0.0] * n, [0] * n, [0] * n, [False] * n
    teasers = set()
    for holder, text, links in blocks:
        letters[holder] += len(text)
        linked[holder] += links
        if page.tag[holder] == "p" and _SENTENCE.search(text):
            sentences[holder] = True
        if page.tag[holder] in HEADINGS and links and page.article[holder] and links >= len(text.replace(" ", "")):
            up = holder
            while up > 0 and page.tag[up] != "article":
                up = page.parent[up]
            teasers.add(up)
    for k in range(n - 1, 0, -1):
        letters[page.parent[k]] += letters[k]
        linked[page.parent[k]] += linked[k]
        sentences[page.parent[k]] |= sentences[k]
    for holder, text, _ in blocks:
        if len(text) < 25 or page.tag[holder] in HEADINGS:
            continue
        worth = 1 + text.count(",") + min(len(text) // 100, 3)
        up = holder if page.tag[holder] in ("div", "section", "article", "main", "body") else page.parent[holder]
        level = 0
        while up >= 0:
            points[up] += worth / (1, 2, 6, 9, 12)[level]
            level += up > 0 and letters[page.parent[up]] > letters[up]
            if level == REACH:
                break
            up = page.parent[up]

    def density(k: int) -> float:
        return min(linked[k] / letters[k], 1.0) if letters[k] else 0.0

    scores = [p * (1 - density(k)) for k, p in enumerate(points)]
    best = max(range(n), key=lambda k: (scores[k], -k))
    if scores[best] <= 0:
        best = next((k for k in range(n) if page.tag[k] in ("article", "main") and letters[k]), 0)
    up = best
    while up > 0:  # the article around it, or else the main part
        if page.tag[up] == "article" or (page.tag[up] == "main" and page.tag[best] != "article"):
            best = up
        up = page.parent[up]
    least = max(10.0, 0.2 * scores[best])
    # An article, a main part and what is left of a page are bounds; another container has none.
    bounded = page.article[best]
    kept = [(best, page.end[best])]

    def is_text(k: int, level: int, before: bool) -> bool:
        """Whether a sibling belongs to the text, ``level`` branchings above the container."""
        tag = page.tag[k]
        if not letters[k] or density(k) >= 0.25 and scores[k] < least:
            return False
        if k in teasers and best not in teasers:
            return False
        if scores[k] >= least or (letters[k] > 80 and tag in (TEXTUAL - LISTS if bounded else TEXTUAL)):
            return True
        if bounded:
            return False
        if tag == "h1":
            return before
        return level == 1 and (tag in HEADINGS or (not linked[k] and (sentences[k] or tag in LISTS)))

    path, level = best, 0
    while path > 0:
        own = page.parent[path]
        if letters[own] > letters[path]:
            level += 1
            child = own + 1
            while child < page.end[own]:
                if child != path and is_text(child, level, child < path):
                    kept.append((child, page.end[child]))
                child = max(page.end[child], child + 1)
            if bounded:
                break
        path = own
    # Announcements go, unless the page is a list of them.
    listed = best in teasers or 2 * sum(letters[k] for k in teasers if best < k < page.end[best]) > letters[best]
    left = [] if listed else [(k, page.end[k]) for k in teasers if not k < best < page.end[k]]
    return "\n".join(
        text for holder, text, _ in blocks if any(a <= holder < b for a, b in kept) and not any(a <= holder < b for a, b in left)
    )


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    A null or empty page, and one without text outside the parts left out, has an empty text.
    Rows that repeat a page_id, or have none, are read one by one. Nothing is cut off, however
    long a page is or however deep its tree. Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(source) for source in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
