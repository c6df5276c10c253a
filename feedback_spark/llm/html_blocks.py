"""Main text of web pages: flat text blocks classified by a small decision tree.

1. A page is cut into flat blocks at block-level tags and line breaks. Scripts, styles, templates, comments and the
   head are dropped; character references are decoded; white space inside a block becomes one space. The head ends at
   its end tag, at the body or before the first tag or text that may not stand in it. Other dropped elements end at
   their end tag or with their parent; one without an end tag also where its parent's end is implied and before an
   article or main element. Only raw text (``RAW``) and comments run to the end of the page when unclosed, as in browsers.
2. Each block is described by its words and link density, those of its two neighbours, the kind of its tag and the
   innermost marked container around it: an article or main part, or page furniture such as menus, footers, forms,
   notices, adverts, sidebars and reader comments, told by tag, role, class or id. A name alone may mislead
   (``no-sidebar``): a main element in a container so named is main text, and an article too, except that one among
   teasers or comments is so only when the page has no other main text.
3. A decision tree (Gini impurity) decides which blocks are main text. It is grown on the two small labelled tables
   below when the operator starts, and sent to the tasks. Blocks in marked containers follow their mark; on pages without
   marks the tree goes by link density, words, kind and neighbours.

Pages are read where they lie, with no shuffle. A page is cut by one scan over its tags, in time by its length however broken it is.

Defined cases: null, empty and unparsable pages give an empty text; unclosed tags end with the page, and stray end tags are
passed over; repeated rows are each extracted; an empty table gives an empty table. Clashing extra columns are replaced.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from feedback_spark.llm.frames import texts_of, with_columns

# HTML element names.
RAW = "script style iframe textarea"
DROPPED = frozenset("template noscript head svg math object canvas audio video select button".split())
IN_HEAD = frozenset("html head title base basefont bgsound link meta noframes noscript template".split())
FURNITURE = frozenset("nav header footer aside form dialog menu fieldset".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "tr ul".split()
)
# A new one of these ends an open one of the same kind.
SELF_CLOSING = frozenset("p li dt dd option tr td th".split())
# Words in class, id or role that mark page furniture or the main part.
FURNITURE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|"
    r"gdpr|notice|notices|alert|popup|modal|overlay|sidebar|side-bar|aside|rail|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|"
    r"header|masthead|topbar|toolbar|comment|comments|commentlist|disqus|reply|replies|respond|share|sharing|social|related|recommended|"
    r"widget|newsletter|subscribe|subscription|signup|login|search|pagination|pager|tags|contentinfo|complementary)(?:$|[\s_-])"
)
# Of these, names of lists of teasers or comments, whose entries may be articles.
TEASER_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|comment|comments|commentlist|disqus|"
    r"reply|replies|respond|related|recommended|widget)(?:$|[\s_-])|(?:^|\s)(?:sidebar|side-bar|aside|rail|complementary)(?:$|\s)"
)
MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:main|articlebody|article-body|post-content|entry-content|main-content|article)(?:$|[\s_-])")

RAW_START = re.compile(rf"<(?:!--|({'|'.join(RAW.split())})\b)", re.I)
RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW.split()}
DROPPED_END = re.compile(rf"</({'|'.join(sorted(DROPPED))})\b", re.I)
TITLE_END = re.compile(r"</title\b", re.I)
TAG_START = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?])")
# What follows a tag's name up to its end, which is not inside quotes.
TAG_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
TAG_SIGNS = re.compile(r"[>\"']")
NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

FURNITURE_MARK, NO_MARK, MAIN_MARK = -1, 0, 1
# On open containers only: marked by name alone; the same for teasers or comments; dropped; an article among teasers or comments.
NAMED_MARK, TEASER_MARK, DROPPED_MARK, ENTRY_MARK = -2, -3, -4, 2


@dataclass
class Block:
    text: str
    words: int
    links: float  # share of characters inside links
    kind: int  # 2 heading, 1 paragraph, 0 other, -1 list item
    mark: int


def container_mark(name: str, attributes: str, outer: int) -> int:
    """The mark of an element inside a container marked ``outer``."""
    if outer in (FURNITURE_MARK, DROPPED_MARK):
        return outer
    found = " ".join(" ".join(m) for m in NAMES.findall(attributes)).lower() if "=" in attributes else ""
    named = bool(found) and name not in ("html", "body") and FURNITURE_NAME.search(found) is not None
    if outer in (NAMED_MARK, TEASER_MARK):
        if name == "main" or name == "article" and outer == NAMED_MARK:
            return MAIN_MARK if name == "main" or not (named and TEASER_NAME.search(found)) else TEASER_MARK
        if name == "article" and not named:
            return ENTRY_MARK
    elif name in MAIN or found and MAIN_NAME.search(found) and not FURNITURE_NAME.search(found):
        return outer if outer == ENTRY_MARK and name != "main" else MAIN_MARK
    if name == "header" and outer in (MAIN_MARK, ENTRY_MARK):
        return outer  # the head of an article belongs to it
    if name in FURNITURE:
        return FURNITURE_MARK
    if named:
        return TEASER_MARK if outer == TEASER_MARK or TEASER_NAME.search(found) else NAMED_MARK
    return outer


class TagEnds:
    """Where a tag of a page ends. The first tag without an end makes a table of all signs, so no part is searched again."""

    def __init__(self, page: str):
        self.page, self.signs, self.ends = page, None, None

    def after(self, at: int) -> int:
        """The place behind the end of the tag whose attributes start at ``at``, or -1."""
        if self.signs is None:
            found = TAG_REST.match(self.page, at)
            if found:
                return found.end()
            self._fill()
        return self.ends[bisect_left(self.signs, at)]

    def _fill(self) -> None:
        self.signs = [m.start() for m in TAG_SIGNS.finditer(self.page)]
        self.ends = [-1] * (len(self.signs) + 1)
        later: dict[str, int] = {}  # the next sign of each kind
        for i in range(len(self.signs) - 1, -1, -1):
            sign = self.page[self.signs[i]]
            if sign == ">":
                self.ends[i] = self.signs[i] + 1
            else:
                self.ends[i] = self.ends[later[sign] + 1] if sign in later else -1
                later[sign] = i


def without_raw(page: str) -> str:
    """``page`` with a space for each comment and each element of raw text."""
    ends, out, kept, at = TagEnds(page), [], 0, 0
    while found := RAW_START.search(page, at):
        name, at = found[1], found.end()
        if name is None:
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else len(page)
        else:
            start = ends.after(at)
            if start < 0:
                continue
            end = RAW_END[name.lower()].search(page, start)
            at = end.end() if end else len(page)
        out += [page[kept : found.start()], " "]
        kept = at
    return "".join([*out, page[kept:]])


def tags_of(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether an end tag, name or nothing, attributes) of each tag or declaration."""
    ends, at = TagEnds(page), 0
    last = page.rfind(">")
    while (found := TAG_START.search(page, at)) and found.start() < last:
        name = found[2]
        after = ends.after(found.end()) if name else page.find(">", found.end()) + 1
        if after <= 0:
            at = found.start() + 1
            continue
        yield found.start(), after, bool(found[1]), (name or "").lower(), page[found.end() : after - 1]
        at = after


def blocks_of(page: str) -> list[Block]:
    page = without_raw(page)
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    open_names: Counter[str] = Counter()
    parts: list[str] = []
    linked, at, link_depth, kind = 0, 0, 0, 0
    last_end = {m[1].lower(): m.start() for m in DROPPED_END.finditer(page)}
    skip, titles = 0, True

    def push(name: str, mark: int) -> None:
        stack.append((name, mark))
        open_names[name] += 1

    def pop() -> None:
        open_names[stack.pop()[0]] -= 1

    def close(name: str) -> None:
        """End the innermost open ``name`` and all inside it; each element is taken off once, stray ends cost nothing."""
        if open_names[name]:
            while stack[-1][0] != name:
                pop()
            pop()

    def end_block() -> None:
        nonlocal linked, parts
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            size = sum(not c.isspace() for c in text)
            out.append(Block(text, text.count(" ") + 1, min(1.0, linked / max(1, size)), kind, stack[-1][1] if stack else NO_MARK))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if stack and stack[-1][1] == DROPPED_MARK:
            if stack[-1][0] != "head" or text.isspace():
                return
            pop()
        parts.append(text)
        if link_depth:
            linked += len("".join(html.unescape(text).split()))

    for start, end, closing, name, attributes in tags_of(page):
        if start < skip:
            continue
        if start > at:
            add(page[at:start])
        at = end
        if not name:
            continue
        if name == "title" and not closing and titles:
            title_end = TITLE_END.search(page, at)
            skip = at = title_end.start() if title_end else at
            titles = title_end is not None
            continue
        if name == "body" and not closing and open_names["head"]:
            while open_names["head"]:
                pop()
        elif stack and stack[-1][0] == "head" and (name in ("body", "html", "br") if closing else name not in IN_HEAD):
            pop()
        if name in DROPPED:
            in_head = bool(stack) and stack[-1][0] == "head"
            if closing or name in ("button", "select"):
                close(name)
            if not closing and not (name in ("svg", "math") and attributes.endswith("/")) and not (in_head and (name == "head" or last_end.get(name, -1) < at)):
                push(name, DROPPED_MARK)
            continue
        # A dropped element that has no end tag ends where its parent does, also when that is implied.
        while not closing and stack and stack[-1][0] in DROPPED and last_end.get(stack[-1][0], -1) < at:
            if name not in MAIN and not (name in SELF_CLOSING and len(stack) > 1 and stack[-2][0] == name):
                break
            pop()
        if name == "a":
            link_depth = 0 if closing else 1
        if name not in BLOCKS:
            if not closing and name not in VOID and "=" in attributes:
                mark = container_mark(name, attributes, stack[-1][1] if stack else NO_MARK)
                if name != "a" and mark != (stack[-1][1] if stack else NO_MARK):
                    end_block()
                    push(name, mark)
            elif closing and stack and stack[-1][0] == name:
                end_block()
                pop()
            continue
        end_block()
        link_depth = 0 if name != "li" or closing else link_depth
        if closing:
            close(name)
        elif name not in VOID:
            if name in SELF_CLOSING and stack and stack[-1][0] == name:
                pop()
            push(name, container_mark(name, attributes, stack[-1][1] if stack else NO_MARK))
        inner = name if not closing else (stack[-1][0] if stack else "")
        if name != "br":
            kind = 2 if inner in HEADINGS else 1 if inner in ("p", "blockquote", "pre") else -1 if inner in ("li", "option", "dt") else 0
    if at < len(page) and not page[at:].lstrip().startswith("<"):
        add(page[at:])
    end_block()
    entries = FURNITURE_MARK if any(b.mark == MAIN_MARK for b in out) else MAIN_MARK
    for block in out:
        block.mark = entries if block.mark == ENTRY_MARK else max(block.mark, FURNITURE_MARK)
    return out


FEATURES = ("mark", "links", "words", "links_before", "words_before", "links_after", "words_after", "kind")


def features(blocks: list[Block]) -> np.ndarray:
    rows = np.zeros((len(blocks), len(FEATURES)))
    if blocks:
        links, words = np.array([b.links for b in blocks]), np.array([b.words for b in blocks])
        rows[:, 0], rows[:, 1], rows[:, 2] = [b.mark for b in blocks], links, words
        rows[1:, 3], rows[1:, 4], rows[:-1, 5], rows[:-1, 6] = links[:-1], words[:-1], links[1:], words[1:]
        rows[:, 7] = [b.kind for b in blocks]
    return rows


W = "word "
# The labelled table: for each sample page its main blocks, as written between the marks, and all others. A block is
# (label, html); the html may open or close containers around it.
LABELLED_PAGES: list[list[tuple[int, str]]] = [
    # News: menu, advert, article of long and very short paragraphs, comments, footer.
    [(0, "<nav><ul><li><a href=1>Home</a>"), (0, "<li><a href=1>World news</a>"), (0, "<li><a href=1>Sport</a></ul></nav>"),
     (0, "<div class=ad>" + W * 8 + "</div>"), (1, "<article><h1>" + W * 9 + "</h1>"), (1, "<p>" + W * 60), (1, "<p>Yes.</p>"),
     (1, "<p>" + W * 45 + "<a href=1>a link</a></p>"), (1, "<p>" + W * 150), (1, "<p>No.</p></article>"),
     (0, "<section id=comments><h3>Comments</h3>"), (0, "<p>" + W * 40), (0, "<p>" + W * 90 + "</section>"),
     (0, "<footer>&copy; " + W * 12 + "</footer>")],
    # Blog: short article, lists, quotes, a sharing bar and a form inside, links as paragraphs.
    [(0, "<header><a href=1>My blog</a></header>"), (0, "<aside><h3>About me</h3>"), (0, "<p>" + W * 35 + "</aside>"),
     (1, "<article><h1>Title</h1>"), (1, "<p>One.</p>"), (1, "<p><a href=1>Only a link</a></p>"), (1, "<ul><li>" + W * 3),
     (1, "<li><a href=1>linked item</a></ul>"), (0, "<div class=share><a href=1>Share</a> this</div>"), (1, "<h2>More</h2>"),
     (1, "<blockquote>" + W * 25 + "</blockquote>"), (0, "<form>Subscribe to " + W * 10 + "</form>"), (1, "<p>End</p></article>"),
     (0, "<footer><a href=1>Imprint</a></footer>")],
    # Article of single words between links, with a notice.
    [(0, "<div id=cookie-notice>" + W * 50 + "</div>"), (0, "<nav><a href=1>Home</a></nav>"), (1, "<article><h1>Go</h1>"),
     (1, "<p>" + W * 14), (1, "<p>" + W * 2), (1, "<p><a href=1>" + W * 4 + "</a>"), (1, "<p>So</p></article>"), (0, "<nav><a href=1>Next</a></nav>"),
     (0, "<div class=sidebar><p>" + W * 30 + "</div>")],
    # Article of one block; article of two.
    [(0, "<nav><a href=1>Up</a></nav>"), (1, "<article>" + W * 200 + "</article>"), (0, "<footer>" + W * 3 + "</footer>")],
    [(1, "<main><h1>" + W * 6 + "</h1>"), (1, "<p>" + W * 7 + "</main>"), (0, "<footer>" + W * 25 + "</footer>")],
    [(0, "<aside>" + W * 70 + "</aside>"), (1, "<main><p>Hm</p>"), (1, "<p>Ok</main>"), (0, "<aside><p>" + W * 60 + "</aside>")],
    # Article of linked headings and list items only.
    [(1, "<article><h2><a href=1>" + W * 5 + "</a></h2>"), (1, "<ul><li><a href=1>" + W * 2 + "</a>"), (1, "<li><a href=1>" + W * 6 + "</a>"),
     (1, "<li><a href=1>x</a></ul>"), (1, "<p>" + W * 22 + "</article>"), (0, "<div class=related><a href=1>" + W * 8 + "</a></div>")],
    # No marks: link lists around running text, a copyright line.
    [(0, "<ul><li><a href=1>Home</a>"), (0, "<li><a href=1>News today</a>"), (0, "<li><a href=1>About</a></ul>"), (1, "<h1>" + W * 4 + "</h1>"),
     (1, "<p>" + W * 30), (1, "<p>" + W * 2), (1, "<p>" + W * 65), (1, "<p>" + W * 18 + "<a href=1>see</a>"), (1, "<p>" + W * 28 + "</p>"),
     (0, "<div><a href=1>Imprint</a> and <a href=1>privacy</a></div>")],
    [(0, "<div><a href=1>Log in</a></div>"), (0, "<div><a href=1>Help</a></div>"), (1, "<h2>" + W * 7 + "</h2>"), (1, "<div>" + W * 90 + "</div>"),
     (1, "<div>" + W * 12 + "</div>"), (1, "<div>" + W * 40 + "</div>"), (0, "<div><a href=1>" + W * 6 + "</a></div>"),
     (0, "<div><a href=1>" + W * 9 + "</a></div>"), (0, "<div><a href=1>" + W * 14 + "</a></div>")],
    [(0, "<table><tr><td><a href=1>A</a>"), (0, "<td><a href=1>B b</a>"), (0, "<td><a href=1>C</a></table>"), (1, "<p>" + W * 50), (1, "<p>" + W * 5),
     (1, "<p>" + W * 25), (1, "<ul><li>" + W * 10), (1, "<li>" + W * 4 + "</ul>"), (1, "<p>" + W * 16 + "</p>"), (0, "<div><a href=1>" + W * 3 + "</a></div>"),
     (0, "<ul><li><a href=1>" + W * 11 + "</a>"), (0, "<li><a href=1>" + W * 12 + "</a></ul>")],
    [(1, "<p>" + W * 20 + "</p>")], [(1, W * 35)], [(1, "<p>" + W * 6 + "</p>"), (1, "<p>" + W * 9 + "</p>")],
]

# Pages without any mark, as (label, kind, words, links) of their blocks in order: what their text is, only sizes, links and
# neighbours tell.
UNMARKED_PAGES: list[list[tuple[int, int, int, float]]] = [
    # News: menu, date, advert line, story with a short answer, teasers, owner's line.
    [(0, -1, 1, 1), (0, -1, 2, 1), (0, -1, 1, 1), (0, 0, 4, 0), (0, 0, 9, 0), (1, 2, 8, 0), (1, 1, 46, 0), (1, 1, 71, 0.04), (1, 1, 2, 0),
     (1, 1, 38, 0), (1, 1, 55, 0), (0, 0, 7, 1), (0, 0, 9, 1), (0, 0, 12, 0.1)],
    # Blog: motto, text with a bare line, list of other entries under a heading of its own.
    [(0, 0, 3, 1), (0, 0, 2, 1), (0, 0, 14, 0), (1, 2, 5, 0), (1, 1, 30, 0.1), (1, 1, 88, 0), (1, 0, 40, 0), (1, 1, 17, 0.3), (0, 2, 2, 0),
     (0, -1, 5, 1), (0, -1, 6, 1), (0, -1, 4, 1), (0, 0, 8, 0)],
    # Manual: steps between paragraphs, two sections.
    [(0, -1, 2, 1), (0, -1, 3, 1), (0, -1, 2, 1), (0, -1, 2, 1), (1, 2, 4, 0), (1, 1, 25, 0), (1, -1, 6, 0), (1, -1, 11, 0.2), (1, -1, 8, 0),
     (1, 1, 33, 0), (1, 2, 3, 0), (1, 1, 52, 0.05), (0, 0, 3, 1), (0, 0, 10, 0.15)],
    # Product: short description, properties, price line.
    [(0, 0, 2, 1), (0, 0, 6, 0), (1, 2, 6, 0), (1, 1, 42, 0), (1, -1, 5, 0), (1, -1, 4, 0), (1, 1, 19, 0), (0, 0, 4, 0.5), (0, 0, 2, 1), (0, 0, 11, 0)],
    # Stub of one paragraph; letter of short paragraphs; reference with linked terms.
    [(0, -1, 1, 1), (0, -1, 1, 1), (0, 0, 8, 0), (1, 2, 7, 0), (1, 1, 64, 0), (0, 0, 13, 0)],
    [(0, -1, 1, 1), (0, -1, 2, 1), (0, 0, 10, 0), (1, 2, 12, 0), (1, 1, 14, 0), (1, 1, 9, 0), (1, 1, 12, 0), (1, 1, 8, 0), (0, 0, 15, 0)],
    [(0, 0, 1, 1), (0, 0, 1, 1), (1, 2, 2, 0), (1, 1, 39, 0.35), (1, 1, 58, 0.28), (1, 2, 3, 0), (1, 1, 31, 0.3), (0, -1, 3, 1), (0, -1, 4, 1)],
    # Text in plain containers; texts alone.
    [(0, 0, 2, 1), (0, 0, 1, 1), (1, 2, 7, 0), (1, 0, 90, 0), (1, 0, 35, 0), (1, 0, 61, 0.02), (0, 0, 5, 1), (0, 0, 9, 0)],
    [(1, 2, 4, 0), (1, 1, 12, 0), (1, 1, 9, 0)], [(1, 1, 28, 0)], [(1, 1, 9, 0), (1, 1, 6, 0)], [(1, 0, 35, 0)],
]


class Tree:
    """A binary decision tree grown by Gini impurity."""

    def __init__(self, rows: np.ndarray, depth: int = 8):
        x, y = rows[:, :-1], rows[:, -1]
        self.left = self.right = None
        self.value = bool(y.mean() >= 0.5)
        self.feature, self.limit = 0, 0.0
        if not depth or len(set(y.tolist())) == 1:
            return
        best = 1e-9
        base = self._impurity(y)
        for feature in range(x.shape[1]):
            values = np.unique(x[:, feature])
            for limit in (values[1:] + values[:-1]) / 2:
                low = x[:, feature] < limit
                gain = base - self._impurity(y[low]) - self._impurity(y[~low])
                if gain > best + 1e-9:
                    best, self.feature, self.limit = gain, feature, float(limit)
        if best > 1e-9:
            low = x[:, self.feature] < self.limit
            self.left, self.right = Tree(rows[low], depth - 1), Tree(rows[~low], depth - 1)

    @staticmethod
    def _impurity(y: np.ndarray) -> float:
        return len(y) * 2 * y.mean() * (1 - y.mean()) if len(y) else 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        low = x[:, self.feature] < self.limit
        out = np.empty(len(x), bool)
        out[low], out[~low] = self.left.predict(x[low]), self.right.predict(x[~low])
        return out


def labelled_rows(pages: list[list[tuple[int, str]]]) -> np.ndarray:
    """The FEATURES of each labelled block and its label."""
    rows = []
    for page in pages:
        found = features(blocks_of("".join(part for _, part in page)))
        rows.append(np.column_stack([found, np.array([label for label, _ in page], float)]))
    return np.concatenate(rows)


def unmarked_rows(pages: list[list[tuple[int, int, int, float]]]) -> np.ndarray:
    """The FEATURES and label of each block of ``UNMARKED_PAGES``; each page once more with its main part and furniture marked."""
    rows = []
    for furniture, main in ((NO_MARK, NO_MARK), (FURNITURE_MARK, MAIN_MARK)):
        for page in pages:
            found = features([Block("", words, links, kind, main if label else furniture) for label, kind, words, links in page])
            rows.append(np.column_stack([found, np.array([row[0] for row in page], float)]))
    return np.concatenate(rows)


def training_rows(exchanges: int = 8) -> np.ndarray:
    """Rows of both tables. Marked blocks stand there also beside ``exchanges`` other neighbours each: a mark holds whatever is near."""
    rows = np.concatenate([labelled_rows(LABELLED_PAGES), unmarked_rows(UNMARKED_PAGES)])
    marked, near = rows[rows[:, 0] != NO_MARK], slice(3, 7)
    moved = []
    for step in range(1, exchanges + 1):
        other = marked.copy()
        other[:, near] = np.roll(marked[:, near], 7 * step, axis=0)
        moved.append(other)
    return np.concatenate([rows, *moved])


def train(pages: list[list[tuple[int, str]]] | None = None) -> Tree:
    """A tree of the given pages, or of both tables."""
    return Tree(labelled_rows(pages) if pages else training_rows())


def main_text(page: str, tree: Tree) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, main in zip(blocks, tree.predict(features(blocks))) if main)


def extract(df: DataFrame, html_column: str = "html", text_column: str = "text", tree: Tree | None = None, keep_html: bool = True) -> DataFrame:
    """``df`` with the main text of each page."""
    tree = tree or train()

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        cut = [blocks_of(p) for p in texts_of(batch, html_column)]
        main = tree.predict(np.concatenate([np.zeros((0, len(FEATURES))), *map(features, cut)])).tolist()
        texts, start = [], 0
        for blocks in cut:
            texts.append("\n".join(b.text for b, kept in zip(blocks, main[start : start + len(blocks)]) if kept))
            start += len(blocks)
        return {text_column: pa.array(texts, pa.string())}

    return with_columns(df, [html_column], f"{text_column} string", work, drop=() if keep_html else (html_column,))
