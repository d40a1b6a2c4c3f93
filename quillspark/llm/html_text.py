"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. A block's features are its words, the share of them in links, the same of the blocks
before and after it, the kind of its own tag, its place (inside an article, in a part that tags or roles mark as something else, in
a part that only words in class or id mark so, beside the page's article, or unmarked), and how many unlinked words the page has in
articles or unmarked. A decision tree is trained on the blocks of the small labelled pages below when the module is loaded, and keeps
or drops each block.

Words in class or id are features, no verdict: an article or main element in a part that only words mark is the page's article,
unless the page has one in fewer such parts, and blocks in such parts are kept or dropped by the tree.

Defined results: a null or empty page, or one without blocks that are kept, has an empty text; markup that is broken is read as far
as it goes (an unclosed element ends with its parent, a head where something starts that cannot be in one, another unclosed element
without text at the next block); pages of any length are read whole; a null id or url is kept; repeated rows
give repeated results; columns other than id, url and html are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.base import frugal, table

#: Elements by role. Content of DROPPED ones is no text; VOID ones have no content; the others that start a block:
DROPPED = frozenset("script style template noscript svg math iframe object head title audio video canvas select datalist".split())
#: What can be in a head; other elements end it.
IN_HEAD = frozenset("head title base basefont bgsound link meta style script noscript template object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td textarea tfoot th "
    "thead tr ul".split()
)
#: A paragraph ends where one of these starts.
ENDS_PARAGRAPH = BLOCKS - {"br", "button", "option", "textarea"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Parts that are not the article, by tag, role, and words in class or id. An article inside a SOFT part is an article all the same.
OTHER_TAGS, SOFT_TAGS = frozenset("nav footer aside menu dialog search".split()), frozenset("header form fieldset button textarea label".split())
OTHER_ROLES = frozenset("navigation contentinfo complementary search alert dialog alertdialog menu menubar toolbar".split())
SOFT_ROLES = frozenset("banner form".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts adbox adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations "
    "comment comments disqus reply replies respond sidebar rail widget widgets nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "footer copyright login signin signup register toolbar skip tags tagcloud feedback paywall".split()
)
#: With one of these a name tells of a state or a layout (has-sidebar, comments-open), not of what the part is.
STATE_WORDS = frozenset("has no with without open closed enabled disabled layout".split())
SOFT_WORDS = frozenset("header masthead topbar form search".split())
ARTICLE_TAGS = frozenset("article main".split())
ARTICLE_WORDS = frozenset("article content post entry story articlebody maincontent main text".split())

#: Places of a block.
OTHER, BESIDE, UNMARKED, ARTICLE, NAMED = 0, 1, 2, 3, 4
FEATURES = ("place", "elsewhere", "words", "links", "words_before", "links_before", "words_after", "links_after", "kind")
#: Kinds of a block's own tag.
KINDS = {"li": 1, "td": 1, "th": 1, "dd": 1, "dt": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "p": 3, "blockquote": 3, "pre": 3}

#: Labelled pages: n unlinked words stand for {n}, n linked ones for [n]; the blocks whose tag has + are the main text.
LABELLED_PAGES = (
    "<header><a href=/>[2]</a></header><nav><ul><li>[1]<li>[2]<li>[1]<li>[3]</ul></nav><main><article><h1 +>{9}</h1><p +>{120}</p><p +>{45} [5] {30}</p><h2 +>{3}</h2><p +>{55}</p><p +>{1}</p><p +>{75}</p><p +>{2}</p></article><aside><h3>{2}</h3><ul><li>[5]<li>[4]</ul><p>{60}</p></aside></main><footer><p>{12}</p><p>[2] {6}</p></footer>",
    "<div class=topbar>{4} [2]</div><article class=post><h1 +>{6}</h1><p +>{14} [14]</p><p +>{61}</p><ul><li +>{6}<li +>{8} [2]<li +>{7}</ul><blockquote +>{33}</blockquote><p +>[4]</p><p +>{65}</p><ul><li>[2]<li>[3]<li>[4]<li>[5]</ul></article><section id=comments><h3>{2}</h3><p>{90}</p><p>{40}</p><p>{15} [2]</p></section>",
    "<article><div +>{30}</div></article><footer>{8}</footer>",
    "<nav>[1] [2]</nav><article><p +>{5}</p><div +>{90}</div><div class=share>[2]</div><div class=ad>{6}</div><p +>{4}</p></article><div>{20}</div><p>{60}</p><p>{7}</p><div>{3}</div>",
    "<div class=cookie-notice><p>{25}</p><button>{1}</button></div><main><h1 +>{7}</h1><p +>{80}</p><form><label>{2}</label><button>{1}</button></form><p +>{35}</p><div class=newsletter><p>{15}</p></div><p +>{3}</p></main><div class=related><h3>{2}</h3><ul><li>[6]<li>[7]</ul></div><footer><p>{200}</p></footer>",
    "<p>[1] [1] [2]</p><h1 +>{8}</h1><p +>{75}</p><p +>{60}</p><h2 +>{4}</h2><p +>{80}</p><p +>{35} [4]</p><p +>{3}</p><p +>{45}</p><p +>{1}</p><p +>{20}</p><p>{2} [8]</p>",
    "<ul><li>[1]<li>[2]<li>[1]</ul><h2 +>{2}</h2><p +>{20}</p><p +>{50}</p><div +>{150} [20]</div><p>{5} [7]</p><ul><li>[2]<li>[3]</ul>",
    "<p +>{15}</p>", "<p +>{6}</p><p +>{2}</p><p +>{6}</p>", "<div +>{6}</div>", "<div><a href=/>[3]</a></div><h2 +>{3}</h2><p +>{8}</p>", "<h2 +>{3}</h2><p +>{4}</p>", "<p +>{5}</p><p +>{3}</p><p +>{2}</p>",
    "<ul><li>[20] {9}<li>[18] {10}<li>[22] {6}</ul>", "<div><a href=/>[5] </a>{3}</div><div>[6] {4}</div><div>[9] {1}</div>", "<h1 +>{5}</h1><ul><li +>{12}<li +>{14}<li +>{11}</ul>",
    "<nav><a href=/>[1]</a></nav><div id=widgets><p +>{30}</p><p>[1]</p></div>", "<div class=sidebar><p +>{90}</p><p +>{40} [4]</p><p +>{120}</p></div><footer>{6}</footer>", "<div class=comments><div +>{200}</div></div>",
    "<div><p +>{30}</p></div><div class=comments><p>{30}</p><p>{8}</p></div>", "<div><p +>{45}</p><p +>{70}</p></div><div id=sidebar><h3>{2}</h3><p>{60}</p><p>{110}</p></div><div class=promo>{12} [3]</div><div class=ads>{3}</div>",
    "<div class=promo>{8}</div><div class=share>[1] [1]</div>", "<div class=notice><p>{12}</p></div>", "<div class=widget><p +>{60} [12]</p><div>{3}</div><p +>{25}</p><p>[30] {12}</p></div>", "<div class=tags>[2] [3]</div><div class=login>{2}</div>",
    "<aside><p>{30}</p></aside>", "<footer><p>{90}</p></footer><nav>{12}</nav>", "<div><p +>{55}</p></div><aside><p>{35}</p><p>{100}</p></aside><footer>{25} [10]</footer>", "<div id=header>{4}</div><div>{3} [9]</div><p +>{22}</p><p +>{40}</p><div id=footer>{9}</div>",
)


def labelled_blocks() -> list[tuple]:
    """(features, label) of each block of the labelled pages, as rows for train()."""
    rows = []
    for page in LABELLED_PAGES:
        page = re.sub(r"<(\w+) \+", r"<\1 data-main=1", page)
        page = re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), page)
        page = re.sub(r"\[(\d+)\]", lambda m: "<a href=/x>" + " ".join(["link"] * int(m[1])) + "</a>", page)
        found = Blocks(page).found
        rows += [(*f, int(b[6])) for b, f in zip(found, features(found), strict=True)]
    return rows


@dataclass
class Node:
    label: int
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def train(rows: list[tuple], depth: int = 9) -> Node:
    """A tree by Gini impurity; ties go to the earlier feature and the lower cut."""
    labels = [r[-1] for r in rows]
    node = Node(int(2 * sum(labels) > len(labels)))
    if depth == 0 or len(set(labels)) < 2:
        return node
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values[:-1], values[1:], strict=True):
            cut = (a + b) / 2
            parts = [[r[-1] for r in rows if r[f] <= cut], [r[-1] for r in rows if r[f] > cut]]
            gini = sum(len(p) * (s := sum(p) / len(p)) * (1 - s) for p in parts)
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, cut)
    if best is None:
        return node
    node.feature, node.cut = best[1], best[2]
    node.low, node.high = (train([r for r in rows if (r[best[1]] <= best[2]) == side], depth - 1) for side in (True, False))
    return node


def decide(node: Node, row: tuple) -> bool:
    while node.feature >= 0:
        node = node.low if row[node.feature] <= node.cut else node.high
    return bool(node.label)


#: Tags of DROPPED elements that hold markup, outside of comments and raw text.
_DROPPED_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title)\b.*?(?:</(?P=raw)\b|\Z)|<(?P<close>/?)(?P<tag>{'|'.join(sorted(DROPPED - {'script', 'style', 'title', 'head'}))})(?=[\s/>])", re.S | re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\b", re.I) for tag in ("script", "style", "textarea", "title")}
_STOP = re.compile(r"[>\"']")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _words(value: str) -> set[str]:
    return set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))


def _part(tag: str, attrs: str) -> str:
    """What an element makes of its content: "drop", "other", "named" (other, by words only), "soft", "article" ("comment": with words
    of something else), "text" (article, by words only) or "" (no change)."""
    role, names, whole, other, gone = "", set(), set(), set(), False
    if attrs and "=" in attrs or "hidden" in attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                for name in value.split():
                    words = _words(name)
                    names |= words
                    whole.add(name.lower())
                    other |= set() if words & STATE_WORDS else words & OTHER_WORDS
            elif key == "role":
                role = value.strip().lower()
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                gone = True
    if tag in DROPPED or gone:
        return "drop"
    if tag in ("body", "html"):
        return ""
    if tag in OTHER_TAGS or role in OTHER_ROLES:
        return "other"
    if tag in ARTICLE_TAGS or role in ("main", "article"):
        return "comment" if whole & OTHER_WORDS and not whole & ARTICLE_WORDS else "article"
    if other and (whole & OTHER_WORDS or not whole & ARTICLE_WORDS):
        return "named"
    if tag in SOFT_TAGS or role in SOFT_ROLES or names & SOFT_WORDS:
        return "soft"
    return "text" if names & ARTICLE_WORDS else ""


class Blocks:
    """The blocks of a page: (text, words, linked words, place, kind, level, labelled); level: how many parts around are marked by words.

    Every character is looked at a bounded number of times: where a tag's quotes never close, no later tag's quotes are heeded."""

    def __init__(self, page: str):
        self.found: list[list] = []
        self.stack: list[tuple[str, str, int, bool]] = []  # element, place ("", "soft", "text", "article", "named", "other" or "drop"), level, never closed
        self.text: list[str] = []
        self.linked: list[str] = []
        self.in_link, self.own = 0, ""
        self.page, self.unclosed = page, None  # where DROPPED elements start that are never closed, once it has been looked up
        self.opened: dict[str, int] = {}
        self.own_main = self.heedless = False
        at, end = 0, len(page)
        last = {c: page.rfind(c) for c in (">", "]]>")}
        while at < end:
            start = page.find("<", at)
            if start < 0 or start >= last[">"]:
                unfinished = page.find("<!--", at)
                self.add(page[at : end if unfinished < 0 else unfinished])
                break
            if start > at:
                self.add(page[at:start])
            if page.startswith("<!--", start):
                at = page.find("-->", start + 4)
                at = end if at < 0 else at + 3
            elif page.startswith("<![CDATA[", start) and start < last["]]>"]:
                at = page.find("]]>", start)
                self.add(html.escape(page[start + 9 : at], False))
                at += 3
            elif page[start + 1] in "!?":
                at = page.find(">", start) + 1
            else:
                at = self.tag(start)
        self.flush()

    def tag(self, start: int) -> int:
        """Reads the tag at start, or the < as text; gives the place behind it."""
        page = self.page
        closes = page[start + 1] == "/"
        m = _NAME.match(page, start + 1 + closes)
        if not m:
            self.add("<")
            return start + 1
        tag, stop = m[0].lower(), self.end_of(m.end())
        if closes:
            self.close(tag)
            return stop + 1
        attrs = page[m.end() : stop]
        self.open(tag, attrs, start)
        if tag in ("script", "style", "textarea", "title") and not attrs.endswith("/"):
            raw = _RAW_END[tag].search(page, stop + 1)
            return raw.start() if raw else len(page)
        return stop + 1

    def end_of(self, at: int) -> int:
        """Where the tag ends whose attributes begin at `at`: at the first > outside of quotes, or the first of all."""
        page, place = self.page, at
        while not self.heedless:
            m = _STOP.search(page, place)
            if m and m[0] == ">":
                return m.start()
            place = page.find(m[0], m.end()) + 1 if m else 0
            self.heedless = place == 0
        return page.find(">", at)

    def add(self, text: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and text.strip():
            self.cut(len(self.stack) - 1)
        if self.place() != "drop":
            self.text.append(text)
            if self.in_link:
                self.linked.append(text)

    def place(self) -> str:
        return self.stack[-1][1] if self.stack else ""

    def level(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.text)).split())
        if text:
            linked = len(html.unescape(" ".join(self.linked)).split())
            n = len(text.split())
            self.found.append([text, n, min(n, linked), self.place(), KINDS.get(self.own, 0), self.level(), self.own_main])
        self.text, self.linked = [], []

    def never_closed(self, start: int) -> bool:
        if self.unclosed is None:
            opened: dict[str, list[int]] = {}
            for m in _DROPPED_TAG.finditer(self.page):
                if m["tag"]:
                    own = opened.setdefault(m["tag"].lower(), [])
                    if not m["close"]:
                        own.append(m.start())
                    elif own:
                        own.pop()
            self.unclosed = {x for own in opened.values() for x in own}
        return start in self.unclosed

    def end_dropped(self, tag: str) -> None:
        """Ends a head, and DROPPED elements that are never closed, where an element starts that cannot be in them."""
        for i in range(len(self.stack) - 1, -1, -1):
            name, place, _, open_end = self.stack[i]
            if place != "drop":
                return
            if name == "head" and (tag not in IN_HEAD or tag == "body") or open_end and tag in ENDS_PARAGRAPH | {"body"}:
                self.cut(i)
            elif name in DROPPED and tag != "body":
                return

    def open(self, tag: str, attrs: str, start: int = -1) -> None:
        if self.place() == "drop":
            self.end_dropped(tag)
        if tag in BLOCKS:
            self.flush()
            if tag in ENDS_PARAGRAPH:
                self.end_paragraph()
            if tag in SAME_ENDS:
                self.end_same(tag)
            if tag != "br":
                self.own, self.own_main = tag, "data-main" in attrs
        elif tag == "a":
            self.in_link = 1
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS | {"a"}:
            return
        part, around = _part(tag, attrs), self.place()
        level = self.level() + (part in ("named", "comment"))
        if part and part != around and tag not in BLOCKS and part not in ("article", "text"):
            self.flush()
        if around == "drop" or part == "drop":
            place = "drop"
        elif around == "other" or part == "other":
            place = "other"
        elif part in ("article", "comment"):
            place = "article"
        elif around == "named" or part == "named":
            place = "named"
        elif part == "text":
            place = "article" if around == "article" else "text"
        elif around in ("article", "text") and tag in ("header", "label"):
            place = around
        elif part == "soft":
            place = "soft"
        else:
            place = around
        if tag in BLOCKS or tag in DROPPED or place != around or level != self.level():
            self.opened[tag] = self.opened.get(tag, 0) + 1
            self.stack.append((tag, place, level, tag in DROPPED and tag not in ("script", "style", "title", "head") and self.never_closed(start)))

    def cut(self, i: int) -> None:
        for name, *_ in self.stack[i:]:
            self.opened[name] -= 1
        del self.stack[i:]

    def end_paragraph(self) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == "p":
                self.cut(i)
                return
            if self.stack[i][0] in BLOCKS or self.stack[i][0] in DROPPED:
                return

    def end_same(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in SAME_ENDS[tag]:
                self.cut(i)
                return
            if self.stack[i][0] in DROPPED or self.stack[i][0] in ("ul", "ol", "dl", "table", "menu", "nav", "div", "section", "article", "main"):
                return

    def close(self, tag: str) -> None:
        if tag == "a":
            self.in_link = 0
        if tag in BLOCKS:
            self.flush()
            self.own, self.own_main = "", False
        for i in range(len(self.stack) - 1, -1, -1) if self.opened.get(tag) else ():
            if self.stack[i][0] == tag:
                if self.stack[i][1] != (self.stack[i - 1][1] if i else ""):
                    self.flush()
                self.cut(i)
                return


def features(found: list[list]) -> list[tuple]:
    levels = [b[5] for b in found if b[3] == "article"] or [b[5] for b in found if b[3] == "text"]
    lowest = min(levels, default=0)
    places = {"other": OTHER, "named": NAMED, "soft": OTHER, "": BESIDE if levels else UNMARKED}
    place = [places[b[3]] if b[3] in places else ARTICLE if b[5] <= lowest else OTHER for b in found]
    elsewhere = sum(b[1] - b[2] for b, p in zip(found, place, strict=True) if p in (ARTICLE, UNMARKED))
    share = [b[2] / b[1] for b in found]
    none = (0, 0.0)
    out = []
    for i, b in enumerate(found):
        before, after = (found[i - 1][1], share[i - 1]) if i else none, (found[i + 1][1], share[i + 1]) if i + 1 < len(found) else none
        out.append((place[i], elsewhere, b[1], share[i], *before, *after, b[4]))
    return out


TREE = train(labelled_blocks())


def main_text(page: str | None, tree: Node = TREE) -> str:
    found = Blocks(page or "").found
    return " ".join(b[0] for b, f in zip(found, features(found), strict=True) if decide(tree, f))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of pages."""
    rows = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = [main_text(h) for h in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(frugal(run), f"{id_col} long, {url_col} string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
