"""Main text of web pages by composite text density.

Every node of the page's tree has a density: characters per tag, lowered by the
share of its characters and tags that are links.  A node's density sum adds up
the densities of the blocks right inside it.  The least density on the way from the node with
the greatest sum up to the body is the threshold, and from the body down, every
node that reaches it gives its subtree of the greatest sum to the article.
Where the page marks articles, the density says which of them is meant.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.llm.common import table

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a new element of the same kind, or of the kinds named, closes.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
P_SCOPE = frozenset("table td th caption button object html body".split())
#: Parts of a page that are never article text.
DROPPED = frozenset("nav footer aside form select option input head dialog menu search object embed canvas audio video map annotation annotation-xml".split())
#: What a button has to stand in to be a word of a sentence.
SENTENCE = frozenset("p li dd dt td th h1 h2 h3 h4 h5 h6 blockquote figcaption caption summary".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROPPED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|newsletter|subscribe|subscription|paywall|popup|modal|overlay|share|sharing|social|comments?|commentlist|disqus|respond|sidebar|side-bar|rail|menu|navbar|nav|navigation|breadcrumbs?|pagination|pager|related|recommended|recommendations|footer|masthead|skip-link|toolbar|login|signup|tags|widget\w*)(?:$|[\s_-])",
    re.I,
)
#: Whole names, of a container inside the article too, that say advert, consent or reader comments and nothing else.
FOREIGN_NAMES = frozenset("ad ads advert adverts advertisement advertising ad-slot ad-container sponsored cookie-banner cookie-notice cookie-consent newsletter-signup share-buttons social-share comments reader-comments comment-list commentlist comments-section disqus_thread respond".split())
#: Elements that hold parts of a page, and may be left out of the densities by their names; paragraphs and headings are not.
HOLDERS = frozenset("div section ul ol dl table details figure fieldset center ins".split())
MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"[^\s/>]+")
EDGE = re.compile(r">|=\s*[\"']")
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
SPACE = re.compile(r"\s+")


class Page:
    """The tree of a page, as parallel lists in document order; parents come before children."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.attrs = ["#root"], [0], [""]
        #: (node, text) in page order; a None text is a block's edge
        self.flow: list[tuple[int, str | None]] = []
        #: how many elements of a name are open
        self.open: dict[str, int] = {}
        self._parse(html)

    def _open(self, tag: str, attrs: str, stack: list[int]) -> int:
        self.tag.append(tag)
        self.parent.append(stack[-1])
        self.attrs.append(attrs)
        return len(self.tag) - 1

    def _close_implied(self, tag: str, stack: list[int]) -> None:
        names = self.tag
        if tag in CLOSES:
            ended, scope = CLOSES[tag]
        elif tag in BLOCK:
            ended, scope = {"p"}, P_SCOPE
        else:
            return
        if not any(self.open.get(x) for x in ended):
            return
        for depth in range(len(stack) - 1, 0, -1):
            name = names[stack[depth]]
            if name in scope:
                return
            if name in ended:
                # tags of a row close a cell and the row around it
                while depth > 1 and names[stack[depth - 1]] in ended and names[stack[depth - 1]] not in scope:
                    depth -= 1
                for _ in range(len(stack) - depth):
                    self._leave(stack)
                return
            if tag not in CLOSES and name in BLOCK:
                return

    def _leave(self, stack: list[int]) -> None:
        node = stack.pop()
        self.open[self.tag[node]] -= 1
        if self.tag[node] in BLOCK:
            self.flow.append((node, None))

    @staticmethod
    def _end_of_tag(html: str, at: int) -> int:
        """Where the tag whose name ends at ``at`` ends, quoted values passed over; -1 if it never does."""
        while m := EDGE.search(html, at):
            if m[0] == ">":
                return m.start()
            at = html.find(m[0][-1], m.end()) + 1
            if not at:
                return -1
        return -1

    def _parse(self, html: str) -> None:
        """One pass; a comment or a tag that never ends takes the rest of the page, as in a browser."""
        stack, at, size, lower = [0], 0, len(html), None
        while at < size:
            m = MARKUP.search(html, at)
            if not m:
                self.flow.append((stack[-1], html[at:]))
                break
            if m.start() > at:
                self.flow.append((stack[-1], html[at : m.start()]))
            kind, at = m[0], m.end()
            if kind == "<!--":
                end = at - 2 if html.startswith(">", at) or html.startswith("->", at) else html.find("-->", at)
                end = html.find(">", end) if end >= 0 else -1
                at = size if end < 0 else end + 1
            elif kind == "<![CDATA[":
                end = html.find("]]>", at)
                self.flow.append((stack[-1], html[at : size if end < 0 else end]))
                at = size if end < 0 else end + 3
            elif kind[1] in "!?":
                at = html.find(">", at) + 1 or size
            else:
                name = NAME.match(html, at - 1)
                end = self._end_of_tag(html, name.end())
                if end < 0:
                    break
                at, tag, attrs = end + 1, name[0].lower(), html[name.end() : end]
                if kind[1] == "/":
                    if self.open.get(tag):
                        while self.tag[stack[-1]] != tag:
                            self._leave(stack)
                        self._leave(stack)
                    continue
                self._close_implied(tag, stack)
                node = self._open(tag, attrs, stack)
                if tag == "br":
                    self.flow.append((node, " "))
                if tag in BLOCK:
                    self.flow.append((node, None))
                if tag in RAW:
                    lower = lower if lower is not None else html.lower()
                    end = lower.find("</" + tag, at)
                    at = size if end < 0 else (html.find(">", end) + 1 or size)
                elif tag not in VOID and not attrs.endswith("/"):
                    stack.append(node)
                    self.open[tag] = self.open.get(tag, 0) + 1
        while len(stack) > 1:
            self._leave(stack)

    def text(self) -> str:
        tag, parent, n = self.tag, self.parent, len(self.tag)
        density, total, drop = self.densities()
        chosen = self._select(density, total, drop)
        # inside the article names say little: what is kept from it is told by element, role and the plainest names
        inside, hide, within = [False] * n, [False] * n, [False] * n
        for i in range(n):
            p = parent[i]
            inside[i] = i in chosen or i > 0 and inside[p]
            # the article's own header, with its headline or by-line, is part of it; a page's isn't
            within[i] = i > 0 and within[p] or tag[i] in ("article", "main") or i in chosen and tag[i] not in ("#root", "html", "body", "header")
            hide[i] = i > 0 and (hide[p] or self._unfit(i) or tag[i] == "header" and not within[p] or tag[i] in HOLDERS and self._named(i, lambda v: any(x.lower() in FOREIGN_NAMES for x in v.split())))
        blocks, own = [], []
        for node, text in self.flow:
            if text is None:
                if own:
                    blocks.append("".join(own))
                    own = []
            elif inside[node] and not hide[node]:
                own.append(text)
        blocks.append("".join(own))
        done = (SPACE.sub(" ", unescape(b)).strip() for b in blocks)
        return "\n".join(b for b in done if b)

    def densities(self) -> tuple[list[float], list[float], list[bool]]:
        """Each node's density and density sum, and whether it takes part in them."""
        tag, parent, n = self.tag, self.parent, len(self.tag)
        drop, link, article = [False] * n, [False] * n, [False] * n
        holds = [t in ("h1", "article", "main") for t in tag]
        for i in range(n - 1, 0, -1):
            holds[parent[i]] |= holds[i]
        for i in range(1, n):
            p = parent[i]
            link[i] = link[p] or tag[i] == "a"
            article[i] = article[p] or tag[i] in ("article", "main")
            # a layout wrapper named after its sidebar still holds the article; a paragraph's name says nothing
            named = tag[i] in HOLDERS and not holds[i] and self._named(i, DROPPED_NAMES.search)
            drop[i] = drop[p] or self._unfit(i) or named or tag[i] == "header" and not article[p] and not holds[i]
        chars, links = [0] * n, [0] * n
        for node, text in self.flow:
            if text and not drop[node]:
                k = len(SPACE.sub(" ", text).strip())
                chars[node] += k
                if link[node]:
                    links[node] += k
        tags, link_tags = [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            if not drop[i]:
                p = parent[i]
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (tag[i] == "a")
        ratio = links[0] / max(1, chars[0])
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if not drop[i] and chars[i]:
                density[i] = text_density(chars[i], links[i], tags[i], link_tags[i], ratio)
                # bold words, links and the like are their block's text, not parts that it adds up
                if i and tag[i] in BLOCK:
                    total[parent[i]] += density[i]
        return density, total, drop

    def _unfit(self, i: int) -> bool:
        """A part that is no article text, by its element or role, or hidden."""
        tag = self.tag[i]
        if tag in RAW or tag in DROPPED:
            return True
        if tag == "button":
            p = self.parent[i]
            while p and self.tag[p] not in BLOCK and self.tag[p] not in SENTENCE:
                p = self.parent[p]
            return self.tag[p] not in SENTENCE
        for m in ATTR.finditer(self.attrs[i]):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name == "role" and value in DROPPED_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return True
        return False

    def _named(self, i: int, told: Callable[[str], object]) -> bool:
        return any(m[1].lower() in ("class", "id") and told((m[2] or "").strip("\"'")) for m in ATTR.finditer(self.attrs[i]))

    def _select(self, density: list[float], total: list[float], drop: list[bool]) -> set[int]:
        """The nodes whose subtrees are the article.

        Where a marked article or main part reaches the threshold: of those
        around the node of the greatest density sum the nearest, else of those
        inside it the one of the greatest sum.  On other pages: from the body
        down, of every node that reaches the threshold the subtree of the
        greatest sum.
        """
        n, parent = len(self.tag), self.parent
        best = max(range(n), key=lambda i: (total[i], -i))
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        threshold, at = density[best] or max(density), best
        while at and at != body:
            at = parent[at]
            threshold = min(threshold, density[at] or threshold)
        reach = [d >= threshold > 0 and not drop[i] for i, d in enumerate(density)]
        marked = {i for i in range(n) if self.tag[i] in ("article", "main") and reach[i]}
        up = best
        while up:
            if up in marked:
                return {up}
            up = parent[up]
        # parents come before children: the greatest sum of every subtree in one backward pass
        top = list(range(n))
        under = [i == best for i in range(n)]
        for i in range(1, n):
            under[i] |= under[parent[i]]
        for i in range(n - 1, 0, -1):
            if not drop[i] and density[i] and (total[top[i]], -top[i]) > (total[top[parent[i]]], -top[parent[i]]):
                top[parent[i]] = top[i]
        if below := [i for i in marked if under[i]]:
            return {max(below, key=lambda i: (total[i], -i))}
        chosen, seen = {best}, [False] * n
        for i in range(n):
            # a node is looked at if its parent was and reached the threshold too
            seen[i] = reach[i] and (i in (0, body) or seen[parent[i]])
            if seen[i]:
                # a subtree without element children has no sum: its own text counts
                chosen.add(top[i] if total[top[i]] else i)
        return chosen


def text_density(chars: int, link_chars: int, tags: int, link_tags: int, page_ratio: float) -> float:
    """Characters per tag, lowered by the share of links among characters and tags."""
    t = max(1, tags)
    base = log(chars / max(1, chars - link_chars) * link_chars + page_ratio * chars + e)
    share = log(max(1.0, chars / max(1, link_chars) * t / max(1, link_tags)))
    return chars / t * max(0.0, share / max(log(base) if base > e else 1.0, 1.0))


def main_text(html: str | None) -> str:
    """The article of a page; empty for null, empty and wordless pages."""
    return Page(html).text() if html else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row's whole page.

    Null pages have an empty text; null ids and urls and repeated rows are kept
    as they are; an empty table gives an empty one; pages of any length are
    read whole, in linear time; other columns are not read.  Text blocks come
    in page order, one to a line, with character references decoded and white
    space made single spaces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    cols = [F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")]
    return pages.select(*cols).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
