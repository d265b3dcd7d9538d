"""Operator 5: main text of web pages by composite text density.

Every block element of a page is a node.  With C characters, T tags, LC
characters inside links and LT link tags in its subtree, its density is the
characters per tag, adjusted for links:

    C/T * ln(C/LC * T/LT) / ln(ln(C*LC/(C-LC) + C*LCb/Cb + e))

(LCb and Cb are the body's; a zero count stands for 1).  A node's density sum
adds the densities of its children.  The node of the largest sum is found;
the smallest density on its path from the body is the threshold.  From the
body down, each node at or above the threshold contributes its subtree of the
largest density sum.  Formatting tags (``b``, ``br``, ``span`` ...) are text,
not nodes, and links count as tags without being nodes.

Menus, headers, footers, asides, forms, notices, adverts, reader comments,
scripts and styles take part in the densities but not in the text; elements
say so by their tag, role, class or id.

Rules: a null, empty or tagless page is a body of text; character references
are decoded, white space in a block becomes one space, blocks are joined by
one space.  Ties go to the node that comes first.  Malformed markup never
raises and takes time in proportion to its length: unclosed paragraphs, items
and cells end where the next begins, an unmatched end tag is ignored, a tag
with an open quote ends at its first ``>``.  Rows are independent; extra
columns pass through.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

START = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*+)|[!?/])")
SPECIAL = re.compile("[>\"']")
LONG_NUMBER = re.compile("&#0*+([0-9]{8,});?|&#0{8,}(?=[0-9])")
LABEL = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
PART = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")

# fixed values: elements by kind
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
OUTSIDE = frozenset("nav footer aside form button dialog menu head object canvas audio video fieldset".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)),
        "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ())}
# fixed values: words of class, id and role that name what is not the article
LABELS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent
    cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination
    paywall popup promo promoted promotion recommended related replies respond share sharing sidebar signup social sponsor sponsored
    subscribe subscription teaser toolbar widget widgets contentinfo complementary search alert alertdialog""".split())
ARTICLE = frozenset("article content entry main post story".split())


def _outside(tag: str, attributes: str, in_article: bool) -> bool:
    """True for an element that is not part of an article."""
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in LABEL.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style":
            if "display:none" in value.replace(" ", "").lower():
                return True
        elif name != "aria-hidden":
            parts = {p.lower() for p in PART.split(value)}
            if parts & LABELS or ("header" in parts and not parts & ARTICLE and not in_article):
                return True
    return False


class Markup:
    """Tags and comments of a text, each found in time that grows with the text read, also where quotes or tags stay open."""

    def __init__(self, text: str):
        self.text, self.last = text, text.rfind(">")
        self.lost: set[int] = set()  # opening quotes after which no tag ends

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, "/" of an end tag, name, attributes) of the first piece of markup from ``at`` on; a comment
        or declaration has no name.  A tag without a ``>`` is text; a comment without an end takes the rest."""
        m = START.search(self.text, at)
        if m is not None and not m[1] and m.end() > self.last:
            m = re.compile("<(!--)").search(self.text, m.start() + 1)
        if m is None:
            return None
        if m[1]:
            stop = self.text.find("-->", m.end())
            return m.start(), len(self.text) if stop < 0 else stop + 3, "", "", ""
        if m[3] is None:
            return m.start(), self.text.find(">", m.end()) + 1, "", "", ""
        end = self._end(m.end())
        return m.start(), end, m[2], m[3].lower(), self.text[m.end():end - 1]

    def _end(self, at: int) -> int:
        """Place after the ``>`` of a tag whose name ends at ``at``: the first outside quotes, or the first of all
        where a quote stays open."""
        seen, k = [], at
        while True:
            m = SPECIAL.search(self.text, k)
            if m is not None and m[0] == ">":
                return m.end()
            if m is None or m.start() in self.lost:
                break
            seen.append(m.start())
            k = self.text.find(m[0], m.end()) + 1
            if not k:
                break
        self.lost.update(seen)
        return self.text.find(">", at) + 1


def decoded(text: str) -> str:
    """Character references as characters; a number beyond Unicode is U+FFFD, whatever its length."""
    return html.unescape(LONG_NUMBER.sub(lambda m: "\ufffd" if m[1] else "&#0", text))


class Page:
    """Block nodes of a page in page order: parents come before their children."""

    def __init__(self, text: str):
        self.parent, self.outside = [-1], [False]
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        self.pieces: list[tuple[int, str]] = []  # (node, text)
        self._read(text)

    def _open(self, parent: int, outside: bool) -> int:
        self.parent.append(parent)
        self.outside.append(outside)
        for counts in (self.chars, self.link_chars, self.link_tags):
            counts.append(0)
        self.tags.append(1)
        return len(self.parent) - 1

    def _read(self, text: str) -> None:
        stack = [("body", 0, False)]  # (tag, node, inside an article)
        opened: dict[str, list[int]] = {}  # places in the stack by tag
        links = at = 0
        markup = Markup(text)

        def say(part: str) -> None:
            node = stack[-1][1]
            part = decoded(part) if "&" in part else part
            count = len("".join(part.split()))
            self.chars[node] += count
            if links:
                self.link_chars[node] += count
            self.pieces.append((node, part))

        def close(names, until=()) -> None:
            last, border = (max((opened[t][-1] for t in tags if opened.get(t)), default=0) for tags in (names, until))
            if last > border:
                for t, *_ in stack[last:]:
                    opened[t].pop()
                del stack[last:]

        while True:
            m = markup.after(at)
            if m is None:
                say(text[at:])
                return
            start, stop, end, tag, attributes = m
            if start > at:
                say(text[at:start])
            at = stop
            if not tag:
                continue
            if tag in RAW:
                if not end:
                    m = re.compile(rf"</{tag}\b", re.I).search(text, at)
                    at = (m and text.find(">", m.end()) + 1) or len(text)
                continue
            if tag in ("html", "body"):
                continue
            if tag in INLINE:
                if tag == "a":
                    links = 0 if end else 1
                    if not end:
                        self.link_tags[stack[-1][1]] += 1
                        self.tags[stack[-1][1]] += 1
                elif tag == "br":
                    self.pieces.append((stack[-1][1], " "))
                continue
            self.pieces.append((stack[-1][1], " "))  # a block ends here
            if end:
                links = 0
                close((tag,))
                continue
            if tag in CLOSES_P:
                close(("p",), ("td", "th", "button", "object"))
            if tag in SAME:
                names, until = SAME[tag]
                close(names.split(), until)
            if tag in VOID:
                continue
            _, parent, in_article = stack[-1]
            node = self._open(parent, self.outside[parent] or _outside(tag, attributes, in_article))
            opened.setdefault(tag, []).append(len(stack))
            stack.append((tag, node, in_article or tag in ("article", "main")))

    def densities(self) -> tuple[list[float], list[float]]:
        """(density, density sum) per node."""
        n = len(self.parent)
        c, t, lc, lt = (list(x) for x in (self.chars, self.tags, self.link_chars, self.link_tags))
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            c[p] += c[k]
            t[p] += t[k]
            lc[p] += lc[k]
            lt[p] += lt[k]
        share = lc[0] / max(1, c[0])
        density, total = [0.0] * n, [0.0] * n
        for k in range(n - 1, -1, -1):
            if c[k]:
                tags = max(1, t[k])
                near = c[k] * lc[k] / max(1, c[k] - lc[k]) + c[k] * share + math.e
                density[k] = c[k] / tags * math.log(max(1.0, c[k] / max(1, lc[k]) * tags / max(1, lt[k]))) / max(0.1, math.log(math.log(near)))
            if k:
                total[self.parent[k]] += density[k]
        return density, total

    def content(self) -> list[bool]:
        """True for the nodes of the main text."""
        n, parent = len(self.parent), self.parent
        density, total = self.densities()
        best = list(range(n))  # of the subtree, outside elements apart
        inside = [k for k in range(n) if not self.outside[k]]
        for k in reversed(inside):
            up = best[parent[k]]
            if k and (total[best[k]], -best[k]) > (total[up], -up):
                best[parent[k]] = best[k]
        threshold, k = density[0], best[0]
        while k > 0:
            threshold = min(threshold, density[k])
            k = parent[k]
        said, reached = [False] * n, [False] * n
        for k in inside:
            reached[k] = k == 0 or reached[parent[k]]
            if reached[k] and (k == 0 or density[k] >= threshold):
                said[best[k]] = True
            elif k:
                reached[k] = False
        for k in range(1, n):
            said[k] = (said[k] or said[parent[k]]) and not self.outside[k]
        return said

    def text(self) -> str:
        said = self.content()
        return " ".join("".join(t if said[k] else " " for k, t in self.pieces).split())


def main_text(page: str | None) -> str:
    return Page(page).text() if page else ""


def extract(df: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the main text of each page; a column named ``out`` is replaced."""
    @F.arrow_udf("string")
    def run(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pages:
            yield pa.array([main_text(p) for p in batch.to_pylist()], pa.string())
    return bounded_batches(df).withColumn(out, run(F.col(f"`{column}`")))
