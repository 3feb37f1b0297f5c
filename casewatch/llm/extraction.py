"""Main text of web pages by tag-path ratios.

A page is cut into text lines (blocks), each with its root-to-leaf tag path; phrase elements inside a line belong to the
line's path, a line that is nothing but links has the path of its link. Per path, text length and punctuation are summed and
divided by the path's number of lines. The two ratios are smoothed over the lines in page order, fused (geometric mean)
and averaged by path. One comparison then decides each path, and with it each line:

* a path that ends in a container or a link is content from HIGH times the page's mean (weighted by text) on;
* a path that ends in a text element (paragraph, list item, cell, quote, ...) from LOW times the mean on, if it lies in the
  article: the smallest container that holds nearly all text of the paths above HIGH;
* a heading in the article is content unless its section has text and all of it fell below.

Elements, roles and class words that name navigation, notices, adverts, forms, comments and the like damp the ratio of the
paths below them to zero. They are a secondary sign: a class word or form that holds nearly all high-ratio text of the page does
not damp, nor do words that only describe the page (`has-sidebar`, `no-comments`, `share-enabled`). Comments always do.

Nulls and pages without text give an empty string; repeated pages give repeated rows. Unclosed and misnested tags are
closed as browsers do for paragraphs, list items and table cells. Time and memory grow with the page's length, also
for deeply nested pages. Kept columns named `text` or `n_chars` give way to the results. Pages are independent rows, so no
shuffle takes place.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm import words as W

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|xmp)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_EMPTY = re.compile(r"""(?:\A|[\s"'])/\Z""")  # not the slash that ends a bare value
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？；：¿¡]")

# Element names of HTML by their role, and words that mark parts outside the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
OUTSIDE = frozenset("nav header footer aside form button select option dialog menu head object canvas audio video fieldset label".split())
CONTAINERS = frozenset("html body div section main article center table tbody tr td".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal"
    " newsletter subscribe signup sidebar widget widgets related recommended share sharing social breadcrumb breadcrumbs menu nav navbar navigation"
    " pagination pager footer masthead comment comments commentlist respond reply replies disqus login toolbar skip".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus".split())
OVERRIDABLE = frozenset("aside form header fieldset".split())
DESCRIBES_FIRST = frozenset("has no not non with without is hide show enable disable".split())
DESCRIBES_LAST = frozenset("enabled disabled active inactive open closed on off".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_ELEMENTS = HEADINGS | frozenset("p li dt dd td th pre blockquote figcaption caption address summary".split())

HIGH, LOW = 0.5, 0.001  # of the page's mean ratio
NEIGHBOUR = 0.125  # weight of the line before and after in smoothing
DOMINANT = 0.9  # share of the high-ratio text that makes a container the article
SENTENCE = 8.0  # fused ratio of a line of some 50 letters with a full stop

# Strength of a mark: none, a sign that a dominant share overrides, a sign that always counts.
CLEAR, SIGN, ALWAYS = 0, 1, 2


def _mark(tag: str, attributes: str) -> int:
    """How strongly element, role and class words say that the element is no part of an article."""
    mark = CLEAR
    if tag in OUTSIDE:
        mark = SIGN if tag in OVERRIDABLE else ALWAYS
    if not attributes or tag in ("html", "body", "main"):
        return mark
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return ALWAYS
        if name == "role" and value in OUTSIDE_ROLES:
            mark = max(mark, SIGN if value == "form" else ALWAYS)
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return ALWAYS
        elif name in ("class", "id") and tag not in INLINE:
            for entry in value.split():
                parts = [p for p in re.split(r"[^a-z]+", entry) if p]
                found = OUTSIDE_WORDS.intersection(parts)
                if not found or (len(parts) > 1 and (not DESCRIBES_FIRST.isdisjoint(parts[:-1]) or parts[-1] in DESCRIBES_LAST)):
                    continue
                if found & COMMENT_WORDS:
                    return ALWAYS
                if tag != "article":
                    mark = max(mark, SIGN)
    return mark


class _Page:
    """Elements in page order, interned tag paths, and text lines by (block, path)."""

    def __init__(self, source: str):
        self.parent, self.tags, self.marks = [-1], [""], [CLEAR]
        self.leaf = [0]  # per element: itself, or for phrase elements the element whose path they share
        self.linked, self.in_article = [False], [False]
        self.paths: dict[tuple[int, str, int], int] = {}
        self.path = [0]
        self.path_tag = [""]
        self.lines: dict[tuple[int, int], list[str]] = {}  # (block, leaf element) -> texts
        self.plain: dict[tuple[int, int], bool] = {}  # whether a line has text outside links
        self.block = 0
        self.open: list[int] = [0]
        self.count: dict[str, int] = {}
        at = 0
        for m in _TOKEN.finditer(source):
            self._text(source[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self._text(html.escape(m[0][9:].removesuffix("]]>")))
                continue
            tag = tag.lower()
            if tag not in INLINE:
                self.block += 1
            if m["close"]:
                self._close(tag)
            elif tag in VOID:
                if tag == "br":
                    self._text(" ")
            else:
                self._open(tag, m["attributes"])
        self._text(source[at:])

    def intern(self, path: int, tag: str, mark: int) -> int:
        """Number of the path that goes on from `path` by this tag."""
        number = self.paths.setdefault((path, tag, mark), len(self.path_tag))
        if number == len(self.path_tag):
            self.path_tag.append(tag)
        return number

    def _open(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_PARAGRAPH:
            self._close_within(("p",), ("table", "td", "th", "button", "article", "section", "div"))
        elif tag in SIBLINGS:
            self._close_within(*SIBLINGS[tag])
        above, element = self.open[-1], len(self.tags)
        own_header = tag == "header" and self.in_article[above]  # an article's own header: only its headings count
        mark = CLEAR if own_header else _mark(tag, attributes)
        self.parent.append(above)
        self.tags.append("header-inside" if own_header else tag)
        self.marks.append(mark)
        phrase = tag in INLINE and mark == CLEAR
        self.leaf.append(self.leaf[above] if phrase else element)
        self.linked.append(self.linked[above] or tag == "a")
        self.in_article.append(self.in_article[above] or tag in ("article", "main"))
        self.path.append(self.path[above] if phrase else self.intern(self.path[above], self.tags[-1], mark))
        if tag not in INLINE or not _EMPTY.search(attributes):
            self.open.append(element)
            self.count[self.tags[-1]] = self.count.get(self.tags[-1], 0) + 1

    def _pop_to(self, k: int) -> None:
        for e in self.open[k:]:
            self.count[self.tags[e]] -= 1
        del self.open[k:]

    def _close_within(self, tags: tuple, stop: tuple) -> None:
        if not any(self.count.get(t) for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[k]]
            if tag in tags:
                return self._pop_to(k)
            if tag in stop:
                return

    def _close(self, tag: str) -> None:
        names = ("header", "header-inside") if tag == "header" else (tag,)
        if not any(self.count.get(t) for t in names):
            return
        for k in range(len(self.open) - 1, 0, -1):
            found = self.tags[self.open[k]]
            if found in names:
                return self._pop_to(k)
            if tag in INLINE and found not in INLINE:
                return

    def _text(self, raw: str) -> None:
        if not raw:
            return
        element = self.open[-1]
        key = (self.block, self.leaf[element])
        text = html.unescape(raw) if "&" in raw else raw
        self.lines.setdefault(key, []).append(text)
        if not self.linked[element] and not text.isspace():
            self.plain[key] = True


def _up(page: _Page, values: list[float]) -> list[float]:
    """Sums of `values` over each element and all below it."""
    for e in range(len(values) - 1, 0, -1):
        values[page.parent[e]] += values[e]
    return values


def _ratios(paths: list[int], texts: list[str]) -> tuple[dict[int, float], list[int]]:
    """Smoothed, fused ratio of each path, and the length of each line."""
    sizes = [len(t) for t in texts]
    total: dict[int, list[float]] = {}
    for path, text, size in zip(paths, texts, sizes):
        row = total.setdefault(path, [0, 0, 0, 0.0])
        row[0] += size
        row[1] += len(_PUNCTUATION.findall(text))
        row[2] += 1
    fused = [math.sqrt(total[p][0] * (total[p][1] + 0.5)) / total[p][2] for p in paths]
    last = len(fused) - 1
    for i, path in enumerate(paths):
        near = fused[max(i - 1, 0)] + fused[min(i + 1, last)]
        total[path][3] += (1 - 2 * NEIGHBOUR) * fused[i] + NEIGHBOUR * near
    return {p: row[3] / row[2] for p, row in total.items()}, sizes


def _article(page: _Page, weight: list[float]) -> int:
    """The smallest container with nearly all of the weight; an article or main element is not left."""
    children: dict[int, list[int]] = {}
    for e, p in enumerate(page.parent):
        children.setdefault(p, []).append(e)
    root = 0
    while page.tags[root] not in ("article", "main") or any(page.tags[c] == "article" for c in children.get(root, ())):
        inner = [c for c in children.get(root, ()) if (page.tags[c] in CONTAINERS or page.tags[c] in OVERRIDABLE) and weight[c] and weight[c] >= DOMINANT * weight[root]]
        if not inner:
            break
        root = inner[0]
    return root


def main_text(source: str, threshold: bool = True) -> str:
    """The main text of a page; without `threshold` every path counts as content."""
    page = _Page(source)
    elements, texts, paths = [], [], []
    for (block, leaf), parts in page.lines.items():
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            linked = (block, leaf) not in page.plain and page.tags[leaf] not in HEADINGS and page.tags[leaf] != "p"
            elements.append(leaf)
            texts.append(text)
            paths.append(page.intern(page.path[leaf], "a", CLEAR) if linked else page.path[leaf])
    if not threshold:
        return "\n".join(texts)
    ratio, sizes = _ratios(paths, texts)
    count = len(page.tags)

    # Signs that hold nearly all high-ratio text are overridden; the others damp every path below them.
    always = [False] * count
    for e in range(1, count):
        always[e] = always[page.parent[e]] or page.marks[e] == ALWAYS
    mass, best = [0.0] * count, [0.0] * count
    for e, p, n in zip(elements, paths, sizes):
        if not always[e]:
            mass[e] += n * ratio[p]
            best[e] = max(best[e], ratio[p])
    _up(page, mass)
    for e in range(count - 1, 0, -1):
        best[page.parent[e]] = max(best[page.parent[e]], best[e])
    damped, header, titled = always[:], [False] * count, [False] * count
    for e in range(1, count):
        up = page.parent[e]
        sign = page.marks[e] == SIGN
        if sign and not damped[up] and mass[e] >= DOMINANT * mass[0] and best[e] >= SENTENCE:
            sign = False
        damped[e] = damped[e] or damped[up] or sign
        header[e] = header[up] or page.tags[e] == "header-inside"
        titled[e] = titled[up] or page.tags[e] in HEADINGS

    clear = [i for i, e in enumerate(elements) if not damped[e]]
    total = sum(sizes[i] for i in clear)
    mean = sum(sizes[i] * ratio[paths[i]] for i in clear) / total if total else 0.0
    weight = [0.0] * count
    for i in clear:
        if ratio[paths[i]] >= HIGH * mean:
            weight[elements[i]] += sizes[i]
    root = _article(page, _up(page, weight))
    inside = [False] * count
    inside[root] = True
    for e in range(root + 1, count):
        inside[e] = inside[page.parent[e]]

    lines: list[tuple[int, bool, str]] = []  # heading level or 0, whether content, text
    for i, (e, p) in enumerate(zip(elements, paths)):
        if not inside[e]:
            continue
        own = 0.0 if damped[e] or (header[e] and not titled[e]) else ratio[p]
        level = int(page.path_tag[p][1]) if page.path_tag[p] in HEADINGS else 0
        lines.append((level, own > 0 and own >= (LOW if page.path_tag[p] in TEXT_ELEMENTS else HIGH) * mean, texts[i]))
    return "\n".join(t for (level, content, t), empty in zip(lines, _lost_sections(lines)) if content and not empty)


def _lost_sections(lines: list[tuple[int, bool, str]]) -> list[bool]:
    """Whether each line is a heading whose section has text, none of which is content."""
    out = [False] * len(lines)
    kept, lost = [False] * 8, [False] * 8  # per heading level: lines seen since the last heading of that level or above
    for i in range(len(lines) - 1, -1, -1):
        level, content, _ = lines[i]
        if level:
            out[i] = lost[level] and not kept[level]
            content = content and not out[i]
            for d in range(level, 8):
                kept[d] = lost[d] = False
            for d in range(1, level):
                kept[d], lost[d] = kept[d] or content, lost[d] or not content
        else:
            for d in range(1, 8):
                kept[d], lost[d] = kept[d] or content, lost[d] or not content
    return out


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The `keep` columns of every page with its main text and the text's number of code points."""
    W.small_batches(pages.sparkSession)
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))
    source = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    width, names = len(keep), [*keep, "text", "n_chars"]

    def run(batches):
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column(width).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(width)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    schema = ", ".join(f"`{n}` {t}" for n, t in source.dtypes[:width]) + ", text string, n_chars long"
    return source.mapInArrow(run, schema)
