"""Main text of web pages by tag-path ratios.

Wu, Li & Hu, "Web news extraction via path ratios" (CIKM 2013): text that matters comes in long, punctuated runs that
share a root-to-leaf path of tags. Per path the text length and punctuation are aggregated over the page; each text
block takes its path's ratios, which are smoothed along the page, fused, and thresholded. What passes the threshold
points out the element that holds the content, whose blocks are the text, short ones and headings included, along with
blocks elsewhere that pass. Elements that mark themselves as something else (navigation, adverts, forms, comments and
so on) have paths of their own, whose scores are cut to a tenth: a mark counts as far as the page has better text
outside it, so a mark on a wrapper of the whole page changes nothing as long as an article or main element in it has none;
without one, a page that is marked throughout (a menu, a form) has no main text.

Pages are independent, so the operator is one pass over the rows where they lie. A page takes memory in proportion to
its length, however deep its elements are nested.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements without content, with raw content, that end a block, and that hold no text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
SKIP = frozenset("button head object select canvas audio video datalist".split())
#: Elements that are marked by their tag, and those that are leaves of a text, which no word marks.
MARKED = frozenset("aside dialog footer form header menu nav fieldset label".split())
LEAVES = frozenset("html body article main p h1 h2 h3 h4 h5 h6 li td th dd dt pre tr tbody figcaption".split())
#: Words of class, id and role that mark an element as something besides the main text.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav aside menu nav navbar navigation breadcrumb"
    " breadcrumbs footer foot masthead header topbar toolbar comment comments commentlist respond reply replies disqus discussion cookie cookies consent gdpr"
    " notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended pagination pager skip widget"
    " contentinfo complementary search dialog feedback reviews survey paywall disclaimer".split()
)
#: Of these, the words that mark leaves of a text too.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments reply replies cookie cookies consent gdpr notice notices"
    " alert popup newsletter subscribe signup login paywall disclaimer".split()
)
#: An open element of the key is closed by a start tag of the values.
CLOSED_BY = {
    "p": BLOCK - {"body", "html", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}, **{f"h{k}": frozenset("h1 h2 h3 h4 h5 h6 p".split()) for k in range(1, 7)},
}
#: By start tag, the open elements that it closes.
CLOSES = {tag: tuple(e for e, tags in CLOSED_BY.items() if tag in tags) for tag in BLOCK}
#: An open element of these is closed by nothing from within but its own end.
SCOPE = frozenset("html body article main section div table td th ul ol dl blockquote nav aside footer header form".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*>|[^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?。，、！？；：…¿¡]")


#: What is left of the score of a path for each mark on it.
MARK_FACTOR = 0.1
#: The share of the content that the content element holds.
SHARE = 0.9


def _marks(attributes: str) -> tuple[bool, bool, bool]:
    """(whether the attributes hide the element, whether their class, id or role names something besides the text, whether so by a word that marks leaves too)."""
    hidden = named = strong = False
    if len(attributes) < 4:
        return hidden, named, strong
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _UNSEEN.search(value):
            hidden = True
        elif name in ("class", "id", "role"):
            for word in value.split():
                parts = [x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", word)]
                if parts and parts[0] not in ("with", "has", "no", "js", "is") and (parts[0] in HINTS or parts[-1] in HINTS):
                    named = True
                    strong = strong or parts[0] in STRONG or parts[-1] in STRONG
    return hidden, named, strong


class Page:
    """Elements by number (parent, tag, path, marks on the way to the root) and text blocks (element, text, whether all of it is links)."""

    def __init__(self):
        self.parent, self.tag, self.path, self.marks = [0], ["#"], [0], [0]
        self.paths: dict[tuple[int, str, bool], int] = {}
        self.blocks: list[tuple[int, str, bool]] = []

    def open(self, parent: int, tag: str, marked: bool) -> int:
        step = (self.path[parent], tag, marked)
        self.path.append(self.paths.setdefault(step, len(self.paths) + 1))
        self.parent.append(parent)
        self.tag.append(tag)
        self.marks.append(self.marks[parent] + marked)
        return len(self.tag) - 1


def read_page(page: str) -> Page:
    """The page's block elements and text blocks, in order; what the elements of SKIP and RAW hold is left out."""
    out = Page()
    stack: list[tuple[str, int, bool]] = [("#", 0, False)]  # tag, number of the innermost block element, skipped
    places: dict[str, list[int]] = {}  # by tag, where it stands in the stack
    scopes: list[int] = []  # where elements of SCOPE stand
    held: list[str] = []
    where, plain = 0, False

    def flush() -> None:
        nonlocal plain
        if held:
            text = _SPACE.sub(" ", "".join(held)).strip()
            if text:
                out.blocks.append((where, text, not plain))
            held.clear()
        plain = False

    def add(text: str) -> None:
        nonlocal plain, where
        if stack[-1][2] or not text:
            return
        if not held:
            if text.isspace():
                return
            where = stack[-1][1]
        text = html.unescape(text)
        plain = plain or not text.isspace() and not places.get("a")
        held.append(text)

    def close(k: int) -> None:
        for tag, _, _ in reversed(stack[k:]):
            places[tag].pop()
            if tag in SCOPE:
                scopes.pop()
        del stack[k:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        add(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            k = places[tag][-1] if places.get(tag) else 0
            if k and (tag in BLOCK or not scopes or scopes[-1] <= k):
                if tag in BLOCK or any(x[0] in BLOCK for x in stack[k:]):
                    flush()
                close(k)
            continue
        if tag in BLOCK:
            flush()
            k = max((places[t][-1] for t in CLOSES[tag] if places.get(t)), default=0)
            if k and (not scopes or scopes[-1] <= k):
                close(k)
        if tag in VOID:
            if tag == "br" or tag == "hr":
                add(" ")
            continue
        if tag in RAW:
            ends = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = page.find(">", ends.start()) + 1 if ends else end
            at = at or end
            continue
        skipped, number = stack[-1][2] or tag in SKIP, stack[-1][1]
        hidden, named, strong = _marks(m[3])
        marked = hidden or tag in MARKED or named and tag not in LEAVES or strong and tag not in ("html", "body", "main")
        if tag in BLOCK or marked:
            if marked or skipped and not stack[-1][2]:
                flush()
            number = out.open(number, tag, marked)
        places.setdefault(tag, []).append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        stack.append((tag, number, skipped))
    flush()
    return out


def path_scores(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Each block's fused ratio, with and without its neighbours: its path's text length per node times punctuation per node, smoothed along the page, less its marks."""
    path = np.array([page.path[e] for e, _, _ in page.blocks])
    own = np.array([(len(t) * (0.2 if linked else 1.0), len(_PUNCTUATION.findall(t)), 1.0) for _, t, linked in page.blocks])
    total = np.stack([np.bincount(path, own[:, j]) for j in range(3)], axis=1)[path]
    ratio = total[:, :2] / total[:, 2:]
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    kernel /= kernel.sum()
    padded = np.pad(ratio, ((2, 2), (0, 0)), mode="edge")
    smooth = sum(k * padded[j : j + len(ratio)] for j, k in enumerate(kernel))
    marks = np.array([page.marks[e] for e, _, _ in page.blocks])
    left = MARK_FACTOR ** (marks - marks.min()).astype(float)
    return np.sqrt(smooth[:, 0] * (smooth[:, 1] + 0.05)) * left, np.sqrt(ratio[:, 0] * (ratio[:, 1] + 0.05)) * left


def main_text(text: str | None) -> str:
    """The page's main text, a line per block; empty if there is none."""
    page = read_page(text or "")
    if not page.blocks:
        return ""
    least = min(page.marks[e] for e, _, _ in page.blocks)
    if least and not any(t in ("article", "main") and page.marks[e] == page.marks[page.parent[e]] for e, t in enumerate(page.tag)):
        return ""  # all is marked, and nothing in it says it is the text
    score, own = path_scores(page)
    level = min(score.std(), score.max())
    # a marked block must be as good as half of the best one even so
    content = score >= np.where(np.array([page.marks[e] for e, _, _ in page.blocks]) > least, max(level, 0.5 * score.max()), level)
    element = np.array([e for e, _, _ in page.blocks])
    parent = np.array(page.parent)
    # the deepest element that holds SHARE of the content; children have greater numbers than their parents
    held = np.bincount(element[content], [len(t) for (_, t, _), c in zip(page.blocks, content, strict=True) if c], len(parent))
    for e in range(len(parent) - 1, 0, -1):
        held[parent[e]] += held[e]
    root = int(np.flatnonzero(held >= SHARE * held[0])[-1]) if held[0] else 0
    while root and page.tag[root] in LEAVES - {"html", "body", "article", "main"}:
        root = page.parent[root]
    inside = np.zeros(len(parent), dtype=bool)
    inside[root] = True
    marks = np.array(page.marks)
    for e in range(root + 1, len(parent)):  # the text's own header is no mark
        inside[e] = inside[parent[e]]
        if inside[e] and page.tag[e] == "header" and page.tag[root] not in ("#", "html", "body"):
            marks[e] = marks[parent[e]]
        elif inside[e]:
            marks[e] = marks[parent[e]] + page.marks[e] - page.marks[parent[e]]
    taken = inside[element] & (content | (marks[element] <= marks[root])) | content & (own >= 0.5 * own.max())
    # a heading above the content element, if that has none
    heads = [k for k, e in enumerate(element) if page.tag[e] == "h1" and page.marks[e] <= page.marks[root]]
    first = int(taken.argmax())
    if heads and not any(taken[k] for k in heads) and heads[0] < first:
        taken[max(k for k in heads if k < first)] = True
    if page.tag[root] in ("#", "html", "body"):  # without an element of its own for the text, three items in a row that are links only are a menu
        menu = np.array([linked and page.tag[e] == "li" for e, _, linked in page.blocks])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], menu.astype(int), [0]])))
        for start, stop in zip(edges[::2], edges[1::2], strict=True):
            if stop - start >= 3:
                taken[start:stop] = False
    return "\n".join(t for (_, t, _), keep in zip(page.blocks, taken, strict=True) if keep)


def extract_text(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of ``df``: key, url, text, n_chars (code points of the text).

    White space within a block becomes one space, blocks are joined by one line end, and character references are
    decoded; a line break is white space. A null or empty page, or one without text, gives an empty text. Whole pages
    are read, broken markup included; repeated rows give repeated results; an empty table gives an empty result; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column("page")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    kinds = f"key {df.schema[key].dataType.simpleString()}, url {df.schema[url].dataType.simpleString()}, text string, n_chars long"
    rows = df.select(df[key].alias("key"), df[url].alias("url"), df[page].alias("page"))
    return rows.mapInArrow(run, kinds).withColumnRenamed("key", key)
