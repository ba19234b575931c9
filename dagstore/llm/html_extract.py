"""Main text of web pages by tag-path ratios.

A page's text nodes are labelled with their root-to-leaf tag path (inline formatting left out).  For every path, text
length and punctuation are added up over its nodes; the text path ratio is text length per node, the punctuation path
ratio punctuation per node.  The two are fused (geometric mean, links' text counting against a path), smoothed over
the nodes in page order, and weighed by the root of the path's text length.  On every page a path belongs to the
content if its weight reaches THRESHOLD times the heaviest path's; headings and paragraphs beside such a path do too.
Structure narrows what is weighed, which departs from pure path ratios: subtrees of menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments never count.  An article or main element is a prior, no
rule: paths within weigh PRIOR times as much, and beside a path of the content in the same element THRESHOLD cubed of
the best ratio is enough, however short the text (cells and list items, not lists of links).  Text outside such
elements is weighed against them like any other.

The page is read as a browser would: comments, raw-text elements, void elements, implied ends of p, li, dt, dd, tr,
td, th and option, unclosed and stray tags, truncated tags.  Character references are decoded in text alone; white
space within a block becomes one space, blocks are joined by one space in page order.

Defined results: a null or empty page, or one without content, gives the empty text; repeated rows repeat; an empty
table gives an empty table; nothing is capped.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
from pyspark.sql import DataFrame

from dagstore.llm import runtime as rt

THRESHOLD = 0.25
SIGMA = 1.0
PRIOR = 2.0

TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<[!?][^>]*(?:>|$)|</[^a-zA-Z>][^>]*(?:>|$)", re.S)
ATTR = re.compile(r"""(?:^|\s)(id|class|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
CONTAINER = re.compile(r".*?/(?:article|main)(?=/|$)")
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？]")

# fixed values: element kinds of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# fixed values: what never is main text
OUTSIDE = set("nav header footer aside form script style noscript template head title iframe button select textarea svg canvas object embed menu dialog audio video math map datalist fieldset".split())
OUTSIDE_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
OUTSIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|newsletter|subscribe|signup|popup|modal|overlay|comments?|disqus|respond|replies|reply|sidebar|side|nav\w*|menu\w*|breadcrumbs?|pagination|pager|footer|header|masthead|related|recommend\w*|share|sharing|social|widget|toolbar|login|search)(?:$|[\s_-])",
    re.I,
)
# header and side inside an article may be its own title block; these names only count outside of one
KEEP_IN_ARTICLE = {"header"}


class Node:
    __slots__ = ("name", "outside", "article", "path")

    def __init__(self, name: str, outside: bool, article: bool, path: str):
        self.name, self.outside, self.article, self.path = name, outside, article, path


def _outside(name: str, attrs: str, in_article: bool) -> bool:
    if name in OUTSIDE:
        return not (name in KEEP_IN_ARTICLE and in_article)
    if not attrs or attrs.isspace():
        return False
    for key, a, b, c in ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
        if key == "role" and value.lower() in OUTSIDE_ROLES:
            return True
        if key in ("id", "class") and name not in ("html", "body", "article", "main") and OUTSIDE_NAMES.search(value):
            return True
    return False


class Blocks:
    """Text nodes in page order: path, whether in an article or main element, text, link characters; and the blocks they are in."""

    def __init__(self) -> None:
        self.nodes: list[tuple[str, bool, int, str, bool]] = []  # path, in an article, block, text, in a link
        self.block = 0


def parse(page: str) -> Blocks:
    out, stack = Blocks(), [Node("#root", False, False, "")]
    at, end = 0, len(page)
    links = 0

    def text(raw: str) -> None:
        top = stack[-1]
        if not top.outside and raw and not raw.isspace():
            out.nodes.append((top.path, top.article, out.block, entities.unescape(raw) if "&" in raw else raw, links > 0))
        elif not top.outside and raw:
            out.nodes.append((top.path, top.article, out.block, " ", links > 0))

    def pop(k: int) -> None:
        nonlocal links
        for n in stack[k:]:
            links -= n.name == "a"
            if n.name not in INLINE:
                out.block += 1
        del stack[k:]

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = TAG.match(page, lt)
        if not m:  # a bare < is text
            nxt = page.find("<", lt + 1)
            nxt = end if nxt < 0 else nxt
            text(page[at:nxt])
            at = nxt
            continue
        text(page[at:lt])
        at = m.end()
        if m[2] is None:
            continue
        name, closing, attrs = m[2].lower(), bool(m[1]), m[3] or ""
        if closing:
            if name == "br":
                out.block += 1
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    pop(k)
                    break
                if stack[k].name in ("td", "th", "table", "article", "main") and name in ("p", "li", "div", "b", "i", "em", "strong", "a", "span"):
                    break
            else:
                if name not in INLINE:
                    out.block += 1
            continue
        if name in VOID:
            if name in ("br", "hr"):
                out.block += 1
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    pop(k)
                    break
                if stack[k].name not in INLINE:
                    break
        if name in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in SIBLINGS[name]:
                    pop(k)
                    break
                if stack[k].name in SCOPE[name]:
                    break
        top = stack[-1]
        if name == "body" or name == "html":
            if any(n.name == name for n in stack):
                continue
            if name == "body":  # an unclosed head ends here
                for k in range(1, len(stack)):
                    if stack[k].name == "head":
                        pop(k)
                        top = stack[-1]
                        break
        article = top.article or (name in ("article", "main") and not top.outside)
        inline = name in INLINE
        node = Node(name, top.outside or _outside(name, attrs, article), article, top.path if inline else f"{top.path}/{name}")
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if not node.outside:
                stack.append(node)
                text(page[at : stop.start() if stop else end])
                stack.pop()
            if not stop:
                break
            gt = page.find(">", stop.end())
            at = end if gt < 0 else gt + 1
            continue
        if not inline:
            out.block += 1
        if attrs.rstrip().endswith("/") and name in ("svg", "path", "math"):
            continue
        stack.append(node)
        links += name == "a"
    return out


def path_scores(nodes: list[tuple[str, bool, int, str, bool]]) -> dict[str, float]:
    """The fused, smoothed ratio of each path."""
    keys: dict[str, int] = {}
    of = np.array([keys.setdefault(n[0], len(keys)) for n in nodes])
    size = np.array([len(n[3].strip()) for n in nodes], float)
    link = np.array([len(n[3].strip()) if n[4] else 0 for n in nodes], float)
    marks = np.array([len(PUNCTUATION.findall(n[3])) for n in nodes], float)
    count = np.bincount(of)
    text_ratio = np.bincount(of, size) / count
    mark_ratio = np.bincount(of, marks) / count
    plain = 1 - np.bincount(of, link) / np.maximum(1, np.bincount(of, size))
    fused = np.sqrt(text_ratio * (1 + mark_ratio)) * plain
    span = np.arange(-3, 4)
    kernel = np.exp(-(span**2) / (2 * SIGMA**2))
    series = fused[of]
    weight = np.convolve(np.ones(len(series)), kernel)[3 : 3 + len(series)]
    smooth = np.convolve(series, kernel)[3 : 3 + len(series)] / weight
    smooth = np.sqrt(smooth * series)  # a path without merit gains nothing from its neighbours
    mean = np.bincount(of, smooth) / count
    return {k: float(mean[i]) for k, i in keys.items()}


def content_nodes(nodes: list[tuple[str, bool, int, str, bool]], threshold: float = THRESHOLD) -> list[tuple[str, bool, int, str, bool]]:
    if not nodes:
        return []
    size: dict[str, int] = {}
    container: dict[str, str] = {}  # paths in an article or main element: the path of that element
    for path, article, _, text, _ in nodes:
        size[path] = size.get(path, 0) + len(text.strip())
        if article and path not in container:
            container[path] = CONTAINER.match(path)[0]
    scores = path_scores(nodes)
    weigh = {p: s * np.sqrt(size[p]) * (PRIOR if p in container else 1) for p, s in scores.items()}
    top, best = max(weigh.values()), max(scores.values())
    kept = {p for p, w in weigh.items() if w > 0 and w >= threshold * top}
    homes = {p.rsplit("/", 1)[0] for p in kept}  # headings beside the kept paragraphs
    around = {container[p] for p in kept if p in container}
    for path, score in scores.items():
        parent, _, leaf = path.rpartition("/")
        if (parent in homes and re.fullmatch(r"h[1-6]|p|pre|blockquote", leaf)) or (container.get(path) in around and score >= threshold**3 * best):
            kept.add(path)
    return [n for n in nodes if n[0] in kept]


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    if not page:
        return ""
    blocks: list[str] = []
    last = None
    for _, _, block, text, _ in content_nodes(parse(page).nodes, threshold):
        if block == last:
            blocks[-1] += text
        else:
            blocks.append(text)
            last = block
    return " ".join(" ".join(blocks).split())


def extract(df: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """The id columns, text and n_chars (code points), one row per input row."""
    types = dict(df.dtypes)
    ddl = ", ".join(f"{c} {types[c]}" for c in id_cols) + ", text string, n_chars bigint"
    schema, k = rt.arrow_schema(ddl), len(id_cols)

    def run(batches):
        for b in rt.slices(batches):
            texts = [main_text(p, threshold) for p in b.column(k).to_pylist()]
            yield rt.to_batch(schema, [*[b.column(i).to_pylist() for i in range(k)], texts, [len(t) for t in texts]])

    return rt.map_arrow(rt.only(df, *id_cols, html_col), run, ddl)
