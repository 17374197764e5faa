"""Main text of HTML pages by minimum-cut labelling.

A page is cut into blocks at block-level tags. A linear classifier over the block's own features (length, share of linked
text, sentence ends) and those of its place (element names, class and id words of its ancestors) gives each block a cost of being called
content and a cost of being called boilerplate; these are its capacities to the two terminals. It is a logistic regression fitted, on
the driver, on PAGES labelled pages made from templates with a fixed seed. Neighbours in page order and blocks under one parent are
joined by smoothness edges. The minimum cut separates content from boilerplate. Elements that are never main text
(navigation, scripts, ...) have unbounded costs, so no neighbour pulls them over. So has a form, unless it holds prose, as where a page
lies in one form as a whole; and so has what is labelled as advert, comments, sidebar or the like inside an article or main element:
the credit of that place is the article's, not the inset's. An article that opens in such an element of main, and is not itself
so labelled, is judged again; so is an element with a label for content beside the other.

Text is never dropped inside a content block and blocks are never capped: only the cut decides.

Defined cases: null or empty html, and html without content, give an empty text; unclosed and stray tags are taken as browsers
take them; a very long page is one value, whose blocks meet in one cut; repeated rows and null ids are rows of their own; other
columns, whatever their names, play no part; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Element names.
BLOCK = set("address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes template".split())
NEVER = set("nav footer aside script style template iframe noscript select button textarea head title menu dialog object svg canvas audio video noembed noframes datalist input search".split())
CLOSES_P = BLOCK - {"body", "head", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "title", "noscript", "canvas", "legend"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "p": set("article section div td li body blockquote main table".split())}
BAD = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|nav(?:bar|igation)?|menu|sidebar|side-?bar|footer|masthead|site-?header|page-?header|top-?bar|cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|signup|social|sharing|related|recommend(?:ed|ations?)?|breadcrumbs?|comments?|comment-?list|disqus|replies|respond|widget|pagination|pager|toolbar)(?:$|[\s_-])", re.I)
WEAK = re.compile(r"(?:^|[\s_-])(?:share|copyright|legal|login|search|tags|skip|toc|alert|links|meta|byline)(?:$|[\s_-])", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article|content|entry|post|story|body|main|text|prose)(?:$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>\"']|$)", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
SPACE = re.compile(r"\s+")
FIELD = re.compile(r"<(?:select|textarea|button)\b|<input\b(?![^>]*type\s*=\s*[\"']?hidden)", re.I)
SENTENCE = re.compile(r"[.!?。…:;][\"'”»)]*(?:\s|$)")
#: Words that a form holds for each of its fields, and one more, from which it is no form but holds the page.
FORM_WORDS = 40
#: The classifier's features; words is the logarithm of one more than the block's words.
FEATURES = ("bias", "words", "linked", "sentence", "article", "main", "good", "bad", "weak", "heading", "item")
#: Pages that it is fitted on, the penalty of its weights, and the seed.
PAGES, RIDGE, SEED = 400, 1.0, 20240307
NEIGHBOUR, SIBLING, NEVER_COST = 0.6, 0.4, 1e6


class Block:
    __slots__ = ("parts", "linked", "path", "tag", "never", "bad", "weak", "good", "inside")

    def __init__(self, path: int, tag: str, never: bool, bad: bool, weak: bool, good: bool, inside: frozenset):
        self.parts, self.linked, self.path, self.tag, self.never, self.bad, self.weak, self.good, self.inside = [], 0, path, tag, never, bad, weak, good, inside

    def text(self) -> str:
        return SPACE.sub(" ", html.unescape("".join(self.parts))).strip()


def is_form(page: str, at: int) -> bool:
    """Whether the form element whose start tag ends at this place is a form to fill in, and not what holds the page."""
    end = re.compile(r"</form\b|<form\b", re.I).search(page, at)
    inner = re.sub(r"(?is)<(script|style|template|noscript)\b.*?(?:</\1|\Z)|<!--.*?(?:-->|\Z)", " ", page[at : end.start() if end else len(page)])
    words = len(re.sub(r"<[^>]*>", " ", inner).split())
    return words < FORM_WORDS * (1 + len(FIELD.findall(inner)))


def blocks(page: str) -> list[Block]:
    """The page's blocks in order; those of white space only are left out."""
    # Open elements: (name, number, never, bad, good, names of ancestors and itself, inset, weak).
    stack: list[tuple] = [("", 0, False, False, False, frozenset(), False, False)]
    made, now, out = 0, None, []
    raw: str | None = None

    def close_to(i: int) -> None:
        nonlocal now
        if any(x[0] in BLOCK or x[2] != stack[i - 1][2] or x[3] != stack[i - 1][3] or x[6] != stack[i - 1][6] for x in stack[i:]):
            now = None
        del stack[i:]

    at, size = 0, len(page)
    while at < size:
        if raw:
            m = re.compile(rf"</{raw}(?=[\s/>])", re.I).search(page, at)
            stop = m.start() if m else size
            raw, at = None, stop
            continue
        m = TOKEN.match(page, at)
        if m is None:  # an unclosed quote in a tag: the tag ends at its first bracket
            stop = page.find(">", at)
            at = size if stop < 0 else stop + 1
            continue
        at = m.end()
        if m[4] is not None:
            if now is None:
                if m[4].isspace():
                    continue
                home = next((x for x in reversed(stack) if x[0] in BLOCK), stack[0])
                top = stack[-1]
                now = Block(home[1], home[0], top[2] or top[6], top[3], top[7], top[4], top[5])
                out.append(now)
            now.parts.append(m[4])
            if "a" in stack[-1][5]:
                now.linked += len(m[4].strip())
            continue
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            # A stray end tag closes nothing, and an inline one closes no block around it.
            if i and (name in BLOCK or not any(x[0] in BLOCK for x in stack[i + 1 :])):
                close_to(i)
            elif name == "p":
                now = None
            continue
        if name in ("br", "hr", "img", "wbr", "input"):
            if now is not None and name == "br":
                now.parts.append(" ")
            if name == "hr":
                now = None
            continue
        if name in VOID:
            continue
        if name in CLOSES_P:
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p" or stack[i][0] in STOPS["p"]), 0)
            if i and stack[i][0] == "p":
                close_to(i)
        if name in SAME:
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in SAME[name] or stack[i][0] in STOPS[name]), 0)
            if i and stack[i][0] in SAME[name]:
                close_to(i)
        if name in BLOCK:
            now = None
        attributes = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3] and not m[3].isspace() else {}
        label = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        up = stack[-1]
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I)
        # A page's own header is no main text; an article's header holds its title.
        never = up[2] or name in NEVER or bool(hidden) or attributes.get("role", "").lower() in ROLES or (name == "header" and not up[5] & {"article", "main"}) or (name == "form" and is_form(page, at))
        # The root elements' labels say nothing about a block, and an article may be called a post with comments.
        bad = up[3] or (name not in ("body", "html", "article", "main") and bool(BAD.search(label)))
        inset = up[6]
        if name == "article" and "article" not in up[5]:
            inset = inset and bool(BAD.search(label))
        elif name not in ("body", "html", "article", "main") and up[5] & {"article", "main"} and BAD.search(label):
            inset = inset or not any(GOOD.search(x) and not BAD.search(x) for x in label.split())
        if never and not up[2]:
            now = None
        if bad != up[3] or inset != up[6]:
            now = None
        if m[3].endswith("/") and name in ("svg", "path", "circle", "rect", "use"):
            continue
        made += 1
        stack.append((name, made, never, bad, up[4] or name in ("article", "main") or bool(GOOD.search(label)), up[5] | {name}, inset, up[7] or (name not in ("body", "html", "article", "main") and bool(WEAK.search(label)))))
        if name in RAW:
            raw = name
    return [b for b in out if not "".join(b.parts).isspace()]


def features(b: Block, text: str) -> tuple[float, ...]:
    return (
        1.0, math.log1p(text.count(" ") + 1), min(1.0, b.linked / max(1, len(text))), float(bool(SENTENCE.search(text))), float("article" in b.inside), float("main" in b.inside),
        float(b.good), float(b.bad), float(b.weak), float(b.tag in ("h1", "h2", "h3", "h4")), float(b.tag == "li"),
    )


def labelled_pages() -> list[tuple[str, set[str]]]:
    """Pages made from templates, each with the texts of its content blocks."""
    r = random.Random(SEED)
    word = lambda: "".join(r.choice("aaeeiioudfghlmnnprrsstt") for _ in range(r.randrange(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randrange(a, b)))
    links = lambda a, b: "<ul>" + "".join(f"<li><a href=/x>{words(1, 4)}</a></li>" for _ in range(r.randrange(a, b))) + "</ul>"
    box = lambda labels, body: f"<div{x}>{body}</div>" if (x := r.choice([f' class="{c}"' for c in labels] + [""])) else f"<div>{body}</div>"
    out = []
    for _ in range(PAGES):
        content: set[str] = set()

        def kept(text: str, into: set[str] = content) -> str:
            into.add(text)
            return text

        def sentence() -> str:
            return words(*r.choice([(4, 10), (10, 40), (40, 120)])) + r.choice([".", ".", ".", "!", "?", ""])

        inner = f"<h1>{kept(words(3, 11))}</h1>"
        for _ in range(r.randrange(2, 10)):
            kind = r.random()
            if kind < 0.7:
                inner += f"<p>{kept(sentence())}</p>"
            elif kind < 0.8:
                inner += f"<h2>{kept(words(2, 7))}</h2>"
            elif kind < 0.9:
                inner += "<ul>" + "".join(f"<li>{kept(words(3, 16))}</li>" for _ in range(r.randrange(2, 6))) + "</ul>"
            else:
                inner += r.choice(["<blockquote>{}</blockquote>", "<pre>{}</pre>", "<p class=legal>{}</p>"]).format(kept(sentence()))
        place = r.choice(["<article>{}</article>"] * 4 + ["<main>{}</main>", "<main><article>{}</article></main>", "<div class=content>{}</div>", "<div class=entry-content>{}</div>", "<div id=main>{}</div>", "<div>{}</div>"])
        around = [
            box(["menu", "navbar", "links"], links(4, 12)), box(["tagline"], words(3, 9)), box(["ad", "promo", "sponsored", "banner"], f"{words(4, 20)}."), box(["sidebar", "widget"], f"<h3>{words(1, 4)}</h3>{links(2, 8)}{words(2, 9)}"),
            f"<div class={r.choice(['comments', 'comment-list', 'replies'])}>" + "".join(f"<p>{words(5, 60)}.</p>" for _ in range(r.randrange(1, 5))) + "</div>",
            box(["footer", "copyright", "legal"], f"(c) {words(3, 14)}"), box(["related", "recommended"], links(3, 9)), box(["login", "search", "share"], words(1, 6)),
        ]
        r.shuffle(around)
        cut = r.randrange(len(around) + 1)
        out.append((f"<body>{''.join(around[:cut])}{place.format(inner)}{''.join(around[cut:])}</body>", content))
    return out


@lru_cache(1)
def fitted() -> tuple[float, ...]:
    """The classifier's weights: a penalised logistic regression by Newton's method."""
    rows = [(features(b, t), t in content) for page, content in labelled_pages() for b in blocks(page) if (t := b.text()) and not b.never]
    x, y = np.array([f for f, _ in rows]), np.array([float(c) for _, c in rows])
    w = np.zeros(len(FEATURES))
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (y - p) - RIDGE * w)
    return tuple(float(v) for v in w)


def odds(b: Block, text: str, weights: tuple[float, ...]) -> float:
    """Log odds that the block is content."""
    return sum(w * f for w, f in zip(weights, features(b, text), strict=True))


class Flow:
    """Maximum flow by shortest augmenting levels."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.room: list[float] = []
        self.edges: list[list[int]] = [[] for _ in range(n)]

    def join(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def levels(self, source: int) -> list[int]:
        level, queue = [-1] * len(self.edges), deque([source])
        level[source] = 0
        while queue:
            x = queue.popleft()
            for e in self.edges[x]:
                if self.room[e] > 1e-12 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """The side of each node once no more flow passes."""
        while (level := self.levels(source))[sink] >= 0:
            next_edge = [0] * len(self.edges)
            path: list[int] = []
            x = source
            while True:
                if x == sink:
                    most = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= most
                        self.room[e ^ 1] += most
                    i = next(i for i, e in enumerate(path) if self.room[e] <= 1e-12)
                    x = self.to[path[i] ^ 1]
                    del path[i:]
                    continue
                while next_edge[x] < len(self.edges[x]):
                    e = self.edges[x][next_edge[x]]
                    if self.room[e] > 1e-12 and level[self.to[e]] == level[x] + 1:
                        break
                    next_edge[x] += 1
                if next_edge[x] < len(self.edges[x]):
                    path.append(e)
                    x = self.to[e]
                elif x == source:
                    break
                else:
                    level[x] = -1
                    x = self.to[path.pop() ^ 1]
        return [v >= 0 for v in level]


def label(found: list[Block], texts: list[str], weights: tuple[float, ...]) -> list[bool]:
    """Whether each block is content: the source side of the minimum cut."""
    n = len(found)
    if not n:
        return []
    # Where every block leans the same way the cut is empty, and smoothness edges carry nothing.
    lean = [-NEVER_COST if b.never else odds(b, t, weights) for b, t in zip(found, texts, strict=True)]
    if all(x > 0 for x in lean) or all(x <= 0 for x in lean):
        return [x > 0 for x in lean]
    places: dict[int, int] = {}
    flow = Flow(n + 2 + len({b.path for b in found}))
    for i, (b, x) in enumerate(zip(found, lean, strict=True)):
        flow.join(n, i, max(x, 0.0))
        flow.join(i, n + 1, max(-x, 0.0))
        if not b.never:
            if i and not found[i - 1].never:
                flow.join(i - 1, i, NEIGHBOUR, NEIGHBOUR)
            home = places.setdefault(b.path, n + 2 + len(places))
            flow.join(i, home, SIBLING, SIBLING)
    return flow.source_side(n, n + 1)[:n]


def main_text(page: str | None, weights: tuple[float, ...] | None = None) -> str:
    """The page's content blocks in order, two line ends between them. weights: the classifier's, fitted ones if left out."""
    found = [(b, t) for b in blocks(page or "") if (t := b.text())]
    labels = label([b for b, _ in found], [t for _, t in found], weights or fitted())
    return "\n\n".join(t for (_, t), good in zip(found, labels, strict=True) if good)


def extract(pages: DataFrame, page: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """page_id, url, the main text and its length in code points."""
    weights = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", text, n_chars])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(page).alias("html"))
    return rows.mapInArrow(run, f"page_id long, url string, {text} string, {n_chars} long")


def op7_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
