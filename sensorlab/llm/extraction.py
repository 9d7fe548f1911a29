"""Main text of web pages by a linear-chain conditional random field.

A page is read as a sequence of leaf blocks: runs of text between the borders of
block elements, with the elements they lie in. Each block has features of its
ancestors (tags; words of class, id and role; each counts once, however deep the page is
nested), of the nearest ancestor that is more than a nameless wrapper, and of its text
(length, share of link text, ends, marks). The field weighs the features, and pairs of neighbouring
labels apart for blocks held by one element and by two. Viterbi's algorithm gives the
likeliest labels of a page's blocks; those labelled main are its text.

It is fitted by gradient steps on the exact likelihood of ``TRAIN_PAGES`` labelled
pages, which ``labelled_page`` lays out by seeded rules: an article in any of the
usual containers, named or not, in up to ``NESTED`` wrappers around it and the page, among menus, headers, footers, sidebars, notices, adverts,
forms and reader comments, with invented words, so that only layout and shape
can be learned. Every page is the same labelled set; no page of a table is used.

Scripts, styles, templates, frames and comments of the markup are no blocks, nor is
a noscript before the body. All other elements are, or lie in, blocks: svg and math
are read as inline elements, where ``/>`` ends one. Character references
are decoded, white space inside a block is one space, blocks are joined by one
line feed. Null and empty pages, and pages without a main block, give an empty
text. Unclosed or stray tags end where HTML ends them or are passed over. Rows are
read one by one, so repeated rows give equal texts; columns that clash with
a result column are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sensorlab.llm.common import map_arrow

TRAIN_PAGES, STEPS, RATE, RIDGE, SEED = 800, 120, 0.15, 0.02, 41

# Elements by their part in HTML.
RAW = frozenset("script style template iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp "
    "small span strike strong sub sup time tt u var wbr br noscript object param embed svg math".split()
)
#: Inline elements whose end ends the blocks in them.
CARRIERS = frozenset("noscript object".split())
#: Elements in svg and math that hold HTML, those whose text stands apart, and tags that end both.
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
APART = frozenset("foreignobject desc title text mtd mtr annotation annotation-xml".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: An element, and those it closes when it begins.
CLOSES = {
    "p": {"p"},
    "li": {"li", "p"},
    "dt": {"dt", "dd", "p"},
    "dd": {"dt", "dd", "p"},
    "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"},
    "th": {"td", "th", "p"},
    "option": {"option"},
    "body": {"head", "title"},
}
#: Block elements that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main nav ol pre section table ul".split()
)
BREAKS_OUT = ENDS_P | frozenset(
    "b big body br center code dd dt em embed head i img li meta p pre ruby s small span strong "
    "strike sub sup tt u var".split()
)
#: Elements beyond which an implied end does not reach.
SCOPE = frozenset("object foreignobject table ul ol dl div article section main body html td th".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_RAW_END = {
    tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for tag in (*RAW, "noscript")
}
_UNQUOTED = re.compile(r"=\s*[^\s\"'][^\s]*/\Z")
_ATTRIBUTE = re.compile(
    r"""\b(class|id|role|style|hidden|aria-label|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""",
    re.IGNORECASE,
)
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_MARKS = re.compile(r"[©®]")
_END = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*$")


#: Elements that tell a part of the page by themselves.
TELLING = frozenset("nav header footer aside form main article".split())


class Block:
    """Text of a leaf block, its features, and the element that holds its own."""

    __slots__ = ("text", "features", "parent")

    def __init__(self, text: str, features: list[str], parent: int):
        self.text, self.features, self.parent = text, features, parent


class Element:
    """An open element, and what holds for all that lies in it.

    ``around`` are the features of all elements open there, each once however often it
    recurs, so a block's features do not grow with depth. ``telling`` are those of the
    nearest element that is more than a nameless wrapper.
    """

    __slots__ = ("tag", "number", "around", "telling", "own", "holder", "outer", "within", "foreign")

    def __init__(self, tag: str, number: int, found: tuple[str, ...], above: Element | None, at: int):
        self.tag, self.number = tag, number
        around = above.around if above else frozenset()
        self.around = around if around.issuperset(found) else around.union(found)
        self.telling = above.telling if above else ()
        if found and tag not in INLINE and (len(found) > 1 or tag in TELLING):
            self.telling = tuple("near:" + f for f in found)
        self.own, self.holder, self.outer = (
            (above.own, above.holder, above.outer) if above else ("none", -1, -1)
        )
        if found and tag not in INLINE:
            self.own, self.holder, self.outer = tag, number, self.holder
        # place of the svg or math whose own content is read, and whether any is open
        self.within = above.within if above else -1
        self.foreign = bool(above and above.foreign) or tag in ("svg", "math")
        if tag in ("svg", "math"):
            self.within = at
        elif tag in HOLDS_HTML:
            self.within = -1


@lru_cache(maxsize=20_000)
def element_features(tag: str, attributes: str) -> tuple[str, ...]:
    found = {f"in:{tag}"}
    for match in _ATTRIBUTE.finditer(attributes):
        name = match[1].lower()
        value = match[2] or match[3] or match[4] or ""
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            found.add("hidden")
        elif name != "style":
            found |= {f"name:{word.lower()}" for word in _NAME.findall(value)}
    return tuple(sorted(found))


def text_features(text: str, linked: int) -> list[str]:
    words = text.count(" ") + 1
    found = [f"words:{min(words, 64).bit_length()}", f"links:{4 * linked // max(len(text), 1)}"]
    if _END.search(text):
        found.append("ends")
    if _MARKS.search(text):
        found.append("marks")
    return found


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in page order."""
    out: list[Block] = []
    stack: list[Element] = []
    open_tags: Counter = Counter()
    pieces: list[str] = []
    linked = numbers = foreign_open = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                last = stack[-1] if stack else None
                features = text_features(text, linked)
                features.append(f"own:{last.own if last else 'none'}")
                if last:
                    features += [*last.telling, *last.around]
                out.append(Block(text, features, last.outer if last else -1))
            pieces.clear()
        linked = 0

    def push(tag: str, found: tuple[str, ...]) -> None:
        nonlocal numbers, foreign_open
        numbers += 1
        stack.append(Element(tag, numbers, found, stack[-1] if stack else None, len(stack)))
        open_tags[tag] += 1
        foreign_open += tag in ("svg", "math")

    def close(at: int) -> None:
        nonlocal foreign_open
        for element in stack[at:]:
            open_tags[element.tag] -= 1
            foreign_open -= element.tag in ("svg", "math")
        del stack[at:]

    def last_of(tag: str) -> int:
        """Place of the innermost open element of a tag, or -1."""
        if open_tags[tag] > 0:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at].tag == tag:
                    return at
        return -1

    def in_head() -> bool:
        if stack and stack[-1].tag == "head":
            return True
        bare = not stack or len(stack) == 1 and stack[0].tag == "html"
        return not out and bare and not "".join(pieces).strip()

    def add(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if open_tags["a"] > 0:
                linked += len(text)

    done = 0
    while match := _TOKEN.search(page, done):
        add(page[done : match.start()])
        done = match.end()
        tag = (match["tag"] or match["tag2"] or "").lower()
        if not tag:
            continue
        ending = match["end"] or match["end2"]
        attributes = match["attrs"] or match["attrs2"] or ""
        closed = attributes.rstrip().endswith("/") and not _UNQUOTED.search(attributes.rstrip())
        within = stack[-1].within if stack else -1
        if not ending:
            if tag in RAW and not (closed and (within >= 0 or tag == "iframe")):
                last = _RAW_END[tag].search(page, done)
                done = last.end() if last else len(page)
                continue
            if tag in RAW:
                continue
            if tag == "noscript" and in_head() and (last := _RAW_END[tag].search(page, done)):
                done = last.end()
                continue
            if within >= 0 and tag in BREAKS_OUT:
                close(within)
                within = -1
        if tag == "br":
            pieces.append(" ")
            continue
        if foreign_open and tag in APART:
            pieces.append(" ")
        if within >= 0 and not ending:
            if not closed:
                push(tag, ())
            continue
        if foreign_open and ending:
            at = last_of(tag)
            if at >= 0 and stack[at].foreign:
                if any(e.tag in ENDS_P for e in stack[at:]):
                    flush()
                close(at)
                continue
            if at < 0:
                continue
            close(next(i for i in range(at, len(stack)) if stack[i].tag in ("svg", "math")))
        if tag not in INLINE:
            flush()
        if ending:
            if open_tags[tag] > 0:
                for at in range(len(stack) - 1, -1, -1):
                    if stack[at].tag == tag:
                        if tag in CARRIERS and any(e.tag not in INLINE for e in stack[at:]):
                            flush()
                        close(at)
                        break
                    if tag in INLINE and tag not in CARRIERS and stack[at].tag not in INLINE:
                        break
            continue
        ended = CLOSES.get(tag, {"p"} if tag in ENDS_P else ())
        if any(open_tags[e] > 0 for e in ended):
            at = len(stack)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in ended:
                    at = i
                elif stack[i].tag in SCOPE:
                    break
            if at < len(stack):
                close(at)
        if tag in VOID or tag in ("svg", "math") and closed:
            continue
        push(tag, element_features(tag, attributes))
    add(page[done:])
    flush()
    return out


class Field:
    """Weights of features for the label main, and of pairs of neighbouring labels."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs.tolist()

    def labels(self, found: list[Block]) -> list[bool]:
        """The likeliest labels, by Viterbi's algorithm."""
        if not found:
            return []
        get = self.weights.get
        best0, best1 = 0.0, 0.0
        back: list[tuple[bool, bool]] = []
        for i, block in enumerate(found):
            emit = get("bias", 0.0) + sum(get(f, 0.0) for f in block.features)
            if not i:
                best0, best1 = 0.0, emit
                continue
            (p00, p01), (p10, p11) = self.pairs[found[i - 1].parent == block.parent]
            from0, from1 = best1 + p10 > best0 + p00, best1 + p11 > best0 + p01
            back.append((from0, from1))
            best0, best1 = (
                max(best0 + p00, best1 + p10),
                max(best0 + p01, best1 + p11) + emit,
            )
        label = best1 > best0
        out = [label]
        for from0, from1 in reversed(back):
            label = from1 if label else from0
            out.append(label)
        return out[::-1]


# Names that pages give to the parts around and of an article.
AROUND = {
    "nav": ("nav", "menu", "navbar", "breadcrumb", "pagination", "toc", "navigation"),
    "header": ("header", "masthead", "topbar", "site-header", "branding"),
    "footer": ("footer", "site-footer", "copyright", "legal", "bottom"),
    "aside": ("sidebar", "aside", "related", "widget", "recommended", "trending", "popular"),
    "notice": ("notice", "cookie-banner", "alert", "consent", "gdpr", "popup", "newsletter", "modal"),
    "advert": ("ad", "ads", "advert", "sponsored", "promo", "banner-ad", "advertisement"),
    "form": ("form", "search", "login", "signup", "subscribe", "contact-form"),
    "comments": ("comments", "comment-list", "responses", "discussion", "disqus", "replies"),
}
CONTAINERS = (
    "<article>",
    '<article class="post">',
    "<main>",
    '<div class="article-body">',
    '<div class="content">',
    '<div id="content">',
    '<div class="entry-content">',
    '<section class="story">',
    '<div class="post">',
    '<div role="main">',
    '<div itemprop="articleBody">',
    '<td class="text">',
    "<div>",
    "<section>",
    "<div>",
)
#: Wrappers around a page, an article or a part of it, and the most that are nested.
WRAPPERS = ("div", "div", "div", "section", "article")
WRAPPER_NAMES = ("container", "row", "col-md-8", "wrapper", "page", "inner", "layout", "grid", "site")
NESTED = 15


def labelled_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page laid out by rules, and the label of each of its leaf blocks."""
    parts: list[str] = []
    labels: list[bool] = []
    pick = lambda options: options[int(rng.integers(len(options)))]

    def words(low: int, high: int, end: str = "") -> str:
        n = int(rng.integers(low, high + 1))
        syllables = "ab ce di fo gu ha".split()
        made = ("".join(pick(syllables) for _ in range(rng.integers(1, 5))) for _ in range(n))
        return " ".join(made) + end

    def wrapped(inner, tags=WRAPPERS) -> None:
        """What ``inner`` adds, in none to many wrappers."""
        depth = int(rng.integers(1, NESTED + 1)) if rng.random() < 0.5 else 0
        made = [pick(tags) for _ in range(depth)]
        for tag in made:
            parts.append(f'<{tag} class="{pick(WRAPPER_NAMES)}">' if rng.random() < 0.3 else f"<{tag}>")
        inner()
        parts.extend(f"</{tag}>" for tag in reversed(made))

    def block(tag: str, text: str, label: bool, link: float = 0.0) -> None:
        if rng.random() < link:
            text = f'<a href="/x">{text}</a>'
        elif rng.random() < 0.15:
            text = f"<b>{text}<br>" if rng.random() < 0.5 else f"<em>{text}</em>"
        parts.append(f"<{tag}>{text}" + (f"</{tag}>" if rng.random() < 0.9 else ""))
        labels.append(label)

    def around(kind: str) -> None:
        name = pick(AROUND[kind])
        tag = {"comments": "section", "notice": "div", "advert": "div"}.get(kind, kind)
        semantic = rng.random() < 0.5
        tag = tag if semantic else "div"
        told_by_tag = semantic and kind in ("nav", "header", "footer", "aside", "form")
        named = rng.random() < (0.5 if told_by_tag else 1.0)
        key = pick(("class", "class", "id"))
        parts.append(f'<{tag} {key}="{name}">' if named else f"<{tag}>")
        if kind == "nav" or kind in ("header", "footer", "aside") and rng.random() < 0.4:
            parts.append("<ul>")
            for _ in range(rng.integers(2, 8)):
                block("li", words(1, 4), False, 0.9)
            parts.append("</ul>")
        if kind == "form":
            for _ in range(rng.integers(1, 4)):
                block(pick(("label", "button", "p")), words(1, 6), False)
        elif kind != "nav":
            for _ in range(rng.integers(1, 2 + 4 * (kind in ("comments", "aside")))):
                long = rng.random() < 0.6 and kind in ("comments", "advert", "notice", "aside", "footer")
                mark = "&copy; " if kind == "footer" and rng.random() < 0.5 else ""
                text = words(5, 50, pick((".", ".", "!", ""))) if long else words(1, 6)
                block(pick(("p", "div", "p", "li")), mark + text, False, 0.15)
        parts.append(f"</{tag}>")

    def article() -> None:
        opening = pick(CONTAINERS)
        tag = re.match(r"<(\w+)", opening)[1]
        parts.append("<table><tr>" + opening if tag == "td" else opening)
        if rng.random() < 0.7:
            block(pick(("h1", "h1", "h2")), words(1, 12), True)
        for _ in range(rng.integers(1, 9)):
            kind = rng.random()
            if kind < 0.72:
                block("p", words(1, 90, pick((".", ".", ".", ""))), True)
            elif kind < 0.8:
                block(pick(("h2", "h3")), words(1, 8), True)
            elif kind < 0.86:
                parts.append("<ul>")
                for _ in range(rng.integers(1, 4)):
                    block("li", words(1, 20, pick((".", ""))), True, 0.1)
                parts.append("</ul>")
            elif kind < 0.92:
                block(pick(("blockquote", "pre")), words(4, 40, "."), True)
            else:
                around(pick(("advert", "aside", "notice", "form")))
        if rng.random() < 0.15:
            around("comments")
        parts.append(f"</{tag}></tr></table>" if tag == "td" else f"</{tag}>")

    if rng.random() < 0.9:
        parts.append("<html><head>")
        block("title", words(1, 10), False)
        parts.append("<style>p{margin:0}</style><script>var t='</p>';</script></head><body>")

    def part(kind: str) -> None:
        wrapped(lambda: around(kind), ("div",)) if rng.random() < 0.3 else around(kind)

    def body() -> None:
        for kind in ("notice", "header", "nav", "form", "advert"):
            if rng.random() < 0.55:
                part(kind)
        if rng.random() < 0.25:
            part("aside")
        wrapped(article)
        for kind in ("comments", "aside", "advert", "form", "footer", "notice"):
            if rng.random() < 0.5:
                part(kind)

    wrapped(body)
    return "".join(parts), labels


def _likelihood(emit, labels, alive, same, pairs):
    """Marginals of main and of label pairs, by forward and backward sums over padded pages."""
    pages, length = emit.shape
    own = np.stack((np.zeros_like(emit), emit), axis=2)
    step = pairs[same.astype(int)]  # page, place, before, after: into each place
    forward = np.zeros((pages, length, 2))
    backward = np.zeros((pages, length, 2))
    forward[:, 0] = own[:, 0]
    for t in range(1, length):
        into = np.logaddexp.reduce(forward[:, t - 1, :, None] + step[:, t], axis=1) + own[:, t]
        forward[:, t] = np.where(alive[:, t, None], into, forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        back = np.logaddexp.reduce(
            step[:, t + 1] + (own[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2
        )
        backward[:, t] = np.where(alive[:, t + 1, None], back, backward[:, t + 1])
    total = np.logaddexp.reduce(forward[:, -1], axis=1)
    main = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]) * alive
    both = np.exp(
        forward[:, :-1, :, None]
        + step[:, 1:]
        + (own[:, 1:] + backward[:, 1:])[:, :, None, :]
        - total[:, None, None, None]
    ) * alive[:, 1:, None, None]
    return main, both


def fit_field(pages: list[tuple[list[Block], list[bool]]]) -> Field:
    """Weights by adaptive gradient steps on the likelihood, with a ridge penalty."""
    names: dict[str, int] = {"bias": 0}
    length = max(len(found) for found, _ in pages)
    rows, columns = [], []
    truth = np.zeros((len(pages), length))
    alive = np.zeros((len(pages), length), bool)
    same = np.zeros((len(pages), length), bool)
    for i, (found, labels) in enumerate(pages):
        for t, block in enumerate(found):
            alive[i, t], truth[i, t] = True, labels[t]
            same[i, t] = t > 0 and found[t - 1].parent == block.parent
            own = [0, *(names.setdefault(f, len(names)) for f in block.features)]
            rows += [i * length + t] * len(own)
            columns += own
    rows_, columns_ = np.array(rows), np.array(columns)
    held = truth.astype(int)
    seen = np.zeros((2, 2, 2))
    follows = alive[:, 1:]
    kinds = same[:, 1:][follows].astype(int)
    np.add.at(seen, (kinds, held[:, :-1][follows], held[:, 1:][follows]), 1)
    weights, pairs = np.zeros(len(names)), np.zeros((2, 2, 2))
    squares, pair_squares = np.full(len(names), 1e-8), np.full((2, 2, 2), 1e-8)
    for _ in range(STEPS):
        emit = np.bincount(rows_, weights[columns_], truth.size).reshape(truth.shape)
        main, both = _likelihood(emit, truth, alive, same, pairs)
        slope = np.bincount(columns_, (truth - main).ravel()[rows_], len(names)) - RIDGE * weights
        expected = np.stack([both[~same[:, 1:]].sum(axis=0), both[same[:, 1:]].sum(axis=0)])
        pair_slope = seen - expected - RIDGE * pairs
        squares += slope**2
        pair_squares += pair_slope**2
        weights += RATE * slope / np.sqrt(squares) * 4
        pairs += RATE * pair_slope / np.sqrt(pair_squares) * 4
    return Field({name: float(weights[i]) for name, i in names.items()}, pairs)


@lru_cache(maxsize=1)
def trained_field() -> Field:
    rng = np.random.default_rng(SEED)
    pages = []
    for _ in range(TRAIN_PAGES):
        page, labels = labelled_page(rng)
        found = blocks(page)
        if len(found) != len(labels):
            raise AssertionError("a labelled page is read as another number of blocks")
        pages.append((found, labels))
    return fit_field(pages)


def main_text(page: str, field: Field) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, main in zip(found, field.labels(found)) if main)


def extract_text(pages: DataFrame, page: str = "html") -> DataFrame:
    """Replace the page's markup by ``text`` and ``n_chars``."""
    field = trained_field()
    rest = [c for c in pages.columns if c not in ("text", "n_chars", page)]
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*rest).schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p or "", field) for p in batch.column(len(rest)).to_pylist()]
        columns = [
            *batch.columns[:-1],
            pa.array(texts, pa.string()),
            pa.array(list(map(len, texts)), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[*rest, "text", "n_chars"])

    return map_arrow(pages.select(*rest, page), run, types + "text string, n_chars long")
