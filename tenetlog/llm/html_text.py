"""Main text of web pages: flat text blocks judged by a decision tree.

A page is cut into blocks, the runs of text between block-level tags. Each block is
described by its words and link density, those of its neighbours, and by what encloses it
(navigation, form, comment, article). A decision tree says which blocks are main text. It
is trained at each call on ``LABELLED_PAGES``, a small table of pages whose blocks are
marked by hand, so every page of any table is judged by the same tree.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element and name lists of HTML and common page templates.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre "
    "search section select summary table tbody td tfoot th thead tr ul xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style title textarea iframe noembed noframes noscript template svg math canvas object audio video".split())
SCOPE_TAGS = frozenset("html table td th caption".split())
CONTROL_TAGS = frozenset("button select option optgroup label legend fieldset datalist output".split())
CHROME_TAGS = frozenset("nav header footer aside menu dialog".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
CHROME_NAMES = frozenset(
    "ad ads adsense adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies copyright "
    "disclaimer footer gdpr header masthead menu menubar nav navbar navigation newsletter notice pagination pager popup promo "
    "promoted promotion recommended related share sharing sidebar sitemap social sponsor sponsored subscribe teaser toolbar "
    "topbar widget widgets".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies reply respond".split())
ARTICLE_NAMES = frozenset("article content entry post story".split())
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = ("chrome", "form", "comment", "article", "beside", "heading", "paragraph",
            "words", "links", "words_before", "links_before", "words_after", "links_after")
_CHROME, _FORM, _COMMENT, _ARTICLE, _LINK, _CONTROL = 1, 2, 4, 8, 16, 32


def _marks(tag: str, attributes: str, around: int) -> int:
    """What encloses the content of an element, given what encloses the element."""
    marks = around
    if tag == "a":
        return marks | _LINK
    if tag in CONTROL_TAGS:
        return marks | _CONTROL
    names: list[str] = []
    for kind, *value in _NAMED.findall(attributes) if attributes else ():
        text = "".join(value)
        if kind.lower() == "role":
            marks |= _CHROME if text.lower() in CHROME_ROLES else _ARTICLE if text.lower() in ("main", "article") else 0
        else:
            names += [p.lower() for p in _PARTS.findall(text)]
    if tag in ("html", "body"):
        return around
    main = tag in ("article", "main")
    if COMMENT_NAMES.intersection(names) and tag != "main":
        marks |= _COMMENT
    elif main:
        marks |= _ARTICLE
        if not around & (_CHROME | _COMMENT):
            marks &= ~_FORM                        # a form around a whole page is no form of the article
    elif tag == "form":
        marks |= _FORM
    elif tag in CHROME_TAGS and not (tag == "header" and around & _ARTICLE):
        marks |= _CHROME
    elif tag in BLOCK_TAGS and CHROME_NAMES.intersection(names) and not (tag == "header" and around & _ARTICLE):
        marks |= _CHROME
    elif tag in BLOCK_TAGS and ARTICLE_NAMES.intersection(names):
        marks |= _ARTICLE
    return marks


class _Block:
    __slots__ = ("parts", "tag", "marks", "label", "words", "linked", "text")

    def __init__(self, tag: str, marks: int, label: str | None):
        self.parts: list[tuple[str, bool]] = []
        self.tag, self.marks, self.label = tag, marks, label

    def close(self) -> bool:
        """Join the parts; true if the block has a word."""
        raw = "".join(p for p, _ in self.parts)
        self.text = " ".join(html.unescape(raw).split() if "&" in raw else raw.split())
        self.words = self.text.count(" ") + 1 if self.text else 0
        self.linked = sum(len(p.split()) for p, link in self.parts if link)
        self.parts = []
        return self.words > 0


def blocks(page: str) -> list[_Block]:
    """Text blocks of a page in order, each non-empty. Time and memory grow with the page's length.

    Unclosed elements end as in browsers: a paragraph or list item at the next block, others with
    what encloses them; end tags without a start tag count for nothing. Comments, scripts,
    styles, titles and other raw elements give no text.
    """
    page = page.replace("\x00", "")
    # Each open element: tag, marks, depth of the nearest open p and li (-1: none), label, nearest block's tag.
    stack: list[tuple] = [("", 0, -1, -1, None, "")]
    opened: Counter = Counter()
    found: list[_Block] = []
    current: _Block | None = None
    at = 0

    def add(text: str) -> None:
        nonlocal current
        if not text:
            return
        top = stack[-1]
        if current is None:
            if text.isspace():
                return
            current = _Block(top[5], top[1], top[4])
        current.parts.append((text, bool(top[1] & _LINK)))

    def cut() -> None:
        nonlocal current
        if current is not None and current.close():
            found.append(current)
        current = None

    def pop_to(depth: int) -> None:
        for tag, *_ in stack[depth:]:
            opened[tag] -= 1
        del stack[depth:]

    size = len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        add(page[at:token.start()])
        at = token.end()
        if token.group(2) is None:
            continue
        tag, attributes = token.group(2).lower(), token.group(3)
        block = tag in BLOCK_TAGS
        if token.group(1):
            if block:
                cut()
            if opened[tag] > 0:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    if not block and stack[depth][0] in BLOCK_TAGS:      # an inline end tag stays in its block
                        depth = 0
                        break
                    depth -= 1
                if depth:
                    pop_to(depth)
            continue
        if block:
            cut()
            _, _, p, li, _, _ = stack[-1]
            if p > 0:
                pop_to(p)
            elif tag == "li" and li > 0:
                pop_to(li)
        elif tag == "br":
            add(" ")
        if tag in RAW_TAGS:
            if not (tag in ("svg", "math") and attributes.endswith("/")):
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = size if end is None else end.start()
            continue
        if tag in VOID_TAGS:
            continue
        _, around, p, li, label, holder = stack[-1]
        if tag in SCOPE_TAGS or tag in ("ul", "ol"):
            li = -1
        if tag in SCOPE_TAGS:
            p = -1
        depth = len(stack)
        if attributes and "data-label" in attributes:
            label = attributes.split("data-label=\"")[1][0]
        stack.append((tag, _marks(tag, attributes, around & ~_LINK if block else around),
                      depth if tag == "p" else p, depth if tag == "li" else li, label, tag if block else holder))
        opened[tag] += 1
    cut()
    return found


def described(found: list[_Block]) -> np.ndarray:
    """One row of ``FEATURES`` per block."""
    x = np.zeros((len(found), len(FEATURES)))
    if not found:
        return x
    words = np.array([b.words for b in found], float)
    links = np.minimum(np.array([b.linked for b in found]) / words, 1)
    marks = np.array([b.marks for b in found])
    for column, mark in enumerate((_CHROME, _FORM | _CONTROL, _COMMENT, _ARTICLE)):
        x[:, column] = (marks & mark) > 0
    x[:, 4] = x[:, 3].any() - x[:, 3]              # outside the article of a page that has one
    x[:, 5] = [b.tag in ("h1", "h2", "h3", "h4", "h5", "h6") for b in found]
    x[:, 6] = [b.tag in ("p", "blockquote", "pre", "dd") for b in found]
    x[:, 7], x[:, 8] = words, links
    x[1:, 9], x[1:, 10] = words[:-1], links[:-1]
    x[:-1, 11], x[:-1, 12] = words[1:], links[1:]
    return x


# --- the labelled table ---

_LONG = ("the river rose in the night and by morning the lower streets were under water, so the town moved its market to the "
         "hill where it stayed until the end of the month")
_MIDDLE = "nobody was hurt, but three bridges have to be built again before winter comes"
_SHORT = "They agreed."
_MENU = "".join(f'<li><a href="/{k}">{w}</a></li>' for k, w in enumerate(("Home", "World news", "Sport", "Weather", "About us")))

# Blocks inside data-label="1" are main text, inside data-label="0" they are not.
LABELLED_PAGES = (
    # Article element between menu, advert and footer.
    f'<nav data-label="0"><ul>{_MENU}</ul></nav><div class="ad" data-label="0">{_MIDDLE}</div><article data-label="1"><h1>Flood in '
    f'the valley</h1><p>{_LONG}<p>{_SHORT}<p>{_MIDDLE}<p>So.</p><p>{_LONG}, see <a href="/m">the map</a></p></article>'
    f'<footer data-label="0">&copy; paper &middot; {_MIDDLE}</footer>',
    # Header of the page, header of the article, aside in the article, comments after it.
    f'<header data-label="0"><div>The Valley Paper</div><p>{_MIDDLE}</p></header><main data-label="1"><article><header><h1>Flood</h1>'
    f'</header><p>{_SHORT}</p><p>{_LONG}</p><aside data-label="0"><h3>Read more</h3><p>{_LONG}</p></aside><h2>Bridges</h2>'
    f'<ul><li>{_MIDDLE}</li><li>one bridge</li></ul><table><tr><td>Water level</td><td>4 m</td></tr></table></article></main>'
    f'<section id="comments" data-label="0"><h2>Comments</h2><p>{_LONG}</p><p>{_SHORT}</p></section>',
    # No article element: containers named by class.
    f'<div id="top-nav" data-label="0">{_MENU}</div><div class="sidebar" data-label="0"><h3>Latest</h3><p>{_MIDDLE}</p><p>{_LONG}</p>'
    f'</div><div class="post-content" data-label="1"><h2>Flood</h2><p>{_LONG}</p><p>{_SHORT}</p><div>{_MIDDLE}</div>'
    f'<blockquote>{_SHORT}</blockquote></div><div class="cookie-notice" data-label="0"><p>{_LONG}</p><button>Accept</button></div>',
    # Form, newsletter and comments inside the article element.
    f'<article data-label="1"><h1>Flood</h1><div class="share" data-label="0"><a href="#">Share</a></div><p>{_LONG}</p><p>{_SHORT}</p>'
    f'<form data-label="0"><label>Your address</label><p>{_LONG}</p><p>{_SHORT}</p><p><a href="/t">{_MIDDLE}</a></p>'
    f'</form><p>{_MIDDLE}</p><p><a href="/w">The water</a></p>'
    f'<div class="comments" data-label="0"><article class="comment"><p>{_LONG}</p><p>{_SHORT}</p>'
    '<p><a href="/u">a reader</a></p></article></div></article>',
    # A form around the whole page.
    f'<form id="page"><ul data-label="0">{_MENU}</ul><p data-label="0">{_MIDDLE}</p><main data-label="1"><h1>Flood</h1><p>{_LONG}</p>'
    f'<p>{_SHORT}</p><p><a href="/all">all about the flood</a></p></main><p data-label="0">{_MIDDLE}</p></form>',
    # An article alone, with short, linked and unmarked blocks at its ends.
    f'<article data-label="1"><h2>Flood</h2>{_SHORT}<p><a href="/w">The water</a></p><p>{_LONG}</p><div>So.</div><ul>{_MENU}</ul></article>',
    f'<main data-label="1"><div><a href="/w">{_SHORT}</a></div><div>{_SHORT}</div><p><a href="/all">{_LONG}</a></p><p>Yes.</p></main>'
    f'<ul data-label="0">{_MENU}</ul>',
    f'<article data-label="1">{_SHORT}</article><div data-label="0"><a href="/">Home</a></div><div data-label="0"><a href="/1">{_MIDDLE}</a></div>',
    f'<p data-label="0">{_LONG}</p><article data-label="1"><p>{_SHORT}</p></article><p data-label="0">{_MIDDLE}</p><div data-label="0">'
    f'{_SHORT}</div><h3 data-label="0">{_MIDDLE}</h3>',
    f'<div class="entry" data-label="1"><div>{_MIDDLE}</div><div>So.</div><div>{_SHORT}</div></div>',
    # Paragraphs alone.
    f'<h1 data-label="1">Flood</h1><p data-label="1">{_LONG}</p><p data-label="1">{_SHORT}</p><p data-label="1">{_MIDDLE}</p>'
    '<p data-label="1">So.</p>',
    f'<p data-label="1">{_SHORT}</p><p data-label="1">{_MIDDLE}</p><p data-label="1">So.</p>',
    '<p data-label="1">So.</p><p data-label="1">Yes.</p>',
    f'<p data-label="1">{_SHORT}</p><p data-label="1">{_SHORT}</p><p data-label="1">{_LONG}</p>',
    # Text alone.
    f'<body data-label="1">{_MIDDLE}</body>',
    f'<body data-label="1">{_SHORT}</body>',
    f'<body data-label="1">{_LONG}<hr>{_LONG}<hr>{_LONG}</body>',
    # Nothing is named: only words, links and neighbours tell.
    f'<table><tr><td data-label="0">{_MENU}</td><td data-label="1"><h1>Flood in the valley</h1><p>{_LONG}</p><p>{_SHORT}</p>'
    f'<p>{_LONG}</p><p>{_MIDDLE}</p><p>{_LONG}</p></td></tr></table><div data-label="0">{_SHORT}</div><div data-label="0"><a '
    f'href="/1">Terms</a> <a href="/2">Imprint</a></div>',
    f'<div data-label="0"><a href="/">Home</a></div><div data-label="0"><a href="/1">{_MIDDLE}</a></div><div data-label="0"><a '
    f'href="/2">{_LONG}</a></div><div data-label="1">{_LONG}</div><div data-label="1">{_LONG}</div><div data-label="1">{_MIDDLE}'
    f'</div><div data-label="0">Print</div><div data-label="0"><a href="/3">{_SHORT}</a></div>',
    f'<div data-label="0">Log in</div><h1 data-label="1">Flood</h1><p data-label="1">{_LONG}</p><p data-label="1">{_LONG}</p>'
    f'<p data-label="1">{_MIDDLE}</p><div data-label="0">Top</div><div data-label="0"><a href="/">Home</a></div>',
)


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    x, y = [], []
    for page in LABELLED_PAGES:
        found = blocks(page)
        keep = [b.label is not None for b in found]
        x.append(described(found)[keep])
        y += [b.label == "1" for b in found if b.label is not None]
    return np.concatenate(x), np.array(y)


# A node: (feature, bound, node if at most, node if above), or a leaf's verdict.
Tree = tuple | bool


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Tree:
    """Binary tree that splits by the drop of the Gini index until leaves are pure; ties go to the first feature."""
    if depth == 0 or y.all() or not y.any():
        return bool(2 * y.sum() > len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= bound
            loss = sum(s.sum() * (len(s) - s.sum()) / len(s) for s in (y[left], y[~left]))
            if best is None or loss < best[0] - 1e-12:
                best = (loss, f, float(bound))
    if best is None:
        return bool(2 * y.sum() > len(y))
    _, f, bound = best
    left = x[:, f] <= bound
    return f, bound, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def judged(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The tree's verdict on each row."""
    out = np.zeros(len(x), bool)
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if isinstance(node, bool):
            out[rows] = node
        elif len(rows):
            f, bound, low, high = node
            left = x[rows, f] <= bound
            todo += [(low, rows[left]), (high, rows[~left])]
    return out


def main_text(page: str | None, tree: Tree) -> str:
    """The page's main text, one line per block."""
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, judged(tree, described(found))) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row.

    Null and empty html give an empty text; repeated rows each their own result; ids and urls
    may be null and other columns are ignored. An empty table gives no rows. A page is read
    whole, however long; one batch's pages are in memory at once.
    """
    tree = grow(*labelled_table())

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h, tree) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([_sound(t) for t in found], pa.string()), pa.array(map(len, found), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
            .mapInArrow(texts, "page_id long, url string, text string, n_chars long"))


def _sound(text: str) -> str:
    """A text that UTF-8 can hold."""
    return text.encode("utf-8", "replace").decode("utf-8") if not text.isascii() else text
