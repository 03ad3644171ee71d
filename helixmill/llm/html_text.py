"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tags and words. A word scores above zero, a tag below; the weights are log odds of lying inside
against outside the article, counted on labelled pages: those that mark their article with one <article> element. One
scan finds the contiguous stretch with the largest sum, and its words are the text. Words inside elements that are no
part of any article (scripts, forms, menus, adverts, comments and so on, by element name or by class, id or role) neither score
nor are put out; their tags score as others do.

A class, id or role bars its element if all parts of one whole token are MARKS ("ad", "cookie-notice", not "has-sidebar").
Headings are never barred by it, nor, within <article> or <main>, are elements by an id of one word (an anchor) or by a
token that names SECTIONS. A marked element or a form that holds more than half of the words of the page's <article> and
<main> elements (of the page, if it has none) is a wrapper and bars nothing. An element that is not barred, with a mark among the
parts of its tokens, costs what is learnt for marks, outside <article> and <main> alone. Formulas are text."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .features import hash_unit

#: Labelled pages that the weights are counted on, at most (expected number).
LABELLED = 4_000
SLICE_BYTES = 4 << 20
_LEAST = 0.05

# HTML element names by what they mean for text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title noscript iframe template svg select object canvas audio video"
NEVER = set("head nav footer aside form button dialog menu fieldset".split())
CONTENT = {"article", "main"}
# Words in class, id and role attributes that mark what is not the article.
MARKS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar sidenav aside"
    " widget cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe subscription signup login register search share sharing social comment comments reply replies respond"
    " disqus discussion related recommended recommendations trending pagination pager toolbar complementary contentinfo skip".split()
)
PAGE_HEAD = {"header", "masthead", "topbar", "site"}
# Marks that are also names of an article's sections.
SECTIONS = {"discussion", "search", "register", "recommendations"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements barred by name that may wrap a page.
WRAPS = {"form", "fieldset"}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<math\b[^>]*>(?P<math>.*?)</math\s*>|<(?P<raw>{'|'.join(RAW.split())})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z!?][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: What of a formula is not shown: comments, annotations, tags.
_UNSHOWN = re.compile(r"<!--.*?-->|<(annotation(?:-xml)?)\b[^>]*>.*?</\1\s*>|<[^>]*>", re.S | re.I)


class Piece:
    """A tag (name, closing or not) or a text of so many words; `out` tells that it is no part of an article, `inside` that
    <article> or <main> is open, `mark` that a tag's class, id or role has a mark."""

    __slots__ = ("name", "closes", "text", "out", "inside", "mark", "words")

    def __init__(self, name: str | None, closes: bool, text: str, out: bool, inside: bool, mark: bool = False):
        self.name, self.closes, self.text, self.out, self.inside, self.mark = name, closes, text, out, inside, mark
        self.words = len(text.split())


def _barred(name: str, attrs: str, in_content: bool) -> tuple[bool, bool]:
    """Whether an element is barred, and whether it has a mark."""
    named = name in NEVER or (name == "header" and not in_content)
    if not attrs or name in ("html", "body") or name in CONTENT:
        return named, False
    bar = mark = False
    marks = MARKS if in_content else MARKS | PAGE_HEAD
    for m in _MARKED.finditer(attrs):
        anchor = in_content and m[0][:2].lower() == "id"
        for token in "".join(x or "" for x in m.groups()).lower().split():
            words = _WORD.findall(token)
            mark = mark or not MARKS.isdisjoint(words)
            if words and words != ["site"] and marks.issuperset(words) and not (in_content and SECTIONS.issuperset(words)):
                bar = bar or not (anchor and len(words) == 1)
    return named or (bar and name not in HEADINGS), mark


def pieces(page: str) -> list[Piece]:
    """Tags and texts in page order. An end tag closes the nearest open element of its name; <article> and <main> end
    whatever unclosed element would bar them. A page in which marked elements are found to be wrappers is walked again,
    with these spared."""
    out, held = _walk(page, set())
    content = sum(p.words for p in out if p.name is None and p.inside)
    half = (content or sum(p.words for p in out if p.name is None)) / 2
    wraps = {at for at, (words, within) in held.items() if words > half and (within or not content)}
    return _walk(page, wraps)[0] if wraps else out


class _Open:
    """The open elements. Every step takes constant time on average, however many elements are open."""

    def __init__(self):
        self.stack: list[tuple[str, int | None, int]] = []  # name, place of a tag that bars, words of the page before it
        self.blocks: list[int] = []  # places in the stack of what is not inline
        self.count: Counter[str] = Counter()
        self.barred = self.content = 0
        self.base = 0  # elements below this place in the stack no longer bar

    def push(self, name: str, bar: int | None, words: int) -> None:
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((name, bar, words))
        self.count[name] += 1
        self.barred += bar is not None
        self.content += name in CONTENT

    def pop(self) -> tuple[str, int | None, int]:
        top = self.stack.pop()
        if self.blocks and self.blocks[-1] == len(self.stack):
            self.blocks.pop()
        self.count[top[0]] -= 1
        self.barred -= top[1] is not None and len(self.stack) >= self.base
        self.content -= top[0] in CONTENT
        self.base = min(self.base, len(self.stack))
        return top

    def unbar(self) -> None:
        self.base, self.barred = len(self.stack), 0


def _walk(page: str, spared: set[int]) -> tuple[list[Piece], dict[int, tuple[int, bool]]]:
    """The pieces of a page if the tags at `spared` bar nothing; and for each tag that bars and may be a wrapper, the words
    that it holds and whether it is within <article> or <main>."""
    out: list[Piece] = []
    held: dict[int, tuple[int, bool]] = {}
    marked: dict[int, bool] = {}
    at = _Open()
    words = 0

    def close() -> str:
        name, bar, before = at.pop()
        if bar in marked:
            held[bar] = words - before, marked[bar]
        return name

    for m in _TOKEN.finditer(page):
        if m["math"] is not None or m["text"] is not None:
            out.append(Piece(None, False, m["text"] if m["math"] is None else _UNSHOWN.sub("", m["math"]), at.barred > 0, at.content > 0))
            words += out[-1].words
        elif (name := m["name"]) is not None:
            name = name.lower()
            if m["close"]:
                out.append(Piece(name, True, "", at.barred > 0, at.content > 0))
                if at.count[name]:
                    while close() != name:
                        pass
                continue
            if name not in INLINE and at.blocks:  # a new block ends an open paragraph, a new item an open item
                top = at.stack[at.blocks[-1]][0]
                if top == "p" or top == name == "li":
                    while close() != top:
                        pass
            if name in CONTENT:
                at.unbar()
            bar, mark = _barred(name, m["attrs"], at.content > 0)
            bar = bar and m.start() not in spared
            if name not in VOID and not m["attrs"].endswith("/"):
                if bar and (name in WRAPS or (name not in NEVER and name != "header")):
                    marked[m.start()] = at.content > 0
                at.push(name, m.start() if bar else None, words)
            out.append(Piece(name, False, "", at.barred > 0, at.content > 0, mark))
        else:
            out.append(Piece(m["raw"].lower() if m["raw"] else "other", False, "", at.barred > 0, at.content > 0))
    while at.stack:
        close()
    return out, held


def scores(seq: list[Piece], weights: dict[str, float]) -> list[float]:
    """What each piece adds to a stretch that holds it."""
    mark = weights.get("marked", -_LEAST)
    word, other = weights.get("", 1.0), weights.get("other", -_LEAST)
    out = []
    for p in seq:
        if p.name is not None:
            out.append(weights.get(p.name, other) + (mark if p.mark and not (p.out or p.inside or p.name in HEADINGS) else 0.0))
        else:
            out.append(0.0 if p.out else word * p.words)
    return out


def best_stretch(values: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous stretch with the largest sum above zero, the first of equals: one linear scan. (0, 0)
    if no sum is above zero."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, v in enumerate(values):
        total += v
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, found = total, (start, i + 1)
    return found


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The words of the best stretch: character references decoded, white space as one space, blocks parted by one space."""
    seq = pieces(page or "")
    out = []
    for p in seq[slice(*best_stretch(scores(seq, weights)))]:
        if p.name is None:
            if not p.out:
                out.append(html.unescape(p.text))
        elif p.name not in INLINE and p.name != "other":
            out.append(" ")
    return " ".join("".join(out).split())


def fit(pages: DataFrame, labelled: int = LABELLED, url: str = "url", page: str = "html") -> dict[str, float]:
    """Weights by tag name, of a word under "" and of a mark under "marked": log odds counted on pages with one <article>, smoothed by one; a word
    keeps at least a small positive weight and a tag a small negative one. Without such pages, 1 and -1."""
    marked = F.col(page).rlike("(?i)<article[\\s>]")
    chance = min(1.0, labelled / max(pages.filter(marked).count(), 1))
    sample = pages.filter(marked & (hash_unit(F.col(url), F.xxhash64(page)) < chance)).select(F.col(page).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for x in batch.column("html").to_pylist():
                seq = pieces(x or "")
                if sum(p.name == "article" and not p.closes for p in seq) != 1:
                    continue
                for p in seq:
                    if p.name is None and p.out:
                        continue
                    if p.name is None:
                        (inside if p.inside else outside)[""] += p.words
                    elif p.name != "article":
                        (inside if p.inside else outside)[p.name if p.name in known else "other"] += 1
                        if p.mark:
                            (inside if p.inside else outside)["marked"] += 1
        names = sorted({*inside, *outside})
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "inside": pa.array([inside[n] for n in names], pa.int64()), "outside": pa.array([outside[n] for n in names], pa.int64())})

    known = INLINE | VOID | set(RAW.split()) | NEVER | set("html body header section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th caption blockquote pre figure figcaption address center details summary".split())
    counts = sample.mapInArrow(run, "name string, inside long, outside long").groupBy("name").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    if not counts:
        return {"": 1.0, "other": -1.0}
    out = {r["name"]: math.log((r["i"] + 1) / (r["o"] + 1)) for r in counts}
    return {n: max(w, _LEAST) if n == "" else min(w, -_LEAST) for n, w in out.items()}


def main_text(pages: DataFrame, weights: dict[str, float] | None = None, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text and n_chars (code points) for each row; null and empty pages give empty text, as do pages without
    words. Null keys and urls and repeated rows are rows like others; other columns are ignored."""
    model = fit(pages, url=url, page=page) if weights is None else weights
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(page).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.slices(batches, "html", SLICE_BYTES):
            out = [extract(x, model) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["key", "url", "text", "n_chars"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, url string, text string, n_chars long").withColumnRenamed("key", key).withColumnRenamed("url", url)
