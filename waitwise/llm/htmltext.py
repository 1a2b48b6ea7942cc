"""HTML main text by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative; the weights are learned
from labelled pages (pages that mark their main text with an ``article`` or ``main`` element), and one
linear scan finds the contiguous region with the largest total. Elements that never are main text
(scripts, forms, menus, adverts, comment sections, ...) count as one barrier and give no text, also
inside the region. Forms and names of class and id may also mark a wrapper of the whole page: such an element is
skipped only where it does not hold the page's main part (see ``_wraps``). On a page that marks its main text, tags
inside the mark cost nothing and words outside it score negative, as they do on every labelled page; so the region
is the mark, whatever lists and tables it holds.

Edge cases: a null or empty page, or one without words, gives an empty text; unclosed tags and
comments end with the page; ties go to the earlier, then the longer region; repeated rows are extracted alike;
an empty table gives an empty result; without labelled pages the starting weights hold; extra columns
pass through.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights are learned from at most so many labelled pages (the first in the order of a hash of the id).
MAX_LABELLED = 400
#: ... and of so many bytes together.
MAX_LABELLED_BYTES = 32 << 20

# Element names of the HTML standard.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td
tfoot th thead tr ul""".split())
#: Elements and ARIA roles that hold no main text by their meaning.
ASIDE = frozenset("nav footer aside form button select menu dialog head".split())
ASIDE_ROLES = frozenset("""navigation banner contentinfo complementary search dialog alertdialog alert menu menubar
toolbar form""".split())
#: Words of class and id names that mark page furniture.
ASIDE_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion
sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup
modal overlay comment comments disqus reply replies respond share sharing social related recommended recommendations
newsletter subscribe subscription signup login footer header masthead topbar toolbar pagination pager widget widgets
skip copyright disclaimer tags""".split())
#: Words that go along with those in a name. Inside an article a name marks furniture only if all its words are of one
#: of these lists: ``related-posts`` does, ``related-work`` does not.
COMPANIONS = frozenset("""post posts article articles story stories list lists item items box boxes block blocks wrapper wrap
container area section sections inner outer left right top bottom link links button buttons bar bars panel column col
row unit slot zone group feed content form title heading icon icons count more""".split())
#: Elements of running text: inside an article their class and id names tell nothing.
TEXT_ELEMENTS = frozenset("""p span h1 h2 h3 h4 h5 h6 a em strong b i u s small mark code pre blockquote q cite li dt dd td th tr
caption figcaption sub sup time abbr label""".split())
#: Names that only mark furniture outside an article (inside, they hold its headline).
OUTSIDE_ONLY = frozenset(["header", "banner", "masthead", "tags"])

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</?([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*)(?:>|$)""", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.S)
_NAME = re.compile(r"[a-z]+", re.I)
_RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW}
#: A skipped element outside and inside the marked main text, as a tag.
BARRIER, INNER_BARRIER = "#barrier", "#inner-barrier"


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "") for m in _ATTR.finditer(text)}


def is_furniture(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Furniture whatever it holds."""
    if tag in ASIDE and tag != "form" or tag == "header" and not in_article:
        return True
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return True
    role = attrs.get("role", "").lower()
    return role in ASIDE_ROLES and role != "form" and not (in_article and role in OUTSIDE_ONLY)


def may_be_furniture(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Furniture unless it wraps the main part: forms, and elements with a listed word in class or id."""
    if tag == "form" or attrs.get("role", "").lower() == "form":
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    names = [{w.lower() for w in _NAME.findall(name)} for key in ("class", "id") for name in attrs.get(key, "").split()]
    if in_article:
        return tag not in TEXT_ELEMENTS and any(x & (ASIDE_NAMES - OUTSIDE_ONLY) and x <= ASIDE_NAMES | COMPANIONS for x in names)
    return any(x & ASIDE_NAMES for x in names)


@dataclass
class Page:
    """Scored items of a page: tag names, ``BARRIER`` or runs of words, with the block each belongs to."""
    items: list[tuple[str, str, int]] = field(default_factory=list)   # (tag or "", text, block number)
    region: tuple[int, int] | None = None                              # items of the marked main element


@dataclass
class Span:
    """Items [start, end) of an element; ``scope``: its innermost article or main element, ``parent``: its
    innermost doubtful element."""
    start: int
    depth: int
    scope: "Span | None" = None
    parent: "Span | None" = None
    end: int = 0
    doubtful: bool = False
    holds_mark: bool = False

    def holds(self, other: "Span") -> bool:
        return self.start <= other.start and other.end <= self.end


def parse(source: str) -> Page:
    page, pos, block, n = Page(), 0, 0, len(source)
    stack: list[str] = []
    opened: Counter = Counter()          # how often each tag stands on the stack
    furniture: list[int] = []            # stack depths at which skipped elements opened
    doubtful: list[Span] = []            # elements that are furniture unless they wrap the main part
    marks: list[Span] = []               # article and main elements
    still: list[Span] = []               # those of both that are open, outermost first

    def close() -> bool:
        """End what the stack no longer holds; whether a doubtful element ended."""
        ended = False
        while still and len(stack) <= still[-1].depth:
            span = still.pop()
            span.end = len(page.items)
            ended = ended or span.doubtful
            if still:
                still[-1].holds_mark |= span.holds_mark or not span.doubtful
        return ended

    while pos < n:
        m = _TOKEN.search(source, pos)
        text = source[pos:m.start() if m else n]
        if text and not furniture:
            page.items.append(("", text, block))
        if not m:
            break
        pos = max(m.end(), pos + 1)
        if not m[1]:
            continue
        tag, closing = m[1].lower(), source[m.start() + 1] == "/"
        if not closing and tag in RAW:
            end = _RAW_END[tag].search(source, pos)
            pos = end.end() if end else n
            continue
        if tag in BLOCKS:
            block += 1
        if closing:
            skipped = False
            if opened[tag]:
                while True:
                    gone = stack.pop()
                    opened[gone] -= 1
                    if gone == tag:
                        break
                if furniture and len(stack) <= furniture[-1]:
                    while furniture and len(stack) <= furniture[-1]:
                        furniture.pop()
                    skipped = True
            if not furniture and not skipped:
                page.items.append(("/" + tag, "", block))
            block += close() or skipped
            continue
        if tag == "br" or tag == "hr":
            if not furniture:
                page.items.append((tag, " ", block))
            continue
        attrs = _attributes(m[2]) if m[2] else {}
        void = tag in VOID or m[2].endswith("/")
        if tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1] == tag:
            opened[stack.pop()] -= 1      # these close their own kind
            if furniture and len(stack) <= furniture[-1]:
                furniture.pop()
            close()
        in_article = opened["article"] + opened["main"] > 0
        doubt = not furniture and may_be_furniture(tag, attrs, in_article)
        if not furniture and (is_furniture(tag, attrs, in_article) or doubt and void):
            page.items.append((INNER_BARRIER if in_article else BARRIER, "", block))
            if not void:
                furniture.append(len(stack))
        elif not furniture:
            if not void and (doubt or tag in ("article", "main")):
                over = still[-1] if still else None
                scope, parent = (None, None) if over is None else (over.scope, over) if over.doubtful else (over, over.parent)
                span = Span(len(page.items), len(stack), scope, parent, doubtful=doubt)
                still.append(span)
                (doubtful if doubt else marks).append(span)
            page.items.append((tag, "", block))
        if not void:
            stack.append(tag)
            opened[tag] += 1
    stack.clear()
    close()
    return _without_furniture(page.items, doubtful, marks)


#: A doubtful element without article or main holds the main part if it has so many times the words around it.
WRAPPER_TIMES = 2
#: An article in another doubtful element does not count beside an element of more than so many times its words.
TEASER_TIMES = 4


def _wraps(span: Span, inner: dict[int, tuple[list[Span], list[int], list[int]]], marks: list[Span], words: list[int]) -> bool:
    """Whether a doubtful element holds the main part of its scope (the article or main element it lies in, else
    the page): the only article or main element, or, where none is outside it, more words than any other
    doubtful element and ``WRAPPER_TIMES`` those outside all others. ``inner``: doubtful elements by parent, their
    starts and running sums of words; ``words``: sums up to an item."""
    start, end = (span.scope.start, span.scope.end) if span.scope else (0, len(words) - 1)
    own = words[span.end] - words[span.start]
    others, apart, at = words[end] - words[start] - own, [], span
    while True:                           # the largest doubtful elements apart: beside it, and beside what holds it
        spans, starts, sums = inner[id(at.parent)]
        lo, hi = bisect_left(starts, start), bisect_left(starts, end)
        others -= sums[hi] - sums[lo] - (words[at.end] - words[at.start])
        apart.append((spans, lo, hi, at))
        if at.parent is None or at.parent.start < start:
            break
        at = at.parent
    if not span.holds_mark and own < WRAPPER_TIMES * others:
        return False
    around = any(start <= x.start and x.end <= end and not x.holds(span) and not span.holds(x)
                 and (TEASER_TIMES * (words[x.end] - words[x.start]) >= own or x.parent is None or x.parent.holds(span)) for x in marks)
    if around != span.holds_mark:
        return span.holds_mark
    return own > 0 and own >= WRAPPER_TIMES * others and all(
        (own, -span.start) > (words[x.end] - words[x.start], -x.start) for spans, lo, hi, at in apart for x in spans[lo:hi] if x is not at)


def _without_furniture(items: list[tuple[str, str, int]], doubtful: list[Span], marks: list[Span]) -> Page:
    """The page with each doubtful element that wraps no main part as one barrier."""
    words = [0]
    for _, text, _ in items:
        words.append(words[-1] + (len(text.split()) if text else 0))
    inner: dict[int, tuple[list[Span], list[int], list[int]]] = {}
    for x in doubtful:
        spans, starts, sums = inner.setdefault(id(x.parent), ([], [], [0]))
        spans.append(x)
        starts.append(x.start)
        sums.append(sums[-1] + words[x.end] - words[x.start])
    skip: list[Span] = []
    for x in doubtful:                    # outer elements first
        if not (skip and skip[-1].holds(x)) and not _wraps(x, inner, marks, words):
            skip.append(x)
    page = Page()
    region = _main_mark([x for x in marks if not _inside(x, skip)], words)
    at, moved = 0, {}
    for x in [*skip, Span(len(items), 0, end=len(items))]:
        for i in range(at, x.start):
            moved[i] = len(page.items)
            page.items.append(items[i])
        if x.start < len(items):
            page.items.append((INNER_BARRIER if x.scope else BARRIER, "", items[x.start][2]))
        at = x.end
    if region:
        last = max(i for i in moved if i < region.end)
        end = moved[last] + 1
        while end < len(page.items) and last + 1 < region.end and page.items[end][0] in (BARRIER, INNER_BARRIER):
            end, last = end + 1, region.end
        page.region = (moved[region.start], end)
    return page


def _inside(mark: Span, skip: list[Span]) -> bool:
    """Whether one of ``skip`` (apart from each other, in order) holds the mark."""
    at = bisect_right([x.start for x in skip], mark.start) - 1 if skip else -1
    return at >= 0 and skip[at].holds(mark)


#: An article inside another marked element is the main text if it has this share of its words.
INNER_SHARE = 0.5


def _main_mark(marks: list[Span], words: list[int]) -> Span | None:
    """Of the marked elements that lie in no other one, that of the most words; then, as long as there is one, the marked
    element inside it that has ``INNER_SHARE`` of its words."""
    def size(x: Span) -> int:
        return words[x.end] - words[x.start]
    best, until = None, 0
    for x in marks:                       # in the order of their starts
        if x.start >= until:
            until = x.end
            if best is None or size(x) > size(best):
                best = x
    if best is not None:
        total = size(best)
        for x in marks:
            if best.start < x.start and x.end <= best.end and size(x) >= INNER_SHARE * total and size(x) > 0:
                best, total = x, size(x)
    return best


#: Cost, in words, of a tag that was seen outside the marked text only.
OUTSIDE_COST = 8.0


@dataclass
class Weights:
    """Score of a word (positive) and of each tag (negative)."""
    word: float = 1.0
    tags: dict[str, float] = field(default_factory=dict)
    block: float = -1.0      # a block tag, or another tag, that no labelled page showed
    inline: float = -0.2

    def score(self, tag: str, text: str) -> float:
        if not tag:
            return self.word * len(text.split())
        return self.tags.get(tag, self.block if tag.lstrip("/") in BLOCKS else self.inline)


#: Weights before any labelled page is seen; borders of the element that marks main text always cost this.
MARKS = {t: -30.0 for t in ("article", "/article", "main", "/main")}
START = Weights(1.0, MARKS | {BARRIER: -3.0, INNER_BARRIER: -0.2, "p": -0.1, "/p": -0.1, "br": -0.1})


def learn(pages: list[str]) -> Weights:
    """Weights from pages that mark their main text: a word scores 1, a tag costs up to ``OUTSIDE_COST``
    words by the share of its occurrences that lie outside the marked text."""
    inside, outside = Counter(), Counter()
    for source in pages:
        page = parse(source)
        if page.region is None:
            continue
        start, end = page.region
        for i, (tag, _, _) in enumerate(page.items):
            if tag:
                (inside if start < i < end - 1 else outside)[tag] += 1
    tags = dict(START.tags)
    for tag in set(inside) | set(outside):
        share = (outside[tag] + 0.5) / (inside[tag] + outside[tag] + 1)
        if tag not in MARKS and tag != INNER_BARRIER:
            tags[tag] = min(-0.02, -OUTSIDE_COST * share)
    return Weights(1.0, tags, START.block, START.inline)


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous items with the largest positive total; (0, 0) if there is none."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


def item_scores(page: Page, weights: Weights) -> list[float]:
    """Scores of the items; on a page that marks its main text, tags inside cost nothing and words outside cost."""
    scores = [weights.score(t, x) for t, x, _ in page.items]
    if page.region is None or not any(s > 0 for s in scores[slice(*page.region)]):
        return scores
    lo, hi = page.region
    return [max(s, 0.0) if lo <= i < hi else -abs(s) for i, s in enumerate(scores)]


def main_text(source: str | None, weights: Weights) -> str:
    """Main text of a page: blocks in page order joined by a newline, white space in a block as one space."""
    if not source:
        return ""
    page = parse(source)
    start, end = best_region(item_scores(page, weights))
    blocks: list[str] = []
    last = None
    for tag, text, block in page.items[start:end]:
        if not text:
            continue
        if block != last:
            blocks.append("")
            last = block
        blocks[-1] += text
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def labelled_pages(pages: DataFrame, max_rows: int = MAX_LABELLED) -> list[str]:
    """Pages that mark their main text: the first ``max_rows`` in the order of a hash of the id."""
    marked = pages.filter(F.col("html").rlike("(?i)<(article|main)[\\s>]") & F.col("page_id").isNotNull())
    # ids first, so that only the chosen pages' texts travel
    pick = marked.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(max_rows)
    rows = (pages.select("page_id", "html").join(pick, "page_id").orderBy(F.xxhash64("page_id"), "page_id", "html").limit(max_rows)
            .withColumn("before", F.sum(F.octet_length("html")).over(Window.orderBy(F.xxhash64("page_id"), "page_id", "html")))
            .filter(F.col("before") <= MAX_LABELLED_BYTES).collect())       # rows and bytes are bounded before they travel
    return [r["html"] for r in rows if r["html"]]


def text_column(source: Column, weights: Weights) -> Column:
    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            yield pa.array([main_text(x.as_py(), weights) for x in col], pa.string())
    return extract(source)


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``pages`` without ``html``, plus text (main text) and n_chars (its code points)."""
    if weights is None:
        weights = learn(labelled_pages(pages))
    return (pages.drop("text", "n_chars").withColumn("text", text_column(F.col("html"), weights)).drop("html")
            .withColumn("n_chars", F.char_length("text").cast("long")))
