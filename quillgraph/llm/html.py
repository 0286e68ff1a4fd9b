"""Main text of HTML pages by two passes of block rules.

Blocks are cut at block-level tags. The first pass classifies each by link density, length and density of stop words: good,
bad, or undecided if short or of few stop words. In the second pass an undecided block inherits the label of its nearest
decided neighbours in the same region (in articles, or outside); where they differ, the nearer counts, then good. An article
is a prior only: its two ends count as good neighbours, and blocks outside have none there. Where the first pass finds nothing
good outside of articles, but undecided blocks there hold most of the text (short texts, or a language of other stop words),
those that aren't short are good, or all of them if all are short.

Elements that by their tag or by a class, id or role name are menus, adverts, comments and the like are away: their blocks are dropped and are no neighbours. Where nothing good stands outside of such elements, those that hold over half of
the page's text count as the page itself. Parsing takes time in proportion to the page, however deep it nests.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import extended, plain_names, prepare, quoted, rows_of

# Elements by what they are for.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title".split())
HIDDEN = frozenset("noscript template iframe object svg math select head button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AWAY = frozenset("nav footer aside form menu dialog".split())
REGIONS = frozenset(("article", "main"))
#: Parts of names that tell of something beside the text whatever stands with them, and those that do so by themselves or beside PLACES.
HINTS = frozenset(
    "ad ads adsbygoogle adsense adslot adunit advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr login masthead nav navbar navigation newsletter "
    "pagination popup promo promoted sidebar signup sponsor sponsored subscribe".split()
)
WEAK = frozenset("copyright header menu modal notice related reply replies search share sharing skip social toolbar topbar widget".split())
#: What may stand beside weak hints in a name.
PLACES = frozenset("area article articles bar block bottom box btn buttons container content entry first form global group icons inner item items last left link links list main media page post posts primary right secondary section site text thread top unit user wrap wrapper".split())
#: With one of these a name is about the page (has-sidebar, no-ads, comments-open) and hints at nothing.
ABOUT = frozenset("no not non has have with without open closed enabled disabled hide hidden show".split())
STOP_WORDS = frozenset(
    "the of and to in is that it for was as with be are on by this from at or an not have "
    "der die das und ist von zu den mit für im nicht ein eine sich auf dem des auch als "
    "le la les de des et en un une du que est pour dans qui par sur pas avec elle au "
    "el los las y una por con se no su como más al lo".split()
)

#: Link density above which a block is bad; lengths below which it is short and above which it can be good by itself;
#: densities of stop words below which it is undecided and above which it is good.
LINKS, SHORT, LONG, FEW, MANY = 0.5, 70, 140, 0.1, 0.2

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""", re.S)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
#: Where a hidden element nests or ends; drawings, formulas and choices also end where a paragraph or the like begins.
EDGES = {tag: re.compile(rf"<(/?)({tag})\b[^>]*>" + (r"|<()(?:p|div|h[1-6]|ul|ol|table|article|section|main|footer|nav)\b" if tag in ("svg", "math", "select") else ""), re.I) for tag in HIDDEN}
WORD = re.compile(r"[^\W\d_]+")
PART = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")


def hinted(attributes: str, inside: bool) -> bool:
    """Whether a class, id or role name tells of something beside the text; an article's own header doesn't."""
    for m in NAMED.findall(attributes):
        for name in "".join(m).lower().split():
            parts = [p for p in PART.findall(name) if len(p) > 1]
            if not ABOUT.isdisjoint(parts):
                continue
            if not HINTS.isdisjoint(parts):
                return True
            weak = [p for p in parts if p in WEAK and not (inside and p == "header")]
            if weak and all(p in WEAK or p in PLACES for p in parts):
                return True
    return False


class Page:
    """One walk over a page: its blocks as (text, characters in links, innermost away element or -1, whether in a region)."""

    def __init__(self, page: str) -> None:
        self.page, self.blocks = page, []
        self.stack: list[tuple[str, int, bool]] = []  # tag, away element or -1, whether a region
        self.open: defaultdict[str, list[int]] = defaultdict(list)  # where open elements of a kind are in the stack
        self.inner: list[int] = []  # where blocks are in the stack
        self.away: list[int] = []
        self.parents: list[int] = []  # of away elements
        self.regions = self.links = 0
        self.parts: list[str] = []
        self.of: set[int] = set()
        self.unclosed: set[str] = set()
        self.walk()
        self.end()

    def here(self) -> int:
        return self.away[-1] if self.away else -1

    def end(self) -> None:
        if self.parts:
            text = SPACES.sub(" ", "".join(self.parts)).strip()
            if text:
                # a word that is away within a block doesn't put the block away
                self.blocks.append((text, self.links, self.of.pop() if len(self.of) == 1 else self.here(), self.regions > 0))
            self.parts.clear()
        self.of.clear()
        self.links = 0

    def text(self, raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if not text.isspace():
                self.of.add(self.here())
                if self.open["a"]:
                    self.links += len(text.strip())

    def push(self, tag: str, attributes: str) -> None:
        region, inside = tag in REGIONS, self.regions > 0
        away = -1
        if tag in AWAY or (tag == "header" and not inside) or ("=" in attributes and tag not in ("html", "body") and hinted(attributes, inside)):
            away = len(self.parents)
            self.parents.append(self.here())
            self.away.append(away)
            region = False
        if tag in BLOCKS:
            self.inner.append(len(self.stack))
        self.open[tag].append(len(self.stack))
        self.stack.append((tag, away, region))
        self.regions += region

    def pop(self) -> str:
        tag, away, region = self.stack.pop()
        self.open[tag].pop()
        self.regions -= region
        if away >= 0:
            self.away.pop()
        if tag in BLOCKS:
            self.inner.pop()
        return tag

    def close(self, tag: str) -> None:
        """Close the nearest such element and what is open in it; the end of an inline element other than a link stays in its block."""
        if tag in BLOCKS or tag == "a":
            if self.open[tag]:
                while self.pop() != tag:
                    pass
            return
        if self.open[tag] and self.open[tag][-1] > (self.inner[-1] if self.inner else -1):
            while self.pop() != tag:
                pass

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.end()
            if self.inner:
                outer = self.stack[self.inner[-1]][0]
                least = self.inner[-1] + (outer != "p" and not outer == tag == "li")
                if least == self.inner[-1] or tag == "p":
                    while len(self.stack) > least:
                        self.pop()
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            self.push(tag, attributes)

    def skip(self, tag: str, at: int) -> int:
        """Where a hidden element that opens before `at` ends; an element that nothing closes hides nothing."""
        if tag in self.unclosed:
            return at
        depth, last = 1, -1
        for m in EDGES[tag].finditer(self.page, at):
            if m[2] is None:
                return m.start()
            depth += -1 if m[1] else 1
            last = m.end() if m[1] else last
            if not depth:
                return m.end()
        self.unclosed.add(tag)
        return at if last < 0 else last

    def walk(self) -> None:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            m = TAG.search(page, at)
            if not m:
                self.text(page[at:])
                return
            self.text(page[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if tag in BLOCKS:
                    self.end()
                self.close(tag)
            elif tag in RAW:
                closing = ENDS[tag].search(page, at)
                at = closing.end() if closing else n
            elif tag in HIDDEN:
                at = self.skip(tag, at)
            elif tag == "br":
                self.parts.append("\n")
            else:
                self.start(tag, m[3] or m[6] or "")


def first_pass(text: str, links: int) -> str:
    n = len(text)
    if links > LINKS * n:
        return "bad"
    if n < SHORT:
        return "?"
    words = WORD.findall(text.lower())
    density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0
    if density >= MANY or (density >= FEW and n > LONG):
        return "good"
    return "?"


def second_pass(labels: list[str], article: bool) -> list[str]:
    """The undecided labels of one region's blocks by their nearest decided neighbours; the ends of an article count as good ones."""
    decided = [(i, label) for i, label in enumerate(labels) if label != "?"]
    if article:
        decided = [(-1, "good"), *decided, (len(labels), "good")]
    out, k = list(labels), 0
    for i, label in enumerate(labels):
        if label == "?":
            while k < len(decided) and decided[k][0] < i:
                k += 1
            sides = [(i - decided[k - 1][0], decided[k - 1][1])] if k else []
            sides += [(decided[k][0] - i, decided[k][1])] if k < len(decided) else []
            out[i] = min(sides, key=lambda s: (s[0], s[1] != "good"))[1] if sides else "bad"
    return out


def dropped(page: Page, labels: list[str]) -> list[bool]:
    """Of each away element, whether its text goes: not where it holds over half of the text and nothing good stands outside."""
    n = len(page.parents)
    if any(away < 0 and (label == "good" or region and label == "?") for (_, _, away, region), label in zip(page.blocks, labels, strict=True)):
        return [True] * n
    held = [0] * n
    for text, _, away, _ in page.blocks:
        if away >= 0:
            held[away] += len(text)
    for i in range(n - 1, -1, -1):  # parents come before their children
        if page.parents[i] >= 0:
            held[page.parents[i]] += held[i]
    half = sum(len(b[0]) for b in page.blocks) / 2
    out: list[bool] = []
    for i in range(n):
        out.append(held[i] <= half or (page.parents[i] >= 0 and out[page.parents[i]]))
    return out


def settled(blocks: list[tuple[str, str, bool]]) -> list[tuple[str, str, bool]]:
    """Blocks (text, label, whether in an article) where undecided ones outside of articles are good if nothing there is and they have most of the text."""
    outside = [(len(text), label) for text, label, region in blocks if not region]
    open_ = [n for n, label in outside if label == "?"]
    if any(label == "good" for _, label in outside) or 2 * sum(open_) <= sum(len(text) for text, *_ in blocks):
        return blocks
    least = SHORT if max(open_) >= SHORT else 0
    return [(text, "good" if label == "?" and not region and len(text) >= least else label, region) for text, label, region in blocks]


def main_text(html: str | None) -> str:
    """The good blocks' texts, two newlines between; empty if there are none."""
    page = Page(html or "")
    labels = [first_pass(text, links) for text, links, *_ in page.blocks]
    gone = dropped(page, labels)
    kept = [(text, label, region) for (text, _, away, region), label in zip(page.blocks, labels, strict=True) if away < 0 or not gone[away]]
    kept = settled(kept)
    final = {article: iter(second_pass([label for _, label, region in kept if region == article], article)) for article in (True, False)}
    return "\n\n".join(text for text, _, region in kept if next(final[region]) == "good")


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep, text, n_chars (code points). Null and empty pages give an empty text; rows are independent."""
    prepare(df.sparkSession)
    out, schema = extended(df.select(*map(quoted, keep)), "text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rows_of(batches, lambda *c: [*c[:-1], [main_text(h) for h in c[-1]]], schema)

    return plain_names(df.select(*map(quoted, keep), quoted(html))).mapInArrow(run, out).withColumn("n_chars", F.length("text").cast("long"))
