"""Operator 10: HTML extraction by two-pass block rules.

The page is cut into blocks at block-level tags. Pass one decides each block by where it stands (navigation, forms,
scripts, comments and the like never count), then by link density, length and stop-word density. Pass two lets short,
undecided blocks inherit from the nearest decided neighbours. Standing in an article is one more signal in both: it
leaves a block undecided that only its few stop words are against, and the article's ends are good neighbours.

Tags say for certain that something surrounds the article; names in class and id are only a hint. In an article, names that
also stand for parts of it (its header, a search or form wrapper) are not listened to, and an element so named that
holds nearly all running text of a page without other marked text is the page's body.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import configure

# Tags and words of the HTML rules.
RAW = "script style noscript template textarea iframe svg annotation select option".split()
BLOCKS = set("address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set("nav footer aside form script style noscript template head title button dialog menu label".split())
CONTENT = set("article main".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
#: Words in class, id or role that mark what surrounds an article, in it as well as around it.
OUTSIDE = set("ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies copyright discussion disqus footer login modal nav navbar navigation newsletter notification pager pagination popup promo promoted promotion related recommended recommendations reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe".split())
#: Those that only count around an article: in it they also name parts of it.
AROUND = set("banner dialog form header masthead menu notice privacy search tags toolbar widget".split())
#: Words before and after one of those that make a name a state or a layout of a wrapper, not a part.
STATE_FIRST, STATE_LAST = set("with has no without is js not".split()), set("open closed enabled disabled results result visible layout active fixed".split())
COMMENTS = set("comment comments commentlist discussion disqus reply replies respond".split())
#: Frequent words of the languages of the corpus.
STOP_WORDS = set(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will more no if out so "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou mais comme on tout nous sa "
    "el que y los del se las por con no para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde".split()
)
MAX_LINK_DENSITY, SHORT_CHARS, LONG_CHARS, STOP_LOW, STOP_HIGH = 0.34, 70, 200, 0.10, 0.22
#: Share of a page's running text that makes an element its body, whatever the element is named.
BODY_SHARE = 0.8

#: Code: without an end it is code to the end of the page. Other raw elements without an end are their tag alone.
CODE = ("script", "style")
#: Share of stop words in all running text of a page below which none of the lists is of its language, and running text that tells.
STOP_NONE, TELLING_CHARS = 0.05, 200
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.DOTALL | re.IGNORECASE)
#: Scripts without spaces: a character of theirs says as much as three letters.
DENSE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
WORDS = re.compile(r"[^\W_]+")


@dataclass
class Block:
    """One run of text between block-level tags."""

    text: str
    links: int = 0
    anchors: int = 0
    outside: bool = False
    named: int = 0  # the outermost element around it, by number, that only its name calls outside
    tag: str = ""
    inside: bool = False
    heading: bool = False
    verdict: str = ""

    @cached_property
    def stops(self) -> float:
        return stop_share(self.text)


@dataclass
class _Open:
    tag: str
    outside: bool = False
    inside: bool = False
    heading: bool = False
    link: bool = False
    named: int = 0


_TOP = _Open("")


@dataclass
class _Reader:
    stack: list[_Open] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    anchors: int = 0
    names: int = 0
    blocks: list[Block] = field(default_factory=list)

    def text(self, s: str) -> None:
        if s:
            self.parts.append(s)
            if self.stack and self.stack[-1].link:
                self.linked.append(s)

    def flush(self) -> None:
        t = tidy("".join(self.parts))
        if t:
            top = self.stack[-1] if self.stack else _TOP
            block = next((x.tag for x in reversed(self.stack) if x.tag in BLOCKS), "")
            self.blocks.append(Block(t, len(tidy("".join(self.linked))), self.anchors, top.outside, top.named, block, top.inside, top.heading))
        self.parts, self.linked, self.anchors = [], [], 0

    def open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
            while self.stack and tag in CLOSED_BY.get(self.stack[-1].tag, ()):
                self.stack.pop()
            self._close_implied(tag)
        elif tag == "br":
            self.text(" ")
        if tag in VOID:
            return
        up = self.stack[-1] if self.stack else _TOP
        inside = up.inside or tag in CONTENT
        heading = tag in HEADINGS or up.heading
        outside = up.outside or tag in NEVER or (tag == "header" and not up.inside)
        named = up.named
        if tag not in ("html", "body", "article", "main") and attributes and not outside and named >= 0:
            kind = marked_outside(attributes, up.inside)
            outside = kind == "hidden"
            if kind in ("comments", "part") and (not named or kind == "comments"):
                # Negative: nothing takes a comment section back.
                self.names += 1
                named = -self.names if kind == "comments" else self.names
        self.anchors += tag == "a"
        self.stack.append(_Open(tag, outside, inside, heading, up.link or tag == "a", named))

    def _close_implied(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            t = self.stack[k].tag
            if tag in CLOSED_BY.get(t, ()):
                del self.stack[k:]
                return
            if t in BLOCKS:
                return

    def close(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return
            if tag not in BLOCKS and self.stack[k].tag in BLOCKS:
                return


def marked_outside(attributes: str, inside: bool) -> str:
    """What class, id, role and style say of an element: "hidden", "comments", "part" (of what surrounds an article) or ""."""
    found = ""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "hidden"
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = [x for x in re.split(r"[^a-z]+", word) if x]
                if not parts or len(parts) > 1 and (parts[0] in STATE_FIRST or parts[-1] in STATE_LAST):
                    continue
                ends = {parts[0], parts[-1]}
                if ends & OUTSIDE or not inside and ends & AROUND:
                    found = "comments" if ends & COMMENTS or found == "comments" else "part"
    return found


def tidy(s: str) -> str:
    """Character references decoded, white space as single spaces, trimmed."""
    return " ".join(html.unescape(s).split()) if s else ""


class _Raw:
    """Where raw elements of one page end. Ends are looked for once a kind of element, however many there are."""

    def __init__(self, page: str):
        self.page, self.ends = page, {}

    def after(self, tag: str, start: int) -> int:
        """What follows the element that opens with a tag up to ``start``."""
        if tag == "option":  # its end may be left out; its text has no markup
            k = self.page.find("<", start)
            return len(self.page) if k < 0 else k
        if tag not in self.ends:
            self.ends[tag] = self._find(tag)
        if tag in CODE:
            at = self.ends[tag]
            k = bisect_right(at, (start, 0))
            return at[k][1] if k < len(at) else len(self.page)
        return self.ends[tag].get(start, start)

    def _find(self, tag: str):
        if tag in CODE:
            return [m.span() for m in re.finditer(rf"</{tag}\s*>", self.page, re.IGNORECASE)]
        open_at, out = [], {}
        for m in re.finditer(rf"<(/?){tag}\b[^>]*>", self.page, re.IGNORECASE):
            if m[1]:
                if open_at:
                    out[open_at.pop()] = m.end()
            elif m[0][-2] != "/":
                open_at.append(m.end())
        return out


def cut_blocks(page: str) -> list[Block]:
    """The blocks of a page in order."""
    r, at, raw = _Reader(), 0, _Raw(page)
    while m := MARKUP.search(page, at):
        r.text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in RAW:
            if not m[1] and m[0][-2:] != "/>":
                at = raw.after(tag, at)
            r.text(" ")
        else:
            r.close(tag) if m[1] else r.open(tag, m[3])
    r.text(page[at:])
    r.flush()
    return r.blocks


def in_article(b: Block) -> bool:
    return b.inside and not b.outside


def stop_share(text: str) -> float:
    words = WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def weight(text: str) -> int:
    """Characters, those of scripts without spaces as three."""
    return len(text) if text.isascii() else len(text) + 2 * len(DENSE.findall(text))


def of_no_list(blocks: list[Block]) -> bool:
    """Whether the page's running text is in a language that the stop words don't have."""
    running = [b for b in blocks if not b.outside and weight(b.text) >= SHORT_CHARS and b.links / len(b.text) <= MAX_LINK_DENSITY]
    size = sum(len(b.text) for b in running)
    return sum(map(weight, (b.text for b in running))) >= TELLING_CHARS and sum(b.stops * len(b.text) for b in running) < STOP_NONE * size


def settle_names(blocks: list[Block]) -> None:
    """Blocks in elements that only a name calls outside are outside, unless that element holds nearly all running text and nothing of it stands in an article or main element elsewhere."""
    if not any(b.named for b in blocks):
        return
    body: set[int] = set()
    if not any(b.inside and not b.named for b in blocks if not b.outside):
        running = [b for b in blocks if not b.outside and b.named >= 0 and len(b.text) >= SHORT_CHARS and b.links / len(b.text) <= MAX_LINK_DENSITY and b.stops >= STOP_LOW]
        total = sum(len(b.text) for b in running)
        body = {k for k in {b.named for b in running} - {0} if sum(len(b.text) for b in running if b.named == k) > BODY_SHARE * total}
    for b in blocks:
        b.outside |= b.named != 0 and b.named not in body


def classify(blocks: list[Block]) -> None:
    """Pass one: decide by place, link density, length and stop-word density; short or middling blocks stay undecided.

    In an article, so do those that only their few stop words are against, linked headings, and paragraphs that are one link.
    On a page whose language has no stop words here, long blocks are good and middling ones undecided.
    """
    settle_names(blocks)
    foreign = of_no_list(blocks)
    for b in blocks:
        if b.outside or b.links / len(b.text) > MAX_LINK_DENSITY and not (b.inside and (b.heading or b.tag == "p" and b.anchors <= 1)):
            b.verdict = "bad"
        elif weight(b.text) < SHORT_CHARS or b.heading:
            b.verdict = "short"
        elif foreign:
            b.verdict = "good" if weight(b.text) >= LONG_CHARS else "short"
        else:
            stops = b.stops
            if stops >= STOP_HIGH or stops >= STOP_LOW and len(b.text) > LONG_CHARS:
                b.verdict = "good"
            else:
                b.verdict = "short" if stops >= STOP_LOW or len(b.text) >= LONG_CHARS or b.inside else "bad"


def _neighbours(blocks: list[Block]) -> list[tuple[Block, list[tuple[int, str]], list[tuple[int, str]]]]:
    """Each undecided block with (distance, verdict) of the decided one before and of the one after, as far as there is one."""
    decided = [i for i, b in enumerate(blocks) if b.verdict != "short"]
    out, k = [], 0
    for i, b in enumerate(blocks):
        if b.verdict != "short":
            continue
        while k < len(decided) and decided[k] < i:
            k += 1
        out.append((b, [(i - j, blocks[j].verdict) for j in decided[max(0, k - 1) : k]], [(j - i, blocks[j].verdict) for j in decided[k : k + 1]]))
    return out


def inherit(blocks: list[Block]) -> None:
    """Pass two: an undecided block follows its nearest decided neighbours; between unlike ones, a heading follows the next, other blocks the nearer, good winning ties.

    Blocks in and around articles follow those of their own side. In an article one good neighbour is enough, except for
    headings before bad blocks, and its ends count as good ones, unless all of it is undecided and less than the text
    that is good around it (a teaser).
    """
    article, around = [b for b in blocks if in_article(b)], [b for b in blocks if not in_article(b)]
    for b, before, after in _neighbours(around):
        near = after if b.heading and after else before + after
        b.verdict = "good+" if near and min(near, key=lambda x: (x[0], x[1] != "good"))[1] == "good" else "bad+"
    found = sum(len(b.text) for b in around if b.verdict.startswith("good"))
    teaser = all(b.verdict != "good" for b in article) and sum(len(b.text) for b in article if b.verdict == "short") < found
    end = [(1, "bad" if teaser else "good")]
    for b, before, after in _neighbours(article):
        near = after if b.heading and before and after else (before or end) + (after or end)
        b.verdict = "good+" if any(v == "good" for _, v in near) else "bad+"


def extract(page: str | None) -> str:
    """The main text of a page, its blocks joined by two newlines; empty for null and for pages without any."""
    if not page:
        return ""
    blocks = cut_blocks(page)
    classify(blocks)
    if not any(b.verdict == "good" for b in blocks):
        # No text has enough stop words: length and link density alone tell.
        for b in blocks:
            if not b.outside and not b.heading and weight(b.text) >= SHORT_CHARS and b.links / len(b.text) <= MAX_LINK_DENSITY:
                b.verdict = "good"
    inherit(blocks)
    return "\n\n".join(b.text for b in blocks if b.verdict.startswith("good"))


def extract_pages(pages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, text, n_chars (code points): one row per page, in one scan.

    Null and empty html give an empty text; repeated rows stay and are read alike; an empty table gives no rows. Pages of
    any length are read whole, one at a time in their task. Other columns are not read, so their names can't clash.
    """
    configure(pages.sparkSession)
    at = pages.select(*keep, F.col("html").cast("string").alias("_html"))
    names = [f.name for f in at.schema.fields[:-1]]

    def run(batches):
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return at.mapInArrow(run, at.select(*names).schema.add("text", "string").add("n_chars", "long"))
