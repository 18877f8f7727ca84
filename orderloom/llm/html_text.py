"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped in one pass over the page: scripts, styles and comments go, boilerplate elements
(nav, header, footer, aside and the like) leave blank lines, and each block of text becomes a line with
its length outside links. A form, or a class, id, role or label that speaks of menus, sidebars, adverts,
reader comments and so on, only proposes to drop an element. It stays if the page has its article or
main element nowhere else, or over half of the text outside links (of a list of reader comments, all);
one named by a word that text is written about as well (search, legal, related) stays, too, if it is
prose of a quarter of the rest. Names as has-sidebar, entry-header or related-work propose nothing.
The lengths are summed over windows
of ``WINDOW`` lines. Text starts where the sum surges from nothing and ends where it dives to nothing.
Of the stretches between surge and dive those are kept that hold an ``article`` or ``main`` element
or, on pages without one, those at least a quarter as heavy as the heaviest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 3

_RAW = frozenset("script style noscript template svg math iframe object canvas title textarea select".split())
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
# Attributes as they mostly are, through the end of the tag; anything else is read step by step.
_USUAL = re.compile(r"(?:\s++[^\s\"'>/=]++(?:=(?:\"[^\"]*+\"|[^\s\"'>]++))?+)*+\s*+/?>")
_SPACE, _ATTRIBUTE, _EQUALS, _UNQUOTED = (re.compile(x) for x in (r"[\s/]*+", r"=?[^\s/>=]*+", r"\s*+=\s*+", r"[^\s>]*+"))
_HINT = re.compile(r"(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Element names and words of class, id and role attributes.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOISE = frozenset("nav header footer aside menu dialog button fieldset head".split())
# Words that name boilerplate beside any other word, and those that do so only beside each other and neutral words.
_STRONG = frozenset(
    "advert adverts advertisement advertising breadcrumb breadcrumbs comments contentinfo cookie cookies disqus footer "
    "masthead nav navbar navigation newsletter outbrain pagination pager popup sidebar signup sponsored taboola".split()
)
_WEAK = frozenset(
    "ad ads banner complementary consent copyright login modal notification promo promoted promotion recommended replies "
    "respond sharing skip sponsor subscribe teaser toolbar widget".split()
)
_TOPICS = frozenset("comment form header legal menu notice related search share social".split())
_NOISE_WORDS = _STRONG | _WEAK | _TOPICS
_COMMENTS = frozenset("comment comments disqus replies respond".split())
_PARTS = frozenset("menu nav navbar navigation header masthead footer contentinfo sidebar breadcrumb breadcrumbs".split()) | _COMMENTS
_NEUTRAL = frozenset(
    "area article articles bar block body bottom box btn button buttons center column contact container content div entry foot "
    "global google group holder home icons inline inner item items left leaderboard link links list lists main media mobile module "
    "outer page panel post posts primary right row secondary section site slot small stories sub text to top unit user web "
    "website wrap wrapper".split()
)
_MODIFIERS = frozenset("has no non not with without".split())
_OF_TEXT = frozenset("article body content entry main post section text".split())  # their headers are titles
_BLOCKS = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption".split()
)
PROSE = 80  # characters outside links
_MAIN = frozenset(["article", "main"])
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Token(NamedTuple):
    """Text, or a tag: its name, whether it closes, and its attributes as written."""

    text: str
    name: str | None = None
    close: bool = False
    attributes: str = ""


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Place of the ``>`` that ends a tag whose name ends at a place; -1 if the page ends first.

    Quotes hold a value only where one begins, so that the one in ``title=it's`` is a letter. A quote
    that nothing closes is a letter, too. ``last`` has each quote's last place.
    """
    usual = _USUAL.match(page, at)
    if usual:
        return usual.end() - 1
    while True:
        at = _SPACE.match(page, at).end()
        if at >= len(page):
            return -1
        if page[at] == ">":
            return at
        at = _ATTRIBUTE.match(page, at).end()
        equals = _EQUALS.match(page, at)
        if equals:
            at = equals.end()
            quote = page[at : at + 1]
            if quote in last and at < last[quote]:
                at = page.find(quote, at + 1) + 1
            else:
                at = _UNQUOTED.match(page, at).end()


def tokens(page: str) -> Iterator[Token]:
    """Texts and tags in page order; comments, and elements whose content is no text, are left out.

    One scan from left to right, in time that grows with the page. What nothing closes goes on to the
    page's end, as browsers have it: a comment, a script, a tag.
    """
    last = {quote: page.rfind(quote) for quote in "\"'"}
    at = 0
    while at < len(page):
        low = page.find("<", at)
        if low != at:
            low = low if low >= 0 else len(page)
            yield Token(page[at:low])
            at = low
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            at = end + 3 if end >= 0 else len(page)
            continue
        close = page.startswith("/", at + 1)
        name = _NAME.match(page, at + 1 + close)
        if name is None:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                end = page.find(">", at)
                at = end + 1 if end >= 0 else len(page)
            else:
                yield Token("<")
                at += 1
            continue
        end = _tag_end(page, name.end(), last)
        if end < 0:
            return
        at, tag = end + 1, name[0].lower()
        if tag in _RAW and not close:
            found = _ENDS[tag].search(page, at)
            at = found.end() if found else len(page)
        else:
            yield Token("", tag, close, page[name.end() : end])


def _hint(name: str, attributes: str, inside: bool) -> frozenset[str]:
    """The words for which an element is proposed for removal; none for most elements."""
    if name == "form":
        return frozenset(["form", "ad"])  # not by a word that may be a topic
    if not attributes or name in ("html", "body", "article", "main") or re.fullmatch(r"h[1-6]", name):
        return frozenset()
    words: set[str] = set()
    for found in _HINT.finditer(attributes):
        value = found[2] or found[3] or found[4] or ""
        label = found[1].lower() == "aria-label"
        for one in [value] if label else value.split():
            parts = [w.lower() for w in _PART.findall(one) if not w.isdigit()]
            noise = _NOISE_WORDS.intersection(parts)
            if not noise or _MODIFIERS.intersection(parts):
                continue
            if "header" in noise and (inside or _OF_TEXT.intersection(parts)):
                noise -= {"header"}
            plain = all(w in _NOISE_WORDS or w in _NEUTRAL for w in parts)
            words |= noise if plain else (frozenset() if label else noise & _STRONG)
    return frozenset(words)


class Line:
    __slots__ = ("text", "weight", "main", "inside", "container")

    def __init__(self, text: str, weight: int, main: bool, inside: tuple[int, ...] = (), container: int = 0):
        self.text, self.weight, self.main = text, weight, main
        self.inside, self.container = inside, container  # proposals it lies in, and the element its block lies in


class Gap:
    """Place where an element begins or ends: parts text if it is not an interruption within one container."""

    __slots__ = ("proposal", "parts", "main", "container")

    def __init__(self, proposal: int, parts: bool, main: bool, container: int):
        self.proposal, self.parts, self.main, self.container = proposal, parts, main, container


def _dropped(rows: list[Line | Gap], proposals: list[tuple[frozenset[str], bool]]) -> set[int]:
    """Proposals that are followed, outer ones first."""
    size = len(proposals) + 1  # the last place is the page
    lines, weights, mains = ([0] * size for _ in range(3))  # of all lines in each proposal
    direct: list[list[Line]] = [[] for _ in range(size)]
    parents = [-1] * size
    for x in rows:
        if isinstance(x, Line):
            direct[x.inside[-1] if x.inside else -1].append(x)
            for parent, k in zip((-1, *x.inside), x.inside):
                parents[k] = parent
                lines[k] += 1
                weights[k] += x.weight
                mains[k] += x.main
    free, free_main, main = 0, 0, False  # lines in no proposal but those that are not followed

    def add(found: list[Line]) -> None:
        nonlocal free, free_main, main
        free += sum(x.weight for x in found)
        free_main += sum(x.weight for x in found if x.main)
        main = main or any(x.main for x in found)

    add(direct[-1])
    dropped: set[int] = set()
    for k, (words, in_main) in enumerate(proposals):
        if not lines[k] or parents[k] in dropped:
            dropped.add(k)
            continue
        rest = free_main if main else free
        if main and not in_main:
            holds = False
        elif words <= _COMMENTS:
            holds = not rest
        else:
            holds = weights[k] > rest or not main and mains[k] > 0
        if words <= _TOPICS - {"comment"} and (in_main or not main):
            holds = holds or weights[k] >= PROSE and 4 * weights[k] >= rest
        if holds:
            add(direct[k])
        else:
            dropped.add(k)
    return dropped


def lines(page: str) -> list[Line]:
    """Blocks of text in page order; blank lines stand for what was removed."""
    out: list[Line | Gap] = []
    open_tags: list[str] = []
    numbers: list[int] = []  # of the open elements
    noise_at = None  # depth of the boilerplate element that hides what follows
    proposals: list[tuple[frozenset[str], bool]] = []
    proposed: list[tuple[int, int]] = []  # depth and number of the open ones
    mains = links = count = 0
    parts: list[str] = []
    linked: list[str] = []

    def container() -> int:
        for name, number in zip(reversed(open_tags), reversed(numbers)):
            if name not in _INLINE and name not in _BLOCKS:
                return number
        return 0

    def end_block() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            hidden = len(" ".join(html.unescape("".join(linked)).split()))
            weight = max(0, len(text) - hidden) if hidden else len(text)
            out.append(Line(text, weight, mains > 0, tuple(k for _, k in proposed), container()))
        parts.clear()
        linked.clear()

    def blank(proposal: int = -1, parting: bool = True) -> None:
        out.append(Gap(proposal, parting, mains > 0, container()))

    def leave(depth: int) -> None:
        nonlocal noise_at, mains, links
        for name in open_tags[depth:]:
            if noise_at is None:
                mains -= name in _MAIN
                links -= name == "a"
        gone = open_tags[depth:]
        del open_tags[depth:], numbers[depth:]
        while proposed and proposed[-1][0] >= depth:
            _, k = proposed.pop()
            if noise_at is None or noise_at >= depth:
                blank(k, bool(proposals[k][0] & _PARTS))
        if noise_at is not None and len(open_tags) <= noise_at:
            noise_at = None
            if gone[0] not in _INLINE:
                blank()
        elif noise_at is None and any(name in _MAIN for name in gone) and not mains:
            out.append(Gap(-1, True, False, -1))

    for token in tokens(page):
        name = token.name
        if name is None:
            if noise_at is None:
                parts.append(token.text)
                if links:
                    linked.append(token.text)
            continue
        if noise_at is None and (name not in _INLINE or name == "br"):
            if name == "br":
                parts.append(" ")
                continue
            end_block()
        if token.close:
            if name in open_tags:
                depth = len(open_tags) - 1 - open_tags[::-1].index(name)
                if name in _INLINE and any(t not in _INLINE for t in open_tags[depth:]):
                    continue  # a stray closing tag across blocks
                leave(depth)
            continue
        if name in _VOID or token.attributes.endswith("/") and name not in ("a", "p", "div"):
            continue
        for closed in _CLOSES.get(name, ()):
            depth = len(open_tags)
            while depth and (open_tags[depth - 1] in _INLINE or open_tags[depth - 1] == closed):
                depth -= 1
                if open_tags[depth] == closed:
                    leave(depth)
                    break
        if noise_at is None:
            hint = _hint(name, token.attributes, mains > 0)
            if name in _NOISE and not (name == "header" and mains):
                noise_at = len(open_tags)
                blank()
            elif hint and name in _INLINE:  # within a line, which goes on behind it
                noise_at = len(open_tags)
                parts.append(" ")
            else:
                if hint:
                    proposed.append((len(open_tags), len(proposals)))
                    blank(len(proposals), bool(hint & _PARTS))
                    proposals.append((hint, mains > 0))
                if name in _MAIN:
                    if not mains:
                        out.append(Gap(-1, True, False, -1))
                    mains += 1
                elif name == "a":
                    links += 1
        count += 1
        open_tags.append(name)
        numbers.append(count)
    if noise_at is None:
        end_block()
    return _laid_out(out, _dropped(out, proposals) if proposals else set())


def _laid_out(rows: list[Line | Gap], dropped: set[int]) -> list[Line]:
    """The lines that stay. What went leaves a blank line where it only interrupts a text, or else a whole window."""
    out: list[Line] = []
    gaps: list[Gap] = []
    for row in rows:
        if isinstance(row, Gap):
            if row.proposal < 0 or row.proposal in dropped:
                gaps.append(row)
        elif not dropped.intersection(row.inside):
            if gaps:
                # In an article, and where the blocks before and after lie in the element that held what went, text goes on.
                before = out[-1].container if out else -1
                parts = any(g.parts and not g.main and not before == row.container == g.container for g in gaps)
                out.extend(Line("", 0, gaps[0].main) for _ in range(WINDOW if parts else 1))
                gaps = []
            out.append(row)
    return out


def stretches(rows: list[Line]) -> list[tuple[int, int]]:
    """Ranges of lines between a surge and the next dive of the windowed sums."""
    sizes = [len(r.text) for r in rows]
    total, sums = 0, []
    for k, size in enumerate(sizes):
        total += size - (sizes[k - WINDOW] if k >= WINDOW else 0)
        sums.append(total)  # text in the window that ends with line k
    found, begun = [], None
    for k, value in enumerate(sums):
        if begun is None and value:
            begun = k
        elif begun is not None and not value:
            found.append((begun, k - WINDOW + 1))
            begun = None
    if begun is not None:
        found.append((begun, len(rows)))
    return found


def main_text(page: str | None) -> str:
    """The article's blocks joined by line feeds; empty for null, empty or text-free pages."""
    if not page:
        return ""
    rows = lines(page)
    ranges = stretches(rows)
    if not ranges:
        return ""
    chosen = [r for r in ranges if any(x.main and x.text for x in rows[r[0] : r[1]])]
    if not chosen:
        weight = [sum(x.weight for x in rows[a:b]) for a, b in ranges]
        chosen = [r for r, w in zip(ranges, weight) if w and 4 * w >= max(weight)]
    return "\n".join(x.text for a, b in chosen for x in rows[a:b] if x.text)


def extract_text(pages: DataFrame, id_column: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of every page, read in whole.

    A null page counts as empty and gives empty text; null ids and urls stay null, repeated rows stay
    repeated, other columns are ignored, and an empty table gives no rows. A row needs its page and
    nothing else, so memory follows the longest page and any executor can repeat any task.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [id_column, url, "text", "n_chars"])

    schema = T.StructType(
        [
            T.StructField(id_column, pages.schema[id_column].dataType),
            T.StructField(url, T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )
    rows = pages.select(F.col(id_column), F.col(url).cast("string"), F.col(markup).cast("string"))
    return rows.mapInArrow(extract, schema)
