"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one per block of text. What the markup itself names as menu, page header, footer, sidebar, notice,
advert, form, script, style or reader comments counts as an empty line. Each other line weighs as many characters as it has outside
links. Weights are summed over sliding windows of lines. A surge is a window of at least a share of the heaviest, and of no more than
a short paragraph. From a surge on, to both sides, the text is kept up to the dive, the first window that weighs next to nothing; lines of links
alone at the ends of what is kept go. A line that the windows leave out stays if it isn't links alone and lies in the same
element as lines that are kept: a short paragraph beside a list of links, say.

If the page names an article or a main part (an element, else one by class or id), what lies outside counts as empty lines as well, however
long. Windows, surges and dives are taken as on any page, and a check follows: a line inside the part that the dives cut off is put back, as
nothing in the part may be left out.

Character references are decoded, white space inside a block becomes one space, blocks are joined by an empty line. Null or empty
html gives an empty text; unclosed and truncated markup is read as far as it goes. Repeated rows give equal texts, empty tables none. The whole
page is read, in time proportional to its length. ``extract_column`` keeps all other columns (``text`` and ``n_chars`` replace columns of that name).
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from statloom.llm.shared import text_parts

#: Lines in a window; the share of the heaviest window that a surge needs, and its least weight; the weight of a window that a dive is below;
#: a short paragraph, which is always enough for a surge.
WINDOW, SURGE, LEAST, DIVE, PARAGRAPH = 3, 0.15, 60, 15, 200

#: Comments, declarations and tags. What starts like one is taken to the end of the page if need be, so that one pass reads it all.
_OTHER = r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?+"
_TOKEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(>?)|" + _OTHER, re.S)
#: The same from where a tag has no end: quotation marks mean nothing, and a tag may end where another begins.
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)(>?)|" + _OTHER, re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:@-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: What HTML calls these elements.
_RAW = frozenset("script style noscript template iframe svg math object canvas audio video title textarea select option datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input".split())
_AWAY = frozenset("nav footer aside form menu dialog button head".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?+", re.I) for tag in _RAW}
_MAIN = frozenset("article main".split())
#: Elements that are a block of text by themselves; a line's parent is what holds these.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th summary address".split())
_NAMED = re.compile(
    r"(?:^|[-_])(?:ads?|adverts?|advertisement|adsense|adslot|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay"
    r"|newsletter|subscribe|subscription|signup|login|side-?bar|rail|menu|nav|navbar|navigation|breadcrumbs?|foot(?:er)?|masthead|topbar|toolbar|share|sharing"
    r"|social|related|recommended|recommendations|comments?|commentlist|disqus|respond|replies|reply|pagination|pager|widgets?|skip|copyright|disclaimer|search|form|logo|brand|tagline|site-title|site-name)(?:$|[-_])"
)
_COMMENTS = re.compile(r"(?:^|[-_])(?:comments?|commentlist|disqus|respond|replies|reply)(?:$|[-_])")
_HEADER = re.compile(r"(?:^|[-_])header(?:$|[-_])")
_CONTENT = re.compile(r"^(?:main|content|main-?content|(?:article|post|entry|story)(?:-?(?:body|content|text))?)$")
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())


def _kind(tag: str, attributes: str, inside_main: bool) -> str:
    """What the markup names an element: "away", "comments", "main", "content" or nothing."""
    names, role, hidden = [], "", False
    if attributes.strip(" /"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                names += value.split()
            elif name == "role":
                role = value
            elif name == "itemprop" and value == "articlebody":
                role = "main"
            hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
    if any(_COMMENTS.search(x) for x in names):
        return "comments"
    if tag in _AWAY or hidden or role in _ROLES or any(_NAMED.search(x) for x in names):
        return "away"
    if not inside_main and (tag == "header" or any(_HEADER.search(x) for x in names)):
        return "away"
    if tag in _MAIN or role == "main":
        return "main"
    return "content" if any(_CONTENT.search(x) for x in names) else ""


def _tokens(html: str) -> list[tuple[int, int, bool, str, str]]:
    """Start, end, whether it is an end tag, name ("" for comments and declarations) and attributes of the page's markup.

    The content of scripts and the like is skipped up to their own end tag, whatever is written inside.
    """
    out: list[tuple[int, int, bool, str, str]] = []
    endless: set[str] = set()  # names of elements whose end tag doesn't come any more
    pattern, at = _TOKEN, 0
    while m := pattern.search(html, at):
        at = m.end()
        if m[2] is None:
            out.append((m.start(), at, False, "", ""))
            continue
        if not m[4] and pattern is _TOKEN:
            pattern, at = _LOOSE, m.start()
            continue
        if not m[4] and at == len(html):  # cut off
            out.append((m.start(), at, False, "", ""))
            break
        tag, end = m[2].lower(), bool(m[1])
        out.append((m.start(), at, end, tag, m[3]))
        if tag in _RAW and not end and tag not in endless:
            if close := _RAW_END[tag].search(html, at):
                at = close.end()
                out.append((close.start(), at, True, tag, ""))
            else:
                endless.add(tag)
    return out


def _closes(tokens: list[tuple[int, int, bool, str, str]]) -> list[int]:
    """For each start tag the index of the end tag of its element, -1 if it has none."""
    out, open_ = [-1] * len(tokens), defaultdict(list)
    for k, (_, _, end, tag, _) in enumerate(tokens):
        if tag and not end:
            open_[tag].append(k)
        elif tag and open_[tag]:
            out[open_[tag].pop()] = k
    return out


def lines(html: str) -> tuple[list[tuple[str, int, int]], list[int]]:
    """The page's blocks of text in order, "" for what the markup excludes; whether each is in an article or main element (2), in
    another that is named for its content (1), or in neither (0); and how many of its characters are outside links. Beside them
    the number of the element that holds each."""
    tokens = _tokens(html)
    closes = _closes(tokens)
    mains = np.concatenate([[0], np.cumsum([not end and tag in _MAIN for _, _, end, tag, _ in tokens])]) if tokens else np.zeros(1, int)
    out: list[tuple[str, int, int]] = []
    parents: list[int] = []
    holders: list[tuple[int, int]] = []  # the open elements that hold blocks: index of the token that closes each, and its number
    buffer: list[str] = []
    parts: list[tuple[int, int]] = []  # the open main parts: index of the token that closes each, and its rank
    inside = [0, 0, 0]  # how many are open, by rank
    linked, link = 0, False

    def rank() -> int:
        return 2 if inside[2] else 1 if inside[1] else 0

    def flush() -> None:
        nonlocal linked, link
        raw = "".join(buffer)
        text = " ".join(unescape(raw).split())
        buffer.clear()
        if text:
            put(text, round(len(text) * (1 - linked / len(raw))))
        linked, link = 0, False

    def put(text: str, own: int) -> None:
        out.append((text, rank(), own))
        parents.append(holders[-1][1] if holders else -1)

    def add(text: str) -> None:
        nonlocal linked
        buffer.append(text)
        linked += len(text) if link else 0

    position, k = 0, 0
    while k < len(tokens):
        start, stop, end, tag, attributes = tokens[k]
        add(html[position:start])
        position = stop
        k += 1
        if not tag:  # a comment or declaration
            continue
        if tag == "a":
            link = not end
        if tag in _INLINE and (end or not attributes):
            if tag == "br":
                add(" ")
            continue
        while parts and k - 1 >= parts[0][0]:
            flush()
            inside[heapq.heappop(parts)[1]] -= 1
        while holders and k - 1 >= holders[-1][0]:
            flush()
            holders.pop()
        if end or tag in _VOID:
            if tag == "br":
                add(" ")
            elif tag not in _INLINE:
                flush()
            continue
        raw = tag in _RAW
        kind = "away" if raw else _kind(tag, attributes, bool(inside[2]))
        close = closes[k - 1]
        if kind in ("away", "comments"):
            holds = not raw and mains[close if close >= 0 else len(tokens)] > mains[k]
            if holds and kind == "away" and tag not in _AWAY:
                kind = ""  # a frame around the article, whatever its name
            elif close >= 0:
                if tag not in _INLINE and not raw:
                    flush()
                    put("", 0)
                k, position = close + 1, tokens[close][1]
                continue
            else:  # never closed: it covers its own block
                flush()
                while k < len(tokens) and (tokens[k][3] in _INLINE or not tokens[k][3]):
                    k += 1
                position = tokens[k][0] if k < len(tokens) else len(html)
                put("", 0)
                continue
        if tag not in _INLINE:
            flush()
            if close >= 0 and tag not in _TEXT:
                holders.append((min(close, holders[-1][0]) if holders else close, k - 1))
        if kind in ("main", "content"):
            of = 2 if kind == "main" else 1
            heapq.heappush(parts, (close if close >= 0 else len(tokens), of))
            inside[of] += 1
    add(html[position:])
    flush()
    return out, parents


def surge_to_dive(weight: np.ndarray) -> np.ndarray:
    """Which lines lie between the dives on both sides of a surge of the windowed weights; lines without weight at the ends go."""
    kept = np.zeros(len(weight), bool)
    if not weight.any():
        return kept
    total = np.concatenate([np.zeros(WINDOW), np.cumsum(weight), np.full(WINDOW - 1, weight.sum())])
    windows = total[WINDOW:] - total[:-WINDOW]  # windows[i] ends at line i, and begins WINDOW - 1 before
    heaviest = windows.max()
    surge = min(heaviest, max(LEAST, min(PARAGRAPH, SURGE * heaviest)))
    over = windows >= min(surge, DIVE)
    # runs of windows over the dive, of which those with a surge are kept
    start = np.flatnonzero(over & ~np.concatenate([[False], over[:-1]]))
    stop = np.flatnonzero(over & ~np.concatenate([over[1:], [False]])) + 1
    for a, b in zip(start, stop):
        if windows[a:b].max() < surge:
            continue
        first, last = max(0, a - WINDOW + 1), min(len(weight), b)
        own = np.flatnonzero(weight[first:last] > 0)  # the ends: neither excluded nor links alone
        if len(own):
            kept[first + own[0] : first + own[-1] + 1] = True
    return kept


def main_lines(found: list[tuple[str, int, int]], parents: Sequence[int] = ()) -> list[str]:
    """The lines between surges and dives of the windowed weights, and by the check that follows those in one element, or the named part, with them."""
    named = max((rank for text, rank, _ in found if text), default=0)
    inside = np.array([bool(text) and rank == named for text, rank, _ in found], bool)
    weight = np.where(inside, [size for _, _, size in found], 0.0)
    kept = surge_to_dive(weight)
    if named:
        kept |= inside
    elif len(parents):
        held = np.asarray(parents)
        kept |= (weight > 0) & np.isin(held, held[kept & (weight > 0)])
    return [text for (text, _, _), stays, own in zip(found, kept, inside) if stays and own]


def extract(html: str | None) -> str:
    return "\n\n".join(main_lines(*lines(html))) if html else ""


def extract_column(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with the main text of column and its length in code points."""
    keep = [c for c in pages.columns if c not in ("text", "n_chars", column)]
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, column):
                texts = [extract(x) for x in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, column).mapInArrow(extracted, schema)
