"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read once into flat blocks.  Each block has its word count, its link density, the same of its
neighbours, whether it is a heading or a list item, and the zone it stands in; a decision tree, grown here from a
small labelled table of many layouts, keeps or drops it.  Zones come from the nearest container whose tag, or a
whole token of whose class, id or role, says what it holds (article, nav, site-footer, comments); body and html
give none, and a token with any unknown part (has-sidebar, side-by-side) gives none.  Without a zone the counts
decide.  Words of class, id and role are hints that the page as a whole may overrule, but for those of readers'
words: containers whose hint names no article, but which hold the page's only first-level heading and prose, and,
where nothing but headings or less than a tenth as much was kept, the containers of the hint with most prose (over
20 words) among what was lost, count as the article.  A page that still loses everything is judged by counts alone.

Defined results: null and empty pages have the empty text.  Markup that never ends is read to the page's end;
end tags without a start are passed over.  Repeated rows each get a row.  Nothing kept is shortened.  A kept column
must not be called text (ValueError).
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.session import bounded_batches, column, free_names, lean

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?][^>]*>?", re.S)
_HINT = re.compile(r"(?<![\w:.-])(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")

#: Elements whose text is never shown, or is no prose.
HIDDEN = frozenset("script style noscript template iframe object svg math head textarea select option button canvas audio video datalist".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements, and words of class, id or role, that name a zone.
ARTICLE, MENU, ASIDE, FORM = 1, 2, 3, 4
ZONE_OF_TAG = {"article": ARTICLE, "main": ARTICLE, "nav": MENU, "footer": MENU, "header": MENU, "menu": MENU, "aside": ASIDE, "form": FORM, "dialog": ASIDE, "fieldset": FORM}
ZONE_OF_WORD = {
    **dict.fromkeys("article post story entry main body content".split(), ARTICLE),
    **dict.fromkeys("nav navigation navbar menu menubar breadcrumb breadcrumbs footer header masthead topbar toolbar pagination pager banner contentinfo".split(), MENU),
    **dict.fromkeys("ad ads advert advertisement sponsor sponsored promo promotion sidebar comment comments reply replies respond disqus cookie cookies consent notice alert popup modal newsletter subscribe signup login share sharing social related recommended widget widgets complementary search legal copyright".split(), ASIDE),
}
#: Parts of tokens that say nothing of what a container holds.
NEUTRAL = frozenset("site page global web blog single left right top bottom upper lower inner outer primary secondary section sections wrapper wrap container box block area region group list item items text links link panel bar col column row the of and 1 2 3 4 5".split())
#: Parts that mark what readers wrote, even in an article element.
READERS = frozenset("comment comments reply replies respond disqus".split())
#: A paragraph of so many words that ends like a sentence counts as one, however much of it is links.
SENTENCE, ENDS = 12, ".!?…。！？»”\"'"
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Block:
    text: str
    words: int
    density: float
    zone: int
    heading: bool
    item: bool
    top: bool = False  # a first-level heading
    hint: str = ""  # of class, id and role, if they gave the zone and name no readers' words


def _hints(attributes: str) -> list[set[str]]:
    """Tokens of class, id and role, in parts, of which all are known."""
    found = (set(filter(None, _SPLIT.split(t))) for v in _HINT.findall(attributes) for t in v.strip("\"'").lower().split())
    return [parts for parts in found if parts and all(p in ZONE_OF_WORD or p in NEUTRAL for p in parts)]


def _zone(name: str, attributes: str, inside: int, hints: bool) -> int:
    """The zone that an element begins, 0 if none."""
    zone = ZONE_OF_TAG.get(name, 0)
    if not hints:
        return 0 if zone == FORM else zone
    if name == "header" and inside == ARTICLE or name == "article" and inside in (MENU, ASIDE):
        zone = 0
    if attributes and name not in INLINE and name not in ("body", "html"):
        for parts in _hints(attributes):
            named = max((ZONE_OF_WORD[p] for p in parts if p in ZONE_OF_WORD), default=0)
            if named == MENU and "header" in parts and inside == ARTICLE:
                continue
            if named == ASIDE and parts & READERS:
                return ASIDE
            if named and not (zone == ARTICLE and name in ("article", "main")):
                zone = max(zone, named) if zone in (MENU, ASIDE) else named
    return zone


def blocks(page: str, hints: bool = True) -> list[Block]:
    """Flat blocks of a page in order; without ``hints``, zones come from tags alone, and not from forms."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, bool, str]] = []  # containers: name, zone, hidden, hint of the zone
    zone, hidden, link, heading, item, top, hint = 0, False, 0, False, False, False, ""
    lower: str | None = None
    at, n, paragraph = 0, len(page), False

    def close() -> None:
        nonlocal parts, linked
        if parts:
            ws = entities.unescape("".join(parts)).split()
            if ws:
                in_links = len(entities.unescape(" ".join(linked)).split())
                if paragraph and len(ws) >= SENTENCE and ws[-1][-1] in ENDS:
                    in_links = 0  # a sentence is prose, also where all of it is a link
                out.append(Block(" ".join(ws), len(ws), min(1.0, in_links / len(ws)), zone, heading, item, top, hint))
        parts, linked = [], []

    while at < n:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text and not hidden:
            parts.append(text)
            if link:
                linked.append(text)
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name, ending, attributes = name.lower(), bool(m[1]), m[3] or ""
        if name == "br" or name == "wbr":
            if not hidden:
                parts.append(" ")
            continue
        if name == "a":
            link = 0 if ending else 1
            continue
        if name in INLINE:
            continue
        close()
        paragraph = name == "p" and not ending
        if name in _HEADINGS:
            heading, top = not ending, not ending and name == "h1"
        elif name in ("li", "dt", "dd"):
            item = not ending
        elif name == "p":
            heading = item = top = False
        if name in ("p", "li", "td", "th", "div", "article", "section"):
            link = 0
        if ending:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    zone, hidden, hint = stack[-1][1:] if stack else (0, False, "")
                    break
            continue
        if name in _RAW and not attributes.endswith("/"):
            lower = lower or page.lower()
            stop = lower.find(f"</{name}", at)
            if name == "title" or name in HIDDEN or hidden:
                at = n if stop < 0 else stop
        if name in HIDDEN or name in ("div", "section", "ul", "ol", "table", "td", "dl", "details", "body", "center") or name in ZONE_OF_TAG:
            if name == "body":
                stack.clear()
                zone, hidden, hint = 0, False, ""
            own = _zone(name, attributes, zone, hints)
            if own:
                tokens = [parts for parts in _hints(attributes) if hints]
                told = own != ZONE_OF_TAG.get(name) and own != ARTICLE and not any(parts & READERS for parts in tokens)
                hint = " ".join(sorted(" ".join(sorted(parts)) for parts in tokens)) if told and not (own == zone and not hint) else ""
            zone = own or zone
            hidden = hidden or name in HIDDEN
            stack.append((name, zone, hidden, hint))
    close()
    return out


#: The labelled table: words, link density, words and density of the block before and after, zone (0 none, 1
#: article, 2 menu, 3 aside), heading, list item; and whether the block belongs to the main text.
TABLE = (
    (8, 0.0, 0, 0.0, 60, 0.0, 1, 1, 0, 1), (6, 0.0, 5, 1.0, 80, 0.05, 1, 1, 0, 1), (3, 0.0, 40, 0.0, 55, 0.0, 1, 1, 0, 1),
    (2, 0.0, 60, 0.0, 90, 0.0, 1, 0, 0, 1), (1, 0.0, 70, 0.0, 2, 1.0, 1, 0, 0, 1), (60, 0.0, 8, 0.0, 75, 0.02, 1, 0, 0, 1),
    (120, 0.03, 60, 0.0, 12, 0.0, 1, 0, 0, 1), (12, 0.0, 12, 0.0, 12, 0.0, 1, 0, 1, 1), (25, 0.3, 60, 0.0, 40, 0.0, 1, 0, 0, 1),
    (5, 0.0, 5, 0.0, 5, 0.0, 1, 0, 0, 1), (200, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1), (15, 0.5, 30, 0.0, 25, 0.0, 1, 0, 1, 1),
    (4, 1.0, 40, 0.0, 4, 1.0, 1, 0, 1, 0), (3, 1.0, 3, 1.0, 3, 1.0, 1, 0, 1, 0), (2, 1.0, 60, 0.0, 0, 0.0, 1, 0, 0, 0), (5, 1.0, 5, 1.0, 60, 0.0, 1, 0, 0, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 2, 0, 1, 0), (2, 1.0, 1, 1.0, 3, 1.0, 2, 0, 1, 0), (1, 1.0, 2, 1.0, 20, 0.0, 2, 0, 1, 0),
    (15, 0.1, 60, 0.0, 0, 0.0, 2, 0, 0, 0), (9, 0.0, 90, 0.0, 0, 0.0, 2, 0, 0, 0), (40, 0.2, 3, 1.0, 0, 0.0, 2, 0, 0, 0),
    (20, 0.0, 30, 0.0, 0, 0.0, 2, 0, 0, 0), (14, 0.0, 200, 0.0, 0, 0.0, 2, 0, 0, 0), (35, 0.0, 60, 0.0, 12, 0.0, 2, 0, 0, 0), (100, 0.0, 0, 0.0, 80, 0.0, 2, 0, 0, 0),
    (50, 0.05, 10, 0.0, 3, 1.0, 2, 0, 0, 0), (25, 0.0, 1, 1.0, 90, 0.0, 2, 0, 0, 0), (18, 0.1, 45, 0.0, 20, 0.0, 2, 0, 0, 0), (3, 0.0, 12, 0.0, 40, 0.0, 2, 1, 0, 0),
    (20, 0.0, 30, 0.0, 0, 0.0, 3, 0, 0, 0), (14, 0.0, 200, 0.0, 0, 0.0, 3, 0, 0, 0), (35, 0.0, 60, 0.0, 12, 0.0, 3, 0, 0, 0), (100, 0.0, 0, 0.0, 80, 0.0, 3, 0, 0, 0),
    (50, 0.05, 10, 0.0, 3, 1.0, 3, 0, 0, 0), (25, 0.0, 1, 1.0, 90, 0.0, 3, 0, 0, 0), (18, 0.1, 45, 0.0, 20, 0.0, 3, 0, 0, 0), (3, 0.0, 12, 0.0, 40, 0.0, 3, 1, 0, 0),
    (20, 0.0, 30, 0.0, 0, 0.0, 1, 0, 0, 1), (14, 0.0, 200, 0.0, 0, 0.0, 1, 0, 0, 1), (35, 0.0, 60, 0.0, 12, 0.0, 1, 0, 0, 1), (100, 0.0, 0, 0.0, 80, 0.0, 1, 0, 0, 1),
    (50, 0.05, 10, 0.0, 3, 1.0, 1, 0, 0, 1), (25, 0.0, 1, 1.0, 90, 0.0, 1, 0, 0, 1), (18, 0.1, 45, 0.0, 20, 0.0, 1, 0, 0, 1), (3, 0.0, 12, 0.0, 40, 0.0, 1, 1, 0, 1),
    (9, 0.0, 1, 1.0, 2, 1.0, 1, 1, 0, 1), (1, 0.0, 1, 0.0, 1, 0.0, 1, 0, 0, 1),
    (6, 0.0, 0, 0.0, 4, 1.0, 2, 1, 0, 0), (80, 0.0, 60, 0.0, 10, 0.0, 2, 0, 0, 0), (3, 0.3, 80, 0.0, 5, 0.8, 2, 0, 0, 0),
    (10, 0.0, 2, 1.0, 8, 0.0, 3, 0, 0, 0), (30, 0.0, 1, 1.0, 60, 0.0, 3, 0, 0, 0), (45, 0.0, 12, 0.0, 45, 0.0, 3, 0, 0, 0),
    (2, 0.0, 80, 0.0, 30, 0.0, 3, 1, 0, 0), (5, 1.0, 5, 1.0, 5, 1.0, 3, 0, 1, 0), (70, 0.02, 20, 0.0, 60, 0.0, 3, 0, 0, 0), (12, 0.4, 60, 0.0, 60, 0.0, 3, 0, 0, 0),
    (90, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 1), (40, 0.05, 6, 0.0, 80, 0.0, 0, 0, 0, 1), (25, 0.0, 70, 0.0, 60, 0.1, 0, 0, 0, 1),
    (20, 0.1, 45, 0.0, 30, 0.0, 0, 0, 0, 1), (8, 0.0, 30, 0.0, 50, 0.0, 0, 0, 0, 1), (6, 0.0, 4, 1.0, 70, 0.0, 0, 1, 0, 1),
    (14, 0.0, 40, 0.0, 35, 0.0, 0, 0, 1, 1), (3, 0.0, 55, 0.0, 65, 0.0, 0, 1, 0, 1), (150, 0.2, 2, 1.0, 3, 1.0, 0, 0, 0, 1),
    (35, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (18, 0.0, 22, 0.0, 2, 1.0, 0, 0, 0, 1), (60, 0.0, 3, 0.0, 2, 0.5, 0, 0, 0, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 1, 0), (4, 1.0, 3, 1.0, 60, 0.0, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0),
    (10, 0.6, 4, 1.0, 8, 0.7, 0, 0, 0, 0), (25, 0.8, 60, 0.0, 5, 1.0, 0, 0, 0, 0), (6, 0.2, 5, 0.9, 3, 1.0, 0, 0, 0, 0),
    (5, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0), (9, 0.0, 4, 0.6, 2, 1.0, 0, 0, 0, 0), (1, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0),
    (2, 1.0, 0, 0.0, 36, 0.0, 0, 0, 0, 0), (1, 1.0, 40, 0.0, 0, 0.0, 0, 0, 0, 0), (3, 0.9, 20, 0.0, 30, 0.0, 0, 0, 0, 0), (12, 1.0, 30, 0.0, 30, 0.0, 0, 0, 0, 0),
    (8, 0.9, 0, 0.0, 50, 0.0, 0, 0, 0, 0), (4, 1.0, 50, 0.0, 50, 0.0, 0, 0, 0, 0), (1, 1.0, 9, 0.0, 3, 0.0, 0, 0, 0, 0), (30, 0.9, 60, 0.0, 60, 0.0, 0, 0, 0, 0),
    (3, 0.0, 30, 0.0, 30, 0.0, 0, 0, 0, 1), (5, 0.1, 60, 0.0, 20, 0.0, 0, 0, 0, 1), (4, 0.0, 70, 0.0, 70, 0.3, 0, 1, 0, 1), (12, 0.2, 30, 0.0, 80, 0.0, 0, 0, 0, 1),
    (7, 0.5, 50, 0.0, 6, 0.8, 0, 0, 0, 0), (4, 0.0, 2, 0.0, 3, 1.0, 0, 0, 0, 0), (40, 0.9, 3, 1.0, 3, 1.0, 0, 0, 1, 0),
)


def grow(rows: list[tuple], depth: int = 7):
    """A decision tree by Gini impurity: nested (feature, bound, at most, above) or a label."""
    labels = [r[-1] for r in rows]
    ones = sum(labels)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:]):
            bound = (low + high) / 2
            left = [r[-1] for r in rows if r[f] <= bound]
            right = [r[-1] for r in rows if r[f] > bound]
            impurity = sum(len(x) * (1 - (sum(x) / len(x)) ** 2 - (1 - sum(x) / len(x)) ** 2) for x in (left, right))
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, bound
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, bound = best
    return f, bound, grow([r for r in rows if r[f] <= bound], depth - 1), grow([r for r in rows if r[f] > bound], depth - 1)


def _coded(words: float, density: float, before: tuple, after: tuple, zone: int, heading: int, item: int, zones: bool = True) -> tuple:
    """Zones as separate yes-or-no features, as they have no order."""
    return words, density, *before, *after, *((int(zone == ARTICLE), int(zone == MENU), int(zone in (ASIDE, FORM))) if zones else ()), heading, item


@lru_cache(maxsize=2)
def tree(zones: bool = True):
    """The decision tree; without ``zones``, of counts alone."""
    rows = TABLE if zones else [r for r in TABLE if r[6] in (0, ARTICLE) or r[1] > 0.3]
    return grow([(*_coded(r[0], r[1], r[2:4], r[4:6], *r[6:9], zones), r[9]) for r in rows])


def judged(found: list[Block], zones: bool = True) -> list[bool]:
    """Whether each block belongs to the main text."""
    out, none = [], (0, 0.0)
    for i, b in enumerate(found):
        before = (found[i - 1].words, found[i - 1].density) if i else none
        after = (found[i + 1].words, found[i + 1].density) if i + 1 < len(found) else none
        x, node = _coded(b.words, b.density, before, after, b.zone, int(b.heading), int(b.item), zones), tree(zones)
        while not isinstance(node, int):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        out.append(bool(node))
    return out


def _prose(found: list[Block]) -> int:
    return sum(b.words for b in found if not b.heading and b.words >= 8 and b.density < 0.5)


def overruled(found: list[Block], kept: list[bool]) -> set[str]:
    """Hints that the page as a whole speaks against."""
    out = set()
    told = {b.hint for b in found if b.hint}
    lost = {h: [b for b, k in zip(found, kept) if b.hint == h and not k] for h in told}
    if not any(b.top for b, k in zip(found, kept) if k):
        out |= {h for h, own in lost.items() if sum(b.top for b in own) == 1 and any(not b.heading and b.words >= 15 and b.density < 0.3 for b in own)}
    most = max(lost, key=lambda h: (_prose(lost[h]), h), default=None)
    if most is not None and _prose(lost[most]) > max(20, 10 * sum(b.words for b, k in zip(found, kept) if k and not b.heading)):
        out.add(most)
    return out


def main_text(page: str | None, zones: bool = True) -> str:
    """The kept blocks, joined by an empty line."""
    found = blocks(page or "")
    kept = judged(found, zones)
    wrong = overruled(found, kept)
    if wrong:
        found = [replace(b, zone=ARTICLE) if b.hint in wrong else b for b in found]
        kept = judged(found, zones)
    if found and not any(kept):
        found = blocks(page or "", hints=False)
        kept = judged(found, zones)
    return "\n\n".join(b.text for b, k in zip(found, kept) if k)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), source: str = "html") -> DataFrame:
    """``keep`` and ``text string`` of every page; a narrow map."""
    bounded_batches(pages.sparkSession)
    free_names(keep, ("text",))
    rows = pages.select(*(column(pages, c).alias(c) for c in keep), column(pages, source).cast("string").alias("_html_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(x) for x in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], text], [*keep, "text"])

    return rows.mapInArrow(lean(run), ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["text string"]))
