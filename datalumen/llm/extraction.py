"""Main text of web pages by two-pass block rules.

Markup is cut into blocks. The first pass decides by length, link density and stop-word density; short blocks
stay ambiguous. The second pass gives those the label of the nearest decided neighbours; at equal distance from a good
and a bad one a block is kept inside an article or main element and dropped elsewhere. Neighbours count only in the same element, and what is set
apart by its markup (menus, notices and the like) is nobody's neighbour. A class, id or role sets apart by whole tokens only, never html, body
or main, and no holder of most of the page's text that leaves less than a long block outside (it is over 200 characters, or all there is). Where no neighbour is decided, blocks are kept if no block of the page
is good, and of these only those in articles and main elements if there are any. Beyond these ties an article or main element only
keeps a short block with links, or one with few stop words, ambiguous, and takes medium stop-word density as enough at any length.

Stop words are listed for four languages. Of a block with few of them nothing is known but its form: sentences in small letters (or
in a script without capitals) are good if long, else ambiguous; anything else counts as no prose. Signs of Chinese, Japanese and Korean count three times in lengths.

Null and empty pages give an empty text. Repeated rows each get their own result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from datalumen.llm.common import slices, small_batches

# Limits of the first pass, in characters and shares.
SHORT, LONG, LINKS, STOP_LOW, STOP_HIGH = 70, 200, 0.33, 0.10, 0.30

# Frequent function words.
STOP_WORDS = frozenset("""
a an and are as at be by for from had has have he her his in is it its not of on or that the their they this to was
were which with you
als auch auf aus bei das dem den der des die ein eine einen er es für hat ich im in ist mit nach nicht sich sie sind
über um und von war wie wird zu zum zur
au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas pour qu que qui sa se
ses son sur un une vous
al como con del el ella en entre es esta este la las lo los más no para pero por que se sin sobre su sus un una y ya
""".split())

# Elements that are never main text, elements that start a block, elements that hold the main text.
_RAW = "script|style|noscript|template|svg|iframe|object|textarea|select|title|canvas|math"
_AROUND = frozenset("nav footer aside form menu dialog button fieldset head".split())
_MAIN = frozenset("article main".split())
_NEVER = frozenset("html body main".split())
_BLOCKS = frozenset("""
address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary
table tbody td tfoot th thead tr ul
""".split())
_HOLDERS = _BLOCKS - frozenset("p hr h1 h2 h3 h4 h5 h6 li dd dt td th tr".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Names of classes, ids and roles that mark what surrounds the main text.
_NAMES = frozenset("""
ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments complementary
consent contentinfo cookie cookies copyright disclaimer disqus footer legal login masthead menu modal nav navbar navigation
newsletter notice notification overlay pagination pager popup promo promotion recommended related replies reply respond
search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar tracking widget
""".split())
# What else a token of such a name may hold ("sidebar-left", "site-footer").
_PLACES = frozenset("""
area bar block bottom box column container footer group header inner item left links list main menu outer page panel post primary right
secondary section site slot top unit
""".split())

_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*+>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+(?:>|\Z)|</?\Z", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_ENDS = re.compile(r"""[.!?…][)"'»”’]*(?=\s|\Z)|[。！？｡।؟۔։።]""")
_LETTERS = re.compile(r"[^\W\d_]+")
_DENSE = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]")
_PARTS = re.compile(r"[^a-z]+")
_WHITE = re.compile(r"\s+")


class Block:
    """The text of one block, its characters in links, and where it stands."""

    __slots__ = ("parts", "linked", "around", "named", "main", "text")

    def __init__(self, around: bool, named: int, main: int):
        self.parts: list[str] = []
        self.linked, self.around, self.named, self.main, self.text = 0, around, named, main, ""


def _named(token: str, inside_main: bool) -> bool:
    """Whether a class, id or role as a whole names what surrounds the main text."""
    parts = {p for p in _PARTS.split(token) if p}
    names = _NAMES if inside_main else _NAMES | {"header"}
    return bool(parts & names) and parts <= names | _PLACES


def _set_apart(attributes: str, inside_main: bool) -> tuple[bool, bool]:
    """Whether an element is hidden, and whether its names set it apart."""
    named = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, named
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, named
        if name in ("class", "id", "role"):
            named = named or any(_named(token, inside_main) for token in value.split())
    return False, named


def blocks(html: str) -> list[Block]:
    """The blocks with text, in page order; unclosed and stray tags are tolerated."""
    out: list[Block] = []
    # Element, set apart, number of the holder set apart by name and of the main element around it (0: none).
    open_: list[tuple[str, bool, int, int]] = []
    outer = [0]  # of each holder set apart by name, the one around it
    current: Block | None = None
    link = mains = at = 0

    def place() -> tuple[bool, int, int]:
        return open_[-1][1:] if open_ else (False, 0, 0)

    def add(text: str) -> None:
        nonlocal current
        if not text:
            return
        if current is None:
            if text.isspace():
                return
            current = Block(*place())
            out.append(current)
        current.parts.append(text)
        if link:
            current.linked += len(text)

    for m in _MARKUP.finditer(html):
        add(html[at:m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "br":
            add(" ")
        elif name == "a":
            link = 0 if m[2] else 1
        if name in _BLOCKS:
            current, link = None, 0
        if name in _VOID:
            continue
        inner_holder = name in _HOLDERS or name in ("span", "p", "li") and not m[2] and m[4] and any(_set_apart(m[4], place()[2] > 0))
        if m[2]:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    if name not in _BLOCKS and open_[k][1:3] != (open_[k - 1][1:3] if k else (False, 0)):
                        current = None
                    del open_[k:]
                    break
        elif inner_holder:
            around, named, main = place()
            if name in _MAIN and not main:
                mains += 1
                main = mains
            hidden, by_name = _set_apart(m[4], main > 0) if m[4] else (False, False)
            apart = around or hidden or name in _AROUND or name == "header" and not main
            if by_name and name not in _NEVER:
                outer.append(named)
                named = len(outer) - 1
            if (apart, named) != place()[:2]:
                current = None
            open_.append((name, apart, named, main))
    add(html[at:])
    for b in out:
        b.text = _WHITE.sub(" ", unescape("".join(b.parts))).strip()
    out = [b for b in out if b.text]
    _undo_names(out, outer)
    return out


def _undo_names(found: list[Block], outer: list[int]) -> None:
    """Names do not count for holders of most of the page's text."""
    held = [0] * len(outer)
    for b in found:
        if not b.around:
            held[b.named] += len(b.text)
    for k in range(len(outer) - 1, 0, -1):  # inner holders come after outer ones
        held[outer[k]] += held[k]
    apart = [False] * len(outer)
    for k in range(1, len(outer)):
        most = 2 * held[k] > held[0] and held[0] - held[k] < LONG and (held[k] > LONG or held[k] == held[0])
        apart[k] = apart[outer[k]] or not most
    for b in found:
        b.around = b.around or apart[b.named]


def _stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)


def _sentences(text: str) -> bool:
    """Whether a text of unknown language has the form of prose: sentence ends, and most words in small letters."""
    ends = len(_ENDS.findall(text))
    words = [w for w in _LETTERS.findall(text) if w.lower() != w.upper()]
    return ends * 400 >= len(text) and sum(w[0].islower() for w in words) * 2 >= len(words)


def _first_pass(b: Block) -> bool | None:
    """Good, bad or ambiguous by the block itself."""
    if b.around or b.linked > LINKS * max(1, sum(map(len, b.parts))):
        return False
    n = len(b.text) + 2 * len(_DENSE.findall(b.text))
    if n < SHORT:
        return None if not b.linked or b.main else False
    stops = _stop_density(b.text)
    if stops >= STOP_HIGH:
        return True
    if stops >= STOP_LOW:
        return True if n > LONG or b.main else None
    if _sentences(b.text):
        return True if n > LONG else None
    return None if b.main else False


def _second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Ambiguous blocks take the label of the nearest decided neighbours in the same main element."""
    before: list[tuple[int, bool] | None] = []
    last: dict[int, tuple[int, bool]] = {}
    for i, (b, x) in enumerate(zip(found, labels)):
        before.append(last.get(b.main))
        if x is not None and not b.around:
            last[b.main] = (i, x)
    some_good, some_main = True in labels, any(b.main and x is None for b, x in zip(found, labels))
    out: list[bool] = []
    last = {}
    for i in range(len(found) - 1, -1, -1):
        b, x = found[i], labels[i]
        if x is None:
            near = [p for p in (before[i], last.get(b.main)) if p]
            if not near:
                x = not some_good and (b.main > 0 or not some_main)
            elif len(near) == 1 or near[0][1] == near[1][1]:
                x = near[0][1]
            else:
                gap = [abs(i - p[0]) for p in near]
                x = b.main > 0 if gap[0] == gap[1] else near[gap.index(min(gap))][1]
        elif not b.around:
            last[b.main] = (i, x)
        out.append(x)
    return out[::-1]


def main_text(html: str) -> str:
    """The blocks that are main text, one a line."""
    found = blocks(html)
    keep = _second_pass(found, [_first_pass(b) for b in found])
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches, "html"):
            found = [main_text(texts.raw(i).decode()) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([
                texts.rows.column("page_id"), texts.rows.column("url"), pa.array(found, pa.string()),
                pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    small_batches(pages)
    rows = pages.select(pages["page_id"].cast("bigint").alias("page_id"), *[pages[c].cast("string").alias(c) for c in ("url", "html")])
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
