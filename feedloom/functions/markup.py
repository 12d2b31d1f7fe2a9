"""The one Python function of the engine: page markup to an array of cards.

Selectors on a tree cannot be written as regular expressions once elements nest, so this step runs in
Python over Arrow batches. It returns *match lists*; which match a mode uses is decided afterwards by
column expressions (``operators.cards``), so every fallback rule stays in Catalyst.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from feedloom.functions.text import _col
from feedloom.presets import CardSpec
from feedloom.schema import PAGE_CARDS_TYPE

# HTML element classes.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
UNSEEN = frozenset("head script style template noscript iframe svg".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
# An opening tag on the left ends an open element on the right, up to the nearest of the containers.
IMPLIED_END = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
}
_PARAGRAPH = frozenset({"p"})
_BUTTON_SCOPE = frozenset({"button"})
_TABLE_SCOPE = frozenset({"button", "table"})
_NO_ATTRS: dict = {}

_BLANKS = re.compile(r"[\t\n\r\f][ \t\n\r\f]*| [ \t\n\r\f]+")
_STEP = re.compile(r"(?:^(?P<tag>[\w-]+))|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)=(['\"])(?P<val>.*?)\4\]")
_BREAK = "\n"
_LINE_END = re.compile("\n")


def parse_selector(selector: str) -> tuple:
    """``tag.class[attr='v'] descendant`` as steps of (tag, classes, attributes)."""
    steps = []
    for part in re.findall(r"(?:\[[^\]]*\]|\S)+", selector):
        found = list(_STEP.finditer(part))
        if not found or "".join(m.group(0) for m in found) != part:
            raise ValueError(f"unsupported selector: {selector!r}")
        tag = next((m["tag"].lower() for m in found if m["tag"]), None)
        classes = frozenset(m["cls"] for m in found if m["cls"])
        attrs = tuple((m["attr"].lower(), m["val"]) for m in found if m["attr"])
        steps.append((tag, classes, attrs))
    return tuple(steps)


class PageTree(HTMLParser):
    """Elements in document order, each with its span in one flat list of text pieces.

    A piece is a string, a line break, or an int: a block boundary, 2 for a paragraph's. One tree serves all renderings and selectors.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.gaps = {**dict.fromkeys(BLOCK, 1), "p": 2}
        self._rendered: dict[str, Rendered] = {}
        self._hits: dict[tuple, list[int]] = {}
        self._levels: dict[tuple, list[int]] = {}
        self.tags: list[str] = []
        self.attrs: list[dict] = []
        self.parents: list[int] = []
        self.first: list[int] = []
        self.last: list[int] = []
        self.end: list[int] = []
        self.pieces: list = []
        self.by_tag: dict[str, list[int]] = {}
        self._open: list[tuple] = []  # (element, tag, is hidden, keeps blanks)
        self._depth: dict[str, int] = {}  # open elements per tag
        self._unseen = 0
        self._pre = 0

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    def handle_starttag(self, tag, attr_list):
        gap = self.gaps.get(tag)
        if gap and self._depth.get("p"):
            self._close_through(_PARAGRAPH, _TABLE_SCOPE if tag != "table" else _BUTTON_SCOPE)
        if tag in IMPLIED_END:
            self._close_through(*IMPLIED_END[tag])
        hides, keeps = tag in UNSEEN, tag == "pre"
        attrs = _NO_ATTRS
        if attr_list:
            attrs = {name: value or "" for name, value in reversed(attr_list)}  # the first one counts
            style = attrs.get("style", "").replace(" ", "").lower()
            hides = hides or "hidden" in attrs or "display:none" in style
            keeps = keeps or "white-space:pre" in style
        if not (self._unseen or hides):
            if gap:
                self.pieces.append(gap)
            elif tag == "br":
                self.pieces.append(_BREAK)
        n = len(self.tags)
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.parents.append(self._open[-1][0] if self._open else -1)
        self.first.append(len(self.pieces))
        self.last.append(len(self.pieces))
        self.end.append(n)
        self.by_tag.setdefault(tag, []).append(n)
        if tag not in VOID:
            self._open.append((n, tag, hides, keeps))
            self._depth[tag] = self._depth.get(tag, 0) + 1
            self._unseen += hides
            self._pre += keeps

    def handle_startendtag(self, tag, attr_list):
        self.handle_starttag(tag, attr_list)

    def handle_endtag(self, tag):
        if not self._depth.get(tag):
            return
        for depth in range(len(self._open) - 1, -1, -1):
            name = self._open[depth][1]
            if name == tag:
                self._pop_to(depth)
                return
            if name in BLOCK and tag not in BLOCK:
                return

    def handle_data(self, data):
        if self._unseen:
            return
        if self._pre:
            lines = data.replace("\r\n", "\n").split("\n")
            for i, line in enumerate(lines):
                if i:
                    self.pieces.append(_BREAK)
                if line:
                    self.pieces.append((line,))
        else:
            self.pieces.append(_BLANKS.sub(" ", data))

    def parse_marked_section(self, i, report=1):
        """``<![`` is read as browsers read it: a comment up to the next ``>``, or to the end of the page."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def finish(self) -> PageTree:
        if self.rawdata.startswith(("<!--", "<![")):
            self.rawdata = ""  # a comment that never ends
        self.close()
        self._pop_to(0)
        return self

    def _close_through(self, ends: frozenset, scope: frozenset) -> None:
        if not any(self._depth.get(tag) for tag in ends):
            return
        for depth in range(len(self._open) - 1, -1, -1):
            name = self._open[depth][1]
            if name in scope:
                return
            if name in ends:
                self._pop_to(depth)
                return

    def _pop_to(self, depth: int) -> None:
        last = len(self.tags) - 1
        while len(self._open) > depth:
            n, tag, hides, keeps = self._open.pop()
            self._depth[tag] -= 1
            self.last[n] = len(self.pieces)
            self.end[n] = last
            self._unseen -= hides
            self._pre -= keeps
            if tag in self.gaps and not (self._unseen or hides):
                self.pieces.append(self.gaps[tag])

    def _fits(self, n: int, step: tuple) -> bool:
        tag, classes, wanted = step
        if tag and self.tags[n] != tag:
            return False
        attrs = self.attrs[n]
        return all(attrs.get(k) == v for k, v in wanted) and (
            not classes or classes <= set((attrs.get("class") or "").split())
        )

    def select(self, steps: tuple) -> list[int]:
        """Elements matching a parsed selector, in document order."""
        if steps not in self._hits:
            *above, last = steps
            pool = self.by_tag.get(last[0], ()) if last[0] else range(len(self.tags))
            hits = [n for n in pool if self._fits(n, last)]
            if above and hits:
                reached = self._reached(tuple(above))
                hits = [n for n in hits if self.parents[n] >= 0 and reached[self.parents[n]] == len(above)]
            self._hits[steps] = hits
        return self._hits[steps]

    def _reached(self, above: tuple) -> list[int]:
        """For each element how many of the steps, in order, it and the elements around it fulfil."""
        if above not in self._levels:
            out = []
            for n, parent in enumerate(self.parents):
                level = out[parent] if parent >= 0 else 0
                out.append(level + (level < len(above) and self._fits(n, above[level])))
            self._levels[above] = out
        return self._levels[above]

    def text(self, n: int, rendering: str) -> str:
        """An element's rendered text."""
        if rendering not in self._rendered:
            self._rendered[rendering] = Rendered(self.pieces, rendering == "lines")
        return self._rendered[rendering].between(self.first[n], self.last[n])


class Rendered:
    """A page's text, written once; the text of any run of pieces is a slice of it.

    Blanks are collapsed, block boundaries and <br> become line breaks, hidden parts are left out. What comes before a run decides
    only about a blank or line breaks at its front, and those a run never begins with, so its text is cut out from its first own
    character on. A blank at the end of a piece is held back until text follows on the same line.
    """

    def __init__(self, pieces: list, lines: bool):
        self.lines = lines
        out: list[str] = []
        at = gap = 0
        newline, soft = False, False
        self.begin: list[int] = []  # where a piece's own text starts
        self.end = [0]  # where the text ends before each piece, the held-back blank left out
        shows: list[bool] = []  # whether a run may start with the piece
        for piece in pieces:
            shown = ""
            if isinstance(piece, int):
                gap = max(gap, 1 if lines else piece)
                shows.append(False)
            elif isinstance(piece, tuple):
                shown = piece[0]
                shows.append(bool(shown))
            elif piece == _BREAK:
                shown = piece
                shows.append(True)
            else:
                blank = piece.startswith(" ")
                shown = piece[1:] if blank and (gap or not at or soft or newline) else piece
                shows.append(len(piece) > blank)
            if not shown:
                self.begin.append(at)
                self.end.append(at)
                continue
            if soft and not (shown == _BREAK or gap):
                out.append(" ")
                at += 1
            # The line after a <br> is already a new one where lines are what is written.
            if gap and at and not (lines and newline):
                out.append("\n" * gap)
                at += gap
            gap = 0
            own = isinstance(piece, str) and piece != _BREAK
            soft = own and shown.endswith(" ")
            self.begin.append(at + (own and shown.startswith(" ")))
            written = shown[:-1] if soft else shown
            if written:
                out.append(written)
                at += len(written)
                newline = written.endswith("\n")
            self.end.append(at)
        self.next = [len(pieces)] * (len(pieces) + 1)
        for i in range(len(pieces) - 1, -1, -1):
            self.next[i] = i if shows[i] else self.next[i + 1]
        self.text = "".join(out)
        if lines:
            self.text = self.text.replace("\xa0", " ")
            self.line_at = [0, *(m.end() for m in _LINE_END.finditer(self.text))]
            trimmed = [line.strip() for line in self.text.split("\n")]
            self.trimmed = "\n".join(trimmed)
            self.trimmed_at = [0]
            for line in trimmed:
                self.trimmed_at.append(self.trimmed_at[-1] + len(line) + 1)

    def between(self, first: int, last: int) -> str:
        """The text of the pieces from ``first`` to before ``last``."""
        piece = self.next[first]
        if piece >= last:
            return ""
        a, b = self.begin[piece], self.end[last]
        if not self.lines:
            return self.text[a:b]
        i, j = bisect_right(self.line_at, a) - 1, bisect_right(self.line_at, b) - 1
        if i == j:
            return self.text[a:b].strip()
        front, back = self.text[a : self.line_at[i + 1]].strip(), self.text[self.line_at[j] : b].strip()
        return f"{front}\n{self.trimmed[self.trimmed_at[i + 1] : self.trimmed_at[j]]}{back}".strip()


def _within(tree: PageTree, hits: list[int], card: int, every: bool) -> list[int]:
    """The matches inside a card, in document order; only the first unless ``every``."""
    first = bisect_right(hits, card)
    last = bisect_left(hits, tree.end[card] + 1)
    return hits[first:last] if every else hits[first : min(last, first + 1)]


@dataclass(frozen=True)
class Reader:
    """What reading a page needs of a CardSpec, selectors parsed."""

    containers: list[tuple]
    fields: list[list[tuple]]
    time_attr: str
    rendering: str
    whole: bool
    every: bool

    @staticmethod
    def of(spec: CardSpec) -> Reader:
        def parsed(selectors: tuple[str, ...]) -> list[tuple]:
            return [parse_selector(s) for s in selectors]

        return Reader(
            parsed(spec.containers),
            [parsed(spec.text), parsed(spec.user), parsed(spec.time)],
            spec.time_attr,
            spec.rendering,
            spec.mode in ("A_lenient", "B_visible"),
            spec.mode == "A_lenient",  # the one mode that reads more than a selector's first match
        )


def page_cards(html: str | None, readers: Sequence[Reader], caps: Sequence[int | None] | None = None) -> list[dict]:
    """Cards of one page for each reader; the page is parsed once. A page or card that cannot be read is reported in ``error``, not raised."""
    if html is None:
        return [{"found": 0, "cards": [], "error": None}] * len(readers)
    try:
        tree = PageTree()
        tree.feed(html)
        tree.finish()
    except Exception as e:  # noqa: BLE001 - any unreadable page is quarantined
        return [{"found": 0, "cards": [], "error": f"{type(e).__name__}: {e}"}] * len(readers)
    return [_cards_for(tree, reader, cap) for reader, cap in zip(readers, caps or [None] * len(readers))]


def _cards_for(tree: PageTree, reader: Reader, cap: int | None) -> dict:
    try:
        cards = next((hits for hits in map(tree.select, reader.containers) if hits), [])
        wanted = cards if cap is None else cards[:cap]
        lists = [[tree.select(s) for s in steps] if wanted else [] for steps in reader.fields]
    except Exception as e:  # noqa: BLE001
        return {"found": 0, "cards": [], "error": f"{type(e).__name__}: {e}"}
    return {
        "found": len(cards),
        "cards": [_card(tree, reader, i, n, lists) for i, n in enumerate(wanted, 1)],
        "error": None,
    }


def _card(tree: PageTree, reader: Reader, pos: int, n: int, lists: list) -> dict:
    def text(m: int) -> str:
        return tree.text(m, reader.rendering)

    try:
        texts, users, times = ([_within(tree, hits, n, reader.every and not k) for hits in hit_lists] for k, hit_lists in enumerate(lists))
        texts = [list(map(text, hits)) for hits in texts]
        # No mode falls back to the whole card's text when the first match has text of its own.
        own = next((hits[0] for hits in texts if hits), "").strip()
        return {
            "pos": pos,
            "texts": texts,
            "users": [list(map(text, hits)) for hits in users],
            "times": [
                [{"attr": tree.attrs[m].get(reader.time_attr), "text": text(m)} for m in hits]
                for hits in times
            ],
            "whole": text(n) if reader.whole and not own else None,
            "error": None,
        }
    except Exception as e:  # noqa: BLE001 - one bad card must not lose the others
        return {
            "pos": pos, "texts": [], "users": [], "times": [], "whole": None,
            "error": f"{type(e).__name__}: {e}",
        }


#: Characters of markup whose cards stand as Python objects at once, apart from a single longer page.
PIECE_CHARS = 256 << 10


def _pieces(pages: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of pages with about PIECE_CHARS characters together, each with the place of its first page."""
    first, size, held = 0, 0, []
    for at, page in enumerate(pages):
        html = page.as_py()
        if held and size + len(html or "") > PIECE_CHARS:
            yield first, held
            first, size, held = at, 0, []
        held.append(html)
        size += len(html or "") + 1
    if held:
        yield first, held


def cards_array(pages: pa.Array, limits: pa.Array, readers: Sequence[Reader], arrow_type: pa.DataType) -> pa.Array:
    """``page_cards`` of each page. Cards turn into Arrow a few pages at a time: as Python objects a batch's cards take many times its markup."""
    done = []
    for first, held in _pieces(pages):
        caps = limits.slice(first, len(held)).to_pylist()
        done.append(pa.array([page_cards(h, readers, c) for h, c in zip(held, caps)], type=arrow_type))
    return pa.concat_arrays(done) if done else pa.array([], type=arrow_type)


def _may_hold_cards(html: Column, specs: Sequence[CardSpec]) -> Column:
    """False only for pages without any container tag. Tag names cannot be written as entities."""
    tags = {parse_selector(s)[-1][0] for spec in specs for s in spec.containers}
    if None in tags:
        return F.lit(True)
    return html.rlike(r"(?i)<(?:" + "|".join(sorted(tags)) + r")[\s/>]")


def cards_of_page(html: Column | str, spec: CardSpec, cap: Column | None = None) -> Column:
    """Struct of PAGE_CARDS_TYPE for each page, as ``cards_by_spec`` gives it for one spec."""
    return F.get(cards_by_spec(html, [spec], [F.lit(None) if cap is None else cap]), F.lit(0))


def cards_by_spec(html: Column | str, specs: Sequence[CardSpec], caps: Sequence[Column] | None = None) -> Column:
    """Array of PAGE_CARDS_TYPE for each page, one entry per spec in the given order; a page is parsed once for all.

    ``caps`` bound the cards read per page, one for each spec (NULL: all); ``found`` still counts every one. Pages without
    any container tag are not sent to Python. The function is marked non-deterministic so that later
    filters are not pushed through it, which would run it twice: filter pages before calling this.
    """
    result = T.ArrayType(PAGE_CARDS_TYPE)
    arrow_type = to_arrow_type(result)
    readers = [Reader.of(spec) for spec in specs]

    @F.arrow_udf(result)
    def read_cards(pages: pa.Array, limits: pa.Array) -> pa.Array:
        return cards_array(pages, limits, readers, arrow_type)

    page = _col(html)
    limits = F.array(*[(F.lit(None) if caps is None else caps[i]).cast("long") for i in range(len(specs))])
    return read_cards.asNondeterministic()(F.when(_may_hold_cards(page, specs), page), limits)


def page_text(html: str | None, rendering: str) -> str | None:
    if html is None:
        return None
    try:
        tree = PageTree()
        tree.feed(f"<x-page>{html}")
        return tree.finish().text(0, rendering)
    except Exception:  # noqa: BLE001 - one unreadable page must not end the query
        return None


def text_of_page(html: Column | str, rendering: str = "lines") -> Column:
    """Rendered text of a whole page, ``<head>``, scripts and styles left out; NULL for a page that cannot be read."""

    @F.arrow_udf("string")
    def read_text(pages: pa.Array) -> pa.Array:
        return pa.array((page_text(h.as_py(), rendering) for h in pages), type=pa.string())

    return read_text.asNondeterministic()(_col(html))
