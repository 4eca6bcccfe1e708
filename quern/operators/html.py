"""HTML pages to sections at h2, h3 and h4.

A page becomes a flat list of nodes in document order, in which a subtree is a range; a section's elements become typed
blocks, captions are settled among the blocks, and each kind of block has one renderer. Nothing recurses, so depth
costs no stack. The standard library's parser runs in Arrow batches.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import zip_longest
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose text is no text of the elements around them.
SILENT = frozenset("script style template rt rp".split())
#: Chrome that goes before sectioning, as tags and as classes, and the classes of links that go.
CHROME_TAGS = frozenset("nav aside header footer".split())
CHROME_CLASSES = frozenset("toc nav-container toolbar breadcrumbs pagination".split())
CHROME_LINKS = frozenset("prev next".split())
#: What goes where it stands before the first heading, and the marks that are written.
BEFORE_HEADING = frozenset("ul ol p nav".split())
REGISTERS = "\n**[REGISTER FILE: x0(zero)–x31 are 32-bit general purpose registers. x0 is hardwired to 0. pc is the 32-bit program counter.]**\n"
FIGURE = "`[FIGURE: {}]`"
BARE_FIGURE = "Instruction encoding diagram"
#: A paragraph that begins or goes on like this names the figure before it.
CAPTION = re.compile(r"\AFigure|(?i:instruction format|types of immediate)")
MIN_CHARS = 40
TEXT, REMARK = "#text", "#remark"
FIELD = pa.struct([(n, pa.string()) for n in ("field", "bit_range", "bits", "semantic")])
ENCODINGS = pa.list_(pa.struct([("encoding_fields", pa.list_(FIELD))]))
SCHEMA = (
    "page_id long, ord int, section_title string, heading_level string, heading_id string, parent_section string, has_encoding_table boolean, document_text string, "
    "structured_encodings array<struct<encoding_fields:array<struct<field:string,bit_range:string,bits:string,semantic:string>>>>"
)


class Page(HTMLParser):
    """The nodes of a page in document order: tag, attributes, text, place of the parent, and where the subtree ends."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.data, self.up, self.end = [""], [{}], [""], [-1], [0]
        self.path, self.counts, self.speaking = [0], Counter(), False
        try:
            self.feed(html)
            self.close()
        except AssertionError:  # the parser gives up on some marked sections; what came before counts
            pass
        self._leave(0)

    def _add(self, tag: str, attrs=(), data: str = "") -> None:
        self.tag.append(tag)
        self.attrs.append({k: v or "" for k, v in attrs})
        self.data.append(data)
        self.up.append(self.path[-1])
        self.end.append(len(self.tag))
        self.speaking = tag == TEXT

    def _leave(self, depth: int) -> None:
        while len(self.path) > depth:
            at = self.path.pop()
            self.end[at] = len(self.tag)
            self.counts[self.tag[at]] -= 1

    def handle_starttag(self, tag, attrs):
        self._add(tag, attrs)
        if tag not in VOID:
            self.path.append(len(self.tag) - 1)
            self.counts[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def handle_endtag(self, tag):
        self.speaking = False
        if self.counts[tag] > 0:  # an end without a start counts for nothing
            self._leave(next(d for d in range(len(self.path) - 1, 0, -1) if self.tag[self.path[d]] == tag))

    def handle_data(self, data):
        if self.speaking:
            self.data[-1] += data
        else:
            self._add(TEXT, data=data)

    def handle_comment(self, data):
        self._add(REMARK, data=data)

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self.handle_data(data.removeprefix("CDATA["))

    def classes(self, i: int) -> set[str]:
        return set(self.attrs[i].get("class", "").split())


class View:
    """A page's body without chrome and without what stands before its first heading: its nodes in document order."""

    def __init__(self, page: Page, body: int):
        p = self.page = page
        first, gone = None, []
        at = body + 1
        while at < p.end[body]:
            if p.tag[at] in CHROME_TAGS or p.classes(at) & CHROME_CLASSES or p.tag[at] == "a" and p.classes(at) & CHROME_LINKS:
                gone.append((at, p.end[at]))
                at = p.end[at]
                continue
            if first is None and p.tag[at] in ("h1", "h2", "h3"):
                first = at
            at += 1
        if first is not None:
            gone += [(i, p.end[i]) for i in range(first) if p.tag[i] in BEFORE_HEADING]
        kept = bytearray(b"\1") * len(p.tag)
        done = 0
        for a, b in sorted(gone):
            if b > done:
                kept[max(a, done) : b] = bytes(b - max(a, done))
                done = b
        self.nodes = [i for i in range(body, p.end[body]) if kept[i]] if kept[body] else []
        quiet = 0
        self.spoken: list[int] = []  # text nodes that count as text
        for i in self.nodes:
            if p.tag[i] in SILENT:
                quiet = max(quiet, p.end[i])
            elif p.tag[i] == TEXT and i >= quiet:
                self.spoken.append(i)
        self.by_tag: dict[str, list[int]] = {}
        for i in self.nodes:
            self.by_tag.setdefault(p.tag[i], []).append(i)

    def inside(self, i: int, *tags: str) -> list[int]:
        """Elements of these tags below i, in document order."""
        out = []
        for t in tags:
            found = self.by_tag.get(t, [])
            out += found[bisect_left(found, i + 1) : bisect_left(found, self.page.end[i])]
        return out if len(tags) == 1 else sorted(out)

    def raw(self, i: int, between: str = "") -> str:
        s = self.spoken
        return between.join(self.page.data[x] for x in s[bisect_left(s, i) : bisect_left(s, self.page.end[i])])

    def text(self, i: int) -> str:
        """Its texts with blanks between them, each run of white space as one blank."""
        return " ".join(self.raw(i, " ").split())

    def siblings(self, i: int, stop: int) -> Iterator[int]:
        """Nodes after i under the same parent, up to `stop`."""
        p, at = self.page, bisect_left(self.nodes, self.page.end[i])
        edge = p.end[p.up[i]]
        while at < len(self.nodes) and self.nodes[at] < edge and self.nodes[at] != stop:
            yield self.nodes[at]
            at = bisect_left(self.nodes, p.end[self.nodes[at]], at + 1)


class Block(NamedTuple):
    """kind: words, heading, note, registers, table, bare (an unnamed figure), figure, paragraph, list, terms, code or none."""

    kind: str
    lines: list[str]
    rows: list[list[str]] = []


def cite(s: str) -> str:
    return re.sub(r"\[(\d+)\]\([^)]+\)", r"[REF:\1]", s)


def fields(rows: list[list[str]]) -> list[dict]:
    """An encoding table's columns, read downwards: bit range, (nothing), name, bits and meaning; nameless columns go.
    Tables of fewer than three rows or without a digit in the first one are none."""
    if len(rows) < 3 or not re.search(r"\d", "\n".join(rows[0])):
        return []
    keys = ("bit_range", "", "field", "bits", "semantic")
    columns = [dict(zip(keys, c, strict=False)) for c in zip_longest(*rows[:5], fillvalue="")]
    return [{k: c[k] for k in ("field", "bit_range", "bits", "semantic") if c.get(k)} for c in columns if c["field"]]


def _table(v: View, i: int) -> Block:
    rows = [[v.text(c) for c in v.inside(r, "td", "th")] for r in v.inside(i, "tr")]
    if rows and {(len(r), *r[:1]) for r in rows} == {(2, "")}:
        return Block("note", [cite(" ".join(r[1] for r in rows))])
    bare = [r for r in rows if len(r) >= 3 and set(r[1:]) == {""}]
    return Block("registers" if len(rows) >= 10 and 10 * len(bare) >= 7 * len(rows) else "table", [], rows)


def _paragraph(v: View, i: int) -> Block:
    pictures, said = v.inside(i, "img"), v.text(i)
    attrs = v.page.attrs[pictures[0]] if pictures else {}
    if attrs.get("src", "").endswith(".svg"):
        said = (said.replace(attrs["alt"], "") if attrs.get("alt") else said).strip()
        return Block("bare", [BARE_FIGURE]) if said in ("", "[svg]") else Block("figure", [said])
    return Block("paragraph", [cite(said)]) if said else Block("none", [])


def _terms(v: View, i: int) -> Block:
    return Block("terms", [f"**{v.text(x)}**" for x in v.inside(i, "dt")] + [f"  {cite(v.text(x))}" for x in v.inside(i, "dd")])


def _items(v: View, i: int) -> Block:
    return Block("list", [f"- {cite(v.text(x))}" for x in v.inside(i, "li") if v.page.up[x] == i])


def _words(v: View, i: int) -> Block:
    said = v.page.data[i].strip()
    return Block("words", [cite(said)]) if said else Block("none", [])


#: From an element to its block, by tag; other elements give none.
READERS: dict[str, Callable[[View, int], Block]] = {
    **dict.fromkeys((TEXT, REMARK), _words),
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), lambda v, i: Block("heading", [v.text(i)])),
    **dict.fromkeys(("p", "div"), _paragraph),
    **dict.fromkeys(("ul", "ol"), _items),
    **dict.fromkeys(("pre", "code"), lambda v, i: Block("code", [v.raw(i)])),
    "table": _table,
    "dl": _terms,
}


def settled(blocks: list[Block]) -> list[Block]:
    """Captions in the place of bare figures: the next figure, paragraph or list after a bare figure decides, and if it is
    a paragraph that reads like a caption, it names the figure and goes."""
    out: list[Block] = []
    decisive = None  # place in `out`, which runs backwards
    for b in reversed(blocks):
        if b.kind == "bare" and decisive is not None and out[decisive].kind == "paragraph" and CAPTION.search(out[decisive].lines[0]):
            b = Block("named", out[decisive].lines)
            out[decisive] = Block("none", [])
        out.append(b)
        if b.kind in ("bare", "named", "figure", "paragraph", "list"):
            decisive = len(out) - 1
    return out[::-1]


def _grid(b: Block) -> list[str]:
    lines = ["| " + " | ".join(c.replace("|", "\\|") or " " for c in r) + " |" for r in b.rows]
    lines[1:1] = ["| " + " | ".join(["---"] * len(r)) + " |" for r in b.rows[:1]]
    found = fields(b.rows)
    code = ["**Structured Encoding (JSON):**", "```json", json.dumps({"encoding_fields": found}, indent=2), "```"] if found else []
    return ["", "\n".join(lines), "", *code, ""]


#: From a block to its lines, by kind.
RENDERERS: dict[str, Callable[[Block], list[str]]] = {
    "none": lambda b: [],
    "words": lambda b: b.lines,
    "heading": lambda b: [f"\n## {b.lines[0]}\n"],
    "note": lambda b: [f"\n> **NOTE:** {b.lines[0]}\n"],
    "registers": lambda b: [REGISTERS],
    "table": _grid,
    "bare": lambda b: [f"\n{FIGURE.format(b.lines[0])}\n"],
    "figure": lambda b: [f"\n{FIGURE.format(b.lines[0])}\n"],
    "named": lambda b: [FIGURE.format(b.lines[0])],
    "paragraph": lambda b: [*b.lines, ""],
    "list": lambda b: [*b.lines, ""],
    "terms": lambda b: [*b.lines, ""],
    "code": lambda b: [f"```\n{b.lines[0]}\n```", ""],
}


def body_of(p: Page) -> int | None:
    """The first article of class doc, else the first article, else the body."""
    every = range(1, len(p.tag))
    wanted = (lambda i: p.tag[i] == "article" and "doc" in p.classes(i), lambda i: p.tag[i] == "article", lambda i: p.tag[i] == "body")
    return next((i for want in wanted for i in every if want(i)), None)


def sections(html: str | None) -> list[tuple]:
    """(ord, title, level, id, context, has encoding, text, encodings) of a page; a page with only h1 has none. The number
    counts sections under 40 characters, which go."""
    page = Page(html or "")
    body = body_of(page)
    if body is None:
        return []
    v, out, over = View(page, body), [], ""
    heads = v.inside(body, "h2", "h3", "h4") if v.nodes else []
    for k, (h, stop) in enumerate(zip(heads, [*heads[1:], -1], strict=False)):
        title, level = v.text(h), page.tag[h]
        over = over if level == "h4" else title
        context = over if level == "h4" else ""
        blocks = settled([READERS[page.tag[i]](v, i) for i in v.siblings(h, stop) if page.tag[i] in READERS])
        intro = [f"> **Section Context:** {context}", ""] if context not in ("", title) else []
        text = "\n".join([*intro, f"# {title}", "", *(line for b in blocks for line in RENDERERS[b.kind](b))]).strip()
        if len(text) >= MIN_CHARS:
            coded = [{"encoding_fields": f} for f in (fields(b.rows) for b in blocks) if f]
            out.append((k, title, level, page.attrs[h].get("id", ""), context, bool(coded), text, coded))
    return out


def html_sections(pages: DataFrame) -> DataFrame:
    """SCHEMA rows from pages (page_id, html). Null and empty pages, and pages without article and body, give none; deep
    nesting costs time in proportion; other columns are not read."""
    types = (pa.int64(), pa.int32(), *[pa.string()] * 4, pa.bool_(), pa.string(), ENCODINGS)
    names = [x.split()[0] for x in re.sub(r"<.*>", "", SCHEMA).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *s) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in sections(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return pages.select("page_id", "html").mapInArrow(run, SCHEMA)
