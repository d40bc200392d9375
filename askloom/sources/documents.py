"""Documents as elements: titles, paragraphs, list items, tables, headers and footers.

HTML, Markdown and plain text, and the zipped XML of .docx and .pptx files, are
read as streams with the standard library and give (kind, text) in their order.
A document's text is that of the four kinds in ``PARSED_KINDS``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings that can be loaded; .pdf needs another library.
SUPPORTED = [".pdf", ".docx", ".pptx", ".html", ".htm", ".txt", ".md"]
PARSED_KINDS = ["NarrativeText", "ListItem", "Title", "Table"]
#: The most that a part of a zipped document may unfold to.
PART_BYTES = 1 << 28

Elements = list[tuple[str, str]]
ELEMENTS = "array<struct<kind: string, text: string>>"


class DocumentLoadError(Exception):
    """A document can't be found or read."""


def _squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class _Html(HTMLParser):
    """Elements of a page; blocks end each other, so that tags without an end do no harm."""

    BLOCKS = {
        **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6", "title"), "Title"), "li": "ListItem", "dt": "ListItem", "dd": "ListItem",
        **dict.fromkeys(
            ("p", "div", "article", "section", "main", "body", "html", "blockquote", "pre", "ul", "ol", "dl", "form", "head", "figure", "figcaption"),
            "NarrativeText",
        ),
    }
    SKIPPED = {"script", "style", "template", "noscript"}
    FRAMES = {"header": "Header", "nav": "Header", "footer": "Footer", "aside": "Footer"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: Elements = []
        self.kind, self.text, self.skipped = "NarrativeText", [], 0
        self.frames: list[str] = []
        self.table, self.rows = 0, []

    def flush(self) -> None:
        text = _squeezed("".join(self.text))
        self.text = []
        if text and self.table:
            self.rows.append(text)
        elif text:
            self.out.append((self.frames[-1] if self.frames else self.kind, text))

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in self.SKIPPED:
            self.skipped += 1
        elif tag == "table":
            self.flush()
            self.table += 1
        elif tag in ("tr", "br") and self.table:
            self.flush() if tag == "tr" else self.text.append(" ")
        elif tag in ("td", "th"):
            self.text.append(" ")
        elif tag == "br":
            self.text.append(" ")
        elif not self.table and (tag in self.BLOCKS or tag in self.FRAMES):
            self.flush()
            self.kind = self.BLOCKS.get(tag, "NarrativeText")
            if tag in self.FRAMES:
                self.frames.append(self.FRAMES[tag])
        elif self.table and tag in self.BLOCKS:
            self.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "table" and self.table:
            self.flush()
            self.table -= 1
            if not self.table and self.rows:
                self.out.append(("Table", "\n".join(self.rows)))
                self.rows = []
        elif not self.table and (tag in self.BLOCKS or tag in self.FRAMES):
            self.flush()
            self.kind = "NarrativeText"
            if tag in self.FRAMES and self.frames:
                self.frames.pop()

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.text.append(data)

    def close(self) -> None:
        super().close()
        if self.table:
            self.handle_endtag("table")
        self.flush()


def html_elements(text: str) -> Elements:
    page = _Html()
    page.feed(text)
    page.close()
    return page.out


_ITEM = re.compile(r"^(?:[-*+•]|\d{1,3}[.)])\s+(.*)", re.S)


def text_elements(text: str, markdown: bool = False) -> Elements:
    """Blocks between empty lines; with ``markdown`` headings, lists and tables are told apart line by line."""
    out: Elements = []
    for block in re.split(r"\n\s*\n", text):
        block = re.sub(r"[ \t]+", " ", block).strip()
        if not markdown:
            out += [("NarrativeText", block)] if block else []
            continue
        held: list[tuple[str, str]] = []
        for line in filter(None, map(str.strip, block.split("\n"))):
            item = _ITEM.match(line)
            kind = "Title" if line.startswith("#") else "ListItem" if item else "Table" if line.startswith("|") else "NarrativeText"
            line = line.lstrip("#").strip() if kind == "Title" else item[1] if item else line
            if held and kind == held[-1][0] and kind in ("NarrativeText", "Table"):
                held[-1] = (kind, held[-1][1] + "\n" + line)
            else:
                held.append((kind, line))
        out += [x for x in held if x[1]]
    return out


def _part(archive: zipfile.ZipFile, name: str) -> io.BytesIO:
    info = archive.getinfo(name)
    if info.file_size > PART_BYTES:
        raise DocumentLoadError(f"{name} unfolds to {info.file_size} bytes")
    return io.BytesIO(archive.read(info))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _value(node: ElementTree.Element, name: str) -> str:
    return next((v for k, v in node.attrib.items() if _local(k) == name), "")


def _said(paragraph: ElementTree.Element) -> str:
    marks = {"tab": " ", "br": " ", "cr": " "}
    return _squeezed("".join(x.text or "" if _local(x.tag) == "t" else marks.get(_local(x.tag), "") for x in paragraph.iter()))


def _table(node: ElementTree.Element) -> str:
    rows = ([" ".join(filter(None, map(_said, (p for p in cell.iter() if _local(p.tag) == "p")))) for cell in row if _local(cell.tag) == "tc"]
            for row in node.iter() if _local(row.tag) == "tr")
    return "\n".join(filter(None, (" ".join(filter(None, cells)) for cells in rows)))


def _streamed(data: io.BytesIO, wanted: set[str]) -> Iterator[ElementTree.Element]:
    """The outermost elements of the wanted names, each once it is complete, after which it is forgotten."""
    inside = 0
    for event, node in ElementTree.iterparse(data, ("start", "end")):
        if _local(node.tag) in wanted:
            inside += 1 if event == "start" else -1
            if event == "end" and not inside:
                yield node
                node.clear()


def docx_elements(data: bytes) -> Elements:
    out: Elements = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for node in _streamed(_part(archive, "word/document.xml"), {"p", "tbl"}):
            if _local(node.tag) == "tbl":
                out.append(("Table", _table(node)))
                continue
            names = {_local(x.tag): x for x in node.iter()}
            style = _value(names["pStyle"], "val").lower() if "pStyle" in names else ""
            kind = "Title" if style.startswith(("heading", "title")) else "ListItem" if "numPr" in names or style.startswith("list") else "NarrativeText"
            out.append((kind, _said(node)))
    return [x for x in out if x[1]]


def pptx_elements(data: bytes) -> Elements:
    out: Elements = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        slides = [(int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))]
        for _, name in sorted(slides):
            for node in _streamed(_part(archive, name), {"sp", "graphicFrame"}):
                tables = [x for x in node.iter() if _local(x.tag) == "tbl"]
                out += [("Table", _table(x)) for x in tables]
                holder = next((_value(x, "type") for x in node.iter() if _local(x.tag) == "ph"), None)
                kind = "Title" if holder in ("title", "ctrTitle") else "ListItem" if holder in ("", "body", "obj") else "NarrativeText"
                if not tables:
                    out += [(kind, _said(p)) for p in node.iter() if _local(p.tag) == "p"]
    return [x for x in out if x[1]]


def parse_elements(name: str, data: bytes) -> Elements:
    """The elements of a file, by its ending."""
    ending = PurePosixPath(name).suffix.lower()
    if ending not in SUPPORTED:
        raise DocumentLoadError(f"unsupported ending {ending!r}")
    if ending == ".pdf":
        raise DocumentLoadError(f"{ending} needs a parser that isn't installed")
    try:
        if ending in (".docx", ".pptx"):
            return (docx_elements if ending == ".docx" else pptx_elements)(data)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, RuntimeError, ValueError) as e:
        raise DocumentLoadError(f"{name} is damaged: {e}") from e
    text = data.decode("utf-8", "replace")
    return html_elements(text) if ending in (".html", ".htm") else text_elements(text, ending == ".md")


def joined_elements(elements: list[dict] | Elements) -> str:
    """What a parser or a parsing service found, as text: narrative, list items, titles and tables."""
    pairs = [(e.get("type"), e.get("text", "")) if isinstance(e, dict) else e for e in elements]
    return "\n\n".join(text for kind, text in pairs if kind in PARSED_KINDS)


def parse_document(name: str, data: bytes) -> str:
    """The text of a file; elements are set apart by empty lines."""
    return joined_elements(parse_elements(name, data))


def page_elements(html: Column | str) -> Column:
    """The elements of a column of pages, as an array of (kind, text); none for null."""

    @F.arrow_udf(ELEMENTS)
    def parsed(pages: pa.Array) -> pa.Array:
        rows = ([{"kind": k, "text": t} for k, t in html_elements(x or "")] for x in pages.to_pylist())
        return pa.array(list(rows), pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())])))

    return parsed(html)


def element_text(elements: Column) -> Column:
    """The text of an array of elements."""
    return F.array_join(F.transform(F.filter(elements, lambda e: e["kind"].isin(PARSED_KINDS)), lambda e: e["text"]), "\n\n")
