"""Typed elements of pages and of office files."""

import html
import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from askloom import queries
from askloom.sources import documents as D
from askloom.sources import tables


def plain_page(text):
    """The elements of the test tables' pages, by cutting at tags; written apart from the parser."""
    text = re.sub(r"(?is)<(script|style)\b.*?</\1>", "", text)
    out, kind, frame, held = [], "NarrativeText", None, ""
    kinds = {"h1": "Title", "title": "Title", "li": "ListItem"}
    frames = {"nav": "Header", "footer": "Footer"}

    def put():
        nonlocal held
        said = " ".join(html.unescape(held).split())
        if said:
            out.append((frame or kind, said))
        held = ""

    for piece in re.split(r"(<[^>]*>)", text):
        tag = re.match(r"<(/?)([a-z0-9]+)", piece)
        if not piece.startswith("<"):
            held += piece
        elif tag and tag[2] == "br":
            held += " "
        elif tag and tag[2] in (*kinds, *frames, "p", "div", "article", "body", "html", "head", "ul"):
            put()
            kind = "NarrativeText" if tag[1] else kinds.get(tag[2], "NarrativeText")
            if tag[2] in frames:
                frame = None if tag[1] else frames[tag[2]]
    put()
    return out


def test_pages_against_a_plain_parse(spark, sf_dir):
    got = {}
    for r in sorted(queries.page_elements(spark, sf_dir).collect(), key=lambda r: (r.page_id, r.pos)):
        got.setdefault(r.page_id, []).append((r.kind, r.text))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert got == {r.page_id: plain_page(r.html) for r in pages}
    assert {k for rows in got.values() for k, _ in rows} == {"Title", "NarrativeText", "Header", "Footer"}


def test_html(spark):
    page = (
        "<title>T</title><header>top<p>more</header><h2>A &amp; B<p>one<br>two<b>!</b><ul><li>x<li>y <i>z</i></ul>"
        "<table><tr><th>k</th><td>v<p>w</td></tr><tr><td>2</td></tr></table>tail<noscript>no</noscript><style>s</style> end<footer>f</footer>"
    )
    want = [
        ("Title", "T"), ("Header", "top"), ("Header", "more"), ("Title", "A & B"), ("NarrativeText", "one two!"), ("ListItem", "x"),
        ("ListItem", "y z"), ("Table", "k v w\n2"), ("NarrativeText", "tail end"), ("Footer", "f"),
    ]
    assert D.html_elements(page) == want
    df = spark.createDataFrame([(page,), (None,), ("",)], "h string").select(D.page_elements("h").alias("e"))
    rows = df.select("e", D.element_text(F.col("e")).alias("text")).collect()
    assert [(e.kind, e.text) for e in rows[0].e] == want and rows[1].e == rows[2].e == []
    assert rows[0].text == D.joined_elements(want) == "T\n\nA & B\n\none two!\n\nx\n\ny z\n\nk v w\n2\n\ntail end"
    assert D.html_elements("<table><tr><td>open") == [("Table", "open")] and D.html_elements("a < b & c") == [("NarrativeText", "a < b & c")]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def paragraph(text, props=""):
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def docx():
    cell = lambda x: f"<w:tc>{paragraph(x)}</w:tc>"
    body = (
        paragraph("Глава", '<w:pStyle w:val="Heading1"/>') + paragraph("Первый абзац.") + paragraph("пункт", "<w:numPr/>") + paragraph("")
        + f"<w:tbl><w:tr>{cell('а')}{cell('б')}</w:tr><w:tr>{cell('в')}</w:tr></w:tbl>"
        + "<w:p><w:r><w:t>два</w:t><w:tab/><w:t>слова</w:t></w:r></w:p>"
    )
    return zipped(word__document=f"<w:document {W}><w:body>{body}</w:body></w:document>")


def pptx():
    line = lambda x: f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>"
    shape = lambda kind, *lines: f'<p:sp><p:nvPr>{kind}</p:nvPr><p:txBody>{"".join(map(line, lines))}</p:txBody></p:sp>'
    table = f"<p:graphicFrame><a:tbl><a:tr><a:tc>{line('1')}</a:tc><a:tc>{line('2')}</a:tc></a:tr></a:tbl></p:graphicFrame>"
    slide = lambda x: f"<p:sld {A}><p:cSld>{x}</p:cSld></p:sld>"
    first = shape('<p:ph type="title"/>', "Заголовок") + shape('<p:ph idx="1"/>', "раз", "два") + table
    return zipped(ppt__slides__slide10=slide(shape("", "Последний")), ppt__slides__slide2=slide(first))


def test_office_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx())
    (tmp_path / "b.pptx").write_bytes(pptx())
    (tmp_path / "c.md").write_text("# Т\nстрока\nещё\n\n- раз\n2. два\n\n| a | b |\n| 1 | 2 |", encoding="utf-8")
    (tmp_path / "d.docx").write_bytes(docx()[:-40])
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f.docx").write_bytes(zipped(word__document="<w:document"))
    got, errors = {}, {}
    for r in sorted(tables.load_elements(spark, f"file://{tmp_path}").collect(), key=lambda r: (r.source, r.pos or 0)):
        name = r.source.rpartition("/")[2]
        if r.error:
            errors[name] = r.error
        else:
            got.setdefault(name, []).append((r.kind, r.text))
    assert got["a.docx"] == [("Title", "Глава"), ("NarrativeText", "Первый абзац."), ("ListItem", "пункт"), ("Table", "а б\nв"), ("NarrativeText", "два слова")]
    assert got["b.pptx"] == [("Title", "Заголовок"), ("ListItem", "раз"), ("ListItem", "два"), ("Table", "1 2"), ("NarrativeText", "Последний")]
    assert got["c.md"] == [("Title", "Т"), ("NarrativeText", "строка\nещё"), ("ListItem", "раз"), ("ListItem", "два"), ("Table", "| a | b |\n| 1 | 2 |")]
    assert set(errors) == {"d.docx", "e.pdf", "f.docx"} and set(got) == {"a.docx", "b.pptx", "c.md"}
    texts = {r.metadata["filename"]: r.content for r in tables.load_documents(spark, f"file://{tmp_path}").collect()}
    assert texts["a.docx"].startswith("Глава\n\nПервый абзац.") and set(texts) == set(got)


def test_a_part_that_unfolds_too_far(monkeypatch):
    monkeypatch.setattr(D, "PART_BYTES", 100)
    with pytest.raises(D.DocumentLoadError, match="unfolds"):
        D.parse_document("x.docx", docx())
