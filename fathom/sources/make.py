"""Small office files made of lines and cells, for exports and fixtures: the least parts that readers ask for."""

from __future__ import annotations

import zipfile
from io import BytesIO
from xml.sax import saxutils

_KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_DRAW, _DECK = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"


def escape(text: str) -> str:
    """Most texts have nothing to escape."""
    return saxutils.escape(text) if "&" in text or "<" in text or ">" in text else text


def _rels(*targets: tuple[str, str]) -> str:
    return f"<Relationships {_REL}>" + "".join(f'<Relationship Id="r{i}" Type="{_KIND}/{kind}" Target="{t}"/>' for i, (kind, t) in enumerate(targets)) + "</Relationships>"


def _archive(main: str, parts: dict[str, str]) -> bytes:
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for name, text in ({"_rels/.rels": _rels(("officeDocument", main))} | parts).items():
            z.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED, 1)  # without a time: the same bytes each time
    return out.getvalue()


def xlsx(rows: list[list[str]], name: str = "Sheet") -> bytes:
    """A book of one sheet with cells of text; blank cells are left out, as spreadsheets do it."""
    cells = lambda row: "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in row if c)
    data = "".join(f"<row>{cells(r)}</row>" for r in rows)
    book = f'<workbook xmlns="{_SHEET}" xmlns:r="{_KIND}"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="r0"/></sheets></workbook>'
    return _archive("xl/workbook.xml", {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": _rels(("worksheet", "worksheets/sheet1.xml")), "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_SHEET}"><sheetData>{data}</sheetData></worksheet>'})


def docx(paragraphs: list[str]) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    return _archive("word/document.xml", {"word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body>{body}</w:body></w:document>'})


def pptx(slides: list[str]) -> bytes:
    """A deck with one text a slide."""
    shape = lambda t: f"<p:sp><p:txBody><a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p></p:txBody></p:sp>"
    parts = {f"ppt/slides/slide{i}.xml": f'<p:sld xmlns:a="{_DRAW}" xmlns:p="{_DECK}"><p:cSld><p:spTree>{shape(t)}</p:spTree></p:cSld></p:sld>' for i, t in enumerate(slides)}
    ids = "".join(f'<p:sldId id="{256 + i}" r:id="r{i}"/>' for i in range(len(slides)))
    deck = f'<p:presentation xmlns:p="{_DECK}" xmlns:r="{_KIND}"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>'
    return _archive("ppt/presentation.xml", parts | {"ppt/presentation.xml": deck, "ppt/_rels/presentation.xml.rels": _rels(*[("slide", f"slides/slide{i}.xml") for i in range(len(slides))])})
