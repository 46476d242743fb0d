"""Texts of office files (xlsx, docx, pptx), which are archives of XML: parts are read as streams, and an archive that
inflates beyond a bound is refused before it does."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, time, timedelta
from functools import lru_cache
from io import BytesIO
from posixpath import dirname, join, normpath
from xml.parsers import expat
from xml.etree.ElementTree import Element, fromstring, iterparse

#: Bytes that the parts of one file may have in all.
MOST = 1 << 30
#: Parts up to so many bytes are parsed at once, which is faster; larger ones as streams.
SMALL = 1 << 20
_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# What stands before a sheet's rows and a slide's texts.
SHEET, SLIDE = "工作表：", "幻灯片 "
# Numbers of the built-in formats that are dates or times.
_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


class LoadError(ValueError):
    """A file can't be read as what its suffix says."""


class Package:
    """The parts of an archive."""

    def __init__(self, content: bytes, most: int = MOST):
        self.zip = zipfile.ZipFile(BytesIO(content))
        if sum(i.file_size for i in self.zip.infolist()) > most:
            raise LoadError(f"more than {most} bytes when inflated")
        self.names = set(self.zip.namelist())

    def small(self, part: str) -> bool:
        return self.zip.getinfo(part).file_size <= SMALL

    def events(self, part: str, *ends: str) -> Iterator[Element]:
        """Elements with these local names (which don't hold each other) in their order; of a large part nothing is kept
        behind them."""
        if self.small(part):
            yield from (e for e in fromstring(self.zip.read(part)).iter() if local(e) in ends)
            return
        with self.zip.open(part) as stream:
            for _, e in iterparse(stream, ("end",)):
                if local(e) in ends:
                    yield e
                    e.clear()

    def targets(self, part: str) -> dict[str, tuple[str, str]]:
        """Parts that a part refers to, by id, with the last word of their kind."""
        rels = join(dirname(part), "_rels", part.rsplit("/", 1)[-1] + ".rels")
        if rels not in self.names:
            return {}
        found = ((e.get("Id"), e.get("Target", ""), e.get("Type", "")) for e in self.events(rels, "Relationship"))
        return {i: (normpath(t.lstrip("/") if t.startswith("/") else join(dirname(part), t)), kind.rsplit("/", 1)[-1]) for i, t, kind in found}


@lru_cache(4096)
def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def local(e: Element) -> str:
    return _local(e.tag)


def _kids(e: Element, *names: str) -> list[Element]:
    return [k for k in e if local(k) in names]


def _joined(cells: list[str]) -> str:
    return " | ".join(c for c in (x.strip() for x in cells) if c)


# -- sheets --


def _strings(p: Package, part: str) -> list[str]:
    """Shared strings: the text of each, runs joined, without readings."""
    return ["".join(t.text or "" for k in si for t in ([k] if local(k) == "t" else _kids(k, "t") if local(k) == "r" else [])) for si in p.events(part, "si")]


def _date_styles(p: Package, part: str) -> list[bool]:
    """By style number, whether a number of that style is a date or time."""
    own: dict[str, bool] = {}
    styles: list[bool] = []
    for e in p.events(part, "numFmt", "cellXfs"):
        if local(e) == "numFmt":
            code = re.sub(r'"[^"]*"|\\.|_.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", e.get("formatCode", "").lower())
            own[e.get("numFmtId", "")] = bool(re.search("[dmyhs]", code)) and code != "general"
        else:
            styles = [own.get(x.get("numFmtId", ""), x.get("numFmtId", "0").isdigit() and int(x.get("numFmtId", "0")) in _DATES) for x in _kids(e, "xf")]
    return styles


def _moment(value: float, late: bool) -> str:
    """A serial number as a time of day, where it is less than one, or as date and time; days count from 1900 (which has
    a 29th of February there) or from 1904."""
    if 0 <= value < 1:
        return str(time(*divmod(round(value * 86_400) // 60, 60), round(value * 86_400) % 60)) if round(value * 86_400) < 86_400 else "00:00:00"
    start = datetime(1904, 1, 1) if late else datetime(1899, 12, 30) if value >= 60 else datetime(1899, 12, 31)
    return str(start + timedelta(seconds=round(value * 86_400)))


def _cell(kind: str, style: str, value: str, strings: list[str], dates: list[bool], late: bool) -> str:
    if kind == "inlineStr" or value == "":
        return value
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return str(value != "0")
    if kind != "n":
        return value
    number = float(value) if re.search("[.eE]", value) else int(value)
    return _moment(float(number), late) if int(style) < len(dates) and dates[int(style)] else str(number)


def _rows(p: Package, part: str, strings: list[str], dates: list[bool], late: bool) -> Iterator[list[str]]:
    """The cells' texts of each row. A sheet has several elements a cell with little in each, so no tree is made of them."""
    done: list[list[str]] = []
    cells: list[str] = []
    said: list[str] = []
    depth = row = cell = 0  # those of a row and a cell that are open
    kind, style, inside, seen, reading = "n", "0", False, False, False

    def start(tag: str, about: dict[str, str]) -> None:
        nonlocal depth, row, cell, cells, kind, style, inside, seen, reading
        depth, name = depth + 1, _local(tag)
        if cell:
            reading = False
            if kind != "inlineStr":
                if name == "v" and depth == cell + 1 and not seen:
                    seen = reading = True
            elif depth == cell + 1:
                inside = name == "is"
            else:
                reading = inside and name == "t"
        elif row:
            if name == "c" and depth == row + 1:
                cell, kind, style, inside, seen = depth, about.get("t", "n"), about.get("s", "0"), False, False
        elif name == "row":
            row, cells = depth, []

    def text(x: str) -> None:
        if reading:
            said.append(x)

    def end(tag: str) -> None:
        nonlocal depth, row, cell, reading
        reading = False
        if depth == cell:
            cells.append(_cell(kind, style, "".join(said), strings, dates, late))
            said.clear()
            cell = 0
        elif depth == row:
            done.append(cells)
            row = 0
        depth -= 1

    def unknown(name: str, *_) -> None:
        raise LoadError(f"undefined entity {name}")

    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler, parser.SkippedEntityHandler = start, text, end, unknown
    with p.zip.open(part) as stream:
        while data := stream.read(1 << 16):
            parser.Parse(data, False)
            yield from done
            done.clear()
    parser.Parse(b"", True)
    yield from done


def sheets(p: Package) -> str:
    """For each sheet with anything in it a title line, then its rows: cells that aren't blank, joined."""
    book = next(t for t, kind in p.targets("").values() if kind == "officeDocument") if "_rels/.rels" in p.names else "xl/workbook.xml"
    named, late, targets = [], False, p.targets(book)
    for e in p.events(book, "sheet", "workbookPr"):
        if local(e) == "workbookPr":
            late = e.get("date1904") in ("1", "true")
        elif targets.get(e.get(_ID), ("", ""))[1] == "worksheet":
            named.append((e.get("name", ""), targets[e.get(_ID)][0]))
    of = lambda kind: next((t for t, k in targets.values() if k == kind and t in p.names), None)
    strings = _strings(p, of("sharedStrings")) if of("sharedStrings") else []
    dates = _date_styles(p, of("styles")) if of("styles") else []
    out = []
    for name, part in named:
        rows = filter(None, map(_joined, _rows(p, part, strings, dates, late)))
        first = next(rows, None)
        if first is not None:
            out += [f"{SHEET}{name}", first, *rows]
    return "\n".join(out)


# -- documents --

_RUN = {"tab": "\t", "ptab": "\t", "cr": "\n", "noBreakHyphen": "-"}


def _paragraph(p: Element) -> str:
    """The text of a paragraph's runs, those in links among them."""
    out = []
    for r in [r for k in p for r in ([k] if local(k) == "r" else _kids(k, "r") if local(k) == "hyperlink" else [])]:
        for k in r:
            name = local(k)
            breaks = name == "br" and next((v for a, v in k.attrib.items() if a.endswith("type")), "textWrapping") == "textWrapping"
            out.append(k.text or "" if name == "t" else "\n" if breaks else _RUN.get(name, ""))
    return "".join(out)


def _grid(table: Element) -> Iterator[list[str]]:
    """Rows of cell texts by the columns of the grid: a cell that spans columns comes for each, one that goes on from
    above has the text from there."""
    above: list[str] = []
    for row in _kids(table, "tr"):
        cells: list[str] = []
        for tc in _kids(row, "tc"):
            about = {local(k): k for x in _kids(tc, "tcPr") for k in x}
            said = lambda name: next((v for a, v in about[name].attrib.items() if a.endswith("val")), None) if name in about else ""
            at = len(cells)
            text = above[at] if "vMerge" in about and said("vMerge") != "restart" and at < len(above) else "\n".join(map(_paragraph, _kids(tc, "p")))
            cells += [text] * max(1, int(said("gridSpan") or 1))
        above = cells
        yield cells


def _in_body(p: Package, part: str) -> Iterator[Element]:
    """Children of the body; of a large part nothing is kept behind them."""
    if p.small(part):
        yield from (e for body in fromstring(p.zip.read(part)) for e in body)
        return
    depth = 0
    with p.zip.open(part) as stream:
        for event, e in iterparse(stream, ("start", "end")):
            depth += 1 if event == "start" else -1
            if event == "end" and depth == 2:
                yield e
                e.clear()


def document(p: Package) -> str:
    """The paragraphs of the body that aren't blank, then the rows of its tables."""
    part = next((t for t, kind in p.targets("").values() if kind == "officeDocument"), "word/document.xml")
    paragraphs, rows = [], []
    for e in _in_body(p, part):
        if local(e) == "p" and (text := _paragraph(e)).strip():
            paragraphs.append(text)
        elif local(e) == "tbl":
            rows += [_joined(cells) for cells in _grid(e)]
    return "\n".join(paragraphs + rows)


# -- slides --


def _frame(body: Element | None) -> str:
    """The text of a text body: paragraphs as lines."""
    said = lambda k: "\v" if local(k) == "br" else "".join(t.text or "" for t in _kids(k, "t"))
    return "" if body is None else "\n".join("".join(said(k) for k in p if local(k) in ("r", "br", "fld")) for p in _kids(body, "p"))


def slides(p: Package) -> str:
    """For each slide with anything in it a line with its number, then its shapes' texts and its tables' rows."""
    deck = next((t for t, kind in p.targets("").values() if kind == "officeDocument"), "ppt/presentation.xml")
    targets, out = p.targets(deck), []
    order = [targets[e.get(_ID)][0] for e in p.events(deck, "sldId") if e.get(_ID) in targets]
    for n, part in enumerate(order, 1):
        found = []
        for tree in p.events(part, "spTree"):
            for shape in tree:
                if local(shape) == "sp":
                    found.append(_frame(next(iter(_kids(shape, "txBody")), None)).strip())
                elif local(shape) == "graphicFrame":
                    for table in (t for t in shape.iter() if local(t) == "tbl"):
                        found += [_joined([_frame(next(iter(_kids(tc, "txBody")), None)) for tc in _kids(tr, "tc")]) for tr in _kids(table, "tr")]
        found = [x for x in found if x]
        if found:
            out += [f"{SLIDE}{n}", *found]
    return "\n".join(out)


READERS = {"xlsx": sheets, "xlsm": sheets, "docx": document, "pptx": slides}


def text_of(content: bytes, suffix: str, most: int = MOST) -> str:
    """The text of an office file; whatever is wrong with it is a ``LoadError``."""
    try:
        return READERS[suffix](Package(content, most))
    except LoadError:
        raise
    except Exception as e:  # archives and XML can be broken in many ways
        raise LoadError(f"{type(e).__name__}: {e}") from e
