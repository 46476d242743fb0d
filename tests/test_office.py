"""Office files, tables and encodings, made here part by part, and what is read from them."""

import io
import zipfile

import pytest
from fathom.sources import files, office
from fathom.sources.make import docx, pptx, xlsx

R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def rels(**targets):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{R}/{kind}" Target="{t}"/>' for i, (kind, t) in targets.items()) + "</Relationships>"


def book(sheets, strings=(), formats="", styles=(), late=False):
    parts = {
        "_rels/.rels": rels(a=("officeDocument", "/xl/workbook.xml")),
        "xl/workbook.xml": f'<workbook xmlns:r="{R}"><workbookPr {"date1904=" + chr(34) + "1" + chr(34) if late else ""}/><sheets>' + "".join(f'<sheet name="{n}" r:id="s{i}"/>' for i, (n, _) in enumerate(sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": rels(**{f"s{i}": ("worksheet" if rows is not None else "chartsheet", f"worksheets/s{i}.xml") for i, (_, rows) in enumerate(sheets)}, t=("sharedStrings", "strings.xml"), y=("styles", "styles.xml")),
        "xl/strings.xml": "<sst>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>",
        "xl/styles.xml": f"<styleSheet><numFmts>{formats}</numFmts><cellXfs>" + "".join(f'<xf numFmtId="{n}"/>' for n in styles) + "</cellXfs></styleSheet>",
    }
    return archive(parts | {f"xl/worksheets/s{i}.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>" for i, (_, rows) in enumerate(sheets) if rows is not None})


def test_cells_of_all_kinds():
    cells = '<row r="2"><c r="C2" t="s"><v>0</v></c><c r="F2" t="s"><v>1</v></c><c r="G2"/></row><row r="4"><c t="n"><v>12</v></c><c><v>1.50</v></c><c><v>1E+3</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><f>A1</f><v> made </v></c></row>'
    more = '<row><c s="1"><v>45000</v></c><c s="1"><v>45000.5</v></c><c s="2"><v>0.25</v></c><c s="3"><v>7</v></c><c s="4"><v>59</v></c><c s="9"><v>3</v></c><c t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c t="s"><v>2</v></c></row><row><c t="s"><v>2</v></c></row>'
    strings = ["<t>plain &amp; simple</t>", "<r><t>two </t></r><r><t>runs</t></r><rPh><t>no</t></rPh>", "<t> </t>"]
    formats = '<numFmt numFmtId="164" formatCode="[Red]0.0&quot;day&quot;"/><numFmt numFmtId="165" formatCode="yyyy\\-mm"/>'
    got = office.text_of(book([("One", cells), ("empty", "<row><c/></row>"), ("chart", None), ("Two", more)], strings, formats, (0, 14, 20, 164, 165)), "xlsx")
    assert got.split("\n") == ["工作表：One", "plain & simple | two runs", "12 | 1.5 | 1000.0 | True | #N/A | made", "工作表：Two", "2023-03-15 00:00:00 | 2023-03-15 12:00:00 | 06:00:00 | 7 | 1900-02-28 00:00:00 | 3 | inline"]
    assert office.text_of(book([("d", '<row><c s="1"><v>1</v></c></row>')], styles=(0, 14), late=True), "xlsm").endswith("1904-01-02 00:00:00")


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_paragraphs_then_tables():
    p = lambda *runs: "<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in runs) + "</w:p>"
    cell = lambda text, about="": f"<w:tc><w:tcPr>{about}</w:tcPr>{p(text)}</w:tc>"
    table = "<w:tbl><w:tr>" + cell("a", '<w:vMerge w:val="restart"/>') + cell("wide", '<w:gridSpan w:val="2"/>') + "</w:tr><w:tr>" + cell("", "<w:vMerge/>") + cell(" b ") + cell("") + "</w:tr></w:tbl>"
    body = p("one ", "two") + table + "<w:p><w:pPr/></w:p>" + '<w:p><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:tab/><w:t>x</w:t><w:br/><w:t>y</w:t><w:br w:type="page"/><w:noBreakHyphen/></w:r><w:ins><w:r><w:t>no</w:t></w:r></w:ins></w:p><w:sectPr/>'
    parts = {"_rels/.rels": rels(a=("officeDocument", "word/document.xml")), "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"}
    assert office.text_of(archive(parts), "docx") == "one two\nlink\tx\ny-\na | wide | wide\na | b"


def test_slides_in_their_order():
    a = 'xmlns:a="a" xmlns:p="p"'
    text = lambda *ps: "<p:txBody>" + "".join(f"<a:p>{x}</a:p>" for x in ps) + "</p:txBody>"
    run = lambda t: f"<a:r><a:t>{t}</a:t></a:r>"
    slide = lambda shapes: f"<p:sld {a}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"
    table = "<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr><a:tc>" + text(run("k")) + "</a:tc><a:tc>" + text(run(" v ")) + "</a:tc><a:tc/></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    parts = {
        "_rels/.rels": rels(a=("officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="{R}"><p:sldIdLst><p:sldId r:id="x"/><p:sldId r:id="y"/><p:sldId r:id="z"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(x=("slide", "slides/slide2.xml"), y=("slide", "slides/slide1.xml"), z=("slide", "slides/slide3.xml")),
        "ppt/slides/slide1.xml": slide("<p:sp/><p:pic/>"),
        "ppt/slides/slide2.xml": slide("<p:sp>" + text(run("Title") + "<a:br/>" + run("more"), run("line")) + "</p:sp><p:grpSp><p:sp>" + text(run("grouped")) + "</p:sp></p:grpSp>" + table),
        "ppt/slides/slide3.xml": slide("<p:sp>" + text(run("end")) + "</p:sp>"),
    }
    assert office.text_of(archive(parts), "pptx") == "幻灯片 1\nTitle\vmore\nline\nk | v\n幻灯片 3\nend"


def test_what_is_wrong_is_said(spark, tmp_path):
    good = docx(["first", "second"])
    for name, data in {"a.docx": good, "b.docx": good[:40], "c.xlsx": b"nothing", "d.pptx": archive({"x": "y"}), "e.xlsx": xlsx([["a", "b"], ["c"]]), "f.pptx": pptx(["s"]), "g.txt": "été".encode("utf-8-sig"), "h.txt": b"\xff\xfe\xfd", "i.doc": b"old", "j.txt": b" \n", "k.csv": b'a,"b\nc",\n,\n"d ""q""",e'}.items():
        (tmp_path / name).write_bytes(data)
    found = files.scan(spark, [str(tmp_path)], ("docx", "xlsx", "pptx", "txt", "csv", "doc"))
    got = {r["path"].rsplit("/", 1)[1]: (r["content"], r["error"] is not None) for r in files.read(found).collect()}
    assert got == {"a.docx": ("first\nsecond", False), "b.docx": (None, True), "c.xlsx": (None, True), "d.pptx": (None, True), "e.xlsx": ("工作表：Sheet\na | b\nc", False), "f.pptx": ("幻灯片 1\ns", False), "g.txt": ("été", False), "h.txt": (None, True), "i.doc": (None, True), "j.txt": ("", False), "k.csv": ('a | b\nc\nd "q" | e', False)}
    assert {r["path"].rsplit("/", 1)[1] for r in files.load(found).collect()} == {"a.docx", "e.xlsx", "f.pptx", "g.txt", "k.csv"}
    with pytest.raises(office.LoadError, match="b.docx"):
        files.load_all(found)
    with pytest.raises(office.LoadError, match="no file"):
        files.load_all(found.where("path like '%j.txt'"))
    assert files.load_all(found.where("path like '%.docx' and path not like '%b.docx'")).count() == 1
    assert files.exists(spark, [str(tmp_path), str(tmp_path / "none")]) == {str(tmp_path): True, str(tmp_path / "none"): False}


def test_a_bomb_is_refused():
    with pytest.raises(office.LoadError, match="inflated"):
        office.text_of(archive({"word/document.xml": "x" * 2_000_000}), "docx", most=1_000_000)


@pytest.mark.parametrize("name,text", [("gbk", "这是一个测试"), ("gb18030", "測試 €"), ("utf-16", "naïve 日本"), ("cp1252", "café crème à la carte, déjà vu"), ("cp1251", "привет, мир, как дела"), ("utf-32", "x日")])
def test_encodings(name, text):
    data = text.encode(name)
    assert files.detected(data) == text
    assert files.detected(b"\xff\xff\xff\x00\x01\x02\xff") is None


def test_tables_with_and_without_quotes_agree(spark):
    texts = ['a,b , c\r\n,,\r\nd', "x\ry,z", " \n , \n", "", "one"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r["x"] for r in rows.select("i", files.csv_text(rows["t"]).alias("x")).orderBy("i").collect()] == [files.rows_of(t) for t in texts]
