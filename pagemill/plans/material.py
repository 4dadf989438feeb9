"""Test material made from nothing but the standard library: a small file of every kind that is read."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib


def compound_file(streams: dict[str, bytes]) -> bytes:
    """A compound file with these streams (``folder/name`` for one level of storages)."""
    size, mini = 512, 64
    entries: list[dict] = [{"name": "Root Entry", "kind": 5, "kids": []}]
    for path, data in streams.items():
        *folder, name = path.split("/")
        parent = 0
        for f in folder:
            found = next((k for k in entries[parent]["kids"] if entries[k]["name"] == f), None)
            if found is None:
                entries.append({"name": f, "kind": 1, "kids": []})
                found = len(entries) - 1
                entries[parent]["kids"].append(found)
            parent = found
        entries.append({"name": name, "kind": 2, "kids": [], "data": data})
        entries[parent]["kids"].append(len(entries) - 1)
    small = bytearray()
    mini_fat: list[int] = []
    for e in entries:
        if e["kind"] == 2 and 0 < len(e["data"]) < 4096:
            first, n = len(mini_fat), -(-len(e["data"]) // mini)
            e["start"] = first
            small += e["data"].ljust(n * mini, b"\0")
            mini_fat += [*range(first + 1, first + n), 0xFFFFFFFE]
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        if not data:
            return 0xFFFFFFFE
        first, n = len(sectors), -(-len(data) // size)
        sectors.extend(data[k * size : (k + 1) * size].ljust(size, b"\0") for k in range(n))
        fat.extend([*range(first + 1, first + n), 0xFFFFFFFE])
        return first

    for e in entries:
        if e["kind"] == 2 and len(e["data"]) >= 4096:
            e["start"] = put(e["data"])
    root_start = put(bytes(small))
    mini_start = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat)) if mini_fat else 0xFFFFFFFE
    n_mini = -(-len(mini_fat) * 4 // size)
    directory = b""
    for k, e in enumerate(entries):
        kids = e["kids"]
        for a, b in zip(kids, kids[1:], strict=False):
            entries[a]["right"] = b
        name = e["name"].encode("utf-16-le") + b"\0\0"
        start = root_start if k == 0 else e.get("start", 0xFFFFFFFE if e["kind"] == 2 else 0)
        length = len(small) if k == 0 else len(e.get("data", b""))
        e["row"] = (name, e["kind"], kids[0] if kids else 0xFFFFFFFF, start, length)
    for e in entries:
        name, kind, child, start, length = e["row"]
        directory += name.ljust(64, b"\0") + struct.pack("<HBBIII", len(name), kind, 1, 0xFFFFFFFF, e.get("right", 0xFFFFFFFF), child) + bytes(36) + struct.pack("<IIQ"[:3], start, length) + bytes(4)
    directory_start = put(directory.ljust(-(-len(directory) // size) * size, b"\0"))
    n_fat = 1
    while (len(fat) + n_fat) * 4 > n_fat * size:
        n_fat += 1
    fat_at = [len(sectors) + k for k in range(n_fat)]
    fat += [0xFFFFFFFD] * n_fat
    raw = struct.pack(f"<{len(fat)}I", *fat).ljust(n_fat * size, b"\xff")
    sectors += [raw[k * size : (k + 1) * size] for k in range(n_fat)]
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<IIIIIIIIII", 0, n_fat, directory_start, 0, 4096, mini_start, n_mini, 0xFFFFFFFE, 0, *fat_at[:1]) + struct.pack("<108I", *(fat_at[1:] + [0xFFFFFFFF] * (109 - n_fat)))
    return head + b"".join(sectors)


def package(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
R = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
O = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:draw="urn:oasis:names:tc:opendocument:xmlns:drawing:1.0"'  # noqa: E741
H = 'xmlns:hs="http://www.hancom.co.kr/hwpml/2011/section" xmlns:hp="http://www.hancom.co.kr/hwpml/2011/paragraph"'


def docx() -> bytes:
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = (
        '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>회의 기록</w:t></w:r></w:p>'
        "<w:p><w:r><w:t>담당자: 김하늘 </w:t></w:r><w:r><w:t>010-</w:t></w:r><w:r><w:t>1234-5678</w:t></w:r></w:p>"
        '<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/></w:numPr></w:pPr><w:r><w:t>first point</w:t></w:r></w:p>'
        f"<w:tbl><w:tr>{cell('품목')}{cell('수량')}</w:tr><w:tr>{cell('연필')}{cell('3')}</w:tr></w:tbl>"
    )
    return package({"[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def pptx() -> bytes:
    slide = lambda t, b: f'<p:sld {A}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{b}</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>'
    return package({
        "ppt/presentation.xml": f'<p:presentation {A}><p:sldIdLst><p:sldId id="1" r:id="r2"/><p:sldId id="2" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships {R}><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/></Relationships>',
        "ppt/slides/slide1.xml": slide("둘째", "last point"),
        "ppt/slides/slide2.xml": slide("첫째", "opening point"),
    })


def xlsx() -> bytes:
    sheet = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>date</t></is></c></row><row r="2"><c r="A2"><v>12.5</v></c><c r="B2" t="b"><v>1</v></c><c r="C2" s="1"><v>45292</v></c></row>'
    return package({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="매출" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {R}><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><r><t>값</t></r><r><t>어치</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>{sheet}</sheetData></worksheet>",
    })


def _open(kind: str, body: str) -> bytes:
    return package({"mimetype": f"application/vnd.oasis.opendocument.{kind}", "content.xml": f"<office:document-content {O}><office:body>{body}</office:body></office:document-content>"})


def odt() -> bytes:
    return _open("text", '<office:text><text:h text:outline-level="2">제목</text:h><text:p>plain<text:s text:c="2"/>text</text:p><text:list><text:list-item><text:p>하나</text:p></text:list-item></text:list></office:text>')


def ods() -> bytes:
    return _open("spreadsheet", '<office:spreadsheet><table:table table:name="표"><table:table-row><table:table-cell table:number-columns-repeated="2"><text:p>x</text:p></table:table-cell><table:table-cell table:number-columns-repeated="1020"/></table:table-row></table:table></office:spreadsheet>')


def odp() -> bytes:
    return _open("presentation", '<office:presentation><draw:page draw:name="p1"><draw:frame><draw:text-box><text:p>slide text</text:p></draw:text-box></draw:frame></draw:page></office:presentation>')


def hwpx() -> bytes:
    p = lambda t: f"<hp:p><hp:run><hp:t>{t}</hp:t></hp:run></hp:p>"
    grid = f"<hp:p><hp:run><hp:tbl><hp:tr><hp:tc><hp:subList>{p('가')}</hp:subList></hp:tc><hp:tc><hp:subList>{p('나')}</hp:subList></hp:tc></hp:tr></hp:tbl></hp:run></hp:p>"
    return package({"mimetype": "application/hwp+zip", "Contents/section0.xml": f"<hs:sec {H}>{p('한글 문서')}{grid}</hs:sec>"})


def _record(tag: int, level: int, body: bytes) -> bytes:
    return struct.pack("<I", tag | level << 10 | len(body) << 20) + body


def hwp(compressed: bool = True) -> bytes:
    text = "첫 문단\t끝"
    units = b"".join(struct.pack("<H", 9) + bytes(14) if c == "\t" else c.encode("utf-16-le") for c in text) + struct.pack("<H", 13)
    section = _record(66, 0, bytes(22)) + _record(67, 1, units) + _record(66, 0, bytes(22)) + _record(67, 1, "성명: 이바다\r".encode("utf-16-le"))
    section += _record(77, 2, bytes(22))
    for column, cell in enumerate(("표1", "표2")):
        section += _record(72, 2, bytes(8) + struct.pack("<HH", column, 0) + bytes(10)) + _record(66, 2, bytes(22)) + _record(67, 3, (cell + "\r").encode("utf-16-le"))
    section += _record(66, 0, bytes(22)) + _record(67, 1, "끝 문단\r".encode("utf-16-le"))
    if compressed:
        c = zlib.compressobj(9, zlib.DEFLATED, -15)
        section = c.compress(section) + c.flush()
    return compound_file({"FileHeader": b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 0x05000300, int(compressed)) + bytes(216), "BodyText/Section0": section})


def doc() -> bytes:
    one, two = "Old Word text\r", "한글 문단\rA\x07B\x07\x07after\r"
    head = bytearray(0x400)
    struct.pack_into("<HH", head, 0, 0xA5EC, 0xC1)
    struct.pack_into("<H", head, 10, 0x200)
    struct.pack_into("<I", head, 0x4C, len(one) + len(two))
    wide_at = 0x400 + len(one) + len(one) % 2
    pieces = struct.pack("<III", 0, len(one), len(one) + len(two)) + struct.pack("<HIH", 0, 0x40000000 | 0x400 * 2, 0) + struct.pack("<HIH", 0, wide_at, 0)
    clx = b"\x02" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<II", head, 0x1A2, 0, len(clx))
    body = bytes(head) + one.encode("cp1252") + bytes(len(one) % 2) + two.encode("utf-16-le")
    return compound_file({"WordDocument": body.ljust(4096, b"\0"), "1Table": clx})


def xls() -> bytes:
    r = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    begin = r(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    text = "이름".encode("utf-16-le")
    # The second string is cut by a continuation, and goes on in narrow characters.
    sst = r(0xFC, struct.pack("<II", 2, 2) + struct.pack("<HB", 2, 1) + text + struct.pack("<HB", 6, 1) + "abc".encode("utf-16-le")) + r(0x3C, b"\0def")
    xf = r(0xE0, struct.pack("<HH", 0, 0) + bytes(16)) + r(0xE0, struct.pack("<HH", 0, 14) + bytes(16))
    name = "시트".encode("utf-16-le")
    sheet_head = lambda at: r(0x85, struct.pack("<IBB", at, 0, 0) + struct.pack("<BB", 2, 1) + name)
    start = len(begin + xf + sheet_head(0) + sst + r(0x0A, b""))
    sheet = r(0x809, struct.pack("<HHHHII", 0x600, 0x10, 0, 0, 0, 0)) + r(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + r(0xFD, struct.pack("<HHHI", 0, 1, 0, 1))
    sheet += r(0x203, struct.pack("<HHHd", 1, 0, 1, 45292.0)) + r(0x27E, struct.pack("<HHHI", 1, 1, 0, 42 << 2 | 2)) + r(0x0A, b"")
    return compound_file({"Workbook": (begin + xf + sheet_head(start) + sst + r(0x0A, b"") + sheet).ljust(4096, b"\0")})


def ppt() -> bytes:
    atom = lambda kind, body, inst=0: struct.pack("<HHI", inst << 4, kind, len(body)) + body
    box = lambda kind, body: struct.pack("<HHI", 15, kind, len(body)) + body
    texts = atom(1011, bytes(20)) + atom(3999, struct.pack("<I", 0)) + atom(4000, "발표 제목".encode("utf-16-le")) + atom(3999, struct.pack("<I", 1)) + atom(4008, b"first line\rsecond line")
    return compound_file({"PowerPoint Document": box(1000, box(4080, texts) + box(4080, b"")) + box(1006, b"") + box(1016, box(1036, atom(4008, b"master text"))), "Current User": b"\0" * 20})


def pdf(compress: bool = True, text: bool = True) -> bytes:
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0001> <0002> <AC00> endbfrange 1 beginbfchar <0003> <B098> endbfchar"
    page = b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\)) Tj 0 -14 Td [(spa) -300 (ced)] TJ ET BT /F2 12 Tf 72 600 Td <00010003> Tj ET" if text else b"q 10 0 0 10 0 0 cm Q"

    def stream(data: bytes) -> bytes:
        z = zlib.compress(data) if compress else data
        return b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(z), b" /Filter /FlateDecode" if compress else b"", z)

    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>",
        stream(page),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>",
        stream(cmap),
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF\n"


def png() -> bytes:
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0" * 20)) + part(b"IEND", b"")


def jpeg() -> bytes:
    when = b"2024:05:06 07:08:09\0"
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x0132, 2, len(when), 26) + struct.pack("<I", 0) + when
    exif = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 48, 64, 0) + b"\xff\xd9"


HTML = '<!doctype html><html><head><title>웹 문서</title><script>var t="</p>";</script></head><body><nav>menu</nav><h1>제목 &amp; 부제</h1><p>문의 <b>010</b>-9876-5432<p>open paragraph<ul><li>one<ul><li>two</ul></ul><table><tr><th>a<th>b<tr><td>1<td>2</table></body>'.encode()
SRT = "1\n00:00:01,000 --> 00:00:02,000\n<i>안녕</i>하세요\n\n2\n00:01:05,500 --> 00:01:06,000\nbye\n".encode()
VTT = b"WEBVTT\n\nintro\n00:01.000 --> 00:02.000 align:start\nhello &amp; welcome\n"
SMI = "<SAMI><HEAD><TITLE>자막</TITLE></HEAD><BODY><SYNC Start=1500><P>첫 줄<br>둘째<SYNC Start=3000><P>&nbsp;</BODY></SAMI>".encode("cp949")


def archive() -> bytes:
    inner = package({"deep.txt": "deep text"})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("folder/note.txt", "in the archive")
        z.writestr("inner.zip", inner)
        z.writestr("../escape.txt", "outside")
        z.writestr("bomb.bin", bytes(4 << 20))
        old = zipfile.ZipInfo("placeholder")
        z.writestr(old, "korean name")
    # A name in the Korean code page, without the UTF-8 flag.
    return out.getvalue().replace(b"placeholder", "한글이름x.t".encode("cp949").ljust(11, b"t"))


def folder() -> dict[str, bytes]:
    """Path -> content of a mixed folder; several names tell the wrong kind."""
    return {
        "docs/minutes.docx": docx(),
        "docs/slides.pptx": pptx(),
        "docs/sales.xlsx": xlsx(),
        "docs/text.odt": odt(),
        "docs/sheet.ods": ods(),
        "docs/show.odp": odp(),
        "한글/new.hwpx": hwpx(),
        "한글/old.hwp": hwp(),
        "한글/plain.hwp": hwp(False),
        "old/word.doc": doc(),
        "old/sheet.xls": xls(),
        "old/show.ppt": ppt(),
        "report.pdf.jpg": pdf(),
        "plain.pdf": pdf(False),
        "scan.pdf": pdf(text=False),
        "page.txt": HTML,
        "movie.srt": SRT,
        "movie.vtt": VTT,
        "movie.smi": SMI,
        "photo.png": png(),
        "photo.jpg": jpeg(),
        "mixed.zip": archive(),
        "_memo.txt": "성명: 박구름 계좌 국민은행 123456-01-234567".encode(),
        ".hidden.txt": "옛 글".encode("cp949"),
        "empty.txt": b"",
        "~$lock.docx": b"lock",
        "broken.docx": b"PK\x03\x04 broken",
        "unknown.bin": b"\x00\x01\x02\x03",
    }
