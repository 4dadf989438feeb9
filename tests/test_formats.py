"""Parsers, the sniffer and archives, on files made in the test."""

from __future__ import annotations

import io
import struct
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.functions.compound import Compound
from pagemill.functions.markup import html_blocks
from pagemill.functions.parse import parse
from pagemill.functions.sniff import kind_of
from pagemill.plans import material
from pagemill.plans.selfcheck import EXPECTED
from pagemill.sources.archives import members
from pagemill.sources.bundle import safe_path

FILES = material.folder()


@pytest.mark.parametrize("path", [p for p in EXPECTED if p in FILES])
def test_each_format(path):
    kind, _, markdown, error = parse(FILES[path])
    assert not error and markdown
    for s in EXPECTED[path][0]:
        if not s.startswith("["):
            assert s in markdown


def test_kind_does_not_follow_the_name():
    assert kind_of(FILES["report.pdf.jpg"]) == "pdf"
    assert kind_of(FILES["page.txt"]) == "html"
    assert [kind_of(FILES[p]) for p in ("docs/minutes.docx", "한글/old.hwp", "old/word.doc", "old/sheet.xls", "old/show.ppt", "한글/new.hwpx", "docs/sheet.ods")] == ["docx", "hwp", "doc", "xls", "ppt", "hwpx", "ods"]
    assert kind_of(b"") == "empty" and kind_of(None) == "empty" and kind_of(b"\x00\x01") == "unknown"


def test_sniffing_in_the_jvm_agrees(spark):
    from pyspark.sql import functions as F

    from pagemill.functions.parse import kinds
    from pagemill.functions.sniff import kind_of_head

    rows = [(p, bytearray(c)) for p, c in FILES.items()] + [("none", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    want = {p: kind_of(c) for p, c in FILES.items()} | {"none": "empty"}
    assert {r["path"]: r["kind"] for r in kinds(df).collect()} == want
    head = {r["path"]: r["k"] for r in df.select("path", kind_of_head(F.col("content")).alias("k")).collect()}
    assert all(head[p] == k for p, k in want.items() if head[p] not in ("zip", "ole"))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=8), st.binary(max_size=9000), min_size=1, max_size=6))
def test_compound_round_trip(streams):
    file = Compound(material.compound_file(streams))
    assert {n: file.read(n) for n in file.names()} == streams


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(sorted(FILES)), st.integers(0, 5000), st.integers(0, 255))
def test_damage_is_reported_and_stops_nothing(path, at, byte):
    data = bytearray(FILES[path])
    if data:
        data[at % len(data)] = byte
        parse(bytes(data))
        parse(bytes(data[: at % len(data)]))


def test_archive_limits():
    found = {name: (data, problem) for name, data, problem in members(FILES["mixed.zip"])}
    assert found["folder/note.txt"][0] == b"in the archive"
    assert found["inner.zip/deep.txt"][0] == b"deep text"
    assert found["../escape.txt"] == (None, "path leaves the archive")
    assert found["bomb.bin"] == (None, "unpacks to too much")
    assert any("한글이름" in n for n in found)
    nested = b"x"
    for _ in range(5):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("in", nested)
        nested = out.getvalue()
    assert any(problem == "nested too deep" for *_, problem in members(nested))


def test_encrypted_is_an_error():
    data = bytearray(material.compound_file({"FileHeader": b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 0x05000300, 2) + bytes(216), "BodyText/Section0": b""}))
    assert parse(bytes(data))[3] == "ValueError: encrypted"


def _sheet(rows: str) -> bytes:
    return material._open("spreadsheet", f'<office:spreadsheet><table:table table:name="s">{rows}</table:table></office:spreadsheet>')


def test_repeated_rows_and_gaps_are_whole():
    cell = lambda t, n=1: f'<table:table-cell table:number-columns-repeated="{n}">{f"<text:p>{t}</text:p>" if t else ""}</table:table-cell>'
    row = lambda cells, n=1: f'<table:table-row table:number-rows-repeated="{n}">{cells}</table:table-row>'
    kind, _, markdown, error = parse(_sheet(row(cell("same"), 5000) + row(cell("a") + cell("", 100) + cell("b", 1500) + cell("", 15000)) + row(cell("", 16384), 1_000_000)))
    lines = [[c.strip() for c in line.split("|")[1:-1]] for line in markdown.split("\n") if line.startswith("| ") and "---" not in line]
    assert kind == "ods" and not error
    assert len(lines) == 5001 and all(c[0] == "same" and not any(c[1:]) for c in lines[:-1])
    assert lines[-1] == ["a", *[""] * 100, *["b"] * 1500]
    # Too much is an error of the document, not a cut.
    for hostile in (row(cell("x", 1000), 1_000_000), row(cell("x", 10**12)), row(cell("x"), 10**12), row(cell("", 10**12) + cell("x")), row(cell("x" * 1000), 1_000_000)):
        assert parse(_sheet(hostile))[2] == "" and "unpacks to too much" in parse(_sheet(hostile))[3]


def _hwp_grid(cells: list[tuple[int, int, str]]) -> bytes:
    rows = [material._record(77, 2, bytes(8))]
    for r, c, text in cells:
        rows += [material._record(72, 2, bytes(8) + struct.pack("<HH", c, r) + bytes(8)), material._record(67, 3, text.encode("utf-16-le"))]
    return material.compound_file({"FileHeader": b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 0x05000300, 0) + bytes(216), "BodyText/Section0": b"".join(rows)})


def test_large_hwp_tables_are_whole():
    kind, _, markdown, error = parse(_hwp_grid([(0, 0, "first"), (5000, 1, "low"), (7, 1500, "right")]))
    assert kind == "hwp" and not error
    lines = [[c.strip() for c in line.split("|")[1:-1]] for line in markdown.split("\n") if line.startswith("| ") and "---" not in line]
    assert [(c.index(next(filter(None, c))), "".join(c)) for c in lines] == [(0, "first"), (1500, "right"), (1, "low")]
    assert "unpacks to too much" in parse(_hwp_grid([(r, 65535, "x") for r in range(600)]))[3]


def test_html_without_end_tags():
    blocks = html_blocks("<table><tr><td>a<td>b<tr><td>c</table><p>x<p>y<h3>z".encode())
    assert blocks[0].rows == (("a", "b"), ("c",))
    assert [(b.kind, b.text) for b in blocks[1:]] == [("paragraph", "x"), ("paragraph", "y"), ("heading", "z")]


@given(st.text(max_size=60), st.one_of(st.none(), st.text(max_size=60)))
def test_places_stay_in_the_bundle(path, member):
    place = safe_path(path or "x", member)
    assert place.endswith(".md") and not place.startswith("/") and ".." not in place.split("/")
    assert all(len(p.encode()) < 256 for p in place.split("/"))


def _pdf(streams: dict[int, tuple[bytes, bytes]], page: bytes = b"/Contents 4 0 R /Resources << /Font << /F1 5 0 R >> /XObject << /X 6 0 R >> >>") -> bytes:
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R " + page + b" >>", 5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    objects |= {n: b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), head, data) for n, (head, data) in streams.items()}
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted(objects.items())) + b"trailer << /Root 1 0 R >>\n%%EOF\n"


def _lzw(data: bytes) -> bytes:
    """As an encoder with early change writes it."""
    table = {bytes([k]): k for k in range(256)}
    bits, wide, size, nxt, now = 0, 0, 9, 258, b""

    def put(code: int) -> None:
        nonlocal bits, wide
        bits, wide = bits << size | code, wide + size

    put(256)
    for k in range(len(data)):
        c = data[k : k + 1]
        if now + c in table:
            now += c
            continue
        put(table[now])
        table[now + c] = nxt
        nxt += 1
        size = max(9, min(12, nxt.bit_length()))
        if nxt == 4094:
            put(256)
            table, nxt, size = {bytes([x]): x for x in range(256)}, 258, 9
        now = c
    if now:
        put(table[now])
        size = max(9, min(12, (nxt + 1).bit_length()))
    put(257)
    return (bits << -wide % 8).to_bytes(-(-wide // 8), "big")


def test_pdf_streams_in_other_forms():
    said = b"".join(b"BT /F1 12 Tf 0 -14 Td (line %d of many) Tj ET\n" % k for k in range(900))
    want = [f"line {k} of many" for k in range(900)]
    rolled = b"".join(bytes([len(said[k : k + 100]) - 1]) + said[k : k + 100] for k in range(0, len(said), 100)) + b"\x80"
    for head, data in ((b"/Filter /LZWDecode", _lzw(said)), (b"/Filter /RunLengthDecode", rolled), (b"/Filter [/ASCIIHexDecode /LZWDecode]", _lzw(said).hex().encode() + b">")):
        kind, _, markdown, error = parse(_pdf({4: (head, data)}))
        assert kind == "pdf" and not error and markdown.split("\n")[2:-1] == want
    from pagemill.functions.pdf import _unrolled

    assert _unrolled(b"\x02abc\xfex\x80zz") == b"abcxxx"


def test_pdf_forms_are_read_and_what_is_not_read_is_an_error():
    form = b"/Type /XObject /Subtype /Form /Resources << /Font << /F1 5 0 R >> /XObject << /X 6 0 R >> >>"
    kind, _, markdown, error = parse(_pdf({4: (b"", b"BT /F1 9 Tf (before) Tj ET /X Do BT (after) Tj ET"), 6: (form, b"BT /F1 9 Tf (in the form) Tj ET /X Do")}))
    assert (kind, error) == ("pdf", "") and markdown == "## Page 1\n\nbefore\nin the form after\n"
    assert "JBIG2Decode" in parse(_pdf({4: (b"/Filter /JBIG2Decode", b"x")}))[3]
    assert "damaged stream" in parse(_pdf({4: (b"/Filter /FlateDecode", b"not packed at all")}))[3]
    assert "damaged stream" in parse(_pdf({4: (b"/Filter /LZWDecode", b"\xff\xf0\x00")}))[3]


def test_one_far_cell_of_an_old_sheet():
    from pagemill.functions.compound import xls

    r = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    head = lambda at: r(0x85, struct.pack("<IBB", at, 0, 0) + b"\x01\x00s")
    begin = r(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    start = len(begin + head(0) + r(0x0A, b""))
    sheet = r(0x809, struct.pack("<HHHHII", 0x600, 0x10, 0, 0, 0, 0)) + r(0x27E, struct.pack("<HHHI", 0, 0, 0, 7 << 2 | 2)) + r(0x27E, struct.pack("<HHHI", 65535, 255, 0, 9 << 2 | 2)) + r(0x0A, b"")
    blocks = xls(material.compound_file({"Workbook": (begin + head(start) + r(0x0A, b"") + sheet).ljust(4096, b"\0")}))
    assert [len(row) for row in blocks[1].rows] == [256, 256] and blocks[1].rows[1][255] == "9"
