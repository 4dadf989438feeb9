"""What conversions must give, written by hand from what the test material says, as rows for SQL.

Nothing here is computed by the code under test.
"""

from __future__ import annotations

# Fixed values: (path, kind, title, masked Markdown) of the test folder's documents, by format.
DOCUMENTS: dict[str, list[tuple[str, str, str, str]]] = {
    "parse_hwp": [
        ("한글/old.hwp", "hwp", "첫 문단 끝", "첫 문단\t끝\n\n성명: [NAME]\n\n| 표1 | 표2 |\n| --- | --- |\n\n끝 문단\n"),
        ("한글/plain.hwp", "hwp", "첫 문단 끝", "첫 문단\t끝\n\n성명: [NAME]\n\n| 표1 | 표2 |\n| --- | --- |\n\n끝 문단\n"),
    ],
    "parse_hwpx": [("한글/new.hwpx", "hwpx", "한글 문서", "한글 문서\n\n| 가 | 나 |\n| --- | --- |\n")],
    "parse_docx": [("docs/minutes.docx", "docx", "회의 기록", "# 회의 기록\n\n담당자: [NAME] [PHONE]\n\n- first point\n\n| 품목 | 수량 |\n| --- | --- |\n| 연필 | 3 |\n")],
    "parse_doc": [("old/word.doc", "doc", "Old Word text", "Old Word text\n\n한글 문단\n\n| A | B |\n| --- | --- |\n\nafter\n")],
    "parse_pptx": [("docs/slides.pptx", "pptx", "첫째", "## 첫째\n\n- opening point\n\n## 둘째\n\n- last point\n")],
    "parse_ppt": [("old/show.ppt", "ppt", "Slide 1", "## Slide 1\n\n### 발표 제목\n\nfirst line\n\nsecond line\n")],
    "parse_xlsx": [("docs/sales.xlsx", "xlsx", "매출", "## 매출\n\n| 값어치 |  | date |\n| --- | --- | --- |\n| 12.5 | TRUE | 2024-01-01 |\n")],
    "parse_xls": [("old/sheet.xls", "xls", "시트", "## 시트\n\n| 이름 | abcdef |\n| --- | --- |\n| 2024-01-01 | 42 |\n")],
    "parse_opendocument": [
        ("docs/text.odt", "odt", "제목", "## 제목\n\nplain  text\n\n- 하나\n"),
        ("docs/sheet.ods", "ods", "표", "## 표\n\n| x | x |\n| --- | --- |\n"),
        ("docs/show.odp", "odp", "p1", "## p1\n\nslide text\n"),
    ],
    "parse_pdf": [
        ("report.pdf.jpg", "pdf", "Page 1", "## Page 1\n\nHello (PDF)\nspa ced\n가나\n"),
        ("plain.pdf", "pdf", "Page 1", "## Page 1\n\nHello (PDF)\nspa ced\n가나\n"),
        ("scan.pdf", "pdf", "Page 1", "## Page 1\n\n(no text layer)\n"),
    ],
    "parse_subtitles": [
        ("movie.srt", "srt", "[00:00:01] 안녕하세요", "[00:00:01] 안녕하세요\n\n[00:01:05] bye\n"),
        ("movie.vtt", "vtt", "[00:00:01] hello & welcome", "[00:00:01] hello & welcome\n"),
        ("movie.smi", "smi", "자막", "# 자막\n\n[00:00:01] 첫 줄 둘째\n"),
    ],
    "parse_photos": [
        ("photo.png", "png", "Image (PNG), 3 x 2 pixels", "Image (PNG), 3 x 2 pixels\n"),
        ("photo.jpg", "jpeg", "Image (JPEG), 64 x 48 pixels DateTime: 2024:05:06 07:08:09", "Image (JPEG), 64 x 48 pixels\nDateTime: 2024:05:06 07:08:09\n"),
    ],
    "parse_texts": [
        ("_memo.txt", "text", "성명: [NAME] 계좌 국민은행 [ACCOUNT]", "성명: [NAME] 계좌 국민은행 [ACCOUNT]\n"),
        (".hidden.txt", "text", "옛 글", "옛 글\n"),
        ("empty.txt", "empty", "", ""),
    ],
}

# Fixed values: (id, page, Markdown).
PAGES: list[tuple[int, str, str]] = [
    (1, "<!doctype html><p>&copy; 2024 &middot; A&nbsp;B</p>", "© 2024 · A B\n"),
    (2, "<!doctype html><ol><li>a<li>b<ul><li>c</ul></ol><p>d", "- a\n- b\n  - c\n\nd\n"),
    (3, "<!doctype html><table><tr><td>a|b</td><td>c</td></tr><tr><td>1</td></tr></table>", "| a\\|b | c |\n| --- | --- |\n| 1 |  |\n"),
    (4, "<html><head><title>A &amp; B</title></head><body><p>x", "# A & B\n\nx\n"),
    (5, "<html><style>p{}</style><h2>H</h2><nav>n</nav><p>a<br>b</p><footer>f</footer><script>1<2</script>", "## H\n\na\nb\n"),
    (6, "<html><p><img alt='pic' src=x> y</p>", "![pic] y\n"),
    (7, "<!-- c --><html><div>one</div><div>two <b>three</b></div>", "one\n\ntwo three\n"),
    (8, "<html><h1>T</h1><p>call 010-12<b>34</b>-5678 now", "# T\n\ncall [PHONE] now\n"),
    (9, "<html><table><tr><th>성명<th>박구름<tr><td>k<td>v</table>tail", "| 성명 | [NAME] |\n| --- | --- |\n| k | v |\n\ntail\n"),
    (10, "<html><ul><li>one<ul><li>two<ul><li>three</ul></ul><li>four</ul>", "- one\n  - two\n    - three\n- four\n"),
]

# Fixed values: (rule, id, text, masked text).
MASKED: list[tuple[str, int, str, str]] = [
    ("name", 1, "이름: 홍길동, 담당자 김하늘", "이름: [NAME], 담당자 [NAME]"),
    ("name", 2, "| 성명 | 박구름 |", "| 성명 | [NAME] |"),
    ("name", 3, "예금주：남궁하늘", "예금주：[NAME]"),
    ("name", 4, "이름표를 달고", "이름표를 달고"),
    ("name", 5, "대표자: Kim", "대표자: Kim"),
    ("phone", 6, "전화 010-1234-5678번", "전화 [PHONE]번"),
    ("phone", 7, "가01012345678나", "가[PHONE]나"),
    ("phone", 8, "02-123-4567 / 031-1234-5678", "[PHONE] / [PHONE]"),
    ("phone", 9, "+82 10-1234-5678", "[PHONE]"),
    ("phone", 10, "(02) 123-4567, 070.1234.5678", "[PHONE], [PHONE]"),
    ("phone", 11, "011 234 5678 019-123-4567", "[PHONE] [PHONE]"),
    ("phone", 12, "+1 (555) 123-4567", "[PHONE]"),
    ("phone", 13, "2024-01-02 12345 1588-1234", "2024-01-02 12345 1588-1234"),
    ("account", 14, "4465758382889437 4465758382889437", "[ACCOUNT] [ACCOUNT]"),
    ("account", 15, "1234-5678-9012-3456.", "[ACCOUNT]."),
    ("account", 16, "국민은행 123456-01-234567 입금", "국민은행 [ACCOUNT] 입금"),
    ("account", 17, "계좌번호: 110-123-456789", "계좌번호: [ACCOUNT]"),
    ("account", 18, "44657583828894370", "44657583828894370"),
    ("resident_number", 19, "주민 900101-1234567", "주민 [RRN]"),
    ("resident_number", 20, "900101 - 2234567번", "[RRN]번"),
    ("email", 21, "a.b@c.co.kr, x+y@d.org", "[EMAIL], [EMAIL]"),
    ("email", 22, "@home user@host", "@home user@host"),
    ("ip", 23, "host 192.168.0.1:80", "host [IP]:80"),
    ("none", 24, "", ""),
]

# The listing of the test folder; links, lock files and the folder of results are left out.
LISTING: list[tuple[str, str]] = [
    (".hidden.txt", "text"),
    ("_memo.txt", "text"),
    ("broken.docx", "zip"),
    ("docs/minutes.docx", "docx"),
    ("docs/sales.xlsx", "xlsx"),
    ("docs/sheet.ods", "ods"),
    ("docs/show.odp", "odp"),
    ("docs/slides.pptx", "pptx"),
    ("docs/text.odt", "odt"),
    ("empty.txt", "empty"),
    ("mixed.zip", "zip"),
    ("movie.smi", "smi"),
    ("movie.srt", "srt"),
    ("movie.vtt", "vtt"),
    ("old/sheet.xls", "xls"),
    ("old/show.ppt", "ppt"),
    ("old/word.doc", "doc"),
    ("page.txt", "html"),
    ("photo.jpg", "jpeg"),
    ("photo.png", "png"),
    ("plain.pdf", "pdf"),
    ("report.pdf.jpg", "pdf"),
    ("scan.pdf", "pdf"),
    ("unknown.bin", "unknown"),
    ("한글/new.hwpx", "hwpx"),
    ("한글/old.hwp", "hwp"),
    ("한글/plain.hwp", "hwp"),
]

# Fixed values: (path, member, length, problem) inside the archives of the test folder.
MEMBERS: list[tuple[str, str, int, str | None]] = [
    ("mixed.zip", "../escape.txt", 0, "path leaves the archive"),
    ("mixed.zip", "bomb.bin", 0, "unpacks to too much"),
    ("mixed.zip", "folder/note.txt", 14, None),
    ("mixed.zip", "inner.zip/deep.txt", 9, None),
    ("mixed.zip", "한글이름x.t", 11, None),
    ("broken.docx", "", 0, "damaged archive: File is not a zip file"),
]

# Fixed values: (kind, files) that a conversion of the test folder would meet; two members have no content.
SKIM: list[tuple[str, int]] = [
    ("text", 5), ("empty", 4), ("unknown", 1), ("html", 1), ("pdf", 3), ("docx", 1), ("pptx", 1), ("xlsx", 1), ("odt", 1), ("ods", 1), ("odp", 1),
    ("hwpx", 1), ("hwp", 2), ("doc", 1), ("xls", 1), ("ppt", 1), ("srt", 1), ("vtt", 1), ("smi", 1), ("png", 1), ("jpeg", 1),
]

# INDEX.md of the test folder, without blank lines.
INDEX: list[str] = [
    "# INDEX",
    "> 개인정보 가리기는 완벽하지 않으므로 공개하기 전에 사람이 확인해야 합니다. / Masking is not perfect; check before publishing.",
    "## .",
    "- [옛 글](.hidden.txt.md) (text, 4 characters)",
    "- [성명: \\[NAME\\] 계좌 국민은행 \\[ACCOUNT\\]](_memo.txt.md) (text, 29 characters)",
    "- [broken.docx](broken.docx.md) — not converted: damaged archive: File is not a zip file",
    "- [empty.txt](empty.txt.md) (empty, 0 characters)",
    "- [자막](movie.smi.md) (smi, 24 characters)",
    "- [\\[00:00:01\\] 안녕하세요](movie.srt.md) (srt, 33 characters)",
    "- [\\[00:00:01\\] hello & welcome](movie.vtt.md) (vtt, 27 characters)",
    "- [제목 & 부제](page.txt.md) (html, 88 characters)",
    "- [Image (JPEG), 64 x 48 pixels DateTime: 2024:05:06 07:08:09](photo.jpg.md) (jpeg, 59 characters)",
    "- [Image (PNG), 3 x 2 pixels](photo.png.md) (png, 26 characters)",
    "- [Page 1](plain.pdf.md) (pdf, 34 characters)",
    "- [Page 1](report.pdf.jpg.md) (pdf, 34 characters)",
    "- [Page 1](scan.pdf.md) (pdf, 27 characters)",
    "- [unknown.bin](unknown.bin.md) — not converted: no parser for unknown",
    "## docs",
    "- [회의 기록](docs/minutes.docx.md) (docx, 82 characters)",
    "- [매출](docs/sales.xlsx.md) (xlsx, 74 characters)",
    "- [표](docs/sheet.ods.md) (ods, 30 characters)",
    "- [p1](docs/show.odp.md) (odp, 18 characters)",
    "- [첫째](docs/slides.pptx.md) (pptx, 44 characters)",
    "- [제목](docs/text.odt.md) (odt, 25 characters)",
    "## mixed.zip",
    "- [bomb.bin](mixed.zip/bomb.bin.md) — not converted: unpacks to too much",
    "- [escape.txt](mixed.zip/escape.txt.md) — not converted: path leaves the archive",
    "- [korean name](mixed.zip/한글이름x.t.md) (text, 12 characters)",
    "## mixed.zip/folder",
    "- [in the archive](mixed.zip/folder/note.txt.md) (text, 15 characters)",
    "## mixed.zip/inner.zip",
    "- [deep text](mixed.zip/inner.zip/deep.txt.md) (text, 10 characters)",
    "## old",
    "- [시트](old/sheet.xls.md) (xls, 57 characters)",
    "- [Slide 1](old/show.ppt.md) (ppt, 47 characters)",
    "- [Old Word text](old/word.doc.md) (doc, 53 characters)",
    "## 한글",
    "- [한글 문서](한글/new.hwpx.md) (hwpx, 31 characters)",
    "- [첫 문단 끝](한글/old.hwp.md) (hwp, 52 characters)",
    "- [첫 문단 끝](한글/plain.hwp.md) (hwp, 52 characters)",
]

# Fixed values: (path, Markdown) of some files of a bundle that was made again with masking off.
UNMASKED: list[tuple[str, str]] = [
    ("old/word.doc.md", "Old Word text\n\n한글 문단\n\n| A | B |\n| --- | --- |\n\nafter\n"),
    ("movie.smi.md", "# 자막\n\n[00:00:01] 첫 줄 둘째\n"),
    ("mixed.zip/folder/note.txt.md", "in the archive\n"),
    ("한글/old.hwp.md", "첫 문단\t끝\n\n성명: 이바다\n\n| 표1 | 표2 |\n| --- | --- |\n\n끝 문단\n"),
]


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else f"CAST({value} AS BIGINT)"


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of these rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) t({columns})"
