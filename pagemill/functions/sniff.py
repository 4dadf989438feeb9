"""The kind of a file from its content; its name plays no part.

``kind_of_head`` decides what the first bytes can tell, as one CASE expression that stays in generated code. Packages (ZIP)
and compound files hold several kinds; ``kind_of`` looks inside those, in Python, and is used only for them.
"""

from __future__ import annotations

import io
import lzma
import re
import struct
import zipfile
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD_BYTES = 4096

# Signatures of file formats, in the order they are tried.
SIGNATURES: tuple[tuple[str, str], ...] = (
    ("255044462D", "pdf"),
    ("89504E470D0A1A0A", "png"),
    ("FFD8FF", "jpeg"),
    ("474946383761", "gif"),
    ("474946383961", "gif"),
    ("424D", "bmp"),
    ("49492A00", "tiff"),
    ("4D4D002A", "tiff"),
    ("D0CF11E0A1B11AE1", "ole"),
    ("504B0304", "zip"),
    ("504B0506", "zip"),
)
# How texts of a kind begin, after blanks (lower-cased).
TEXT_PATTERNS: tuple[tuple[str, str], ...] = (
    ("html", r"^[\s\x{FEFF}]*(<!--.*?-->\s*)*<(!doctype html|html|head|body)"),
    ("vtt", r"^\x{FEFF}?webvtt"),
    ("smi", r"^[\s\x{FEFF}]*<sami"),
    ("srt", r"^[\s\x{FEFF}]*[0-9]+[ \t]*\r?\n[0-9]{1,2}:[0-9]{2}:[0-9]{2}[,.][0-9]{1,3}[ \t]*-->"),
    ("xml", r"^[\s\x{FEFF}]*<\?xml"),
)
IMAGES = ("png", "jpeg", "gif", "bmp", "tiff", "webp")


def kind_of_text(text: Column) -> Column:
    """The kind of decoded text."""
    low = F.lower(F.substring(text, 1, HEAD_BYTES))
    case = F.when(text.isNull() | (text == ""), F.lit("empty"))
    for kind, pattern in TEXT_PATTERNS:
        case = case.when(low.rlike("(?s)" + pattern), F.lit(kind))
    return case.otherwise(F.lit("text"))


def kind_of_head(content: Column) -> Column:
    """The kind of binary content; ``zip`` and ``ole`` may be looked into with ``kind_of``."""
    head = F.substring(content, 1, HEAD_BYTES)
    shown = F.hex(F.substring(content, 1, 16))
    case = F.when(content.isNull() | (F.octet_length(content) == 0), F.lit("empty"))
    for signature, kind in SIGNATURES:
        case = case.when(shown.startswith(signature), F.lit(kind))
    case = case.when(shown.startswith("52494646") & (F.substring(shown, 17, 8) == "57454250"), F.lit("webp"))
    case = case.when(shown.startswith("FFFE") | shown.startswith("FEFF"), F.lit("text"))
    # A zero byte marks binary data; all else is text in some encoding.
    plain = kind_of_text(F.decode(head, "ISO-8859-1"))
    bare = F.when(shown.startswith("EFBBBF"), kind_of_text(F.decode(F.substring(content, 4, HEAD_BYTES), "ISO-8859-1"))).otherwise(plain)
    return case.when(F.hex(head).rlike("^(?:..)*?00"), F.lit("unknown")).otherwise(bare)


def kind_of_package(content: bytes) -> str:
    """docx, pptx, xlsx, odt, ods, odp, hwpx, or zip."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            stated = z.read("mimetype").decode("ascii", "replace").strip() if "mimetype" in names else ""
    except (zipfile.BadZipFile, RuntimeError, OSError, NotImplementedError, EOFError, ValueError, struct.error, zlib.error, lzma.LZMAError):
        return "zip"
    # Media types and the parts that tell packages apart.
    for part, kind in (("opendocument.text", "odt"), ("opendocument.spreadsheet", "ods"), ("opendocument.presentation", "odp"), ("hwp+zip", "hwpx")):
        if part in stated:
            return kind
    for part, kind in (("word/document.xml", "docx"), ("ppt/presentation.xml", "pptx"), ("xl/workbook.xml", "xlsx"), ("Contents/section0.xml", "hwpx")):
        if part in names:
            return kind
    return "zip"


def kind_of_compound(content: bytes) -> str:
    from pagemill.functions.compound import Compound

    try:
        names = set(Compound(content).names())
    except (ValueError, IndexError):
        return "ole"
    # The streams that tell compound files apart.
    for stream, kind in (("FileHeader", "hwp"), ("WordDocument", "doc"), ("Workbook", "xls"), ("Book", "xls"), ("PowerPoint Document", "ppt")):
        if stream in names:
            return kind
    return "ole"


_PATTERNS = [(kind, re.compile("(?s)" + p.replace(r"\x{FEFF}", "﻿"))) for kind, p in TEXT_PATTERNS]


def kind_of(content: bytes | None) -> str:
    """The same decision in Python, packages and compound files looked into."""
    if not content:
        return "empty"
    for signature, kind in SIGNATURES:
        if content.startswith(bytes.fromhex(signature)):
            return kind_of_package(content) if kind == "zip" else kind_of_compound(content) if kind == "ole" else kind
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        return "webp"
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "text"
    head = content[:HEAD_BYTES]
    if 0 in head:
        return "unknown"
    low = head.removeprefix(b"\xef\xbb\xbf").decode("latin-1").lower()
    return next((kind for kind, p in _PATTERNS if p.search(low)), "text")
