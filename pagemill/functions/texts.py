"""Plain text, subtitles and images."""

from __future__ import annotations

import html
import re
import struct

from pagemill.functions.blocks import Block, heading, paragraph


def decoded(content: bytes) -> str:
    """Text of unknown encoding: a byte order mark decides, then UTF-8, then the Korean code page, then Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    for name in ("utf-8", "cp949"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


def text_blocks(content: bytes) -> list[Block]:
    text = decoded(content).replace("\r\n", "\n").replace("\r", "\n")
    return [paragraph(p) for p in re.split(r"\n[ \t]*\n", text) if p.strip()]


_CUE = re.compile(r"^\s*(?:(\d+):)?(\d{1,2}):(\d{2})[,.](\d{1,3})\s*-->")


def _clock(seconds: int) -> str:
    return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"


def _said(lines: list[str]) -> str:
    return " ".join(html.unescape(re.sub(r"<[^>]*>|\{\\[^}]*\}", "", " ".join(lines))).split())


def cue_blocks(content: bytes) -> list[Block]:
    """SubRip and WebVTT: a line for each cue, its start first."""
    text = decoded(content).replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
    out: list[Block] = []
    for part in re.split(r"\n[ \t]*\n", text):
        lines = part.strip("\n").split("\n")
        for k, line in enumerate(lines):
            if m := _CUE.match(line):
                start = int(m[1] or 0) * 3600 + int(m[2]) * 60 + int(m[3])
                if said := _said(lines[k + 1 :]):
                    out.append(paragraph(f"[{_clock(start)}] {said}"))
                break
    return out


def sami_blocks(content: bytes) -> list[Block]:
    text = decoded(content)
    out = [heading(" ".join(m[1].split()))] if (m := re.search(r"(?is)<title>(.*?)</title>", text)) and m[1].strip() else []
    for m in re.finditer(r"(?is)<sync[^>]*start\s*=\s*[\"']?(\d+)[^>]*>(.*?)(?=<sync|</body|\Z)", text):
        said = _said([re.sub(r"(?i)<br\s*/?>", " ", m[2])])
        if said := said.replace("\xa0", " ").strip():
            out.append(paragraph(f"[{_clock(int(m[1]) // 1000)}] {said}"))
    return out


# Tags of camera data that are reported.
_TAGS = {0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0132: "DateTime", 0x9003: "DateTimeOriginal"}


def _camera(tiff: bytes) -> dict[str, str]:
    """Camera data of an image; places are left out, they are personal."""
    end = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    found: dict[str, str] = {}
    if not end:
        return found
    todo, seen = [struct.unpack(end + "I", tiff[4:8])[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        for k in range(struct.unpack(end + "H", tiff[at : at + 2])[0]):
            entry = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) < 12:
                break
            tag, kind, n = struct.unpack(end + "HHI", entry[:8])
            value = struct.unpack(end + "I", entry[8:])[0]
            if tag == 0x8769:
                todo.append(value)
            elif tag in _TAGS and kind == 2:
                raw = entry[8 : 8 + n] if n <= 4 else tiff[value : value + n]
                found[_TAGS[tag]] = raw.split(b"\0")[0].decode("latin-1").strip()
            elif tag in _TAGS and kind == 3:
                found[_TAGS[tag]] = str(struct.unpack(end + "H", entry[8:10])[0])
    return found


def image_size(content: bytes) -> tuple[int, int, dict[str, str]] | None:
    if content.startswith(b"\x89PNG") and len(content) >= 24:
        return (*struct.unpack(">II", content[16:24]), {})
    if content.startswith(b"GIF8") and len(content) >= 10:
        return (*struct.unpack("<HH", content[6:10]), {})
    if content.startswith(b"BM") and len(content) >= 26:
        wide, high = struct.unpack("<ii", content[18:26])
        return wide, abs(high), {}
    if content[:4] == b"RIFF" and content[12:16] == b"VP8X" and len(content) >= 30:
        return 1 + int.from_bytes(content[24:27], "little"), 1 + int.from_bytes(content[27:30], "little"), {}
    if content.startswith(b"\xff\xd8"):
        at, camera = 2, {}
        while at + 9 < len(content) and content[at] == 0xFF:
            marker, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
            if marker == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                camera = _camera(content[at + 10 : at + 2 + size])
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                high, wide = struct.unpack(">HH", content[at + 5 : at + 9])
                return wide, high, camera
            at += 2 + size
    return None


def image_blocks(content: bytes, kind: str) -> list[Block]:
    """What can be told without reading the picture itself: format, size, camera data."""
    found = image_size(content)
    lines = [f"Image ({kind.upper()})" + (f", {found[0]} x {found[1]} pixels" if found else "")]
    lines += [f"{k}: {v}" for k, v in sorted(found[2].items())] if found else []
    return [paragraph("\n".join(lines))]
