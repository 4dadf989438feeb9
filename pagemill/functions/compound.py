"""Compound files (OLE) and the four binary kinds in them: hwp, doc, xls and ppt."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

from pagemill.functions.blocks import Block, heading, paragraph, table
from pagemill.functions.packages import MOST_BYTES, bounded, shown_number

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE


class Compound:
    """Streams of a compound file by path."""

    def __init__(self, data: bytes):
        if data[:8] != bytes.fromhex("D0CF11E0A1B11AE1") or len(data) < 512:
            raise ValueError("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if not 7 <= shift <= 16 or not 4 <= mini_shift <= shift:
            raise ValueError("odd sector sizes")
        self.size, self.mini = 1 << shift, 1 << mini_shift
        n_fat, root, self.cutoff, mini_fat, _, more, n_more = struct.unpack_from("<I", data, 44) + struct.unpack_from("<I", data, 48) + struct.unpack_from("<I", data, 56) + struct.unpack_from("<IIII", data, 60)
        fat_at = list(struct.unpack_from("<109I", data, 76))
        seen: set[int] = set()
        while more not in (FREE, END) and more not in seen and len(seen) <= n_more:
            seen.add(more)
            ids = struct.unpack(f"<{self.size // 4}I", self._sector(more).ljust(self.size, b"\xff"))
            fat_at += ids[:-1]
            more = ids[-1]
        self.fat = [x for s in fat_at[:n_fat] if s < END - 2 for x in struct.unpack(f"<{self.size // 4}I", self._sector(s).ljust(self.size, b"\xff"))]
        raw = self._chain(root)
        self.entries: list[tuple] = []
        for k in range(0, len(raw) - 127, 128):
            n = struct.unpack_from("<H", raw, k + 64)[0]
            name = raw[k : k + max(0, min(n, 64) - 2)].decode("utf-16-le", "replace")
            left, right, child = struct.unpack_from("<III", raw, k + 68)
            self.entries.append((name, raw[k + 66], left, right, child, *struct.unpack_from("<II", raw, k + 116)))
        if not self.entries:
            raise ValueError("no directory")
        mini = self._chain(mini_fat) if mini_fat not in (FREE, END) else b""
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini[: len(mini) // 4 * 4])
        self.mini_data = self._chain(self.entries[0][5]) if self.entries[0][5] not in (FREE, END) else b""
        self.paths: dict[str, int] = {}
        self._walk(self.entries[0][4], "", set())

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size]

    def _chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < END - 2 and n not in seen and n < len(self.fat):
            seen.add(n)
            out.append(self._sector(n))
            n = self.fat[n]
        return b"".join(out)

    def _walk(self, n: int, folder: str, seen: set[int]) -> None:
        todo = [n]
        while todo:
            n = todo.pop()
            if n >= len(self.entries) or n in seen:
                continue
            seen.add(n)
            name, kind, left, right, child, *_ = self.entries[n]
            todo += [left, right]
            if kind == 1:
                self._walk(child, f"{folder}{name}/", seen)
            elif kind == 2:
                self.paths[folder + name] = n

    def names(self) -> list[str]:
        return list(self.paths)

    def read(self, path: str) -> bytes:
        if path not in self.paths:
            return b""
        *_, start, size = self.entries[self.paths[path]]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = [], set()
        while start < END - 2 and start not in seen and start < len(self.mini_fat):
            seen.add(start)
            out.append(self.mini_data[start * self.mini : (start + 1) * self.mini])
            start = self.mini_fat[start]
        return b"".join(out)[:size]


def inflated(data: bytes) -> bytes:
    d = zlib.decompressobj(-15)
    out = d.decompress(data, MOST_BYTES)
    if d.unconsumed_tail:
        raise ValueError("a stream unpacks to too much")
    return out


# --- hwp

# Characters of a paragraph that stand for one unit each; other controls take eight.
_ONE_UNIT = {0, 10, 13, 24, 25, 26, 27, 28, 29, 30, 31}
_PARA_HEADER, _PARA_TEXT, _CTRL_HEADER, _LIST_HEADER, _TABLE = 66, 67, 71, 72, 77


def hwp_text(raw: bytes) -> str:
    units = struct.unpack(f"<{len(raw) // 2}H", raw[: len(raw) // 2 * 2])
    out: list[int] = []
    k = 0
    while k < len(units):
        c = units[k]
        if c >= 32:
            out.append(c)
            k += 1
        elif c in _ONE_UNIT:
            out += [10] if c == 10 else [45] if c == 24 else [32] if c in (30, 31) else []
            k += 1
        else:
            out += [9] if c == 9 else []
            k += 8
    return struct.pack(f"<{len(out)}H", *out).decode("utf-16-le", "replace")


def _records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    at = 0
    while at + 4 <= len(data):
        head = struct.unpack_from("<I", data, at)[0]
        tag, level, size = head & 0x3FF, head >> 10 & 0x3FF, head >> 20
        at += 4
        if size == 0xFFF:
            if at + 4 > len(data):
                return
            size = struct.unpack_from("<I", data, at)[0]
            at += 4
        yield tag, level, data[at : at + size]
        at += size


def hwp(content: bytes) -> list[Block]:
    file = Compound(content)
    header = file.read("FileHeader")
    flags = struct.unpack_from("<I", header, 36)[0] if len(header) >= 40 else 0
    if flags & 2:
        raise ValueError("encrypted")
    out: list[Block] = []
    names = sorted((int(m[1]), n) for n in file.names() if (m := re.fullmatch(r"BodyText/Section(\d+)", n)))
    for _, name in names:
        data = file.read(name)
        data = inflated(data) if flags & 1 else data
        grid: dict | None = None
        depth = -1
        for tag, level, body in _records(data):
            if grid is not None and level < depth:
                out.append(_hwp_table(grid))
                grid = None
            if tag == _TABLE and len(body) >= 8:
                if grid is not None:
                    out.append(_hwp_table(grid))
                grid, depth = {"cells": {}, "at": None}, level
            elif tag == _LIST_HEADER and grid is not None and level == depth and len(body) >= 12:
                column, row = struct.unpack_from("<HH", body, 8)
                grid["at"] = (row, column)
                grid["cells"].setdefault((row, column), [])
            elif tag == _PARA_TEXT:
                text = hwp_text(body)
                if grid is not None and grid["at"] is not None:
                    grid["cells"][grid["at"]].append(text)
                else:
                    out.append(paragraph(text))
        if grid is not None:
            out.append(_hwp_table(grid))
    return out


def _hwp_table(grid: dict) -> Block:
    cells = grid["cells"]
    if not cells:
        return paragraph("")
    high, wide = 1 + max(r for r, _ in cells), 1 + max(c for _, c in cells)
    held = {r for r, _ in cells}
    bounded(len(held), wide)
    return table([["\n".join(cells.get((r, c), [])).strip() for c in range(wide)] if r in held else [] for r in range(high)])


# --- doc


def doc(content: bytes) -> list[Block]:
    file = Compound(content)
    main = file.read("WordDocument")
    if len(main) < 0x1AA or struct.unpack_from("<H", main, 0)[0] != 0xA5EC:
        raise ValueError("not a Word document")
    flags = struct.unpack_from("<H", main, 10)[0]
    if flags & 0x100:
        raise ValueError("encrypted")
    side = file.read("1Table" if flags & 0x200 else "0Table")
    at, size = struct.unpack_from("<II", main, 0x1A2)
    n_text = struct.unpack_from("<I", main, 0x4C)[0]
    clx, k, text = side[at : at + size], 0, []
    while k < len(clx):
        if clx[k] == 1:
            k += 3 + struct.unpack_from("<H", clx, k + 1)[0]
            continue
        if clx[k] != 2:
            break
        n = (struct.unpack_from("<I", clx, k + 1)[0] - 4) // 12
        ends = struct.unpack_from(f"<{n + 1}I", clx, k + 5)
        for i in range(n):
            place = struct.unpack_from("<I", clx, k + 5 + 4 * (n + 1) + 8 * i + 2)[0]
            length = ends[i + 1] - ends[i]
            if place & 0x40000000:
                place = (place & 0x3FFFFFFF) // 2
                text.append(main[place : place + length].decode("cp1252", "replace"))
            else:
                text.append(main[place : place + 2 * length].decode("utf-16-le", "replace"))
        break
    return _word_blocks("".join(text)[: n_text or None])


def _word_blocks(text: str) -> list[Block]:
    # Fields: what stands between begin and separator is an instruction, between separator and end the result.
    text = re.sub(r"\x13[^\x13\x14\x15]*\x14([^\x13\x15]*)\x15", r"\1", text)
    text = re.sub(r"\x13[^\x15]*\x15", "", text)
    out: list[Block] = []
    row: list[str] = []
    rows: list[list[str]] = []
    for piece, end in re.findall(r"([^\r\x07\x0c]*)([\r\x07\x0c]|$)", text):
        plain = re.sub(r"[\x00-\x08\x0e-\x1f]", "", piece.replace("\x0b", "\n").replace("\x1e", "-").replace("\x1f", ""))
        if end == "\x07":
            # A row ends with an empty mark of its own.
            if plain or not row:
                row.append(plain)
            elif row:
                rows.append(row)
                row = []
            continue
        if row or rows:
            out.append(table([*rows, *([row] if row else [])]))
            row, rows = [], []
        if plain.strip():
            out.append(paragraph(plain))
    if row or rows:
        out.append(table([*rows, *([row] if row else [])]))
    return out


# --- xls


def _biff(data: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Records with what continues them."""
    at, held = 0, None
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0x3C and held is not None:
            held[1].append(body)
            continue
        if held is not None:
            yield held
        held = (kind, [body])
    if held is not None:
        yield held


class _Pieces:
    """Reads strings that may go on in the next piece, where a new flag byte tells the width."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.k, self.at = pieces, 0, 0

    def left(self) -> int:
        return len(self.pieces[self.k]) - self.at

    def raw(self, n: int) -> bytes:
        out = b""
        while n and self.k < len(self.pieces):
            if not self.left():
                self.k, self.at = self.k + 1, 0
                continue
            got = self.pieces[self.k][self.at : self.at + n]
            out += got
            self.at += len(got)
            n -= len(got)
        return out

    def string(self) -> str:
        n, flags = struct.unpack("<HB", self.raw(3))
        runs = struct.unpack("<H", self.raw(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.raw(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while n:
            if not self.left():
                self.k, self.at = self.k + 1, 0
                if self.k >= len(self.pieces):
                    break
                wide = self.raw(1)[0] & 1
            got = min(n, self.left() // (2 if wide else 1))
            if not got:
                break
            out += self.raw(got * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1", "replace")
            n -= got
        self.raw(4 * runs + extra)
        return out


def _rk(v: int) -> float:
    n = float(struct.unpack("<i", struct.pack("<I", v))[0] >> 2) if v & 2 else struct.unpack("<d", b"\0\0\0\0" + struct.pack("<I", v & 0xFFFFFFFC))[0]
    return n / 100 if v & 1 else n


def _short(body: bytes, wide_length: bool) -> str:
    n, flag = struct.unpack_from("<HB" if wide_length else "<BB", body)
    rest = body[3 if wide_length else 2 :]
    return rest[: 2 * n].decode("utf-16-le", "replace") if flag & 1 else rest[:n].decode("latin-1")


def xls(content: bytes) -> list[Block]:
    from pagemill.functions.packages import _DATES

    file = Compound(content)
    data = file.read("Workbook") or file.read("Book")
    strings: list[str] = []
    sheets: dict[int, tuple[str, bool]] = {}
    formats: dict[int, str] = {}
    styles: list[int] = []
    old = False
    out: list[Block] = []
    cells: dict[tuple[int, int], str] = {}
    waiting: tuple[int, int] | None = None

    def dated(style: int) -> bool:
        f = styles[style] if style < len(styles) else 0
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", formats.get(f, ""))
        return f in _DATES or bool(re.search("[ymdhs]", code, re.I)) and "General" not in code

    at = 0
    place: list[int] = []
    walk = 0
    while walk + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, walk)
        if kind != 0x3C:
            place.append(walk)
        walk += 4 + size
    name: str | None = None

    def flush() -> None:
        nonlocal cells
        if name is not None:
            out.append(heading(name, 2))
            if cells:
                # Rows without cells leave nothing in a table, so one cell far down costs one row.
                wide = 1 + max(c for _, c in cells)
                out.append(table([[cells.get((r, c), "") for c in range(wide)] for r in sorted({r for r, _ in cells})]))
        cells = {}

    for at, (kind, pieces) in zip(place, _biff(data), strict=False):
        b = pieces[0]
        if kind == 0x2F:
            raise ValueError("encrypted")
        if kind == 0x22 and len(b) >= 2:
            old = b[0] == 1
        elif kind == 0x85:
            offset, hidden, sort = struct.unpack_from("<IBB", b)
            sheets[offset] = (_short(b[6:], False), bool(hidden) or sort != 0)
        elif kind == 0xFC:
            reader = _Pieces(pieces)
            _, n = struct.unpack("<II", reader.raw(8))
            for _ in range(n):
                try:
                    strings.append(reader.string())
                except (struct.error, IndexError):
                    break
        elif kind == 0x41E:
            formats[struct.unpack_from("<H", b)[0]] = _short(b[2:], True)
        elif kind == 0xE0:
            styles.append(struct.unpack_from("<HH", b)[1])
        elif kind == 0x809 and at in sheets:
            flush()
            label, hidden = sheets[at]
            name = None if hidden else label
        elif name is None or len(b) < 6:
            continue
        elif kind == 0xFD:
            r, c, _, n = struct.unpack_from("<HHHI", b)
            cells[r, c] = strings[n] if n < len(strings) else ""
        elif kind == 0x203:
            r, c, s, v = struct.unpack_from("<HHHd", b)
            cells[r, c] = shown_number(v, dated(s), old)
        elif kind == 0x27E:
            r, c, s, v = struct.unpack_from("<HHHI", b)
            cells[r, c] = shown_number(_rk(v), dated(s), old)
        elif kind == 0xBD:
            r, c = struct.unpack_from("<HH", b)
            for k in range((len(b) - 6) // 6):
                s, v = struct.unpack_from("<HI", b, 4 + 6 * k)
                cells[r, c + k] = shown_number(_rk(v), dated(s), old)
        elif kind == 0x204:
            r, c, _ = struct.unpack_from("<HHH", b)
            cells[r, c] = _short(b[6:], True)
        elif kind == 0x205:
            r, c, _, v, error = struct.unpack_from("<HHHBB", b)
            cells[r, c] = "#ERROR" if error else "TRUE" if v else "FALSE"
        elif kind == 0x06 and len(b) >= 14:
            r, c, s = struct.unpack_from("<HHH", b)
            if b[12:14] == b"\xff\xff":
                waiting = (r, c) if b[6] == 0 else None
                if b[6] == 1:
                    cells[r, c] = "TRUE" if b[8] else "FALSE"
            else:
                cells[r, c] = shown_number(struct.unpack_from("<d", b, 6)[0], dated(s), old)
        elif kind == 0x207 and waiting is not None:
            cells[waiting] = _Pieces(pieces).string() if len(b) >= 3 else ""
            waiting = None
    flush()
    return out


# --- ppt

# Records of a presentation.
_SLIDE, _NOTES, _MAIN, _SLIDE_TEXTS = 1006, 1008, 1016, 4080
_TEXT_HEADER, _CHARS, _BYTES, _PERSIST = 3999, 4000, 4008, 1011


def _atoms(data: bytes, inside: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], int, int, bytes]]:
    at = 0
    while at + 8 <= len(data):
        head, kind, size = struct.unpack_from("<HHI", data, at)
        body = data[at + 8 : at + 8 + size]
        at += 8 + size
        if head & 15 == 15:
            yield inside, kind, head >> 4, b""
            yield from _atoms(body, (*inside, kind))
        else:
            yield inside, kind, head >> 4, body


def ppt(content: bytes) -> list[Block]:
    file = Compound(content)
    if file.read("EncryptedSummary"):
        raise ValueError("encrypted")
    out: list[Block] = []
    listed = drawn = 0
    sort = 4
    for inside, kind, instance, body in _atoms(file.read("PowerPoint Document")):
        in_list = _SLIDE_TEXTS in inside
        if _MAIN in inside or (_NOTES in inside and not in_list):
            continue
        if kind == _SLIDE:
            drawn += 1
            if drawn > listed:
                out.append(heading(f"Slide {drawn}", 2))
        elif kind == _PERSIST and in_list:
            listed += 1
            out.append(heading(f"Slide {listed}", 2))
        elif kind == _TEXT_HEADER and len(body) >= 4:
            sort = struct.unpack_from("<I", body)[0]
        elif kind in (_CHARS, _BYTES) and (in_list or _SLIDE in inside):
            text = body.decode("utf-16-le" if kind == _CHARS else "latin-1", "replace").replace("\x0b", "\n")
            for p in text.split("\r"):
                if p.strip():
                    out.append(heading(p, 3) if sort in (0, 6) else paragraph(p))
    return out
