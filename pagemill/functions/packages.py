"""XML packages: docx, pptx, xlsx, OpenDocument and hwpx."""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pagemill.functions.blocks import Block, heading, item, paragraph, table

#: A part of a package may not unpack to more than this.
MOST_BYTES = 256 << 20
#: A table may not have more cells than this; what has is an error of the document (a full sheet of 32 columns has as many).
MOST_CELLS = 1 << 25


def local(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def attr(e: ET.Element, name: str, default: str = "") -> str:
    """An attribute by its local name."""
    return next((v for k, v in e.attrib.items() if local(k) == name), default)


def read_part(z: zipfile.ZipFile, name: str) -> bytes:
    if z.getinfo(name).file_size > MOST_BYTES:
        raise ValueError(f"{name} unpacks to too much")
    return z.read(name)


def part(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    if name not in z.NameToInfo:
        return None
    data = read_part(z, name)
    if b"<!DOCTYPE" in data[:1024] or b"<!ENTITY" in data[:4096]:
        raise ValueError(f"{name} declares entities")
    return ET.fromstring(data)


def children(e: ET.Element | None, *names: str) -> Iterator[ET.Element]:
    return (c for c in (e if e is not None else ()) if local(c.tag) in names)


def first(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        e = next(children(e, name), None)
        if e is None:
            return None
    return e


def links(z: zipfile.ZipFile, name: str) -> dict[str, str]:
    """Relation id -> part, of a part."""
    folder, base = posixpath.split(name)
    root = part(z, f"{folder}/_rels/{base}.rels".lstrip("/"))
    found = {}
    for r in children(root, "Relationship"):
        to = r.get("Target", "")
        if r.get("TargetMode") != "External":
            found[r.get("Id", "")] = to.lstrip("/") if to.startswith("/") else posixpath.normpath(posixpath.join(folder, to))
    return found


def numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


# --- word processing


def _run_text(e: ET.Element) -> str:
    out = []
    for x in e.iter():
        name = local(x.tag)
        if name == "t":
            out.append(x.text or "")
        elif name == "tab":
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")
        elif name == "noBreakHyphen":
            out.append("-")
    return "".join(out)


def _word_paragraph(p: ET.Element, levels: dict[str, int]) -> Block:
    props = first(p, "pPr")
    style = first(props, "pStyle")
    name = attr(style, "val") if style is not None else ""
    outline = first(props, "outlineLvl")
    text = _run_text(p)
    level = int(attr(outline, "val", "9")) + 1 if outline is not None else levels.get(name, 0)
    if 1 <= level <= 9:
        return heading(text, level)
    if (number := first(props, "numPr")) is not None:
        depth = first(number, "ilvl")
        return item(text, int(attr(depth, "val", "0") or 0) if depth is not None else 0)
    return paragraph(text)


def _word_body(body: ET.Element, levels: dict[str, int]) -> Iterator[Block]:
    for e in body:
        name = local(e.tag)
        if name == "p":
            yield _word_paragraph(e, levels)
        elif name == "tbl":
            yield table([["\n".join(_run_text(p) for p in c.iter() if local(p.tag) == "p") for c in children(r, "tc")] for r in children(e, "tr")])
        elif name in ("sdt", "sdtContent", "ins", "smartTag", "customXml"):
            yield from _word_body(e, levels)


def docx(content: bytes) -> list[Block]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        levels = {}
        for s in children(part(z, "word/styles.xml"), "style"):
            name = first(s, "name")
            label = attr(name, "val").lower() if name is not None else ""
            outline = first(s, "pPr", "outlineLvl")
            if outline is not None:
                levels[attr(s, "styleId")] = int(attr(outline, "val", "9")) + 1
            elif m := re.fullmatch(r"heading (\d)", label):
                levels[attr(s, "styleId")] = int(m[1])
            elif label == "title":
                levels[attr(s, "styleId")] = 1
        levels.setdefault("Title", 1)
        for k in range(1, 7):
            levels.setdefault(f"Heading{k}", k)
        root = part(z, "word/document.xml")
        out = list(_word_body(first(root, "body") if root is not None else [], levels))
        for name in ("word/footnotes.xml", "word/endnotes.xml"):
            notes = [_run_text(n) for n in children(part(z, name), "footnote", "endnote") if attr(n, "type") not in ("separator", "continuationSeparator")]
            out += [item(n) for n in notes if n.strip()]
    return out


# --- slides


def _drawn(shape: ET.Element) -> Iterator[Block]:
    place = next((attr(e, "type") for e in shape.iter() if local(e.tag) == "ph"), None)
    for body in (e for e in shape.iter() if local(e.tag) == "txBody"):
        for p in children(body, "p"):
            text = _run_text(p)
            props = first(p, "pPr")
            if place in ("title", "ctrTitle"):
                yield heading(text, 2)
            elif place in (None, "subTitle"):
                yield paragraph(text)
            elif place not in ("sldNum", "ftr", "dt"):
                yield item(text, int(attr(props, "lvl", "0")) if props is not None else 0)


def _slide(tree: ET.Element | None) -> Iterator[Block]:
    for e in tree if tree is not None else ():
        name = local(e.tag)
        if name == "sp":
            yield from _drawn(e)
        elif name == "grpSp":
            yield from _slide(e)
        elif name == "graphicFrame":
            for t in (x for x in e.iter() if local(x.tag) == "tbl"):
                yield table([[" ".join(_run_text(p) for p in c.iter() if local(p.tag) == "p") for c in children(r, "tc")] for r in children(t, "tr")])


def pptx(content: bytes) -> list[Block]:
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        to = links(z, "ppt/presentation.xml")
        shown = first(part(z, "ppt/presentation.xml"), "sldIdLst")
        names = [to[r] for s in children(shown, "sldId") if (r := next((v for k, v in s.attrib.items() if k.endswith("}id")), "")) in to]
        for k, name in enumerate(names or numbered(z, r"ppt/slides/slide(\d+)\.xml"), 1):
            blocks = list(_slide(first(part(z, name), "cSld", "spTree")))
            if not any(b.kind == "heading" and b.text.strip() for b in blocks):
                blocks.insert(0, heading(f"Slide {k}", 2))
            out += blocks
            for n in (n for n in links(z, name).values() if "notesSlide" in n):
                said = [b for b in _slide(first(part(z, n), "cSld", "spTree")) if b.text.strip()]
                out += [paragraph("Notes: " + " ".join(b.text for b in said))] if said else []
    return out


# --- sheets

# Built-in number formats that show dates or times.
_DATES = {*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)}


def cell_place(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def shown_number(raw: str | float, dated: bool = False, since_1904: bool = False) -> str:
    try:
        v = float(raw)
    except ValueError:
        return str(raw)
    if dated and 0 <= v < 2958466:
        day = dt.datetime(1904, 1, 1) if since_1904 else dt.datetime(1899, 12, 30)
        t = day + dt.timedelta(seconds=round(v * 86400))
        if v < 1:
            return t.strftime("%H:%M:%S")
        return t.strftime("%Y-%m-%d" if v == int(v) else "%Y-%m-%d %H:%M:%S")
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def xlsx(content: bytes) -> list[Block]:
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings = ["".join(t.text or "" for t in s.iter() if local(t.tag) == "t") for s in children(part(z, "xl/sharedStrings.xml"), "si")]
        styles = part(z, "xl/styles.xml")
        own = {attr(f, "numFmtId"): attr(f, "formatCode") for f in children(first(styles, "numFmts"), "numFmt")}
        dated = []
        for x in children(first(styles, "cellXfs"), "xf"):
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(attr(x, "numFmtId"), ""))
            dated.append(int(attr(x, "numFmtId", "0")) in _DATES or bool(re.search(r"[ymdhs]", code, re.I)) and "General" not in code)
        book = part(z, "xl/workbook.xml")
        props = first(book, "workbookPr")
        old = props is not None and attr(props, "date1904") in ("1", "true")
        to = links(z, "xl/workbook.xml")
        for s in children(first(book, "sheets"), "sheet"):
            if attr(s, "state") in ("hidden", "veryHidden"):
                continue
            name = next((to[v] for k, v in s.attrib.items() if k.endswith("}id") and v in to), None)
            root = part(z, name) if name else None
            rows: list[list[str]] = []
            for r in children(first(root, "sheetData"), "row"):
                row: list[str] = []
                for c in children(r, "c"):
                    at = cell_place(attr(c, "r")) if attr(c, "r") else len(row)
                    row += [""] * (at - len(row))
                    kind, v = attr(c, "t", "n"), first(c, "v")
                    raw = (v.text or "") if v is not None else ""
                    if kind == "s":
                        text = strings[int(raw)] if raw.isdigit() and int(raw) < len(strings) else ""
                    elif kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter() if local(t.tag) == "t")
                    elif kind == "b":
                        text = "TRUE" if raw == "1" else "FALSE"
                    elif kind == "n" and raw:
                        style = int(attr(c, "s", "0") or 0)
                        text = shown_number(raw, style < len(dated) and dated[style], old)
                    else:
                        text = raw
                    row.append(text)
                rows.append(row)
            out.append(heading(attr(s, "name"), 2))
            if any(any(row) for row in rows):
                out.append(table(rows))
    return out


# --- OpenDocument


def _odf_text(e: ET.Element) -> str:
    out = [e.text or ""]
    for c in e:
        name = local(c.tag)
        if name == "s":
            out.append(" " * int(attr(c, "c", "1")))
        elif name == "tab":
            out.append("\t")
        elif name == "line-break":
            out.append("\n")
        elif name not in ("annotation", "note-citation"):
            out.append(_odf_text(c))
        out.append(c.tail or "")
    return "".join(out)


def bounded(n_rows: int, wide: int, n_chars: int = 0) -> None:
    """Against hostile files: a table that would unpack to too much is an error, never cut."""
    if n_rows * wide > MOST_CELLS or n_chars > MOST_BYTES:
        raise ValueError(f"a table of {n_rows} x {wide} cells unpacks to too much")


def _odf_table(t: ET.Element) -> Block:
    rows: list = []
    filled = wide = n_chars = 0
    for r in (e for e in t.iter() if local(e.tag) == "table-row"):
        row: list[str] = []
        gap = own = 0
        for c in children(r, "table-cell", "covered-table-cell"):
            text = "\n".join(_odf_text(p) for p in c.iter() if local(p.tag) == "p")
            n = max(0, int(attr(c, "number-columns-repeated", "1")))
            if not text:
                # May be repeated to the sheet's edge; counts only if a filled cell follows.
                gap += n
                continue
            own += n * len(text)
            bounded(1, len(row) + gap + n, own)
            row += [""] * gap + [text] * n
            gap = 0
        if not row:
            rows.append(())
            continue
        n = max(0, int(attr(r, "number-rows-repeated", "1")))
        filled, wide, n_chars = filled + n, max(wide, len(row)), n_chars + n * own
        bounded(filled, wide, n_chars)
        rows += [tuple(row)] * n
    while rows and not rows[-1]:
        rows.pop()
    return table(rows)


def _odf(e: ET.Element, depth: int = 0) -> Iterator[Block]:
    for c in e:
        name = local(c.tag)
        if name == "h":
            yield heading(_odf_text(c), int(attr(c, "outline-level", "1")))
        elif name == "p":
            boxes = [b for b in c.iter() if local(b.tag) == "text-box"]
            if not boxes:
                yield item(_odf_text(c), depth - 1) if depth else paragraph(_odf_text(c))
            for b in boxes:
                yield from _odf(b, depth)
        elif name == "list":
            for i in children(c, "list-item", "list-header"):
                yield from _odf(i, depth + 1)
        elif name == "table":
            if label := attr(c, "name") if local(e.tag) == "spreadsheet" else "":
                yield heading(label, 2)
            if (t := _odf_table(c)).rows:
                yield t
        elif name == "page":
            yield heading(attr(c, "name") or "Slide", 2)
            yield from _odf(c, depth)
        elif name not in ("tracked-changes", "forms", "sequence-decls", "notes", "annotation"):
            yield from _odf(c, depth)


def opendocument(content: bytes) -> list[Block]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = first(part(z, "content.xml"), "body")
        return list(_odf(body)) if body is not None else []


# --- hwpx


def _hwpx_text(p: ET.Element) -> str:
    out = []
    for r in children(p, "run"):
        for t in children(r, "t"):
            out.append(t.text or "")
            for c in t:
                out += ["\n" if local(c.tag) == "lineBreak" else "\t" if local(c.tag) == "tab" else " " if local(c.tag) in ("nbSpace", "fwSpace") else "", c.tail or ""]
    return "".join(out)


def _hwpx(section: ET.Element) -> Iterator[Block]:
    for p in children(section, "p"):
        yield paragraph(_hwpx_text(p))
        for r in children(p, "run"):
            for t in children(r, "tbl"):
                yield table([["\n".join(_hwpx_text(q) for q in c.iter() if local(q.tag) == "p") for c in children(row, "tc")] for row in children(t, "tr")])
            for e in children(r, "rect", "textbox", "container", "header", "footer", "footNote", "endNote"):
                for sub in (x for x in e.iter() if local(x.tag) == "subList"):
                    yield from _hwpx(sub)


def hwpx(content: bytes) -> list[Block]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [b for name in numbered(z, r"Contents/section(\d+)\.xml") if (root := part(z, name)) is not None for b in _hwpx(root)]
