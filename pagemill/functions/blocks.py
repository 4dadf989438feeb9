"""Blocks, the common middle form of all parsers, and their rendering as Markdown."""

from __future__ import annotations

from typing import NamedTuple


class Block(NamedTuple):
    """kind: heading, paragraph, item, table, code, or image."""

    kind: str
    text: str = ""
    level: int = 0
    rows: tuple[tuple[str, ...], ...] = ()


def heading(text: str, level: int = 1) -> Block:
    return Block("heading", text, max(1, min(6, level)))


def paragraph(text: str) -> Block:
    return Block("paragraph", text)


def item(text: str, level: int = 0) -> Block:
    return Block("item", text, level)


def table(rows: list[list[str]]) -> Block:
    return Block("table", rows=tuple(tuple(r) for r in rows))


def _cell(text: str) -> str:
    return " ".join(text.split()).replace("|", "\\|")


def _table(rows: tuple[tuple[str, ...], ...]) -> str:
    wide = max(len(r) for r in rows)
    lines = ["| " + " | ".join(_cell(c) for c in (*r, *[""] * (wide - len(r)))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]])


def render(blocks: list[Block]) -> str:
    """Markdown; blocks without content leave nothing."""
    out: list[str] = []
    before = ""
    for b in blocks:
        if b.kind == "table":
            rows = tuple(r for r in b.rows if any(c.strip() for c in r))
            text = _table(rows) if rows else ""
        elif b.kind == "heading":
            text = "#" * b.level + " " + " ".join(b.text.split()) if b.text.strip() else ""
        elif b.kind == "item":
            text = "  " * b.level + "- " + " ".join(b.text.split()) if b.text.strip() else ""
        elif b.kind == "code":
            text = f"```\n{b.text.rstrip()}\n```" if b.text.strip() else ""
        else:
            text = "\n".join(line.strip() for line in b.text.strip().split("\n"))
        if not text:
            continue
        if out:
            out.append("\n" if before == b.kind == "item" else "\n\n")
        out.append(text)
        before = b.kind
    return "".join(out) + ("\n" if out else "")


def title_of(blocks: list[Block]) -> str:
    """The first heading, else the start of the first text."""
    for kinds in (("heading",), ("paragraph", "item")):
        for b in blocks:
            if b.kind in kinds and b.text.strip():
                return " ".join(b.text.split())[:120]
    return ""
