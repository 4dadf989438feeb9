"""Files inside ZIP archives become files of their own, with limits on depth, size and ratio."""

from __future__ import annotations

import io
import lzma
import posixpath
import struct
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from pagemill.functions.sniff import kind_of

MEMBERS = "path string, member string, length long, modified timestamp, content binary, problem string"
DEPTH = 3
MOST_FILE = 256 << 20
MOST_TOTAL = 1 << 30
RATIO = 200
#: Bytes of rows that go out together.
HELD = 8 << 20


def member_name(info: zipfile.ZipInfo) -> str:
    """Without the UTF-8 flag a name is in the Korean code page, or else in the old one."""
    name = info.filename
    if not info.flag_bits & 0x800:
        raw = name.encode("cp437", "replace")
        for code in ("utf-8", "cp949"):
            try:
                name = raw.decode(code)
                break
            except UnicodeDecodeError:
                continue
    return unicodedata.normalize("NFC", name.replace("\\", "/"))


def members(content: bytes, depth: int = DEPTH, budget: list[int] | None = None) -> Iterator[tuple[str, bytes | None, str]]:
    """(name, content or None, problem) of the files in an archive; archives in it are opened too."""
    budget = [MOST_TOTAL] if budget is None else budget
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError, struct.error) as e:
        yield "", None, f"damaged archive: {e}"
        return
    with z:
        for info in z.infolist():
            name = member_name(info)
            if info.is_dir():
                continue
            clean = posixpath.normpath(name)
            if name.startswith("/") or clean.startswith("..") or ":" in name.split("/")[0]:
                yield name, None, "path leaves the archive"
            elif info.flag_bits & 1:
                yield clean, None, "encrypted"
            elif info.file_size > MOST_FILE or info.file_size > budget[0]:
                yield clean, None, "too large"
            elif info.file_size > (1 << 20) and info.file_size > RATIO * max(1, info.compress_size):
                yield clean, None, "unpacks to too much"
            else:
                try:
                    with z.open(info) as f:
                        data = f.read(info.file_size + 1)
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError, EOFError, ValueError, struct.error, zlib.error, lzma.LZMAError) as e:
                    yield clean, None, f"damaged: {e}"
                    continue
                budget[0] -= len(data)
                if kind_of(data) == "zip":
                    if depth <= 1:
                        yield clean, None, "nested too deep"
                    else:
                        for inner, got, problem in members(data, depth - 1, budget):
                            yield posixpath.join(clean, inner) if inner else clean, got, problem
                else:
                    yield clean, data, ""


def expanded(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(path, member, length, modified, content, problem): plain files with a null member, archives as their members."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MEMBERS.split(", ")]
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for f in batch.itertuples(index=False):
                content = None if f.content is None else bytes(f.content)
                if content is not None and kind_of(content) == "zip":
                    found = ((f.path, member, len(data or b""), f.modified, data, problem or None) for member, data, problem in members(content, depth))
                else:
                    found = iter([(f.path, None, f.length, f.modified, content, None if content is not None else "too large")])
                for row in found:
                    rows.append(row)
                    size += 100 + len(row[4] or b"")
                    if size > HELD:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "length", "modified", "content").mapInPandas(run, MEMBERS)


def met(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, length) of the rows that ``expanded`` gives; no content leaves the task.

    Content that is shorter than its file is a head: the kind is what it tells, and an archive of which only that is known is
    not opened.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple[str, int]] = []
            for f in batch.itertuples(index=False):
                content = None if f.content is None else bytes(f.content)
                kind = kind_of(content)
                if kind == "zip" and len(content) >= f.length:
                    rows += [(kind_of(data), len(data or b"")) for _, data, _ in members(content, depth)]
                else:
                    rows.append((kind, f.length))
            if rows:
                yield pd.DataFrame(rows, columns=["kind", "length"])

    return files.select("length", "content").mapInPandas(run, "kind string, length long")
