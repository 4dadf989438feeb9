"""The sink: one Markdown file for each document, an index, and the manifest of a run.

Files are written by the executors under a temporary name and renamed, the index after all documents, the manifest last: a
run that breaks off converts again and skips nothing. The target is a folder that all executors see, as is the source.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

INDEX = "INDEX.md"


def safe_path(path: str, member: str | None) -> str:
    """Place of a document in the bundle: the source path with ``.md``, what a file system may refuse replaced."""
    whole = path if not member else f"{path}/{member}"
    parts = [re.sub(r'[<>:"\\|?*\x00-\x1f]', "_", p).lstrip(" ").rstrip(" .") or "_" for p in whole.split("/") if p not in ("", ".", "..")]
    if parts[-1] == INDEX.removesuffix(".md"):
        parts[-1] += "_"
    # A name is at most 255 bytes long; its end tells documents apart.
    name = parts[-1]
    while len(name.encode()) > 200:
        name = name[: len(name) // 2 - 4] + "…" + name[len(name) // 2 + 4 :]
    parts[-1] = name
    return "/".join(parts) + ".md"


def write_file(root: str, name: str, parts: Iterable[str]) -> None:
    target = os.path.join(root, name)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    fresh = f"{target}.{os.getpid()}.tmp"
    with open(fresh, "w", encoding="utf-8", newline="\n") as f:
        f.writelines(parts)
    os.replace(fresh, target)


def write_bundle(docs: DataFrame, root: str) -> DataFrame:
    """Writes (out_path, markdown) and gives the paths written; lazily, as its result is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for out_path, markdown in zip(batch["out_path"], batch["markdown"], strict=True):
                write_file(root, out_path, [markdown or ""])
            yield batch[["doc_id", "out_path"]]

    return docs.select("doc_id", "out_path", "markdown").mapInPandas(run, "doc_id string, out_path string")
