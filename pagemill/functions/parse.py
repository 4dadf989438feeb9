"""From content to blocks: one parser for each kind."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import compound, markup, packages, pdf, texts
from pagemill.functions.blocks import Block, render, title_of
from pagemill.functions.sniff import IMAGES, kind_of

PARSERS: dict[str, Callable[[bytes], list[Block]]] = {
    "hwp": compound.hwp,
    "doc": compound.doc,
    "xls": compound.xls,
    "ppt": compound.ppt,
    "docx": packages.docx,
    "pptx": packages.pptx,
    "xlsx": packages.xlsx,
    "odt": packages.opendocument,
    "ods": packages.opendocument,
    "odp": packages.opendocument,
    "hwpx": packages.hwpx,
    "pdf": pdf.pdf_blocks,
    "html": markup.html_blocks,
    "srt": texts.cue_blocks,
    "vtt": texts.cue_blocks,
    "smi": texts.sami_blocks,
    "text": texts.text_blocks,
    "xml": texts.text_blocks,
    "empty": lambda content: [],
} | {k: (lambda content, k=k: texts.image_blocks(content, k)) for k in IMAGES}


def parse(content: bytes | None) -> tuple[str, str, str, str]:
    """(kind, title, markdown, error): a damaged or unknown file is reported and stops nothing."""
    kind = kind_of(content)
    if kind not in PARSERS:
        return kind, "", "", f"no parser for {kind}"
    try:
        blocks = PARSERS[kind](content or b"")
        return kind, title_of(blocks), render(blocks), ""
    except Exception as e:  # noqa: BLE001  parsers meet any bytes; the row carries what went wrong
        return kind, "", "", f"{type(e).__name__}: {str(e)[:200]}"


PARSED = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "title", "markdown", "error")])


@F.pandas_udf(PARSED)
def _parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([parse(None if c is None else bytes(c)) for c in batch], columns=["kind", "title", "markdown", "error"])


def parsed(content: Column) -> Column:
    """struct<kind, title, markdown, error> of binary content, in Arrow batches."""
    return _parsed(content)


@F.pandas_udf(T.StringType())
def _kinds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([kind_of(None if c is None else bytes(c)) for c in batch], dtype="object")


def kinds(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with kind: decided on the head in the JVM; only packages and compound files are looked into in Python."""
    from pagemill.functions.sniff import kind_of_head

    head = files.withColumn("kind", kind_of_head(F.col(content)))
    plain = head.where(~F.col("kind").isin("zip", "ole"))
    inside = head.where(F.col("kind").isin("zip", "ole")).withColumn("kind", _kinds(F.col(content)))
    return plain.unionByName(inside)
