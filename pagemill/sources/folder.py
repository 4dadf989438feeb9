"""A data source that lists a folder: every file, hidden and empty ones too, in batches of about equal bytes.

Spark's own binary source leaves out empty files and names that begin with ``_`` or ``.``; a user's folder has both. Lock
files and links are left out on purpose, and so is the folder that results are written to. Content is read only if asked for
(option ``content``: ``none``, ``head``, ``all``, or ``inside``: heads, but packages and compound files whole, whose kind stands
anywhere in them), in the executors.
"""

from __future__ import annotations

import datetime as dt
import os
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagemill.functions.sniff import SIGNATURES

OUTPUT = "_변환결과"
SCHEMA = "path string, name string, length long, modified timestamp, content binary"
HEAD_BYTES = 8192
# How ZIP and compound files begin.
LOOKED_INTO = tuple(bytes.fromhex(s) for s, kind in SIGNATURES if kind in ("zip", "ole"))


class Batch(InputPartition):
    def __init__(self, files: list[tuple[str, int, float]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.content = options.get("content", "all")
        self.batch = int(options.get("batchbytes", str(64 << 20)))
        self.batch_files = int(options.get("batchfiles", "1000"))
        self.most = int(options.get("maxlength", str(512 << 20)))
        self.skip = options.get("output", OUTPUT)

    def partitions(self) -> list[InputPartition]:
        found = []
        for folder, folders, names in os.walk(self.root, followlinks=False):
            folders[:] = sorted(d for d in folders if unicodedata.normalize("NFC", d) != self.skip and not os.path.islink(os.path.join(folder, d)))
            for name in names:
                path = os.path.join(folder, name)
                if name.startswith("~$") or os.path.islink(path) or not os.path.isfile(path):
                    continue
                s = os.stat(path)
                found.append((os.path.relpath(path, self.root), s.st_size, s.st_mtime))
        found.sort()
        out: list[InputPartition] = []
        held: list = []
        size = 0
        for f in found:
            if held and (size + f[1] > self.batch or len(held) >= self.batch_files):
                out.append(Batch(held))
                held, size = [], 0
            held.append(f)
            size += f[1]
        return out + [Batch(held)]

    def read(self, partition: Batch) -> Iterator[tuple]:
        for path, length, modified in partition.files:
            content = None
            heads = self.content in ("head", "inside")
            if self.content != "none" and (heads or length <= self.most):
                with open(os.path.join(self.root, path), "rb") as f:
                    content = f.read(HEAD_BYTES if heads else -1)
                    if self.content == "inside" and content.startswith(LOOKED_INTO) and length <= self.most:
                        content += f.read()
            shown = unicodedata.normalize("NFC", path).replace(os.sep, "/")
            yield shown, shown.rpartition("/")[2], length, dt.datetime.fromtimestamp(modified, dt.timezone.utc), content


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def files(spark: SparkSession, root: str, content: str = "all", output: str = OUTPUT) -> DataFrame:
    """(path, name, length, modified, content) of every file under ``root``; paths relative, composed Unicode."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").option("content", content).option("output", output).load(root)
