"""Helpers shared by the training-data operators: table access, materialised steps, vectorised words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that separate words: blank and \t \n \v \f \r.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SHINGLE_WORDS = 5
#: Texts are handled in slices of about so many bytes (a longer text is a slice of its own).
SLICE_BYTES = 1 << 20

_SEPARATES = np.zeros(256, dtype=bool)
_SEPARATES[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
_FIRST = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEPS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Values of bytes for two hashes of a word that have nothing to do with each other.
_BYTE_VALUES = _FIRST, _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; one of this machine's own only where there is but this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: steps are written to a folder that all executors share")
        if not hasattr(shared_dir, "own"):
            shared_dir.own = tempfile.mkdtemp(prefix="pagemill-shared-")
        found = shared_dir.own
    return found.rstrip("/")


def give_back(spark: SparkSession) -> None:
    """Executors collect their garbage, so that their JVMs return the heap that earlier steps left; nothing in local mode.

    A JVM keeps the heap it once needed, and counts twice while it starts a process, as Hadoop does (chmod) for each file
    it writes to a local folder without its native library.
    """
    executors = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1  # one is the driver
    if executors > 0:
        # So many tasks go to one executor each where all are idle; elsewhere some may miss theirs, which only costs memory.
        collect = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
        spark.range(0, executors, 1, executors).select(collect.alias("done")).write.format("noop").mode("overwrite").save()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffle files of the job go with it, so disk holds the largest step and not the sum of all. Before it, executors
    return the heap of the steps that went before.
    """
    spark = df.sparkSession
    give_back(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        # Small row groups: a writer holds one in memory.
        df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialized_at = path
    return out


def discard(*steps: DataFrame) -> None:
    """Remove written steps that nothing reads any more."""
    for df in steps:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.materialized_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Rows in an Arrow batch; small where rows are whole texts, so that a batch stays within a few MB. So are the batches of the scan."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(min(4096, max(256, rows))))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def squeezed(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its texts compressed each on its own, as binary (null as empty), so that a shuffle of them moves less."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = pa.array([pack.compress(t.as_buffer() or b"") for t in batch.column(at).fill_null("")], type=pa.binary())
            yield pa.RecordBatch.from_arrays([z if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, T.BinaryType() if f.name == text else f.dataType) for f in df.schema]))


def inflated(column: pa.Array) -> list[bytes]:
    """The texts' UTF-8 bytes."""
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(z.as_buffer()) for z in column]


def unsqueezed(df: DataFrame, text: str = "text") -> DataFrame:
    """Undoes ``squeezed``."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.array([b.decode() for b in inflated(batch.column(at))], type=pa.string())
            yield pa.RecordBatch.from_arrays([t if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in df.schema]))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of the hash base and their inverses modulo 2**64, grown on demand."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = max(n, 2 * SLICE_BYTES)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                a = np.empty(size, dtype=np.uint64)
                a[0], filled = 1, 1
                while filled < size:
                    step = np.uint64(pow(base, filled, 2**64))
                    more = min(filled, size - filled)
                    a[filled : filled + more] = a[:more] * step
                    filled += more
                setattr(cls, name, a)
        return cls.up, cls.down


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows, without copying; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, side="right")) - 1)
        yield first, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the slice, and each document's first word (one more entry than documents)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~_SEPARATES[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offs] = True
    cut = cut[:-1]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut))
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    cut_next = np.empty_like(cut)
    cut_next[-1], cut_next[:-1] = True, cut[1:]
    ends = np.flatnonzero(inside & (~after | cut_next)) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every word's bytes, A-Z as a-z if ``lower``; ``which`` of two."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    if len(data) > 2 * SLICE_BYTES and len(starts) > 1:
        # A long text in stretches of whole words; a word's hash does not depend on where it stands.
        out, i = [], 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, side="right")))
            a, b = starts[i], ends[j - 1]
            out.append(word_hashes(data[a:b], starts[i:j] - a, ends[i:j] - a, lower, which))
            i = j
        return np.concatenate(out)
    up, down = _Powers.upto(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUES[which][_LOWER[data] if lower else data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, at every start that has n words."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        h += words[k : len(words) - n + 1 + k] * _STEPS[k]
    return mix(h)


def shingle_sets(column: pa.Array, n: int = SHINGLE_WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes): words lower-cased; fewer than n words are one shingle, none is empty."""
    for first, data, offs in text_slices(column):
        starts, ends, at = word_spans(data, offs)
        words = word_hashes(data, starts, ends, lower=True)
        every = grams(words, n)
        for k in range(len(offs) - 1):
            a, b = int(at[k]), int(at[k + 1])
            if b - a >= n:
                found = np.unique(every[a : b - n + 1])
            elif b > a:
                found = mix((words[a:b] * _STEPS[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                found = np.zeros(0, dtype=np.uint64)
            yield first + k, found
