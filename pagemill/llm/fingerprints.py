"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the number of distinct shingles it was made of (while it holds all of them) and the k smallest hashes, each
cut to its upper 48 bits. Sketches of parts of a document, or of a corpus, merge into the sketch of the whole: the k
smallest of both. From two sketches follow estimates of resemblance (the share of the k smallest of the union that both
hold), containment and the count of distinct shingles; below k shingles these are exact.

``neighbours`` lines documents up in descending order of id and hands each to a function with the next one: ids are dealt
into ranges at bounds found from quantiles, each range is sorted by Spark in its own task (spilling if need be) and read
as a stream; the first document of every range also goes to the range before it. Texts are shuffled once, compressed.

Defined results: a null text is empty; a text without words has the empty sketch, and two empty sketches have likeness 1;
fewer than five words are one shingle; equal ids follow each other in an order that their texts fix; a null id comes last; the
only row of a table is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_rows, inflated, shingle_sets, shuffle_partitions, squeezed

K = 256


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest of sorted distinct 64-bit hashes, upper 48 bits."""
    return hashes[:k] >> np.uint64(16)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    return float(np.isin(both, a, assume_unique=True)[np.isin(both, b, assume_unique=True)].sum() / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**48 / float(a[k - 1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def encode(a: np.ndarray) -> str:
    """48-bit values, big-endian, as base64; the order of hashes is the order of strings' bytes."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), dtype=np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).copy().view(">u8").reshape(-1).astype(np.uint64)


def sketches(texts: list[str], k: int = K) -> list[np.ndarray]:
    return [sketch(h, k) for _, h in shingle_sets(pa.array(texts, type=pa.string()))]


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def ranged(docs: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(part, doc_id, text, borrowed): ids in descending order over the parts; the first row of a part also ends the one before."""
    ids = docs.select("doc_id")
    bounds = sorted(set(ids.where("doc_id is not null").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    # Bounds are whole ids; part 0 has the largest ids, null ids go to the last part.
    part = F.lit(len(bounds)) - F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    placed = docs.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(part).cast("int"))
    heads = sorted(r for r in placed.groupBy("part").agg(F.max("doc_id").alias("head")).collect())  # one row for each part
    if not heads:
        return placed.withColumn("borrowed", F.lit(False)), 1
    before = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads) if head is not None and (k or len(heads) > 1)}
    # Every row equal to a head's id would be borrowed; the reader takes the first of them in its order.
    lent = F.lit(None).cast("int")
    if before:
        items = [x for head, p in before.items() for x in (F.lit(int(head)), F.lit(int(p)))]
        lent = F.element_at(F.create_map(*items), F.col("doc_id"))
    if len(heads) > 1 and heads[-1][1] is None:  # a last part of rows without id only
        lent = F.when(F.col("doc_id").isNull(), F.lit(heads[-2][0])).otherwise(lent)
    both = F.array_compact(F.array(F.struct("part", F.lit(False).alias("borrowed")), F.when(lent.isNotNull(), F.struct(lent.alias("part"), F.lit(True).alias("borrowed")))))
    return placed.withColumn("p", F.explode(both)).select("p.part", "doc_id", "text", "p.borrowed"), len(heads)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, contained_next, n_shingles (estimates)."""
    spark = docs.sparkSession
    kept = docs.selectExpr(f"cast(`{doc_id}` as bigint) AS doc_id", f"`{text}` AS text")
    parts = 4 * shuffle_partitions(spark)
    rows, found = ranged(kept, min(parts, 1024))
    alone = found <= 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # (part, id, text, sketch) that has not met its next document
        opening: tuple | None = None  # the first document of all, where one part holds all of them
        out: list[list] = [[] for _ in range(9)]

        def pair(one: tuple, following: str, near: np.ndarray) -> None:
            _, key, own, a = one
            changed = edited(own, following)
            b = sketches([changed], k)[0]
            for column, value in zip(out, (key, len(own), hashlib.sha256(changed.encode()).hexdigest(), encode(a), encode(b), resemblance(a, b, k), resemblance(a, near, k), containment(a, near, k), distinct(a, k)), strict=True):
                column.append(value)

        def flush() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4)
            done = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_next", "n_shingles"])
            for c in out:
                c.clear()
            return done

        for batch in batches:
            texts = [t.decode() for t in inflated(batch.column(2))]
            for part, key, own, borrowed, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3).to_pylist(), sketches(texts, k), strict=True):
                now = (part, key, own, a)
                if waiting is not None and waiting[0] == part:
                    pair(waiting, own, a)
                    waiting = None
                if not borrowed:
                    waiting = now
                    if alone and opening is None:
                        opening = now
            if out[0]:
                yield flush()
        if alone and waiting is not None:
            pair(waiting, opening[2], opening[3])
            yield flush()

    arrow_rows(spark, 500)
    placed = squeezed(rows.select("part", "doc_id", "text", "borrowed")).repartition(parts, "part").sortWithinPartitions("part", "borrowed", F.col("doc_id").desc_nulls_last(), "text")
    return placed.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_next double, n_shingles double")
