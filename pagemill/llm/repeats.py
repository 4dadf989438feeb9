"""What the two exact-repeat operators share: classes of equal texts, anchors, and contexts around repeated anchors.

A window of fixed length has one anchor: its least gram by hash, the leftmost of equal ones. The choice depends on the
window's content only, so equal windows have equal anchors at equal places, and every window start belongs to one anchor.
Anchors are few (two in a window's length); those whose gram occurs once cannot lie in a repeated window and go, and only
the contexts of the others, the stretch their windows span, are cut out of the texts and brought together by gram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import discard, materialize


def keyed(docs: DataFrame, doc_id: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(uid, doc_id, sha, text) and the columns to carry: rows of equal id and text have equal uid, 128 bits of both."""
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *carry)
    kept = kept.withColumn("sha", F.unhex(F.sha2("text", 256)))
    uid = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit("/").cast("binary"), F.col("sha"))))
    return kept.select(uid.alias("uid"), "doc_id", "sha", "text", *carry)


def classes(rows: DataFrame) -> DataFrame:
    """(sha, copies, first: uid of the row with the smallest doc_id, first_doc) of distinct texts."""
    return rows.groupBy("sha").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "uid")).alias("f")).select("sha", "copies", F.col("f.uid").alias("first"), F.col("f.doc_id").alias("first_doc"))


def least_in_window(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each start, the place of the least of ``width`` hashes (by their upper 32 bits, leftmost of equal ones)."""
    v = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    if have < width:
        v = np.minimum(v[: len(v) - (width - have)], v[width - have :])
    return (v & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchor_runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in order, and the first and last start of each one's windows."""
    if not len(places):
        return places, places, places
    lo = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    return places[lo], lo, np.r_[lo[1:], len(places)] - 1


#: What is known of a text without others travels with its anchors: as runs lo..hi of kind -1 - p, with p below 0.
ANCHORED = "uid binary, tag long, h array<long>, p array<int>, lo array<int>, hi array<int>"


def anchored(rows: DataFrame, find: Callable[[pa.Array], Iterator[tuple]]) -> DataFrame:
    """Anchors of each text, with a hash of the whole text as tag. ``find`` gives (row, hashes, places, first starts, last starts) for a batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cols = [], [[], [], [], []]
            for row, *found in find(batch.column(2)):
                if len(found[0]):
                    at.append(row)
                    for c, x in zip(cols, found, strict=True):
                        c.append(x)
            if at:
                offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in cols[0]])], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c).astype(kind))) for c, kind in zip(cols, (np.int64, np.int32, np.int32, np.int32), strict=True)]
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *lists], ["uid", "tag", "h", "p", "lo", "hi"])

    return rows.select("uid", F.xxhash64("sha").alias("tag"), "text").mapInArrow(run, ANCHORED)


def repeated_anchors(found: DataFrame, firsts: DataFrame, across: bool, label: str) -> tuple[DataFrame, DataFrame | None]:
    """(uid, spots: array of (h, p, lo, hi, m)), for each class's first row, of anchors whose gram occurs again (m times in all),
    and (uid, kind, a, b) of the runs that travelled with them.

    ``across``: in another text, and no runs. Then copies need not be left out before grams are counted, which saves a shuffle of all anchors.
    """
    first = firsts.select(F.col("first").alias("uid"))
    one = found if across else found.join(first, "uid", "left_semi")
    every = materialize(one.select("uid", "tag", F.explode(F.arrays_zip("h", "p", "lo", "hi")).alias("x")).select("uid", "tag", "x.h", "x.lo", (F.col("x.p") - F.col("x.lo")).alias("off"), (F.col("x.hi") - F.col("x.lo")).alias("span")), f"{label}-anchors")
    flat = every.where("off >= 0")
    runs = None if across else materialize(every.where("off < 0").select("uid", (-1 - F.col("off") - F.col("lo")).alias("kind"), F.col("lo").alias("a"), (F.col("lo") + F.col("span")).alias("b")), f"{label}-settled")
    counts = flat.groupBy("h").agg(F.count("*").alias("m"), F.min("tag").alias("a"), F.max("tag").alias("b")).where("a < b" if across else "m > 1").select("h", "m")
    # Written first: a join right above an aggregate cannot be split where one gram has very many rows.
    counts = materialize(counts, f"{label}-grams")
    # Two small numbers and a start travel as one.
    packed = flat.select("uid", "h", (F.col("lo").cast("long") * (1 << 24) + F.col("off") * (1 << 12) + F.col("span")).alias("at"))
    rest = F.col("at").bitwiseAND(F.lit((1 << 24) - 1))
    joined = packed.join(counts, "h").select("uid", "h", "m", F.shiftright("at", 24).cast("int").alias("lo"), rest.alias("r"))
    spot = F.struct("h", (F.col("lo") + F.shiftright("r", 12)).cast("int").alias("p"), "lo", (F.col("lo") + F.col("r").bitwiseAND(F.lit((1 << 12) - 1))).cast("int").alias("hi"), "m")
    spots = joined.groupBy("uid").agg(F.collect_list(spot).alias("spots"))
    out = materialize(spots.join(first, "uid", "left_semi") if across else spots, f"{label}-spots")
    discard(every, counts)
    return out, runs
