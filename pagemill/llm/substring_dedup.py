"""Removal of word windows seen in an earlier document, by prefix-partitioned suffix trees.

A window is ``length`` consecutive words of one document. Every word goes that a window covers whose words also start in a
document with a smaller id; windows are judged on the input. The steps:

1. Texts that are equal form a class; of the rows after its first (by id) every window was seen before.
2. Anchors (see ``repeats``; grams of ``GRAM`` words) that only one document has are dropped. The contexts of the others are
   brought together by gram. The gram is the prefix that partitions: all suffixes (window starts) of a gram's contexts are
   in its part, and no window is in two parts.
3. In memory-sized batches of parts, the subtrees of the suffixes are built top-down, one word a level: a node's suffixes
   are split by their next word, and branches with a single suffix are leaves and go. Equal contexts are one path. What
   reaches depth ``length`` is a deep internal node, a repeat; its smallest document id decides.
4. Where a part would not fit in memory (more than ``GROUP`` contexts of one gram), prefixes are lengthened: first to
   stretches of contexts and to whole contexts, of which all but the first are settled, then, for what is left, to the full
   depth, so that each part is one node: its smallest id is a combining minimum over 128-bit digests of its words, and its members meet that minimum in
   a join which Spark may split.

Words are compared by 64-bit hashes, windows of crowded parts by two such hashes that have nothing to do with each other. Defined results: a null text has no words; fewer words than ``length`` are all kept; rows
of equal id are not before each other; a null id comes before all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import _Powers, arrow_rows, discard, give_back, grams, inflated, materialize, mix, squeezed, text_slices, word_hashes, word_spans
from pagemill.llm.repeats import anchor_runs, anchored, classes, keyed, least_in_window, repeated_anchors

LENGTH = 13
GRAM = 5
#: Contexts of a gram that are taken into memory together.
GROUP = 4096
#: Crowded contexts in a stretch, on average.
STRETCH = 4
#: Bytes of contexts that are held at once.
BATCH = 4 << 20
LEAST = -(1 << 63)


def find_anchors(column: pa.Array, length: int) -> Iterator[tuple]:
    """(row, gram hashes, places, first and last window starts, all in words) for each text."""
    for first, data, offs in text_slices(column):
        starts, ends, at = word_spans(data, offs)
        if len(starts) < length:
            continue
        hashes = grams(word_hashes(data, starts, ends, lower=False), GRAM)
        places = least_in_window(hashes, length - GRAM + 1)
        for k in range(len(offs) - 1):
            a, b = int(at[k]), int(at[k + 1])
            if b - a >= length:
                p, lo, hi = anchor_runs(places[a : b - length + 1])
                yield first + k, hashes[p].view(np.int64), p - a, lo, hi


CONTEXTS = "h long, uid binary, doc_id long, lo int, hi int, body binary, crowded array<struct<lo:int,hi:int,d1:bigint,d2:bigint,inner:array<struct<lo:int,hi:int,d1:bigint,d2:bigint,w1:array<bigint>,w2:array<bigint>>>>>"
_PART = [("lo", pa.int32()), ("hi", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())]
_CROWDED = pa.struct([*_PART, ("inner", pa.list_(pa.struct([*_PART, ("w1", pa.list_(pa.int64())), ("w2", pa.list_(pa.int64()))])))])
_CONTEXTS = pa.schema([("h", pa.int64()), ("uid", pa.binary()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("body", pa.binary()), ("crowded", pa.list_(_CROWDED))])


def digest(words: np.ndarray) -> int:
    steps = _Powers.upto(len(words) + 1)[0][: len(words)]
    return int(mix((words * steps).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(words))).view(np.int64)[0])


def _contexts(spots: DataFrame, rows: DataFrame, length: int, group: int) -> DataFrame:
    """A row for each context of a gram, its words in ``body``; of a text's contexts under crowded grams, one row of their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for uid, doc, raw, spot in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), inflated(batch.column(2)), batch.column(3), strict=True):
                data = np.frombuffer(raw, dtype=np.uint8)
                begin, end, _ = word_spans(data, np.array([0, len(data)]))
                s = spot.values
                h, _, lo, hi, m = (s.field(k).to_numpy(zero_copy_only=False) for k in range(5))
                few = m <= group
                for k in np.flatnonzero(few):
                    for c, v in zip(out, (int(h[k]), uid, doc, int(lo[k]), int(hi[k]), raw[begin[lo[k]] : end[hi[k] + length - 1]], None), strict=True):
                        c.append(v)
                if not few.all():
                    words = word_hashes(data, begin, end, lower=False)
                    again = word_hashes(data, begin, end, lower=False, which=1)
                    one, two = grams(words, length), grams(again, length)
                    part = lambda x, y: {"lo": x, "hi": y, "d1": digest(words[x : y + length]), "d2": digest(again[x : y + length])}  # noqa: B023, E731
                    inner = [part(x, y) | {"w1": one[x : y + 1].view(np.int64), "w2": two[x : y + 1].view(np.int64)} for x, y in zip(lo[~few].tolist(), hi[~few].tolist(), strict=True)]
                    inner.sort(key=lambda x: x["lo"])
                    stretches: list[list] = []
                    for x in inner:
                        # Neighbours make a stretch; its ends depend on content, so equal passages are cut alike.
                        if stretches and stretches[-1][-1]["hi"] + 1 == x["lo"] and x["d1"] % STRETCH:
                            stretches[-1].append(x)
                        else:
                            stretches.append([x])
                    every = [part(x[0]["lo"], x[-1]["hi"]) | {"inner": x} for x in stretches]
                    for c, v in zip(out, (None, uid, doc, None, None, None, every), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, _CONTEXTS, strict=True)], schema=_CONTEXTS)

    return squeezed(rows.select("uid", "doc_id", "text")).join(spots, "uid").select("uid", "doc_id", "text", "spots").mapInArrow(run, CONTEXTS)


def seen_before(part: np.ndarray, docs: np.ndarray, bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, window in it) of windows whose words also start in a context of the same part with a smaller document id."""
    # Equal contexts of a part are one path: the smallest id stands for them, and the next may be told by it.
    path: dict = {}
    own = np.array([path.setdefault(x, len(path)) for x in zip(part.tolist(), bodies, strict=True)])
    least = np.full(len(path), np.iinfo(np.int64).max)
    np.minimum.at(least, own, docs)
    text = [body for _, body in path]
    data = np.frombuffer(b" ".join(text), dtype=np.uint8)
    begin, end, at = word_spans(data, np.r_[0, np.cumsum([len(t) + 1 for t in text])[:-1], len(data)])
    _, word = np.unique(word_hashes(data, begin, end, lower=False), return_inverse=True)
    windows = np.diff(at) - length + 1
    which = np.repeat(np.arange(len(path)), windows)
    place = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = at[which] + place
    # Top-down: ``node`` numbers the nodes at the depth reached. Suffixes alone in a node are leaves, but a leaf of a path
    # that stands for several documents is a repeat as well.
    node = np.array([g for g, _ in path], dtype=np.int64)[which]
    alive = np.arange(len(which))
    several = np.bincount(own, minlength=len(path)) > 1
    for depth in range(length):
        _, node, size = np.unique(node * (len(word) + 1) + word[start[alive] + depth], return_inverse=True, return_counts=True)
        stay = (size[node] > 1) | several[which[alive]]
        alive, node = alive[stay], node[stay]
        if not len(alive):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, node, least[which[alive]])
    # Back from paths to contexts.
    told = np.full(len(which), np.iinfo(np.int64).max)
    told[alive] = first[node]
    begins = np.cumsum(windows) - windows
    n = windows[own]
    context = np.repeat(np.arange(len(own)), n)
    window = np.arange(len(context)) - np.repeat(np.cumsum(n) - n, n)
    late = told[begins[own[context]] + window] < docs[context]
    return context[late], window[late]


def _judged(contexts: DataFrame, length: int) -> DataFrame:
    def judge(held: list) -> Iterator[pa.RecordBatch]:
        h, doc, lo = (np.array([x[k] for x in held]) for k in (0, 2, 3))
        uid = pa.array([x[1] for x in held], pa.binary())
        context, window = seen_before(np.cumsum(np.r_[0, h[1:] != h[:-1]]), doc, [x[5] for x in held], length)
        if len(context):
            cut = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (window[1:] != window[:-1] + 1)])
            last = np.r_[cut[1:], len(context)] - 1
            who = context[cut]
            yield pa.RecordBatch.from_arrays([uid.take(pa.array(who)), pa.array((lo[who] + window[cut]).astype(np.int32)), pa.array((lo[who] + window[last]).astype(np.int32))], ["uid", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BATCH and row[0] != last:
                    yield from judge(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
                last = row[0]
        if held:
            yield from judge(held)

    plain = contexts.where("h is not null").select("h", "uid", "doc_id", "lo", "hi", "body")
    return plain.repartition("h").sortWithinPartitions("h").mapInArrow(run, "uid binary, a int, b int")


def _settled(each: DataFrame, inner: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Of parts (uid, doc_id, lo, hi, d1, d2) with equal words all but those of the smallest id are settled; the others' inner."""
    # Minima are written before they are joined: right above an aggregate a join cannot be split.
    least = materialize(each.groupBy("d1", "d2").agg(F.min("doc_id").alias("least")), f"{label}-least")
    judged = materialize(each.join(least, ["d1", "d2"]).select("uid", "doc_id", "lo", "hi", "least", F.when(F.col("doc_id") == F.col("least"), F.expr(inner)).alias("inner")), label)
    return judged.where("doc_id > least").select("uid", F.col("lo").alias("a"), F.col("hi").alias("b")), judged.where("doc_id = least").select("uid", "doc_id", "lo", "inner")


def _crowded(contexts: DataFrame) -> DataFrame:
    """Stretches of contexts first, then contexts of those not settled, then, of what is left, window by window."""
    stretches = contexts.where("h is null").select("uid", "doc_id", F.explode("crowded").alias("x")).select("uid", "doc_id", "x.*")
    settled, rest = _settled(stretches, "inner", "substring-stretches")
    parts = rest.select("uid", "doc_id", F.explode("inner").alias("x")).select("uid", "doc_id", "x.*")
    more, rest = _settled(parts, "arrays_zip(w1, w2)", "substring-crowded")
    windows = rest.select("uid", "doc_id", "lo", F.posexplode("inner").alias("k", "x")).select("uid", "doc_id", (F.col("lo") + F.col("k")).alias("a"), "x.w1", "x.w2")
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w1", "w2", "first")
    first = materialize(first, "substring-windows-least")
    last = windows.join(first, ["w1", "w2"]).where("doc_id > first").select("uid", "a", F.col("a").alias("b"))
    return settled.unionByName(more).unionByName(last)


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""
    spark = docs.sparkSession
    arrow_rows(spark, 300)
    rows = keyed(docs, doc_id, text).withColumn("doc_id", F.coalesce("doc_id", F.lit(LEAST)))
    ids = materialize(rows.select("uid", "doc_id", "sha"), "substring-ids")
    kinds = materialize(classes(ids), "substring-classes")
    spots, _ = repeated_anchors(anchored(rows, lambda column: find_anchors(column, length)), kinds, across=True, label="substring")
    contexts = materialize(_contexts(spots, rows, length, group), "substring-contexts")
    discard(spots)
    runs = materialize(_judged(contexts, length).unionByName(_crowded(contexts)), "substring-runs")
    discard(contexts)
    later = ids.join(kinds.where("copies > 1").select("sha", "first_doc"), "sha").where("doc_id > first_doc")
    whole = later.select("uid", F.lit(True).alias("whole"), F.lit(None).cast("struct<a:int,b:int>").alias("run"))
    every = runs.select("uid", F.lit(False).alias("whole"), F.struct("a", "b").alias("run")).unionByName(whole)
    found = every.groupBy("uid").agg(F.max("whole").alias("whole"), F.collect_list("run").alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for t, whole, spans in zip(inflated(batch.column(1)), batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = t.split()
                kept = words
                if whole:
                    kept = words if len(words) < length else []
                elif spans.values is not None and len(spans.values):
                    a, b = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    edge = np.zeros(len(words) + 1, dtype=np.int32)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, b + length, -1)
                    kept = list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
                for c, v in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    arrow_rows(spark, 300)
    give_back(spark)
    joined = squeezed(rows.select("uid", "doc_id", "text")).join(found, "uid", "left").select(F.nullif("doc_id", F.lit(LEAST)).alias("doc_id"), "text", "whole", "runs")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
