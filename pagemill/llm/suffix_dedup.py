"""Exact removal of repeated byte strings, by column-wise construction over many documents.

Every byte that a string of ``length`` bytes covers which also starts anywhere else goes; overlaps count, and strings are
judged on the input. The steps:

1. Texts that are equal form a class; its first row stands for it. Of a class of two or more with ``length`` bytes, all
   bytes are repeated.
2. Anchors (see ``repeats``) whose ``GRAM``-byte gram occurs once are dropped; the contexts of the others are cut out and
   brought together by gram, aligned at their anchors. A repeated window reaches beyond the gram on at least one side by
   half of the rest of its length, so contexts that share neither side with another one take no part in the next step.
3. The contexts of a batch of grams are a collection of short documents, and one symbol of each is inserted a round, from the
   right-most column to the left-most. A round holds the collection's order by suffixes (so its symbols, read in that
   order, are a column of the Burrows-Wheeler transform) and the common prefix of each with the one before; sorting the
   order stably by the new symbols gives the next order, and common prefixes follow from minima over the rows between.
   Contexts enter where their text ends and leave where it begins. A window whose common prefix with a neighbour has
   ``length`` bytes is repeated, and no other is. Several lengths are judged on the same common prefixes: anchors are
   those of the shortest windows, and contexts reach as far as the longest.
4. A gram with more than ``GROUP`` contexts is dealt into shares of about that size. A share settles the windows it sees
   twice; 128-bit digests of the first of its equal windows, in the order of suffixes, are packed, dealt by digest, and those
   seen by two shares are settled too.

The sequential file a round reads is the shuffle's own: contexts arrive sorted by gram and are taken in batches of
``BATCH`` bytes, so memory is bounded whatever the input. Text runs of a short period have an anchor at every period;
there, windows that recur within the document are settled on the spot (by digest, then by their bytes) and only the first of
each goes on.

Defined results: a null text is empty; texts shorter than ``length`` keep all; repeated rows count as copies, rows of equal
id and other text as documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import arrow_rows, discard, inflated, materialize, mix, shuffle_partitions, squeezed, text_slices
from pagemill.llm.repeats import anchor_runs, anchored, classes, keyed, least_in_window, repeated_anchors

LENGTH = 400
#: Passages of over 50 words have at least so many bytes (all but one in a hundred); what is shorter than LENGTH is reported only.
NOTE = 200
GRAM = 32
#: Window starts of a very long text that are looked at together.
LONG = 4 << 20
#: Contexts of a gram that are ordered together.
GROUP = 512
#: Bytes of contexts that are held at once.
BATCH = 8 << 20
_C = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_D = np.random.default_rng(8).integers(1, 2**63, (4, 512), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of GRAM bytes at each place."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    data = np.ascontiguousarray(data)
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data.data, strides=(1,))
    h = eight[:n] * _C[0]
    for k in range(1, GRAM // 8):
        h ^= h >> np.uint64(29)
        h += eight[8 * k : 8 * k + n] * _C[k]
    return mix(h)


def window_digests(data: np.ndarray, length: int) -> np.ndarray:
    """Two 64-bit digests of the ``length`` bytes at each place: by doubling, then the two overlapping halves."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros((0, 2), dtype=np.uint64)
    out = np.empty((n, 2), dtype=np.uint64)
    for s in (0, 1):
        v, have, k = mix(data.astype(np.uint64) + _C[32 + s]), 1, 0
        while 2 * have <= length:
            v = mix(v[:-have] * _C[34 + 2 * k + s] + v[have:])
            have, k = 2 * have, k + 1
        if have < length:
            v = mix(v[: len(v) - (length - have)] * _C[60 + s] + v[length - have :])
        out[:, s] = v[:n]
    return out


def digests_at(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Two 64-bit digests of the ``length`` bytes at some places."""
    out = np.empty((len(at), 2), dtype=np.uint64)
    wide = -(-length // 8)
    windows = np.lib.stride_tricks.sliding_window_view(data, length) if len(at) else None
    for k in range(0, len(at), 20_000):
        held = np.zeros((len(at[k : k + 20_000]), 8 * wide), dtype=np.uint8)
        held[:, :length] = windows[at[k : k + 20_000]]
        words = held.view("<u8")
        for s in (0, 1):
            out[k : k + 20_000, s] = mix((mix(words * _D[s, :wide]) * _D[2 + s, :wide]).sum(axis=1, dtype=np.uint64))
    return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, mask.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def recurring(doc: np.ndarray, lengths: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Of a document's windows of each length: which recur in it; and of its starts, those whose longest window is the first of its kind."""
    every, fresh = [], np.ones(len(doc) - lengths[0] + 1, dtype=bool)
    for length in lengths:
        d = window_digests(doc, length)
        repeats = np.zeros(len(d), dtype=bool)
        if len(d):
            _, first, inverse = np.unique(d.view([("a", np.uint64), ("b", np.uint64)]).reshape(-1), return_index=True, return_inverse=True)
            again = np.flatnonzero(first[inverse] != np.arange(len(d)))
            windows = np.lib.stride_tricks.sliding_window_view(doc, length)
            for k in range(0, len(again), 2000):
                at = again[k : k + 2000]
                same = (windows[at] == windows[first[inverse[at]]]).all(axis=1)
                repeats[at[same]] = True
                repeats[first[inverse[at[same]]]] = True
            if length == lengths[-1]:
                unseen = np.zeros(len(d), dtype=bool)
                unseen[first] = True
                # A start too near the end for the longest window always goes on.
                fresh[: len(d)] = unseen | ~repeats
        every.append(repeats)
    return every, fresh


def _anchors(doc: np.ndarray, hashes: np.ndarray, places: np.ndarray, lengths: tuple[int, ...]) -> list[tuple]:
    """(gram hashes, places, first and last window starts) of a document's anchors, and of runs settled in it (places -1 - level)."""
    p, lo, hi = anchor_runs(places)
    runs = []
    if len(p) > 64 and len(p) > len(doc) // 40:
        settled, fresh = recurring(doc, lengths)
        at = np.repeat(np.arange(len(p)), hi - lo + 1)
        at[~fresh[: len(at)]] = -1
        cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        end = np.r_[cut[1:], len(at)] - 1
        keep = at[cut] >= 0
        p, lo, hi = p[at[cut[keep]]], cut[keep], end[keep]
        for level, mask in enumerate(settled):
            a, b = _runs(mask)
            runs.append((np.zeros(len(a), dtype=np.int64), np.full(len(a), -1 - level), a, b))
    return [(hashes[p].view(np.int64), p, lo, hi), *runs]


def find_anchors(column: pa.Array, lengths: tuple[int, ...]) -> Iterator[tuple]:
    """(row, gram hashes, places, first and last window starts) for each text, with the runs settled in it (places -1 - level).

    Anchors are those of the shortest windows; a longer window has the anchor of its beginning. A text beyond ``LONG`` bytes is
    taken in blocks of so many window starts; an anchor cut in two is two anchors.
    """
    short, most = lengths[0], lengths[-1]
    for first, data, offs in text_slices(column):
        if len(data) < short:
            continue
        if len(offs) == 2 and len(data) > 2 * LONG:
            blocks = [(0, s, data[s : s + LONG + most - 1]) for s in range(0, len(data) - short + 1, LONG)]
            # Starts beyond the first LONG belong to the next block.
            found = ((k, s, _anchors(block, h := gram_hashes(block), least_in_window(h, short - GRAM + 1)[:LONG], lengths)) for k, s, block in blocks)
        else:
            hashes = gram_hashes(data)
            places = least_in_window(hashes, short - GRAM + 1)
            found = ((k, 0, _anchors(data[a:b], hashes[a : b - GRAM + 1], places[a : b - short + 1] - a, lengths)) for k, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)) if b - a >= short)
        held: dict[int, list] = {}
        for k, shift, parts in found:
            held.setdefault(k, []).extend((h, np.where(p < 0, p, p + shift), lo + shift, hi + shift) for h, p, lo, hi in parts)
            if len(offs) > 2:
                yield first + k, *(np.concatenate(c) for c in zip(*held.pop(k), strict=True))
        for k, parts in held.items():
            yield first + k, *(np.concatenate(c) for c in zip(*parts, strict=True))


def columns(gid: np.ndarray, text: list[np.ndarray], p: np.ndarray, lo: np.ndarray, hi: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of each length are repeated among contexts of equal gid, and which are the first of their kind in the order
    of suffixes: flags by (length, context, place of the start from p - lengths[0] + GRAM on).

    ``gid`` ascends. ``text[i]`` are the bytes from lo[i] on of its document, to where the longest window from hi[i] ends; ``p[i]`` its anchor.
    """
    back, n, wide = lengths[0] - GRAM, len(gid), lengths[0] - GRAM + lengths[-1]
    rows = np.zeros((n, wide), dtype=np.uint8)
    begin, last = lo - p + back, hi - p + back
    stop = begin + np.fromiter(map(len, text), dtype=np.int64, count=n)
    for i in range(n):
        rows[i, begin[i] : stop[i]] = text[i]
    flags = np.zeros((len(lengths), n, back + 1), dtype=bool)
    place = np.arange(back + 1)
    firsts = np.repeat(((place >= begin[:, None]) & (place <= last[:, None]))[None], len(lengths), axis=0)
    some = np.flatnonzero(beside(rows, gid, begin, stop, back))
    if len(some):
        flags[:, some], firsts[:, some] = _inserted(np.ascontiguousarray(rows[some].T), gid[some], begin[some], last[some], stop[some], back, lengths)
    return flags, firsts


def beside(rows: np.ndarray, gid: np.ndarray, begin: np.ndarray, stop: np.ndarray, back: int) -> np.ndarray:
    """Which contexts share what stands just before or just after the anchor with another one of their gram.

    A repeated window reaches beyond the gram by ``back`` bytes in all, so by half of that on one side; the others need no order.
    """
    half = min(back // 2, 240) // 8 * 8
    found = np.zeros(len(rows), dtype=bool)
    for side, a, full in ((0, back - half, begin <= back - half), (1, back + GRAM, stop >= back + GRAM + half)):
        at = np.flatnonzero(full)
        if len(at) and half:
            words = np.ascontiguousarray(rows[at, a : a + half]).view("<u8")
            h = mix((mix(words * _C[: half // 8]) * _C[half // 8 : half // 4]).sum(axis=1, dtype=np.uint64) + gid[at].astype(np.uint64) * _C[63 - side])
            _, inverse, size = np.unique(h, return_inverse=True, return_counts=True)
            found[at[size[inverse] > 1]] = True
    return found if half else np.ones(len(rows), dtype=bool)


def _inserted(rows: np.ndarray, gid: np.ndarray, begin: np.ndarray, last: np.ndarray, stop: np.ndarray, back: int, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """``columns``, one symbol of each context a round. ``rows``: a row for each column of the collection."""
    wide, n = rows.shape
    most = np.int16(lengths[-1])
    gid = np.cumsum(np.r_[0, gid[1:] != gid[:-1]]).astype(np.int32)
    flags, firsts = (np.zeros((len(lengths), back + 1, n), dtype=bool) for _ in range(2))
    enters = np.lexsort((gid, -stop)).astype(np.int32)
    entry = np.searchsorted(-stop[enters], -np.arange(wide + 1), side="left")
    order, common = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int16)
    for c in range(wide - 1, -1, -1):
        new = enters[entry[c + 1] : entry[c]] if c + 1 <= wide else enters[:0]
        if len(new):
            # Contexts that end here come with the empty suffix, before all others of their gram.
            order, common = np.concatenate([new, order]), np.concatenate([np.zeros(len(new), dtype=np.int16), common])
            k = np.argsort(gid[order], kind="stable")
            order, common = order[k], common[k]
        if not len(order):
            continue
        key = gid[order] * np.int32(256) + rows[c, order]
        if (key[1:] < key[:-1]).any():
            k = np.argsort(key, kind="stable")
            order, key = order[k], key[k]
            same = key[1:] == key[:-1]
            a, b = k[:-1][same] + 1, k[1:][same] + 1
            at = np.empty(2 * len(a), dtype=np.int64)
            at[0::2], at[1::2] = a, b
            least = np.minimum.reduceat(np.append(common, 0), at)[0::2] if len(at) else common[:0]
        else:
            same = key[1:] == key[:-1]
            least = common[1:][same]
        common = np.zeros(len(order), dtype=np.int16)
        common[1:][same] = np.minimum(least + 1, most)
        if c <= back:
            # A start after the context's last one is another context's, perhaps of the same place in the same text.
            own = np.flatnonzero(last[order] >= c)
            if len(own) in (0, len(order)):
                here, near = order[own], common[: len(own)]
            else:
                here, near = order[own], np.minimum.reduceat(common[: own[-1] + 1], np.r_[0, own[:-1] + 1])
            for level, length in enumerate(lengths if len(own) else ()):
                full = near >= length
                full[0] = False
                firsts[level, c, here[~full]] = True
                full[:-1] |= full[1:]
                flags[level, c, here[full]] = True
        stay = begin[order] < c
        if not stay.all():
            kept = np.flatnonzero(stay)
            if len(kept):
                common = np.minimum.reduceat(common[: kept[-1] + 1], np.r_[0, kept[:-1] + 1])
                common[0] = 0
            else:
                common = common[:0]
            order = order[kept]
            # Of two grams' rows nothing is common.
            if len(order):
                common[np.flatnonzero(np.r_[True, gid[order][1:] != gid[order][:-1]])] = 0
    return flags.transpose(0, 2, 1), firsts.transpose(0, 2, 1)


CONTEXTS = "h long, salt int, shares int, uid binary, p int, lo int, hi int, body binary"


def _contexts(spots: DataFrame, rows: DataFrame, most: int, group: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, data, spot in zip(batch.column(0).to_pylist(), inflated(batch.column(1)), batch.column(2), strict=True):
                s = spot.values
                h, p, lo, hi, m = (s.field(k).to_numpy(zero_copy_only=False) for k in range(5))
                shares = -(-m // group)
                salt = (mix(np.full(len(h), int.from_bytes(uid[:8], "little"), dtype=np.uint64) + lo.astype(np.uint64)) % shares.astype(np.uint64)).astype(np.int32)
                body = [data[int(a) : int(b) + most] for a, b in zip(lo, hi, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(salt), pa.array(shares.astype(np.int32)), pa.array([uid] * len(h), pa.binary()), pa.array(p), pa.array(lo), pa.array(hi), pa.array(body, pa.binary())], ["h", "salt", "shares", "uid", "p", "lo", "hi", "body"])

    return squeezed(rows.select("uid", "text")).join(spots, "uid").select("uid", "text", "spots").mapInArrow(run, CONTEXTS)


FOUND = "uid binary, level int, a int, b int, bucket int, digests binary, uids binary, starts binary, own binary"
_FOUND = pa.schema([("uid", pa.binary()), ("level", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("bucket", pa.int32()), ("digests", pa.binary()), ("uids", pa.binary()), ("starts", pa.binary()), ("own", pa.binary())])


def _judged(contexts: DataFrame, lengths: tuple[int, ...], buckets: int) -> DataFrame:
    """Repeated window starts a..b by uid and level; of shared-out grams also packed digests for ``_across``."""
    back = lengths[0] - GRAM

    def judge(held: list) -> Iterator[pa.RecordBatch]:
        h, salt, shares, p, lo, hi = (np.array([x[k] for x in held]) for k in (0, 1, 2, 4, 5, 6))
        uid = pa.array([x[3] for x in held], pa.binary())
        gid = np.cumsum(np.r_[0, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])])
        text = [np.frombuffer(x[7].as_buffer(), dtype=np.uint8) for x in held]
        flags, firsts = columns(gid, text, p, lo, hi, lengths)
        many = np.flatnonzero(shares > 1)
        keys = np.frombuffer(b"".join(held[k][3] for k in many), dtype="V16")
        crowd = np.concatenate([text[k] for k in many]) if len(many) else None
        size = np.array([len(text[k]) for k in many], dtype=np.int64)
        at = np.cumsum(size) - size
        for level, length in enumerate(lengths):
            edge = np.diff(np.pad(flags[level].astype(np.int8), ((0, 0), (1, 1))), axis=1)
            i, a = np.nonzero(edge == 1)
            _, b = np.nonzero(edge == -1)
            base = p[i] - back
            none = pa.nulls(len(i), pa.binary())
            yield pa.RecordBatch.from_arrays([uid.take(pa.array(i)), pa.array(np.full(len(i), level, dtype=np.int32)), pa.array((base + a).astype(np.int32)), pa.array((base + b - 1).astype(np.int32)), pa.nulls(len(i), pa.int32()), none, none, none, none], schema=_FOUND)
            # Of a share's equal windows the first goes on. Near the end of its document a start may have no window of this length.
            k, c = np.nonzero(firsts[level][many]) if len(many) else (many, many)
            start = c + p[many[k]] - back
            fits = start - lo[many[k]] + length <= size[k]
            k, c, start = k[fits], c[fits], start[fits].astype(np.int32)
            if not len(k):
                continue
            d = digests_at(crowd, at[k] + start - lo[many[k]], length)
            settled, who, o = flags[level][many[k], c], keys[k], np.lexsort((d[:, 1], d[:, 0]))
            to = (d[o, 0] % np.uint64(buckets)).astype(np.int64)
            o = o[np.argsort(to, kind="stable")]
            to = np.sort(to)
            cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
            parts = [o[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            none = pa.nulls(len(parts), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), pa.binary()), pa.array(np.full(len(parts), level, dtype=np.int32)), none, none, pa.array(to[cuts[:-1]].astype(np.int32)), *(pa.array([c[x].tobytes() for x in parts], pa.binary()) for c in (d, who, start, settled))], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size, last = 0, None
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(7)]
            for *row, body in zip(*cols, batch.column(7), strict=True):
                if size > BATCH and (row[0], row[1]) != last:
                    yield from judge(held)
                    held, size = [], 0
                held.append((*row, body))
                size += row[6] - row[5] + lengths[-1]
                last = (row[0], row[1])
        if held:
            yield from judge(held)

    return contexts.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(run, FOUND)


def _across(found: DataFrame, buckets: int) -> DataFrame:
    """Windows that two shares of a gram have seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for level, *raw in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in range(2, 6)), strict=True):
                held.setdefault(level, []).append([np.frombuffer(x.as_buffer(), dtype=kind) for x, kind in zip(raw, (np.uint64, "V16", np.int32, bool), strict=True)])
        for level, parts in held.items():
            d, uid, start, own = (np.concatenate(c) for c in zip(*parts, strict=True))
            d, who = d.reshape(-1, 2), uid.view(np.uint64).reshape(-1, 2)
            o = np.lexsort((d[:, 1], d[:, 0]))
            same = (d[o][1:] == d[o][:-1]).all(axis=1)
            twice = np.zeros(len(o), dtype=bool)
            twice[1:] |= same
            twice[:-1] |= same
            o = o[twice & ~own[o]]
            o = o[np.lexsort((start[o], who[o, 1], who[o, 0]))]
            if len(o):
                cut = np.flatnonzero(np.r_[True, (who[o][1:] != who[o][:-1]).any(axis=1) | (start[o][1:] != start[o][:-1] + 1)])
                yield pa.RecordBatch.from_arrays([pa.array([uid[k].tobytes() for k in o[cut]], pa.binary()), pa.array(np.full(len(cut), level, dtype=np.int32)), pa.array(start[o][cut]), pa.array(start[o][np.r_[cut[1:], len(o)] - 1])], ["uid", "level", "a", "b"])

    packed = found.where("bucket is not null").select("level", "bucket", "digests", "uids", "starts", "own")
    return packed.repartition(buckets, "bucket").mapInArrow(run, "uid binary, level int, a int, b int")


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lengths: tuple[int, ...] = (LENGTH,), group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(rows with uid, doc_id, sha, text), and (uid, whole, runs: array of repeated window starts a..b of a level) where there are any.

    ``lengths`` ascend; levels number them.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 300)
    rows = keyed(docs, doc_id, text)
    ids = rows.withColumn("long_enough", F.octet_length("text") >= lengths[0]).select("uid", "doc_id", "sha", "long_enough")
    ids = materialize(ids, "suffix-ids")
    kinds = materialize(classes(ids), "suffix-classes")
    spots, settled = repeated_anchors(anchored(rows, lambda column: find_anchors(column, lengths)), kinds, across=False, label="suffix")
    buckets = shuffle_partitions(spark)
    judged = materialize(_judged(_contexts(spots, rows, lengths[-1], group), lengths, buckets), "suffix-found")
    discard(spots)
    runs = judged.where("uid is not null").select("uid", "level", "a", "b").unionByName(_across(judged, buckets)).unionByName(settled.withColumnRenamed("kind", "level"))
    whole = ids.where("long_enough").join(kinds.where("copies > 1").select("sha"), "sha", "left_semi").select("uid", F.lit(True).alias("whole"), F.lit(None).cast("struct<level:int,a:int,b:int>").alias("run"))
    every = runs.select("uid", F.lit(False).alias("whole"), F.struct("level", "a", "b").alias("run")).unionByName(whole)
    return rows, every.groupBy("uid").agg(F.max("whole").alias("whole"), F.collect_list("run").alias("runs"))


def covered(data: np.ndarray, whole: bool, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Which bytes windows cover that start from a to b."""
    if whole and len(data) >= length:
        return np.ones(len(data), dtype=bool)
    edge = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(edge, a, 1)
    np.add.at(edge, np.minimum(b + length, len(data)), -1)
    return np.cumsum(edge[:-1]) > 0


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, group: int = GROUP, carry: tuple[str, ...] | None = None, note: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; with ``note``, a shorter length, n_repeated: bytes that such
    strings cover which also start elsewhere (reported, not removed); with ``carry``, also what is left of the text, cut at
    characters, as kept, and the columns named."""
    lengths = (length,) if note is None else (note, length)
    if sorted(set(lengths)) != list(lengths) or lengths[0] < 2 * GRAM or length > 4000:
        raise ValueError(f"lengths must ascend from {2 * GRAM} to 4000")
    rows, found = spans(docs, doc_id, text, lengths, group)
    with_text, carry = carry is not None, carry or ()
    if carry:
        rows = keyed(docs, doc_id, text, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int32)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for t, whole, runs in zip(inflated(batch.column(1)), batch.column(2).to_pylist(), batch.column(3), strict=True):
                data = np.frombuffer(t, dtype=np.uint8)
                s = runs.values
                level, a, b = (s.field(k).to_numpy(zero_copy_only=False) for k in range(3)) if s is not None and len(s) else (none,) * 3
                by = [covered(data, bool(whole), a[level == k], b[level == k], n) for k, n in enumerate(lengths)]
                gone = by[-1]
                kept = data[~gone].tobytes()
                left = None
                if with_text:
                    # A character goes where all its bytes go.
                    if gone.any():
                        starts = np.flatnonzero((data & 0xC0) != 0x80)
                        size = np.diff(np.r_[starts, len(data)])
                        all_gone = np.add.reduceat(gone.astype(np.int32), starts) == size
                        left = data[~np.repeat(all_gone, size)].tobytes().decode()
                    else:
                        left = data.tobytes().decode()
                for c, v in zip(out, (len(data), int(gone.sum()), len(_runs(gone)[0]), hashlib.sha256(kept).hexdigest(), int(by[0].sum()), left), strict=True):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            arrays = [pa.array(c, type=k) for c, k in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays[:4], *arrays[4:5] * (note is not None), *arrays[5:] * with_text, *batch.columns[4:]], names)

    arrow_rows(docs.sparkSession, 300)
    joined = squeezed(rows.select("uid", "doc_id", "text", *carry)).join(found, "uid", "left").select("doc_id", "text", "whole", "runs", *carry)
    fields = [T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()))]
    fields += [T.StructField("n_repeated", T.LongType())] * (note is not None) + [T.StructField("kept", T.StringType())] * with_text + joined.schema.fields[4:]
    names = [f.name for f in fields]
    return joined.mapInArrow(run, T.StructType(fields))
