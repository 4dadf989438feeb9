"""N-gram Jaccard join: rare-first prefix filter, length, positional and suffix filters, each pair verified once.

A document is the set of its distinct 5-word shingles (64-bit hashes of lower-cased words). Two documents link when
``100 * common >= 75 * union``. The steps:

1. One pass makes every document's set size and digest, and a frequency sketch: ``SKETCH`` counters by shingle hash, summed
   over all documents (its size does not depend on the input). Documents of equal sets form a class; its smallest id stands
   for it. Copies, however many, take no further part.
2. Shingles are ordered rare first by (sketch count, hash), the same order everywhere; a document of n shingles joins on
   its first ``n - ceil(3n/4) + 1``. The sketch only orders, so its collisions cost time, never a link.
3. Prefix shingles are dealt into buckets as packed arrays; those of one document only fall away. Of a shingle that
   m documents share, first only neighbours are paired, in the order of set size and in a seeded order, and each document
   with the one whose shingles are the most usual (the original of a group of near copies): some 3m pairs instead of
   m*m/2. Pairs that pass the length and positional filters are verified once, and linked ones are joined into components.
4. Shingles all of whose documents are by now in one component are done. Of the others, every pair of documents in different
   components that passes the length, positional and suffix filters and was not verified before is verified. So no link
   between components can be missed, and no pairs within a group of near copies are spelled out.
5. The suffix filter bounds from below how many shingles two sets do not share. Where candidates arise, texts are not at
   hand, and signatures stand for the sets: a bit for each of fixed ranges of hashes, whether the set has an odd number in
   it; where bits differ, the sets do. Verification gets both texts by joins on ids, hashes them anew, and bounds the
   difference once more by recursive partition of both sets at a median, before common shingles are counted.

A shingle that far more documents share than others (``HOT`` times) never meets in one array: its rows are salted for step 3.
In step 4 the documents of any shingle are dealt into blocks of about ``BLOCK``, and each pair of blocks is a cell of its own,
so that a large group is spread over many tasks, none of which holds more than two blocks at a time.

Defined results: null and empty texts and texts without words have an empty set and link with nothing; fewer than five
words are one shingle; rows of equal id are one document; rows without id get a null component unless their set has a class;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_rows, discard, materialize, mix, shingle_sets, shuffle_partitions
from pagemill.llm.components import components

#: Share of the union two documents must have in common, as a fraction.
SHARE = (75, 100)
#: Counters of the frequency sketch (a power of two), and the pieces in which it travels.
SKETCH = 1 << 24
PIECES = 256
#: Bits of the longest parity signature; up to that, two to four bits a shingle.
PARITY = 1 << 15
#: Documents of a shingle in a block, on average; rows that a task compares at once.
BLOCK = 512
HELD = 8192
#: How often the suffix filter halves a set.
DEPTH = 3
#: A shingle in more documents than this, and than 4 times what is usual, is hot.
HOT = 50_000
#: Rows of a hot shingle that are ordered together.
SALT = 4096
_PACK = 1 << 20


def least_common(total: np.ndarray | int) -> np.ndarray | int:
    """The common shingles that sets of sizes summing to ``total`` need to link."""
    a, b = SHARE
    return -(-a * total // (a + b))


def prefix_length(n: int) -> int:
    return n - -(-SHARE[0] * n // SHARE[1]) + 1


def parity(shingles: np.ndarray) -> bytes:
    """A bit for each range of hashes: whether the set has an odd number of shingles in it."""
    bits = min(max(256, 1 << (2 * len(shingles) - 1).bit_length()), PARITY)
    return np.packbits((np.bincount((shingles >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sig, bits) of each row, and rows (piece, cells, counts) of each task's share of the sketch, cells not 0 only."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("bits", pa.binary()), ("piece", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])
    step = SKETCH // PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            ns, sigs, bits, waiting, held = [], [], [], [], 0
            counts = np.zeros(SKETCH, dtype=np.uint16) if counts is None else counts
            for _, s in shingle_sets(batch.column(1)):
                ns.append(len(s))
                sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bits.append(parity(s) if len(s) else None)
                waiting.append(s)
                held += len(s)
                if held > _PACK:
                    _count(counts, waiting)
                    waiting, held = [], 0
            _count(counts, waiting)
            none = pa.nulls(len(ns), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bits, pa.binary()), pa.nulls(len(ns), pa.int32()), none, none], schema=schema)
        for k in range(PIECES if counts is not None else 0):
            cells = np.flatnonzero(counts[k * step : (k + 1) * step])
            if len(cells):
                one = counts[k * step + cells].tobytes()
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([cells.astype(np.uint16).tobytes()], pa.binary()), pa.array([one], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n long, sig binary, bits binary, piece int, cells binary, counts binary")


def _count(counts: np.ndarray, sets: list[np.ndarray]) -> None:
    if sets:
        cells, n = np.unique((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.uint32), return_counts=True)
        # As wide as the summed sketch: what a task cuts off here, the sum cuts off anyway.
        counts[cells] = np.minimum(counts[cells] + n, 65535)


def _sketch(profiles: DataFrame) -> np.ndarray:
    """The summed sketch: SKETCH 16-bit counters, whatever the input."""
    step = SKETCH // PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells, raw in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                own = sums.setdefault(k, np.zeros(step, dtype=np.uint32))
                own[np.frombuffer(cells.as_buffer(), dtype=np.uint16)] += np.frombuffer(raw.as_buffer(), dtype=np.uint16)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(s, 65535).astype(np.uint16).tobytes() for s in sums.values()], pa.binary())], ["piece", "counts"])

    out = np.zeros(SKETCH, dtype=np.uint16)
    for r in profiles.where("piece is not null").select("piece", "cells", "counts").repartition("piece").mapInArrow(run, "piece int, counts binary").collect():
        out[r["piece"] * step : (r["piece"] + 1) * step] = np.frombuffer(r["counts"], dtype=np.uint16)
    return out


def _prefixes(docs: DataFrame, sketch) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            ns, tokens, usual = [], [], []
            for _, s in shingle_sets(batch.column(1)):
                ns.append(len(s))
                usual.append(0)
                if len(s):
                    seen = counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                    # s is sorted, so a stable sort by count orders by (count, hash).
                    usual[-1] = int(1000 * np.log1p(seen).mean())
                    tokens.append(s[np.argsort(seen, kind="stable")[: prefix_length(len(s))]].tobytes())
                else:
                    tokens.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(usual, pa.int32()), pa.array(tokens, pa.binary())], ["doc_id", "n", "usual", "prefix"])

    return docs.mapInArrow(run, "doc_id long, n long, usual int, prefix binary").where("prefix is not null")


def _dealt(prefixes: DataFrame, sketch, buckets: int, hot: int) -> DataFrame:
    """Packed (shingle, document, set size, position, how usual its shingles are) by bucket of the shingle; hot shingles apart, in buckets from ``buckets`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        parts: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            t, d, n, p, u = (np.concatenate(c) for c in zip(*parts, strict=True))
            to = (t >> np.uint64(20)).astype(np.int64) % buckets
            busy = counts[(t & np.uint64(SKETCH - 1)).astype(np.int64)] >= hot
            to[busy] = buckets + (mix(d[busy].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(to[order]) > 0, True])
            rows = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int(to[r[0]]) for r in rows], pa.int32())] + [pa.array([c[r].tobytes() for r in rows], pa.binary()) for c in (t, d, n, p, u)], ["bucket", "t", "d", "n", "p", "u"])

        for batch in batches:
            for d, n, usual, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                t = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                parts.append((t, np.full(len(t), d, dtype=np.int64), np.full(len(t), n, dtype=np.int32), np.arange(len(t), dtype=np.int32), np.full(len(t), usual, dtype=np.int16)))
                held += len(t)
                if held >= _PACK:
                    yield from flush()
                    parts, held = [], 0
        if parts:
            yield from flush()

    return prefixes.mapInArrow(run, "bucket int, t binary, d binary, n binary, p binary, u binary")


def possible(na: np.ndarray, pa_: np.ndarray, nb: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Length filter, and positional filter: what may be common before, at and after a match at these positions."""
    na, nb = na.astype(np.int64), nb.astype(np.int64)
    length = SHARE[1] * np.minimum(na, nb) >= SHARE[0] * np.maximum(na, nb)
    most = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_ - 1, nb - pb - 1)
    return length & (most >= least_common(na + nb))


def _neighbours(t, d, n, p, u) -> np.ndarray:
    """Pairs under a shingle: neighbours in two orders, and each document with the one whose shingles are the most usual."""
    if not len(t):
        return np.zeros((0, 2), dtype=np.int64)
    found = []

    def pair(a: np.ndarray, b: np.ndarray) -> None:
        ok = (d[a] != d[b]) & possible(n[a], p[a], n[b], p[b])
        a, b = d[a[ok]], d[b[ok]]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))

    for key in (n, mix(d.astype(np.uint64))):
        o = np.lexsort((d, key, t))
        same = np.flatnonzero(t[o][1:] == t[o][:-1])
        pair(o[same], o[same + 1])
    o = np.lexsort((d, -u.astype(np.int32), t))
    start = np.flatnonzero(np.r_[True, t[o][1:] != t[o][:-1]])
    pair(np.repeat(o[start], np.diff(np.r_[start, len(o)])), o)
    every = np.concatenate(found)
    return np.unique(every, axis=0) if len(every) else every


_GROUPS = "a long, b long, t long, d long, n int, p int, u short, hot boolean"


def _groups(dealt: DataFrame, buckets: int) -> DataFrame:
    """Neighbouring pairs (a, b), and rows (t, d, n, p) of shingles that at least two documents have in their prefixes."""

    def rows(columns: list, names: tuple, size: int) -> pa.RecordBatch:
        types = {"a": pa.int64(), "b": pa.int64(), "t": pa.int64(), "d": pa.int64(), "n": pa.int32(), "p": pa.int32(), "u": pa.int16(), "hot": pa.bool_()}
        given = dict(zip(names, columns, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(given[k], type=v) if k in given else pa.nulls(size, v) for k, v in types.items()], list(types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            for bucket, *raw in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in range(1, 6)), strict=True):
                t, d, n, p, u = (np.frombuffer(x.as_buffer(), dtype=kind) for x, kind in zip(raw, (np.uint64, np.int64, np.int32, np.int32, np.int16), strict=True))
                if bucket >= buckets:
                    yield rows([t.view(np.int64), d, n, p, u, np.ones(len(t), dtype=bool)], ("t", "d", "n", "p", "u", "hot"), len(t))
                else:
                    parts.append((t, d, n, p, u))
        if not parts:
            return
        t, d, n, p, u = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()
        o = np.argsort(t)
        run_start = np.flatnonzero(np.r_[True, t[o][1:] != t[o][:-1]])
        size = np.diff(np.r_[run_start, len(t)])
        o = o[np.repeat(size > 1, size)]
        t, d, n, p, u = t[o], d[o], n[o], p[o], u[o]
        pairs = _neighbours(t, d, n, p, u)
        for k in range(0, len(pairs), 50_000):
            part = pairs[k : k + 50_000]
            yield rows([part[:, 0], part[:, 1]], ("a", "b"), len(part))
        for k in range(0, len(t), 50_000):
            s = slice(k, k + 50_000)
            yield rows([t[s].view(np.int64), d[s], n[s], p[s], u[s], np.zeros(len(t[s]), dtype=bool)], ("t", "d", "n", "p", "u", "hot"), len(t[s]))

    return dealt.repartition(buckets, "bucket").mapInArrow(run, _GROUPS)


def _possible(one: str, other: str):
    """The filters of ``possible`` as a condition on columns n and p of two rows."""
    na, nb, pa_, pb = (F.col(f"{x}.{c}").cast("long") for c in "np" for x in (one, other))
    a, b = SHARE
    most = F.least(pa_, pb) + 1 + F.least(na - pa_ - 1, nb - pb - 1)
    return (F.least(na, nb) * b >= F.greatest(na, nb) * a) & (most * (a + b) >= (na + nb) * a)


def _hot_neighbours(rows: DataFrame) -> DataFrame:
    """Neighbours under hot shingles: within salted shares, and between the heads of shares."""
    salted = rows.withColumn("h", F.xxhash64("d"))
    sizes = salted.groupBy("t").agg(F.count("*").alias("m"), F.max(F.struct("u", F.col("d"), "n", "p")).alias("top"))
    salted = salted.join(sizes, "t").withColumn("salt", F.pmod("h", F.ceil(F.col("m") / SALT))).drop("m")
    linked = lambda near: near.where(_possible("x", "y") & (F.col("x.d") != F.col("y.d"))).select(F.least("x.d", "y.d").alias("a"), F.greatest("x.d", "y.d").alias("b"))
    out = linked(salted.select(F.struct("d", "n", "p").alias("x"), F.struct("top.d", "top.n", "top.p").alias("y")))
    for order in ("n", "h"):
        w = W.partitionBy("t", "salt").orderBy(order, "d")
        ranked = salted.withColumn("before", F.lag(F.struct("d", "n", "p")).over(w)).withColumn("k", F.row_number().over(w))
        heads = ranked.where("k <= 4").withColumn("before", F.lag(F.struct("d", "n", "p")).over(W.partitionBy("t").orderBy("n", "d")))
        near = ranked.unionByName(heads).where("before is not null").select(F.struct("d", "n", "p").alias("x"), F.col("before").alias("y"))
        out = out.unionByName(linked(near))
    return out


def differ(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> np.ndarray:
    """At least so many shingles are in one set only: unequal bits of the signatures (rows of words), folded to the shorter."""
    size = min(size_a, size_b)
    fold = lambda x, n: np.bitwise_xor.reduce(x[:, :n].reshape(len(x), n // size, size), axis=1)
    return np.bitwise_count(fold(a, size_a) ^ fold(b, size_b)).sum(axis=1)


def open_pairs(cell, d, n, p, c, b, bits) -> Iterator[np.ndarray]:
    """Pairs within a cell of different components that pass the length, positional and suffix filters.

    ``b`` is a row's block; where a cell has two, only pairs across them count. The rows of a cell stand in order of set size;
    step by step each row meets the next one after it, until sizes pass the length filter. ``bits``: signatures.
    """
    o = np.lexsort((d, n, cell))
    cell, d, n, p, c, b = cell[o], d[o], n[o].astype(np.int64), p[o], c[o], b[o]
    size = np.fromiter(map(len, bits), dtype=np.int64, count=len(bits))[o] // 8
    words = np.zeros((len(o), int(size.max())), dtype=np.uint64)
    for k, at in enumerate(o):
        words[k, : size[k]] = np.frombuffer(bits[at], dtype=np.uint64)
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    span = np.diff(np.r_[start, len(cell)])
    end = np.repeat(start + span, span)
    two = np.repeat(np.minimum.reduceat(b, start) < np.maximum.reduceat(b, start), span)
    i, step = np.arange(len(cell)), 0
    while len(i):
        step += 1
        i = i[i + step < end[i]]
        i = i[SHARE[1] * n[i] >= SHARE[0] * n[i + step]]
        for k in range(0, len(i), 20_000):
            x = i[k : k + 20_000]
            y = x + step
            ok = (c[x] != c[y]) & (d[x] != d[y]) & (~two[x] | (b[x] != b[y]))
            x, y = x[ok], y[ok]
            ok = possible(n[x], p[x], n[y], p[y])
            x, y = x[ok], y[ok]
            most = n[x] + n[y] - 2 * least_common(n[x] + n[y])
            keep = np.zeros(len(x), dtype=bool)
            for v, w in {(int(v), int(w)) for v, w in zip(size[x], size[y], strict=True)}:
                own = np.flatnonzero((size[x] == v) & (size[y] == w))
                keep[own] = differ(words[x[own]], words[y[own]], v, w) <= most[own]
            if keep.any():
                yield np.unique(np.stack([np.minimum(d[x[keep]], d[y[keep]]), np.maximum(d[x[keep]], d[y[keep]])], axis=1), axis=0)


def _open_pairs(rows: DataFrame, labels: DataFrame, profiles: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """All pairs under a shingle whose documents are in different components and pass the filters; and the steps written for it."""
    marked = rows.join(labels, F.col("d") == F.col("node"), "left").select("t", "d", "n", "p", F.coalesce("component", "d").alias("c"))
    marked = materialize(marked, "jaccard-marked")
    split = marked.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("t", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    # Written before it is joined: right above an aggregate the join of a very common shingle cannot be split.
    split = materialize(split, "jaccard-open")
    bits = profiles.where("bits is not null and doc_id is not null").groupBy("doc_id").agg(F.min("bits").alias("bits"))
    left = marked.join(split, "t").withColumn("b", F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int"))
    left = left.join(bits, F.col("d") == F.col("doc_id")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = left.select("t", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "b", "d", "n", "p", "c", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def judge() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            t, i, j, b, d, n, p, c = (table.column(k).to_numpy() for k in range(8))
            cell = np.cumsum(np.r_[0, (t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            for pairs in open_pairs(cell, d, n, p, c, b, [x.as_buffer() for chunk in table.column(8).chunks for x in chunk]):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

        # Cut where a cell ends, once enough rows are held.
        for batch in batches:
            keys = [tuple(x) for x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            begin = 0
            for k, key in enumerate(keys):
                if key != last and sum(x.num_rows for x in held) + k - begin >= HELD:
                    if k > begin:
                        held.append(batch.slice(begin, k - begin))
                    yield from judge()
                    held, begin = [], k
                last = key
            if begin < len(keys):
                held.append(batch.slice(begin))
        if held:
            yield from judge()

    return cells.repartition("t", "i", "j").sortWithinPartitions("t", "i", "j").mapInArrow(run, "a long, b long"), (marked, split)


def suffix_bound(x: np.ndarray, y: np.ndarray, most: int, depth: int = DEPTH) -> int:
    """At least so many elements are in one of two sorted sets only: by halving one at its median and the other at the same
    value, and each half again. Ends early above ``most``."""
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    middle = len(y) // 2
    k = int(np.searchsorted(x, y[middle]))
    found = int(k < len(x) and x[k] == y[middle])
    one, other = (x[:k], y[:middle]), (x[k + found :], y[middle + 1 :])
    right = abs(len(other[0]) - len(other[1]))
    if abs(k - middle) + right + 1 - found > most:
        return abs(k - middle) + right + 1 - found
    left = suffix_bound(*one, most - right - 1 + found, depth - 1)
    if left + right + 1 - found > most:
        return left + right + 1 - found
    return left + suffix_bound(*other, most - left - 1 + found, depth - 1) + 1 - found


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) those that link."""
    one = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    other = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict = {}
            for k in (0, 1):
                keys, texts = batch.column(k).to_pylist(), batch.column(k + 2)
                first = {key: at for at, key in reversed(list(enumerate(keys)))}
                fresh = [key for key in first if key not in sets]
                for (_, s), key in zip(shingle_sets(texts.take(pa.array([first[key] for key in fresh]))), fresh, strict=True):
                    sets[key] = s
            a, b = [], []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = len(sets[x]) + len(sets[y])
                need = least_common(total)
                if suffix_bound(sets[x], sets[y], total - 2 * need) > total - 2 * need:
                    continue
                if len(np.intersect1d(sets[x], sets[y], assume_unique=True)) >= need:
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    return pairs.join(one, "a").join(other, "b").select("a", "b", "ta", "tb").mapInArrow(run, "u long, v long")


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    spark = docs.sparkSession
    arrow_rows(spark, 400)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    profiles = materialize(_profiles(docs), "jaccard-profiles")
    counts = _sketch(profiles)
    hot = min(65535, max(HOT, 4 * int(np.median(counts))))
    sketch = spark.sparkContext.broadcast(counts)  # SKETCH 16-bit counters
    rows = profiles.where("piece is null").select("doc_id", "n", "sig", "bits")
    classes = rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    buckets = shuffle_partitions(spark)
    reps = _prefixes(docs, sketch).join(classes.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    groups = materialize(_groups(_dealt(reps, sketch, buckets, hot), buckets), "jaccard-groups")
    shingles = groups.where("t is not null").select("t", "d", "n", "p", "u", "hot")
    near = groups.where("a is not null").select("a", "b").unionByName(_hot_neighbours(shingles.where("hot").drop("hot")))
    tried = materialize(near.distinct(), "jaccard-pairs")
    links = materialize(verified(tried, docs).distinct(), "jaccard-links")
    labels = components(links, "jaccard-stars")
    pairs, steps = _open_pairs(shingles.select("t", "d", "n", "p"), labels, rows)
    more = materialize(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
    found = materialize(verified(more, docs).distinct(), "jaccard-links")
    discard(groups, tried, links, more, *steps)
    sketch.unpersist()
    if found.limit(1).count():
        labels = components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(found), "jaccard-stars")
    # Written before it is joined: right above an aggregate the join of a class with very many copies cannot be split.
    ends = materialize(classes.join(labels, F.col("rep") == F.col("node"), "left").select(F.col("sig").alias("s"), F.coalesce("component", "rep").alias("c")), "jaccard-classes")
    out = rows.join(ends, F.col("sig") == F.col("s"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("c")).alias("component_id"))
