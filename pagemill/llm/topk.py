"""Exact top-k search by inner product, with distributed histogram selection.

Queries are taken in slices of a proven size (``SLICE_VALUES`` vector components), which are broadcast to the candidates'
tasks; candidates never move. For a slice, every round scores all candidates against all its queries in blocks and counts
every score in a histogram of the query: bins over the range that is known to hold its kth value, which is all scores at
first. The histograms of all tasks are summed, the bin in which the count from the top reaches k becomes the next round's
range, and bins get narrower by up to ``SHRINK`` bits until they are one score wide. A task's histogram holds ``CELLS``
counters at most, so more queries mean fewer bins a round; of it, bins go out from the top until they hold as many scores as
are looked for: no lower bin can be the one. With the kth value known, one more pass keeps the scores above it and, of the
scores equal to it, the k smallest ids of each task; ties are then broken by id over all tasks.

Scores are exact integers: components that could overflow the fast path's 53 bits are multiplied as Python integers.

Defined results: vectors that are null, empty, or hold null, NaN or infinite components take no part, nor do null ids; only vectors
of equal length are compared; rows that repeat an id are separate candidates, none of which matches a query of that id
(and repeated query rows give one list, that of the largest vector in array order); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_rows

K = 10
SCALE = 1024
#: Components of the queries that are broadcast at once (16 MB).
SLICE_VALUES = 2_000_000
#: Bits by which bins get narrower in a round.
SHRINK = 11
#: Counters of a task's histograms.
CELLS = 1 << 22
_EXACT = 2.0**53
#: Scores counted at once in a task.
_BLOCK = 1 << 20


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    finite = F.forall(F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)


def matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: rows and their scaled components."""
    lens = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    starts = np.r_[0, np.cumsum(lens)]
    return {int(d): (rows := np.flatnonzero(lens == d), flat[starts[rows][:, None] + np.arange(d)]) for d in np.unique(lens)}


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of a and b; int64 where exact in it, else Python integers."""
    bound = a.shape[1] * (np.abs(a).max(initial=0.0) or 0.0) * (np.abs(b).max(initial=0.0) or 0.0)
    if bound < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (a, b)]
    return whole[0] @ whole[1].T


class Slice:
    """Queries by vector length: ids and scaled components."""

    def __init__(self, rows: list):
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in sorted({len(r.vector) for r in rows}):
            own = [r for r in rows if len(r.vector) == d]
            self.by[d] = np.array([r.id for r in own], dtype=np.int64), np.floor(SCALE * np.array([r.vector for r in own], dtype=np.float64))

    def blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """(vector length, which of its queries, candidates' ids, scores: queries x candidates)."""
        ids = batch.column(0).to_numpy()
        for d, (rows, components) in matrix(batch.column(1)).items():
            if d not in self.by:
                continue
            keys, queries = self.by[d]
            step = max(1, _BLOCK // max(1, len(rows)))
            for q in range(0, len(keys), step):
                part = slice(q, min(q + step, len(keys)))
                yield d, part, ids[rows], scores(queries[part], components)


def search(vectors: DataFrame, is_query, k: int = K, key: str = "vec_id", vector: str = "embedding", slice_values: int = SLICE_VALUES) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query``: a condition on the column id."""
    spark = vectors.sparkSession
    arrow_rows(spark, 4096)
    candidates = usable(vectors, key, vector)
    queries = candidates.where(is_query).groupBy("id").agg(F.max("vector").alias("vector"))
    n, longest = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    slices = -(-n * (longest or 1) // slice_values) or 1
    out = None
    for s in range(slices):
        found = _search_slice(spark, candidates, queries.where(F.pmod(F.hash("id"), F.lit(slices)) == s), k)
        out = found if out is None else out.unionByName(found)
    return out


def _search_slice(spark, candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    part = Slice(queries.collect())  # bounded by slice_values
    # The widest score: length times the largest components of either side, as a number of bits.
    most = candidates.select(F.max(F.array_max(F.transform("vector", lambda x: F.abs(F.floor(x.cast("double") * SCALE).cast("double")))))).first()[0] or 0.0
    wide = max((d * max(1, int(np.abs(q).max(initial=0))) for d, (_, q) in part.by.items()), default=1) * max(1, int(most))
    bits = wide.bit_length() + 1
    state = {d: [[-(1 << bits), 1 << (bits + 1), k] for _ in ids] for d, (ids, _) in part.by.items()}  # low end, width, how many from the top of the bin
    # Fewer bits a round where there are many queries.
    step = max(1, min(SHRINK, (CELLS // max(1, sum(len(v) for v in state.values()))).bit_length() - 1))
    width = bits + 1
    while width > 0:
        width = max(0, width - step)
        state = _refine(spark, candidates, part, state, width)
    low = {d: [s[0] for s in v] for d, v in state.items()}
    shared = spark.sparkContext.broadcast((part, low))

    def best(q: np.ndarray, ids: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each query's k highest, equal scores by smaller id."""
        o = np.array(sorted(range(len(q)), key=lambda x: (q[x], -found[x], ids[x])), dtype=np.int64) if found.dtype == object else np.lexsort((ids, -found, q))
        q, ids, found = q[o], ids[o], found[o]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        nth = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        return q[nth < k], ids[nth < k], found[nth < k]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores not below the kth value; what a task holds is cut to each query's k best whenever it has grown."""
        part, low = shared.value
        held: dict[int, tuple] = {}
        for batch in batches:
            for d, which, ids, found in part.blocks(batch):
                keys = part.by[d][0][which]
                floor = np.array(low[d][which], dtype=object if found.dtype == object else np.int64)
                q, c = np.nonzero((found >= floor[:, None]) & (keys[:, None] != ids[None, :]))
                if len(q):
                    new = (keys[q], ids[c], found[q, c])
                    held[d] = best(*(np.concatenate(x) for x in zip(held[d], new, strict=True))) if d in held else best(*new)
        rows = list(held.values()) or [(np.zeros(0, np.int64),) * 3]
        for q, ids, found in rows:
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.int64()), pa.array([str(v) for v in found], pa.string())], ["query_id", "vec_id", "score"])

    kept = candidates.mapInArrow(last, "query_id long, vec_id long, score string")
    # Scores travel as text, so that any size of integer does; those beyond 64 bits end the query with an overflow error.
    kept = kept.withColumn("score", F.col("score").cast("long"))
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _refine(spark, candidates: DataFrame, part: Slice, state: dict, width: int) -> dict:
    """One round: histograms of 2**width-wide bins over every query's range; the new range and what is left to find in it."""
    shared = spark.sparkContext.broadcast((part, state))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = shared.value
        bins = {d: max(s[1] for s in v) >> width for d, v in state.items()}
        hist = {d: np.zeros((len(v), bins[d]), dtype=np.int64) for d, v in state.items()}
        for batch in batches:
            for d, which, ids, found in part.blocks(batch):
                n = bins[d]
                kind = found.dtype if max(abs(s[0]) + s[1] for s in state[d][which]) < 1 << 62 else object
                at = (found.astype(kind, copy=False) - np.array([s[0] for s in state[d][which]], dtype=kind)[:, None]) >> width
                inside = (at >= 0) & (at < n) & (part.by[d][0][which][:, None] != ids[None, :])
                q, c = np.nonzero(inside)
                hist[d][which] += np.bincount(q * n + at[q, c].astype(np.int64), minlength=len(at) * n).reshape(len(at), n)
        qs, at, counts = [], [], []
        for d, h in hist.items():
            # From the top until as many scores are counted as are looked for.
            above = np.cumsum(h[:, ::-1], axis=1)[:, ::-1] - h
            q, b = np.nonzero((h > 0) & (above < np.array([s[2] for s in state[d]])[:, None]))
            qs += [f"{d}/{x}" for x in q]
            at += b.tolist()
            counts += h[q, b].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(qs, pa.string()), pa.array(at, pa.int64()), pa.array(counts, pa.int64())], ["q", "bin", "n"])

    hist = candidates.mapInArrow(count, "q string, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
    running = hist.withColumn("upto", F.sum("n").over(W.partitionBy("q").orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)))
    needs = {f"{d}/{q}": s[2] for d, v in state.items() for q, s in enumerate(v)}
    limits = spark.createDataFrame([(q, n) for q, n in needs.items()] or [("", 0)], "q string, need long")
    # Of each query the highest bin at which the count from the top reaches what it needs; fewer scores than that: the lowest bin.
    reach = running.join(limits, "q").groupBy("q").agg(F.max(F.when(F.col("upto") >= F.col("need"), F.struct("bin", "upto", "n"))).alias("at"), F.min(F.struct("bin", "upto", "n")).alias("lowest"))
    found = {r.q: (r["at"] or r["lowest"]) for r in reach.collect()}  # a row for each query of the slice
    shared.unpersist()
    out: dict = {}
    for d, v in state.items():
        out[d] = []
        for q, (lo, _, need) in enumerate(v):
            at = found.get(f"{d}/{q}")
            out[d].append([lo, 1 << width, need] if at is None else [lo + (at["bin"] << width), 1 << width, max(1, need - (at["upto"] - at["n"]))])
    return out


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
