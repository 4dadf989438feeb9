"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source wants ``budget * weight / sum of weights`` words. A source stops at ``max_epochs`` times its size; what it
cannot take is shared among the others by weight, until none is above its cap. The water level that this ends at is found
in one pass: sources in the order of cap/weight, a running sum of the caps below, the weights not yet clamped above.

The sample is a seeded whole and fractional repetition: each document is taken ``floor(target/size)`` times, and the
documents of a source that come first in the order of a seeded hash are taken once more until the rest of the target is
met; of the last one, only as many words as are missing. The hash order is dealt into buckets, so that no source needs to
be sorted in one task: sums for each (source, bucket) give every bucket its offset, and documents are summed in theirs.

Defined results: a null text has size 0; a row without id has its place in the order by its text; a null source is a source, after all others; an empty source has target 0 and
nothing is taken; equal rows are told apart by nothing, so each gets its share in any order; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size) -> with weight and target. A row for each source; ranks and running sums over these few rows."""
    ranked = W.orderBy(F.col("source").asc_nulls_last())
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "nth")
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    wanted = (
        sources.withColumn("nth", F.row_number().over(ranked))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(budget)))
        .withColumn("below", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("below")) / F.col("open"))
    )
    # The level rises from source to source while they are clamped; the first that stays under its cap fixes it.
    fixed = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth_cap", "level"))).over(every)["level"]
    return (
        wanted.withColumn("nth_cap", F.row_number().over(by_cap))
        .withColumn("fixed", fixed)
        .withColumn("target", F.when(F.col("fixed").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("fixed") * F.col("weight"))))
        .select("source", "source_size", "weight", "target")
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, weights: tuple = WEIGHTS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target, taken (words, repeats counted) for each row of ``docs``."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("by_text"))))
    sized = docs.select(F.col(doc_id).alias("doc_id"), word_count(F.col(text)).alias("size"), F.col(source).alias("source"), F.when(F.col(doc_id).isNull(), F.md5(F.coalesce(F.col(text), F.lit("")))).alias("by_text"))
    sized = sized.withColumn("h", order).withColumn("bucket", F.substring("h", 1, 3)).drop("by_text")
    parts = sized.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    sources = parts.groupBy("source").agg(F.sum("part").alias("source_size"))
    targets = water_fill(sources, budget, max_epochs, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.select(F.col("source").alias("s"), "source_size", "target", epochs.alias("whole"), (F.round(F.col("target")).cast("long") - epochs * F.col("source_size")).alias("rest"))
    before = F.coalesce(F.sum("part").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = (
        parts.withColumn("before", before)
        .join(targets, F.col("source").eqNullSafe(F.col("s")))
        .select("s", F.col("bucket").alias("b"), "before", "source_size", "target", "whole", "rest")
    )
    in_bucket = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    # The part's own running sum needs no shuffle of texts: only ids, sizes and hashes move.
    ranked = sized.withColumn("ahead", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    joined = ranked.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    more = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("before") - F.col("ahead")))
    return joined.select("doc_id", "size", "source", "source_size", "target", (F.col("whole") * F.col("size") + more).cast("long").alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, source,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth FROM s),
w AS (SELECT *, CAST([5, 2, 1][CAST((nth - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap,
             1.5::DOUBLE * sum(source_size) OVER () AS budget FROM n),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
             row_number() OVER (ORDER BY cap / weight, nth) AS k FROM w),
f AS (SELECT arg_min(level, k) AS fixed FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN fixed IS NULL THEN cap ELSE least(cap, fixed * weight) END AS target FROM l, f),
e AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t),
r AS (SELECT d.*, source_size, target, whole, CAST(round(target) AS BIGINT) - whole * source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + least(size, greatest(0, rest - ahead)) AS BIGINT) AS taken FROM r
"""
