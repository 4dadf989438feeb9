"""Running numbers in a global order without one task seeing all rows.

Keys are dealt into ranges at bounds from quantiles; rows are numbered within their range and shifted by the counts of the
ranges before, a table of one row for each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: str, name: str = "ord", ranges: int = 64) -> DataFrame:
    """``df`` with a running number from 1 in the order of a numeric key (nulls last)."""
    bounds = sorted(set(df.where(F.col(key).isNotNull()).approxQuantile(key, [k / ranges for k in range(1, ranges)], 0.2 / ranges)))
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(key))) if bounds else F.lit(0)
    placed = df.withColumn("_part", F.when(F.col(key).isNull(), F.lit(len(bounds) + 1)).otherwise(part).cast("int"))
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row for each range
    before, shift = {}, 0
    for p in sorted(sizes):
        before[p] = shift
        shift += sizes[p]
    if not before:
        return placed.withColumn(name, F.lit(1).cast("long")).drop("_part")
    offset = F.element_at(F.create_map(*[F.lit(v) for p, n in before.items() for v in (p, n)]), F.col("_part"))
    return placed.withColumn(name, (F.row_number().over(W.partitionBy("_part").orderBy(key)) + offset).cast("long")).drop("_part")
