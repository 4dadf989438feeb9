"""From raw documents to packed training sequences: language ID, near duplicates, repeated strings, mixing, packing.

Each stage takes all that the one before it kept and returns documents (doc_id, text, lang, source, n_chars); the last one
returns the pieces of the packed sequences. Decisions are joined to texts by id, or by a hash of id and text; nothing is collected.

Defined results: rows without id pass the near-duplicate stage as they are; rows of equal id and text count once, those of
equal id and different texts are documents of their own; a text that is wholly repeated leaves no
document; a source without words has none to mix; empty tables pass through all stages as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import jaccard_join, language, mixing, packing, suffix_dedup
from pagemill.llm.common import arrow_rows, give_back, materialize, squeezed, table, unsqueezed
from pagemill.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None
#: Bytes of a repeated string that goes: passages of over 50 words have as many (all but one in a hundred).
REPEATED_BYTES = suffix_dedup.NOTE


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts whose language stays open."""
    give_back(spark)
    model = language.train(docs, judge=True)
    give_back(spark)
    found = language.predict(docs.select(*COLUMNS), model, judge=True)
    return found.where(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def _own_ids(known: DataFrame) -> DataFrame:
    """``known`` with uid, the same for rows of equal id and text, and for those only: the id, or where it has several texts a hash of both."""
    several = known.groupBy("doc_id").agg(F.min(h := F.xxhash64("text")).alias("a"), F.max(h).alias("b"), F.min(F.isnull("text")).alias("c"), F.max(F.isnull("text")).alias("d")).where("a < b or c < d")
    # Written, so that its size is known: mostly it is empty.
    several = materialize(several.select(F.col("doc_id").alias("twice")), "pipeline-ids")
    return known.join(several, F.col("doc_id") == F.col("twice"), "left").withColumn("uid", F.when(F.col("twice").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text"))).drop("twice")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    known = _own_ids(docs.where("doc_id is not null").select(*COLUMNS))
    linked = jaccard_join.link(known, doc_id="uid").select(F.col("doc_id").alias("uid"), "component_id").distinct()
    least = linked.join(known.select("uid", "doc_id").distinct(), "uid").groupBy("component_id").agg(F.min(F.struct("doc_id", "uid")).alias("f"))
    kept = least.select("f.uid")
    arrow_rows(spark, 400)
    give_back(spark)
    staying = squeezed(known).join(kept, "uid", "left_semi").dropDuplicates(["uid"])
    return unsqueezed(staying).select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated strings out of the texts; what has nothing left goes."""
    found = suffix_dedup.cleaned(docs, length=REPEATED_BYTES, carry=("lang", "source"))
    give_back(spark)
    left = found.where((F.col("kept") != "") | (F.col("n_bytes") == 0))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each whole repetition of a document that the mix takes (a fraction of a half or more counts as one)."""
    give_back(spark)
    docs = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("key"))
    times = mixing.mix(docs, doc_id="key").groupBy(F.col("doc_id").alias("key")).agg(F.max(F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")))).cast("int").alias("times")).where("times > 0")
    taken = docs.join(times, "key").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return taken.select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
