"""Operators on files and documents: skim, change detection, and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "2"
MANIFEST = "doc_id string, sha256 string, options_hash string, version string, out_path string"


def doc_key(path: str = "path", member: str = "member"):
    return F.sha2(F.concat(F.col(path), F.lit("!"), F.coalesce(F.col(member), F.lit(""))), 256)


def skim(files: DataFrame, length: str = "length") -> DataFrame:
    """(kind, n_files, n_bytes): what a conversion would meet; a combining aggregate over kinds."""
    return files.groupBy("kind").agg(F.count("*").alias("n_files"), F.sum(F.col(length).cast("long")).alias("n_bytes"))


def changes(now: DataFrame, manifest: DataFrame, options_hash: str, version: str = VERSION) -> DataFrame:
    """(doc_id, state): new, changed, unchanged or deleted against the last run.

    A document is unchanged only if its content, the options of the run (masking among them) and the converter are.
    """
    old = manifest.select("doc_id", F.col("sha256").alias("old_sha"), F.col("options_hash").alias("old_options"), F.col("version").alias("old_version"))
    both = now.select("doc_id", "sha256").join(old, "doc_id", "full_outer")
    same = (F.col("sha256") == F.col("old_sha")) & (F.col("old_options") == options_hash) & (F.col("old_version") == version)
    state = F.when(F.col("old_sha").isNull(), "new").when(F.col("sha256").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return both.select("doc_id", state.alias("state"))


def index_lines(docs: DataFrame) -> DataFrame:
    """(folder, line): entries of the index by folder, in the order of paths."""
    shown = F.when(F.coalesce("title", F.lit("")) == "", F.regexp_extract("out_path", r"([^/]*)\.md$", 1)).otherwise(F.col("title"))
    shown = F.regexp_replace(shown, r"([\[\]])", r"\\$1")
    to = F.regexp_replace(F.regexp_replace("out_path", " ", "%20"), r"([()])", r"\\$1")
    note = F.when(F.col("error").isNotNull() & (F.col("error") != ""), F.concat(F.lit(" — not converted: "), F.col("error"))).otherwise(F.concat(F.lit(" ("), F.col("kind"), F.lit(", "), F.col("n_chars").cast("string"), F.lit(" characters)")))
    return docs.select(F.regexp_extract("out_path", r"^(.*?)/?[^/]*$", 1).alias("folder"), "out_path", F.concat(F.lit("- ["), shown, F.lit("]("), to, F.lit(")"), note).alias("line"))
