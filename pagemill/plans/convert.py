"""Converting a folder: list, expand, sniff, skip what is unchanged, parse, mask, write, index."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.masking import mask
from pagemill.functions.parse import parsed
from pagemill.operators.documents import MANIFEST, VERSION, changes, doc_key, index_lines, skim
from pagemill.sources.archives import expanded, met
from pagemill.sources.bundle import INDEX, safe_path, write_bundle, write_file
from pagemill.sources.folder import OUTPUT, files

STATE = ".manifest"
WARNING = "개인정보 가리기는 완벽하지 않으므로 공개하기 전에 사람이 확인해야 합니다. / Masking is not perfect; check before publishing."

_place = F.udf(safe_path, T.StringType())


def scan(spark: SparkSession, root: str, output: str = OUTPUT) -> DataFrame:
    """(kind, n_files, n_bytes) of a folder, archives as their members; writes nothing.

    Packages and compound files are read whole, as only all of them tells their kind; of the others the heads.
    """
    return skim(met(files(spark, root, "inside", output)))


def documents(spark: SparkSession, root: str, output: str = OUTPUT) -> DataFrame:
    """(doc_id, path, member, length, content, problem, sha256) of every file, archives opened."""
    found = expanded(files(spark, root, "all", output))
    return found.withColumn("doc_id", doc_key()).withColumn("sha256", F.sha2(F.coalesce("content", F.encode(F.coalesce("problem", F.lit("")), "UTF-8")), 256))


def converted(docs: DataFrame, masking: bool = True) -> DataFrame:
    """(doc_id, path, member, sha256, out_path, kind, title, markdown, n_chars, error): parsed, rendered, then masked.

    Titles, paths and errors are masked too: they reach the index.
    """
    done = docs.withColumn("p", parsed(F.col("content")))
    error = F.coalesce(F.col("problem"), F.col("p.error"))
    out = done.select("doc_id", "path", "member", "sha256", "p.kind", mask(F.col("p.title"), masking).alias("title"), mask(F.col("p.markdown"), masking).alias("markdown"), mask(error, masking).alias("error"))
    shown = mask(F.col("path"), masking), mask(F.col("member"), masking)
    return out.withColumn("n_chars", F.char_length("markdown").cast("long")).withColumn("out_path", _place(*shown))


def convert(spark: SparkSession, root: str, output: str | None = None, masking: bool = True) -> dict[str, int]:
    """Converts what is new or changed under ``root`` and writes the bundle; gives the counts of states.

    ``output`` is a folder all executors see; by default ``_변환결과`` in the root, which the listing leaves out.
    """
    target = os.path.abspath(output or os.path.join(root, OUTPUT))
    os.makedirs(target, exist_ok=True)
    state = os.path.join(target, STATE)
    options = f"mask={masking}"
    manifest = spark.read.parquet(state).select("doc_id", "sha256", "options_hash", "version", "out_path", "kind", "title", "n_chars", "error") if os.path.isdir(state) else spark.createDataFrame([], f"{MANIFEST}, kind string, title string, n_chars long, error string")
    now = documents(spark, root, os.path.basename(target))
    found = changes(now, manifest, options).join(manifest.select("doc_id", "out_path"), "doc_id", "left")
    # Unchanged, but its file is gone: convert again.
    there = F.udf(lambda p: p is not None and os.path.isfile(os.path.join(target, p)), "boolean")
    found = found.withColumn("state", F.when((F.col("state") == "unchanged") & ~there("out_path"), "changed").otherwise(F.col("state")))
    # Written before any result is: judged again later, a file that this run restores would count as unchanged.
    stage = os.path.join(target, STATE + ".next")
    found.write.mode("overwrite").parquet(stage + ".states")
    found = spark.read.parquet(stage + ".states")
    todo = found.where("state in ('new', 'changed')").select("doc_id")
    fresh = converted(now.join(todo, "doc_id", "left_semi"), masking)
    kept = manifest.join(found.where("state = 'unchanged'").select("doc_id"), "doc_id", "left_semi")
    # Two documents may come to one place (masked names, replaced characters): only one that no kept document holds it
    # against, the first by id, gets the plain name; the others' ids tell them apart.
    low = F.lower("out_path").alias("low")
    taken = fresh.groupBy(low).agg(F.min("doc_id").alias("first")).join(kept.select(low, F.lit(True).alias("held")).distinct(), "low", "left")
    plain = (F.col("doc_id") == F.col("first")) & F.col("held").isNull()
    told = F.concat(F.expr("left(out_path, length(out_path) - 3)"), F.lit("-"), F.substring("doc_id", 1, 8), F.lit(".md"))
    fresh = fresh.join(taken, F.lower("out_path") == F.col("low")).withColumn("out_path", F.when(plain, F.col("out_path")).otherwise(told)).drop("low", "first", "held")
    made = fresh.withColumn("options_hash", F.lit(options)).withColumn("version", F.lit(VERSION))
    made.write.mode("overwrite").parquet(stage + ".docs")
    made = spark.read.parquet(stage + ".docs")
    write_bundle(made, target).write.format("noop").mode("append").save()
    columns = ["doc_id", "sha256", "options_hash", "version", "out_path", "kind", "title", "n_chars", "error"]
    every = kept.select(*columns).unionByName(made.select(*columns))
    every.write.mode("overwrite").parquet(stage)
    counts = {r["state"]: r["n"] for r in found.groupBy("state").agg(F.count("*").alias("n")).collect()}
    # Results of documents that are gone, or that moved, go as well.
    left = spark.read.parquet(stage).select("out_path")
    for r in manifest.join(left, "out_path", "left_anti").select("out_path").toLocalIterator():
        if os.path.isfile(os.path.join(target, r[0])):
            os.remove(os.path.join(target, r[0]))
    write_index(spark.read.parquet(stage), target)
    _replace(stage, state)
    _remove(stage + ".docs")
    _remove(stage + ".states")
    return counts


def write_index(docs: DataFrame, target: str) -> None:
    """INDEX.md, one file, streamed entry by entry in the order of paths; the driver holds one part of the entries at a time."""

    def lines() -> Iterator[str]:
        yield from ("# INDEX", "", f"> {WARNING}", "")
        folder = None
        for r in index_lines(docs).orderBy("folder", "out_path").toLocalIterator():
            if r["folder"] != folder:
                yield from ("", f"## {r['folder'] or '.'}", "")
                folder = r["folder"]
            yield r["line"]

    write_file(target, INDEX, (line + "\n" for line in lines()))


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def _replace(fresh: str, state: str) -> None:
    old = state + ".old"
    _remove(old)
    if os.path.isdir(state):
        os.replace(state, old)
    os.replace(fresh, state)
    _remove(old)
