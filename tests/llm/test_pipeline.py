"""The pipeline's stages, each on all that the one before it kept."""

from __future__ import annotations

import os
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pyspark
from pyspark.sql import functions as F

import corpus_pipeline as p
from pagemill.llm.common import materialize


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "12345 ###", "en", "src0", 9), (9003, "", None, None, 0), (None, "the and of them with a word or two in it", "en", None, 40)], docs.schema.simpleString()[7:-1].replace(":", " "))
    docs = docs.unionByName(odd).unionByName(docs.limit(1)).withColumn("extra", F.lit(1))
    seen = [docs]
    for name, stage in p.STAGES:
        seen.append(materialize(stage(spark, seen[-1], "unused"), f"test-{name}"))
    rows = [d.collect() for d in seen]
    assert all(d.columns == list(p.COLUMNS) for d in seen[1:-1])
    kept = {r["doc_id"] for r in rows[1]}
    assert not {9001, 9002, 9003} & kept and len(rows[1]) == len(rows[0]) - 3
    near = Counter(r["doc_id"] for r in rows[2])
    assert max(near.values()) == 1 and len(rows[2]) < len(rows[1]) and None in near
    assert all(r["text"] and r["n_chars"] == len(r["text"]) for r in rows[3])
    times = Counter(r["doc_id"] for r in rows[4])
    assert set(times) <= {r["doc_id"] for r in rows[3]} and max(times.values()) <= 2
    whole = Counter()
    for r in rows[5]:
        whole[r["doc_id"]] += r["length"]
    assert set(whole) == set(times)


def test_open_languages_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*p.COLUMNS)
    r = random.Random(1)
    noise = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz      ") for _ in range(n)) for n in (200, 1000, 3000)]
    odd = ["안녕하세요 오늘은 날씨가 좋습니다 그래서 밖으로 나갔습니다", "Привет мир как дела сегодня хорошая погода и мы пошли гулять", *noise]
    clean = ["This is an ordinary sentence in English about the weather and the people who walked there."]
    more = spark.createDataFrame([(9_000_000 + k, t, None, "src0", len(t)) for k, t in enumerate(odd + clean)], docs.schema)
    kept = {r["doc_id"] for r in p.language_id(spark, docs.unionByName(more), "unused").select("doc_id").collect()}
    assert not kept & {9_000_000 + k for k in range(len(odd))}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()} | {9_000_000 + len(odd)}


def test_equal_ids_of_different_texts_stay(spark):
    text = lambda k: " ".join(f"w{(k * 7919 + j * 31) % 9973}" for j in range(60))
    rows = [(1, text(1)), (1, text(2)), (1, text(2)), (2, text(1)), (3, text(3)), (3, text(1) + " more"), (4, text(3)), (4, text(4)), (None, text(5)), (None, text(5))]
    docs = spark.createDataFrame([(d, t, "en", "src0", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in p.near_duplicates(spark, docs, "unused").collect())
    assert got == Counter([(1, text(1)), (1, text(2)), (3, text(3)), (4, text(4)), (None, text(5)), (None, text(5))])


def test_repeated_passages_go_and_clean_texts_stay(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    passages = [line(n) for n in range(51, 71)]
    clean = {k: line(r.randint(5, 300)) + " Made under the terms of a short licence." for k in range(40)}
    with_passage = {100 + k: (line(80), passages[k % 20], line(40)) for k in range(60)}
    texts = list(clean.items()) + [(k, "\n".join(t)) for k, t in with_passage.items()]
    docs = spark.createDataFrame([(k, t, "en", "src0", len(t)) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x["doc_id"]: x["text"] for x in p.repeated_strings(spark, docs, "unused").collect()}
    assert {k: got[k] for k in clean} == clean
    # Letters around a passage may be the same by chance.
    assert all(len(a + b) - 8 <= len(got[k].replace("\n", "")) <= len(a + b) and m[8:48] not in got[k] for k, (a, m, b) in with_passage.items())


def test_empty_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for name, stage in p.STAGES:
        docs = materialize(stage(spark, docs, "unused"), f"test-{name}")
        assert docs.count() == 0


LEFT_HEAP = """
import os, sys, pathlib
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
import corpus_pipeline as p
from pagemill.llm import substring_dedup

conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "1000m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": "file://" + sys.argv[1], "spark.sql.shuffle.partitions": "2", "spark.executor.extraJavaOptions": "-XX:InitialHeapSize=900m -XX:MinHeapSize=64m -XX:+AlwaysPreTouch -XX:MetaspaceSize=400m"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")


def executors():
    # What the JVMs of this session's executors hold, in MB.
    found = []
    for d in pathlib.Path("/proc").iterdir():
        try:
            said = (d / "cmdline").read_bytes()
            if d.name.isdigit() and b"CoarseGrainedExecutorBackend" in said and spark.sparkContext.applicationId.encode() in said:
                found.append(int((d / "statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20)
        except OSError:
            pass
    return found


docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
docs.write.format("noop").mode("overwrite").save()
print("HELD", *executors())
if sys.argv[2] == "stage":
    p.language_id(spark, docs, "unused")
else:
    substring_dedup.cleaned(docs)
print("HELD", *executors())
spark.stop()
"""


def left_heap(kind, tmp_path):
    """MB of each executor's JVM before and after."""
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for x in Path(pyspark.__path__[0]).iterdir():
        if x.name != "work":
            (home / x.name).symlink_to(x)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path), "PYSPARK_PYTHON": sys.executable}
    for name in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"):
        env.pop(name, None)
    done = subprocess.run([sys.executable, "-c", LEFT_HEAP, str(tmp_path / "shared"), kind], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    held = [sorted(map(int, x.split()[1:])) for x in done.stdout.splitlines() if x.startswith("HELD")]
    assert len(held) == 2 and all(len(x) == 2 for x in held), done.stdout + done.stderr
    return held


def test_a_stage_begins_without_the_heap_of_those_before(tmp_path):
    before, after = left_heap("stage", tmp_path)
    # An executor may miss a collection.
    assert before[0] > 900 and after[0] < 800 and after[-1] < before[0]


def test_substring_steps_begin_without_the_heap_of_those_before(tmp_path):
    before, after = left_heap("substring", tmp_path)
    # An executor may miss a collection.
    assert before[0] > 900 and after[0] < 800 and after[-1] < before[0]
