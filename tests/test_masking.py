"""Masking rules: what must go, what must stay, and that nothing that went is left."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from pagemill.functions.masking import RULES, hits, mask

CASES = [
    ("전화 010-1234-5678번", "전화 [PHONE]번"),
    ("가01012345678나", "가[PHONE]나"),
    ("02-123-4567 / 031-1234-5678", "[PHONE] / [PHONE]"),
    ("+82 10-1234-5678", "[PHONE]"),
    ("4465758382889437 4465758382889437", "[ACCOUNT] [ACCOUNT]"),
    ("국민은행 123456-01-234567 입금", "국민은행 [ACCOUNT] 입금"),
    ("계좌번호: 110-123-456789", "계좌번호: [ACCOUNT]"),
    ("주민 900101-1234567", "주민 [RRN]"),
    ("이름: 홍길동, 담당자 김하늘", "이름: [NAME], 담당자 [NAME]"),
    ("| 성명 | 박구름 |", "| 성명 | [NAME] |"),
    ("a.b@c.co.kr 192.168.0.1", "[EMAIL] [IP]"),
    ("+1 (555) 123-4567", "[PHONE]"),
    ("", ""),
    ("2024-01-02 12345", "2024-01-02 12345"),
]


def test_cases(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)] + [(99, None)], "k int, t string")
    got = {r["k"]: r["m"] for r in df.select("k", mask(F.col("t")).alias("m")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(CASES)} | {99: None}
    off = {r["k"]: r["m"] for r in df.select("k", mask(F.col("t"), on=False).alias("m")).collect()}
    assert off == {k: t for k, (t, _) in enumerate(CASES)} | {99: None}


def test_masking_twice_changes_nothing_and_no_rule_still_matches(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").unionByName(spark.createDataFrame([(t,) for t, _ in CASES], "text string"))
    once = df.select(mask(F.col("text")).alias("text"))
    assert once.where(mask(F.col("text")) != F.col("text")).count() == 0
    assert once.where(F.exists(hits(F.col("text")), lambda h: (h["n"] > 0) & (h["kind"] != "ip"))).count() == 0


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.kind)
def test_no_word_boundaries(rule):
    assert not re.search(r"\\b", rule.pattern)
