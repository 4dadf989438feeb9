"""The whole run over a folder, the change states, the listing, numbering, and the queries against their SQL."""

from __future__ import annotations

import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
from pagemill.operators.documents import changes
from pagemill.operators.numbering import numbered
from pagemill.plans import material
from pagemill.plans.convert import convert, converted, documents, scan
from pagemill.plans.selfcheck import checks
from pagemill.queries import ORACLE, QUERIES
from pagemill.sources.folder import files

SF = "/root/testdata/sf0.001"


def test_selfcheck(spark):
    assert [name for name, passed in checks(spark) if not passed] == []


def test_masked_names_do_not_collide(spark, tmp_path):
    for name, text in (("메모 010-1111-2222.txt", "one"), ("메모 010-3333-4444.txt", "two")):
        (tmp_path / name).write_text(text)
    target = tmp_path / "out"
    read = lambda: sorted(p.read_text().strip() for p in target.glob("*.md") if p.name != "INDEX.md")
    assert convert(spark, str(tmp_path), str(target)) == {"new": 2} and read() == ["one", "two"]
    assert not any("1111" in p.name for p in target.iterdir())
    for name, text in (("메모 010-1111-2222.txt", "three"), ("메모 010-3333-4444.txt", "four")):
        (tmp_path / name).write_text(text)
        assert convert(spark, str(tmp_path), str(target)) == {"changed": 1, "unchanged": 1}
    assert read() == ["four", "three"]


def test_listing_sees_what_a_folder_has(spark, tmp_path):
    os.makedirs(tmp_path / "_변환결과")
    os.makedirs(tmp_path / "_hidden")
    for name in ("a b#%.txt", "_u.txt", ".dot", "empty", "_hidden/x", "~$lock", "_변환결과/out.md"):
        (tmp_path / name).write_bytes(b"" if name == "empty" else b"1")
    os.symlink(tmp_path / ".dot", tmp_path / "link")
    (tmp_path / "한글.txt").write_bytes(b"1")
    got = {r["path"]: r["length"] for r in files(spark, str(tmp_path), "none").collect()}
    assert got == {"a b#%.txt": 1, "_u.txt": 1, ".dot": 1, "empty": 0, "_hidden/x": 1, "한글.txt": 1}


def test_skim_meets_what_a_conversion_does(spark, tmp_path):
    noise = random.Random(5).randbytes(40_000)
    docx = material.package({"word/media/image1.bin": noise, "word/document.xml": f"<w:document {material.W}><w:body/></w:document>"})
    hwp = material.compound_file({"BinData/BIN0001": noise, "FileHeader": b"HWP Document File".ljust(32, b"\0") + bytes(224), "BodyText/Section0": b""})
    found = {"big.docx": docx, "big.hwp": hwp, "more.zip": material.package({"in.docx": docx, "note.txt": "x" * 10, "inner.zip": material.package({"in.hwp": hwp})}), "cut.docx": docx[:30_000], "long.txt": b"y" * 20_000}
    for name, content in found.items():
        (tmp_path / name).write_bytes(content)
    assert min(len(docx), len(hwp)) > 4 * 8192
    got = {r["kind"]: (r["n_files"], r["n_bytes"]) for r in scan(spark, str(tmp_path)).collect()}
    assert got == {"docx": (2, 2 * len(docx)), "hwp": (2, 2 * len(hwp)), "text": (2, 20_010), "empty": (1, 0)}
    assert {k: n for k, (n, _) in got.items()} == {r["kind"]: r["count"] for r in converted(documents(spark, str(tmp_path))).groupBy("kind").count().collect()}


def test_listing_of_an_empty_folder(spark, tmp_path):
    assert files(spark, str(tmp_path)).count() == 0


def test_states(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "doc_id string, sha256 string")
    then = spark.createDataFrame([("a", "1", "o", "1", "p"), ("b", "x", "o", "1", "p"), ("d", "4", "o", "1", "p")], "doc_id string, sha256 string, options_hash string, version string, out_path string")
    state = lambda *a: {r["doc_id"]: r["state"] for r in changes(now, then, *a).collect()}
    assert state("o", "1") == {"a": "unchanged", "b": "changed", "c": "new", "d": "deleted"}
    assert state("other", "1")["a"] == "changed" and state("o", "2")["a"] == "changed"


def test_numbering_is_global(spark):
    df = spark.createDataFrame([(k * 7919 % 1000,) for k in range(1000)] + [(None,)], "k long")
    got = sorted((r["ord"], r["k"]) for r in numbered(df, "k", ranges=8).collect())
    assert got == [(k + 1, k) for k in range(1000)] + [(1001, None)]
    assert numbered(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, db.sql(f"SELECT {', '.join(columns)} FROM want").fetchall()))


# Digits inside secrets, cut-off and Korean numbers, glued addresses, tokens that are there already.
ODD = [
    'token = "199f55dddea0108817963cfd47bc" er', "password=c5e90bd0101058465a die", "01712345678", "010-1234-5678 900101-1234567", "02-123-4567 1234-5678-9012-3456 110-123-456789",
    "이름: 홍길동 계좌번호 110-123-456789", "a@b.c_d@e.fr a@b.c.%x@y.z a@b@c.de a@b.c..d@e.f", "+1 (555) 123-4567+1 (555) 123-45678", "1234567890123456 1234567890123456\n1234567890123456x1234567890123456 12345678901234567",
    "[ACCOUNT] 1234567890123456 [EMAIL] a@b.co [IP] 1.2.3.4 [PHONE]", "1.2.3.4.5.6.7.8 1234.5.6.7890", "\u00a0\u3000 a\u2009b \u00a0", "", None,
]


@pytest.mark.parametrize("name", ["doc_masked", "page_bundle", "index_entries", "pii_hits"])
def test_query_equals_its_sql_on_odd_texts(spark, tmp_path, name):
    pages = [t and f"<html><head><title>{t}</title></head>{t}<body><h1>{t}</h1><p>{t}<br>{t}</p></body></html>{t}" for t in ODD]
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = db.sql(ORACLE[name])
    got = QUERIES[name](spark, str(tmp_path)).select(want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_turns_of_null_stay_in_the_transcript(spark, tmp_path):
    spark.createDataFrame([(1, 1, "user", None), (1, 2, None, "b"), (1, 3, "user", "c")], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert QUERIES["transcript_markdown"](spark, str(tmp_path)).collect()[0]["markdown"] == "**user**: \n\n****: b\n\n**user**: c"


def test_entry(spark):
    assert entry.entry(spark).count() == 50
    assert set(ORACLE) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
