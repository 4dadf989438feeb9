"""Every training-data operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty
tables and extra columns of clashing names."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import chat, components, fingerprints, jaccard_join, language, mixing, packing, substring_dedup, suffix_dedup, token_counts, topk
from pagemill.llm.queries import ORACLE, QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(5)
VOCABULARY = ["".join(RNG.choice(list("abcdefghijé"), size=int(k))) for k in RNG.integers(2, 8, 300)]


def words(n, rng):
    return " ".join(VOCABULARY[k] for k in rng.integers(0, len(VOCABULARY), n))


def corpus():
    """(doc_id, text): copies, near copies, shared passages, short, empty, null and long texts, and repeated rows."""
    rng = np.random.default_rng(11)
    passage, base = words(120, rng), words(150, rng)
    rows = []
    for k in range(40):
        rows.append((k, words(int(rng.integers(1, 200)), rng) + (" " + passage + "\n" + words(20, rng) if k % 4 == 0 else "")))
    for k in range(40, 60):
        w = base.split(" ")
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(0, len(w)))] = "edit" + str(k)
        rows.append((k, " ".join(w)))
    rows += [(60, rows[3][1]), (61, rows[3][1].upper()), (62, ""), (63, None), (64, " \t\n"), (65, "one two"), (66, "one two"), (67, "-" * 3000), (68, "a b " * 400), (69, "a b " * 300), (70, words(6000, rng)), (71, rows[7][1]), (71, rows[7][1]), (72, passage), (-5, passage), (73, "日本語 テキスト 😀 " * 40)]
    return rows


SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    # Columns that operators use inside themselves must not clash.
    return spark.createDataFrame(corpus(), SCHEMA).withColumns({c: F.lit(c) for c in ("uid", "sha", "h", "n", "kind", "component", "bucket", "score", "lang_pred", "part", "t", "d")}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = split((text or "").translate({k: k + 32 for k in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


# --- 1


def test_jaccard_join(docs, none):
    sets = {k: shingles(t) for k, t in corpus()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link(docs).collect()]
    assert sorted(got) == sorted((k, len(sets[k]), find(k)) for k, _ in corpus())
    assert jaccard_join.link(none).count() == 0


def test_jaccard_join_of_hot_shingles(docs, monkeypatch):
    want = sorted(map(tuple, jaccard_join.link(docs).collect()))
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    monkeypatch.setattr(jaccard_join, "SALT", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "HELD", 5)
    assert sorted(map(tuple, jaccard_join.link(docs).collect())) == want


def test_sketch_counts_all_of_a_task(spark):
    docs = spark.range(0, 1500, 1, 2).selectExpr("id AS doc_id", "concat('one two three four five six', id) AS text")
    assert int(jaccard_join._sketch(jaccard_join._profiles(docs)).max()) == 1500


def test_signatures_never_overstate():
    rng = np.random.default_rng(2)
    for n in (1, 5, 100, 900, 3000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n // 2 + 1, dtype=np.uint64)]))
        x, y = (np.frombuffer(jaccard_join.parity(s), dtype=np.uint64)[None] for s in (a, b))
        assert jaccard_join.differ(x, y, x.shape[1], y.shape[1])[0] <= len(np.setxor1d(a, b))


def test_suffix_filter_never_overstates():
    rng = np.random.default_rng(4)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 80, int(rng.integers(0, 60)), dtype=np.uint64)) for _ in range(2))
        true = len(np.setxor1d(x, y))
        for most in (0, 5, 1000):
            bound = jaccard_join.suffix_bound(x, y, most)
            assert bound <= true and jaccard_join.suffix_bound(x, x, most) == 0
    assert jaccard_join.suffix_bound(np.arange(0, 1000, 2), np.arange(1, 1001, 2), 10**6) > 3


def test_jaccard_join_of_a_shared_template(spark):
    """Many documents share a template below the threshold, some pairs link: neither lost nor invented, over many cells."""
    rng = np.random.default_rng(14)
    template = words(70, rng)
    rows = [(k, template + " " + words(40, rng)) for k in range(300)]
    rows += [(1000 + k, rows[7 * k][1] + " end" + str(k)) for k in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {k: k for k, _ in rows} | {1000 + k: 7 * k for k in range(30)}
    old, jaccard_join.BLOCK = jaccard_join.BLOCK, 50
    try:
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link(docs).collect()}
    finally:
        jaccard_join.BLOCK = old
    assert got == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(7, 200), (300, 300), (400, 401), (400, 401)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 5 for k in range(5, 40)} | {200: 5, 400: 400, 401: 400}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 2


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    pieces = packing.pack(docs, vocabulary("byte_bpe_50k.json"), window=256, with_ids=True).collect()
    fill, by = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] > 0 and zlib.crc32(p["ids"]) == p["ids_crc32"]
        fill[p["sequence_id"]].append((p["offset"], p["length"]))
        by[p["doc_id"]].append((p["start"], np.frombuffer(p["ids"], "<u4").tolist(), p["doc_tokens"]))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or (at < 256 and at & (at - 1) == 0)
    for k, text in corpus():
        want = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        copies = Counter(d for d, _ in corpus())[k]
        assert sorted(by[k])[0][0] == 0 and sum(len(i) for _, i, _ in by[k]) == copies * len(want)
        if copies == 1:
            assert [x for _, i, _ in sorted(by[k]) for x in i] == want and {n for *_, n in by[k]} == {len(want)}
    assert packing.pack(none, vocabulary("byte_bpe_50k.json")).count() == 0


def test_packer_keeps_levels_even():
    p = packing.Packer(64, open_limit=16)
    rng = np.random.default_rng(3)
    out = [x for k in range(500) for x in p.add(k, np.arange(int(rng.integers(1, 100)), dtype=np.uint32))]
    assert p.open < 16 and sum(p.levels) == p.open == sum(map(len, p.at))
    out += list(p.flush())
    seen = defaultdict(list)
    for key, start, ids, total, *_ in out:
        seen[key].append((start, len(ids), total))
    for parts in seen.values():
        at = 0
        for start, n, _ in sorted(parts):
            assert start == at
            at += n
        assert at == parts[0][2]


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    own, t = packing.Encoder(vocabulary("byte_bpe_50k.json")), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|>b", "it's 12 o'clock\r\n\t x", "  \n", "é ñ ß ÿ ǅ 日本 😀 ​　", "x" * 5000, *(c for _, c in corpus() if c)]
    texts += ["a" + chr(c) + "1 " + chr(c) + "b " for c in [*range(0x300), *range(0x300, 0x30000, 97)] if not 0xD800 <= c < 0xE000]
    assert all(own(x).tolist() == t.encode(x, add_special_tokens=False).ids for x in texts)


def test_encoder_of_what_the_fast_one_refuses():
    own = packing.Encoder(vocabulary("byte_bpe_50k.json"))
    for text in (" " * 1_000_000, "a" + " " * 1_200_000 + "b", "\n" * 1_000_000):
        assert own(text).tolist() == own.slow.encode(text, add_special_tokens=False).ids
    assert own("still works").tolist() == own.slow.encode("still works", add_special_tokens=False).ids


# --- 3


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=8).round(2).tolist()) for k in range(60)]
    rows += [(100 + k, rows[4][1]) for k in range(30)]  # ties
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (204, []), (None, rows[0][1]), (205, [1.0, 2.0]), (210, [3.0, 1.0]), (0, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1)).repartition(4)
    good = [(k, tuple(math.floor(1024 * x) for x in v)) for k, v in rows if k is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    queries: dict = {}
    for k, v in rows:
        if k is not None and k % 10 == 0 and (k, tuple(math.floor(1024 * x) for x in v or () if x is not None and math.isfinite(x))) in good:
            queries[k] = max(queries.get(k, v), v)
    want = []
    for q, v in queries.items():
        own = [math.floor(1024 * x) for x in v]
        found = sorted((-sum(a * b for a, b in zip(own, c, strict=True)), k) for k, c in good if k != q and len(c) == len(own))[:7]
        want += [(q, r, k, -s) for r, (s, k) in enumerate(found, 1)]
    for values in (topk.SLICE_VALUES, 20):
        got = topk.search(df, F.pmod("id", F.lit(10)) == 0, k=7, slice_values=values).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.search(df.limit(0), F.lit(True)).count() == 0


def test_topk_histograms_take_several_rounds(spark, monkeypatch):
    rng = np.random.default_rng(21)
    rows = [(k, rng.normal(size=4).round(1).tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    want = sorted(map(tuple, topk.search(df, F.pmod("id", F.lit(7)) == 0).collect()))
    monkeypatch.setattr(topk, "CELLS", 100)  # two bins a round
    assert sorted(map(tuple, topk.search(df, F.pmod("id", F.lit(7)) == 0).collect())) == want
    one = spark.createDataFrame([(0, [1.0, 2.0]), (7, [1.0])], "vec_id long, embedding array<double>")
    assert topk.search(one, F.col("id") >= 0).count() == 0


def test_topk_of_large_components(spark):
    df = spark.createDataFrame([(0, [3e6, 1.0]), (1, [2e6, 5.0]), (2, [2e6, 6.0]), (3, [-3e6, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.search(df, F.col("id") == 0, k=2).orderBy("rank").collect()]
    assert got == [(2, 1024 * 1024 * (6 * 10**12 + 6)), (1, 1024 * 1024 * (6 * 10**12 + 5))]


# --- 4


def brute_bytes(rows, length):
    count = Counter()
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        count.update(d[k : k + length] for k in range(len(d) - length + 1))
    out = []
    for (k, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d), dtype=bool)
        for s in range(len(d) - length + 1):
            if count[d[s : s + length]] > 1:
                gone[s : s + length] = True
        runs = int(np.sum(np.diff(np.r_[0, gone.astype(int)]) == 1))
        out.append((k, len(d), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 3])
def test_suffix_dedup(docs, none, group):
    assert sorted(map(tuple, suffix_dedup.cleaned(docs, group=group).collect()), key=str) == brute_bytes(corpus(), 400)
    assert suffix_dedup.cleaned(none).count() == 0


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 3])
def test_suffix_dedup_notes_shorter_repeats(spark, group):
    rng = np.random.default_rng(12)
    short = [words(45, rng)[:260], "é" * 110, "ab" * 100, words(60, rng)[:399]]
    rows = corpus() + [(200 + k, words(30, rng) + " " + short[k % 4] + " " + words(int(rng.integers(0, 60)), rng)) for k in range(16)]
    rows += [(300, "xyz" * 100), (301, "q" * 230 + words(40, rng)), (302, "z" * 230), (303, None), (None, short[0] + "!" + words(100, rng))]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_repeated", F.lit(0)).repartition(3)
    got = [tuple(r) for r in suffix_dedup.cleaned(docs, group=group, note=200).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted((r[:5] for r in got), key=key) == sorted(brute_bytes(rows, 400), key=key)
    assert sorted(((*r[:2], r[5]) for r in got), key=key) == sorted((r[:3] for r in brute_bytes(rows, 200)), key=key)
    assert sorted(map(tuple, suffix_dedup.cleaned(docs, group=group, length=200).collect()), key=key) == sorted(brute_bytes(rows, 200), key=key)


def test_suffix_dedup_keeps_characters_whole(spark):
    rows = [(1, "é" * 250 + "a"), (2, "xx" + "é" * 250), (3, "plain")]
    got = {r["doc_id"]: r["kept"] for r in suffix_dedup.cleaned(spark.createDataFrame(rows, SCHEMA), carry=()).collect()}
    assert got == {1: "a", 2: "xx", 3: "plain"}


# --- 5


def brute_words(rows, length):
    data = [(k, split(t)) for k, t in rows]
    first: dict = {}
    for k, w in data:
        for s in range(len(w) - length + 1):
            first[tuple(w[s : s + length])] = min(k, first.get(tuple(w[s : s + length]), k))
    out = []
    for k, w in data:
        gone = np.zeros(len(w), dtype=bool)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < k:
                gone[s : s + length] = True
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((k, len(w), int(gone.sum()), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("group", [substring_dedup.GROUP, 3])
def test_substring_dedup(docs, none, group):
    assert sorted(map(tuple, substring_dedup.cleaned(docs, group=group).collect())) == brute_words(corpus(), 13)
    assert substring_dedup.cleaned(none).count() == 0


# --- 6


def test_fingerprints(docs, none, spark):
    got = {}
    for r in fingerprints.fingerprints(docs).collect():
        got.setdefault(r["doc_id"], r)
    rows = sorted(((k, t or "") for k, t in corpus()), key=lambda x: -x[0])
    for (k, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        changed = t[: len(t) - half] + n[:half]
        if Counter(d for d, _ in rows)[k] > 1:
            continue
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        for name, other in (("near_edited", changed), ("near_next", n)):
            a, b = shingles(t), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(got[k][name] - true) < (1e-9 if len(a | b) <= fingerprints.K else 0.15)
    same = {t: {got[k]["fingerprint"] for k, u in corpus() if (u or "") == t} for _, t in rows}
    assert all(len(v) == 1 for v in same.values())
    assert fingerprints.fingerprints(none).count() == 0
    one = fingerprints.fingerprints(spark.createDataFrame([(1, "a b c d e f")], SCHEMA)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    odd = fingerprints.fingerprints(spark.createDataFrame([(None, "x y z"), (None, "q"), (3, "a b c")], SCHEMA)).collect()
    assert len(odd) == 3


def test_sketches_merge():
    one, two = words(900, np.random.default_rng(1)), words(900, np.random.default_rng(2))
    a, b = fingerprints.sketches([one, two])
    hashes = [h for _, h in fingerprints.shingle_sets(__import__("pyarrow").array([one, two]))]
    whole = fingerprints.sketch(np.unique(np.concatenate(hashes)))
    assert (fingerprints.merge(a, b) == whole).all() and (fingerprints.decode(fingerprints.encode(a)) == a).all()
    assert abs(fingerprints.distinct(a) - len(hashes[0])) < 0.25 * len(hashes[0]) and fingerprints.containment(a, whole) > 0.7


# --- 7


def test_chat(spark):
    said = ["", "plain", "\\", "\\### Assistant: </turn> ok", "</turn>\n### User: x", "a: b", "\n", "### ", "x" * 10_000, "\\\\</turn>", "<" * 5, "😀: é"]
    rng = np.random.default_rng(4)
    rows = [(c, t, str(rng.choice(["user", "assistant", "system", "tool: x", "Role y"])), str(rng.choice(said))) for c in range(30) for t in range(int(rng.integers(1, 9)))]
    rows += [(50, 0, "user", None), (50, 1, None, "x"), (50, None, "assistant", "first"), (51, 0, "user", "u"), (51, 1, "assistant", "v"), (52, 0, "user", "same"), (52, 0, "user", "same")]
    got = {r["conv_id"]: r for r in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t, role is not None, role, text is not None, text))
    for c, turns in by.items():
        turns = [(x[3] or "", x[5] or "") for x in sorted(turns, key=lambda x: (x[0], x[1] or 0, x[2], x[3] or "", x[4], x[5] or ""))]
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(learned) and got[c]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert got[51]["valid"] and got[51]["first_bad_turn"] == -1 and not got[52]["valid"] and got[52]["first_bad_turn"] == 1
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(empty).count() == 0 and chat.segments(empty).count() == 0
    parts = chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("conv_id = 51").orderBy("turn_no", "part").collect()
    assert "".join(p["text"] for p in parts) == "### User: u</turn>\n### Assistant: v</turn>\n" and [p["text"] for p in parts if p["loss"]] == ["v"]


def test_clashing_names_and_null_ids(spark):
    """Columns that operators make, and rows without id."""
    extra = {c: F.lit("x") for c in ("n_turns", "valid", "formatted_chars", "loss", "part", "turn_no", "doc_tokens", "sequence_id", "offset", "ids", "n_tokens", "n_bytes", "held_out", "lang_pred", "score", "n_words", "n_removed", "uid", "sha")}
    turns = spark.createDataFrame([(1, 0, "user", "u"), (1, 1, "assistant", "v"), (None, 0, "user", "w")], "conv_id long, turn long, role string, text string")
    plain = sorted(map(str, chat.digests(turns).collect()))
    assert sorted(map(str, chat.digests(turns.withColumns(extra)).collect())) == plain and len(plain) == 2
    docs = spark.createDataFrame([(1, "the one and the other", "en"), (2, "der eine und der andere", "de"), (None, "le premier et un autre", "fr"), (None, None, None), (3, words(30, RNG), "en"), (None, words(30, RNG), "en")], "doc_id long, text string, lang string")
    for run in (
        lambda d: language.identify(d),
        lambda d: packing.pack(d, vocabulary("byte_bpe_50k.json")).drop("sequence_id", "offset"),
        lambda d: token_counts.count_tokens(d, vocabulary("piece_bpe_32k.model")),
        lambda d: suffix_dedup.cleaned(d, note=200),
        lambda d: substring_dedup.cleaned(d),
    ):
        one, other = run(docs.repartition(2)), run(docs.withColumns(extra).repartition(2))
        assert one.columns == other.columns and sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
        assert one.where("doc_id is null").count() >= 3


# --- 8


def test_mixing(spark):
    rng = np.random.default_rng(6)
    sources = ["b", "a", None, "é", "tiny", "none"]
    rows = [(k, words(int(rng.integers(1, 60)), rng), sources[k % 4]) for k in range(200)] + [(500, "x", "tiny"), (501, "", "none"), (502, None, "none"), (503, "one two", "a"), (503, "one two", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("h", F.lit(1)).withColumn("size", F.lit(1))
    got = mixing.mix(df).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(split(t))
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: weight[s] * level for s in open_}
    taken = Counter()
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names) and len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0
    # Rows without id are dealt over buckets as well, and come near their target.
    bare = df.withColumn("doc_id", F.lit(None).cast("long"))
    none = mixing.mix(bare).collect()
    own = Counter()
    for r in none:
        own[r["source"]] += r["taken"]
    assert all(abs(own[s] - target[s]) <= 1 for s in names) and sorted(map(str, none)) == sorted(map(str, mixing.mix(bare.repartition(5)).collect()))


# --- 9


def test_language(spark, none):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == r["true"] for r in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 $$", "en"), (3, "", None), (6, "é", None), *((k, "the " * k, "en") for k in range(10, 20))], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[6] == "en"
    assert language.identify(none.withColumn("lang", F.lit("x"))).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_families():
    means = np.array([[1, 0.9, 0, 0], [0.9, 1, 0, 0], [0, 0, 1, 0.8], [0, 0, 0.8, 1.0]])
    means /= np.linalg.norm(means, axis=1, keepdims=True)
    assert sorted(map(sorted, language.families(means))) == [[0, 1], [2, 3]]


# --- 10


def test_token_counts(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = sorted(map(tuple, token_counts.count_tokens(docs, vocabulary("piece_bpe_32k.model")).collect()))
    want = sorted((k, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for k, t in corpus())
    assert got == want
    assert token_counts.count_tokens(none, vocabulary("piece_bpe_32k.model")).count() == 0


def test_merging_is_the_library():
    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model")), token_counts.PieceCounter(vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(9)
    texts = ["", " ", "   a  ", "▁", "▁▁x", "<s></s><unk><0x0A>", "a" * 5000, "ab" * 3000, " " * 100, "\n\t\0", "日本語😀"]
    texts += ["".join(rng.choice(list("abething   0é日\n😀▁"), size=int(n))) for n in rng.integers(1, 300, 400)]
    texts += ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size=8000))]
    assert own.count(texts).tolist() == [len(sp.encode(t)) for t in texts]


def test_long_unbroken_runs_are_the_library():
    import time

    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model")), token_counts.PieceCounter(vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(10)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé日\0"), size=n)) for n in (4000, 5000, 30_000)] + ["ab" * 40_000, "a" * 100_001, "x " + "=-" * 9000 + " y"]
    assert own.count(texts).tolist() == [len(sp.encode(t)) for t in texts]
    began = time.perf_counter()
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size=1_000_000))
    assert own.count([text]).tolist() == [len(sp.encode(text))]
    assert time.perf_counter() - began < 60


# --- queries


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), db.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, db.sql(f"SELECT {', '.join(columns)} FROM want").fetchall()))


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    from pagemill.llm import common

    text = (words(3000, np.random.default_rng(8)) + " " + "w" * 5000 + " end").encode()
    data = np.frombuffer(text, dtype=np.uint8)
    starts, ends, _ = common.word_spans(data, np.array([0, len(data)]))
    whole = common.word_hashes(data, starts, ends, True)
    monkeypatch.setattr(common, "SLICE_BYTES", 512)
    assert (common.word_hashes(data, starts, ends, True) == whole).all()


@pytest.mark.parametrize("lengths", [(400,), (200, 400)])
def test_suffix_dedup_of_very_long_texts(spark, monkeypatch, lengths):
    rows = [(k, t) for k, t in corpus() if t and len(t) > 300]
    rows += [(k + 100, t + t[-500:]) for k, t in rows[:5]]
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(suffix_dedup, "LONG", 700)
    data = (rows[0][1] * 5).encode()
    for k, *found in suffix_dedup.find_anchors(__import__("pyarrow").array([data.decode()]), lengths):
        starts = [s for p, lo, hi in zip(*found[1:], strict=True) if p >= 0 for s in range(lo, hi + 1)]
        assert k == 0 and len(starts) == len(set(starts))
        settled = {s for p, lo, hi in zip(*found[1:], strict=True) if p < 0 for s in range(lo, hi + 1)}
        assert set(starts) | settled == set(range(len(data) - lengths[0] + 1))
    monkeypatch.undo()
    want = sorted(map(tuple, suffix_dedup.cleaned(docs, note=200).collect()))
    assert sorted((r[:5] for r in want), key=str) == brute_bytes(rows, 400)
