"""Language identification by hierarchical discrimination with linear support vector machines.

A text's features are hashed n-grams of its lower-cased letters (UTF-8 bytes, everything else a blank), counted over the
whole text, damped by a logarithm and scaled to unit length. Languages fall into families by the likeness of their mean
vectors (agglomerated while the likeness is above the middle between the least and the greatest). A first machine picks the
family (one against the rest); within it, machines for every two languages decide by votes, equal votes by margins.

Learning uses at most ``PER_LANGUAGE`` labelled documents a language, those with the smallest seeded hashes; features are
made on the executors, so the driver holds PER_LANGUAGE vectors of DIMENSIONS half-precision numbers a language, whatever
the texts' length. Prediction is one pass over all rows without a shuffle; the model (a few vectors) goes to every task.

Whether a text's language stays open is judged on two counts: how far its score is above the least that the score can be (both
machines undecided), and how like it is to the mean of the language chosen. What is usual in a language comes from labelled
documents that a model learned from the other half of them identifies rightly; a text far below the lowest of these is open.

Defined results: a text that is null or has no letter is ``und`` with score 0; where nothing can be learned (no labelled
rows) every text is; with one language only, every other text is it; repeated rows get equal predictions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_rows, text_slices

DIMENSIONS = 4096
ORDERS = (1, 2, 3, 4)
PER_LANGUAGE = 400
UNKNOWN = "und"
SEED = 17
#: A language is open below these parts of the score and likeness that all but the lowest ``LOWEST`` of its documents reach. Likeness
#: also falls with a text's length, so it has the lower bound.
OPEN = (1 / 3, 1 / 5)
LOWEST = 0.01
_LETTER = regex.compile(r"\p{L}")
_KEPT = np.full(256, 32, dtype=np.uint8)
_KEPT[97:123] = np.arange(97, 123)
_KEPT[128:] = np.arange(128, 256)


def features(texts: list[str | None]) -> np.ndarray:
    """A unit vector for each text; zero where it has no n-gram."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for first, data, offs in text_slices(pa.array([(t or "").lower() for t in texts], type=pa.large_string())):
        letters = _KEPT[data].astype(np.uint32)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        cells = np.zeros((len(offs) - 1) * DIMENSIONS, dtype=np.int64)
        for n in ORDERS:
            if len(letters) < n:
                break
            m = len(letters) - n + 1
            h = np.full(m, n, dtype=np.uint32)
            seen = np.zeros(m, dtype=bool)
            for k in range(n):
                h = h * np.uint32(257) + letters[k : k + m]
                seen |= letters[k : k + m] != 32
            h = (h * np.uint32(2654435761)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
            seen &= row[:m] == row[n - 1 :]
            cells += np.bincount(row[:m][seen] * DIMENSIONS + h[seen], minlength=len(cells))
        out[first : first + len(offs) - 1] = np.log1p(cells.reshape(-1, DIMENSIONS))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def machine(x: np.ndarray, y: np.ndarray, rounds: int = 150, c: float = 10.0) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge loss, classes weighed alike) by accelerated gradient steps; y is +-1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    y = y.astype(np.float32)
    weight = (np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c).astype(np.float32)
    w = np.zeros(x.shape[1], dtype=np.float32)
    ahead, step, t = w.copy(), np.float32(1.0 / (1e-3 + 2 * weight.sum() * 2)), 1.0
    for _ in range(rounds):
        slack = np.maximum(np.float32(0), 1 - y * (x @ ahead))
        grad = np.float32(1e-3) * ahead - 2 * ((weight * y * slack) @ x)
        new = ahead - step * grad
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + np.float32((t - 1) / t2) * (new - w), new, t2
    return w[:-1], float(w[-1])


def families(means: np.ndarray) -> list[list[int]]:
    like = means @ means.T
    groups = [[k] for k in range(len(means))]
    if len(means) < 3:
        return groups
    pairs = [like[a, b] for a, b in combinations(range(len(means)), 2)]
    middle = (min(pairs) + max(pairs)) / 2
    while len(groups) > 1:
        best, a, b = max((float(np.mean(like[np.ix_(groups[a], groups[b])])), a, b) for a, b in combinations(range(len(groups)), 2))
        if best <= middle:
            break
        groups[a] += groups.pop(b)
    return groups


class Model:
    def __init__(self, x: np.ndarray, labels: list[str], judge: bool = False):
        self.names = sorted(set(labels))
        y = np.array([self.names.index(s) for s in labels])
        means = np.array([x[y == k].mean(axis=0) for k in range(len(self.names))]) if self.names else np.zeros((0, DIMENSIONS))
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
        self.means = means.astype(np.float32)
        self.groups = families(means)
        family = np.zeros(len(self.names), dtype=int)
        for g, group in enumerate(self.groups):
            family[group] = g
        self.first = [machine(x, np.where(family[y] == g, 1.0, -1.0)) for g in range(len(self.groups))] if len(self.groups) > 1 else []
        self.second = {}
        for group in self.groups:
            for a, b in combinations(group, 2):
                own = (y == a) | (y == b)
                self.second[a, b] = machine(x[own], np.where(y[own] == a, 1.0, -1.0))
        # The score of a text that leaves every machine undecided, by language.
        self.floor = np.zeros(len(self.names))
        for group in self.groups:
            self.floor[group] = 0.5 ** (bool(self.first) + (len(group) > 1))
        self.least = self._least(x, labels) if judge else np.zeros((len(self.names), 2))

    def _least(self, x: np.ndarray, labels: list[str]) -> np.ndarray:
        """Least excess of score and likeness of a settled text by language, each half of the rows judged by a model of the other."""
        nth, seen = np.zeros(len(labels), dtype=int), dict.fromkeys(self.names, 0)
        for k, name in enumerate(labels):
            nth[k], seen[name] = seen[name], seen[name] + 1
        found: dict[str, list[np.ndarray]] = {name: [] for name in self.names}
        for half in (0, 1):
            own, rest = np.flatnonzero(nth % 2 == half), np.flatnonzero(nth % 2 != half)
            if not len(own) or not len(rest):
                continue
            other = Model(x[rest], [labels[k] for k in rest])
            picked, score = other(x[own])
            for k, p, reached in zip(own, picked, other.reached(x[own], picked, score), strict=True):
                if other.names[p] == labels[k]:
                    found[labels[k]].append(reached)
        return np.array(OPEN) * np.array([np.quantile(found[name], LOWEST, axis=0) if found[name] else np.zeros(2) for name in self.names]).reshape(-1, 2)

    def reached(self, x: np.ndarray, picked: np.ndarray, score: np.ndarray) -> np.ndarray:
        """For each vector, the part of the way from the least score to 1, and the likeness to the mean of the language chosen."""
        floor = self.floor[picked]
        return np.stack([(score - floor) / np.maximum(1 - floor, 1e-9), (x * self.means[picked]).sum(axis=1)], axis=1)

    def settled(self, x: np.ndarray, picked: np.ndarray, score: np.ndarray) -> np.ndarray:
        return (self.reached(x, picked, score) >= self.least[picked]).all(axis=1)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and a score from 0 to 1 for each vector."""
        sure = lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
        n = len(x)
        if self.first:
            margins = np.stack([x @ w + b for w, b in self.first], axis=1)
            chosen = margins.argmax(axis=1)
            rest = np.sort(margins, axis=1)
            score = sure((rest[:, -1] - rest[:, -2]) / 2)
        else:
            chosen, score = np.zeros(n, dtype=int), np.ones(n)
        picked = np.zeros(n, dtype=int)
        for g, group in enumerate(self.groups):
            rows = np.flatnonzero(chosen == g)
            votes, total = np.zeros((len(rows), len(group))), np.zeros((len(rows), len(group)))
            for i, j in combinations(range(len(group)), 2):
                w, b = self.second[group[i], group[j]]
                m = x[rows] @ w + b
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                total[:, i] += np.tanh(m)
                total[:, j] -= np.tanh(m)
            best = (votes + 1e-3 * total).argmax(axis=1)
            picked[rows] = np.array(group)[best]
            if len(group) > 1:
                score[rows] *= sure(total[np.arange(len(rows)), best] / (len(group) - 1))
        return picked, score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, judge: bool = False) -> Model:
    """Learns from rows of ``docs`` with a label and a text; the caller leaves out what is held out. ``judge``: also what leaves a language open."""
    spark = docs.sparkSession
    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), (F.xxhash64(F.lit(SEED), F.col(doc_id).cast("string")) / float(2**64) + 0.5).alias("u")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return Model(np.zeros((0, DIMENSIONS), dtype=np.float32), [])
    share = F.element_at(F.create_map(*[F.lit(v) for name, n in counts.items() for v in (name, min(1.0, 1.5 * per_language / n))]), F.col("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x = features(texts).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v.tobytes() for v in x], type=pa.binary())], ["lang", "u", "x"])

    arrow_rows(spark, 200)
    rows = sorted((r["lang"], r["u"], bytes(r["x"])) for r in labelled.where(F.col("u") < share).mapInArrow(run, "lang string, u double, x binary").collect())
    kept, seen = [], dict.fromkeys(counts, 0)
    for name, _, x in rows:
        if seen[name] < per_language:
            seen[name] += 1
            kept.append((name, x))
    return Model(np.stack([np.frombuffer(x, dtype=np.float16) for _, x in kept]).astype(np.float32), [name for name, _ in kept], judge)


def predict(docs: DataFrame, model: Model, text: str = "text", judge: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score (replacing columns of these names); ``judge``: open languages are ``und``."""
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score")
    shared = spark.sparkContext.broadcast(model)  # some vectors of DIMENSIONS numbers for every two languages
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            some = [k for k, t in enumerate(texts) if t and model.names and _LETTER.search(t)]
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if some:
                x = features([texts[k] for k in some])
                picked, score = model(x)
                settled = model.settled(x, picked, score) if judge else np.ones(len(x), dtype=bool)
                for k, p, s, sure in zip(some, picked, score, settled, strict=True):
                    names[k], scores[k] = model.names[p] if sure else UNKNOWN, float(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names), pa.array(scores)], [*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql import types as T

    arrow_rows(spark, 300)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; learned from the rows not held out."""
    model = train(docs.where(~held_out(F.col(doc_id))), doc_id, text, lang, per_language)
    return predict(docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text")), model).drop("text")
