"""Token counts by rank-synchronous array merging of a BPE piece vocabulary.

Pre-tokens (a run of word marks and the characters after it; no piece crosses such a border) are counted once for each
batch and held as ragged numpy arrays of symbol numbers. In each round every sequence applies its lowest-rank pair, all
sequences at once; where no pair made with the new symbol can rank below it, all places of that pair in the sequence are
merged in that round, else only the leftmost. Symbols that survive are counted; one outside the vocabulary counts as its
UTF-8 bytes. Counts of pre-tokens met before are remembered, up to a bound, which alters no result. Rounds over an unbroken
run of very many characters would cost its length for each distinct pair; such a run (``LONG``) is merged place by place from
a heap of pairs in the same order, with the same result.

The vocabulary file is parsed here (it is a small protocol-buffer message), so only its pieces and scores are used.
Defined results: a null text is empty and has 0 tokens; strings of control pieces inside a text are ordinary text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from pagemill.llm.common import arrow_rows

MARK = "▁"
LIMIT = 4096
#: Remembered pre-tokens in a Python worker; beyond it the memory starts afresh.
REMEMBERED = 1_000_000
#: Characters of a pre-token from which on it is merged from a heap.
LONG = 4096
_PRETOKEN = regex.compile(f"{MARK}+[^{MARK}]*")
NONE = np.int64(2**31 - 1)


def _varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if b[i - 1] < 128:
            return n, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        elif key & 7 == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if key & 7 == 5 else 8
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a piece vocabulary file."""
    out = []
    with open(path, "rb") as f:
        model = f.read()
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            if piece.get(3, 1) == 1:
                out.append((piece[1].decode(), float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])))
    return out


class PieceCounter:
    def __init__(self, path: str):
        pieces = read_pieces(path)
        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a piece of this vocabulary crosses a word mark")
        number = {p: k for k, (p, _) in enumerate(pieces)}
        scores = np.array([s for _, s in pieces])
        rank = np.unique(-scores, return_inverse=True)[1]
        keys, made = [], []
        for p, k in number.items():
            for cut in range(1, len(p)):
                a, b = number.get(p[:cut]), number.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(k)
        keys, made = np.array(keys, dtype=np.int64), np.array(made, dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], made[order]
        self.rank = rank.astype(np.int64)
        safe = np.ones(len(pieces), dtype=bool)
        ranks = self.rank[self.made]
        for side in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            safe[side[ranks <= self.rank[side]]] = False
        self.safe = safe
        self.table: dict[int, int] = {}
        self.single = {p: k for p, k in number.items() if len(p) == 1}
        self.known: dict[str, int] = {}

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair makes, or -1."""
        want = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (left >= 0) & (right >= 0), self.made[at], -1)

    def merge(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        text = "".join(words)
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        distinct, inverse = np.unique(points, return_inverse=True)
        numbers = np.array([self.single.get(chr(c), -1) for c in distinct], dtype=np.int64)
        # A symbol that is no piece is held as minus the count of its bytes; it takes part in no merge.
        numbers = np.where(numbers >= 0, numbers, -np.array([len(chr(c).encode()) for c in distinct], dtype=np.int64))
        sym = numbers[inverse]
        seq = np.repeat(np.arange(len(words)), lens)
        total = np.zeros(len(words), dtype=np.int64)
        made, ranks = self._ranked(sym, seq)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            spans = np.diff(np.r_[starts, len(seq)])
            best = np.repeat(np.minimum.reduceat(ranks, starts), spans)
            done = best == NONE
            if done.any():
                np.add.at(total, seq[done], np.where(sym[done] >= 0, 1, -sym[done]))
                stay = ~done
                sym, seq, made, ranks, best = sym[stay], seq[stay], made[stay], ranks[stay], best[stay]
                if not len(sym):
                    break
            at = np.flatnonzero(ranks == best)
            own = seq[at]
            first = np.r_[True, own[1:] != own[:-1]]
            # Places that overlap: of a run of neighbours every other one merges, from the left.
            new_run = first | np.r_[True, at[1:] != at[:-1] + 1]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            apart = (np.arange(len(at)) - run_start) % 2 == 0
            unsafe = np.zeros(int(seq[-1]) + 1, dtype=bool)
            unsafe[own[~self.safe[made[at]]]] = True
            at = at[np.where(unsafe[own], first, apart)]
            sym[at] = made[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            sym, seq, made, ranks = sym[keep], seq[keep], made[keep], ranks[keep]
            touched = np.unique(np.r_[moved, np.maximum(moved - 1, 0)])
            nxt = np.minimum(touched + 1, len(sym) - 1)
            m = np.where((nxt > touched) & (seq[nxt] == seq[touched]), self.pairs(sym[touched], sym[nxt]), -1)
            made[touched] = m
            ranks[touched] = np.where(m >= 0, self.rank[m], NONE)
        return total

    def merge_long(self, word: str) -> int:
        """Tokens of one long pre-token: pairs in the order of rank, then place, from a heap."""
        if not self.table:
            self.table = dict(zip(self.keys.tolist(), self.made.tolist(), strict=True))
        table, rank, single = self.table, self.rank.tolist(), self.single
        sym = [single.get(c, -len(c.encode())) for c in word]
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        # An entry is rank, place and made symbol in one number; it holds while the pair at its place still makes that symbol.
        heap = [rank[m] << 64 | i << 32 | m for i, (a, b) in enumerate(zip(sym, sym[1:], strict=False)) if a >= 0 and b >= 0 and (m := table.get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        gone, end = None, len(sym)
        while heap:
            top = heapq.heappop(heap)
            i, m = top >> 32 & 0xFFFFFFFF, top & 0xFFFFFFFF
            a, j = sym[i], after[i]
            if a is gone or a < 0 or j == end or sym[j] < 0 or table.get(a << 32 | sym[j]) != m:
                continue
            sym[i], sym[j] = m, gone
            after[i] = nxt = after[j]
            if nxt != end:
                before[nxt] = i
            for x, y in ((before[i], i), (i, nxt)):
                if x >= 0 and y != end and sym[x] >= 0 and sym[y] >= 0 and (made := table.get(sym[x] << 32 | sym[y])) is not None:
                    heapq.heappush(heap, rank[made] << 64 | x << 32 | made)
        return sum(1 if s >= 0 else -s for s in sym if s is not gone)

    def _ranked(self, sym: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        made = np.full(len(sym), -1, dtype=np.int64)
        if len(sym) > 1:
            made[:-1] = np.where(seq[1:] == seq[:-1], self.pairs(sym[:-1], sym[1:]), -1)
        return made, np.where(made >= 0, self.rank[made], NONE)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        found = [_PRETOKEN.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = list({w for words in found for w in words}.difference(self.known))
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {}
            fresh = list({w for words in found for w in words})
        # Slices of a bounded number of characters: the arrays of a round stay small.
        self.known.update((w, self.merge_long(w)) for w in fresh if len(w) >= LONG)
        fresh = [w for w in fresh if len(w) < LONG]
        part: list[str] = []
        chars = 0
        for w in [*fresh, None]:
            if part and (w is None or chars + len(w) > 1 << 20):
                self.known.update(zip(part, self.merge(part).tolist(), strict=True))
                part, chars = [], 0
            if w is not None:
                part.append(w)
                chars += len(w)
        known = self.known
        return np.array([sum(map(known.__getitem__, words)) for words in found], dtype=np.int64)


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs``; one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            n = own.count(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    arrow_rows(docs.sparkSession, 500)
    kept = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
