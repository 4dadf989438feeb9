"""Sum-of-squares online packing of token sequences into windows.

Each task packs the documents of its input split as they come. A document's ids (and the end id) are cut into whole
windows and one remainder. The remainder goes to the fill level that minimises the sum of the squared counts of partially
filled windows: a level array holds, for every fill from 1 to window-1, how many open windows stand at it, and the place
with the least change of that sum is one vector operation. At the end of the split, or when the open windows reach
``open_limit`` (a bound of memory), what is still open is laid end to end into whole windows, cutting where they end; the
last stretch of a split is cut at powers of two, which need no padding. So nothing is padded, whatever the sizes.

Sequence ids are ``partition * 2**40 + n``, so tasks number independently and a task that runs again gives the same rows.
Only digests of pieces leave the task. A text of any length is encoded as a whole.

Ids are those of the byte-level BPE file's own library. They are computed with the faster encoder of the same vocabulary
and merges; texts with a code point that the two libraries' pattern engines class differently go to the first, and so do
texts that the faster one gives up on (very long runs of blanks).

Defined results: a null or empty text is just the end id; repeated rows are separate documents; an empty table gives none.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pagemill.llm.common import arrow_rows

WINDOW = 2048
END_ID = 1
OPEN_LIMIT = 8192
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of the vocabulary file (byte-level BPE), special tokens in a text as the library takes them."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(letters[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)

    def __call__(self, text: str) -> np.ndarray:
        if not text.isascii() and max(text) > "ɏ":
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        try:
            return self.fast.encode_to_numpy(text, allowed_special=self.special).astype(np.uint32, copy=False)
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # noqa: BLE001  its pattern engine gives up on very long runs, with a panic that is no Exception
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Takes (key, ids), gives pieces (key, start, ids, total, sequence, offset) as windows close."""

    def __init__(self, window: int = WINDOW, open_limit: int = OPEN_LIMIT):
        self.window, self.open_limit = window, open_limit
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.at: list[list[list]] = [[] for _ in range(window)]
        self.open = self.sequence = 0

    def _close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for key, start, ids, total in pieces:
            yield key, start, ids, total, self.sequence, offset
            offset += len(ids)
        self.sequence += 1

    def add(self, key: object, ids: np.ndarray) -> Iterator[tuple]:
        total, window, start = len(ids), self.window, 0
        while total - start >= window:
            yield from self._close([(key, start, ids[start : start + window], total)])
            start += window
        size = total - start
        if not size:
            return
        n = self.levels
        # Change of the sum of squares for putting it on level h: the level h loses a window, h + size gains one.
        change = 2 * (n[size : window + 1] - n[: window + 1 - size]) + 2
        change[0] = 2 * n[size] + 1
        change[-1] = 1 - 2 * n[window - size]
        change[1:][n[1 : window + 1 - size] == 0] = np.iinfo(np.int64).max
        h = len(change) - 1 - int(np.argmin(change[::-1]))  # of equal ones the fullest
        pieces = self.at[h].pop() if h else []
        pieces.append((key, start, ids[start:], total))
        if h:
            n[h] -= 1
            self.open -= 1
        if h + size == window:
            yield from self._close(pieces)
        else:
            n[h + size] += 1
            self.open += 1
            self.at[h + size].append(pieces)
            if self.open >= self.open_limit:
                yield from self.flush(last=False)

    def flush(self, last: bool = True) -> Iterator[tuple]:
        """Lay what is open end to end; what fills no window stays open, or is cut at powers of two if it is the last."""
        row: list = []
        filled = 0
        rest = [p for level in reversed(self.at) for pieces in level for p in pieces]
        self.levels[:] = 0
        self.at = [[] for _ in range(self.window)]
        self.open = 0
        for key, start, ids, total in rest:
            while filled + len(ids) >= self.window:
                cut = self.window - filled
                yield from self._close([*row, (key, start, ids[:cut], total)])
                row, filled, start, ids = [], 0, start + cut, ids[cut:]
            if len(ids):
                row.append((key, start, ids, total))
                filled += len(ids)
        if filled and not last:
            self.levels[filled], self.open = 1, 1
            self.at[filled].append(row)
            return
        while filled:
            target, own, have = 1 << (filled.bit_length() - 1), [], 0
            filled -= target
            while have < target:
                key, start, ids, total = row.pop(0)
                cut = min(target - have, len(ids))
                own.append((key, start, ids[:cut], total))
                have += cut
                if cut < len(ids):
                    row.insert(0, (key, start + cut, ids[cut:], total))
            yield from self._close(own)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, open_limit: int = OPEN_LIMIT, with_ids: bool = False) -> DataFrame:
    """A row for each piece; ``with_ids`` adds the piece's ids (little-endian unsigned 32-bit). One pass, no shuffle."""
    kept = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    id_type = kept.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, base = encoder(path), Packer(window, open_limit), TaskContext.get().partitionId() << 40
        key_type = None
        out: list[list] = [[] for _ in range(8)]

        def put(pieces: Iterator[tuple]) -> None:
            for key, start, ids, total, sequence, offset in pieces:
                raw = ids.astype("<u4").tobytes()
                for column, value in zip(out, (key, start, len(ids), zlib.crc32(raw), total, base + sequence, offset, raw if with_ids else None), strict=True):
                    column.append(value)

        def batch_out() -> pa.RecordBatch:
            arrays = [pa.array(out[0], type=key_type)] + [pa.array(c, type=pa.int64()) for c in out[1:7]] + ([pa.array(out[7], type=pa.binary())] if with_ids else [])
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, NAMES + ["ids"] * with_ids)

        for batch in batches:
            key_type = batch.column(0).type
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                put(packer.add(key, np.append(encode(t.as_py() or ""), np.uint32(end_id))))
            if len(out[0]) >= 10_000:
                yield batch_out()
        if key_type is not None:
            put(packer.flush())
            yield batch_out()

    arrow_rows(docs.sparkSession, 500)
    return kept.mapInArrow(run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)
