"""Chat formatting: a finite-state machine over roles emits text segments with loss flags from a declarative template.

``Template`` says how a turn opens and closes, the roles' names, which roles bear loss and which role may follow which.
Inside names and texts the escape character is put before itself and before every control string, so that formatting can
be undone whatever the texts hold. Each turn gives segments (text, loss flag): opening, text, closing; only the text of an
assistant is under the loss mask. An order of turns that the machine does not allow is reported (``valid`` is false, with
the first offending turn, else -1) and formatted all the same; nothing is dropped.

Turns are dealt by conversation, sorted within their task by Spark, and streamed through the machine turn by turn, so a
conversation of any length takes the memory of one turn.

Defined results: a null text is empty; a null role is the empty role, unknown to the machine; turns of equal number follow
in the order of role and text, a null number first; repeated rows are separate turns; a null conv_id is a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm.common import arrow_rows


@dataclass(frozen=True)
class Template:
    opening: str = "### "
    naming: str = ": "
    closing: str = "</turn>"
    after: str = "\n"
    escape: str = "\\"
    names: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    other: str = "Role "
    loss: frozenset = frozenset({"assistant"})
    #: State (the role before, None at the start) -> roles that may follow.
    follows: dict = field(default_factory=lambda: {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}})
    #: A conversation may end in these.
    ends: frozenset = frozenset({"assistant"})

    def controls(self) -> tuple[str, ...]:
        return (self.escape, self.opening, self.naming, self.closing)

    def escaped(self, text: str) -> str:
        return re.sub("|".join(map(re.escape, self.controls())), lambda m: self.escape + m[0], text)

    def unescaped(self, text: str) -> str:
        return re.sub(f"{re.escape(self.escape)}(.)", r"\1", text, flags=re.S)


def turn_segments(template: Template, role: str, text: str) -> list[tuple[str, bool]]:
    name = template.names.get(role)
    opening = template.opening + (name if name is not None else template.other + template.escaped(role)) + template.naming
    return [(opening, False), (template.escaped(text), role in template.loss), (template.closing + template.after, False)]


class Machine:
    """Validates the order of roles and emits segments."""

    def __init__(self, template: Template):
        self.template, self.state, self.bad_turn, self.n = template, None, None, 0

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        if role not in self.template.follows.get(self.state, ()) and self.bad_turn is None:
            self.bad_turn = self.n
        self.state = role
        self.n += 1
        return turn_segments(self.template, role, text)

    def valid(self) -> bool:
        return self.bad_turn is None and self.state in self.template.ends


class Reader:
    """Reads formatted text back, piece by piece: yields (role, text) as turns close."""

    def __init__(self, template: Template):
        t, self.template, self.rest = template, template, ""
        plain = f"(?:{re.escape(t.escape)}(?s:.)|(?!{'|'.join(map(re.escape, t.controls()))})(?s:.))*+"
        self.turn = re.compile(f"{re.escape(t.opening)}({plain}){re.escape(t.naming)}({plain}){re.escape(t.closing + t.after)}")
        self.roles = {name: role for role, name in t.names.items()}

    def feed(self, formatted: str) -> Iterator[tuple[str, str]]:
        self.rest += formatted
        while m := self.turn.match(self.rest):
            self.rest = self.rest[m.end() :]
            name = m[1]
            role = self.roles[name] if name in self.roles else self.template.unescaped(name.removeprefix(self.template.other))
            yield role, self.template.unescaped(m[2])


SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, first_bad_turn long"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64())
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def ordered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    kept = turns.selectExpr(f"cast(`{conv_id}` as bigint) AS conv_id", f"`{turn}` AS turn", f"`{role}` AS role", f"`{text}` AS text")
    arrow_rows(turns.sparkSession, 2000)
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def segments(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turn_no, part, text, loss: the segments that make the formatted conversations."""
    own = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, machine = (), None
        for batch in batches:
            rows = []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if last != (conv,):
                    last, machine = (conv,), Machine(own)
                rows += [(conv, machine.n - 1, k, s, loss) for k, (s, loss) in enumerate(machine.turn(role or "", text or ""))]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_()), strict=True)], ["conv_id", "turn_no", "part", "text", "loss"])

    return ordered(turns).mapInArrow(run, "conv_id long, turn_no long, part int, text string, loss boolean")


def digests(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Formats every conversation, reads the formatted text back, and gives digests of what was read."""
    own = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ()
        rows: list[tuple] = []
        machine = reader = every = learned = None
        counts = [0, 0, 0]

        def close() -> None:
            if reader.rest:
                raise ValueError("a formatted conversation can't be read back")
            rows.append((last[0], counts[0], every.hexdigest(), counts[1], learned.hexdigest(), counts[2], machine.valid(), -1 if machine.bad_turn is None else machine.bad_turn))

        for batch in batches:
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if last != (conv,):
                    if last:
                        close()
                    last, machine, reader, every, learned, counts = (conv,), Machine(own), Reader(own), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                for piece, loss in machine.turn(role or "", text or ""):
                    counts[2] += len(piece)
                    if loss:
                        plain = own.unescaped(piece)
                        counts[1] += len(plain)
                        learned.update(plain.encode())
                    for read_role, read_text in reader.feed(piece):
                        counts[0] += 1
                        every.update(f"{read_role}\n{read_text}\n".encode())
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)
                rows.clear()
        if last:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    return ordered(turns).mapInArrow(run, SCHEMA)
