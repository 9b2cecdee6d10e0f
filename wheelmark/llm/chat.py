"""Chat formatting: conversations through a compiled template (see ``template``), and back.

Rows of a conversation are ordered by turn, then role, then text (nulls first), so that equal turns and repeated rows
have one order; repeated rows are turns of their own. A null role or text counts as empty. Rows with a null conversation
are one conversation. Other columns of the input play no part. An empty table gives no rows.

One shuffle by conversation, sorted by Spark, brings the turns in order; rendering and reading back are streams over
sorted rows that hold one turn at a time (a template that asks for the number of messages or for later ones holds the
messages of one conversation). A conversation is a sequence with one digest, so that its turns can't be split between
tasks; a very long one takes time but no memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelmark.llm.shared import field, picked
from wheelmark.llm.template import Template

#: Turn marks. No text holds START or END after ``escape``, because none holds "<|".
START, END = "<|im_start|>", "<|im_end|>"
CHATML = """
{%- for message in messages -%}
<|im_start|>{{ message.role | name }}
{% if message.role == 'assistant' -%}
{% generation %}{{ message.text | escape }}{% endgeneration %}
{%- else -%}
{{ message.text | escape }}
{%- endif %}<|im_end|>
{% endfor -%}
"""
#: Characters of an output row, about: short pieces with the same mask are joined up to here.
PIECE_CHARS = 1 << 16
#: Characters of an Arrow batch, about.
BATCH_CHARS = 1 << 22


def escape(text: str) -> str:
    """Every "<", backslashes, "|" gets one more backslash, so that "<|" is never left; ``unescape`` takes it off."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_name(text: str) -> str:
    """A role on one line: backslashes and line ends are written with a backslash, then as ``escape``."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_name(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def compiled(source: str) -> Template:
    return Template(source, {"escape": escape, "name": escape_name})


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pa.DataType, object, Iterator[tuple]]]:
    """Conversations of sorted rows: their id's Arrow type, id, and a stream of their rows' values."""
    kind: list[pa.DataType] = []

    def rows():
        for batch in batches:
            kind[:] = [batch["conv_id"].type]
            yield from zip(*[batch[c].to_pylist() for c in columns], strict=True)

    for conv, group in groupby(rows(), key=lambda row: row[0]):
        yield kind[0], conv, group


def format_conversations(conversations: DataFrame, source: str = CHATML, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", **variables: object) -> DataFrame:
    """Each conversation through the template, as rows (conv_id, piece, start, text, loss): the pieces of its text in
    order, their first code point's place, and whether they are under a generation mark.

    The rows of a conversation lie together in order of ``piece`` (as ``read_back`` needs them, unless they are sorted
    anew); joined they are its text. Spans for a loss mask are the rows with ``loss``. Nothing is written for a
    conversation whose text is empty. ``variables`` are for the template (``add_generation_prompt`` and the like).
    """
    compiled(source)  # fails here if it is not well formed
    kind = field(conversations, conv_col)
    rows = picked(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    ordered = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")}).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, names = compiled(source), ["conv_id", "piece", "start", "text", "loss"]
        out: list[tuple] = []
        waiting = 0
        for batch_type, conv, turns in _runs(batches, ["conv_id", "role", "text"]):
            pieces = template.render(({"role": r, "text": t, "content": t} for _, r, t in turns), **variables)
            for piece, (start, text, loss) in enumerate(_joined(pieces)):
                out.append((conv, piece, start, text, loss))
                waiting += len(text)
                if waiting >= BATCH_CHARS:
                    yield _batch(out, names, [batch_type, pa.int64(), pa.int64(), pa.string(), pa.bool_()])
                    out, waiting = [], 0
        if out:
            yield _batch(out, names, [batch_type, pa.int64(), pa.int64(), pa.string(), pa.bool_()])

    return ordered.mapInArrow(render, f"conv_id {kind}, piece long, start long, text string, loss boolean")


def _joined(pieces: Iterator[tuple[str, bool]]) -> Iterator[tuple[int, str, bool]]:
    """(start, text, loss): neighbours with one mask as one piece, of PIECE_CHARS or a little more."""
    start, held, chars, loss = 0, [], 0, False
    for text, mark in pieces:
        if held and (mark is not loss or chars >= PIECE_CHARS):
            yield start, "".join(held), loss
            start, held, chars = start + chars, [], 0
        loss = mark
        held.append(text)
        chars += len(text)
    if held:
        yield start, "".join(held), loss


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


class Reader:
    """Reads one conversation's text back, piece by piece; holds one turn."""

    def __init__(self) -> None:
        self.left, self.want, self.role, self.seen = "", "start", "", 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n, self.chars, self.loss_chars = 0, 0, 0
        self.masked: list[str] = []

    def take(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        if loss:
            self.masked.append(text)
        else:
            self._unmask()
        self.left += text
        while self._step():
            pass

    def _unmask(self) -> None:
        if self.masked:
            text, self.masked = unescape("".join(self.masked)), []
            self.loss.update(text.encode())
            self.loss_chars += len(text)

    def _step(self) -> bool:
        """One mark further, if it is there."""
        if self.want in ("start", "line"):
            mark = START if self.want == "start" else "\n"
            if len(self.left) < len(mark):
                return False
            if not self.left.startswith(mark):
                raise ValueError(f"{mark!r} expected, {self.left[:40]!r} found")
            self.left, self.want = self.left[len(mark) :], "role" if self.want == "start" else "start"
            return True
        mark = "\n" if self.want == "role" else END
        at = self.left.find(mark, max(0, self.seen - len(mark)))
        if at < 0:
            self.seen = len(self.left)
            return False
        found, self.left, self.seen = self.left[:at], self.left[at + len(mark) :], 0
        if self.want == "role":
            self.role, self.want = unescape_name(found), "text"
        else:
            self.turns.update(f"{self.role}\n{unescape(found)}\n".encode())
            self.n, self.want = self.n + 1, "line"
        return True

    def end(self) -> tuple:
        self._unmask()
        if self.left or self.want != "start":
            raise ValueError(f"a conversation ends within a turn: {self.left[:40]!r}")
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, ordered: bool = False) -> DataFrame:
    """Digests of what CHATML wrote, parsed from its text and masks alone: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. Text in another form is an error. ``formatted``: rows of ``format_conversations``;
    ``ordered``: as that function returns them, so that they need not be brought in order again.
    """
    kind, columns = field(formatted, "conv_id"), ["conv_id", "text", "loss"]
    rows = formatted if ordered else formatted.repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], []
        for batch_type, conv, pieces in _runs(batches, columns):
            reader = Reader()
            for _, text, loss in pieces:
                reader.take(text, loss)
            out.append((conv, *reader.end()))
            types = [batch_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            if len(out) >= 10_000:
                yield _batch(out, names, types)
                out = []
        if out:
            yield _batch(out, names, types)

    return rows.select(*columns).mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
