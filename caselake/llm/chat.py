"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context and only its
text is trainable. Turns after the last assistant turn (or a conversation without one) make a final
example that trains nothing, so the output holds every turn.

A turn is written ``### role: text</turn>`` and a line break. Inside roles and texts a backslash is
doubled, ``#`` becomes ``\\#``, ``</turn>`` becomes ``<\\/turn>``, and in roles ``:`` becomes ``\\:``.
Neither marker can therefore occur inside a text, and dropping one backslash before each escaped
character gives the text back.

Defined results: a null role or text is the empty one; a null turn sorts first; rows with the same
turn stay, ordered by role and text; null conv_ids are one conversation; an empty table gives no
examples; other columns are ignored. Rows are dealt by conversation, sorted by Spark and streamed:
what a task holds at a time is the text of one conversation, which its longest example is anyway.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

OPEN, CLOSE = "### ", "</turn>\n"
TRAINED = "assistant"
TURN = re.compile(r"### ((?:\\.|[^\\:])*): (.*)", re.DOTALL)
EXAMPLE = ("conv_id long, example long, last boolean, text string, loss_start long, loss_end long")
DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, n_examples long")
BATCH_CHARS = 4_000_000


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def write_turn(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the escaped text, and what stands after it."""
    return f"{OPEN}{escape(role).replace(':', '\\:')}: ", escape(text), CLOSE


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted example as (role, text)."""
    turns = []
    for written in formatted.split(CLOSE)[:-1]:
        match = TURN.fullmatch(written)
        if not match:
            raise ValueError("not a formatted turn")
        turns.append((unescape(match[1]), unescape(match[2])))
    return turns


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _examples(turns: Iterator[tuple]) -> Iterator[tuple]:
    """(text, loss_start, loss_end) of one conversation's examples, in order."""
    so_far, open_turns = "", False
    for _, role, text in turns:
        before, body, after = write_turn(role or "", text or "")
        start = len(so_far) + len(before)
        so_far += before + body + after
        open_turns = role != TRAINED
        if not open_turns:
            yield so_far, start, start + len(body)
    if open_turns:
        yield so_far, None, None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def format_examples(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), last, text, and where the trainable part lies."""
    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("last", pa.bool_()), ("text", pa.string()),
                        ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        for conv, turns in groupby(_rows(batches, "conv_id", "role", "text"), key=lambda r: r[0]):
            held = None
            for n, made in enumerate(_examples(turns)):
                if held:
                    out.append(held)
                held = (conv, n, False, *made)
                chars += len(made[0])
                if chars > BATCH_CHARS and out:
                    yield _batch(out, schema)
                    out, chars = [], 0
            out.append((*held[:2], True, *held[3:]))
        if out:
            yield _batch(out, schema)

    return conversations.select("conv_id", "turn", "role", "text").repartition(F.col("conv_id")) \
        .sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(run, EXAMPLE)


def digest_examples(examples: DataFrame) -> DataFrame:
    """Per conversation, what can be read back from its examples (which stand together and in order)."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                        ("n_examples", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        rows = _rows(batches, "conv_id", "last", "text", "loss_start", "loss_end")
        for conv, own in groupby(rows, key=lambda r: r[0]):
            loss, trained, formatted, n = hashlib.sha256(), 0, 0, 0
            for _, last, text, start, end in own:
                n, formatted = n + 1, formatted + len(text)
                if start is not None:
                    target = unescape(text[start:end])
                    trained += len(target)
                    loss.update(target.encode())
                if last:
                    turns = read_turns(text)
            said = hashlib.sha256()
            for role, body in turns:
                said.update(f"{role}\n{body}\n".encode())
            out.append((conv, len(turns), said.hexdigest(), trained, loss.hexdigest(), formatted, n))
            if len(out) >= 10_000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return examples.mapInArrow(run, DIGEST)
