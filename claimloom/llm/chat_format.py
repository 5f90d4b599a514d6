"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a text. Its inside is not looked at: the
prefixes of 1, 2, ... turns are rendered and consecutive outputs compared. What a prefix adds
to the one before is the span of its last turn; a prefix that does not begin with the one
before shows a template that rewrites history, and the common part tells from where. Within
the span of a turn, the (escaped) text of the turn is found by rendering the same prefix with
other texts in that turn: the parts that do not change are the markers around it.

Turns of a conversation are sorted by the shuffle and rendered as they stream by, so a
conversation need not be grouped in memory beyond its own output.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Control strings of the bundled template, and what escapes them inside texts.
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
ESCAPE = "\\"
_MARKS = (OPEN, CLOSE, END, "[ROLE]", "[/ROLE]")
_CONTROL = re.compile(r"(\\*)(\[/?INST\]|</s>|\[/?ROLE\])")
_ESCAPED = re.compile(r"(\\+)(\[/?INST\]|</s>|\[/?ROLE\])")


def escape(text: str) -> str:
    """Backslashes before a control string are doubled and one more is put in front of it."""
    if not any(mark in text for mark in _MARKS):
        return text
    return _CONTROL.sub(lambda m: m[1] * 2 + ESCAPE + m[2], text)


def unescape(text: str) -> str:
    if ESCAPE not in text:
        return text
    return _ESCAPED.sub(lambda m: m[1][: (len(m[1]) - 1) // 2] + m[2], text)


def instruct_template(turns: list[Turn]) -> str:
    """`[INST] text [/INST]` for users, `text</s>` for assistants, a named block for the rest."""
    out = []
    for role, text in turns:
        # a backslash that ends a text must not touch the marker after it
        body = escape(text)
        if role == "user":
            out.append(f"{OPEN} {body} {CLOSE}")
        elif role == "assistant":
            out.append(f" {body} {END}")
        else:
            out.append(f"[ROLE]{escape(role)}\n{body} [/ROLE]")
    return "".join(out)


@dataclass
class Span:
    """A turn in the output: its range, the range of its escaped text, and its role."""

    start: int
    end: int
    text_start: int
    text_end: int
    rewritten_from: int | None = None


def _common_suffix(a: str, b: str) -> int:
    return len(commonprefix([a[::-1], b[::-1]]))


def _body(before: str, turns: list[Turn], output: str, start: int, template: Template) -> tuple[int, int]:
    """Where the last turn's text stands: the rest stays the same under other texts."""
    role, _ = turns[-1]
    probes = [template([*turns[:-1], (role, probe)])[start:] for probe in ("a", "bb")]
    head = len(commonprefix(probes))
    tail = _common_suffix(probes[0][head:], probes[1][head:])
    return start + head, len(output) - tail


def render(turns: list[Turn], template: Template = instruct_template) -> tuple[str, list[Span]]:
    """The whole output and the span of every turn.

    Where a prefix rewrites history, its span starts where the outputs part, earlier spans
    that reach beyond are cut there, and rewritten_from says so.
    """
    before, spans = "", []
    for k in range(1, len(turns) + 1):
        output = template(turns[:k])
        if output.startswith(before):
            start, rewritten = len(before), None
        else:
            start = rewritten = len(commonprefix([before, output]))
            for s in spans:
                s.end, s.text_start, s.text_end = min(s.end, start), min(s.text_start, start), min(s.text_end, start)
        text_start, text_end = _body(before, turns[:k], output, start, template)
        spans.append(Span(start, len(output), text_start, text_end, rewritten))
        before = output
    return before, spans


def formatted(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: Template = instruct_template,
) -> DataFrame:
    """One row per conversation: id, roles, formatted, starts, ends, text_starts, text_ends, loss, rewrites.

    Turns come by turn number, null numbers last; rows that share a number by role and text.
    Null role or text: empty. Rows with a null id are one conversation. The loss mask is the
    list of text ranges of assistant turns. Repeated rows are repeated turns. An empty table
    gives no rows; other columns are not read, whatever their names.
    """
    rows = conversations.select(
        F.col(id_col).alias("id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, roles array<string>, formatted string, starts array<bigint>, ends array<bigint>, "
        "text_starts array<bigint>, text_ends array<bigint>, rewrites array<int>"
    )

    def finish(key, turns: list[Turn]) -> tuple:
        output, spans = render(turns, template)
        return (
            key,
            [r for r, _ in turns],
            output,
            [s.start for s in spans],
            [s.end for s in spans],
            [s.text_start for s in spans],
            [s.text_end for s in spans],
            [k for k, s in enumerate(spans) if s.rewritten_from is not None],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "roles", "formatted", "starts", "ends", "text_starts", "text_ends", "rewrites"]
        types: list = [None, pa.list_(pa.string()), pa.string(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.int32())]
        done: list[tuple] = []
        size, key, turns, began = 0, None, [], False

        def batch_of() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            types[0] = batch.schema.field(0).type
            ids, roles, texts = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for own, role, text in zip(ids, roles, texts, strict=True):
                if began and own != key:
                    done.append(finish(key, turns))
                    size, turns = size + len(done[-1][2]), []
                    if size > 4 << 20:
                        yield batch_of()
                        done, size = [], 0
                key, began = own, True
                turns.append((role, text))
        if began:
            done.append(finish(key, turns))
        if done:
            yield batch_of()

    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id"), F.col("turn").asc_nulls_last(), "role", "text"]
    return rows.repartition(n, "id").sortWithinPartitions(*order).mapInArrow(scan, schema)


def role_of(before: str, after: str) -> str:
    """The role that the bundled template's markers around a text stand for."""
    if (before, after) == (f"{OPEN} ", f" {CLOSE}"):
        return "user"
    if (before, after) == (" ", f" {END}"):
        return "assistant"
    if before.startswith("[ROLE]") and before.endswith("\n") and after == " [/ROLE]":
        return unescape(before[len("[ROLE]") : -1])
    raise ValueError(f"no turn of the template: {before!r} ... {after!r}")


def read_back(chats: DataFrame) -> DataFrame:
    """id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the output and its spans alone.

    The output is the bundled template's; a span with other markers around its text fails.
    """
    kind = chats.schema["id"].dataType.simpleString()
    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = row["formatted"]
                spans = list(zip(row["starts"], row["text_starts"], row["text_ends"], row["ends"], strict=True))
                bodies = [unescape(text[s:e]) for _, s, e, _ in spans]
                roles = [role_of(text[a:s], text[e:z]) for a, s, e, z in spans]
                turns = hashlib.sha256()
                for role, body in zip(roles, bodies, strict=True):
                    turns.update(f"{role}\n{body}\n".encode())
                loss = "".join(b for r, b in zip(roles, bodies, strict=True) if r == "assistant")
                out.append((row["id"], len(bodies), turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if out:
                cols = list(zip(*out, strict=True))
                types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    schema = f"id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return chats.drop("roles").mapInArrow(scan, schema)
