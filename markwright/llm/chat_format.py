"""Chat formatting by incremental black-box rendering.

A template is a function from a list of (role, text) turns to a string; nothing else is known of it. The prefixes of a
conversation are rendered one after the other. Where each output starts with the one before, what it adds is the span of
its turn; a template for which some output does not start with the one before rewrites history, and is reported. Inside
a span, the text stands between what the template writes before and after it, which two probes at the turn's own place
show: outputs for two different texts behind the same prefix agree before and after them. A turn whose span does not
fit its probes, and every turn of a rewritten conversation, has an empty text and is not under the loss mask.

The instruct template of this module marks turns and escapes its control strings inside texts: after the first character
of a control string, whole or already escaped, one more backslash is written, so that none is left whole; reading takes
it away again.

Defined cases: rows without a conv_id are conversations of one turn each; a null role or text is empty; turns that repeat a number
follow each other by role and text; a null turn comes first; an empty table gives an empty result; extra columns are
ignored. A conversation's rows are handled in one task, since a prefix has to be rendered whole; its cost grows with
its turns times its length, whatever the other conversations.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: The control strings of the instruct template.
CONTROL = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN", "[/TURN]", "<s>", "</s>")
_BROKEN = "|".join(rf"(?<={re.escape(c[0])}){{}}(\\*)(?={re.escape(c[1:])})" for c in CONTROL)
_ESCAPE = re.compile(_BROKEN.replace("{}", ""))
_UNESCAPE = re.compile(_BROKEN.replace("{}", r"\\"))


@lru_cache(maxsize=1024)
def escape(text: str) -> str:
    """A text in which no control string is left whole. A conversation's prefixes repeat its texts, so the last ones are kept."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][1:], text)


def instruct(turns: list[Turn]) -> str:
    """The template of the query: system, user, assistant and, by name, any other role."""
    known = {"system": "<<SYS>> {} <</SYS>>\n", "user": "<s> [INST] {} [/INST]", "assistant": " {} </s>\n"}
    out = []
    for role, text in turns:
        form = known.get(role) or "[TURN " + json.dumps(role).replace("{", "\\u007b").replace("}", "\\u007d").replace("[", "\\u005b").replace("<", "\\u003c") + "] {} [/TURN]\n"
        before, after = form.split("{}")
        out.append(before + escape(text) + after)
    return "".join(out)


def role_of(before: str) -> str:
    """The role that the instruct template's opening mark stands for."""
    if before.startswith("[TURN "):
        return json.loads(before[6:-2])
    return {"<<SYS>> ": "system", "<s> [INST] ": "user", " ": "assistant"}[before]


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def frame(template: Template, before: list[Turn], prefix: str, role: str) -> tuple[str, str] | None:
    """What the template writes before and after the text of a role's turn behind these turns, from two probes; None if it rewrites them."""
    one, two = template([*before, (role, "a1")]), template([*before, (role, "b2")])
    if not (one.startswith(prefix) and two.startswith(prefix)):
        return None
    one, two = one[len(prefix) :], two[len(prefix) :]
    start = common(one, two)
    end = common(one[::-1], two[::-1])
    return one[:start], one[len(one) - end :]


def locate(template: Template, turns: list[Turn]) -> tuple[str, list[int], bool]:
    """The output, where the span of each turn ends in it, and whether the template rewrites history."""
    output, ends, rewrites = "", [], False
    for k in range(1, len(turns) + 1):
        longer = template(turns[:k])
        if not longer.startswith(output):
            rewrites = True
            at = common(longer, output)
            ends = [min(e, at) for e in ends]
        output = longer
        ends.append(len(output))
    return output, ends, rewrites


FORMATTED = "conv_id long, formatted string, ends array<long>, text_starts array<long>, text_ends array<long>, loss array<boolean>, rewrites boolean"


def format_conversations(conversations: DataFrame, template: Template = instruct, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per conversation the output, the ends of the turns' spans, the places of their texts, the loss mask by turn, and rewrites."""
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("ends", pa.list_(pa.int64())), ("text_starts", pa.list_(pa.int64())), ("text_ends", pa.list_(pa.int64())), ("loss", pa.list_(pa.bool_())), ("rewrites", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in schema]
        size = 0
        turns: list[Turn] = []
        current: tuple | None = None

        def close(conv_id: int | None) -> None:
            nonlocal size
            output, ends, rewrites = locate(template, turns)
            starts, stops, loss, start = [], [], [], 0
            for k, ((role, _), end) in enumerate(zip(turns, ends, strict=True)):
                marks = None if rewrites else frame(template, turns[:k], output[:start], role)
                span = output[start:end]
                framed = marks is not None and span.startswith(marks[0]) and span.endswith(marks[1]) and len(span) >= len(marks[0]) + len(marks[1])
                starts.append(start + len(marks[0]) if framed else end)
                stops.append(end - len(marks[1]) if framed else end)
                loss.append(framed and role in learn)
                start = end
            for column, value in zip(held, (conv_id, output, ends, starts, stops, loss, rewrites), strict=True):
                column.append(value)
            size += len(output)

        for batch in batches:
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is not None and (conv_id is None or current != (conv_id,)):
                    close(current[0])
                    turns = []
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, schema.types, strict=True)], schema=schema)
                        held, size = [[] for _ in schema], 0
                current = (conv_id,)
                turns.append((role, text))
        if current is not None:
            close(current[0])
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, schema.types, strict=True)], schema=schema)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition(F.coalesce("conv_id", F.xxhash64("turn", "role", "text"))).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites: read from the output of the instruct template."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                conv_id, output, ends, starts, stops, loss, rewrites = (c[i].as_py() for c in batch.columns)
                turns, learned, n, at = hashlib.sha256(), hashlib.sha256(), 0, 0
                for end, a, b, learn in zip(ends, starts, stops, loss, strict=True):
                    text = unescape(output[a:b])
                    turns.update(f"{role_of(output[at:a])}\n{text}\n".encode())
                    if learn:
                        n += len(text)
                        learned.update(text.encode())
                    at = end
                rows.append((conv_id, len(ends), turns.hexdigest(), n, learned.hexdigest(), len(output), rewrites))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, schema.types, strict=True)], schema=schema)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")
