"""Conversations rendered by a compiled template, and read back.

A conversation's turns are dealt by (conversation, stretch of 256 turn numbers)
and sorted inside the tasks, with one small header row per stretch that says how
many turns come before it and how many there are, so one conversation that holds
most rows is rendered by many tasks. Each task streams: it holds one part (about
four million code points, or one turn if longer) at a time.

Defined results: a null text or role is empty; null turns come first; rows of one
turn number are ordered by role and text (repeated rows all stay); a null
conversation id is a conversation of its own; an empty table gives an empty one;
other columns are ignored. Rows of one conversation *and* one stretch meet in one
task, which streams them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chat_template import Output, Template, TemplateError, unescape
from .common import blocks, shuffle_partitions, to_arrow

STRETCH = 256
PART_CHARS = 4 << 20

TEMPLATE = (
    "{% for message in messages %}### {{ message.role | escape(':') }}: "
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}</turn>\n{% endfor %}"
    "{% if add_generation_prompt %}### assistant: {% endif %}"
)


@dataclass(frozen=True)
class ChatFormat:
    """A template whose turns read ``opening role middle text closing``, role and
    text escaped. ``closing`` is a control string without a border (no beginning of
    it is also its end), so no text can end in half of one."""

    template: str = TEMPLATE
    opening: str = "### "
    middle: str = ": "
    closing: str = "</turn>"
    after: str = "\n"
    generation_prompt: bool = False
    part_chars: int = PART_CHARS

    def controls(self) -> tuple[str, ...]:
        return (self.opening, self.closing)

    def compile(self) -> Template:
        for s in (self.closing, self.middle):
            if not s or "\\" in s or any(s.startswith(s[-n:]) for n in range(1, len(s))):
                raise TemplateError(f"{s!r} cannot end a text")
        return Template(self.template, self.controls())

    def context(self) -> dict:
        return {"add_generation_prompt": self.generation_prompt}

    def turn_pattern(self) -> re.Pattern:
        def until(stop: str) -> str:
            first = re.escape(stop[0])
            rest = f"|{first}(?!{re.escape(stop[1:])})" if len(stop) > 1 else ""
            return rf"((?:[^\\{first}]++|\\.{rest})*+)"

        e = re.escape
        return re.compile(f"{e(self.opening)}{until(self.middle[0])}{e(self.middle)}{until(self.closing)}{e(self.closing)}{e(self.after)}", re.S)


def _parts_schema(conv: T.DataType) -> T.StructType:
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    return T.StructType([
        T.StructField("conv_id", conv), T.StructField("part", T.LongType()), T.StructField("turns", T.LongType()),
        T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()),
        T.StructField("loss_spans", T.ArrayType(span)),
    ])


def format_conversations(rows: DataFrame, fmt: ChatFormat = ChatFormat()) -> DataFrame:
    """Every conversation of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``) by
    the template: ``conv_id``, ``part`` (number of the part's first turn, from 0),
    ``turns`` of the part, ``n_turns`` of the conversation, ``formatted`` text and
    ``loss_spans``, the part's code-point ranges of generated text. A conversation
    is one part unless it is very long; its parts in order are its whole text."""
    fmt.compile()
    empty = F.lit("")
    said = rows.select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), empty).alias("_key"), F.col("conv_id").isNull().alias("_none"),
        F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 62))).cast("long").alias("_stretch"),
        F.col("turn").cast("long").alias("_turn"), F.coalesce(F.col("role").cast("string"), empty).alias("_role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("_text"),
    )
    group = ["_none", "_key"]
    counts = said.groupBy("conv_id", *group, "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    mine = Window.partitionBy(*group)
    headers = counts.select(
        "conv_id", *group, "_stretch", F.lit(None).cast("long").alias("_turn"), F.lit(None).cast("string").alias("_role"),
        F.lit(None).cast("string").alias("_text"),
        F.coalesce(F.sum("_n").over(mine.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(mine).alias("_length"),
    )
    none = F.lit(None).cast("long")
    stream = headers.unionByName(said.select("*", none.alias("_before"), none.alias("_length")))
    dealt = stream.repartition(shuffle_partitions(rows.sparkSession), *group, "_stretch").sortWithinPartitions(
        *group, "_stretch", F.col("_length").isNull(), F.col("_turn").asc_nulls_first(), "_role", "_text"
    )
    schema = _parts_schema(rows.schema["conv_id"].dataType)
    return dealt.mapInArrow(_Formatter(fmt, schema), schema)


class _Formatter:
    """Renders rows in order; a header row opens each stretch."""

    def __init__(self, fmt: ChatFormat, schema: T.StructType) -> None:
        self.fmt, self.schema = fmt, schema

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from blocks(self.parts(batches), to_arrow(self.schema))

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        template, context = self.fmt.compile(), self.fmt.context()
        conv = part = length = index = None
        out, env = Output(), {}

        def done() -> tuple[int, tuple]:
            text = out.text()
            return 4 * len(text), (conv, part, index - part, length, text, [{"begin": b, "end": e} for b, e in out.spans])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "_role", "_text", "_before", "_length")]
            for conv_id, role, text, before, total in zip(*columns, strict=True):
                if total is not None:
                    if index is not None and index > part:
                        yield done()
                    conv, part, index, length, out = conv_id, before, before, total, Output()
                    env = template.head(out if before == 0 else Output(), context)
                    continue
                if out.size >= self.fmt.part_chars:
                    yield done()
                    part, out = index, Output()
                template.turn(out, env, {"role": role, "text": text}, index, length)
                index += 1
                if index == length:
                    template.tail(out, env)
        if index is not None and index > part:
            yield done()


def parse_part(fmt: ChatFormat, pattern: re.Pattern, ends: tuple[str, str], formatted: str, first: bool, last: bool) -> list[tuple[str, str]]:
    """(role, text) of every turn of a part; ``ends`` are the texts before the first
    and after the last turn."""
    at = len(ends[0]) if first else 0
    stop = len(formatted) - (len(ends[1]) if last else 0)
    turns = []
    while at < stop:
        m = pattern.match(formatted, at, stop)
        if m is None:
            raise ValueError(f"no turn at {at} of {formatted[at : at + 40]!r}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _ends(fmt: ChatFormat) -> tuple[str, str]:
    template, head, tail = fmt.compile(), Output(), Output()
    template.tail(tail, template.head(head, fmt.context()))
    return head.text(), tail.text()


def read_turns(parts: DataFrame, fmt: ChatFormat = ChatFormat()) -> DataFrame:
    """The turns of formatted parts: ``conv_id``, ``place`` (from 0), ``role``, ``text``."""
    schema = T.StructType([
        T.StructField("conv_id", parts.schema["conv_id"].dataType), T.StructField("place", T.LongType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, ends = fmt.turn_pattern(), _ends(fmt)

        def turns() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                for r in batch.to_pylist():
                    last = r["part"] + r["turns"] == r["n_turns"]
                    for i, (role, text) in enumerate(parse_part(fmt, pattern, ends, r["formatted"], r["part"] == 0, last)):
                        yield 4 * len(text), (r["conv_id"], r["part"] + i, role, text)

        yield from blocks(turns(), to_arrow(schema))

    return parts.select("conv_id", "part", "turns", "n_turns", "formatted").mapInArrow(read, schema)


def digests(parts: DataFrame, fmt: ChatFormat = ChatFormat()) -> DataFrame:
    """Per conversation, from its formatted parts alone: ``n_turns``,
    ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``.

    A conversation of one part is read where it lies. The turns of longer ones
    move once more, by conversation, and are hashed as a stream in the order of
    the parts."""
    conv = parts.schema["conv_id"].dataType
    result = [
        T.StructField("conv_id", conv), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
    ]
    pieces = T.StructType([*result, T.StructField("part", T.LongType()), T.StructField("said", T.BinaryType()), T.StructField("loss", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, ends = fmt.turn_pattern(), _ends(fmt)

        def rows() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                for r in batch.to_pylist():
                    text, first, last = r["formatted"], r["part"] == 0, r["part"] + r["turns"] == r["n_turns"]
                    turns = parse_part(fmt, pattern, ends, text, first, last)
                    said = "".join([f"{role}\n{t}\n" for role, t in turns]).encode()
                    loss = "".join([unescape(text[s["begin"] : s["end"]]) for s in r["loss_spans"]])
                    sums = (r["conv_id"], len(turns), None, len(loss), None, len(text), r["part"])
                    raw = loss.encode()
                    if first and last:
                        shas = hashlib.sha256(said).hexdigest(), hashlib.sha256(raw).hexdigest()
                        yield 200, (*sums[:2], shas[0], sums[3], shas[1], *sums[5:], None, None)
                    else:
                        yield len(said) + len(raw), (*sums, said, raw)

        yield from blocks(rows(), to_arrow(pieces))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, tuple]]:
            held = None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["turns_sha256"] is not None:
                        yield 200, tuple(r[f.name] for f in result)
                        continue
                    if r["part"] == 0:
                        if held:
                            yield 200, finish(held)
                        held = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    held[1] += r["n_turns"]
                    held[2].update(r["said"])
                    held[3] += r["loss_chars"]
                    held[4].update(r["loss"])
                    held[5] += r["formatted_chars"]
            if held:
                yield 200, finish(held)

        def finish(h: list) -> tuple:
            return h[0], h[1], h[2].hexdigest(), h[3], h[4].hexdigest(), h[5]

        yield from blocks(rows(), to_arrow(T.StructType(result)))

    dealt = parts.mapInArrow(read, pieces).repartition(shuffle_partitions(parts.sparkSession), "conv_id")
    return dealt.sortWithinPartitions("conv_id", "part").mapInArrow(chain, T.StructType(result))
