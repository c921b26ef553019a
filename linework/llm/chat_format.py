"""Chat formatting by prefix-target expansion.

A turn is rendered as ``### Role: text</turn>`` and a line break; backslash, ``<`` and ``#`` inside role and text are
escaped by a backslash, so no text can open or close a turn. Every assistant turn becomes an example of its own: the
context is everything rendered before it, and only its reply (its escaped text) is under the loss mask. written() stores a row for
each example: its text from the start of a block of whole turns, which is the conversation's start for all but long ones. Those
have blocks before it, which the examples of a block share. expanded() makes a row for each reply and block of its example;
examples() joins them. read_back() reads each stored example after its context, so that a long conversation's spread over tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.llm.common import stored
from linework.llm.kernels import tidied

ASSISTANT = "assistant"
OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
_ESCAPED = re.compile(r"([\\<#:])")
_PLAIN = re.compile(r"\\([\\<#:])", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)
#: Characters after which a block of turns closes, and of rows that are handed on at once. Of a long conversation, R replies in L characters
#: are written as R * BLOCK_CHARS / 2 characters and meet L * L / (2 * BLOCK_CHARS) characters of context.
BLOCK_CHARS, READY_CHARS = 1 << 13, 1 << 20
PIECES = "conv_id long, example long, piece long, text string, loss_start long, loss_end long"
SEGMENTS = "conv_id long, turn long, example long, segment string, context_chars long, loss_start long, loss_end long"
BLOCKS = "conv_id long, block long, start long, text string, last boolean, whole boolean, examples array<struct<example:long,end:long,loss_start:long,loss_end:long>>"
READ = "conv_id long, block long, turns string, n_turns long, loss string, formatted_chars long, n_examples long, upto long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def escape(text: str) -> str:
    return _ESCAPED.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _PLAIN.sub(r"\1", text)


def render(role: str, text: str) -> str:
    return f"{OPEN}{escape(role)}{SEP}{escape(text)}{CLOSE}"


def parse(text: str, at: int = 0) -> list[tuple[str, str]]:
    """Role and text of each turn of a rendering, from a turn's start."""
    out = []
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError(f"not a rendered turn: {text[at : at + 80]!r}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<#:])", r"\\$1")


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; null role or text counts as empty."""
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def _segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation and turn; only running totals are held, so a conversation may be of any length."""
    current: object = ()
    at = example = 0
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
            if conv != current:
                current, at, example = conv, 0, 0
            segment = render(role, text)
            mine = role == ASSISTANT
            start = at + len(OPEN) + len(escape(role)) + len(SEP)
            row = (conv, turn, example if mine else None, segment, at, start if mine else None, at + len(segment) - len(CLOSE) if mine else None)
            for column, x in zip(out, row, strict=True):
                column.append(x)
            at += len(segment)
            example += mine
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _KINDS, strict=True)], _NAMES)


_NAMES = [x.split()[0] for x in SEGMENTS.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def segments(rows: DataFrame) -> DataFrame:
    """One row per turn: its rendering, where it starts, and for an assistant turn its example and loss mask.

    Example k of a conversation is the renderings up to the row with example = k; its loss mask is [loss_start, loss_end),
    in code points from the conversation's start. Turns of equal number come by role, then text. An empty table gives
    no rows; rows of null conv_id are one conversation.
    """
    dealt = turns(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(tidied(_segmented), SEGMENTS)


def _batch(rows: list[tuple], names: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in names.split(", ")])


_EXAMPLE = pa.struct([(x, pa.int64()) for x in ("example", "end", "loss_start", "loss_end")])


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments come by conversation and turn; one block is held. A row for each example, and one for turns after a block's last."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(_EXAMPLE)]
    current: object = ()
    block = start = size = 0
    text: list[str] = []
    replies: list[dict] = []

    def closed(last: bool) -> Iterator[tuple]:
        nonlocal block, start, size, text, replies
        whole = "".join(text)
        for r in replies:
            yield current, block, start, whole[: r["end"] - start], last, r["end"] - start == size, [r]
        if not replies or replies[-1]["end"] - start < size:
            yield current, block, start, whole, last, True, []
        block, start, size, text, replies = block + 1, start + size, 0, [], []

    def rows() -> Iterator[tuple]:
        nonlocal current, block, start, size
        for batch in batches:
            for conv, example, segment, at, first, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "example", "segment", "context_chars", "loss_start", "loss_end")), strict=True):
                if conv != current:
                    if text:
                        yield from closed(True)
                    current, block, start = conv, 0, 0
                elif size >= BLOCK_CHARS:
                    yield from closed(False)
                text.append(segment)
                size += len(segment)
                if example is not None:
                    replies.append({"example": example, "end": at + len(segment), "loss_start": first, "loss_end": end})
        if text:
            yield from closed(True)

    out, ready = [], 0
    for row in rows():
        out.append(row)
        ready += len(row[3])
        if ready > READY_CHARS:
            yield _batch(out, BLOCKS, kinds)
            out, ready = [], 0
    if out:
        yield _batch(out, BLOCKS, kinds)


def written(rows: DataFrame) -> DataFrame:
    """Every example as a row of its own, stored: its text from its block's start to its reply's end, and its places from the
    conversation's start. Turns after a block's last reply have a row without example; a block's last row is whole, so has all its turns."""
    return stored(segments(rows).mapInArrow(tidied(_blocked), BLOCKS), "examples")


def blocks(rows: DataFrame) -> DataFrame:
    """Renderings in blocks of whole turns, stored: where each starts in its conversation, whether it is the last, and the reply that ends it."""
    return written(rows).where("whole")


def _pieces(parts: DataFrame) -> DataFrame:
    own = parts.select("conv_id", "block", "text", F.explode("examples").alias("r"))
    met = own.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_last"), "r").join(parts.where("whole").select("conv_id", "block", "text"), F.col("_conv").eqNullSafe(F.col("conv_id")) & (F.col("block") < F.col("_last")))
    return met.unionByName(own, True).select("conv_id", "r.example", F.col("block").alias("piece"), "text", "r.loss_start", "r.loss_end")


def expanded(rows: DataFrame) -> DataFrame:
    """Every example in full, as consecutive pieces: the blocks of its context, and the last up to its reply's end.

    [loss_start, loss_end) is the example's loss mask, in code points from its start. Texts grow with the square of a
    conversation's length; rows are of single pieces, which any task may take.
    """
    return _pieces(written(rows))


def examples(rows: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example, text (context and reply), loss_start, loss_end.

    The texts of a conversation grow with the square of its length; use expanded() or written() for very long ones.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "")
    return expanded(rows).groupBy("conv_id", "example", "loss_start", "loss_end").agg(text.alias("text")).select("conv_id", "example", "text", "loss_start", "loss_end")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's examples, read in order of length after the blocks of their context.

    Of the context only its length is kept. Each example must begin with the one before it in its block; the turns that it adds,
    and what its loss mask shows, are read from its own text.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    current: object = ()
    context, seen = 0, ""
    for batch in batches:
        rows, ready = [], 0
        for conv, target, piece, start, text, replies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "target", "piece", "start", "text", "examples")), strict=True):
            if (conv, target) != current:
                current, context, seen = (conv, target), 0, ""
            if piece < target:
                context += len(text)
                continue
            if replies and context != start:
                raise ValueError(f"a context of {context} characters, not {start}, in conversation {conv}")
            if not text.startswith(seen):
                raise ValueError(f"an example of {len(text)} characters does not begin with that before it, in conversation {conv}")
            turns_ = parse(text, len(seen))
            loss = [unescape(text[r["loss_start"] - context : r["loss_end"] - context]) for r in replies]
            formatted = sum(context + len(text[: r["end"] - context]) for r in replies)
            rows.append((conv, target, "".join(f"{role}\n{plain}\n" for role, plain in turns_), len(turns_), "".join(loss), formatted, len(loss), len(text)))
            ready += len(text) - len(seen)
            seen = text
            if ready > READY_CHARS:
                yield _batch(rows, READ, kinds)
                rows, ready = [], 0
        if rows:
            yield _batch(rows, READ, kinds)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What was read comes by conversation and block; running digests are held."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    state: list | None = None

    def closed() -> tuple:
        conv, every, loss, sums = state
        return conv, sums[0], every.hexdigest(), sums[1], loss.hexdigest(), sums[2], sums[3]

    for batch in batches:
        rows = []
        for conv, turns_, n_turns, loss, formatted, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turns", "n_turns", "loss", "formatted_chars", "n_examples")), strict=True):
            if state is None or conv != state[0]:
                if state is not None:
                    rows.append(closed())
                state = [conv, hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]]
            state[1].update(turns_.encode())
            state[2].update(loss.encode())
            state[3] = [x + y for x, y in zip(state[3], (n_turns, len(loss), formatted, n), strict=True)]
        if rows:
            yield _batch(rows, DIGEST, kinds)
    if state is not None:
        yield _batch([closed()], DIGEST, kinds)


def read_back(rows: DataFrame) -> DataFrame:
    """Per conversation, from its examples as written: digests of all turns and of all text under the loss mask.

    formatted_chars sums the code points of its examples, each with its context. Without assistant turns both loss
    columns are of the empty text. Rows that repeat a turn are turns each, in order of role and text; rows of null conv_id
    are one conversation, and null roles and texts are empty. A conversation of one block is read by one task. Of a longer
    one each block's examples are read with their context by a task of their own; in one task are only streams over its turns, of
    constant state. Extra columns are ignored; an empty table gives no rows.
    """
    parts = written(rows)
    own = parts.select("conv_id", F.col("block").alias("target"), F.col("block").alias("piece"), "start", "text", "examples", "last", "whole", F.length("text").alias("chars"))
    short = own.where("target = 0 and last").drop("last", "whole").repartition("conv_id").sortWithinPartitions("conv_id", "chars")
    long = own.where("target > 0 or not last").drop("last")
    later = long.where("target > 0 and size(examples) > 0").select(F.col("conv_id").alias("_conv"), F.col("target").alias("_target")).distinct()
    context = long.where("whole").join(later, F.col("_conv").eqNullSafe(F.col("conv_id")) & (F.col("target") < F.col("_target")))
    context = context.select("conv_id", F.col("_target").alias("target"), "piece", "start", "text", F.slice("examples", 1, 0).alias("examples"), "chars")
    dealt = long.drop("whole").unionByName(context).repartition("conv_id", "target").sortWithinPartitions("conv_id", "target", "piece", "chars")
    read = dealt.mapInArrow(tidied(_read), READ).repartition("conv_id").sortWithinPartitions("conv_id", "block", "upto")
    return short.mapInArrow(tidied(_read), READ).mapInArrow(tidied(_digested), DIGEST).unionByName(read.mapInArrow(tidied(_digested), DIGEST))
