"""Chat formatting by rendering prefixes with a template that is a black box.

A template is a function of a list of (role, text) that returns a string. It is called with the first turn, the first two,
and so on; what an output adds to the one before it is the last turn's span. Inside an assistant turn's span the text is
located by one more call with a mark in its place and one with nothing, so headers and end marks stay outside the loss
mask. Where an output does not begin with the one before it, the template rewrites history: the conversation is
flagged and given no loss mask, as spans found earlier are no longer true.

Long conversations are rendered in blocks of ``BLOCK_TURNS`` turns, so that calls stay short. Each block comes after its context: the
conversation's leading system turn, and the ``context_turns`` turns before the block or up to ``BLOCK_TURNS`` more, so that these begin
with the role that the conversation begins with after the system turn; with None it comes after all turns before it.
A conversation is rewritten if one of its blocks is, and then none of its blocks has a mask. With a bounded context a template may look
back that far: it is not seen when it changes a turn that is further back, or counts turns. Rows are ordered by turn, then role and text, nulls first;
null roles and texts are empty; rows with a null conv_id form one conversation; repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm.common import map_batches, record_batch
from forumlens.session import stage

BLOCK_TURNS = 32
CONTEXT_TURNS = 2
START, END = "<|im_start|>", "<|im_end|>"
_MARK = ""

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    """No ``<|`` is left: each ``<``, backslashes, ``|`` gets one more backslash."""
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def chat_markup(turns: list[Turn]) -> str:
    """The template of the registered query: marked turns, control strings inside texts escaped."""
    return "".join(f"{START}{_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


def parse(formatted: str) -> list[Turn]:
    """The turns of a text made by ``chat_markup``."""
    return [(_unrole(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def render_block(template: Template, context: list[Turn], turns: list[Turn],
                 trained: frozenset[str]) -> tuple[str, list[tuple[int, int]], list[int], bool]:
    """What the turns add after their context: the text, spans under the loss mask, each turn's start, rewritten or not."""
    prefix = before = template(context) if context else ""
    spans, starts, rewritten = [], [], False
    for k, (role, text) in enumerate(turns):
        past = context + turns[:k]
        output = template(past + [(role, text)])
        if not output.startswith(before):
            rewritten = True
        starts.append(len(before) - len(prefix))
        if role in trained and not rewritten:
            marked, empty = template(past + [(role, _MARK)]), template(past + [(role, "")])
            at = marked.find(_MARK, len(before))
            size = len(output) - len(empty)
            if at < 0 or output[:at] != marked[:at] or output[at + size:] != empty[at:]:
                rewritten = True  # the template changes what stands around a text
            else:
                spans.append((at - len(prefix), at - len(prefix) + size))
        before = output
    if rewritten:
        return before[len(prefix):] if before.startswith(prefix) else before, [], starts, True
    return before[len(prefix):], spans, starts, False


def block_context(head: list[Turn], past: list[Turn], context_turns: int | None) -> list[Turn]:
    """What a block is rendered after: ``head`` has the conversation's first two turns, ``past`` the latest turns before the block."""
    if context_turns is None:
        return past
    system = [t for t in head[:1] if t[0] == "system"]
    opening = head[len(system)][0] if len(head) > len(system) else None
    least = min(context_turns, len(past))
    starts = range(len(past) - least, max(-1, len(past) - least - BLOCK_TURNS - 1), -1)
    begin = next((k for k in starts if least and past[k][0] == opening), len(past) - least)
    return system + past[begin:]


_BLOCK = "conv_id long, block long, n_turns long, text string, mask array<struct<first: long, end: long>>, " \
         "turn_starts array<long>, rewritten boolean"


def format_conversations(turns: DataFrame, template: Template = chat_markup, trained: tuple[str, ...] = ("assistant",),
                         context_turns: int | None = CONTEXT_TURNS) -> DataFrame:
    """Formatted text of conversations (conv_id, turn, role, text), a row for each block of turns.

    ``mask`` and ``turn_starts`` are places in the block's text, in code points. A task streams its conversations
    turn by turn and holds one block and its context, however long a conversation is. ``rewritten`` tells of the whole conversation; blocks are
    staged to find that out.
    """
    learn = frozenset(trained)
    kept = None if context_turns is None else context_turns + BLOCK_TURNS

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block, head, past, waiting, rows, size = (), 0, [], [], [], [], 0

        def flush() -> None:
            nonlocal head, past, waiting, block, size
            context = block_context(head, past, context_turns)
            text, mask, starts, rewritten = render_block(template, context, waiting, learn)
            rows.append((current[0], block, len(waiting), text, [dict(first=a, end=b) for a, b in mask], starts, rewritten))
            if not block:
                head = waiting[:2]
            new = waiting[1:] if kept is not None and not block and waiting[0][0] == "system" else waiting
            past = past + new if kept is None else (past + new)[max(0, len(past) + len(new) - kept):]
            waiting, block, size = [], block + 1, size + len(text)

        for batch in batches:
            for number, role, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if current != (number,):
                    if waiting:
                        flush()
                    current, block, head, past = (number,), 0, [], []
                elif len(waiting) == BLOCK_TURNS:
                    flush()
                waiting.append((role or "", text or ""))
                if size > 1 << 22:
                    yield _blocks(rows)
                    rows, size = [], 0
        if waiting:
            flush()
        if rows:
            yield _blocks(rows)

    ordered = turns.select(F.col("conv_id").cast("bigint"), "role", "text", "turn").repartition("conv_id")
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    blocks = stage(map_batches(ordered, render, _BLOCK))
    changed = blocks.where("rewritten").select(F.col("conv_id").alias("c"), F.lit(True).alias("changed")).distinct()
    whole = F.col("changed").isNotNull()
    judged = blocks.join(changed, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return judged.select("conv_id", "block", "n_turns", "text", F.when(whole, F.slice("mask", 1, 0)).otherwise(F.col("mask")).alias("mask"),
                         "turn_starts", whole.alias("rewritten"))


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    names = ("conv_id", "block", "n_turns", "text", "mask", "turn_starts", "rewritten")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(),
             pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64()), pa.bool_())
    return record_batch(**{n: pa.array(c, k) for n, c, k in zip(names, zip(*rows), kinds)})


def read_back(blocks: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewritten) from formatted blocks.

    Turns are parsed from the text, loss text is what the masks cover, both unescaped; digests run over a conversation's
    blocks in their order, which a task streams.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = (), []

        def close() -> None:
            rows.append((current[0], n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars, rewritten))

        for batch in batches:
            for number, text, mask, changed in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if current != (number,):
                    if current:
                        close()
                    current, n, loss_chars, chars, rewritten = (number,), 0, 0, 0, False
                    all_turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, content in parse(text):
                    n += 1
                    all_turns.update(f"{role}\n{content}\n".encode())
                for span in mask:
                    content = unescape(text[span["first"]:span["end"]])
                    loss_chars += len(content)
                    loss.update(content.encode())
                chars, rewritten = chars + len(text), rewritten or changed
            if len(rows) > 5000:
                yield _digests(rows)
                rows = []
        if current:
            close()
        if rows:
            yield _digests(rows)

    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return map_batches(ordered.select("conv_id", "text", "mask", "rewritten"), digest,
                       "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                       "formatted_chars long, rewritten boolean")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    return record_batch(**{n: pa.array(c, k) for n, c, k in zip(names, zip(*rows), kinds)})
