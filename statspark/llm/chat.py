"""Chat formatting with a template that is only called, never read, and the loss mask found from what it returns.

Successive prefixes of the turns are rendered and each output is compared with the one before: where they part, the new
turn begins. Two probe texts in place of the turn's own show what the template puts before and after the text. A template
whose output for more turns changes text that it had already written for earlier ones rewrites history; that is reported,
and such a conversation has no spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statspark.llm.common import small_batches

Turn = tuple[str, str]
#: Turns of a conversation that are rendered together if the template is local; bounds the work, not the result.
BLOCK = 32
#: Rows without a turn number come first; they are dealt to so many blocks by a hash.
_LOOSE = 64

# The control strings of the default template.
CONTROLS = ("[INST]", "[/INST]", "[ANS]", "</s>", "[ROLE]", "[SAYS]", "[/ROLE]")
_MARK = re.compile("|".join(map(re.escape, CONTROLS)))
_CONTROL = re.compile(rf"(\\*)({_MARK.pattern})")


def escape(text: str) -> str:
    """Control strings get a backslash in front, and backslashes that stand there are doubled."""
    if not _MARK.search(text):
        return text
    return _CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    if not _MARK.search(text):
        return text
    return _CONTROL.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def render(turns: Iterable[Turn]) -> str:
    """The default template: each turn stands between its own marks, texts and roles are escaped."""
    out = []
    for role, text in turns:
        if role == "user":
            out.append(f"[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f"[ANS] {escape(text)} </s>")
        else:
            out.append(f"[ROLE] {escape(role)} [SAYS] {escape(text)} [/ROLE]")
    return "".join(out)


def parse(formatted: str) -> list[Turn]:
    """The turns of a text that ``render`` made. A mark is a control string without a backslash in front."""
    turns, role, begin = [], "", 0
    for m in _MARK.finditer(formatted):
        if formatted[m.start() - 1 : m.start()] == "\\":
            continue
        if m[0] in ("[INST]", "[ANS]"):
            role, begin = {"[INST]": "user", "[ANS]": "assistant"}[m[0]], m.end() + 1
        elif m[0] == "[ROLE]":
            begin = m.end() + 1
        elif m[0] == "[SAYS]":
            role, begin = unescape(formatted[begin : m.start() - 1]), m.end() + 1
        else:
            turns.append((role, unescape(formatted[begin : m.start() - 1])))
    return turns


@dataclass(frozen=True)
class Template:
    """What formats a conversation: ``render(turns) -> str``, and how to read a text back.

    ``local`` says that a turn is rendered the same way whatever stands around it; this is checked on every turn. Only then
    are long conversations cut into blocks. ``learned`` are the roles whose text is under the loss mask.
    """

    render: Callable[[list[Turn]], str] = render
    unescape: Callable[[str], str] = unescape
    local: bool = True
    learned: tuple[str, ...] = ("assistant",)


def _shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _around(template: Template, before: list[Turn], role: str) -> tuple[str, str]:
    """What the template writes before and after the text of one more turn of this role."""
    a, b = (template.render([*before, (role, probe)]) for probe in ("a", "b"))
    head = _shared(a, b)
    return a[:head], a[head + 1 :]


@dataclass
class Formatted:
    """``spans``: (start, end, text start, text end) of each turn in ``text``; none after a rewrite.

    ``rewrites_at``: the first turn that changed what stood before it. ``altered``: turns whose text did not come back whole.
    """

    text: str
    spans: list[tuple[int, int, int, int]]
    rewrites_at: int | None
    altered: int


def format_turns(turns: list[Turn], template: Template) -> Formatted:
    """Render every prefix of ``turns`` and locate each turn from the difference to the prefix before."""
    spans: list[tuple[int, int, int, int]] = []
    before, altered, known = template.render([]) if turns else "", 0, {}
    for k, (role, text) in enumerate(turns):
        now = template.render(turns[: k + 1])
        start = _shared(before, now)
        if spans and start < spans[-1][3]:
            return Formatted(template.render(turns), [], k, altered)
        if spans:  # what the template wrote after the last text and has taken back belongs to no turn
            spans[-1] = (*spans[-1][:1], min(spans[-1][1], start), *spans[-1][2:])
        if template.local:
            if now[len(before) :] != template.render([(role, text)]):
                raise ValueError("the template is not local: a turn is rendered otherwise on its own")
            if role not in known:
                known[role] = _around(template, [], role)
            head, tail = known[role]
            begin, end = len(before) + len(head), len(now) - len(tail)
            fits = now.startswith(head, len(before))
        else:
            head, tail = _around(template, turns[:k], role)
            begin, end = len(head), len(now) - len(tail)
            fits = now.startswith(head)
        end = max(begin, end)
        altered += not (fits and now.endswith(tail) and template.unescape(now[begin:end]) == text)
        spans.append((start, len(now), begin, end))
        before = now
    return Formatted(before, spans, None, altered)


_SPANS = "array<struct<role: string, start: long, stop: long, text_start: long, text_stop: long, learned: boolean>>"


def format_conversations(rows: DataFrame, template: Template = Template(), conv: str = "conv_id") -> DataFrame:
    """Formatted conversations in blocks: (conv_id, block, part, n_turns, text, spans, rewrites_at, altered).

    ``rows`` has conv_id, turn, role and text; turns are ordered by turn, then role and text (rows that repeat all stay).
    Rows without a turn come first, in the order of a hash of role and text. Null texts and roles are empty; a null id is a
    conversation like any other. With a local template a block holds the turns of ``BLOCK`` turn numbers and is split into
    parts of ``BLOCK`` rows, so a long conversation is spread over tasks and never held whole; else a block is a whole
    conversation, whose prefixes must all be rendered from its start. An empty table gives no rows; other columns are ignored.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema[conv].dataType.simpleString()
    plain = rows.select(
        F.col(conv).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("body"),
    )
    loose = F.pmod(F.xxhash64("role", "body"), F.lit(_LOOSE)) - F.lit(_LOOSE)
    block = F.when(F.col("turn").isNull(), F.struct(F.lit(0).alias("numbered"), loose.alias("n"))).otherwise(
        F.struct(F.lit(1).alias("numbered"), F.floor(F.col("turn") / BLOCK).alias("n"))
    )
    if not template.local:
        block = F.struct(F.lit(0).alias("numbered"), F.lit(0).cast("long").alias("n"))
    order = ["conv", "block", "turn", F.when(F.col("turn").isNull(), loose), "role", "body"]
    keyed = plain.withColumn("block", block)
    ordered = keyed.repartition("conv", "block").sortWithinPartitions(*order)

    def run(batches):
        schema = None
        held: list[Turn] = []
        at, part = None, 0

        def settle():
            out = format_turns(held, template)
            names = ("role", "start", "stop", "text_start", "text_stop", "learned")
            spans = [dict(zip(names, (role, *span, role in template.learned))) for (role, _), span in zip(held, out.spans)]
            row = {
                "conv": at[0], "block": dict(zip(("numbered", "n"), at[1:])), "part": part, "n_turns": len(held), "text": out.text,
                "spans": spans, "rewrites_at": out.rewrites_at, "altered": out.altered,
            }
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            if schema is None:
                span = [(c, pa.int64()) for c in ("start", "stop", "text_start", "text_stop")]
                schema = pa.schema([
                    ("conv", batch.schema.field("conv").type), ("block", pa.struct([("numbered", pa.int32()), ("n", pa.int64())])), ("part", pa.int64()),
                    ("n_turns", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("role", pa.string()), *span, ("learned", pa.bool_())]))),
                    ("rewrites_at", pa.int64()), ("altered", pa.int64()),
                ])
            for r in batch.to_pylist():
                here = (r["conv"], r["block"]["numbered"], r["block"]["n"])
                full = template.local and len(held) >= BLOCK
                if held and (here != at or full):
                    yield settle()
                    part, held = (part + 1 if here == at else 0), []
                at = here
                held.append((r["role"], r["body"]))
        if held:
            yield settle()

    out = ordered.mapInArrow(
        run, f"conv {kind}, block struct<numbered: int, n: long>, part long, n_turns long, text string, spans {_SPANS}, rewrites_at long, altered long"
    )
    return out.withColumnRenamed("conv", conv)


def write_conversations(rows: DataFrame, path: str, template: Template = Template(), conv: str = "conv_id") -> None:
    format_conversations(rows, template, conv).write.parquet(path)


def read_conversations(
    spark: SparkSession, path: str, parse: Callable[[str], list[Turn]] = parse, unescape: Callable[[str], str] = unescape, conv: str = "conv_id"
) -> DataFrame:
    """Digests per conversation, read from its blocks in order: turns from the marks, learned texts from the loss mask.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline per turn), loss_chars, loss_sha256 (learned texts unescaped,
    one after the other), formatted_chars, rewrites_at (whether a template changed earlier text), altered. Blocks stream through
    a task in order; it holds one block and two hash states, however long the conversation.
    """
    blocks = spark.read.parquet(path)
    kind = blocks.schema[conv].dataType.simpleString()
    ordered = blocks.withColumnRenamed(conv, "conv").repartition("conv").sortWithinPartitions("conv", "block", "part")

    def run(batches) -> Iterator[pa.RecordBatch]:
        schema, row, turns, loss = None, None, None, None

        def settle(row, turns, loss):
            return pa.RecordBatch.from_pylist([row | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}], schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([
                    (conv, batch.schema.field("conv").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.bool_()), ("altered", pa.int64()),
                ])
            for b in batch.to_pylist():
                if row is None or b["conv"] != row[conv]:
                    if row is not None:
                        yield settle(row, turns, loss)
                    row = {conv: b["conv"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "rewrites": False, "altered": 0}
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                text = b["text"]
                for role, said in parse(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    row["n_turns"] += 1
                for s in b["spans"]:
                    if s["learned"]:
                        said = unescape(text[s["text_start"] : s["text_stop"]])
                        loss.update(said.encode())
                        row["loss_chars"] += len(said)
                row["formatted_chars"] += len(text)
                row["rewrites"] |= b["rewrites_at"] is not None
                row["altered"] += b["altered"]
        if row is not None:
            yield settle(row, turns, loss)

    columns = f"`{conv}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean, altered long"
    return ordered.mapInArrow(run, columns)
