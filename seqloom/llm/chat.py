"""Operator 13: conversations of typed parts as training texts, with a loss mask and attachments.

A visitor goes through the parts of each turn in order. Text parts become escaped text; image, audio and
document parts become placeholders, and their references go into a list beside the text, with the
number of tokens that each placeholder expands to. A conversation reads

    <s>[SYS] text [/SYS][INST] text [/INST] text </s>[ROLE] name [TEXT] text [/ROLE]...

for turns of system, user, assistant and any other role. One blank stands between a text and each mark,
so that a mark of the template never follows a backslash; a control string inside a text gets a backslash
before it. So every text comes back exactly, whatever it holds, and texts without control strings stay
as they are.

Turns are sorted by conversation and streamed: a task holds one block of a conversation, so a
conversation may be of any length. A block ends after the turn that reaches BLOCK_CHARS.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import tasks

BLOCK_CHARS = 1 << 20
BEGIN, END = "<s>", "</s>"
#: What stands before and after the text of a turn of each role; any other role is named.
TURNS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", f" {END}")}
NAMED, NAME_END, NAMED_END = "[ROLE] ", " [TEXT] ", " [/ROLE]"
PLACEHOLDERS = {kind: f"<|{kind}|>" for kind in ("image", "audio", "document", "file")}
CONTROLS = [BEGIN, END, "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/ROLE]", *PLACEHOLDERS.values()]
_ANY = "|".join(re.escape(c) for c in CONTROLS)
_CONTROL, _ESCAPED, _MARK = re.compile(f"(?={_ANY})"), re.compile(rf"\\(?={_ANY})"), re.compile(rf"(?<!\\)(?:{_ANY})")
_KINDS = {mark: kind for kind, mark in PLACEHOLDERS.items()}


def escape(text: str) -> str:
    """With a backslash before each control string; those that stand there already stay."""
    return _CONTROL.sub(r"\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


@dataclass(frozen=True)
class Expansion:
    """How many tokens the placeholder of a part becomes; 1 where its extent isn't known."""

    patch: int = 14
    audio_per_s: float = 25.0
    page: int = 256

    def image(self, part: dict) -> int:
        width, height = part.get("width"), part.get("height")
        return max(1, math.ceil(width / self.patch) * math.ceil(height / self.patch)) if width and height else 1

    def audio(self, part: dict) -> int:
        return max(1, math.ceil((part.get("seconds") or 0) * self.audio_per_s))

    def document(self, part: dict) -> int:
        return max(1, (part.get("pages") or 0) * self.page)

    def file(self, part: dict) -> int:
        return 1


@dataclass
class Flattened:
    """The visitor: takes parts in order, keeps the body of the turn and what is attached to it."""

    expansion: Expansion
    pieces: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)  # of texts in the body
    attachments: list[tuple[int, str, str | None, int]] = field(default_factory=list)  # place, kind, reference, tokens
    size: int = 0
    _open: list[str] = field(default_factory=list)

    def _put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.size += len(piece)

    def _close(self) -> None:
        # texts side by side are one, lest a control string be made where they meet
        if self._open:
            start = self.size
            self._put(escape("".join(self._open)))
            self._open.clear()
            self.spans.append((start, self.size))

    def visit(self, part: dict) -> None:
        kind = part.get("type")
        if kind == "text" or (kind not in PLACEHOLDERS and part.get("text") is not None):
            self._open.append(part.get("text") or "")
            return
        kind = kind if kind in PLACEHOLDERS else "file"
        self._close()
        self.attachments.append((self.size + 1, kind, part.get("ref"), getattr(self.expansion, kind)(part)))
        self._put(f" {PLACEHOLDERS[kind]} ")

    def body(self) -> str:
        self._close()
        return "".join(self.pieces)


def format_turn(role: str, parts: list[dict], expansion: Expansion) -> tuple[str, list, list]:
    """A turn's text, the places in it that count for the loss (the assistant's texts), and its attachments."""
    flat = Flattened(expansion)
    for part in parts:
        flat.visit(part)
    body = flat.body()
    before, after = TURNS.get(role) or (f"{NAMED}{escape(role)}{NAME_END}", NAMED_END)
    shift = len(before)
    loss = [(a + shift, b + shift) for a, b in flat.spans if b > a] if role == "assistant" else []
    return before + body + after, loss, [(p + shift, *rest) for p, *rest in flat.attachments]


_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_ATTACHED = pa.struct([("place", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int64())])
_BLOCK = pa.schema([("conv_id", pa.int64()), ("block", pa.int32()), ("n_turns", pa.int32()), ("text", pa.string()), ("loss", pa.list_(_SPAN)),
                    ("attachments", pa.list_(_ATTACHED)), ("attached_tokens", pa.int64())])
BLOCK_DDL = (
    "conv_id long, block int, n_turns int, text string, loss array<struct<start:int,stop:int>>, "
    "attachments array<struct<place:int,kind:string,ref:string,n_tokens:bigint>>, attached_tokens long"
)
_NOTHING = object()


def _blocks(expansion: Expansion, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        conv, block, chars = _NOTHING, 0, 0
        texts, loss, attachments = [], [], []
        size, n_turns = 0, 0

        def end():
            nonlocal texts, loss, attachments, size, n_turns, chars
            rows.append({
                "conv_id": conv, "block": block, "n_turns": n_turns, "text": "".join(texts), "loss": [{"start": a, "stop": b} for a, b in loss],
                "attachments": [dict(zip(("place", "kind", "ref", "n_tokens"), a, strict=True)) for a in attachments], "attached_tokens": sum(a[3] for a in attachments),
            })
            chars += size
            texts, loss, attachments, size, n_turns = [], [], [], 0, 0

        for batch in batches:
            with_parts = batch.num_columns > 4
            columns = [c.to_pylist() for c in batch.columns]
            for k, this in enumerate(columns[0]):
                if conv is _NOTHING or this != conv:
                    if conv is not _NOTHING:
                        end()
                    conv, block, texts, size = this, 0, [BEGIN], len(BEGIN)
                elif size >= block_chars:
                    end()
                    block += 1
                parts = columns[4][k] if with_parts else None
                parts = [p for p in parts if p is not None] if parts is not None else [{"type": "text", "text": columns[3][k]}]
                turn, counted, attached = format_turn(columns[2][k] or "", parts, expansion)
                loss += [(a + size, b + size) for a, b in counted]
                attachments += [(p + size, *rest) for p, *rest in attached]
                texts.append(turn)
                size += len(turn)
                n_turns += 1
                if len(rows) >= 256 or chars > 4 * block_chars:
                    yield pa.RecordBatch.from_pylist(rows, schema=_BLOCK)
                    rows, chars = [], 0
        if conv is not _NOTHING:
            end()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_BLOCK)

    return run


def format_conversations(
    df: DataFrame, parts_col: str | None = None, expansion: Expansion = Expansion(), block_chars: int = BLOCK_CHARS,
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """conv_id, block, n_turns, text, loss, attachments, attached_tokens: a row for each block of a conversation.

    ``parts_col`` names a column of parts (array of structs with the fields type and, as they apply,
    text, ref, width, height, seconds, pages); where it is null, or isn't given, a turn is its text. Rows go
    by turn; equal turns by role, text and parts, and rows that repeat another are turns too. A null turn
    comes first, a null role is the role '', a null text is empty, rows with a null conv_id are one
    conversation. Parts of an unknown type are text if they have any, else files; null parts go. Places in
    ``loss`` and ``attachments`` are code points of the block's text. Other columns are ignored.
    """
    columns = [F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    rows = df.select(*columns, *([F.col(parts_col).alias("parts")] if parts_col else []))
    dealt = rows.repartition(tasks(df.sparkSession), "conv_id").sortWithinPartitions(*rows.columns)
    return dealt.mapInArrow(_blocks(expansion, block_chars), BLOCK_DDL)


def turns_of(text: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """The turns of a block: role and parts, which are ("text", text) or (kind, "") of an attachment."""
    at = len(BEGIN) if text.startswith(BEGIN) else 0
    while at < len(text):
        role = next((r for r in ("system", "user") if text.startswith(TURNS[r][0], at)), "assistant")
        if text.startswith(NAMED, at):
            name_end = _MARK.search(text, at + len(NAMED))
            role, after = unescape(text[at + len(NAMED) : name_end.start() - 1]), NAMED_END
            at = name_end.end() + 1
        else:
            before, after = TURNS[role]
            at += len(before)
        parts: list[tuple[str, str]] = []
        while True:
            mark = _MARK.search(text, at)
            parts.append(("text", unescape(text[at : mark.start() - 1])))
            at = mark.end()
            if mark[0] == after[1:]:
                break
            parts.append((_KINDS[mark[0]], ""))
            at += 1
        yield role, [p for p in parts if p[0] != "text" or p[1]]


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                   ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("attached_tokens", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose blocks come in order; one block is held at a time."""
    found: list[tuple] = []
    conv, state = _NOTHING, None

    def end():
        n, turns, loss_chars, loss, chars, n_attached, tokens = state
        found.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_attached, tokens))

    def out():
        columns = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _READ, strict=True)]
        found.clear()
        return pa.RecordBatch.from_arrays(columns, schema=_READ)

    for batch in batches:
        for this, text, loss, attached, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv is _NOTHING or this != conv:
                if conv is not _NOTHING:
                    end()
                conv, state = this, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            for role, parts in turns_of(text):
                state[0] += 1
                said = "".join(t for kind, t in parts if kind == "text")
                state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            for span in loss:
                said = unescape(text[span["start"] : span["stop"]])
                state[2] += len(said)
                state[3].update(said.encode("utf-8", "surrogatepass"))
            state[4] += len(text)
            state[5] += len(attached)
            state[6] += tokens
            if len(found) >= 4096:
                yield out()
    if conv is not _NOTHING:
        end()
    if found:
        yield out()


def read_back(blocks: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, attached_tokens, from
    formatted blocks alone: turns are read from the text, and the loss is what its places hold, unescaped.

    A conversation's digests are taken in order, so by one task, which holds one block of it.
    """
    rows = blocks.select("conv_id", "block", "text", "loss", "attachments", "attached_tokens")
    dealt = rows.repartition(tasks(blocks.sparkSession), "conv_id").sortWithinPartitions("conv_id", "block").drop("block")
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attached_tokens long"
    return dealt.mapInArrow(_digests, ddl)


#: A conversation whose texts hold control strings; the query formats it beside those of the table.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def with_probe(spark: SparkSession, df: DataFrame) -> DataFrame:
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return df.select("conv_id", "turn", "role", "text").unionByName(probe)
