"""Chat formatting of conversations with typed content parts.

Method: a visitor walks each turn's parts in order.  Text parts are escaped and written; image,
audio and document parts become placeholders, and each leaves a record of its reference, its
place in the formatted text and the number of tokens it expands to.  Conversations are streamed:
rows are dealt by conversation, sorted by turn, and formatted turn by turn in constant memory, so
a conversation may have any number of turns.  The loss mask is the span of each assistant text.

Inside texts a backslash is put after the first character of every control string and after
every backslash, so no control string is left, and removing one backslash of each pair or break
gives the text back.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

OPEN, CLOSE, LEARNT = "<|im_start|>", "<|im_end|>\n", "assistant"
#: Control strings of common templates: anything that opens with <|, sentence, instruction and system marks.
CONTROL = re.compile(r"\\|<(?=\||/?s>|/?unk>|/?pad>|<SYS>>|</SYS>>)|\[(?=/?INST\])")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
PATCH, FRAMES, PAGE_TOKENS = 28, 25, 256

ATTACHMENTS = "array<struct<kind:string,reference:string,at:long,tokens:long>>"
SEGMENTS = f"conv_id long, seq long, at long, segment string, loss_start long, loss_end long, tokens long, attachments {ATTACHMENTS}"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


class Visitor:
    """Flattens the parts of one turn: the text so far, attachments and expanded token counts."""

    def __init__(self, at: int) -> None:
        self.at, self.out, self.attachments = at, [], []

    def visit(self, part: dict) -> None:
        method = getattr(self, f"visit_{part.get('type') or 'text'}", None)
        if method is None:
            raise ValueError(f"no such part: {part.get('type')}")
        method(part)

    def write(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def visit_text(self, part: dict) -> None:
        self.write(escape(part.get("text") or ""))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "reference": part.get("uri"), "at": self.at, "tokens": tokens})
        self.write(f"<|{kind}|>")

    def visit_image(self, part: dict) -> None:
        sides = (max(1, math.ceil((part.get(k) or 0) / PATCH)) for k in ("width", "height"))
        self._attach("image", part, math.prod(sides))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * FRAMES)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, int(part.get("pages") or 1)) * PAGE_TOKENS)


def _present(value) -> bool:
    return value is not None and value is not pd.NA and value == value


def _formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    before, seq, at = object(), 0, 0
    for batch in batches:
        rows = []
        for conv, role, text, parts in zip(batch["conv_id"], batch["role"], batch["text"], batch["parts"], strict=True):
            conv = int(conv) if _present(conv) else None
            if conv != before:
                before, seq, at = conv, 0, 0
            role = role if isinstance(role, str) else ""
            head = OPEN + escape(role).replace("\n", "\\n") + "\n"
            visitor = Visitor(at + len(head))
            if parts is None:
                visitor.visit_text({"text": text})
            else:
                for part in parts:
                    visitor.visit(part if isinstance(part, dict) else part.asDict())
            segment = head + "".join(visitor.out) + CLOSE
            span = (at + len(head), visitor.at) if role == LEARNT else (None, None)
            tokens = sum(x["tokens"] for x in visitor.attachments)
            rows.append((conv, seq, at, segment, *span, tokens, visitor.attachments))
            seq, at = seq + 1, at + len(segment)
        names = ["conv_id", "seq", "at", "segment", "loss_start", "loss_end", "tokens", "attachments"]
        out = pd.DataFrame(rows, columns=names)
        yield out.astype({"conv_id": "Int64", "loss_start": "Int64", "loss_end": "Int64"})


def format_conversations(turns: DataFrame) -> DataFrame:
    """One segment per row of (conv_id, turn, role, text[, parts]); in order they are the output.

    `parts`, where present and not null, takes the place of text: an array of structs with `type`
    (text, image, audio, document) and text, uri, width, height, seconds or pages.  A column of
    that name and another type is an extra column, and those play no part.  Null texts
    and roles are empty; null turns come first; rows of one turn go by role and text; null
    conv_id is a conversation of its own.  `loss_start` and `loss_end` are code points from the
    conversation's start and null for turns that are not learnt.
    """
    typed = turns.schema["parts"].dataType if "parts" in turns.columns else None
    holds = isinstance(typed, ArrayType) and isinstance(typed.elementType, StructType) and "type" in typed.elementType.names
    parts = F.col("parts") if holds else F.lit(None).cast("array<struct<type:string>>")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), parts.alias("parts"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInPandas(_formatted, SEGMENTS)


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and text of a segment; attachments stay as placeholders."""
    if not segment.startswith(OPEN) or not segment.endswith(CLOSE) or segment.find(CLOSE, len(OPEN)) != len(segment) - len(CLOSE):
        raise ValueError("not a formatted turn")
    head, _, body = segment[len(OPEN) : -len(CLOSE)].partition("\n")
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head, flags=re.DOTALL), unescape(body)


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now: list | None = None

    def closed(state: list) -> tuple:
        conv, n, turns, chars, loss, size = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

    for batch in batches:
        done = []
        for conv, at, segment, lo, hi in zip(batch["conv_id"], batch["at"], batch["segment"], batch["loss_start"], batch["loss_end"], strict=True):
            conv = int(conv) if _present(conv) else None
            if now is None or conv != now[0]:
                if now is not None:
                    done.append(closed(now))
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse_segment(segment)
            now[1] += 1
            now[2].update(f"{role}\n{text}\n".encode())
            if _present(lo):
                learnt = unescape(segment[int(lo) - int(at) : int(hi) - int(at)])
                now[3] += len(learnt)
                now[4].update(learnt.encode())
            now[5] += len(segment)
        yield pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})
    if now is not None:
        yield pd.DataFrame([closed(now)], columns=names).astype({"conv_id": "Int64"})


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of conversations, parsed from `format_conversations`' segments as they stream out."""
    return segments.mapInPandas(_digested, DIGESTS)
