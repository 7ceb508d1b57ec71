"""Chunks of plain texts, Markdown and JSON for an index, each of a bounded number of characters.

Texts are cut in Arrow batches, a text at a time: where a chunk ends depends on all that came
before it in its text, and on nothing else.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST, GROUP, STEP = 4_096, 20, 18
BLANK = re.compile(r"\n\s*\n")
HEADING = re.compile(r"(#{1,4})\s+(.+)")
FENCE = re.compile(r"`{3,}|~{3,}")
NAMES = ("id", "name", "title", "label")


def paragraphs(text: str) -> list[str]:
    return [p for p in (x.strip() for x in BLANK.split(text)) if p]


def packed(parts: list[str], title: str, most: int) -> Iterator[tuple[str, str]]:
    """Paragraphs joined by blank lines while they fit; one that is longer stands alone."""
    held: list[str] = []
    size, number = 0, 0
    for part in [*parts, None]:
        if held and (part is None or size + 2 + len(part) > most):
            number += 1
            yield f"{title} {number}", "\n\n".join(held)
            held, size = [], 0
        if part is not None:
            size += len(part) + 2 * bool(held)
            held.append(part)


def by_lines(text: str, most: int) -> Iterator[tuple[str, str]]:
    """Windows of GROUP lines every STEP; a longer window is cut at `most` characters."""
    lines, number = text.splitlines(), 0
    for at in range(0, len(lines), STEP):
        window = "\n".join(lines[at : at + GROUP])
        for lo in range(0, len(window) if len(window) > most else 1, most):
            number += 1
            yield f"Lines {number}", window[lo : lo + most] if len(window) > most else window


def plain_chunks(text: str, most: int = MOST) -> list[tuple[str, str]]:
    """(title, text) of a plain text: by paragraphs, or by lines if it has fewer than three."""
    if not text.strip():
        return []
    parts = paragraphs(text)
    return list(by_lines(text, most) if len(parts) < 3 else packed(parts, "Paragraph", most))


def sections(text: str) -> Iterator[tuple[str, str]]:
    """(heading, text) of a Markdown text's parts, the heading line included; headings in fences don't count."""
    title, held, fenced = "Preamble", [], False
    for line in text.split("\n"):
        found = None if fenced else HEADING.fullmatch(line.rstrip("\r"))
        if FENCE.match(line):
            fenced = not fenced
        if found:
            yield title, "\n".join(held).strip()
            title, held = found[2].strip(), []
        held.append(line)
    yield title, "\n".join(held).strip()


def cut(title: str, text: str, most: int) -> Iterator[tuple[str, str]]:
    """A text in parts of at most `most` characters, cut at the last blank line behind their first quarter if there is one."""
    number = 1
    while text:
        end = len(text)
        if end > most:
            at = text.rfind("\n\n", 0, most)
            end = at if at > most // 4 else most
        yield title if number == 1 else f"{title} (part {number})", text[:end].strip()
        text, number = text[end:].strip(), number + 1


def markdown_chunks(text: str, most: int = MOST) -> list[tuple[str, str]]:
    """(title, text) of a Markdown text by its headings of one to four signs; without any, by paragraphs."""
    if not text.strip():
        return []
    parts = list(sections(text))
    if len(parts) == 1:
        return list(packed(paragraphs(text), "Section", most))
    return [chunk for title, body in parts if body for chunk in cut(title, body, most)]


def json_chunks(value, most: int = MOST, path: str = "") -> Iterator[tuple[str, str]]:
    """(title, text) of a JSON value: the largest subtrees that fit, and runs of a list's items that fit together."""
    shown = json.dumps(value, ensure_ascii=False, default=str)
    if isinstance(value, dict):
        own = next((str(value[k]) for k in NAMES if isinstance(value.get(k), str | int)), "")
        if len(shown) <= most:
            yield f"{path} ({own})" if own else path or "root", shown
        else:
            for key, child in value.items():
                yield from json_chunks(child, most, f"{path}.{key}" if path else key)
    elif isinstance(value, list):
        run: list = []
        size = 0
        for k, item in enumerate([*value, None]):
            length = len(json.dumps(item, ensure_ascii=False, default=str))
            if run and (k == len(value) or size + length > most):
                yield f"{path}[{k - len(run)}..{k - 1}]", json.dumps(run, ensure_ascii=False, default=str)
                run, size = [], 0
            if k < len(value):
                run.append(item)
                size += length
    else:
        yield path or "value", str(value)


def _of_json(text: str, most: int) -> list[tuple[str, str]]:
    try:
        return list(json_chunks(json.loads(text), most))
    except ValueError:
        return plain_chunks(text, most)


def any_chunks(text: str, most: int = MOST) -> list[tuple[str, str]]:
    """Chunks by what a text looks like: JSON by its first sign, Markdown by a heading or fence, else plain."""
    if text.lstrip()[:1] in ("{", "["):
        return _of_json(text, most)
    return markdown_chunks(text, most) if re.search(r"(?m)^(?:#{1,4}\s|`{3}|~{3})", text) else plain_chunks(text, most)


def chunk(texts: DataFrame, how: Callable[[str, int], list[tuple[str, str]]] = any_chunks, most: int = MOST) -> DataFrame:
    """(id, part, title, text): the chunks of texts (id, text); null and blank texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, *c) for i, t in zip(batch["id"], batch["text"].fillna(""), strict=True) for k, c in enumerate(how(t, most))]
            yield pd.DataFrame(rows, columns=["id", "part", "title", "text"])

    return texts.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "id long, part int, title string, text string")
