"""Small column functions on names, paths, sizes, ports, JSON and texts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let


def is_pascal(name: Column) -> Column:
    """Whether a name begins with a capital and a small letter, and has small letters elsewhere."""
    return name.rlike("^[A-Z][a-z]")


def is_snake(name: Column) -> Column:
    """Whether a name has an underscore and letters."""
    return name.contains("_") & name.rlike("[a-zA-Z]")


def last_part(qualified: Column, sign: str = "::") -> Column:
    """What follows the last sign of a qualified name."""
    return F.substring_index(qualified, sign, -1)


def file_part(qualified: Column, sign: str = "::") -> Column:
    """What comes before the first sign of a qualified name."""
    return F.substring_index(qualified, sign, 1)


def human_size(n: Column) -> Column:
    """A number of bytes as 12B, 3.4K or 5.6M; null stays."""
    tenth = lambda x: F.format_string("%.1f", F.round(x, 1))
    return F.when(n.isNull(), None).when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1024 * 1024, F.concat(tenth(n / 1024), F.lit("K"))).otherwise(F.concat(tenth(n / 1048576), F.lit("M")))


def short_path(path: Column, most: int = 50) -> Column:
    """A long path of over three parts as its first and its last two."""
    parts = F.split(path, "/")
    ends = F.concat(F.get(parts, 0), F.lit("/.../"), F.element_at(parts, -2), F.lit("/"), F.element_at(parts, -1))
    return F.when((F.length(path) > most) & (F.size(parts) > 3), ends).otherwise(path)


def short_line(line: Column, width: int) -> Column:
    """A line cut to a width, three dots included."""
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width - 3), F.lit("..."))).otherwise(line)


def short_image(image: Column) -> Column:
    return F.substring_index(image, "/", -1)


def short_ports(ports: Column) -> Column:
    """The first two distinct published ports, and how many there are beyond."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(ports, F.lit("")), F.lit(r":(\d+)->"), F.lit(1)))
    more = F.concat(F.array_join(F.slice(found, 1, 2), ", "), F.lit(", ... +"), (F.size(found) - 2).cast("string"))
    return F.when(F.size(found) <= 2, F.array_join(found, ", ")).otherwise(more)


def resolution(n: int) -> float:
    """How fine communities of a graph of n nodes are."""
    return max(0.05, 1 / math.log10(max(n, 10)))


def json_kind(text: Column) -> Column:
    """The type of a JSON text by Spark's names, null if it is none."""
    return F.schema_of_variant(F.try_parse_json(text))


def decoded(text: Column) -> Column:
    """A JSON object's fields as a map of texts; an empty map if it is none."""
    fields = F.from_json(F.when(F.try_parse_json(text).isNotNull(), text), "map<string,string>")
    return F.coalesce(fields, F.from_json(F.lit("{}"), "map<string,string>"))


def question_slug(question: Column, most: int = 60) -> Column:
    """A question as a file name: words in lower case, joined by hyphens."""
    words = F.regexp_replace(F.lower(question), r"[^\w\s-]", "")
    return F.substring(F.btrim(F.regexp_replace(words, r"[\s_]+", "-"), F.lit("-")), 1, most)


def relative_path(path: Column, root: str) -> Column:
    """A path below a root without it; other paths stay."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 20)).otherwise(path)


def package_parts(path: Column, least: int = 4) -> Column:
    """A path's folders of at least four letters, but for common ones."""
    parts = F.split(path, "/")
    return F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: (F.length(p) >= least) & ~p.isin("home", "src", "lib", "app"))


def content_hash(text: Column) -> Column:
    """A text's SHA-256 in hex digits; null stays."""
    return F.sha2(text.cast("binary"), 256)


def body_hash(text: Column) -> Column:
    """Sixteen digits that name a text whatever its common indent, which blank lines have too; a last line break doesn't count."""
    split = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    def indent_of(lines: Column) -> Column:
        indents = F.transform(F.filter(lines, lambda x: F.btrim(x, F.lit(" \t")) != ""), lambda x: F.length(x) - F.length(F.ltrim(x, F.lit(" \t"))))
        return F.coalesce(F.array_min(indents), F.array_min(F.transform(lines, F.length)))  # lines that are all blank are all indent

    # The indent is found once and not for each line, which would cost the square of a text's lines.
    cut = lambda lines, indent: F.array_join(F.transform(lines, lambda x: F.substring(x, indent + 1, F.length(x))), "\n")
    bare = let(split, lambda lines: let(indent_of(lines), lambda indent: cut(lines, indent)))
    # The last break goes after the cut, for behind it an indented text has a line of its indent alone.
    return F.substring(F.sha2(F.regexp_replace(bare, r"\n\z", "").cast("binary"), 256), 1, 16)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches a glob (* and ? cross folders); `name/**` means a folder of that name at any depth."""
    out = F.lit(False)
    for pattern in patterns:
        sign = {"*": ".*", "?": "."}
        out = out | path.rlike("(?s)^" + "".join(sign.get(c, "\\" + c if not c.isalnum() else c) for c in pattern) + "$")
        if pattern.endswith("/**") and "/" not in pattern[:-3]:
            out = out | F.array_contains(F.split(path, "/"), pattern[:-3])
    return out


# Commands that are never run, and edge kinds by the names that extractors give relations.
DENIED = [
    r"(?i)\brm\s+(-\w*r\w*f\w*|-\w*f\w*r\w*)\s+/\s*$", r"(?i)\brm\s+(-\w*r\w*f\w*|-\w*f\w*r\w*)\s+/(?:\s|$)", r"\bsudo\b", r"\bshutdown\b", r"\breboot\b", r"\bmkfs\b",
    r"(?i)\bdd\s+if=/dev/", r"(?i)\b:(){ :\|:& };:", r"\bchmod\s+(-\w+\s+)*777\s+/\s*$", r"\bchmod\s+(-\w+\s+)*777\s+/(?:\s|$)",
]
RELATIONS = {
    "contains": "CONTAINS", "method": "CONTAINS", "inherits": "INHERITS", "imports": "IMPORTS_FROM", "imports_from": "IMPORTS_FROM", "calls": "CALLS",
    "semantically_similar_to": "SEMANTICALLY_SIMILAR", "defines": "CONTAINS", "uses": "REFERENCES",
}


def denied(command: Column) -> Column:
    """Whether a command must not be run."""
    out = F.lit(False)
    for pattern in DENIED:
        out = out | command.rlike(pattern.replace("{ :", r"\{ :").replace(" };", r" \};"))
    return out


def edge_kind(relation: Column) -> Column:
    """The kind of an edge by an extractor's name of its relation; others in capitals."""
    known = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])[F.lower(relation)]
    return F.coalesce(known, F.upper(relation))
