"""Text transforms as column expressions: compression, HTML to text, chunks, tokens, slugs, masks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let

# The words, phrases and patterns of the compression rules.
FILLERS = [
    "just", "really", "basically", "actually", "simply", "essentially", "generally", "literally", "certainly", "obviously", "probably", "typically",
    "usually", "definitely", "particularly", "specifically",
]
PHRASES = {
    "in order to": "to", "make sure to": "ensure", "make sure that": "ensure", "due to the fact that": "because", "at this point in time": "now",
    "in the event that": "if", "for the purpose of": "for", "with respect to": "re", "as a result of": "from", "on the other hand": "alternatively",
    "in addition to": "plus", "a large number of": "many", "a small number of": "few", "is able to": "can", "is not able to": "can't",
    "has the ability to": "can", "in spite of": "despite", "with regard to": "re", "for example": "e.g.", "such as": "e.g.",
    "that is to say": "i.e.", "as well as": "and",
}
ARTICLES = ["a", "an", "the"]
CONNECTIVES = ["however", "furthermore", "additionally", "moreover", "consequently", "nevertheless", "nonetheless", "accordingly"]
ABBREVIATIONS = {
    "database": "DB", "authentication": "auth", "authorization": "authz", "configuration": "config", "request": "req", "response": "res",
    "function": "fn", "implementation": "impl", "application": "app", "repository": "repo", "directory": "dir", "environment": "env",
    "dependency": "dep", "dependencies": "deps", "parameter": "param", "parameters": "params", "argument": "arg", "arguments": "args",
    "document": "doc", "documents": "docs", "information": "info", "specification": "spec", "specifications": "specs", "development": "dev",
    "production": "prod", "connection": "conn", "connections": "conns", "component": "comp", "components": "comps", "middleware": "mw",
    "approximately": "~", "administrator": "admin", "management": "mgmt",
}
PLEASANTRIES = r"(?i)\b(?:sure[,!.]?\s*|of course[,!.]?\s*|happy to\s+|glad to\s+|i'd be happy to[^.]*\.\s*|i'd recommend\s+|please note that\s+|it's worth noting that\s+|it should be noted that\s+|as you (?:can see|know|may know)[,]?\s*)"
HEDGING = r"(?i)\b(?:it might be worth\s+|you could consider\s+|you may want to\s+|it would be possible to\s+|it seems like\s+|it appears that\s+|in my opinion[,]?\s*|i think that?\s+|i believe that?\s+|(?:this|that|it) (?:is|was) (?:likely|probably)\s+)"
CAUSES = ["because", "therefore", "so that", "which leads to", "which causes", "resulting in"]
PROTECTED = [
    r"(?s:(`{3,}|~{3,})[^\n]*\n.*?\n\1)", r"`[^`]+`", r"https?://[^\s)>\]]+", r"[\w./]++::[\w.]+", r"(?:\./|\.\./|/|[A-Za-z]:\\)[\w\-/\\.]+",
    r"[\w\-.]++[/\\][\w\-/\\.]+", r"\b\d+(?:\.\d+)?(?:\s*(?:ms|s|KB|MB|GB|TB|%))?(?=\s|$|[,;.])",
]
SKIPPED_KEYS = [
    "kind", "type", "pipeline", "language", "format", "qualified_name", "file_path", "file_type", "source", "target", "id", "flow_id", "community_id",
    "node_id", "color", "status", "version", "schema_version", "line_start", "line_end", "line", "count", "total", "total_nodes", "total_edges",
    "files_count", "length", "weight", "score", "confidence", "confidence_score", "connected", "is_valid", "notes_written", "node_count", "edge_count",
    "nodes", "edges",
]
TEXT_KEYS = [
    "name", "label", "description", "summary", "content", "text", "message", "detail", "reason", "explanation", "title", "body", "relation", "question",
]
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}

#: Stands for a protected span while the rules run; itself protected where a text has it.
HOLE = "\ue000"


def replacements(level: str) -> list[tuple[str, str] | list[str]]:
    """The steps of a level, lite, full (lite first) or ultra (full first): (pattern, replacement), or words to drop."""
    return [step for _, steps in stages(level) for step in steps]


def stages(level: str) -> list[tuple[list[str], list]]:
    """The steps of a level, by the words of which a text has one if any of a stage's steps changes it; no words where none are known."""
    out: list = [([], [(PLEASANTRIES, ""), (HEDGING, "")]), (list(PHRASES), [("(?i)" + a, b) for a, b in PHRASES.items()])]
    out.append(([], [FILLERS]))
    if level in ("full", "ultra"):
        out.append(([], [ARTICLES]))
        out.append((CONNECTIVES, [(rf"(?i)\b{word}[,]?\s+", "") for word in CONNECTIVES]))
    if level == "ultra":
        out.append((list(ABBREVIATIONS), [(rf"(?i)\b{a}\b", b) for a, b in ABBREVIATIONS.items()]))
        out.append((CAUSES, [(rf"\s+{cause}\s+", " \u2192 ") for cause in CAUSES]))
    return out


def replaced(text: Column, level: str) -> Column:
    """A text after the steps of a level, one after the other; words that steps in a row drop go at once."""
    out, dropped = text, []
    for words, steps in stages(level):
        if isinstance(steps[0], list):
            dropped += steps[0]
            continue
        if dropped:
            out, dropped = without_words(out, dropped), []
        out = where_met(out, words, steps)
    return without_words(out, dropped) if dropped else out


def without_words(text: Column, words: list[str]) -> Column:
    """The words of a text, one blank between, but for some (whatever their case and the marks after them)."""
    marks = ".,;:!?"
    bare = lambda w: F.lower(F.when(F.substring(w, -1, 1).isin(list(marks)), F.rtrim(w, F.lit(marks))).otherwise(w))
    return F.array_join(F.filter(F.split(text, r"\s+"), lambda w: (w != "") & ~bare(w).isin(words)), " ")


def where_met(text: Column, words: list[str], steps: list[tuple[str, str]]) -> Column:
    """A text after some steps, which are left out where it has none of the words, whatever their case (a word is in all that a step matches)."""

    def after(t: Column) -> Column:
        for pattern, new in steps:
            t = F.regexp_replace(t, pattern, new)
        return t

    met = lambda low: reduce(or_, [low.contains(w) for w in words])
    return let(text, lambda t: let(F.lower(t), lambda low: F.when(met(low), after(t)).otherwise(t))) if words else after(text)


def compress(text: Column, level: str = "full") -> Column:
    """Rule compression; `off` leaves a text as it is.

    Fenced and inline code, URLs, qualified names, paths and numbers are cut out first and put
    back at the end, as they were.
    """
    if level == "off":
        return text
    guard = "|".join([HOLE, *PROTECTED])

    def without(t: Column) -> Column:
        # Spans between two signs are found and cut out in one pass; a text that has the sign itself takes two.
        marked = F.split(F.regexp_replace(t, guard, f"{HOLE}$0{HOLE}"), HOLE, -1)
        odd = lambda want: lambda x, i: (i % 2) == want
        once = let(marked, lambda m: F.struct(F.array_join(F.filter(m, odd(0)), HOLE).alias("text"), F.filter(m, odd(1)).alias("spans")))
        twice = F.struct(F.regexp_replace(t, guard, HOLE).alias("text"), F.regexp_extract_all(t, F.lit(guard), F.lit(0)).alias("spans"))
        return F.when(t.contains(HOLE), twice).otherwise(once)

    def filled(cut: Column) -> Column:
        parts = F.split(F.btrim(F.regexp_replace(replaced(cut["text"], level), " {2,}", " "), F.lit(" \t\n\r")), HOLE, -1)
        return F.array_join(F.transform(parts, lambda x, i: F.concat(x, F.coalesce(F.get(cut["spans"], i), F.lit("")))), "")

    return let(let(text, without), filled)


def compress_fields(fields: Column, level: str = "full") -> Column:
    """A map of texts with those of the text keys compressed; the other keys' values stay."""
    shorter = lambda k, v: F.when(k.isin(TEXT_KEYS) & ~k.isin(SKIPPED_KEYS), compress(v, level)).otherwise(v)
    return F.transform_values(fields, shorter)


def compress_list(texts: Column, level: str = "full") -> Column:
    """A list of texts with those over 20 characters compressed."""
    return F.transform(texts, lambda x: F.when(F.length(x) > 20, compress(x, level)).otherwise(x))


def html_rules() -> list[tuple[str, str]]:
    """(pattern, replacement) from HTML to text: scripts, styles and comments go, blocks end lines."""
    return [
        (r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>", ""), (r"(?s)<!--.*?-->", ""),
        (r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|blockquote|pre)\b[^>]*>", "\n"), (r"<[^>]+>", ""),
    ]


def html_to_text(html: Column) -> Column:
    """The text of a page: tags gone, six entities replaced, blanks collapsed."""
    out = html
    for pattern, new in html_rules():
        out = F.regexp_replace(out, pattern, new)
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.btrim(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def slug(text: Column, most: int = 30) -> Column:
    """Lower-case ASCII letters and digits, other runs as one hyphen, cut."""
    return F.substring(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, most)


def split_name(name: Column) -> Column:
    """The parts of a camelCase, snake_case, kebab-case or dotted name."""
    return F.filter(F.split(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"), r"[_\-.\s]+"), lambda x: x != "")


def mask_log(line: Column) -> Column:
    """A log line with times and IPv4 addresses masked."""
    times = F.regexp_replace(line, r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?Z?", "<time>")
    return F.regexp_replace(times, r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>")


def mask_secret(key: Column, value: Column) -> Column:
    return F.when(F.upper(key).rlike("SECRET|KEY|TOKEN|PASSWORD|CREDENTIAL|AUTH"), "***").otherwise(value)


def line_windows(docs: DataFrame, size: int = 20, step: int = 18) -> DataFrame:
    """(doc_id, part, text): overlapping windows of lines; the last one may be short."""
    lines = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    last = F.greatest(F.ceil((F.size("lines") - size) / step).cast("int"), F.lit(0))
    parts = lines.select("doc_id", "lines", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    return parts.select("doc_id", "part", F.array_join(F.slice("lines", F.col("part") * step + 1, F.lit(size)), "\n").alias("text"))


def head_tail(text: Column, keep: int = 50, above: int = 200) -> Column:
    """A long text's first and last lines around a count of those between."""
    lines = F.split(text, "\n", -1)
    n = F.size(lines)
    middle = F.array(F.format_string("... %d lines omitted ...", n - 2 * keep))
    cut = F.concat(F.slice(lines, 1, keep), middle, F.slice(lines, F.lit(-keep), F.lit(keep)))
    return F.when(n > above, F.array_join(cut, "\n")).otherwise(text)
