"""Files as tables: scans, routing, symbols of Python sources and unified diffs."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What is never read, and the pipelines by extension.
IGNORED_DIRS = [
    ".git", "node_modules", "__pycache__", ".tox", ".venv", "venv", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", ".next", ".nuxt",
]
IGNORED_ENDS = [".pyc", ".pyo", ".so", ".dylib", ".dll", ".exe", ".whl", ".egg", ".lock", ".map"]
PIPELINES = {
    "code": [
        ".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".go", ".rs", ".java", ".cs", ".rb", ".php", ".kt", ".kts", ".swift", ".scala", ".sol", ".dart",
        ".r", ".pl", ".pm", ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".vue", ".svelte", ".lua", ".zig", ".ps1", ".ex", ".exs", ".gd", ".jl",
        ".ipynb", ".sh", ".bash", ".zsh", ".ksh",
    ],
    "document": [".md", ".mdx", ".txt", ".rst", ".html"],
    "pdf": [".pdf"],
    "image": [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg"],
    "office": [".docx", ".xlsx"],
    "video": [".mp4", ".mov", ".avi", ".webm", ".mkv", ".mp3", ".wav", ".m4a"],
    "config": [".yaml", ".yml", ".toml", ".json"],
}


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified, content) of files below a folder, without ignored ones and what is in dot folders or dot files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace("path", "^.*?" + re.escape(root.split("://")[-1].rstrip("/")) + "/", "/")
    hidden = below.rlike(r"/\.[^/]+(?:/|$)")
    inside = below.rlike("/(?:" + "|".join(d.replace(".", r"\.") for d in IGNORED_DIRS) + ")/")
    ends = F.lower("path").rlike("(?:" + "|".join(e.replace(".", r"\.") for e in IGNORED_ENDS) + ")$")
    return rows.where(~hidden & ~inside & ~ends).select("path", "length", F.col("modificationTime").alias("modified"), "content")


def is_binary(content: Column) -> Column:
    """Whether a NUL byte is in the first 8,192 bytes."""
    return F.contains(F.decode(F.substring(content, 1, 8192), "ISO-8859-1"), F.lit("\0"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def route(path: Column, head: Column | None = None) -> Column:
    """The pipeline of a path; API descriptions are told by the head of JSON and YAML; unknown ones are documents."""
    ext, out = extension(path), F.lit("document")
    for name, ends in PIPELINES.items():
        out = F.when(ext.isin(ends), name).otherwise(out)
    if head is not None:
        api = ext.isin(".json", ".yaml", ".yml") & F.lower(F.substring(head, 1, 2048)).rlike("openapi|swagger")
        out = F.when(api, "api_spec").otherwise(out)
    return out


SYMBOLS = "path string, kind string, name string, qualified_name string, line_start int, line_end int, params string, calls array<string>, bases array<string>, decorators array<string>"


def _symbols(path: str, source: str) -> Iterator[tuple]:
    def dotted(node: ast.AST) -> str:
        return ast.unparse(node).split("(")[0]

    def walk(body: list, owner: str | None) -> Iterator[tuple]:
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = f"{owner}.{node.name}" if owner else node.name
                cls = isinstance(node, ast.ClassDef)
                called = [] if cls else sorted({dotted(x.func) for x in ast.walk(node) if isinstance(x, ast.Call)})
                test = not cls and node.name.startswith("test_")
                yield (
                    path, "Class" if cls else "Test" if test else "Function", node.name, f"{path}::{name}", node.lineno, node.end_lineno,
                    None if cls else ast.unparse(node.args), called, [dotted(b) for b in node.bases] if cls else [], [dotted(d) for d in node.decorator_list],
                )
                if cls:
                    yield from walk(node.body, name)

    yield from walk(ast.parse(source).body, None)


def python_symbols(files: DataFrame) -> DataFrame:
    """Classes, functions and tests of Python sources (path, content), with calls, bases and decorators.

    Sources that do not parse give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SYMBOLS.split(", ")]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += _symbols(path, bytes(content).decode("utf-8", "replace"))
                except (SyntaxError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=names)

    return files.where(F.col("path").endswith(".py")).select("path", "content").mapInPandas(run, SYMBOLS)


def symbol_edges(symbols: DataFrame) -> DataFrame:
    """(kind, source, target): calls within a file, inheritance, and tests of what they call (production to test)."""
    own = symbols.select("path", F.col("name").alias("called"), F.col("qualified_name").alias("target"), F.col("line_start").alias("at"))
    own = own.groupBy("path", "called").agg(F.min(F.struct("at", "target")).alias("m")).select("path", "called", F.col("m.target").alias("target"))
    calls = symbols.select("path", "kind", F.col("qualified_name").alias("source"), F.explode("calls").alias("c"))
    calls = calls.withColumn("called", F.substring_index("c", ".", -1)).join(own, ["path", "called"]).select("kind", "source", "target").distinct()
    bases = symbols.select("path", F.col("qualified_name").alias("source"), F.explode("bases").alias("called")).join(own, ["path", "called"])
    return (
        calls.select(F.lit("CALLS").alias("kind"), "source", "target")
        .unionAll(bases.select(F.lit("INHERITS"), "source", "target").distinct())
        .unionAll(calls.where(F.col("kind") == "Test").select(F.lit("TESTED_BY"), F.col("target"), F.col("source")))
    )


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """(file_path, start, stop) of the new sides of unified diffs (text); an empty side is one place."""
    from pyspark.sql import Window

    lines = diffs.withColumn("d", F.monotonically_increasing_id()).select("d", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    file = F.when(F.col("line").startswith("+++ "), F.regexp_extract("line", r"^\+\+\+ (?:b/)?(\S+)", 1))
    named = lines.withColumn("file_path", F.last(file, ignorenulls=True).over(Window.partitionBy("d").orderBy("n")))
    hunk = named.where(F.col("line").startswith("@@")).withColumns(
        {"start": F.regexp_extract("line", r"\+(\d+)", 1).cast("int"), "size": F.regexp_extract("line", r"\+\d+,(\d+)", 1)}
    )
    size = F.when(F.col("size") == "", 1).otherwise(F.try_to_number("size", F.lit("999999")).cast("int"))
    return hunk.select("file_path", "start", (F.col("start") + F.greatest(size - 1, F.lit(0))).alias("stop"))
