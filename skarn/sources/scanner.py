"""Modules of brace languages without a grammar: comments and texts blanked, braces counted, blocks matched.

A file's lines are folded with the lexer's state (in code, a string, a template or a comment, and how
deep comments are nested), and a line's pieces within it: runs of plain characters are one piece, and each
character that may mean something is one.  What the folds leave has as many characters and lines as
before.  Blocks are matched by windows over each file's braces: of those on one level, an opening
one's next is its closing one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let

CODE, STRING, TEMPLATE, COMMENT, LINE_COMMENT = range(5)
PIECES = r"""[^/*"`\\]+|[/*"`\\]"""
# How a module begins, up to its brace, and the words that another definition begins with.
HEADER = r"^[ \t]*module\s+(?:type\s+)?[A-Z][\w']*\s*[:=](?!\s*[A-Z][\w']*(?:\.[A-Za-z_][\w']*)*\s*$)(?:(?!(?<=\s)(?:let|type|module|external|and)\s)[^{])*\{"
NAME = r"^\s*module\s+(?:type\s+)?([A-Z][\w']*)"


def _blank(piece: Column) -> Column:
    return F.repeat(F.lit(" "), F.length(piece))


def blanked(text: Column) -> Column:
    """A text whose comments (nested ones too) and the insides of strings and templates are blanks; quotes and lines stay."""

    def step(s: Column, p: Column) -> Column:
        this, then, mode = p["this"], p["then"], s["mode"]
        put = lambda out, mode=mode, depth=s["depth"], skip=F.lit(False): F.struct(mode.alias("mode"), depth.alias("depth"), skip.alias("skip"), F.concat(s["out"], out).alias("out"))
        sign, is_ = then.isin("/", "*", '"', "`", "\\"), lambda a, b: (this == a) & (then == b)
        code = (
            F.when(is_("/", "/"), put(F.lit(" "), F.lit(LINE_COMMENT))).when(is_("/", "*"), put(F.lit(" "), F.lit(COMMENT), F.lit(1), F.lit(True)))
            .when(this == '"', put(this, F.lit(STRING))).when(this == "`", put(this, F.lit(TEMPLATE))).otherwise(put(this))
        )
        string = F.when(this == '"', put(this, F.lit(CODE))).when(this == "\\", put(F.lit(" "), skip=F.coalesce(sign, F.lit(False)))).otherwise(put(_blank(this)))
        template = F.when(this == "`", put(this, F.lit(CODE))).otherwise(put(_blank(this)))
        closed = F.when(s["depth"] == 1, F.lit(CODE)).otherwise(F.lit(COMMENT))
        comment = (
            F.when(is_("/", "*"), put(F.lit(" "), depth=s["depth"] + 1, skip=F.lit(True)))
            .when(is_("*", "/"), put(F.lit(" "), closed, s["depth"] - 1, F.lit(True))).otherwise(put(_blank(this)))
        )
        return (
            F.when(s["skip"], put(_blank(this))).when(mode == CODE, code).when(mode == STRING, string).when(mode == TEMPLATE, template).when(mode == COMMENT, comment).otherwise(put(_blank(this)))
        )

    def line_step(s: Column, line: Column) -> Column:
        def folded(pieces: Column) -> Column:
            pairs = F.transform(pieces, lambda x, i: F.struct(x.alias("this"), F.coalesce(F.get(pieces, i + 1), F.lit("")).alias("then")))
            start = F.struct(s["mode"].alias("mode"), s["depth"].alias("depth"), F.lit(False).alias("skip"), F.lit("").alias("out"))
            return F.aggregate(pairs, start, step)

        def after(r: Column) -> Column:
            mode = F.when(r["mode"] == LINE_COMMENT, CODE).otherwise(r["mode"])
            return F.struct(mode.alias("mode"), r["depth"].alias("depth"), F.concat(s["lines"], F.array(r["out"])).alias("lines"))

        return let(let(F.regexp_extract_all(line, F.lit(PIECES), F.lit(0)), folded), after)

    start = F.struct(F.lit(CODE).alias("mode"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("lines"))
    return F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n", -1), start, line_step, lambda s: F.array_join(s["lines"], "\n"))


def modules(files: DataFrame) -> DataFrame:
    """(file_path, name, line_start, line_end, parent): the module blocks of files (file_path, text), with the module around each.

    A module without a closing brace ends with its file; aliases, and headers whose brace belongs to
    another definition, are none; null texts have none.  Files of one path are one another's text.
    """
    clean = files.select("file_path", blanked(F.col("text")).alias("text"))
    found = clean.select("file_path", F.posexplode(F.regexp_extract_all("text", F.lit("(?m)" + HEADER + r"|[{}\n]"), F.lit(0))).alias("i", "it"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("last"))
    newlines = F.length("it") - F.length(F.replace("it", F.lit("\n"), F.lit("")))
    opens, closes = F.col("it").endswith("{"), F.col("it") == "}"
    before = Window.partitionBy("file_path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(before), F.lit(0))
    line = F.coalesce(F.sum(newlines).over(before), F.lit(0)) + 1
    level = F.when(closes, F.col("depth") - 1).otherwise(F.col("depth"))
    braces = found.withColumns({"depth": depth, "line": line}).where(opens | closes).withColumn("level", level)
    at_level = Window.partitionBy("file_path", "level").orderBy("i")
    matched = braces.withColumns({"close": F.lead("i").over(at_level), "close_line": F.lead("line").over(at_level)}).where(F.col("it").rlike(NAME))
    own = matched.select(
        "file_path", F.regexp_extract("it", NAME, 1).alias("name"), F.col("line").cast("int").alias("line_start"), F.coalesce("close_line", "last").cast("int").alias("line_end"),
        "i", F.coalesce("close", F.lit(2**31 - 1)).alias("close"),
    )
    around = own.select("file_path", F.col("name").alias("outer"), F.col("i").alias("from"), F.col("close").alias("to"))
    inside = own.join(around, "file_path").where("from < i and to > close or from < i and to = close and to = 2147483647")
    parents = inside.groupBy("file_path", "i").agg(F.max(F.struct("from", "outer")).alias("m")).select("file_path", "i", F.col("m.outer").alias("parent"))
    return own.join(parents, ["file_path", "i"], "left").select("file_path", "name", "line_start", "line_end", "parent")
