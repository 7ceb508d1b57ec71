"""Calls of methods through variables: what a receiver is, by the scopes around a call, and where its method is defined.

Lines are read by patterns; everything else is joins.  A call's scopes are those around it, from the
innermost out; the innermost that binds the receiver's name decides, whatever it binds it to.  A class's
methods are its own and those of its bases, nearest first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import enclosing
from .scratch import Scratch

# An assignment of a new object, names with types, and a call through a lower-case name.
ASSIGNED = r"^\s*([A-Za-z_]\w*)\s*(?::\s*[\w.\[\]\"', |]+)?=\s*(?:await\s+)?(?:[a-z_]\w*\.)*([A-Z]\w*)\("
REBOUND = r"^\s*([A-Za-z_]\w*)\s*=(?!=)"
TYPED = r"\b([a-z_]\w*)\s*:\s*[\"']?(?:[a-z_]\w*\.)*([A-Z]\w*)"
CALLED = r"(?<![\w.])([a-z_]\w*)\.([A-Za-z_]\w*)\s*\("


def bound_names(lines: DataFrame) -> DataFrame:
    """(file_path, line, name, type): what lines (file_path, line, text) bind names to; a null type is not known.

    Parameters and variables with a type count, as do assignments of new objects; an assignment of
    anything else binds the name to what isn't known.
    """
    typed = F.transform(F.regexp_extract_all("text", F.lit(TYPED), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, TYPED, 1).alias("name"), F.regexp_extract(x, TYPED, 2).alias("type")))
    new = F.when(F.col("text").rlike(ASSIGNED), F.array(F.struct(F.regexp_extract("text", ASSIGNED, 1).alias("name"), F.regexp_extract("text", ASSIGNED, 2).alias("type"))))
    other = F.when(F.col("text").rlike(REBOUND), F.array(F.struct(F.regexp_extract("text", REBOUND, 1).alias("name"), F.lit(None).cast("string").alias("type"))))
    has_types = F.col("text").rlike(r"^\s*(?:async\s+)?def\s|^\s*[a-z_]\w*\s*:\s*")
    found = F.coalesce(new, F.when(has_types & (F.size(typed) > 0), typed), other)
    return lines.select("file_path", "line", F.explode(found).alias("b")).select("file_path", "line", "b.name", "b.type")


def method_calls(lines: DataFrame) -> DataFrame:
    """(file_path, line, receiver, method): calls through names, but for self and cls."""
    found = F.transform(F.regexp_extract_all("text", F.lit(CALLED), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, CALLED, 1).alias("receiver"), F.regexp_extract(x, CALLED, 2).alias("method")))
    each = lines.select("file_path", "line", F.explode(found).alias("c")).select("file_path", "line", "c.receiver", "c.method")
    return each.where(~F.col("receiver").isin("self", "cls"))


def _above(rows: DataFrame, child: str, parent: str, scratch: Scratch) -> DataFrame:
    """(child, above, up): each with itself and all above it, by the least number of steps; rings end."""
    steps = scratch.keep(rows.select(F.col(child).alias("child"), F.col(parent).alias("parent")).where("parent is not null").distinct())
    own = rows.select(F.col(child).alias("child")).unionAll(rows.select(F.col(parent))).where("child is not null").distinct()
    frontier = scratch.keep(own.select("child", F.col("child").alias("above"), F.lit(0).alias("up")))
    seen, up = frontier, 0
    while not frontier.isEmpty():
        up += 1
        found = frontier.join(steps.select(F.col("child").alias("above"), "parent"), "above").select("child", F.col("parent").alias("above")).distinct()
        frontier = scratch.keep(found.join(seen.select("child", "above"), ["child", "above"], "left_anti").withColumn("up", F.lit(up)))
        seen = seen.unionByName(frontier)
    return scratch.keep(seen)


def resolve_receivers(lines: DataFrame, scopes: DataFrame, types: DataFrame, bases: DataFrame, methods: DataFrame, known: DataFrame) -> DataFrame:
    """(file_path, line, receiver, method, source, target, outcome): each call through a name, and what came of it.

    `lines` (file_path, line, text); `scopes` (qualified_name, file_path, kind, line_start, line_end,
    parent): functions and classes, and a File for the rest of a file; `types` (file_path, name,
    class): what a type's name means in a file; `bases` (class, base, place); `methods` (class,
    method, target); `known` (source, line): calls there already are.

    Outcome is `new` where the call gives an edge from the innermost function (or file) around it,
    `known` where there is one at its line, and else what is missing: `method` (no class has one of
    that name), `receiver` (no scope binds it, or not before the call), `type` (what it is bound to
    is no known class) or `member` (the class and its bases don't have it).
    """
    scratch = Scratch(lines.sparkSession)
    keep = scratch.keep
    calls = keep(method_calls(lines).distinct())
    bound = keep(bound_names(lines))
    points = calls.select("file_path", "line").unionAll(bound.select("file_path", "line")).distinct()
    # The text of a def's line belongs to the function it begins, as its parameters do; what is in none, to the file.
    inner = enclosing(scopes, points)
    whole = scopes.where("kind = 'File'").select("file_path", F.col("qualified_name").alias("file_scope"))
    around = keep(points.join(inner, ["file_path", "line"], "left").join(whole, "file_path", "left").select("file_path", "line", F.coalesce("qualified_name", "file_scope").alias("scope")))
    above = _above(scopes, "qualified_name", "parent", scratch)
    kinds = scopes.select(F.col("qualified_name").alias("above"), F.col("kind").alias("above_kind"))
    # Names of a class's body can't be seen from the functions in it.
    seen_from = above.join(kinds, "above").where("up = 0 or above_kind <> 'Class'").select(F.col("child").alias("scope"), "above", "up")
    told = calls.join(methods.select("method").distinct().withColumn("is_method", F.lit(True)), "method", "left").join(around, ["file_path", "line"], "left")
    told = keep(told.withColumn("call", F.monotonically_increasing_id()))
    names = bound.join(around, ["file_path", "line"]).select(F.col("scope").alias("above"), F.col("name").alias("receiver"), F.col("line").alias("at"), "type")
    ways = told.where("is_method").select("call", "scope", "receiver", "line").join(seen_from, "scope").join(names, ["above", "receiver"])
    inner = ways.withColumn("nearest", F.min("up").over(Window.partitionBy("call"))).where("up = nearest")
    last = inner.where("up > 0 or at <= line").groupBy("call").agg(F.max(F.struct("at", F.col("type").isNotNull().alias("has"), "type")).alias("m")).select("call", F.lit(True).alias("is_bound"), F.col("m.type").alias("name"))
    given = told.join(last, "call", "left").join(types.groupBy("file_path", "name").agg(F.min("class").alias("class")), ["file_path", "name"], "left")
    lineage = _above(bases.select("class", "base"), "class", "base", scratch).select(F.col("child").alias("class"), F.col("above").alias("owner"), "up")
    # What a class has of its bases is settled once a class, so that calls don't meet all classes above theirs.
    alone = methods.select("class").distinct().join(lineage, "class", "left_anti").select("class", F.col("class").alias("owner"), F.lit(0).alias("up"))
    owned = lineage.unionByName(alone).join(methods.select(F.col("class").alias("owner"), "method", "target"), "owner")
    members = keep(owned.groupBy("class", "method").agg(F.min(F.struct("up", "owner", "target")).alias("m")).select("class", "method", "m.target"))
    out = given.join(members, ["class", "method"], "left")
    there = known.select(F.col("source").alias("scope"), "line", F.lit(True).alias("there")).distinct()
    out = out.join(there, ["scope", "line"], "left")
    outcome = (
        F.when(F.col("is_method").isNull(), "method").when(F.col("is_bound").isNull(), "receiver").when(F.col("class").isNull(), "type")
        .when(F.col("target").isNull(), "member").when(F.col("there"), "known").otherwise("new")
    )
    return scratch.result(out.select("file_path", "line", "receiver", "method", F.col("scope").alias("source"), "target", outcome.alias("outcome")))
