"""Breaking changes between two versions of symbols, and backward slices of programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def breaking_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, symbol, change, severity): what callers of the old symbols may break on.

    Symbols are (path, symbol, kind, owner, params, n_defaults, returns, bases): kind is function,
    method or class, owner a method's class.  Removed symbols, changed bases, removed parameters,
    new parameters without a default and changed return types count; a method of a removed class is
    removed with it.
    """
    keys = ["path", "symbol"]
    after = new.select(*keys, *[F.col(c).alias("new_" + c) for c in ("kind", "params", "n_defaults", "returns", "bases")])
    both = old.join(after, keys, "left")
    gone = F.col("new_kind").isNull()
    callable_ = ~gone & F.col("kind").isin("function", "method")
    required = lambda prefix: F.size(prefix + "params") - F.col(prefix + "n_defaults")
    rules = [
        ("removed_method", "high", gone & (F.col("kind") == "method")),
        ("removed_function", "high", gone & (F.col("kind") != "method")),
        ("changed_bases", "high", ~gone & (F.col("kind") == "class") & ~F.col("bases").eqNullSafe(F.col("new_bases"))),
        ("removed_parameter", "high", callable_ & (F.size(F.array_except("params", "new_params")) > 0)),
        ("added_required_param", "high", callable_ & (F.size(F.array_except("new_params", "params")) > 0) & (required("new_") > required(""))),
        ("changed_signature", "medium", callable_ & (F.col("returns") != F.col("new_returns"))),
    ]
    found = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(name).alias("change"), F.lit(severity).alias("severity"))) for name, severity, rule in rules]))
    return both.select(*keys, F.inline(found))


def severities(changes: DataFrame) -> DataFrame:
    """Counts of changes by severity and kind."""
    return changes.groupBy("severity", "change").agg(F.count("*").alias("n"))


def backward_slice(definitions: DataFrame, targets: DataFrame, settle) -> DataFrame:
    """(path, line): the lines that a variable's value at a line depends on.

    `definitions` has (path, line, variable, used): a line that sets a variable and the array of
    variables it uses.  `targets` has (path, line, variable).  Each round takes the definitions, up
    to the target's line, of the variables that the last round reached, until none is new, however long the chain is.
    """
    wanted = targets.select("path", F.col("line").alias("upto"), "variable")
    seen = frontier = settle(wanted.distinct())
    lines = None
    while True:
        hit = definitions.join(frontier, ["path", "variable"]).where(F.col("line") <= F.col("upto"))
        found = settle(hit.select("path", "upto", "line", "used"))
        lines = found.select("path", "line") if lines is None else lines.unionByName(found.select("path", "line"))
        more = found.select("path", "upto", F.explode("used").alias("variable")).distinct()
        frontier = settle(more.join(seen, ["path", "upto", "variable"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select(*seen.columns))
    return lines.distinct()
