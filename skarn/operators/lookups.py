"""Look-ups and listings on the graph, on symbols, on flows and on memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def node(nodes: DataFrame, qualified_name: str) -> DataFrame:
    """The node of a name."""
    return nodes.where(F.col("qualified_name") == qualified_name)


def files_ending(nodes: DataFrame, end: str = "") -> DataFrame:
    """Distinct files, of a suffix if one is given."""
    return nodes.where(F.col("file_path").endswith(end)).select("file_path").distinct()


def nodes_of_kinds(nodes: DataFrame, kinds: list[str], part: str | None = None) -> DataFrame:
    """Nodes of some kinds whose path holds a part, whatever its case."""
    some = nodes.where(F.col("kind").isin(kinds))
    return some if part is None else some.where(F.contains(F.lower("file_path"), F.lit(part.lower())))


def nodes_by_size(nodes: DataFrame, least: int = 50, most: int | None = None, kind: str | None = None, part: str | None = None, n: int = 50) -> DataFrame:
    """The n largest nodes of so many lines (both bounds included), of a kind and a part of a path if given; ties by name."""
    size = F.col("line_end") - F.col("line_start") + 1
    some = nodes.where(size >= least)
    if most is not None:
        some = some.where(size <= most)
    if kind:
        some = some.where(F.col("kind") == kind)
    if part:
        some = some.where(F.contains(F.lower("file_path"), F.lit(part.lower())))
    return some.select("qualified_name", "kind", "file_path", size.alias("n_lines")).orderBy(F.desc("n_lines"), "qualified_name").limit(n)


def signature(kind: Column, name: Column, params: Column, returns: Column) -> Column:
    """`def name(params) -> returns` of functions and tests, `class name` of classes, else the name; 512 characters at most."""
    call = F.concat(F.lit("def "), name, F.lit("("), F.coalesce(params, F.lit("")), F.lit(")"))
    call = F.when(F.coalesce(returns, F.lit("")) != "", F.concat(call, F.lit(" -> "), returns)).otherwise(call)
    text = F.when(kind.isin("Function", "Test"), call).when(kind == "Class", F.concat(F.lit("class "), name)).otherwise(name)
    return F.substring(text, 1, 512)


def sanitised(text: Column, most: int = 256) -> Column:
    """A text without control characters other than tabs and line feeds, cut."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F]", ""), 1, most)


def review_context(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes of the given files (file_path) with the number of calls into each."""
    some = nodes.where(F.col("kind") != "File").join(files.distinct(), "file_path", "left_semi")
    calls = edges.where(F.col("kind") == "CALLS").groupBy(F.col("target").alias("qualified_name")).agg(F.count("*").alias("n"))
    return some.join(calls, "qualified_name", "left").select("file_path", "qualified_name", "kind", F.coalesce("n", F.lit(0)).alias("n_callers"))


def find_symbols(nodes: DataFrame, names: str, exact: bool = False) -> DataFrame:
    """Nodes found by each of some comma-separated names: equal to it, or with it within name or qualified name."""
    asked = nodes.sparkSession.createDataFrame([(x.strip(),) for x in names.split(",") if x.strip()], "asked string").distinct()
    holds = lambda c: F.col(c) == F.col("asked") if exact else F.contains(F.lower(c), F.lower("asked"))
    # The names asked for are a few literals.
    return nodes.join(F.broadcast(asked), holds("name") | holds("qualified_name")).select("asked", "qualified_name", "kind", "file_path")


def symbol_links(edges: DataFrame, name: str, side: str = "target") -> DataFrame:
    """Edges whose end on a side is a symbol, by its whole name or its last part."""
    end = F.col(side)
    return edges.where((end == name) | end.endswith("." + name) | end.endswith("::" + name)).select("kind", "source", "target")


def source_slice(text: Column, first: Column, last: Column) -> Column:
    """The lines of a text from one to another, both included and counted from 1."""
    return F.array_join(F.slice(F.split(text, "\n", -1), F.greatest(first, F.lit(1)), F.greatest(last - F.greatest(first, F.lit(1)) + 1, F.lit(0))), "\n")


def stale(index: DataFrame, listing: DataFrame) -> DataFrame:
    """Indexed files (path, seen_at) that are gone or changed since, by a listing (path, changed_at)."""
    both = index.join(listing, "path", "left")
    return both.where(F.col("changed_at").isNull() | (F.col("changed_at") > F.col("seen_at"))).select("path", F.col("changed_at").isNull().alias("gone"))


def memory_index(observations: DataFrame, n: int = 50, kind: str | None = None) -> DataFrame:
    """Active observations, most important first, then most read, newest, and of least id."""
    some = observations.where(~F.col("archived"))
    if kind:
        some = some.where(F.col("type") == kind)
    order = [F.desc("importance"), F.desc("access_count"), F.desc("created_at"), F.asc("id")]
    return some.orderBy(*order).limit(n).select("id", "type", "title", "importance", "access_count")


def recent(rows: DataFrame, n: int, at: str = "created_at", key: str = "event_id") -> DataFrame:
    """The n newest rows."""
    return rows.orderBy(F.desc(at), F.desc(key)).limit(n)


def flow_list(members: DataFrame, scores: DataFrame, n: int = 50) -> DataFrame:
    """Flows (flow_id, node, depth) with their sizes and criticality, the most critical first."""
    sizes = members.groupBy("flow_id").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("depth"))
    return sizes.join(scores, "flow_id").orderBy(F.desc("criticality"), "flow_id").limit(n)


def flow_steps(members: DataFrame, nodes: DataFrame, flow_id: str) -> DataFrame:
    """A flow's nodes in the order of depth and name."""
    info = nodes.select(F.col("qualified_name").alias("node"), "name", "kind", "file_path")
    return members.where(F.col("flow_id") == flow_id).join(info, "node").select("depth", "node", "name", "kind", "file_path")


def flows_of_nodes(members: DataFrame) -> DataFrame:
    """How many flows each node is in."""
    return members.groupBy("node").agg(F.count_distinct("flow_id").alias("n_flows"))


def flows_through(members: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Ids of the flows that have a node of the given files."""
    some = nodes.join(files.distinct(), "file_path", "left_semi").select(F.col("qualified_name").alias("node"))
    return members.join(some, "node", "left_semi").select("flow_id").distinct()


def communities(nodes: DataFrame, least: int = 0) -> DataFrame:
    """Communities of at least so many nodes: size, files, and the commonest language (ties to the least)."""
    some = nodes.where(F.col("community_id").isNotNull())
    sizes = some.groupBy("community_id").agg(F.count("*").alias("size"), F.count_distinct("file_path").alias("n_files")).where(F.col("size") >= least)
    spoken = some.where(F.col("language") != "").groupBy("community_id", "language").agg(F.count("*").alias("n"))
    top = spoken.groupBy("community_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "language")).alias("m")).select("community_id", F.col("m.language").alias("language"))
    return sizes.join(top, "community_id", "left")


def members_of(nodes: DataFrame, communities_: list[int]) -> DataFrame:
    """The nodes of some communities."""
    return nodes.where(F.col("community_id").isin(communities_)).select("community_id", "qualified_name")


# Flags of search commands that take the next word.
VALUE_FLAGS = [
    "-e", "-f", "-m", "-A", "-B", "-C", "-g", "--glob", "-t", "--type", "--include", "--exclude", "--max-count", "--max-depth", "--max-filesize",
    "--color", "--colors", "--context-separator", "--field-match-separator", "--path-separator", "--replace", "--sort", "--sortr",
]


def searched_pattern(tool: Column, pattern: Column, command: Column) -> Column:
    """What a tool call searches for: a search's pattern, the name in a glob, or a search command's first word of three letters.

    Of a command's words those after the search command count, without flags and the words that flags take.
    """
    globbed = F.nullif(F.regexp_extract(pattern, r"[*/]([a-zA-Z][a-zA-Z0-9_]{2,})", 1), F.lit(""))
    flags = "|".join(f.replace("-", r"\-") for f in VALUE_FLAGS)
    after = F.regexp_extract(command, r"^(?:.*?\s)?\S*\b(?:rg|grep)\s+(.*)$", 1)
    bare = F.regexp_replace(after, rf"^(?:(?:(?:{flags})\s+\S+|-\S*)(?:\s+|$))+", "")
    word = F.regexp_replace(F.regexp_extract(bare, r"^(\S+)", 1), r"^['\"]+|['\"]+$", "")
    return F.when(tool == "Grep", pattern).when(tool == "Glob", globbed).when((tool == "Bash") & (F.length(word) >= 3), word)


def metadata(pairs: DataFrame) -> DataFrame:
    """The latest value of each key, of rows (key, value, at)."""
    return pairs.groupBy("key").agg(F.max(F.struct("at", "value")).alias("m")).select("key", F.col("m.value").alias("value"))


def enriched(nodes: DataFrame, edges: DataFrame, part: str, n: int = 5, most: int = 5) -> DataFrame:
    """The first n symbols that are no tests and have a part in their name, with callers and callees, at most so many of each."""
    some = nodes.where(~F.col("is_test") & (F.col("kind") != "File") & F.contains(F.lower("name"), F.lit(part.lower()))).orderBy("qualified_name").limit(n)
    calls = edges.where(F.col("kind") == "CALLS")

    def ends(own: str, other: str, name: str) -> DataFrame:
        found = calls.join(F.broadcast(some.select(F.col("qualified_name").alias(own))), own)  # n rows
        least = found.withColumn("k", F.row_number().over(Window.partitionBy(own).orderBy(other))).where(F.col("k") <= most)
        return least.groupBy(F.col(own).alias("qualified_name")).agg(F.array_join(F.array_sort(F.collect_list(other)), ",").alias(name))

    out = some.select("qualified_name", "name", "community_id").join(ends("target", "source", "callers"), "qualified_name", "left").join(ends("source", "target", "callees"), "qualified_name", "left")
    return out.select("qualified_name", "name", "community_id", F.coalesce("callers", F.lit("")).alias("callers"), F.coalesce("callees", F.lit("")).alias("callees"))
