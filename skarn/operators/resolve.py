"""Resolution of names: bare calls, module names, path suffixes, dependencies in texts, renames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_bare_calls(calls: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls (call_id, file_path, name) of a bare name with the one node that it means.

    That is the only callable node of the name, or else the only one in a file that the calling
    file imports (imports: file_path, imported).  Other calls are left out.
    """
    callable_ = nodes.where(F.col("kind").isin("Function", "Test", "Class")).select("name", F.col("qualified_name").alias("target"), F.col("file_path").alias("defined_in"))
    sizes = callable_.groupBy("name").agg(F.count("*").alias("n"), F.min("target").alias("only"))
    known = calls.join(sizes, "name")
    sure = known.where("n = 1").select("call_id", "name", F.col("only").alias("target"))
    brought = imports.select("file_path", F.col("imported").alias("defined_in")).distinct()
    # Calls and nodes of a name never meet one by one: each file's names are settled once, from counts by name and file.
    several = known.where("n > 1").select("call_id", "name", "file_path")
    per_file = callable_.groupBy("name", "defined_in").agg(F.count("*").alias("n"), F.min("target").alias("target"))
    reached = several.select("name", "file_path").distinct().join(brought, "file_path").join(per_file, ["name", "defined_in"])
    meant = reached.groupBy("name", "file_path").agg(F.sum("n").alias("n"), F.min("target").alias("target"))
    one = several.join(meant, ["name", "file_path"]).groupBy("call_id", "name").agg(F.sum("n").alias("n"), F.min("target").alias("target")).where("n = 1")
    return sure.unionByName(one.select("call_id", "name", "target"))


def peeled(targets: DataFrame, modules: DataFrame) -> DataFrame:
    """Dotted targets (target) with the longest leading part that is a module (module, file_path), and the rest."""
    parts = F.split("target", r"\.")
    heads = targets.select("target", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"))
    heads = heads.select("target", "k", F.array_join(F.slice(F.split("target", r"\."), F.lit(1), F.col("k")), ".").alias("module"))
    found = heads.join(modules, "module").groupBy("target").agg(F.max(F.struct("k", "module", "file_path")).alias("m"))
    rest = F.expr("array_join(slice(split(target, '[.]'), m.k + 1, size(split(target, '[.]'))), '.')")
    return found.select("target", F.col("m.module").alias("module"), F.col("m.file_path").alias("file_path"), rest.alias("rest"))


def path_suffixes(files: DataFrame) -> DataFrame:
    """(suffix, file_path): every trailing part of a path, down to the file's name."""
    parts = F.split("file_path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return files.select("file_path", F.explode(tails).alias("suffix")).where("suffix <> ''").select("suffix", "file_path").distinct()


def resolve_suffix(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """References (source_file, suffix) with a file: the only one, the one nearest to the source, or the first.

    Nearest means in the same folder; if that leaves several, the least path.
    """
    found = wanted.join(path_suffixes(files), "suffix")
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    near = (folder("file_path") == folder("source_file")).cast("int")
    best = found.groupBy("source_file", "suffix").agg(F.min(F.struct((-near).alias("far"), "file_path")).alias("m"), F.count("*").alias("n_candidates"))
    return best.select("source_file", "suffix", F.col("m.file_path").alias("file_path"), "n_candidates")


# Calls that name no symbol of a project.
BUILTINS = [
    "if", "for", "while", "return", "print", "len", "range", "str", "int", "float", "list", "dict", "set", "tuple", "type", "isinstance", "super",
    "open", "not", "and", "or", "in", "is", "with", "assert", "lambda", "def", "class",
]


def called_names(sources: DataFrame, known: DataFrame) -> DataFrame:
    """(id, name): words before a parenthesis in sources (id, text) that are known names (name), built-ins aside."""
    words = sources.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)))).alias("name"))
    return words.where(~F.col("name").isin(BUILTINS)).join(known.select("name").distinct(), "name", "left_semi").select("id", "name")


def type_names(texts: DataFrame) -> DataFrame:
    """Distinct capitalised identifiers of texts (text)."""
    return texts.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Z][A-Za-z0-9_]*"), F.lit(0))).alias("name")).distinct()


def whole_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes, one of each pair of ends: the last by kind."""
    ends = nodes.select("qualified_name")
    both = edges.join(ends.withColumnRenamed("qualified_name", "source"), "source", "left_semi").join(ends.withColumnRenamed("qualified_name", "target"), "target", "left_semi")
    return both.groupBy("source", "target").agg(F.max("kind").alias("kind"))


def rename_preview(nodes: DataFrame, edges: DataFrame, old: str, new: str) -> DataFrame:
    """Places to edit for a rename: the definition, then calls and imports of it; one row a file and what is there."""
    own = nodes.where(F.col("name") == old).select("qualified_name", "file_path", F.col("line_start").alias("line"))
    places = own.select("file_path", "qualified_name", F.lit("definition").alias("what"))
    users = edges.where(F.col("kind").isin("CALLS", "DEPENDS_ON", "TESTED_BY")).join(own.select(F.col("qualified_name").alias("target")), "target")
    at = nodes.select(F.col("qualified_name").alias("source"), "file_path")
    uses = users.join(at, "source").select("file_path", F.col("source").alias("qualified_name"), F.lower("kind").alias("what"))
    return places.unionByName(uses).distinct().withColumns({"old": F.lit(old), "new": F.lit(new)})


def resolve_repository(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """Names (wanted, cwd) with a registered path: by alias, else by path, else the deepest that holds the working folder."""
    r = registry.select("alias", "path")
    by_alias = wanted.join(r.select(F.col("alias").alias("wanted"), F.col("path").alias("p1")).groupBy("wanted").agg(F.min("p1").alias("p1")), "wanted", "left")
    by_path = by_alias.join(r.select(F.col("path").alias("wanted"), F.col("path").alias("p2")).distinct(), "wanted", "left")
    # The working folder's own ancestors are its candidates, so the join is by equality.
    tails = F.transform(F.sequence(F.lit(1), F.size(F.split("cwd", "/"))), lambda i: F.array_join(F.slice(F.split("cwd", "/"), F.lit(1), i), "/"))
    above = wanted.select("wanted", "cwd", F.explode(tails).alias("path")).join(r.select("path").distinct(), "path")
    deepest = above.groupBy("wanted", "cwd").agg(F.max(F.struct(F.length("path").alias("n"), "path")).alias("m")).select("wanted", "cwd", F.col("m.path").alias("p3"))
    return by_path.join(deepest, ["wanted", "cwd"], "left").select("wanted", "cwd", F.coalesce("p1", "p2", "p3").alias("path"))


def knowledge_gaps(nodes: DataFrame, edges: DataFrame, below: float = 0.5) -> DataFrame:
    """(gap, qualified_name): nodes without any edge, and nodes of low confidence."""
    ends = edges.select(F.col("source").alias("qualified_name")).unionAll(edges.select("target")).distinct()
    alone = nodes.join(ends, "qualified_name", "left_anti").select(F.lit("isolate").alias("gap"), "qualified_name")
    return alone.unionAll(nodes.where(F.col("confidence_score") < below).select(F.lit("low_confidence"), "qualified_name"))


def graph_changes(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Counts of nodes and edges that came and went, and of common nodes that changed community."""
    (n0, e0), (n1, e1) = before, after
    community = lambda n, name: n.select("qualified_name", F.coalesce("community_id", F.lit(-1)).alias(name))
    nodes = community(n0, "a").join(community(n1, "b"), "qualified_name", "full_outer")
    end = lambda e, flag: e.select("kind", "source", "target").distinct().withColumn(flag, F.lit(True))
    edges = end(e0, "a").join(end(e1, "b"), ["kind", "source", "target"], "full_outer")
    counted = nodes.agg(
        F.count_if(F.col("a").isNull()).alias("nodes_added"), F.count_if(F.col("b").isNull()).alias("nodes_removed"), F.count_if(F.col("a") != F.col("b")).alias("community_moves")
    )
    return counted.join(edges.agg(F.count_if(F.col("a").isNull()).alias("edges_added"), F.count_if(F.col("b").isNull()).alias("edges_removed")))  # one row each


def super_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph of communities: (first, second, n_edges) of unordered pairs and (first, first, n_nodes) of each, -1 for nodes without one."""
    c = nodes.select("qualified_name", F.coalesce("community_id", F.lit(-1)).alias("c"))
    e = edges.join(c.select(F.col("qualified_name").alias("source"), F.col("c").alias("a")), "source")
    e = e.join(c.select(F.col("qualified_name").alias("target"), F.col("c").alias("b")), "target").where("a <> b")
    pairs = e.groupBy(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second")).agg(F.count("*").alias("n"))
    return c.groupBy(F.col("c").alias("first"), F.col("c").alias("second")).agg(F.count("*").alias("n")).unionByName(pairs)


def touched_communities(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """How many communities the given files touch, and whether they must be found anew."""
    some = nodes.join(files.distinct(), "file_path", "left_semi")
    n = F.count_distinct("community_id")
    return some.agg(n.alias("n_communities"), (n > 0).alias("rerun"))


def suggested_questions(nodes: DataFrame, edges: DataFrame, hubs: DataFrame, surprises: DataFrame, hotspots: DataFrame) -> DataFrame:
    """Review questions (category, target, priority) from hubs without tests, edges across communities, thin communities and hotspots."""
    tested = edges.where(F.col("kind") == "TESTED_BY").select(F.col("source").alias("node")).distinct()
    row = lambda df, category, target, priority: df.select(F.lit(category).alias("category"), target.cast("string").alias("target"), F.lit(priority).alias("priority"))
    c = nodes.select("qualified_name", "community_id")
    across = surprises.join(c.select(F.col("qualified_name").alias("source"), F.col("community_id").alias("a")), "source")
    across = across.join(c.select(F.col("qualified_name").alias("target"), F.col("community_id").alias("b")), "target").where("a <> b")
    thin = nodes.where(F.col("community_id").isNotNull()).groupBy("community_id").agg(F.count("*").alias("n")).where("n < 3")
    return (
        row(hubs.join(tested, "node", "left_anti"), "hub_risk", F.col("node"), "high")
        .unionAll(row(across, "surprising_connection", F.col("source"), "medium"))
        .unionAll(row(thin, "thin_community", F.concat(F.lit("community:"), F.col("community_id").cast("string")), "low"))
        .unionAll(row(hotspots, "untested_hotspot", F.col("node"), "medium"))
    )


def ranked_filters(runs: DataFrame, matches: DataFrame) -> DataFrame:
    """Matching filters (command_id, filter) of each command, the best saving on average first; those never run come last."""
    mean = runs.groupBy("filter").agg(F.round(F.avg("savings_pct"), 4).alias("avg_pct"))
    order = Window.partitionBy("command_id").orderBy(F.desc(F.coalesce("avg_pct", F.lit(0.0))), "filter")
    return matches.join(mean, "filter", "left").withColumn("place", F.row_number().over(order)).select("command_id", "filter", "place")
