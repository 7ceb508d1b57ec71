"""Writers and exports of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_by_key(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """`current` without the keys that `incoming` has, and `incoming`: replacement by file, idempotent."""
    gone = incoming.select(key).distinct()
    return current.join(gone, key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of greatest `version` for each key; ties go to the whole row's order."""
    both = current.unionByName(incoming, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, version)]
    return both.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("m")).select(*keys, "m.*")


def escape_xml(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml_nodes(nodes: DataFrame) -> DataFrame:
    """One `value` a node: its GraphML element."""
    e = {c: escape_xml(F.coalesce(F.col(c), F.lit(""))) for c in ("qualified_name", "name", "kind")}
    return nodes.select(F.format_string('<node id="%s"><data key="name">%s</data><data key="kind">%s</data></node>', *e.values()).alias("value"))


def graphml_edges(edges: DataFrame) -> DataFrame:
    e = [escape_xml(F.coalesce(F.col(c), F.lit(""))) for c in ("source", "target", "kind")]
    return edges.select(F.format_string('<edge source="%s" target="%s"><data key="kind">%s</data></edge>', *e).alias("value"))


def cypher_nodes(nodes: DataFrame) -> DataFrame:
    q = [F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")) for c in ("kind", "qualified_name", "name")]
    return nodes.select(F.format_string("MERGE (n:%s {qualified_name: '%s'}) SET n.name = '%s';", *q).alias("value"))


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Parquet tables that scans prune: nodes by kind, edges by kind."""
    nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/edges")


def without(current: DataFrame, files: DataFrame, key: str = "file_path") -> DataFrame:
    """`current` without the rows of the given files."""
    return current.join(files.select(key).distinct(), key, "left_anti")


def changed_only(current: DataFrame, incoming: DataFrame, key: str, hash_: str) -> DataFrame:
    """Incoming rows whose key is new or whose hash differs from what is stored."""
    known = current.select(key, F.col(hash_).alias("known"))
    return incoming.join(known, key, "left").where(~F.col(hash_).eqNullSafe(F.col("known"))).drop("known")


def json_string(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_replace(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One `value` a node and an edge: its JSON object."""
    shown = lambda kind, *cols: F.concat(F.lit('{"type":"' + kind + '"'), *[x for c in cols for x in (F.lit(f',"{c}":'), json_string(F.col(c)))], F.lit("}"))
    return nodes.select(shown("node", "kind", "name", "qualified_name", "file_path").alias("value")).unionAll(edges.select(shown("edge", "kind", "source", "target").alias("value")))


def wiki_pages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(community_id, page): a Markdown page for each community: its size, its files, and the communities it is tied to."""
    c = nodes.where(F.col("community_id").isNotNull()).select("qualified_name", "community_id", "file_path")
    files = c.groupBy("community_id", "file_path").agg(F.count("*").alias("n"))
    listed = files.groupBy("community_id").agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct("file_path", "n"))).alias("files"))
    e = edges.join(c.select(F.col("qualified_name").alias("source"), F.col("community_id").alias("a")), "source").join(c.select(F.col("qualified_name").alias("target"), F.col("community_id").alias("b")), "target")
    tied = e.where("a <> b").groupBy(F.col("a").alias("community_id"), "b").agg(F.count("*").alias("n"))
    ties = tied.groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("ties"))
    lines = F.array_join(F.transform("files", lambda f: F.format_string("- %s (%d)", f["file_path"], f["n"])), "\n")
    ends = F.array_join(F.transform(F.coalesce("ties", F.array().cast("array<struct<b:int,n:bigint>>")), lambda t: F.format_string("- [[community-%d]] (%d)", t["b"], t["n"])), "\n")
    page = F.concat(F.format_string("# Community %d\n\n%d members\n\n## Files\n", F.col("community_id"), F.col("size")), lines, F.lit("\n\n## Ties\n"), ends, F.lit("\n"))
    return listed.join(ties, "community_id", "left").select("community_id", page.alias("page"))
