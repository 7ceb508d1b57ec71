"""Communities: weighted label propagation, groups by folder, and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug, split_name
from .search import placed
from .traverse import settled

# Edge weights by kind, and words that say nothing in a name.
WEIGHTS = {"CALLS": 1.0, "IMPORTS_FROM": 0.5, "INHERITS": 0.8, "IMPLEMENTS": 0.7, "CONTAINS": 0.3, "TESTED_BY": 0.4, "DEPENDS_ON": 0.6}
COMMON = [
    "get", "set", "init", "new", "self", "the", "and", "for", "from", "with", "this", "that", "none", "all", "add", "create", "make", "build", "run",
    "main", "do", "is", "has", "on", "of", "in", "at", "to", "by", "test", "update", "delete", "remove", "my",
]


def propagate(nodes: DataFrame, edges: DataFrame, rounds: int = 5, least: int = 2) -> DataFrame:
    """(node, community): each round, a node takes the label of most weight around it, ties to the least.

    Labels start as the nodes themselves and a node counts its own with weight 0.5, which stops
    two neighbours from swapping for ever.  Communities below `least` nodes are left out.
    """
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("kind")], F.lit(0.5))
    ends = edges.select("source", "target", weight.alias("w")).where("source <> target")
    every = nodes.select(F.col("qualified_name").alias("name")).unionAll(ends.select("source")).unionAll(ends.select("target")).where("name is not null").distinct()
    # Rounds deal out numbers, places by name, so that ties still go to the least name.
    ids = settled(placed(every.withColumn("score", F.lit(0)), "name", "score"))
    named = lambda name, to: ids.select(F.col("name").alias(name), F.col("place").alias(to))
    pairs = ends.join(named("source", "x"), "source").join(named("target", "y"), "target")
    once = settled(pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("w").alias("w")))
    both = once.unionAll(once.select(F.col("b"), F.col("a"), "w"))
    labels = settled(nodes.select(F.col("qualified_name").alias("name")).join(ids, "name").select(F.col("place").alias("node"), F.col("place").alias("label")))
    for _ in range(rounds):
        votes = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label", "w")
        votes = votes.unionAll(labels.select("node", "label", F.lit(0.5)))
        sums = votes.groupBy("node", "label").agg(F.round(F.sum("w"), 6).alias("w"))
        best = sums.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("m"))
        labels = settled(best.select("node", F.col("m.label").alias("label")))
    big = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kept = labels.join(big, "label").join(named("n_node", "node"), "node").join(named("n_label", "label"), "label")
    return kept.select(F.col("n_node").alias("node"), F.col("n_label").alias("community"))


def by_folder(nodes: DataFrame, depth: int) -> DataFrame:
    """Counts of nodes by the first `depth` folders of their files."""
    folder = F.array_join(F.slice(F.split("file_path", "/"), 1, depth), "/")
    return nodes.groupBy(folder.alias("folder")).agg(F.count("*").alias("n"))


def names(members: DataFrame) -> DataFrame:
    """A name for each community of members (community, name, file_path): commonest folder and word.

    Ties go to the least.  Words of a name are split by case and signs; common ones do not count.
    """

    def commonest(values: DataFrame) -> DataFrame:
        counts = values.where("v <> ''").groupBy("community", "v").agg(F.count("*").alias("n"))
        first = Window.partitionBy("community").orderBy(F.desc("n"), "v")
        return counts.withColumn("r", F.row_number().over(first)).where("r = 1").select("community", "v")

    folder = F.element_at(F.split("file_path", "/"), -2)
    folders = commonest(members.where(F.col("file_path").contains("/")).select("community", slug(folder).alias("v")))
    words = members.select("community", F.explode(split_name(F.col("name"))).alias("w")).select("community", F.lower("w").alias("v"))
    words = commonest(words.where(~F.col("v").isin(COMMON) & (F.length("v") > 2)))
    return folders.withColumnRenamed("v", "f").join(words.withColumnRenamed("v", "w"), "community", "full").select("community", F.concat_ws("-", "f", "w").alias("name"))
