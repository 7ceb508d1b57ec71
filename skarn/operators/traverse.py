"""Walks of the graph by whole frontiers: one join and one anti join a level.

The frontier and what has been seen are kept as tables each level, which cuts their lineage, in the
folder the session names; the driver sees only whether a level is empty.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the session names, or a temporary one of a local session."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skarn-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """`df` as Parquet in the shared folder, read from there: compressed, by columns and without its lineage."""
    at = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def steps_from(edges: DataFrame, frontier: DataFrame, directed: bool = False) -> DataFrame:
    """Steps (node, next) over edges, both ways unless directed, from the nodes of a frontier (node); as often as edges have them."""
    at = frontier.select("node")
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("next")).join(at, "node", "left_semi")
    return out if directed else out.unionAll(edges.select(F.col("target").alias("node"), F.col("source").alias("next")).join(at, "node", "left_semi"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """(node, depth): nodes within `depth` steps of the seeds (node), with the least number of steps."""
    frontier = settled(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for level in range(1, depth + 1):
        found = steps_from(edges, frontier, directed).select(F.col("next").alias("node")).distinct()
        frontier = settled(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


def impact(nodes: DataFrame, edges: DataFrame, files: DataFrame, depth: int = 2, most: int = 500) -> DataFrame:
    """Nodes near the nodes of changed files (file_path): depth, and whether more than `most` were reached.

    Ordered by depth and name before the cut, so the result does not depend on partitions.
    """
    seeds = nodes.join(files, "file_path", "left_semi").select(F.col("qualified_name").alias("node"))
    # No more nodes than that can be among the rows; a name that several nodes have gives several.
    near = reach(edges, seeds, depth).orderBy("depth", "node").limit(most + 1)
    found = near.join(nodes.select(F.col("qualified_name").alias("node"), "kind", "file_path"), "node", "left")
    # The place in the order comes from counts by depth and partition sort, not from one window over all.
    top = found.orderBy("depth", "node").limit(most + 1).withColumn("place", F.row_number().over(Window.orderBy("depth", "node")))
    cut = top.agg((F.count("*") > most).alias("truncated"))
    return top.where(F.col("place") <= most).join(F.broadcast(cut)).select("node", "kind", "file_path", "depth", "truncated")


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(step, node) of one undirected shortest path, the least by parent names; empty if there is none.

    Whole levels are walked from both ends, from the end whose last one has fewer nodes, until two meet
    or none is left, however long the path is.  From where they meet, levels of the target's side that
    the source's reaches take their parents from there.
    """
    spark = edges.sparkSession
    if source == target:
        return spark.createDataFrame([(0, source)], "step int, node string")

    def beyond(level: DataFrame) -> DataFrame:
        return steps_from(edges, level).where("next is not null").groupBy(F.col("next").alias("node")).agg(F.min("node").alias("parent"))

    sides = [[settled(spark.createDataFrame([(end, None)], "node string, parent string"))] for end in (source, target)]
    seen, sizes = [side[0] for side in sides], [1, 1]
    while True:
        k = 0 if sizes[0] <= sizes[1] else 1
        level = settled(beyond(sides[k][-1]).join(seen[k].select("node"), "node", "left_anti"))
        sizes[k] = level.count()
        if not sizes[k]:
            return spark.createDataFrame([], "step int, node string")
        sides[k].append(level)
        seen[k] = seen[k].unionAll(level)
        met = settled(sides[0][-1].join(sides[1][-1].select("node"), "node", "left_semi"))
        if not met.isEmpty():
            break
    levels = [*sides[0][:-1], met]
    for side in reversed(sides[1][:-1]):
        levels.append(settled(beyond(levels[-1]).join(side.select("node"), "node", "left_semi")))
    path, at = [], target
    for level in reversed(levels):  # one row a level
        row = level.where(F.col("node") == at).first()
        if row is not None:
            path.append(at)
            at = row["parent"]
    return spark.createDataFrame(list(enumerate(reversed(path))), "step int, node string")


# What tells an entry point by a decorator and by a name, and a test's file.
ENTRY_DECORATORS = [
    r"(?i)app\.(get|post|put|delete|patch|route|websocket|on_event)", r"(?i)router\.(get|post|put|delete|patch|route)",
    r"(?i)blueprint\.(route|before_request|after_request)", r"(?i)(before|after)_(request|response)", r"(?i)click\.(command|group)",
    r"(?i)\w+\.(command|group)\b", r"(?i)(field|model)_(serializer|validator)", r"(?i)(celery\.)?(task|shared_task|periodic_task)", r"(?i)receiver",
    r"(?i)api_view", r"(?i)\baction\b", r"pytest\.(fixture|mark)", r"(?i)(override_settings|modify_settings)", r"(?i)(event\.)?listens_for",
    r"(?i)(Get|Post|Put|Delete|Patch|RequestMapping)Mapping", r"(?i)(Scheduled|EventListener|Bean|Configuration)",
    r"(?i)(Component|Injectable|Controller|Module|Guard|Pipe)", r"(?i)(Subscribe|Mutation|Query|Resolver)",
    r"(app|router)\.(get|post|put|delete|patch|use|all)\b", r"(?i)@(Override|OnLifecycleEvent|Composable)",
    r"(?i)(HiltViewModel|AndroidEntryPoint|Inject)", r"(?i)\w+\.(tool|tool_plain|system_prompt|result_validator)\b", r"^tool\b",
    r"(?i)\w+\.(middleware|exception_handler|on_exception)\b", r"(?i)\w+\.route\b",
]
ENTRY_NAMES = [
    r"^main$", r"^__main__$", r"^test_", r"^Test[A-Z]", r"^on_", r"^handle_", r"^handler$", r"^handle$", r"^lambda_handler$", r"^upgrade$",
    r"^downgrade$", r"^lifespan$", r"^get_db$", r"^on(Create|Start|Resume|Pause|Stop|Destroy|Bind|Receive)", r"^do(Get|Post|Put|Delete)$",
    r"^do_(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)$", r"^log_message$", r"^(middleware|errorHandler)$",
    r"^ng(OnInit|OnChanges|OnDestroy|DoCheck|AfterContentInit|AfterContentChecked|AfterViewInit|AfterViewChecked)$",
    r"^(transform|writeValue|registerOnChange|registerOnTouched|setDisabledState)$",
    r"^(canActivate|canDeactivate|canActivateChild|canLoad|canMatch|resolve)$",
    r"^(componentDidMount|componentDidUpdate|componentWillUnmount|shouldComponentUpdate|render)$",
]
TEST_FILE = r"([\\/]__tests__[\\/]|\.spec\.[jt]sx?$|\.test\.[jt]sx?$|[\\/]test_[^/\\]*\.py$)"


def entry_points(nodes: DataFrame, edges: DataFrame, tests: bool = False) -> DataFrame:
    """Functions that nothing but files calls, or that a decorator or their name tells as entry points; tests aside unless asked for.

    `decorators`, where nodes have it, holds a node's decorators as one text a line.
    """
    some = nodes.where(F.col("kind").isin("Function", "Test"))
    if not tests:
        some = some.where(~F.col("is_test") & (F.col("kind") != "Test") & ~F.col("file_path").rlike(TEST_FILE))
    callers = nodes.where(F.col("kind") == "File").select(F.col("qualified_name").alias("source"))
    called = edges.where(F.col("kind") == "CALLS").join(callers, "source", "left_anti").select(F.col("target").alias("qualified_name")).distinct().withColumn("called", F.lit(True))
    marks = F.coalesce(F.col("decorators"), F.lit("")) if "decorators" in nodes.columns else F.lit("")
    by_mark = marks.rlike("|".join(f"(?:{p})" for p in ENTRY_DECORATORS)) & (marks != "")
    by_name = F.col("name").rlike("|".join(ENTRY_NAMES))
    why = F.when(F.col("called").isNull(), "uncalled").when(by_mark, "decorator").when(by_name, "name")
    return some.join(called, "qualified_name", "left").select("qualified_name", why.alias("why")).where("why is not null")


def flows(nodes: DataFrame, edges: DataFrame, depth: int = 15, through: DataFrame | None = None) -> DataFrame:
    """(entry, node, depth): what each entry point reaches over calls, entries of two nodes or more.

    Entry points are those of `entry_points`, called by others or not; with `through` (node), those
    that reach any of these nodes.
    """
    calls = edges.where(F.col("kind") == "CALLS")
    entries = entry_points(nodes, edges).select(F.col("qualified_name").alias("entry")).distinct()
    if through is not None:
        back = reach(calls.select(F.col("target").alias("source"), F.col("source").alias("target")), through, depth, directed=True)
        entries = entries.join(back.select(F.col("node").alias("entry")), "entry", "left_semi")
    return traced(entries, calls, depth)


def traced(entries: DataFrame, calls: DataFrame, depth: int = 15) -> DataFrame:
    """(entry, node, depth): what each entry reaches over calls, of those that reach another node.

    Those are the ones that the first level has.  Later levels take only nodes that some call leads to
    and another from, and the calls from these.
    """
    steps = calls.select(F.col("source").alias("node"), F.col("target").alias("next")).where("not (node <=> next)")
    near = steps.withColumnsRenamed({"node": "entry", "next": "node"}).join(entries.select("entry"), "entry", "left_semi")
    frontier = settled(near.distinct().withColumn("depth", F.lit(1)).where(F.lit(depth > 0)))
    seen = frontier.select("entry", F.col("entry").alias("node"), F.lit(0).alias("depth")).distinct().unionAll(frontier)
    inner = settled(steps.select("node").distinct().join(steps.select(F.col("next").alias("node")).distinct(), "node", "left_semi"))
    if depth < 2 or inner.isEmpty():
        return seen
    onward = settled(steps.join(inner, "node", "left_semi"))
    for level in range(2, depth + 1):
        found = frontier.select("entry", "node").join(onward, "node").select("entry", F.col("next").alias("node")).distinct()
        frontier = settled(found.join(seen.select("entry", "node"), ["entry", "node"], "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


def retraced(members: DataFrame, gone: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 15) -> DataFrame:
    """Flows (flow_id, node, depth) with those of some ids (flow_id, the entry) traced anew over the edges of now."""
    calls, gone = edges.where(F.col("kind") == "CALLS"), settled(gone)
    known = nodes.select(F.col("qualified_name").alias("entry"))
    again = traced(gone.select(F.col("flow_id").alias("entry")).join(known, "entry", "left_semi"), calls, depth)
    return members.join(gone, "flow_id", "left_anti").unionByName(again.withColumnRenamed("entry", "flow_id"))


def dependents(nodes: DataFrame, edges: DataFrame, files: DataFrame, hops: int = 2) -> DataFrame:
    """(file_path, hops): files whose nodes depend on or call into the given files, within some hops."""
    f = nodes.select("qualified_name", "file_path")
    e = edges.where(F.col("kind").isin("CALLS", "DEPENDS_ON"))
    e = e.join(f.select(F.col("qualified_name").alias("source"), F.col("file_path").alias("user")), "source")
    e = e.join(f.select(F.col("qualified_name").alias("target"), F.col("file_path").alias("used")), "target")
    by_file = e.where("user <> used").select(F.col("used").alias("source"), F.col("user").alias("target")).distinct()
    found = reach(settled(by_file), files.select(F.col("file_path").alias("node")), hops, directed=True)
    return found.where("depth > 0").select(F.col("node").alias("file_path"), F.col("depth").alias("hops"))


def transitive_tests(edges: DataFrame, start: DataFrame, hops: int = 1) -> DataFrame:
    """(test, indirect): tests of the nodes (node), and of what they call within some hops."""
    near = reach(edges.where(F.col("kind") == "CALLS"), start, hops, directed=True)
    tests = edges.where(F.col("kind") == "TESTED_BY").select(F.col("source").alias("node"), F.col("target").alias("test"))
    return near.join(tests, "node").groupBy("test").agg((F.min("depth") > 0).alias("indirect"))


def betweenness(edges: DataFrame, pivots: DataFrame, depth: int = 1 << 30) -> DataFrame:
    """(node, score): how often a node lies between a pivot (node) and the others, over shortest directed paths.

    The counts of shortest paths are summed level by level from all pivots at once; then each level
    hands its share back to the one before, in proportion to the paths.  With every node as a pivot
    this is betweenness without its normalisation; with some, an estimate of a share of it.
    """
    pairs = edges.select("source", "target").where("source <> target").distinct()
    starts = pivots.select("node").where("node is not null").distinct()
    every = pairs.select(F.col("source").alias("node")).unionAll(pairs.select("target")).unionAll(starts).distinct()
    # Rows of pivots and nodes hold numbers: names meet only at both ends of the walk.
    ids = settled(every.withColumn("id", F.monotonically_increasing_id()))
    named = lambda name, to: ids.select(F.col("node").alias(name), F.col("id").alias(to))
    steps = settled(pairs.join(named("source", "from"), "source").join(named("target", "next"), "target").select(F.col("from").alias("node"), "next"))
    frontier = settled(starts.join(ids, "node").select(F.col("id").alias("pivot"), F.col("id").alias("node"), F.lit(1.0).alias("paths")))
    levels, seen = [frontier], frontier.select("pivot", "node")
    while len(levels) <= depth:
        reached = frontier.join(steps, "node").groupBy("pivot", F.col("next").alias("node")).agg(F.sum("paths").alias("paths"))
        frontier = settled(reached.join(seen, ["pivot", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        levels.append(frontier)
        seen = seen.unionAll(frontier.select("pivot", "node"))
    share = levels[-1].withColumn("share", F.lit(0.0))
    shares = [share]
    for above in reversed(levels[:-1]):
        given = share.select("pivot", F.col("node").alias("next"), ((1 + F.col("share")) / F.col("paths")).alias("each"))
        handed = above.select("pivot", "node").join(steps, "node").join(given, ["pivot", "next"]).groupBy("pivot", "node").agg(F.sum("each").alias("each"))
        part = F.coalesce(F.col("paths") * F.col("each"), F.lit(0.0))
        share = settled(above.join(handed, ["pivot", "node"], "left").select("pivot", "node", "paths", part.alias("share")))
        shares.append(share)
    out = shares[0]
    for other in shares[1:]:
        out = out.unionByName(other)
    scores = out.where("node <> pivot and share > 0").groupBy("node").agg(F.round(F.sum("share"), 6).alias("score")).where("score > 0")
    return scores.withColumnRenamed("node", "id").join(ids, "id").select("node", "score")


def within_budget(reached: DataFrame, budget: int) -> DataFrame:
    """(node, depth, spent): reached nodes by depth and name while the tokens of their names stay within a budget.

    A node costs a quarter of its name's length and ten, so no more than a tenth of the budget can
    be taken, and only so many rows are ordered in one task.
    """
    cost = (F.floor(F.length("node") / 4) + 10).cast("long")
    first = reached.withColumn("cost", cost).orderBy("depth", "node").limit(budget // 10 + 1)
    spent = first.withColumn("spent", F.sum("cost").over(Window.orderBy("depth", "node").rowsBetween(Window.unboundedPreceding, 0)))
    return spent.where(F.col("spent") <= budget).select("node", "depth", "spent")
