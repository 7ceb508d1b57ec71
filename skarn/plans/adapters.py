"""The engine's logical tables as views over the driver tables, for Spark and (as CTEs) for SQL.

Logical tables: nodes and edges of a property graph, telemetry and session events, pipeline runs,
memory observations, pack candidates, diff ranges and two versions of files.  Nothing here is
collected.  Nodes and edges are stored once a session and state of their files; each other view is a projection or union of
scans, so filters and columns reach the files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.traverse import shared_folder

AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple[str, str, str], str] = {}


def version(spark: SparkSession, sf_dir: str, names: list[str]) -> str:
    """The files of some tables with their lengths and times: another text once any of them changes."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    said = []
    for name in names:
        path = hadoop.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            said.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(said))


def stored(spark: SparkSession, sf_dir: str, name: str, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from the tables `sources`, kept as Parquet in the shared folder and read from there.

    It is derived once a session for each state of the files it comes from, and anew when they change.
    """
    key = (spark.sparkContext.applicationId, name, version(spark, sf_dir, sources))
    if key not in _STORED:
        at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        build().write.parquet(at)
        _STORED[key] = at
    return spark.read.parquet(_STORED[key])


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """`df` in so many tasks by some keys, where the session's own number of shuffle partitions is less; else as it is."""
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def tasks_for(spark: SparkSession, sf_dir: str, names: list[str], mb: int = 4) -> int:
    """A task for each `mb` MB of some tables' files, so that what one holds doesn't grow with them."""
    sizes = [int(line.rsplit(" ", 2)[1]) for line in version(spark, sf_dir, names).splitlines()]
    return sum(sizes) // (mb << 20) + 1


def _key(kind: str, column: str):
    return F.concat(F.lit(kind + "::"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored nodes of the property graph."""
    return stored(spark, sf_dir, "nodes", ["customer", "supplier", "part", "nation", "region"], lambda: derived_nodes(spark, sf_dir))


def derived_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and parts are functions, suppliers classes, nations and regions files."""
    t = lambda n: table(spark, sf_dir, n)
    null = F.lit(None).cast("int")

    def shaped(df, kind, key, name, path, first, last, language, file_type, is_test, score, community):
        return df.select(
            F.lit(kind).alias("kind"), F.col(name).alias("name"), key.alias("qualified_name"), path.alias("file_path"),
            first.cast("int").alias("line_start"), last.cast("int").alias("line_end"), language.alias("language"),
            F.lit(file_type).alias("file_type"), is_test.alias("is_test"), score.cast("double").alias("confidence_score"),
            community.cast("int").alias("community_id"),
        )

    no, one = F.lit(False), F.lit(1)
    c, s, p = t("customer"), t("supplier"), t("part")
    parts = [
        shaped(c, "Function", _key("customer", "c_custkey"), "c_name", F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string"), F.lit("/customer.py")),
               F.col("c_custkey") % 97 + 1, F.col("c_custkey") % 97 + 1 + F.col("c_custkey") % 60, F.col("c_mktsegment"), "code",
               F.col("c_custkey") % 10 == 0, F.when(F.col("c_acctbal") < 0, 0.2).otherwise(1.0), F.col("c_nationkey")),
        shaped(s, "Class", _key("supplier", "s_suppkey"), "s_name", F.concat(F.lit("nation/"), F.col("s_nationkey").cast("string"), F.lit("/supplier.py")),
               one, F.col("s_suppkey") % 100 + 1, F.lit("supplier"), "code", no, F.when(F.col("s_acctbal") < 0, 0.2).otherwise(1.0), F.col("s_nationkey")),
        shaped(p, "Function", _key("part", "p_partkey"), "p_name", F.concat(F.lit("part/"), F.col("p_brand"), F.lit(".md")),
               one, F.col("p_size"), F.col("p_type"), "document", no, F.lit(0.5), F.col("p_size") % 25),
        shaped(t("nation"), "File", _key("nation", "n_nationkey"), "n_name", F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")),
               F.lit(0), F.lit(0), F.lit(""), "code", no, F.lit(1.0), F.col("n_nationkey")),
        shaped(t("region"), "File", _key("region", "r_regionkey"), "r_name", F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")),
               F.lit(0), F.lit(0), F.lit(""), "config", no, F.lit(1.0), null),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NODES = """nodes AS (
  SELECT 'Function' AS kind, c_name AS name, 'customer::' || c_custkey AS qualified_name, 'nation/' || c_nationkey || '/customer.py' AS file_path,
    (c_custkey % 97 + 1)::INT AS line_start, (c_custkey % 97 + 1 + c_custkey % 60)::INT AS line_end, c_mktsegment AS language, 'code' AS file_type,
    c_custkey % 10 = 0 AS is_test, CASE WHEN c_acctbal < 0 THEN 0.2 ELSE 1.0 END::DOUBLE AS confidence_score, c_nationkey::INT AS community_id FROM customer
  UNION ALL SELECT 'Class', s_name, 'supplier::' || s_suppkey, 'nation/' || s_nationkey || '/supplier.py', 1, (s_suppkey % 100 + 1)::INT, 'supplier', 'code',
    false, CASE WHEN s_acctbal < 0 THEN 0.2 ELSE 1.0 END::DOUBLE, s_nationkey::INT FROM supplier
  UNION ALL SELECT 'Function', p_name, 'part::' || p_partkey, 'part/' || p_brand || '.md', 1, p_size::INT, p_type, 'document', false, 0.5, (p_size % 25)::INT FROM part
  UNION ALL SELECT 'File', n_name, 'nation::' || n_nationkey, 'nation/' || n_nationkey, 0, 0, '', 'code', false, 1.0, n_nationkey::INT FROM nation
  UNION ALL SELECT 'File', r_name, 'region::' || r_regionkey, 'region/' || r_regionkey, 0, 0, '', 'config', false, 1.0, NULL FROM region
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored edges of the property graph."""
    return stored(spark, sf_dir, "edges", ["lineitem", "orders", "customer", "supplier", "nation"], lambda: derived_edges(spark, sf_dir))


def derived_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges; TESTED_BY runs from the production node to the test."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    n = tasks_for(spark, sf_dir, ["lineitem", "orders"])
    orders = t("orders").select("o_orderkey", "o_custkey")
    sold = dealt(lines, n, "l_orderkey").join(dealt(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pair = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), a.alias("source"), b.alias("target"))
    customer, part, supplier = _key("customer", "o_custkey"), _key("part", "l_partkey"), _key("supplier", "l_suppkey")
    # Keys repeat far more than nodes do: pairs of keys are made distinct, as numbers, before they are named.
    sold = dealt(sold.select("o_custkey", "l_partkey", "l_returnflag"), n, "o_custkey", "l_partkey")
    bought = sold.groupBy("o_custkey", "l_partkey").agg(F.max(F.col("l_returnflag") == "R").alias("returned"))
    edge = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("source"), b.alias("target"))
    call, test = edge("CALLS", customer, part), edge("TESTED_BY", part, customer)
    made = F.when(F.col("returned") & (F.col("o_custkey") % 10 == 0), F.array(call, test)).otherwise(F.array(call))
    return (
        bought.select(F.explode(made).alias("e")).select("e.*")
        .unionAll(pair(dealt(lines.select("l_partkey", "l_suppkey"), n, "l_partkey", "l_suppkey").distinct(), "DEPENDS_ON", part, supplier))
        .unionAll(pair(t("customer"), "CONTAINS", _key("nation", "c_nationkey"), _key("customer", "c_custkey")))
        .unionAll(pair(t("supplier"), "CONTAINS", _key("nation", "s_nationkey"), _key("supplier", "s_suppkey")))
        .unionAll(pair(t("nation"), "CONTAINS", _key("region", "n_regionkey"), _key("nation", "n_nationkey")))
    )


EDGES = """edges AS (
  SELECT DISTINCT 'CALLS' AS kind, 'customer::' || o_custkey AS source, 'part::' || l_partkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT DISTINCT 'DEPENDS_ON', 'part::' || l_partkey, 'supplier::' || l_suppkey FROM lineitem
  UNION ALL SELECT DISTINCT 'TESTED_BY', 'part::' || l_partkey, 'customer::' || o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_returnflag = 'R' AND o_custkey % 10 = 0
  UNION ALL SELECT 'CONTAINS', 'nation::' || c_nationkey, 'customer::' || c_custkey FROM customer
  UNION ALL SELECT 'CONTAINS', 'nation::' || s_nationkey, 'supplier::' || s_suppkey FROM supplier
  UNION ALL SELECT 'CONTAINS', 'region::' || n_regionkey, 'nation::' || n_nationkey FROM nation
)"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    before = F.lit(100) + k
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(k % 5 == 0, "other").otherwise("compress").alias("event_type"), F.col("event_type").alias("tool_name"),
        before.alias("before_tokens"), F.greatest(F.lit(1), before - F.floor("value").cast("int")).alias("after_tokens"),
        F.element_at(F.array(F.lit("lite"), F.lit("full"), F.lit("ultra")), k % 3 + 1).alias("intensity"),
        F.when(k % 2 == 0, "index").otherwise("full").alias("detail_level"), F.col("ts").alias("created_at"),
    )


TELEMETRY = """telemetry AS (
  SELECT event_id, CASE WHEN k % 5 = 0 THEN 'other' ELSE 'compress' END AS event_type, tool_name, 100 + k AS before_tokens,
    greatest(1, 100 + k - floor(value)::INT) AS after_tokens, (['lite', 'full', 'ultra'])[k % 3 + 1] AS intensity,
    CASE WHEN k % 2 = 0 THEN 'index' ELSE 'full' END AS detail_level, created_at
  FROM (SELECT event_id, event_type AS tool_name, value, ts AS created_at, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
)"""

PRIORITIES = {"error": 1, "purchase": 1, "signup": 2, "click": 3, "view": 3}


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), "event_type",
        F.coalesce(priority[F.col("event_type")], F.lit(3)).alias("priority"), F.col("props").alias("data"), F.col("ts").alias("created_at"),
    )


SESSIONS = """session_events AS (
  SELECT event_id AS id, user_id AS session_id, event_type,
    CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS priority, props AS data, ts AS created_at FROM events
)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "quality")
    kinds = F.array(*[F.lit(x) for x in ("note", "warning", "decision", "user")])
    d = table(spark, sf_dir, "documents")
    return d.join(labels, d["doc_id"] == F.col("l_id"), "left").select(
        F.col("doc_id").alias("id"), F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("type"),
        F.substring("text", 1, 12).alias("title"), ((F.coalesce("quality", F.lit(0)) + 1) / 3.0).alias("importance"),
        (F.col("doc_id") % 7).cast("int").alias("access_count"), (F.col("doc_id") % 11 == 0).alias("archived"),
        F.date_sub(F.lit("2024-02-01").cast("date"), (F.col("doc_id") % 400).cast("int")).alias("created_at"), "source",
    )


OBSERVATIONS = """observations AS (
  SELECT d.doc_id AS id, (['note', 'warning', 'decision', 'user'])[d.doc_id % 4 + 1] AS type, substr(text, 1, 12) AS title,
    ((coalesce(quality, 0) + 1) / 3.0)::DOUBLE AS importance, (d.doc_id % 7)::INT AS access_count, d.doc_id % 11 = 0 AS archived,
    DATE '2024-02-01' - (d.doc_id % 400)::INT AS created_at, source
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def pipeline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("pipeline"), F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"),
        F.col("n_chars").cast("double").alias("duration_ms"), F.col("doc_id").alias("run_id"),
    )


RUNS = """pipeline_runs AS (
  SELECT source AS pipeline, sha256(text) AS file_hash, n_chars::DOUBLE AS duration_ms, doc_id AS run_id FROM documents
)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("query_id"), F.col("p_name").alias("name"),
        (F.length("p_name") + F.col("p_size")).cast("int").alias("cost"), (F.col("p_retailprice") / 2000.0).alias("relevance"),
        (F.col("p_partkey") % 5).cast("int").alias("distance"), (F.col("p_partkey") % 90).cast("int").alias("age_days"),
        F.col("p_size").cast("int").alias("access_count"),
    )


CANDIDATES = """candidates AS (
  SELECT p_partkey AS id, p_brand AS query_id, p_name AS name, (length(p_name) + p_size)::INT AS cost, p_retailprice / 2000.0 AS relevance,
    (p_partkey % 5)::INT AS distance, (p_partkey % 90)::INT AS age_days, p_size::INT AS access_count FROM part
)"""


def diff_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("nation/"), (F.col("l_suppkey") % 25).cast("string"), F.lit("/customer.py")).alias("file_path"),
        (F.col("l_linenumber") * 7).cast("int").alias("start"), (F.col("l_linenumber") * 7 + F.col("l_quantity") % 3).cast("int").alias("stop"),
    ).distinct()


DIFFS = """diff_ranges AS (
  SELECT DISTINCT 'nation/' || (l_suppkey % 25) || '/customer.py' AS file_path, (l_linenumber * 7)::INT AS start,
    (l_linenumber * 7 + l_quantity % 3)::INT AS stop FROM lineitem
)"""


def file_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents before and after: ids divisible by 10 go, those by 7 change, those by 13 are new."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    after = d.where("path % 10 <> 0").withColumn("hash", F.when(F.col("path") % 7 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")))
    return d.where("path % 13 <> 0"), after


VERSIONS = """before AS (SELECT doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 13 <> 0),
after AS (SELECT doc_id AS path, sha256(text) || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END AS hash FROM documents WHERE doc_id % 10 <> 0)"""
