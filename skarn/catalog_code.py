"""Registered queries of import resolution and depth-first walks, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import G, register
from .functions.json_text import skeleton
from .operators import depth as de
from .operators import receivers as re
from .operators.json_tree import compress_json
from .operators.traverse import settled
from .plans import adapters as a
from .sources import imports as im
from .sources import scanner as sc

# --- imports and re-exports: parts as scripts, their folders' indexes as barrels, order lines as importers


def _text(*parts: str | Column) -> Column:
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _project(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """files, definitions, exports (module not yet a file), imports and settings of a project of scripts.

    Part k of brand b and size s is `part<k>` of src/b/s/<k>.ts; src/b/s/index.ts and src/b/index.ts pass on
    all that is below them; src/index.ts passes on all of its folders; api/index.ts renames each part from
    there.  The lines of an order import and call the parts' new names from `@api`, a pattern of root settings.
    """
    parts = a.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_brand").alias("b"), F.col("p_size").cast("string").alias("s"), F.col("p_partkey").cast("int").alias("place"))
    # Made distinct as numbers, once.
    pairs = a.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("f"), "l_partkey").distinct()
    lines = settled(pairs.select(_text("app/", F.col("f").cast("string"), ".ts").alias("file_path"), F.col("l_partkey").cast("string").alias("k")))
    path = _text("src/", F.col("b"), "/", F.col("s"), "/", F.col("k"), ".ts")
    inner, outer = _text("src/", F.col("b"), "/", F.col("s"), "/index.ts"), _text("src/", F.col("b"), "/index.ts")
    one = spark.range(1)
    files = (
        parts.select(path.alias("file_path")).unionAll(parts.select(inner).distinct()).unionAll(parts.select(outer).distinct())
        .unionAll(one.select(F.explode(F.array(F.lit("src/index.ts"), F.lit("api/index.ts"))))).unionAll(lines.select("file_path").distinct())
    )
    star = F.lit("*").alias("exported")
    none = F.lit(None).cast("string").alias("original")
    exports = (
        parts.select(inner.alias("file_path"), "place", star, none, _text("./", F.col("k")).alias("module"))
        .unionAll(parts.select(outer, F.col("s").cast("int"), star, none, _text("./", F.col("s"))).distinct())
        .unionAll(parts.select(F.lit("src/index.ts"), F.regexp_extract("b", "[0-9]+", 0).cast("int"), star, none, _text("./", F.col("b"))).distinct())
        .unionAll(parts.select(F.lit("api/index.ts"), "place", _text("api", F.col("k")), _text("part", F.col("k")), F.lit("../src")))
    )
    settings = spark.createDataFrame([("tsconfig.json", "./base", None, None), ("base.json", None, ".", [("@api", ["api/index"]), ("@*", ["none/*"])])], "path string, extends string, base_url string, paths array<struct<pattern:string,targets:array<string>>>")
    return {
        "files": files, "definitions": parts.select(path.alias("file_path"), _text("part", F.col("k")).alias("name")), "exports": exports, "settings": settings,
        "imports": lines.select("file_path", _text("api", F.col("k")).alias("name"), F.lit("@api").alias("module")),
    }


def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _project(spark, sf_dir)
    script = F.lit("typescript").alias("language")
    asked = p["imports"].select("file_path", script, "module").unionAll(p["exports"].select("file_path", script, "module"))
    found = settled(im.module_files(asked, p["files"], im.effective_settings(p["settings"])))
    exports = p["exports"].join(found, ["file_path", "module"], "left").select("file_path", "place", "exported", F.coalesce("original", "exported").alias("original"), "target_file")
    names = im.exported_names(p["definitions"], exports)
    calls = p["imports"].select("file_path", "name")
    return im.call_targets(calls, p["definitions"], p["imports"], found, names)


register(
    "imported_symbols", _imported,
    """WITH RECURSIVE parts AS (SELECT p_partkey AS k, 'src/' || p_brand || '/' || p_size || '/' || p_partkey || '.ts' AS path, 'src/' || p_brand || '/' || p_size || '/index.ts' AS inside, 'src/' || p_brand || '/index.ts' AS outside FROM part),
    stars AS (SELECT inside AS file, path AS target FROM parts UNION SELECT outside, inside FROM parts UNION SELECT 'src/index.ts', outside FROM parts),
    given AS (SELECT path AS file, 'part' || k AS name, path AS target FROM parts UNION SELECT stars.file, name, given.target FROM given JOIN stars ON given.file = stars.target),
    api AS (SELECT 'api' || k AS name, given.target || '::part' || k AS target FROM parts JOIN given ON given.file = 'src/index.ts' AND given.name = 'part' || k)
    SELECT DISTINCT 'app/' || (l_orderkey % 500) || '.ts' AS file_path, 'api' || l_partkey AS name, target, 'export' AS how FROM lineitem JOIN api ON api.name = 'api' || l_partkey""",
)

# --- depth-first order

_TREE = """steps AS (SELECT DISTINCT source AS node, target AS next FROM edges WHERE {where}),
walk AS (SELECT {start} AS node, 0 AS depth UNION SELECT next, depth + 1 FROM walk JOIN steps USING (node) WHERE depth < {depth}),
near AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node),
tree AS (SELECT n.node, n.depth, min(p.node) AS parent FROM near n LEFT JOIN (SELECT steps.next, near.node, near.depth FROM steps JOIN near USING (node)) p ON p.next = n.node AND p.depth = n.depth - 1 GROUP BY ALL),
paths AS (SELECT node, depth, parent, [node] AS path FROM tree WHERE depth = 0 UNION ALL SELECT t.node, t.depth, t.parent, list_append(paths.path, t.node) FROM tree t JOIN paths ON t.parent = paths.node),
placed AS (SELECT node, parent, depth, row_number() OVER (ORDER BY path) - 1 AS place FROM paths)"""


def _from_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = a.nodes(spark, sf_dir).where("qualified_name = 'region::1'").select(F.col("qualified_name").alias("node"))
    return de.preorder(de.shortest_tree(a.edges(spark, sf_dir).where("kind <> 'TESTED_BY'"), starts, 4)).select("node", "parent", "depth", "place")


register(
    "depth_first_tree", _from_region,
    ", " + _TREE.format(where="kind <> 'TESTED_BY'", start="'region::1'", depth=4) + " SELECT node, parent, depth, place FROM placed", *G,
)
register(
    "depth_first_walk", lambda s, d: de.walk_from(a.nodes(s, d), a.edges(s, d), ["small", "widget"], 3, 2_000),
    """, start AS (SELECT qualified_name FROM nodes WHERE contains(lower(name), 'small') AND contains(lower(name), 'widget')
      ORDER BY CASE WHEN lower(name) = 'small widget' THEN 3 WHEN starts_with(lower(name), 'small widget') THEN 2 ELSE 1 END DESC, qualified_name LIMIT 1), """
    + _TREE.format(where="true", start="(SELECT qualified_name FROM start)", depth=3)
    + """, costs AS (SELECT place, node, depth, sum(length(node) // 4 + 10) OVER (ORDER BY place)::BIGINT AS spent FROM placed)
    SELECT place, node, depth, spent FROM costs WHERE spent <= 2000""", *G,
)

# --- JSON of any shape


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    text = _text('{"z": {"b": {"k": ', k, ', "deep": {"x": [{"y": 1}]}}, "list": [[1.5, 2], ', k, ']}, "type": "', F.col("event_type"), '", "none": null, "on": true, "e": {}, "l": []}')
    # A row of a few bytes takes long to read as JSON: small files are dealt to more tasks than scans of them get.
    events = a.table(spark, sf_dir, "events").select("event_id", "event_type", "props").repartition(a.tasks_for(spark, sf_dir, ["events"], 1), "event_id")
    return events.select("event_id", text.alias("json"))


register(
    "json_skeletons", lambda s, d: _settings(s, d).select("event_id", skeleton(F.col("json")).alias("shape")),
    """SELECT event_id, '{"z": {"b": {"k": "int", "deep": {"x": "..."}}, "list": [["...", "... (2 items)"], "... (2 items)"]}, "type": "str(' || length(event_type)
    || ')", "none": "null", "on": "bool", "e": {}, "l": []}' AS shape FROM events""",
)


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a tool's response: texts under keys of both sorts, in lists, and in objects in lists."""
    part = lambda i: F.substring("text", i, 200)
    inner = F.struct(part(200).alias("title"), F.col("source").alias("source"), F.array(part(400), F.lit("short")).alias("parts"))
    whole = F.struct(F.col("doc_id").alias("id"), F.col("text").alias("summary"), F.col("text").alias("other"), F.array(inner, inner).alias("results"), F.struct(part(1).alias("text")).alias("nodes"))
    # A document takes long to compress: its rows are dealt to more tasks than scans of a few files get.
    documents = a.table(spark, sf_dir, "documents").select("doc_id", "text", "source").repartition(a.tasks_for(spark, sf_dir, ["documents"], 1), "doc_id")
    return documents.select(F.col("doc_id").alias("id"), F.to_json(whole).alias("json"))


def _compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_json(_responses(spark, sf_dir), "ultra")


register("compressed_responses", _compressed)

# --- calls through variables: suppliers as classes with one method and a base each, orders as functions that use two of them


def _receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = a.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    n = s.agg(F.count("*").alias("n"))
    o = a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c")).join(F.broadcast(n))  # one row
    named = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    file, first = _text("app/", (F.col("o") % 200).cast("string"), ".py"), (F.floor(F.col("o") / 200) * 10 + 1).cast("int")
    said = F.array(
        _text("def f", F.col("o").cast("string"), "(x: ", named("S", F.col("c") % F.col("n")), "):"), _text("    y = ", named("S", F.col("o") % F.col("n")), "()"),
        _text("    y.m", (F.col("o") % 7).cast("string"), "()"), _text("    x.m", (F.col("o") % 5).cast("string"), "(y.other())"), F.lit("    z.m1()"),
    )
    lines = o.select(file.alias("file_path"), first.alias("first"), F.posexplode(said).alias("i", "text")).select("file_path", (F.col("first") + F.col("i")).alias("line"), "text")
    scopes = o.select(_text(file, "::f", F.col("o").cast("string")).alias("qualified_name"), file.alias("file_path"), F.lit("Function").alias("kind"), first.alias("line_start"), (first + 4).alias("line_end"), file.alias("parent"))
    whole = o.select(file.alias("qualified_name"), file.alias("file_path"), F.lit("File").alias("kind"), F.lit(0).alias("line_start"), F.lit(1_000_000_000).alias("line_end"), F.lit(None).cast("string").alias("parent")).distinct()
    cls = named("lib/s.py::S", F.col("k"))
    method = named("m", F.col("k") % 7)
    seen = o.select(file.alias("file_path"), F.explode(F.array(F.col("o") % F.col("n"), F.col("c") % F.col("n"))).alias("k")).distinct().join(s, "k")
    types = seen.select("file_path", named("S", F.col("k")).alias("name"), cls.alias("class"))
    bases = s.where("k > 1").select(cls.alias("class"), named("lib/s.py::S", F.floor(F.col("k") / 2)).alias("base"))
    methods = s.select(cls.alias("class"), method.alias("method"), _text(cls, ".", method).alias("target"))
    known = o.where("o % 3 = 0").select(_text(file, "::f", F.col("o").cast("string")).alias("source"), (first + 2).alias("line"))
    return re.resolve_receivers(lines, scopes.unionByName(whole), types, bases, methods, known).select("file_path", "line", "receiver", "method", "source", "target", "outcome")


register(
    "receiver_calls", _receivers,
    """WITH RECURSIVE n AS (SELECT count(*) AS n FROM supplier),
    up AS (SELECT s_suppkey AS k, s_suppkey AS a, 0 AS d FROM supplier UNION ALL SELECT k, a // 2, d + 1 FROM up WHERE a > 1),
    m AS (SELECT k, a % 7 AS m, arg_min(a, d) AS a FROM up JOIN supplier ON s_suppkey = a GROUP BY 1, 2),
    o AS (SELECT o_orderkey AS o, 'app/' || (o_orderkey % 200) || '.py' AS f, (o_orderkey // 200 * 10 + 1)::INT AS first, o_custkey % n AS x, o_orderkey % n AS y FROM orders, n),
    c AS (SELECT o, f, first + 2 AS line, 'y' AS receiver, o % 7 AS m, y AS k FROM o UNION ALL SELECT o, f, first + 3, 'x', o % 5, x FROM o UNION ALL SELECT o, f, first + 3, 'y', NULL, y FROM o UNION ALL SELECT o, f, first + 4, 'z', 1, NULL FROM o)
    SELECT f AS file_path, line, receiver, CASE WHEN c.m IS NULL THEN 'other' ELSE 'm' || c.m END AS method, f || '::f' || o AS source,
      CASE WHEN s_suppkey IS NOT NULL THEN 'lib/s.py::S' || a || '.m' || c.m END AS target,
      CASE WHEN c.m IS NULL THEN 'method' WHEN receiver = 'z' THEN 'receiver' WHEN s_suppkey IS NULL THEN 'type' WHEN a IS NULL THEN 'member' WHEN o % 3 = 0 AND line % 10 = 3 THEN 'known' ELSE 'new' END AS outcome
    FROM c LEFT JOIN m ON m.k = c.k AND m.m = c.m LEFT JOIN supplier ON s_suppkey = c.k""",
)

# --- modules of brace languages: a file for each customer, whose comments and texts hold braces too


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = a.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_nationkey").cast("string").alias("n"), "c_name")
    text = _text("module N", F.col("n"), " = {\n  // } {\n  module C", F.col("k"), ' = {\n    let s = "}{', F.col("c_name"), '"\n  /* } /* } */ { */ }\n}\nmodule Al = Foo.Bar\nlet x = {1}\n')
    return sc.modules(c.select(_text(F.col("k"), ".res").alias("file_path"), text.alias("text")))


register(
    "brace_modules", _modules,
    """SELECT c_custkey || '.res' AS file_path, 'N' || c_nationkey AS name, 1 AS line_start, 6 AS line_end, NULL AS parent FROM customer
    UNION ALL SELECT c_custkey || '.res', 'C' || c_custkey, 3, 5, 'N' || c_nationkey FROM customer""",
)
