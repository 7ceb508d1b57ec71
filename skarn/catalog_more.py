"""Registered queries of look-ups, resolution, reports, sessions and memory, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog as base
from .catalog import COMMUNITY_ENDS, ENDS, FLOWS, G, SAVED, register
from .functions import text as tx
from .operators import graph as g
from .operators import lookups as lo
from .operators import memory as me
from .operators import reports as rp
from .operators import resolve as rs
from .operators import sessions as ss
from .operators import telemetry as te
from .operators import traverse as tr
from .plans import adapters as a


def _graph(run):
    return lambda s, d: run(a.nodes(s, d), a.edges(s, d))


def _nodes(run):
    return lambda s, d: run(a.nodes(s, d))


def _file(*paths: str):
    """Files (file_path) given by name."""
    return lambda s: s.createDataFrame([(p,) for p in paths], "file_path string")


# --- look-ups

register("node_by_name", _nodes(lambda n: lo.node(n, "supplier::1").select("kind", "name", "qualified_name", "file_path")), "SELECT kind, name, qualified_name, file_path FROM nodes WHERE qualified_name = 'supplier::1'", a.NODES)
register("files_ending", _nodes(lambda n: lo.files_ending(n, "customer.py")), "SELECT DISTINCT file_path FROM nodes WHERE file_path LIKE '%customer.py'", a.NODES)
register("nodes_of_kinds", _nodes(lambda n: lo.nodes_of_kinds(n, ["Class", "File"], "NATION/1").select("qualified_name", "kind", "file_path")), "SELECT qualified_name, kind, file_path FROM nodes WHERE kind IN ('Class', 'File') AND file_path ILIKE '%nation/1%'", a.NODES)
register(
    "nodes_by_size", _nodes(lambda n: lo.nodes_by_size(n, 20, 55, "Function", "nation/", 50)),
    "SELECT qualified_name, kind, file_path, line_end - line_start + 1 AS n_lines FROM nodes WHERE kind = 'Function' AND file_path ILIKE '%nation/%' AND line_end - line_start + 1 BETWEEN 20 AND 55 ORDER BY n_lines DESC, qualified_name LIMIT 50", a.NODES,
)
register(
    "signatures", _nodes(lambda n: n.select("qualified_name", lo.signature(F.col("kind"), F.col("name"), F.nullif(F.col("language"), F.lit("")), F.when(F.col("is_test"), "None")).alias("signature"))),
    """SELECT qualified_name, substr(CASE WHEN kind = 'Function' THEN 'def ' || name || '(' || language || ')' || CASE WHEN is_test THEN ' -> None' ELSE '' END
      WHEN kind = 'Class' THEN 'class ' || name ELSE name END, 1, 512) AS signature FROM nodes""", a.NODES,
)
register(
    "sanitised_texts", lambda s, d: a.table(s, d, "documents").select("doc_id", lo.sanitised(F.col("text")).alias("text")),
    r"SELECT doc_id, substr(regexp_replace(text, '[\x00-\x08\x0B-\x1F]', '', 'g'), 1, 256) AS text FROM documents",
)
register(
    "review_context", lambda s, d: lo.review_context(a.nodes(s, d), a.edges(s, d), _file("nation/4/customer.py", "nation/4/supplier.py", "part/Brand#11.md")(s)),
    """, k AS (SELECT target, count(*) AS n FROM edges WHERE kind = 'CALLS' GROUP BY target)
    SELECT file_path, qualified_name, kind, coalesce(n, 0) AS n_callers FROM nodes LEFT JOIN k ON target = qualified_name
    WHERE kind <> 'File' AND file_path IN ('nation/4/customer.py', 'nation/4/supplier.py', 'part/Brand#11.md')""", *G,
)
register(
    "find_symbols", _nodes(lambda n: lo.find_symbols(n, "supplier::1, small widget")),
    """SELECT asked, qualified_name, kind, file_path FROM nodes, (VALUES ('supplier::1'), ('small widget')) q(asked) WHERE contains(lower(name), asked) OR contains(lower(qualified_name), asked)""", a.NODES,
)
register("symbol_links", lambda s, d: lo.symbol_links(a.edges(s, d), "7"), "SELECT kind, source, target FROM edges WHERE target = '7' OR target LIKE '%.7' OR target LIKE '%::7'", a.EDGES)
register(
    "source_slices", lambda s, d: a.table(s, d, "documents").select("doc_id", lo.source_slice(F.col("text"), F.lit(2), F.lit(4)).alias("lines")),
    "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines FROM documents",
)
register(
    "stale_files", lambda s, d: lo.stale(a.table(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("seen_at")), a.table(s, d, "documents").where("doc_id % 10 <> 0").select(F.col("doc_id").alias("path"), (F.col("n_chars") + F.col("doc_id") % 3 - 1).alias("changed_at"))),
    "SELECT doc_id AS path, doc_id % 10 = 0 AS gone FROM documents WHERE doc_id % 10 = 0 OR doc_id % 3 = 2",
)
register("memory_index", lambda s, d: lo.memory_index(a.observations(s, d), 40), "SELECT id, type, title, importance, access_count FROM observations WHERE NOT archived ORDER BY importance DESC, access_count DESC, created_at DESC, id LIMIT 40", a.OBSERVATIONS)
register("recent_runs", lambda s, d: lo.recent(a.telemetry(s, d), 20).select("event_id", "tool_name", "before_tokens"), "SELECT event_id, tool_name, before_tokens FROM telemetry ORDER BY created_at DESC, event_id DESC LIMIT 20", a.TELEMETRY)


def _flows(s: SparkSession, d: str) -> DataFrame:
    return tr.settled(tr.flows(a.nodes(s, d), a.edges(s, d)).withColumnRenamed("entry", "flow_id"))


def _scores(s: SparkSession, d: str, members: DataFrame) -> DataFrame:
    n, e = a.nodes(s, d), a.edges(s, d)
    tested = e.where("kind = 'TESTED_BY'").select(F.col("source").alias("node")).distinct().withColumn("t", F.lit(True))
    info = n.select(F.col("qualified_name").alias("node"), "file_path", F.col("name").rlike("(?i)gadget|lock").alias("secure"), (F.col("confidence_score") < 0.5).cast("int").alias("external"))
    return g.criticality(members.join(info, "node").join(tested, "node", "left").withColumn("tested", F.coalesce("t", F.lit(False))))


CRITICALITY = base.ORACLE["flow_criticality"].split("flows AS (SELECT * FROM steps", 1)[1].split("HAVING count(*) > 1))", 1)[1]
SCORES = FLOWS + CRITICALITY.rsplit("SELECT flow_id, least(", 1)[0].rstrip().rstrip(",") + ", scores AS (SELECT flow_id, least(" + CRITICALITY.rsplit("SELECT flow_id, least(", 1)[1] + ")"


def _flow_list(s: SparkSession, d: str) -> DataFrame:
    members = _flows(s, d)
    return lo.flow_list(members, _scores(s, d, members), 30)


register(
    "flow_list", _flow_list,
    "SELECT entry AS flow_id, count(*) AS n_nodes, max(f.depth) AS depth, any_value(criticality) AS criticality FROM flows f JOIN scores ON entry = flow_id GROUP BY entry ORDER BY criticality DESC, flow_id LIMIT 30", *G, SCORES,
)
register(
    "flow_steps", lambda s, d: lo.flow_steps(_flows(s, d), a.nodes(s, d), "customer::1"),
    "SELECT depth, node, name, kind, file_path FROM flows JOIN nodes ON node = qualified_name WHERE entry = 'customer::1'", *G, FLOWS,
)
register("flows_of_nodes", lambda s, d: lo.flows_of_nodes(_flows(s, d)), "SELECT node, count(DISTINCT entry) AS n_flows FROM flows GROUP BY node", *G, FLOWS)
register(
    "affected_flows", lambda s, d: lo.flows_through(_flows(s, d), a.nodes(s, d), _file("nation/4/customer.py", "part/Brand#11.md")(s)),
    "SELECT DISTINCT entry AS flow_id FROM flows JOIN nodes ON node = qualified_name WHERE file_path IN ('nation/4/customer.py', 'part/Brand#11.md')", *G, FLOWS,
)
register(
    "community_list", _nodes(lambda n: lo.communities(n, 3)),
    """, z AS (SELECT community_id, count(*) AS size, count(DISTINCT file_path) AS n_files FROM nodes WHERE community_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
    t AS (SELECT community_id, language, row_number() OVER (PARTITION BY community_id ORDER BY count(*) DESC, language) AS k FROM nodes WHERE language <> '' GROUP BY 1, 2)
    SELECT community_id, size, n_files, language FROM z LEFT JOIN (SELECT * FROM t WHERE k = 1) USING (community_id)""", a.NODES,
)
register("community_members", _nodes(lambda n: lo.members_of(n, [3, 4])), "SELECT community_id, qualified_name FROM nodes WHERE community_id IN (3, 4)", a.NODES)
register(
    "run_metadata", lambda s, d: lo.metadata(a.pipeline_runs(s, d).select(F.col("pipeline").alias("key"), F.col("file_hash").alias("value"), F.col("run_id").alias("at"))),
    "SELECT pipeline AS key, arg_max(file_hash, run_id) AS value FROM pipeline_runs GROUP BY 1", a.RUNS,
)
KS = "ks AS (SELECT event_id, user_id, event_type, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


def _ks(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return a.table(s, d, "events").select("event_id", "user_id", "event_type", "ts", k.alias("k"), k.cast("string").alias("t"))


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _searches(s: SparkSession, d: str) -> DataFrame:
    t, k = F.col("t"), F.col("k")
    tool = F.element_at(F.array(F.lit("Grep"), F.lit("Glob"), F.lit("Bash"), F.lit("Read")), k % 4 + 1)
    pattern = F.when(k % 4 == 0, _text("auth", t)).when(k % 4 == 1, F.when(k % 3 == 0, "**/*.ts").otherwise(_text("**/auth", t, "*.ts")))
    command = F.when(k % 4 == 2, F.when(k % 3 == 0, _text("cat x", t)).otherwise(_text("cd src && rg -n --glob *.py 'tok", t, "' lib")))
    return _ks(s, d).select("event_id", lo.searched_pattern(tool, pattern, command).alias("pattern"))


register("searched_patterns", _searches, "SELECT event_id, CASE k % 4 WHEN 0 THEN 'auth' || k WHEN 1 THEN CASE WHEN k % 3 <> 0 THEN 'auth' || k END WHEN 2 THEN CASE WHEN k % 3 <> 0 THEN 'tok' || k END END AS pattern FROM ks", KS)

# --- resolution

register(
    "resolve_bare_calls",
    lambda s, d: rs.resolve_bare_calls(
        a.table(s, d, "part").select(F.col("p_partkey").alias("call_id"), _text("part/", F.col("p_brand"), ".md").alias("file_path"), F.col("p_name").alias("name")), a.nodes(s, d),
        a.table(s, d, "part").select(_text("part/", F.col("p_brand"), ".md").alias("file_path"), _text("part/", F.col("p_brand"), ".md").alias("imported")),
    ),
    """, c AS (SELECT name, qualified_name, file_path FROM nodes WHERE kind IN ('Function', 'Test', 'Class')), z AS (SELECT name, count(*) AS n, min(qualified_name) AS sole FROM c GROUP BY name),
    k AS (SELECT p_partkey AS call_id, 'part/' || p_brand || '.md' AS file_path, p_name AS name FROM part),
    m AS (SELECT call_id, k.name, count(*) AS n, min(qualified_name) AS target FROM k JOIN z ON z.name = k.name AND n > 1 JOIN c ON c.name = k.name AND c.file_path = k.file_path GROUP BY 1, 2)
    SELECT call_id, k.name, sole AS target FROM k JOIN z ON z.name = k.name AND n = 1 UNION ALL SELECT call_id, name, target FROM m WHERE n = 1""", a.NODES,
)
register(
    "peeled_modules",
    lambda s, d: rs.peeled(
        a.table(s, d, "customer").select(_text("nation.", F.col("c_nationkey").cast("string"), ".customer.f", (F.col("c_custkey") % 5).cast("string")).alias("target")).distinct(),
        a.nodes(s, d).where("kind = 'File' or (kind = 'Function' and file_type = 'code')").select(F.regexp_replace(F.regexp_replace("file_path", "[.]py$", ""), "/", ".").alias("module"), "file_path").distinct(),
    ),
    """, t AS (SELECT DISTINCT 'nation.' || c_nationkey || '.customer.f' || (c_custkey % 5) AS target FROM customer),
    m AS (SELECT DISTINCT replace(regexp_replace(file_path, '[.]py$', ''), '/', '.') AS module, file_path FROM nodes WHERE kind = 'File' OR (kind = 'Function' AND file_type = 'code')),
    r AS (SELECT target, module, file_path, row_number() OVER (PARTITION BY target ORDER BY length(module) DESC) AS k FROM t JOIN m ON starts_with(target || '.', module || '.'))
    SELECT target, module, file_path, substr(target, length(module) + 2) AS rest FROM r WHERE k = 1""", a.NODES,
)
register(
    "resolve_suffix", lambda s, d: rs.resolve_suffix(
        a.table(s, d, "supplier").select(_text("nation/", F.col("s_nationkey").cast("string"), "/supplier.py").alias("source_file"), F.element_at(F.array(F.lit("customer.py"), F.lit("3/customer.py"), F.lit("none.py")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("suffix")).distinct(),
        a.nodes(s, d).select("file_path").distinct()),
    """, f AS (SELECT DISTINCT file_path FROM nodes), w AS (SELECT DISTINCT 'nation/' || s_nationkey || '/supplier.py' AS source_file, (['customer.py', '3/customer.py', 'none.py'])[s_suppkey % 3 + 1] AS suffix FROM supplier),
    r AS (SELECT source_file, suffix, file_path, count(*) OVER (PARTITION BY source_file, suffix) AS n_candidates,
      row_number() OVER (PARTITION BY source_file, suffix ORDER BY (regexp_replace(file_path, '/[^/]*$', '') = regexp_replace(source_file, '/[^/]*$', '')) DESC, file_path) AS k
      FROM w JOIN f ON file_path = suffix OR ends_with(file_path, '/' || suffix))
    SELECT source_file, suffix, file_path, n_candidates FROM r WHERE k = 1""", a.NODES,
)
register(
    "called_names", lambda s, d: rs.called_names(
        a.table(s, d, "part").select(F.col("p_partkey").alias("id"), _text(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), "(x) + print(y) + other (z)").alias("text")),
        a.table(s, d, "part").select(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("name"))),
    "SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name FROM part WHERE replace(p_name, ' ', '_') IN (SELECT replace(p_name, ' ', '_') FROM part)",
)
register("type_names", lambda s, d: rs.type_names(a.table(s, d, "documents")), "SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][A-Za-z0-9_]*')) AS name FROM documents")
register("whole_edges", _graph(rs.whole_edges), "SELECT source, target, max(kind) AS kind FROM edges WHERE source IN (SELECT qualified_name FROM nodes) AND target IN (SELECT qualified_name FROM nodes) GROUP BY 1, 2", *G)
register(
    "rename_preview", _graph(lambda n, e: rs.rename_preview(n, e, "Supplier#000000003", "Renamed")),
    """, own AS (SELECT qualified_name, file_path FROM nodes WHERE name = 'Supplier#000000003')
    SELECT file_path, qualified_name, 'definition' AS what, 'Supplier#000000003' AS old, 'Renamed' AS new FROM own
    UNION SELECT n.file_path, source, lower(e.kind), 'Supplier#000000003', 'Renamed' FROM edges e JOIN own ON target = own.qualified_name JOIN nodes n ON source = n.qualified_name WHERE e.kind IN ('CALLS', 'DEPENDS_ON', 'TESTED_BY')""", *G,
)


def _registry(s: SparkSession, d: str) -> DataFrame:
    path = _text("/repo/", F.col("n_regionkey").cast("string"), "/", F.col("n_name"))
    n = a.table(s, d, "nation").withColumn("path", path)
    k = F.col("n_nationkey") % 3
    wanted = n.select(F.when(k == 0, F.col("n_name")).when(k == 1, F.col("path")).otherwise("none").alias("wanted"), F.when(k == 2, _text(F.col("path"), "/src/deep")).otherwise("/x").alias("cwd"))
    return rs.resolve_repository(n.select(F.col("n_name").alias("alias"), "path"), wanted)


register(
    "resolve_repository", _registry,
    """WITH n AS (SELECT n_nationkey % 3 AS k, n_name, '/repo/' || n_regionkey || '/' || n_name AS path FROM nation)
    SELECT CASE k WHEN 0 THEN n_name WHEN 1 THEN path ELSE 'none' END AS wanted, CASE k WHEN 2 THEN path || '/src/deep' ELSE '/x' END AS cwd, path FROM n""",
)
register(
    "knowledge_gaps", _graph(rs.knowledge_gaps),
    """SELECT 'isolate' AS gap, qualified_name FROM nodes WHERE qualified_name NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)
    UNION ALL SELECT 'low_confidence', qualified_name FROM nodes WHERE confidence_score < 0.5""", *G,
)


def _changes(s: SparkSession, d: str) -> DataFrame:
    n, e = a.nodes(s, d), a.edges(s, d)
    moved = n.where("file_type <> 'config'").withColumn("community_id", F.when(F.col("kind") == "Class", F.col("community_id") + 1).otherwise(F.col("community_id")))
    return rs.graph_changes((n.where("kind <> 'File'"), e.where("kind <> 'TESTED_BY'")), (moved, e.where("kind <> 'CONTAINS'")))


register(
    "graph_changes", _changes,
    """SELECT (SELECT count(*) FROM nodes WHERE kind = 'File' AND file_type <> 'config') AS nodes_added, (SELECT count(*) FROM nodes WHERE kind <> 'File' AND file_type = 'config') AS nodes_removed,
    (SELECT count(*) FROM nodes WHERE kind = 'Class') AS community_moves, (SELECT count(*) FROM edges WHERE kind = 'TESTED_BY') AS edges_added, (SELECT count(*) FROM edges WHERE kind = 'CONTAINS') AS edges_removed""", *G,
)
register(
    "super_nodes", _graph(rs.super_nodes),
    """, c AS (SELECT coalesce(community_id, -1) AS c FROM nodes)
    SELECT c AS first, c AS second, count(*) AS n FROM c GROUP BY c
    UNION ALL SELECT least(coalesce(x.community_id, -1), coalesce(y.community_id, -1)), greatest(coalesce(x.community_id, -1), coalesce(y.community_id, -1)), count(*) FROM edges JOIN nodes x ON source = x.qualified_name JOIN nodes y ON target = y.qualified_name
    WHERE coalesce(x.community_id, -1) <> coalesce(y.community_id, -1) GROUP BY 1, 2""", *G,
)
register(
    "touched_communities", lambda s, d: rs.touched_communities(a.nodes(s, d), _file("nation/4/customer.py", "part/Brand#11.md")(s)),
    "SELECT count(DISTINCT community_id) AS n_communities, count(DISTINCT community_id) > 0 AS rerun FROM nodes WHERE file_path IN ('nation/4/customer.py', 'part/Brand#11.md')", a.NODES,
)


def _questions(s: SparkSession, d: str) -> DataFrame:
    n, e = tr.settled(a.nodes(s, d)), tr.settled(a.edges(s, d))
    return rs.suggested_questions(n, e, g.hubs(n, e, 3), g.surprising(n, e, 3), g.untested_hotspots(n, e, 5, 2))


SURPRISING = base.ORACLE["surprising_edges"]
SURPRISING = SURPRISING[SURPRISING.index(", m AS (SELECT min(degree)") : SURPRISING.index("SELECT * FROM scored")]
register(
    "suggested_questions", _questions,
    SURPRISING + """, h AS (SELECT node FROM degrees JOIN nodes ON node = qualified_name WHERE kind <> 'File' ORDER BY degree DESC, node LIMIT 3),
    s3 AS (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, source, target, kind LIMIT 3),
    u AS (SELECT node, degree FROM degrees WHERE degree >= 5 AND node IN (SELECT qualified_name FROM nodes WHERE NOT is_test AND kind <> 'File') AND node NOT IN (SELECT source FROM edges WHERE kind = 'TESTED_BY') ORDER BY degree DESC, node LIMIT 2)
    SELECT 'hub_risk' AS category, node AS target, 'high' AS priority FROM h WHERE node NOT IN (SELECT source FROM edges WHERE kind = 'TESTED_BY')
    UNION ALL SELECT 'surprising_connection', source, 'medium' FROM s3 JOIN nodes x ON source = x.qualified_name JOIN nodes y ON target = y.qualified_name WHERE x.community_id <> y.community_id
    UNION ALL SELECT 'thin_community', 'community:' || community_id, 'low' FROM nodes WHERE community_id IS NOT NULL GROUP BY community_id HAVING count(*) < 3
    UNION ALL SELECT 'untested_hotspot', node, 'medium' FROM u""", *G, ENDS,
)
register(
    "ranked_filters",
    lambda s, d: rs.ranked_filters(te.savings(a.telemetry(s, d)).select(F.col("tool_name").alias("filter"), "savings_pct"), a.table(s, d, "events").select(F.col("event_id").alias("command_id"), F.explode(F.array(F.col("event_type"), F.lit("none"), F.lit("click"))).alias("filter")).distinct()),
    """, f AS (SELECT tool_name AS filter, round(avg(savings_pct), 4) AS p FROM saved GROUP BY 1), m AS (SELECT DISTINCT event_id AS command_id, unnest([event_type, 'none', 'click']) AS filter FROM events)
    SELECT command_id, filter, row_number() OVER (PARTITION BY command_id ORDER BY coalesce(p, 0) DESC, filter)::INT AS place FROM m LEFT JOIN f USING (filter)""", SAVED,
)

# --- reports


def _one(*rows: DataFrame) -> DataFrame:
    """Rows of one each, side by side."""
    out = rows[0]
    for row in rows[1:]:
        out = out.join(row)
    return out


def _totals(s: SparkSession, d: str) -> DataFrame:
    t, o, e = te.savings(a.telemetry(s, d)), a.observations(s, d).where(~F.col("archived")), a.session_events(s, d)
    return _one(
        t.agg(
            F.round(F.avg(F.when(F.col("tool_name") == "click", F.col("savings_pct"))), 4).alias("filter_pct"), F.round(F.avg("savings_pct"), 4).alias("graph_pct"),
            F.count_if(F.col("event_type") == "compress").alias("n_commands"), F.count_distinct(F.to_date("created_at")).alias("n_active_days"), F.lit(30).alias("n_days"),
            F.count_if(F.col("after_tokens") < 10).alias("n_compressed"), F.count("*").alias("n_calls"),
        ),
        o.agg(F.count("*").alias("n_memory"), F.round(F.avg("importance"), 6).alias("importance")),
        e.agg(F.count_if(F.col("event_type") == "error").alias("n_errors"), F.count("*").alias("n_events")),
        te.busy_sessions(e, 100).agg(F.count("*").alias("n_long_sessions")),
        a.pipeline_runs(s, d).agg(F.count("*").alias("n_runs"), F.count_if(F.col("duration_ms") > 400).alias("n_good_runs")),
        te.redundant_hashes(a.pipeline_runs(s, d), 1).agg(F.count("*").alias("n_repeated")),
        a.nodes(s, d).agg(F.count("*").alias("n_nodes"), F.count_if(F.col("file_type") == "document").alias("n_media")),
        a.observations(s, d).agg(F.round(F.count_if("archived") / F.count("*"), 6).alias("archive_rate")),
    )


TOTALS = """totals AS (SELECT * FROM
  (SELECT round(avg(savings_pct) FILTER (WHERE tool_name = 'click'), 4) AS filter_pct, round(avg(savings_pct), 4) AS graph_pct, count(*) FILTER (WHERE event_type = 'compress') AS n_commands,
    count(DISTINCT created_at::DATE) AS n_active_days, 30 AS n_days, count(*) FILTER (WHERE after_tokens < 10) AS n_compressed, count(*) AS n_calls FROM saved),
  (SELECT count(*) AS n_memory, round(avg(importance), 6) AS importance FROM observations WHERE NOT archived),
  (SELECT count(*) FILTER (WHERE event_type = 'error') AS n_errors, count(*) AS n_events FROM session_events),
  (SELECT count(*) AS n_long_sessions FROM (SELECT 1 FROM session_events GROUP BY session_id HAVING count(*) > 100)),
  (SELECT count(*) AS n_runs, count(*) FILTER (WHERE duration_ms > 400) AS n_good_runs FROM pipeline_runs),
  (SELECT count(*) AS n_repeated FROM (SELECT 1 FROM pipeline_runs GROUP BY file_hash HAVING count(*) > 1)),
  (SELECT count(*) AS n_nodes, count(*) FILTER (WHERE file_type = 'document') AS n_media FROM nodes),
  (SELECT round(count(*) FILTER (WHERE archived) / count(*), 6) AS archive_rate FROM observations))"""
T = (SAVED, a.OBSERVATIONS, a.SESSIONS, a.RUNS, a.NODES, TOTALS)
GRADE = "CASE WHEN {0} >= 90 THEN 'S' WHEN {0} >= 80 THEN 'A' WHEN {0} >= 70 THEN 'B' WHEN {0} >= 55 THEN 'C' WHEN {0} >= 40 THEN 'D' ELSE 'F' END"
register(
    "quality_signals", lambda s, d: rp.quality_signals(_totals(s, d)),
    f""", g AS (SELECT least(100.0, 2.0::DOUBLE * (filter_pct + graph_pct) / greatest((filter_pct > 0)::INT + (graph_pct > 0)::INT, 1)) AS savings,
      CASE WHEN n_commands / n_days >= 20 THEN 100 WHEN n_commands / n_days >= 10 THEN 80 WHEN n_commands / n_days >= 5 THEN 60 WHEN n_commands / n_days >= 1 THEN 40 ELSE 10 END::DOUBLE AS coverage,
      least(100.0, 120.0::DOUBLE * n_active_days / n_days) AS consistency,
      CASE WHEN n_memory >= 50 AND importance >= 0.5 THEN 100 WHEN n_memory >= 20 AND importance >= 0.4 THEN 75 WHEN n_memory >= 10 THEN 50 WHEN n_memory >= 1 THEN 30 ELSE 0 END::DOUBLE AS memory,
      CASE WHEN n_events = 0 THEN 50 WHEN n_errors / n_events < 0.05 THEN 100 WHEN n_errors / n_events < 0.15 THEN 70 WHEN n_errors / n_events < 0.30 THEN 40 ELSE 15 END::DOUBLE AS errors,
      CASE WHEN n_runs = 0 THEN 50.0 ELSE least(100.0, 110.0::DOUBLE * n_good_runs / n_runs) END AS builds,
      CASE WHEN n_nodes = 0 THEN 30 WHEN n_media / n_nodes >= 0.30 THEN 100 WHEN n_media / n_nodes >= 0.10 THEN 80 WHEN n_media / n_nodes >= 0.01 THEN 60 ELSE 30 END::DOUBLE AS media FROM totals),
    h AS (SELECT *, 0.20::DOUBLE * savings + 0.16::DOUBLE * coverage + 0.16::DOUBLE * consistency + 0.16::DOUBLE * memory + 0.12::DOUBLE * errors + 0.10::DOUBLE * builds + 0.10::DOUBLE * media AS total FROM g)
    SELECT round(savings, 4) AS savings, coverage, round(consistency, 4) AS consistency, memory, errors, round(builds, 4) AS builds, media, round(total, 1) AS score, {GRADE.format('total')} AS grade FROM h""", *T,
)


def _by_filter(s: SparkSession, d: str) -> DataFrame:
    t = te.savings(a.telemetry(s, d))
    return t.groupBy(F.concat_ws("/", "tool_name", "intensity").alias("filter")).agg(F.count("*").alias("n"), F.round(F.avg("savings_pct"), 4).alias("avg_pct"))


FILTERS = ["click/lite", "git", "grep", "ls", "pytest"]


def _waste(s: SparkSession, d: str) -> DataFrame:
    totals = _totals(s, d).withColumn("error_rate", F.col("n_errors") / F.greatest("n_events", F.lit(1)))
    return rp.waste(totals, _by_filter(s, d), s.createDataFrame([(f,) for f in FILTERS], "filter string"))


register(
    "waste_findings", _waste,
    f""", w AS (SELECT *, n_errors / greatest(n_events, 1) AS error_rate FROM totals),
    f AS (SELECT tool_name || '/' || intensity AS filter, count(*) AS n, round(avg(savings_pct), 4) AS avg_pct FROM saved GROUP BY 1),
    i AS (SELECT count(*) AS n FROM (VALUES {', '.join(f"('{x}')" for x in FILTERS)}) v(filter) WHERE filter NOT IN (SELECT filter FROM f))
    SELECT 'empty_filter' AS finding, 'low' AS severity, filter AS subject, 0::BIGINT AS tokens FROM f WHERE n >= 5 AND avg_pct < 5
    UNION ALL SELECT 'session_bloat', 'medium', '', n_long_sessions * 50000 FROM w WHERE n_long_sessions >= 2
    UNION ALL SELECT 'error_churn', 'medium', '', floor(n_events * error_rate * 200)::BIGINT FROM w WHERE error_rate > 0.30 AND n_events > 20
    UNION ALL SELECT 'compression_off', 'medium', '', n_calls * 800 FROM w WHERE n_calls >= 10 AND n_compressed / n_calls < 0.1
    UNION ALL SELECT 'idle_filters', 'low', n || ' filters', 0 FROM i WHERE n >= 3
    UNION ALL SELECT 'memory_neglect', 'medium', '', 0 FROM w WHERE n_memory >= 10 AND importance < 0.3
    UNION ALL SELECT 'repeated_ingestion', 'low', '', n_repeated * 2000 FROM w WHERE n_repeated >= 3""", *T,
)


def _health(s: SparkSession, d: str) -> DataFrame:
    flags = {
        "filters_active": F.col("n_commands") > 0, "memory_used": F.col("n_memory") > 0, "compression_on": F.col("n_compressed") > 0, "sessions_on": F.col("n_events") > 100,
        "n_filter_events": F.col("n_commands"), "avg_pct": F.col("graph_pct"), "saved": F.col("n_calls"), "graph_empty": F.col("n_nodes") == 0,
    }
    return rp.health(_totals(s, d).withColumns(flags))


register(
    "health_report", _health,
    f""", r AS (SELECT CASE WHEN n_commands > 0 THEN 5 ELSE 0 END + CASE WHEN n_memory > 0 THEN 5 ELSE 0 END + CASE WHEN n_compressed > 0 THEN 5 ELSE 0 END + CASE WHEN n_events > 100 THEN 5 ELSE 0 END
        - CASE WHEN graph_pct < 20 AND n_calls > 0 THEN 5 ELSE 0 END - CASE WHEN archive_rate > 0.8 AND n_memory > 10 THEN 5 ELSE 0 END - CASE WHEN n_media = 0 THEN 3 ELSE 0 END + 70 AS h,
      concat_ws(',', CASE WHEN n_commands > 0 THEN 'filters_active' END, CASE WHEN n_memory > 0 THEN 'memory_used' END, CASE WHEN n_compressed > 0 THEN 'compression_on' END, CASE WHEN n_events > 100 THEN 'sessions_on' END,
        CASE WHEN graph_pct < 20 AND n_calls > 0 THEN 'low_savings' END, CASE WHEN archive_rate > 0.8 AND n_memory > 10 THEN 'memory_archived' END, CASE WHEN n_media = 0 THEN 'no_media' END) AS rules FROM totals)
    SELECT least(100, greatest(0, h))::INT AS health, {GRADE.format('least(100, greatest(0, h))')} AS grade, rules FROM r""", *T,
)


def _risks(s: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    """Risks of all nodes, or of some (qualified_name) by the flows through them."""
    n, e = a.nodes(s, d), a.edges(s, d)
    some = None if of is None else of.select(F.col("qualified_name").alias("node"))
    members = tr.settled(tr.flows(n, e, through=some).withColumnRenamed("entry", "flow_id"))
    theirs = members.select("flow_id", "node")
    theirs = theirs if some is None else theirs.join(some, "node", "left_semi")
    flows = theirs.join(_scores(s, d, members), "flow_id").select("node", "criticality")
    return rp.risk(n, e, flows, rp.tests_near(e), of)


def _change_report(s: SparkSession, d: str) -> DataFrame:
    n, e = a.nodes(s, d), a.edges(s, d)
    symbols = n.where("kind in ('Function', 'Test', 'Class')").select("qualified_name", "is_test")
    changed = tr.settled(g.range_overlap(n, a.diff_ranges(s, d)).join(symbols, "qualified_name"))
    return rp.change_report(changed, _risks(s, d, changed), e)


RISKS = COMMUNITY_ENDS + ", " + SCORES + """,
  rc AS (SELECT target, count(*) AS n_calls, count(DISTINCT CASE WHEN a <> b THEN source END) AS n_foreign FROM ce WHERE kind = 'CALLS' GROUP BY target),
  rf AS (SELECT node, sum(round(criticality * 10000)::BIGINT) AS flow FROM flows JOIN scores ON entry = flow_id GROUP BY node),
  rt AS (SELECT node, count(DISTINCT test) AS n_tests FROM (SELECT source AS node, target AS test FROM edges WHERE kind = 'TESTED_BY'
    UNION SELECT c.source, t.target FROM edges c JOIN edges t ON c.target = t.source AND t.kind = 'TESTED_BY' WHERE c.kind = 'CALLS') GROUP BY node),
  risks AS (SELECT qualified_name, greatest(0, least(10000, least(coalesce(flow, 0), 2500) + least(500 * coalesce(n_foreign, 0), 1500) + 3000 - 500 * least(coalesce(n_tests, 0), 5)
    + CASE WHEN regexp_matches(lower(name || ' ' || qualified_name), '""" + "|".join(rp.SECURITY) + """') THEN 2000 ELSE 0 END + least(500 * coalesce(n_calls, 0), 1000))) / 10000.0::DOUBLE AS risk
    FROM nodes LEFT JOIN rc ON qualified_name = rc.target LEFT JOIN rf ON qualified_name = rf.node LEFT JOIN rt ON qualified_name = rt.node WHERE kind <> 'File')"""
register("risk_scores", _risks, "SELECT * FROM risks", *G, RISKS)
register(
    "change_report", _change_report,
    """SELECT qualified_name, risk, NOT is_test AND qualified_name NOT IN (SELECT source FROM edges WHERE kind = 'TESTED_BY') AS test_gap FROM risks JOIN nodes USING (qualified_name)
    WHERE qualified_name IN (SELECT qualified_name FROM nodes n JOIN diff_ranges r ON n.file_path = r.file_path AND line_start <= stop AND line_end >= start)""", *G, RISKS, a.DIFFS,
)
register(
    "token_meta", lambda s, d: rp.token_meta(a.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", F.size(F.split("text", "\n", -1)).alias("n_results"))),
    "SELECT doc_id AS id, greatest(1, length(text) // 4) AS tokens, len(string_split(text, chr(10)))::INT AS n_results, greatest(1, length(text) // 4) // len(string_split(text, chr(10))) AS per_result FROM documents",
)
register(
    "query_costs", lambda s, d: rp.query_costs(a.table(s, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.coalesce("text", F.lit("")).alias("text")), 85),
    """WITH q AS (SELECT conv_id || ':' || turn AS id, length(coalesce(text, '')) > 100 AS l FROM conversations), c AS (SELECT id, (100 + 500 + 1000 + 1000 + 8 + 1500 + CASE WHEN l THEN 200 ELSE 0 END)::INT AS before, (3600 + CASE WHEN l THEN 100 ELSE 0 END)::INT AS after FROM q)
    SELECT id, before, after, round((before - after) / before * 100.0::DOUBLE, 2) AS saved_pct FROM c""",
)
register(
    "human_tokens", lambda s, d: a.table(s, d, "documents").select("doc_id", rp.human_tokens(F.col("n_chars") * F.col("doc_id")).alias("shown")),
    """WITH n AS (SELECT doc_id, n_chars * doc_id AS n FROM documents)
    SELECT doc_id, CASE WHEN n >= 1000000 THEN printf('%.1fM', round(n / 1e6, 1)) WHEN n >= 1000 THEN printf('%.1fK', round(n / 1e3, 1)) ELSE n::VARCHAR END AS shown FROM n""",
)
MODELS = {"model-opus-4": "opus", "Sonnet-4": "sonnet", "anthropic/claude-haiku": "haiku", "GPT5": "gpt-5", "gpt-4.1-mini-2025": "gpt-4.1", "gpt-4o-mini": "gpt-4o-mini", "deepseek-coder": "deepseek-v3", "unknown": "sonnet"}


def _costs(s: SparkSession, d: str) -> DataFrame:
    from .operators import scoring as sc

    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("event_id") % len(MODELS) + 1).cast("int"))
    usage = a.telemetry(s, d).select("event_id", model.alias("model"), F.col("before_tokens").alias("tokens_in"), F.col("after_tokens").alias("tokens_out"))
    return sc.token_cost(usage).select("event_id", "family", "cost")


register(
    "token_costs", _costs,
    f""", v(family, i, o) AS (VALUES ('opus', 15.0::DOUBLE, 75.0::DOUBLE), ('sonnet', 3.0, 15.0), ('haiku', 0.8, 4.0), ('gpt-5', 2.5, 10.0), ('gpt-4.1', 2.0, 8.0), ('gpt-4o-mini', 0.15, 0.6), ('deepseek-v3', 0.27, 1.1)),
    p AS (SELECT event_id, before_tokens, after_tokens, ({list(MODELS.values())})[event_id % {len(MODELS)} + 1] AS family FROM telemetry)
    SELECT event_id, family, round((before_tokens * i + after_tokens * o) / 1e6, 8) AS cost FROM p JOIN v USING (family)""", a.TELEMETRY,
)

# --- sessions


def _shell_calls(s: SparkSession, d: str) -> DataFrame:
    k, t = F.col("k"), F.col("t")
    commands = ['git commit -m "x"', _text("git checkout -b feat/", t), "git merge dev", F.when(k % 2 == 0, "git push up main").otherwise("git push"), "git pull", "git diff", "git status", _text('cat "file', t, '.txt"'), "make all"]
    outs = {0: _text("[main abc12de] message ", t), 2: F.when(k % 2 == 0, "CONFLICT in a").otherwise("ok"), 5: _text("diff --git a/f", t, " b/f\n+one\n+two\n-three"), 6: " M a\n?? b\n?? c"}
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    out = F.lit("")
    for at, text in outs.items():
        out = F.when(k % 9 == at, as_col(text)).otherwise(out)
    return _ks(s, d).select(F.col("event_id").alias("call_id"), F.element_at(F.array(*map(as_col, commands)), k % 9 + 1).alias("command"), out.alias("stdout"), _text("failed ", t).alias("stderr"), (F.col("event_type") == "error").cast("int").alias("exit_code"))


def _flat(rows: DataFrame) -> DataFrame:
    values = F.transform(F.array_sort(F.map_keys("data")), lambda key: F.col("data")[key])
    return rows.withColumn("detail", F.array_join(values, "|")).drop("data")


register(
    "shell_events", lambda s, d: _flat(ss.shell_events(_shell_calls(s, d))),
    """, c AS (SELECT event_id AS call_id, k, event_type = 'error' AS failed, (['git commit -m "x"', 'git checkout -b feat/' || k, 'git merge dev', CASE WHEN k % 2 = 0 THEN 'git push up main' ELSE 'git push' END, 'git pull', 'git diff', 'git status', 'cat "file' || k || '.txt"', 'make all'])[k % 9 + 1] AS cmd FROM ks)
    SELECT call_id, 'error' AS event_type, 2 AS priority, 'errors' AS category, cmd || '|1|failed ' || k AS detail FROM c WHERE failed
    UNION ALL SELECT call_id, (['git_commit', 'git_checkout', 'git_merge', 'git_push', 'git_pull', 'git_diff', 'git_status'])[k % 9 + 1], 2, 'git',
      ([cmd || '|abc12de|message ' || k, 'feat/' || k, 'dev|' || CASE WHEN k % 2 = 0 THEN 'conflict' ELSE 'clean' END, CASE WHEN k % 2 = 0 THEN 'main|up' ELSE '|origin' END, '|origin', '1|1|2', '0|0|1|2'])[k % 9 + 1] FROM c WHERE k % 9 < 7
    UNION ALL SELECT call_id, 'file_read', 1, 'files', 'file' || k || '.txt' FROM c WHERE k % 9 = 7
    UNION ALL SELECT call_id, 'mcp_tool_use', 3, 'tools', 'Bash' FROM c""", KS,
)
register(
    "edit_events", lambda s, d: _flat(ss.edit_events(a.table(s, d, "documents").select(F.col("doc_id").alias("call_id"), F.col("source").alias("file_path"), F.substring("text", 1, 400).alias("old"), F.col("text").alias("new")))),
    """WITH n AS (SELECT doc_id, source, length(text) - length(replace(text, chr(10), '')) - (length(substr(text, 1, 400)) - length(replace(substr(text, 1, 400), chr(10), ''))) AS more FROM documents)
    SELECT doc_id AS call_id, 'file_edit' AS event_type, source || '|' || greatest(more, 0) || '|' || abs(more) || '|' || abs(least(more, 0)) AS detail FROM n""",
)
TOOLS = ["detect_changes", "get_flow", "refactor", "list_flows", "get_impact_radius", "other", "query_graph", "none"]
register(
    "intents", lambda s, d: ss.intents(_ks(s, d).select(F.col("user_id").alias("session_id"), F.struct("ts", "event_id").alias("at"), F.element_at(F.array(*map(F.lit, TOOLS)), F.col("k") % len(TOOLS) + 1).alias("tool"))),
    f""", r AS (SELECT user_id AS session_id, ({TOOLS})[k % {len(TOOLS)} + 1] AS tool, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM ks),
    c AS (SELECT session_id, count(*) FILTER (WHERE tool IN ('detect_changes', 'get_impact_radius')) AS rv, count(*) FILTER (WHERE tool IN ('get_flow', 'query_graph')) AS db,
      count(*) FILTER (WHERE tool = 'refactor') AS rf, count(*) FILTER (WHERE tool = 'list_flows') AS ex FROM r WHERE p <= 10 GROUP BY 1)
    SELECT session_id, CASE WHEN greatest(rv, db, rf, ex) = 0 THEN 'exploring' WHEN rv = greatest(rv, db, rf, ex) THEN 'reviewing' WHEN db = greatest(rv, db, rf, ex) THEN 'debugging' WHEN rf = greatest(rv, db, rf, ex) THEN 'refactoring' ELSE 'exploring' END AS intent FROM c""", KS,
)
TYPES = {"error": "error", "purchase": "git_commit", "signup": "user_prompt", "click": "mcp_tool_use", "view": "file_edit"}


def _said(s: SparkSession, d: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[F.col("event_type")]
    return _ks(s, d).select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), kind.alias("event_type"), _text("item ", (F.col("k") % 7).cast("string"), " & more").alias("text"), F.col("ts").alias("created_at"))


SAID = KS + """, said AS (SELECT event_id AS id, user_id AS session_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'git_commit' WHEN 'signup' THEN 'user_prompt' WHEN 'click' THEN 'mcp_tool_use' WHEN 'view' THEN 'file_edit' END AS event_type,
  'item ' || (k % 7) || ' &amp; more' AS text, ts AS created_at FROM ks)"""
register(
    "session_snapshots", lambda s, d: ss.snapshots(_said(s, d), 600),
    """, last AS (SELECT *, row_number() OVER (PARTITION BY session_id, event_type ORDER BY created_at DESC, id DESC) AS back FROM said),
    fl AS (SELECT *, row_number() OVER (PARTITION BY session_id, text ORDER BY created_at DESC, id DESC) AS k FROM said WHERE event_type = 'file_edit'),
    tl AS (SELECT session_id, text, count(*) AS n FROM said WHERE event_type = 'mcp_tool_use' GROUP BY 1, 2),
    sec AS (
      SELECT session_id, 1 AS tier, '  <last-prompt>' || text || '</last-prompt>' || chr(10) AS x FROM last WHERE event_type = 'user_prompt' AND back = 1
      UNION ALL SELECT session_id, 2, '  <errors>' || chr(10) || string_agg('    <unresolved>' || text || '</unresolved>', chr(10) ORDER BY back DESC) || chr(10) || '  </errors>' || chr(10) FROM last WHERE event_type = 'error' AND back <= 5 GROUP BY session_id
      UNION ALL SELECT session_id, 3, '  <files-modified>' || chr(10) || string_agg('    <file>' || text || '</file>', chr(10) ORDER BY created_at DESC, id DESC) || chr(10) || '  </files-modified>' || chr(10) FROM fl WHERE k = 1 GROUP BY session_id
      UNION ALL SELECT session_id, 4, '  <git-ops>' || chr(10) || string_agg('    <op>' || text || '</op>', chr(10) ORDER BY back DESC) || chr(10) || '  </git-ops>' || chr(10) FROM last WHERE event_type = 'git_commit' AND back <= 10 GROUP BY session_id
      UNION ALL SELECT session_id, 5, '  <tools>' || chr(10) || string_agg('    <tool name="' || text || '" calls="' || n || '"/>', chr(10) ORDER BY n DESC, text) || chr(10) || '  </tools>' || chr(10) FROM tl GROUP BY session_id),
    r AS (SELECT *, 600 - 19 - 20 - coalesce(sum(length(x)) OVER (PARTITION BY session_id ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM sec),
    p AS (SELECT session_id, tier, CASE WHEN length(x) <= l THEN x WHEN l > 20 THEN regexp_replace(substr(x, 1, (l - 15)::INT), '\\n[^\\n]*$', '') || chr(10) || '  <!-- truncated -->' || chr(10) ELSE '' END AS y FROM r WHERE l > 0),
    j AS (SELECT session_id, string_agg(y, '' ORDER BY tier) AS y FROM p GROUP BY 1)
    SELECT session_id, '<session-snapshot>' || chr(10) || coalesce(y, '') || '</session-snapshot>' || chr(10) AS snapshot, (39 + length(coalesce(y, '')))::INT AS n_bytes FROM (SELECT DISTINCT session_id FROM said) LEFT JOIN j USING (session_id)""", SAID,
)
register(
    "open_errors", lambda s, d: ss.open_errors(_said(s, d).withColumn("event_type", F.when(F.col("event_type") == "git_commit", "error_fix").otherwise(F.col("event_type")))),
    """, f AS (SELECT DISTINCT session_id, text FROM said WHERE event_type = 'git_commit'), e AS (SELECT * FROM said WHERE event_type = 'error' AND (session_id, text) NOT IN (SELECT (session_id, text) FROM f)),
    r AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC)::INT AS back, replace(text, '&amp;', '&') AS text FROM e) SELECT * FROM r WHERE back <= 5""", SAID,
)

register(
    "session_tools", lambda s, d: ss.last_tools(_ks(s, d).select(F.col("user_id").alias("session_id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("tool")), 20),
    """, r AS (SELECT user_id AS session_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM ks)
    SELECT session_id, string_agg(event_type, ' ' ORDER BY back DESC) AS tools FROM r WHERE back <= 20 GROUP BY session_id""", KS,
)
register(
    "unexpired_previews", lambda s, d: ss.unexpired(a.session_events(s, d), "2024-01-20 00:00:00", 86_400).select("id", "session_id"),
    "SELECT id, session_id FROM session_events WHERE floor(epoch(TIMESTAMP '2024-01-20 00:00:00')) - floor(epoch(created_at)) BETWEEN 0 AND 86400", a.SESSIONS,
)

# --- memory and texts


def _notes(s: SparkSession, d: str) -> DataFrame:
    return a.table(s, d, "benchmark").select(F.col("item_id").alias("id"), _text(F.element_at(F.array(F.lit("always use "), F.lit("never "), F.lit("avoid "), F.lit("we like ")), (F.col("item_id") % 4 + 1).cast("int")), F.substring_index("text", " ", 12)).alias("text"))


NOTES = "notes AS (SELECT item_id AS id, (['always use ', 'never ', 'avoid ', 'we like '])[item_id % 4 + 1] || array_to_string(string_split(text, ' ')[1:12], ' ') AS text FROM benchmark)"
register(
    "contradictions", lambda s, d: me.contradictions(_notes(s, d)),
    f""", o(p, q) AS (VALUES {', '.join("('%s', '%s')" % (x.replace("'", "''"), y.replace("'", "''")) for x, y in me.OPPOSED)}), s AS (SELECT id, lower(text) AS t, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z_][a-z0-9_.-]*'),
      lambda w: length(w) > 2 AND NOT list_contains({me.STOP_WORDS}, w))) AS w FROM notes)
    SELECT DISTINCT x.id, y.id AS other FROM s x JOIN s y ON x.id <> y.id AND len(list_intersect(x.w, y.w)) > 0 JOIN o ON (contains(x.t, p) AND contains(y.t, q)) OR (contains(x.t, q) AND contains(y.t, p))""", NOTES,
)
RANKED = """, t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), z AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
    h AS (SELECT id, len(w) AS dl, q.term, len(list_filter(w, lambda x: x = q.term)) AS tf FROM t, (SELECT unnest(['license', 'the']) AS term) q), f AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM h GROUP BY term)
    SELECT id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score FROM h JOIN f USING (term), z GROUP BY id HAVING min(tf) > 0 ORDER BY score DESC, id LIMIT 10"""
register("memory_ranked", lambda s, d: me.ranked(a.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), ["the", "license"], 10), "WITH one AS (SELECT 1)" + RANKED)


def _filled(s: SparkSession, d: str) -> DataFrame:
    titles = a.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return me.filled(me.ranked(titles, ["widget", "small"], 5), me.alike(titles, "small widgets"), 40)


register("memory_filled", _filled)
register(
    "html_texts", lambda s, d: a.table(s, d, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("text")),
    "WITH a AS (SELECT page_id, html AS t FROM pages), "
    + ", ".join(f"h{i} AS (SELECT page_id, regexp_replace(t, '{p}', {'chr(10)' if n else chr(39) * 2}, 'g') AS t FROM {f'h{i - 1}' if i else 'a'})" for i, (p, n) in enumerate(tx.html_rules()))
    + ", e AS (SELECT page_id, " + "".join("replace(" for _ in tx.ENTITIES) + "t" + "".join(", '%s', '%s')" % (k, v.replace("'", "''")) for k, v in tx.ENTITIES.items()) + f" AS t FROM h{len(tx.html_rules()) - 1})"
    + r" SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM e",
)
