"""Registered queries over the driver tables and their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import graph as g
from .operators import scoring as sc
from .operators import search as se
from .operators import telemetry as te
from .operators import traverse as tr
from .plans import adapters as a

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, run: Callable, sql: str | None = None, *ctes: str) -> None:
    """Add a query that gets the session and folder, and the SQL of its rows behind the CTEs it needs."""
    QUERIES[name] = run
    if sql:
        ORACLE[name] = f"WITH RECURSIVE {", ".join(ctes)}{sql if sql.startswith(",") else " " + sql}" if ctes else sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def _graph(run: Callable) -> Callable:
    return lambda s, d: run(a.nodes(s, d), a.edges(s, d))


G = (a.NODES, a.EDGES)

# --- graph statistics, look-ups and relations

register("graph_stats", _graph(te.graph_stats), "SELECT 'node' AS what, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind", *G)
register(
    "unified_stats", lambda s, d: te.unified_stats(a.nodes(s, d), ["kind", "file_type", "language"]),
    " UNION ALL ".join(f"SELECT '{c}' AS what, coalesce(nullif({c}, ''), 'unknown') AS value, count(*) AS n FROM nodes GROUP BY 2" for c in ("kind", "file_type", "language")), a.NODES,
)
register(
    "large_nodes", lambda s, d: g.large_nodes(a.nodes(s, d), 40, 60),
    "SELECT qualified_name, kind, line_end - line_start + 1 AS n_lines FROM nodes WHERE line_end - line_start + 1 BETWEEN 40 AND 60", a.NODES,
)
for _pattern, _sql in {
    "callers_of": "SELECT target AS node, source AS peer, 'callers_of' AS role FROM edges WHERE kind = 'CALLS'",
    "callees_of": "SELECT source AS node, target AS peer, 'callees_of' AS role FROM edges WHERE kind = 'CALLS'",
    "imports_of": "SELECT source AS node, target AS peer, 'imports_of' AS role FROM edges WHERE kind = 'DEPENDS_ON'",
    "tests_for": "SELECT source AS node, target AS peer, 'tests_for' AS role FROM edges WHERE kind = 'TESTED_BY'",
    "contains": "SELECT source AS node, target AS peer, 'contains' AS role FROM edges WHERE kind = 'CONTAINS'",
    "references": "SELECT source AS node, target AS peer, 'out' AS role FROM edges WHERE kind <> 'CONTAINS' UNION ALL SELECT target, source, 'in' FROM edges WHERE kind <> 'CONTAINS'",
}.items():
    register(_pattern, lambda s, d, p=_pattern: g.relations(a.edges(s, d), p), _sql, a.EDGES)
register(
    "neighbors", lambda s, d: g.neighbors(a.nodes(s, d), a.edges(s, d), "part::1"),
    """, near AS (SELECT target AS peer, kind, 'out' AS direction FROM edges WHERE source = 'part::1' UNION ALL SELECT source, kind, 'in' FROM edges WHERE target = 'part::1')
    SELECT direction, near.kind, peer, nodes.kind AS peer_kind, file_path FROM near LEFT JOIN nodes ON peer = qualified_name""", *G,
)
register(
    "induced_subgraph", lambda s, d: g.induced(a.edges(s, d), a.nodes(s, d).where("file_type = 'code'")).select("kind", "source", "target"),
    "SELECT kind, source, target FROM edges WHERE source IN (SELECT qualified_name FROM nodes WHERE file_type = 'code') AND target IN (SELECT qualified_name FROM nodes WHERE file_type = 'code')", *G,
)
register(
    "called_targets", _graph(g.callers_outside_files),
    "SELECT DISTINCT target FROM edges LEFT JOIN nodes ON source = qualified_name WHERE edges.kind = 'CALLS' AND (nodes.kind IS NULL OR nodes.kind <> 'File')", *G,
)
register(
    "resolve_bare_names", lambda s, d: g.resolve_by_name(a.nodes(s, d).select(F.col("qualified_name").alias("call_id"), "name"), a.nodes(s, d)),
    """, u AS (SELECT name, min(qualified_name) AS target FROM nodes GROUP BY name HAVING count(*) = 1)
    SELECT qualified_name AS call_id, name, target FROM nodes JOIN u USING (name)""", a.NODES,
)
register(
    "range_overlap", lambda s, d: g.range_overlap(a.nodes(s, d), a.diff_ranges(s, d)),
    "SELECT DISTINCT qualified_name, n.file_path, line_start, line_end FROM nodes n JOIN diff_ranges r ON n.file_path = r.file_path AND line_start <= stop AND line_end >= start", a.NODES, a.DIFFS,
)
register(
    "innermost_function", lambda s, d: g.enclosing(a.nodes(s, d), a.diff_ranges(s, d).select("file_path", F.col("start").alias("line")).distinct()),
    """, points AS (SELECT DISTINCT file_path, start AS line FROM diff_ranges),
    ranked AS (SELECT p.file_path, line, qualified_name, row_number() OVER (PARTITION BY p.file_path, line ORDER BY line_end - line_start, qualified_name) AS k
      FROM points p JOIN nodes n ON p.file_path = n.file_path AND line BETWEEN line_start AND line_end AND n.kind <> 'File')
    SELECT file_path, line, qualified_name FROM ranked WHERE k = 1""", a.NODES, a.DIFFS,
)
register(
    "version_changes", lambda s, d: g.version_changes(*a.file_versions(s, d)),
    """SELECT coalesce(b.path, c.path) AS path, CASE WHEN c.hash IS NULL THEN 'removed' WHEN b.hash IS NULL THEN 'added' WHEN b.hash <> c.hash THEN 'modified' ELSE 'same' END AS change
    FROM before b FULL JOIN after c ON b.path = c.path""", a.VERSIONS,
)

# --- metrics of the graph

ENDS = "ends AS (SELECT source AS node, target AS peer, 1 AS o FROM edges UNION ALL SELECT target, source, 0 FROM edges), degrees AS (SELECT node, sum(o)::BIGINT AS out_degree, (count(*) - sum(o))::BIGINT AS in_degree, count(*) AS degree FROM ends GROUP BY node)"
register("degrees", lambda s, d: g.degrees(a.edges(s, d)), "SELECT * FROM degrees", a.EDGES, ENDS)
register(
    "hub_nodes", _graph(lambda n, e: g.hubs(n, e, 10)),
    "SELECT node, out_degree, in_degree, degree, name, kind FROM degrees JOIN nodes ON node = qualified_name WHERE kind <> 'File' ORDER BY degree DESC, node LIMIT 10", *G, ENDS,
)
register(
    "god_nodes", _graph(lambda n, e: g.god_nodes(n, e, 10, "code")),
    """, c AS (SELECT qualified_name FROM nodes WHERE file_type = 'code'),
    s AS (SELECT DISTINCT source, target FROM edges WHERE source IN (FROM c) AND target IN (FROM c)),
    e2 AS (SELECT source AS node FROM s UNION ALL SELECT target FROM s)
    SELECT node, count(*) AS degree FROM e2 GROUP BY node ORDER BY degree DESC, node LIMIT 10""", *G,
)
register(
    "isolated_nodes", _graph(lambda n, e: g.isolated(n, e)),
    """SELECT qualified_name, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degrees ON node = qualified_name WHERE kind <> 'File' AND coalesce(degree, 0) <= 1""", *G, ENDS,
)
register(
    "untested_hotspots", _graph(lambda n, e: g.untested_hotspots(n, e, 5, 20)),
    """SELECT node, degree FROM degrees WHERE degree >= 5 AND node IN (SELECT qualified_name FROM nodes WHERE NOT is_test AND kind <> 'File')
    AND node NOT IN (SELECT source FROM edges WHERE kind = 'TESTED_BY') ORDER BY degree DESC, node LIMIT 20""", *G, ENDS,
)
register(
    "single_file_communities", lambda s, d: g.single_file_communities(a.nodes(s, d)),
    "SELECT community_id, count(*) AS n, count(DISTINCT file_path) AS files FROM nodes WHERE community_id IS NOT NULL GROUP BY community_id HAVING count(DISTINCT file_path) = 1 AND count(*) >= 3", a.NODES,
)
COMMUNITY_ENDS = """ce AS (SELECT e.kind, source, target, x.community_id AS a, y.community_id AS b FROM edges e
  LEFT JOIN nodes x ON source = x.qualified_name LEFT JOIN nodes y ON target = y.qualified_name)"""
register(
    "cohesion", _graph(g.cohesion),
    """, sides AS (SELECT a AS c, 1 AS i FROM ce WHERE a = b UNION ALL SELECT a, 0 FROM ce WHERE a IS DISTINCT FROM b AND a IS NOT NULL UNION ALL SELECT b, 0 FROM ce WHERE a IS DISTINCT FROM b AND b IS NOT NULL)
    SELECT c AS community_id, sum(i)::BIGINT AS internal, (count(*) - sum(i))::BIGINT AS external, round(sum(i) / count(*), 6) AS cohesion FROM sides GROUP BY c""", *G, COMMUNITY_ENDS,
)
register(
    "cross_community", _graph(lambda n, e: g.cross_community(n, e, 10)),
    "SELECT least(a, b) AS first, greatest(a, b) AS second, count(*) AS n_edges FROM ce WHERE kind <> 'TESTED_BY' AND a <> b GROUP BY 1, 2 HAVING count(*) > 10", *G, COMMUNITY_ENDS,
)
register(
    "surprising_edges", _graph(lambda n, e: g.surprising(n, e, 50)),
    """, m AS (SELECT min(degree) AS median FROM (SELECT degree, row_number() OVER (ORDER BY degree) AS r, count(*) OVER () AS n FROM degrees) WHERE r > n // 2),
    info AS (SELECT qualified_name, community_id, CASE WHEN contains(file_path, '.') THEN split_part(file_path, '.', -1) ELSE '' END AS ext, is_test, kind AS nkind, degree
      FROM nodes LEFT JOIN degrees ON node = qualified_name),
    scored AS (SELECT e.kind, source, target, round(
      CASE WHEN x.community_id <> y.community_id THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN x.ext <> y.ext THEN 0.2::DOUBLE ELSE 0 END
      + CASE WHEN (x.degree <= 2 AND y.degree >= greatest(median * 3, 10)) OR (y.degree <= 2 AND x.degree >= greatest(median * 3, 10)) THEN 0.2::DOUBLE ELSE 0 END
      + CASE WHEN e.kind = 'CALLS' AND x.is_test <> y.is_test THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN e.kind = 'CALLS' AND x.nkind = 'Class' THEN 0.15::DOUBLE ELSE 0 END, 2) AS score
      FROM edges e JOIN info x ON source = x.qualified_name JOIN info y ON target = y.qualified_name CROSS JOIN m)
    SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, source, target, kind LIMIT 50""", *G, ENDS,
)
register(
    "move_suggestions", _graph(g.move_suggestions),
    """, c AS (SELECT qualified_name, community_id AS c FROM nodes WHERE community_id IS NOT NULL),
    p AS (SELECT target, min(c) AS low, max(c) AS high FROM edges JOIN c ON source = qualified_name WHERE kind = 'CALLS' GROUP BY target HAVING min(c) = max(c))
    SELECT target, c AS from_community, low AS to_community FROM p JOIN c ON target = qualified_name WHERE low <> c""", *G,
)
register(
    "dead_code", _graph(g.dead_code),
    """SELECT qualified_name, kind, file_path FROM nodes WHERE kind IN ('Function', 'Class') AND NOT is_test
    AND qualified_name NOT IN (SELECT target FROM edges WHERE kind IN ('CALLS', 'DEPENDS_ON') UNION SELECT source FROM edges WHERE kind = 'TESTED_BY')""", *G,
)
register(
    "file_roll_up", _graph(g.roll_up),
    "SELECT x.file_path AS from_file, y.file_path AS to_file, count(*) AS n_edges FROM edges JOIN nodes x ON source = x.qualified_name JOIN nodes y ON target = y.qualified_name WHERE x.file_path <> y.file_path GROUP BY 1, 2", *G,
)
register(
    "differing_file_types", _graph(g.differing_types),
    "SELECT e.kind, x.file_type AS from_type, y.file_type AS to_type, count(*) AS n FROM edges e JOIN nodes x ON source = x.qualified_name JOIN nodes y ON target = y.qualified_name WHERE x.file_type <> y.file_type GROUP BY 1, 2, 3", *G,
)

# --- walks

UNDIRECTED = "steps AS (SELECT DISTINCT source AS node, target AS next FROM edges UNION SELECT DISTINCT target, source FROM edges)"


def _impact(s: SparkSession, d: str) -> DataFrame:
    seeds = a.nodes(s, d).where("file_path = 'nation/0/customer.py'").select(F.col("qualified_name").alias("node"))
    return tr.reach(a.edges(s, d).where("kind <> 'CONTAINS'"), seeds, 2)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything within two steps of one file's nodes."""
    return _impact(spark, sf_dir)


register(
    "impact_radius", _impact,
    """, w AS (SELECT qualified_name AS node, 0 AS depth FROM nodes WHERE file_path = 'nation/0/customer.py'
      UNION SELECT next, depth + 1 FROM w JOIN (SELECT source AS node, target AS next FROM edges WHERE kind <> 'CONTAINS' UNION SELECT target, source FROM edges WHERE kind <> 'CONTAINS') s ON w.node = s.node WHERE depth < 2)
    SELECT node, min(depth) AS depth FROM w GROUP BY node""", *G,
)
register(
    "impact_capped", lambda s, d: tr.impact(a.nodes(s, d), a.edges(s, d).where("kind <> 'CONTAINS'"), a.nodes(s, d).where("file_path = 'nation/0/customer.py'").select("file_path"), 2, 50),
    """, w AS (SELECT qualified_name AS node, 0 AS depth FROM nodes WHERE file_path = 'nation/0/customer.py'
      UNION SELECT next, depth + 1 FROM w JOIN (SELECT source AS node, target AS next FROM edges WHERE kind <> 'CONTAINS' UNION SELECT target, source FROM edges WHERE kind <> 'CONTAINS') s ON w.node = s.node WHERE depth < 2),
    f AS (SELECT node, min(depth) AS depth FROM w GROUP BY node)
    SELECT f.node, kind, file_path, depth, (SELECT count(*) > 50 FROM f) AS truncated FROM f LEFT JOIN nodes ON qualified_name = f.node ORDER BY depth, f.node LIMIT 50""", *G,
)
register(
    "bfs_tree", lambda s, d: tr.reach(a.edges(s, d).where("kind <> 'TESTED_BY'"), a.nodes(s, d).where("qualified_name = 'nation::3'").select(F.col("qualified_name").alias("node")), 3, directed=True),
    """, w AS (SELECT 'nation::3' AS node, 0 AS depth UNION SELECT target, depth + 1 FROM w JOIN edges ON node = source AND kind <> 'TESTED_BY' WHERE depth < 3)
    SELECT node, min(depth) AS depth FROM w GROUP BY node""", a.EDGES,
)
register(
    "shortest_path", lambda s, d: tr.shortest_path(a.edges(s, d), "customer::1", "region::2").select("step", "node"),
    """, w AS (SELECT 'customer::1' AS node, 0 AS depth UNION SELECT next, depth + 1 FROM w JOIN steps ON w.node = steps.node WHERE depth < 6),
    d AS (SELECT node, min(depth) AS depth FROM w GROUP BY node),
    up AS (SELECT s.next AS node, min(s.node) AS parent FROM steps s JOIN d x ON x.node = s.next JOIN d y ON y.node = s.node AND y.depth = x.depth - 1 GROUP BY s.next),
    b AS (SELECT node, depth FROM d WHERE node = 'region::2' UNION ALL SELECT parent, b.depth - 1 FROM b JOIN up ON up.node = b.node WHERE b.depth > 0)
    SELECT depth AS step, node FROM b""", a.EDGES, UNDIRECTED,
)
register(
    "dependent_files", lambda s, d: tr.dependents(a.nodes(s, d), a.edges(s, d), s.createDataFrame([("nation/1/supplier.py",)], "file_path string")),
    """, fe AS (SELECT DISTINCT y.file_path AS used, x.file_path AS uses FROM edges e JOIN nodes x ON source = x.qualified_name JOIN nodes y ON target = y.qualified_name
      WHERE e.kind IN ('CALLS', 'DEPENDS_ON') AND x.file_path <> y.file_path),
    w AS (SELECT 'nation/1/supplier.py' AS f, 0 AS hops UNION SELECT uses, hops + 1 FROM w JOIN fe ON f = used WHERE hops < 2)
    SELECT f AS file_path, min(hops) AS hops FROM w GROUP BY f HAVING min(hops) > 0""", *G,
)
register(
    "transitive_tests", lambda s, d: tr.transitive_tests(a.edges(s, d), a.nodes(s, d).where("file_path = 'nation/2/customer.py'").select(F.col("qualified_name").alias("node"))),
    """, n0 AS (SELECT qualified_name AS node FROM nodes WHERE file_path = 'nation/2/customer.py'),
    w AS (SELECT node, 0 AS depth FROM n0 UNION SELECT target, 1 FROM n0 JOIN edges ON node = source AND kind = 'CALLS'),
    m AS (SELECT node, min(depth) AS depth FROM w GROUP BY node)
    SELECT target AS test, min(depth) > 0 AS indirect FROM m JOIN edges ON node = source AND kind = 'TESTED_BY' GROUP BY target""", *G,
)
FLOWS = """calls AS (SELECT source, target FROM edges WHERE kind = 'CALLS'),
  entries AS (SELECT qualified_name AS node FROM nodes WHERE kind = 'Function' AND NOT is_test AND qualified_name NOT IN (SELECT target FROM calls)),
  walk AS (SELECT node AS entry, node, 0 AS depth FROM entries UNION SELECT entry, target, depth + 1 FROM walk JOIN calls ON node = source WHERE depth < 15),
  steps AS (SELECT entry, node, min(depth) AS depth FROM walk GROUP BY 1, 2),
  flows AS (SELECT * FROM steps WHERE entry IN (SELECT entry FROM steps GROUP BY entry HAVING count(*) > 1))"""
register("flows", _graph(tr.flows), "SELECT entry, node, depth FROM flows", *G, FLOWS)


def _criticality(s: SparkSession, d: str) -> DataFrame:
    n, e = a.nodes(s, d), a.edges(s, d)
    tested = e.where("kind = 'TESTED_BY'").select(F.col("source").alias("node")).distinct().withColumn("t", F.lit(True))
    info = n.select(F.col("qualified_name").alias("node"), "file_path", F.col("name").rlike("(?i)gadget|lock").alias("secure"), (F.col("confidence_score") < 0.5).cast("int").alias("external"))
    members = tr.flows(n, e).join(info, "node").join(tested, "node", "left").withColumn("tested", F.coalesce("t", F.lit(False)))
    return g.criticality(members.withColumnRenamed("entry", "flow_id"))


register(
    "flow_criticality", _criticality,
    """, m AS (SELECT f.entry AS flow_id, file_path, regexp_matches(name, '(?i)gadget|lock') AS secure, (confidence_score < 0.5)::INT AS ext, f.node IN (SELECT source FROM edges WHERE kind = 'TESTED_BY') AS tested, depth
      FROM flows f JOIN nodes ON f.node = qualified_name),
    p AS (SELECT flow_id, count(*) AS n, count(DISTINCT file_path) AS files, sum(ext) AS ext, count(*) FILTER (WHERE secure) AS sec, count(*) FILTER (WHERE tested) AS tst, max(depth) AS dp FROM m GROUP BY flow_id)
    SELECT flow_id, least((2 * ((750 * least(files - 1, 4) + 400 * least(ext, 5) + 100 * least(dp, 10)) * n + 2500 * sec + 1500 * (n - tst)) + n) // (2 * n), 10000) / 10000.0::DOUBLE AS criticality
    FROM p""", *G, FLOWS,
)

# --- telemetry, sessions, memory

SAVED = a.TELEMETRY + ", saved AS (SELECT *, before_tokens - after_tokens AS saved_tokens, CASE WHEN before_tokens > 0 THEN (before_tokens - after_tokens)::DOUBLE / before_tokens * 100 ELSE 0 END AS savings_pct FROM telemetry)"
TOTALS = """count(*) AS n_events, coalesce(sum(before_tokens), 0)::BIGINT AS sum_before, coalesce(sum(after_tokens), 0)::BIGINT AS sum_after,
  coalesce(sum(saved_tokens), 0)::BIGINT AS sum_saved, round(coalesce(avg(savings_pct), 0.0), 1) AS avg_pct"""
register("compression_summary", lambda s, d: te.compression_summary(a.telemetry(s, d)), f"SELECT {TOTALS} FROM saved WHERE event_type = 'compress'", SAVED)
for _key in ("tool_name", "intensity"):
    register(f"breakdown_by_{_key}", lambda s, d, k=_key: te.breakdown(a.telemetry(s, d), k), f"SELECT {_key}, {TOTALS} FROM saved WHERE event_type = 'compress' GROUP BY {_key}", SAVED)
register(
    "disclosure", lambda s, d: te.disclosure(a.telemetry(s, d)),
    "SELECT count(*) FILTER (WHERE detail_level = 'index') AS n_index, count(*) FILTER (WHERE detail_level = 'full') AS n_full, round(count(*) FILTER (WHERE detail_level = 'full') / count(*) * 100.0::DOUBLE, 2) AS upgrade_rate FROM telemetry", a.TELEMETRY,
)
register("daily_trend", lambda s, d: te.daily_trend(a.telemetry(s, d), "2024-01-30 00:00:00", 7).withColumn("day", F.col("day").cast("string")), f"SELECT created_at::DATE::VARCHAR AS day, {TOTALS} FROM saved WHERE created_at >= TIMESTAMP '2024-01-23 00:00:00' GROUP BY 1", SAVED)
register("filter_performance", lambda s, d: te.filter_performance(a.telemetry(s, d), "click"), "SELECT round(coalesce(avg(savings_pct), 0.0), 2) AS avg_pct FROM saved WHERE tool_name = 'click'", SAVED)
register(
    "merged_trends",
    lambda s, d: te.merged_trends(
        a.telemetry(s, d).groupBy(F.to_date("created_at").alias("day")).agg(F.sum("before_tokens").alias("value")),
        a.session_events(s, d).where("priority = 1").groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("value")),
    ).withColumn("day", F.col("day").cast("string")),
    """, u AS (SELECT created_at::DATE AS day, sum(before_tokens) AS value FROM telemetry GROUP BY 1 UNION ALL SELECT created_at::DATE, count(*) FROM session_events WHERE priority = 1 GROUP BY 1)
    SELECT day::VARCHAR AS day, sum(value)::BIGINT AS value FROM u GROUP BY day""", a.TELEMETRY, a.SESSIONS,
)
ERRORS = "count(*) AS n_events, {extra}count(*) FILTER (WHERE event_type = 'error') AS n_errors, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS error_rate"
register("busy_sessions", lambda s, d: te.busy_sessions(a.session_events(s, d), 60), f"SELECT session_id, {ERRORS.format(extra='')} FROM session_events GROUP BY session_id HAVING count(*) > 60", a.SESSIONS)
register("session_totals", lambda s, d: te.session_totals(a.session_events(s, d)), f"SELECT {ERRORS.format(extra='count(DISTINCT session_id) AS n_sessions, ')} FROM session_events", a.SESSIONS)
register("event_counts", lambda s, d: te.event_counts(a.session_events(s, d), 7), "SELECT event_type, count(*) AS n FROM session_events WHERE session_id = 7 GROUP BY event_type", a.SESSIONS)
register(
    "urgent_events", lambda s, d: a.session_events(s, d).where((F.col("priority") <= 2) & (F.col("created_at") >= F.lit("2024-01-15").cast("timestamp_ntz"))).select("id", "session_id", "event_type", "priority"),
    "SELECT id, session_id, event_type, priority FROM session_events WHERE priority <= 2 AND created_at >= TIMESTAMP '2024-01-15 00:00:00'", a.SESSIONS,
)
register(
    "latest_by_type", lambda s, d: a.session_events(s, d).groupBy("session_id", "event_type").agg(F.max(F.struct("created_at", "id")).alias("m")).select("session_id", "event_type", F.col("m.id").alias("id")),
    "SELECT session_id, event_type, arg_max(id, (created_at, id)) AS id FROM session_events GROUP BY 1, 2", a.SESSIONS,
)
register(
    "markov_transitions", lambda s, d: te.transitions(a.session_events(s, d)),
    """, st AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY session_id ORDER BY created_at, id) AS dst FROM session_events),
    c AS (SELECT src, dst, count(*) AS n FROM st WHERE dst IS NOT NULL GROUP BY 1, 2)
    SELECT src, dst, n, round(n / sum(n) OVER (PARTITION BY src), 6) AS probability FROM c""", a.SESSIONS,
)
register(
    "predict_next", lambda s, d: te.predict_next(te.transitions(a.session_events(s, d))),
    """, st AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY session_id ORDER BY created_at, id) AS dst FROM session_events),
    c AS (SELECT src, dst, count(*) AS n FROM st WHERE dst IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst)::INT AS place, round(n / sum(n) OVER (PARTITION BY src), 6) AS probability FROM c)
    SELECT src, place, dst, probability FROM p WHERE place <= 3""", a.SESSIONS,
)
register("redundant_hashes", lambda s, d: te.redundant_hashes(a.pipeline_runs(s, d), 1), "SELECT file_hash, count(*) AS n_runs FROM pipeline_runs GROUP BY 1 HAVING count(*) > 1", a.RUNS)
register("runs_by_pipeline", lambda s, d: te.runs_by_pipeline(a.pipeline_runs(s, d)), "SELECT pipeline, count(*) AS n_runs, round(avg(duration_ms), 2) AS avg_ms FROM pipeline_runs GROUP BY 1", a.RUNS)
register(
    "memory_stats", lambda s, d: te.memory_stats(a.observations(s, d)).withColumns({c: F.col(c).cast("string") for c in ("oldest", "newest")}),
    "SELECT type, count(*) FILTER (WHERE NOT archived) AS active, count(*) FILTER (WHERE archived) AS archived, round(avg(importance), 3) AS avg_importance, min(created_at)::VARCHAR AS oldest, max(created_at)::VARCHAR AS newest FROM observations GROUP BY type", a.OBSERVATIONS,
)
register("importance_histogram", lambda s, d: te.importance_histogram(a.observations(s, d)), "SELECT least(floor(importance * 5), 4)::INT AS bucket, count(*) AS n FROM observations GROUP BY 1", a.OBSERVATIONS)
register("reuse_value", lambda s, d: te.reuse_value(a.observations(s, d)), "SELECT round(count(*) FILTER (WHERE archived) / count(*), 4) AS archive_rate, (sum(access_count) * 200)::BIGINT AS reuse_tokens FROM observations", a.OBSERVATIONS)
register(
    "duplicate_keepers", lambda s, d: te.duplicate_keepers(a.observations(s, d)),
    """, r AS (SELECT id, title, type, count(*) OVER w AS n, sum(access_count) OVER w AS accesses, row_number() OVER (PARTITION BY title, type ORDER BY importance DESC, id) > 1 AS archive
      FROM observations WHERE NOT archived WINDOW w AS (PARTITION BY title, type))
    SELECT id, title, type, n, accesses::BIGINT AS accesses, archive FROM r WHERE n > 1""", a.OBSERVATIONS,
)
register(
    "memory_roi", lambda s, d: sc.roi(a.observations(s, d), "2024-02-01"),
    """, r AS (SELECT id, type, round(access_count * importance / greatest(1.0::DOUBLE, (DATE '2024-02-01' - created_at) / 30.0::DOUBLE), 6) AS roi FROM observations WHERE NOT archived)
    SELECT id, roi, roi < 0.1 AND type NOT IN ('guardrail', 'convention', 'warning') AS low FROM r""", a.OBSERVATIONS,
)
register(
    "expired_memory", lambda s, d: sc.expired(a.observations(s, d), "2024-02-01"),
    """SELECT id, type FROM observations WHERE NOT archived AND access_count = 0 AND type <> 'warning'
    AND DATE '2024-02-01' - created_at >= CASE type WHEN 'note' THEN 60 WHEN 'decision' THEN 120 WHEN 'user' THEN 365 ELSE 90 END""", a.OBSERVATIONS,
)
register(
    "promoted_memory", lambda s, d: sc.promoted(a.observations(s, d)),
    "SELECT id, type, CASE type WHEN 'note' THEN 'convention' ELSE 'guardrail' END AS new_type FROM observations WHERE NOT archived AND access_count >= 5 AND type IN ('note', 'warning')", a.OBSERVATIONS,
)
register(
    "pack_scores", lambda s, d: sc.pack_score(a.candidates(s, d), "small widget").select("id", "query_id", "cost", "score"),
    """SELECT id, query_id, cost, round(0.4::DOUBLE * relevance + 0.25::DOUBLE / (1 + distance) + 0.2::DOUBLE / (1 + age_days / 30.0::DOUBLE) + 0.15::DOUBLE * least(access_count / 10.0::DOUBLE, 1.0)
      + 0.1::DOUBLE * (len(list_intersect(['small', 'widget'], string_split(lower(name), ' '))) / len(list_distinct(list_concat(['small', 'widget'], string_split(lower(name), ' '))))), 6) AS score FROM candidates""", a.CANDIDATES,
)
PACKED = ORACLE["pack_scores"].replace("SELECT id, query_id, cost, round(", ", scored AS (SELECT id, query_id, cost, round(", 1).split("AS (", 1)[1]
register(
    "pack_context", lambda s, d: sc.pack(sc.pack_score(a.candidates(s, d), "small widget"), 200),
    """), l AS (SELECT query_id, list({'cost': cost::BIGINT, 'used': 0::BIGINT, 'n': 0} ORDER BY score / greatest(cost, 1) DESC, id) AS x FROM scored GROUP BY query_id),
    r AS (SELECT query_id, len(x) AS n, list_reduce(list_prepend({'cost': 0::BIGINT, 'used': 0::BIGINT, 'n': 0}, x), lambda s, i: CASE WHEN s.used + i.cost <= 200 THEN {'cost': 0::BIGINT, 'used': s.used + i.cost, 'n': s.n + 1} ELSE s END) AS p FROM l)
    SELECT query_id, p.n::INT AS n_packed, p.used AS used, (n - p.n)::INT AS n_skipped FROM r""", "candidates AS (" + PACKED,
)

# --- text and search

register(
    "token_estimates", lambda s, d: a.table(s, d, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens")),
    "SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens FROM documents",
)
register(
    "line_windows", lambda s, d: tx.line_windows(a.table(s, d, "documents")).select("doc_id", "part", F.md5(F.col("text").cast("binary")).alias("digest")),
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
    p AS (SELECT doc_id, x, unnest(range(0, greatest(ceil((len(x) - 20) / 18)::INT, 0) + 1)) AS part FROM l)
    SELECT doc_id, part::INT AS part, md5(array_to_string(x[part * 18 + 1 : part * 18 + 20], chr(10))) AS digest FROM p""",
)
register(
    "slugs", lambda s, d: a.table(s, d, "documents").select("doc_id", tx.slug(F.col("text")).alias("slug")),
    "SELECT doc_id, substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 30) AS slug FROM documents",
)
register("compressed_texts", lambda s, d: a.table(s, d, "conversations").select("conv_id", "turn", tx.compress(F.col("text"), "ultra").alias("compressed")))
BM25_WORDS = ["the", "license", "mit"]
register(
    "bm25_top", lambda s, d: se.bm25(a.table(s, d, "documents"), BM25_WORDS, 20),
    """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
    h AS (SELECT doc_id, len(w) AS dl, q.term, len(list_filter(w, lambda x: x = q.term)) AS tf FROM t, (SELECT unnest(['the', 'license', 'mit']) AS term) q),
    p AS (SELECT * FROM h WHERE tf > 0), f AS (SELECT term, count(*) AS df FROM p GROUP BY term)
    SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score
    FROM p JOIN f USING (term) CROSS JOIN s GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""",
)
register(
    "keyword_nodes", lambda s, d: se.keyword(a.nodes(s, d), ["small", "widget"], 20),
    """SELECT qualified_name, name, CASE WHEN lower(name) = 'small widget' THEN 3 WHEN starts_with(lower(name), 'small widget') THEN 2 ELSE 1 END::INT AS score
    FROM nodes WHERE contains(lower(name), 'small') AND contains(lower(name), 'widget') ORDER BY score DESC, qualified_name LIMIT 20""", a.NODES,
)
register(
    "cosine_top", lambda s, d: se.cosine_top(a.table(s, d, "embeddings"), [1.0 if i % 3 == 0 else -0.5 for i in range(64)], 15),
    """WITH q AS (SELECT list_transform(range(64), lambda i: CASE WHEN i % 3 = 0 THEN 1.0::DOUBLE ELSE -0.5 END) AS v)
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS cosine FROM embeddings, q ORDER BY cosine DESC, vec_id LIMIT 15""",
)
register(
    "rank_fusion", lambda s, d: se.fuse([se.placed(a.table(s, d, "part"), "p_partkey", c) for c in ("p_retailprice", "p_size")], "p_partkey"),
    """WITH u AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS place FROM part UNION ALL SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 FROM part)
    SELECT p_partkey, round(sum(1.0::DOUBLE / (60 + place + 1)), 8) AS score FROM u GROUP BY p_partkey""",
)
register(
    "trigram_counts", lambda s, d: se.trigrams(a.table(s, d, "benchmark").withColumnRenamed("item_id", "doc_id")),
    """WITH t AS (SELECT item_id AS doc_id, lower(text) AS x FROM benchmark), p AS (SELECT doc_id, substr(x, i::INT, 3) AS trigram FROM (SELECT doc_id, x, unnest(range(1, length(x) - 1)) AS i FROM t WHERE length(x) >= 3))
    SELECT doc_id, trigram, count(*) AS n FROM p GROUP BY 1, 2""",
)

# --- communities, risk, cost and findings

from .operators import community as co  # noqa: E402

ROUNDS = "".join(
    f""", v{i} AS (SELECT e.a AS node, label, w FROM both_ways e JOIN l{i - 1} ON e.b = node UNION ALL SELECT node, label, 0.5 FROM l{i - 1}), s{i} AS (SELECT node, label, round(sum(w), 6) AS w FROM v{i} GROUP BY 1, 2),
    l{i} AS (SELECT node, arg_min(label, (-w, label)) AS label FROM s{i} GROUP BY node)"""
    for i in (1, 2, 3)
)
register(
    "communities", _graph(lambda n, e: co.propagate(n, e.where("kind <> 'TESTED_BY'"), 3)),
    """, once AS (SELECT least(source, target) AS a, greatest(source, target) AS b, max(CASE kind WHEN 'CALLS' THEN 1.0::DOUBLE WHEN 'CONTAINS' THEN 0.3 WHEN 'DEPENDS_ON' THEN 0.6 ELSE 0.5 END) AS w FROM edges WHERE kind <> 'TESTED_BY' AND source <> target GROUP BY 1, 2),
    both_ways AS (SELECT a, b, w FROM once UNION ALL SELECT b, a, w FROM once), l0 AS (SELECT qualified_name AS node, qualified_name AS label FROM nodes)""" + ROUNDS + """
    SELECT node, label AS community FROM l3 WHERE label IN (SELECT label FROM l3 GROUP BY label HAVING count(*) >= 2)""", *G,
)
register("folder_groups", lambda s, d: co.by_folder(a.nodes(s, d), 2), "SELECT split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) AS folder, count(*) AS n FROM nodes GROUP BY 1", a.NODES)
register("community_names", lambda s, d: co.names(a.nodes(s, d).where("community_id is not null").select(F.col("community_id").alias("community"), "name", "file_path")))

# --- order-dependent operators

from .operators import sequences as sq  # noqa: E402

register(
    "output_cap", lambda s, d: sq.output_cap(a.table(s, d, "documents"), "source", "doc_id", 40_000),
    """WITH r AS (SELECT source, doc_id, strlen(text) AS size, 40000 - coalesce(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM documents)
    SELECT source, doc_id, (CASE WHEN size <= rest THEN size ELSE rest END)::BIGINT AS kept_bytes, size > rest AS cut FROM r WHERE size <= rest OR rest > 100""",
)
register("latest_runs", lambda s, d: sq.latest(a.pipeline_runs(s, d), "file_hash", "run_id", "pipeline"), "SELECT file_hash, max(run_id) AS run_id, arg_max(pipeline, run_id) AS pipeline FROM pipeline_runs GROUP BY file_hash", a.RUNS)
register(
    "ttl_hits", lambda s, d: sq.ttl_hits(a.session_events(s, d), ["session_id", "event_type"], 86_400),
    """, g AS (SELECT event_type, floor(epoch(created_at)) - floor(epoch(lag(created_at) OVER (PARTITION BY session_id, event_type ORDER BY created_at, id))) AS age FROM session_events)
    SELECT event_type, count(*) FILTER (WHERE age <= 86400) AS hits, count(*) FILTER (WHERE age IS NULL OR age > 86400) AS misses FROM g GROUP BY event_type""", a.SESSIONS,
)
register(
    "last_errors", lambda s, d: sq.last_of_type(a.session_events(s, d), "error", 5),
    """, r AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC)::INT AS place, id FROM session_events WHERE event_type = 'error')
    SELECT * FROM r WHERE place <= 5""", a.SESSIONS,
)
register(
    "session_guides", lambda s, d: sq.session_guides(a.session_events(s, d)),
    """, f AS (SELECT session_id, max(created_at) AS fixed_at FROM session_events WHERE event_type = 'purchase' GROUP BY 1),
    e AS (SELECT s.session_id, count(*) AS open_errors FROM session_events s LEFT JOIN f USING (session_id) WHERE event_type = 'error' AND (fixed_at IS NULL OR created_at > fixed_at) GROUP BY 1),
    c AS (SELECT session_id, event_type, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, event_type) AS k FROM session_events GROUP BY 1, 2),
    l AS (SELECT session_id, arg_max(event_type, (created_at, id)) AS last_event FROM session_events GROUP BY 1)
    SELECT session_id, last_event, event_type AS commonest, coalesce(open_errors, 0) AS open_errors FROM l JOIN c USING (session_id) LEFT JOIN e USING (session_id) WHERE k = 1""", a.SESSIONS,
)
register("paragraph_chunks", lambda s, d: sq.chunk_paragraphs(a.table(s, d, "documents"), 4_096))
register(
    "content_sizes", lambda s, d: a.table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("n_bytes")),
    "SELECT lang, count(*) AS n, sum(strlen(text))::BIGINT AS n_bytes FROM documents GROUP BY lang",
)

from . import catalog_code, catalog_more, catalog_outputs, catalog_scalars, catalog_search, catalog_sources  # noqa: E402, F401
