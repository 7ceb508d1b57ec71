"""Registered queries of scalar functions, of bundles of figures and of upkeep, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import FLOWS, PACKED, SAVED, G, register
from .functions import scalars as sf
from .operators import graph as g
from .operators import lookups as lo
from .operators import scoring as sc
from .operators import telemetry as te
from .operators import traverse as tr
from .plans import adapters as a


def _on_nodes(s: SparkSession, d: str) -> DataFrame:
    q, p = F.col("qualified_name"), F.col("file_path")
    deep = F.concat(F.lit("/root/proj/package/src/"), F.regexp_replace(F.col("name"), "[^A-Za-z0-9]+", "_"), F.lit("/"), p)
    return a.nodes(s, d).select(
        "qualified_name", sf.is_pascal(F.col("name")).alias("pascal"), sf.is_snake(F.regexp_replace("name", " ", "_")).alias("snake"), sf.last_part(q).alias("last"), sf.file_part(q).alias("file"),
        sf.short_path(deep, 40).alias("short"), sf.short_line(F.col("name"), 12).alias("line"), sf.short_image(p).alias("image"), sf.relative_path(deep, "/root/proj").alias("relative"),
        F.array_join(sf.package_parts(deep), "|").alias("parts"), sf.question_slug(F.concat(F.lit("Where is "), "name", F.lit("_used?"))).alias("slug"),
        sf.ignored(p, ["part/**", "*2/supplier.py", "nation/?"]).alias("ignored"),
    )


register(
    "name_functions", _on_nodes,
    r"""SELECT qualified_name, regexp_matches(name, '^[A-Z][a-z]') AS pascal, contains(replace(name, ' ', '_'), '_') AND regexp_matches(name, '[a-zA-Z]') AS snake, split_part(qualified_name, '::', -1) AS last, split_part(qualified_name, '::', 1) AS file,
      CASE WHEN length(deep) > 40 THEN '/.../' || split_part(deep, '/', -2) || '/' || split_part(deep, '/', -1) ELSE deep END AS short, CASE WHEN length(name) > 12 THEN substr(name, 1, 9) || '...' ELSE name END AS line,
      split_part(file_path, '/', -1) AS image, substr(deep, 12) AS relative, array_to_string(list_filter(string_split(deep, '/')[:-2], lambda x: length(x) >= 4 AND x NOT IN ('home', 'src', 'lib', 'app')), '|') AS parts,
      substr(trim(regexp_replace(regexp_replace(lower('Where is ' || name || '_used?'), '[^\w\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-'), 1, 60) AS slug,
      starts_with(file_path, 'part/') OR file_path LIKE '%2/supplier.py' OR regexp_matches(file_path, '^nation/.$') AS ignored
    FROM (SELECT *, '/root/proj/package/src/' || regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g') || '/' || file_path AS deep FROM nodes)""", a.NODES,
)


def _on_documents(s: SparkSession, d: str) -> DataFrame:
    indented = F.concat(F.lit("    "), F.regexp_replace("text", "\n", "\n    "))
    # Long texts are dealt to a task for each MB of files, which scans of a few files don't give.
    documents = a.table(s, d, "documents").select("doc_id", "text", "n_chars").repartition(a.tasks_for(s, d, ["documents"], 1), "doc_id")
    return documents.select(
        "doc_id", sf.human_size(F.col("n_chars") * F.col("doc_id")).alias("size"), sf.content_hash(F.col("text")).alias("hash"),
        (sf.body_hash(indented) == sf.body_hash(F.col("text"))).alias("same_body"), sf.body_hash(F.lit("  a\n    b\n\n  c\n")).alias("body"),
    )


register(
    "content_hashes", _on_documents,
    """WITH n AS (SELECT *, n_chars * doc_id AS n FROM documents)
    SELECT doc_id, CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN printf('%.1fK', round(n / 1024, 1)) ELSE printf('%.1fM', round(n / 1048576, 1)) END AS size, sha256(text) AS hash, true AS same_body,
      substr(sha256('a' || chr(10) || '  b' || chr(10) || chr(10) || 'c'), 1, 16) AS body FROM n""",
)


def _on_events(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    ports = F.concat(F.lit("0.0.0.0:80"), k, F.lit("->80/tcp, :::80"), k, F.lit("->80/tcp, 0.0.0.0:9->9/tcp"), F.when(k.cast("int") % 2 == 0, ", 0.0.0.0:7->7/tcp").otherwise(""))
    text = F.when(k.cast("int") % 3 == 0, "not json").otherwise(F.col("props"))
    return a.table(s, d, "events").select("event_id", sf.short_ports(ports).alias("ports"), sf.json_kind(text).alias("kind"), F.size(sf.decoded(text)).alias("n_fields"))


register(
    "event_functions", _on_events,
    """WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
    SELECT event_id, '80' || k || ', 9' || CASE WHEN k % 2 = 0 THEN ', ... +1' ELSE '' END AS ports, CASE WHEN k % 3 <> 0 THEN 'OBJECT<k: BIGINT>' END AS kind, CASE WHEN k % 3 <> 0 THEN 1 ELSE 0 END AS n_fields FROM k""",
)


def _full_stats(s: SparkSession, d: str) -> DataFrame:
    """Totals, and the same by tool and by intensity, in one scan: (what, value, ...)."""
    t = te.savings(a.telemetry(s, d)).where("event_type = 'compress'")
    sets = t.withColumn("by", F.explode(F.array(F.struct(F.lit("all").alias("what"), F.lit("").alias("value")), F.struct(F.lit("tool").alias("what"), F.col("tool_name").alias("value")), F.struct(F.lit("intensity").alias("what"), F.col("intensity").alias("value")))))
    return sets.groupBy("by.what", "by.value").agg(F.count("*").alias("n_events"), F.sum("saved_tokens").cast("long").alias("saved"), F.round(F.avg("savings_pct"), 1).alias("avg_pct"))


register(
    "full_stats", _full_stats,
    """, c AS (SELECT * FROM saved WHERE event_type = 'compress')
    SELECT what, value, count(*) AS n_events, sum(saved_tokens)::BIGINT AS saved, round(avg(savings_pct), 1) AS avg_pct FROM (SELECT *, unnest([{'what': 'all', 'value': ''}, {'what': 'tool', 'value': tool_name}, {'what': 'intensity', 'value': intensity}], recursive := true) FROM c) GROUP BY 1, 2""", SAVED,
)
register(
    "symbol_stats", lambda s, d: a.nodes(s, d).groupBy(F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("none")).alias("spoken")).agg(F.count("*").alias("n_symbols"), F.count_distinct("file_path").alias("n_files")),
    "SELECT coalesce(nullif(language, ''), 'none') AS spoken, count(*) AS n_symbols, count(DISTINCT file_path) AS n_files FROM nodes GROUP BY 1", a.NODES,
)
register(
    "pipeline_summary", lambda s, d: a.pipeline_runs(s, d).groupBy("pipeline").agg(F.count("*").alias("n_files"), F.count_if(F.col("duration_ms") > 500).alias("n_parsed"), F.count_if(F.col("duration_ms") <= 500).alias("n_errors")),
    "SELECT pipeline, count(*) AS n_files, count(*) FILTER (WHERE duration_ms > 500) AS n_parsed, count(*) FILTER (WHERE duration_ms <= 500) AS n_errors FROM pipeline_runs GROUP BY 1", a.RUNS,
)
register(
    "retained_events", lambda s, d: a.session_events(s, d).where(F.col("created_at") >= F.expr("timestamp_ntz'2024-01-30 00:00:00' - interval 14 days")).select("id", "session_id"),
    "SELECT id, session_id FROM session_events WHERE created_at >= TIMESTAMP '2024-01-16 00:00:00'", a.SESSIONS,
)


def _retraced(s: SparkSession, d: str) -> DataFrame:
    """The stored flows with those that touch the changed files traced anew from their entries."""
    n, e = a.nodes(s, d), a.edges(s, d)
    old = tr.settled(tr.flows(n, e).withColumnRenamed("entry", "flow_id"))
    gone = lo.flows_through(old, n, s.createDataFrame([("part/Brand#11.md",)], "file_path string"))
    left = e.where("not (kind = 'CALLS' and target in ('part::1', 'part::2'))")
    return tr.retraced(old, gone, n, left).withColumnRenamed("flow_id", "entry")


register(
    "retraced_flows", _retraced,
    """, gone AS (SELECT DISTINCT entry FROM flows JOIN nodes ON node = qualified_name WHERE file_path = 'part/Brand#11.md'),
    c2 AS (SELECT * FROM calls WHERE target NOT IN ('part::1', 'part::2')),
    w2 AS (SELECT entry, entry AS node, 0 AS depth FROM gone UNION SELECT entry, target, depth + 1 FROM w2 JOIN c2 ON node = source WHERE depth < 15),
    f2 AS (SELECT entry, node, min(depth) AS depth FROM w2 GROUP BY 1, 2)
    SELECT entry, node, depth FROM flows WHERE entry NOT IN (SELECT entry FROM gone) UNION ALL SELECT * FROM f2 WHERE entry IN (SELECT entry FROM f2 GROUP BY entry HAVING count(*) > 1)""", *G, FLOWS,
)

# --- commands, relations, budgets and hits

BAD = ["rm -rf /", "rm -fr /etc", "sudo ls", "dd if=/dev/zero of=x", "chmod -R 777 /", "ls -la", "rm -rf build", "chmod 755 a", "reboot now"]


def _guarded(s: SparkSession, d: str) -> DataFrame:
    command = F.element_at(F.array(*map(F.lit, BAD)), (F.col("event_id") % len(BAD) + 1).cast("int"))
    relation = F.element_at(F.array(*map(F.lit, [*sf.RELATIONS, "owns"])), (F.col("event_id") % (len(sf.RELATIONS) + 1) + 1).cast("int"))
    return a.table(s, d, "events").select("event_id", sf.denied(command).alias("denied"), sf.edge_kind(relation).alias("kind"))


register(
    "guarded_commands", _guarded,
    f"SELECT event_id, event_id % {len(BAD)} NOT IN (1, 5, 6, 7) AS denied, ({[*sf.RELATIONS.values(), 'OWNS']})[event_id % {len(sf.RELATIONS) + 1} + 1] AS kind FROM events",
)
register(
    "budgeted_walk", lambda s, d: tr.within_budget(tr.reach(a.edges(s, d), s.createDataFrame([("nation::3",)], "node string"), 3, directed=True), 2_000),
    """, w AS (SELECT 'nation::3' AS node, 0 AS depth UNION SELECT target, depth + 1 FROM w JOIN edges ON node = source WHERE depth < 3), m AS (SELECT node, min(depth) AS depth FROM w GROUP BY node),
    c AS (SELECT node, depth, sum(length(node) // 4 + 10) OVER (ORDER BY depth, node)::BIGINT AS spent FROM m) SELECT * FROM c WHERE spent <= 2000""", a.EDGES,
)
register(
    "enriched_hits", lambda s, d: lo.enriched(a.nodes(s, d), a.edges(s, d), "Widget"),
    """, h AS (SELECT qualified_name, name, community_id FROM nodes WHERE NOT is_test AND kind <> 'File' AND contains(lower(name), 'widget') ORDER BY qualified_name LIMIT 5),
    i AS (SELECT target, source, row_number() OVER (PARTITION BY target ORDER BY source) AS k FROM edges WHERE kind = 'CALLS' AND target IN (SELECT qualified_name FROM h)),
    o AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS k FROM edges WHERE kind = 'CALLS' AND source IN (SELECT qualified_name FROM h)),
    x AS (SELECT target AS q, string_agg(source, ',' ORDER BY source) AS callers FROM i WHERE k <= 5 GROUP BY 1), y AS (SELECT source AS q, string_agg(target, ',' ORDER BY target) AS callees FROM o WHERE k <= 5 GROUP BY 1)
    SELECT qualified_name, name, community_id, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees FROM h LEFT JOIN x ON x.q = qualified_name LEFT JOIN y ON y.q = qualified_name""", *G,
)
register(
    "packed_items", lambda s, d: sc.packed_items(sc.pack_score(a.candidates(s, d), "small widget"), 200),
    """), l AS (SELECT query_id, list({'id': id, 'cost': cost::BIGINT, 'used': 0::BIGINT, 'ids': ''} ORDER BY score / greatest(cost, 1) DESC, id) AS x FROM scored GROUP BY query_id),
    r AS (SELECT query_id, list_reduce(list_prepend({'id': 0, 'cost': 0::BIGINT, 'used': 0::BIGINT, 'ids': ''}, x), lambda s, i: CASE WHEN s.used + i.cost <= 200 THEN {'id': 0, 'cost': 0::BIGINT, 'used': s.used + i.cost, 'ids': CASE WHEN s.ids = '' THEN '' ELSE s.ids || ',' END || i.id} ELSE s END) AS p FROM l)
    SELECT query_id, p.ids AS ids FROM r""", "candidates AS (" + PACKED,
)


def _marked(s: SparkSession, d: str) -> DataFrame:
    """Nodes of which some have names, decorators or files that tell entry points and tests."""
    n = a.nodes(s, d)
    key = F.length("name") * 7 + F.col("line_end")
    return n.withColumns({
        "name": F.when(key % 11 == 0, F.concat(F.lit("handle_"), "name")).otherwise(F.col("name")),
        "decorators": F.when(key % 5 == 0, "@app.get('/x')\n@cached").when(key % 5 == 1, "@cached"),
        "file_path": F.when(key % 13 == 0, F.concat("file_path", F.lit("/test_x.py"))).otherwise(F.col("file_path")),
    })


register(
    "entry_points", lambda s, d: tr.entry_points(_marked(s, d), a.edges(s, d)),
    """, k AS (SELECT *, length(name) * 7 + line_end AS key FROM nodes), c AS (SELECT DISTINCT target FROM edges WHERE kind = 'CALLS' AND source NOT IN (SELECT qualified_name FROM nodes WHERE kind = 'File')),
    w AS (SELECT qualified_name, CASE WHEN qualified_name NOT IN (SELECT target FROM c) THEN 'uncalled' WHEN key % 5 = 0 THEN 'decorator' WHEN key % 11 = 0 THEN 'name' END AS why FROM k WHERE kind = 'Function' AND NOT is_test AND key % 13 <> 0)
    SELECT * FROM w WHERE why IS NOT NULL""", *G,
)
register(
    "dead_marked_code", lambda s, d: g.dead_code(_marked(s, d), a.edges(s, d).where("kind <> 'DEPENDS_ON'")),
    """, k AS (SELECT *, length(name) * 7 + line_end AS key FROM nodes)
    SELECT qualified_name, kind, file_path FROM k WHERE kind IN ('Function', 'Class') AND NOT is_test AND key % 13 <> 0 AND key % 11 <> 0 AND key % 5 <> 0
    AND qualified_name NOT IN (SELECT target FROM edges WHERE kind = 'CALLS') AND qualified_name NOT IN (SELECT source FROM edges WHERE kind = 'TESTED_BY')""", *G,
)
