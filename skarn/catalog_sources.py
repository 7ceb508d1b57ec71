"""Registered queries of sources, sinks, chunks, changes and searches that join several of them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import COMMUNITY_ENDS, G, register
from .functions import chunks as ch
from .operators import changes as cg
from .operators import search as se
from .operators import traverse as tr
from .plans import adapters as a
from .sources import sinks as sk
from .sources import trees as ts

# --- documents, settings and API descriptions


def _markdown(s: SparkSession, d: str) -> DataFrame:
    """Documents with every third line as a heading of one to four signs, and a fence around some."""
    lines = F.split("text", "\n", -1)
    signs = F.transform(lines, lambda x, i: F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), (i % 4 + 1).cast("int")), F.lit(" "), x)).otherwise(x))
    return a.table(s, d, "documents").select("doc_id", F.array_join(signs, "\n").alias("text"))


register(
    "document_headings", lambda s, d: ts.headings(_markdown(s, d)),
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
    m AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN repeat('#', (i % 4 + 1)::INT) || ' ' || x ELSE x END AS x FROM l),
    h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INT AS at_, length(regexp_extract(x, '^(#+)', 1))::INT AS level, trim(regexp_extract(x, '^#+\s+(.+)$', 1), ' ' || chr(9) || chr(13)) AS title FROM m WHERE regexp_matches(x, '^#+\s+\S'))
    SELECT x.doc_id, x.at_ AS at, x.level, x.title, max(y.at_) AS parent FROM h x LEFT JOIN h y ON x.doc_id = y.doc_id AND y.at_ < x.at_ AND y.level < x.level GROUP BY 1, 2, 3, 4""",
)


def _settings(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"a": {"b": {"k": '), k, F.lit('}, "list": [1, 2, '), k, F.lit(']}, "type": "'), F.col("event_type"), F.lit('", "none": null}'))
    return a.table(s, d, "events").select(F.col("event_id").cast("string").alias("path"), text.alias("json"))


register(
    "setting_keys", lambda s, d: ts.setting_keys(_settings(s, d)),
    """WITH k AS (SELECT event_id::VARCHAR AS path, event_type, json_extract_string(props, '$.k') AS k FROM events)
    SELECT path, u.key, u.parent, u.depth, u.preview FROM k, LATERAL (VALUES ('a', NULL, 0, NULL), ('a.b', 'a', 1, NULL), ('a.b.k', 'a.b', 2, k.k), ('a.list', 'a', 1, '[3 items]'), ('type', NULL, 0, k.event_type), ('none', NULL, 0, NULL)) u(key, parent, depth, preview)""",
)


def _specs(s: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey").cast("string")
    ref = lambda x: F.concat(F.lit('{"$ref": "#/components/schemas/'), x, F.lit('"}'))
    text = F.concat(
        F.lit('{"paths": {"/n/'), n, F.lit('": {"get": {"responses": {"200": {"schema": '), ref(F.lit("Nation")), F.lit('}}}, "post": {"parameters": ['), ref(F.lit("Region")),
        F.lit('], "requestBody": '), ref(F.lit("Nation")), F.lit('}, "summary": "x"}}, "components": {"schemas": {"Nation": {"properties": {"r": '), ref(F.lit("Region")),
        F.lit(', "n": '), ref(F.lit("Nation")), F.lit('}}, "Region": {"type": "object"}}}}'),
    )
    return a.table(s, d, "nation").select(F.concat(n, F.lit(".json")).alias("path"), text.alias("text"))


register(
    "api_rows", lambda s, d: ts.api_rows(ts.as_json(_specs(s, d))),
    """SELECT n_nationkey || '.json' AS path, what, replace(name, '?', n_nationkey::VARCHAR) AS name, target FROM nation, (VALUES ('schema', 'Nation', NULL), ('reference', 'Nation', 'Region'), ('schema', 'Region', NULL), ('endpoint', 'GET /n/?', NULL),
      ('reference', 'GET /n/?', 'Nation'), ('endpoint', 'POST /n/?', NULL), ('reference', 'POST /n/?', 'Nation'), ('reference', 'POST /n/?', 'Region')) v(what, name, target)""",
)

# --- chunks

register("markdown_chunks", lambda s, d: ch.chunk(_markdown(s, d).withColumnRenamed("doc_id", "id"), ch.markdown_chunks, 600))
register("plain_chunks", lambda s, d: ch.chunk(a.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), ch.plain_chunks))
register(
    "json_chunks", lambda s, d: ch.chunk(_settings(s, d).select(F.col("path").alias("id"), F.col("json").alias("text")), ch.any_chunks, 40),
    """WITH k AS (SELECT event_id AS id, event_type, json_extract_string(props, '$.k') AS k FROM events)
    SELECT id, part, title, text FROM k, LATERAL (VALUES (0, 'a.b', '{"k": ' || k || '}'), (1, 'a.list[0..2]', '[1, 2, ' || k || ']'), (2, 'type', event_type), (3, 'none', 'None')) v(part, title, text)
    WHERE length('{"b": {"k": ' || k || '}, "list": [1, 2, ' || k || ']}') > 40
    UNION ALL SELECT id, part, title, text FROM k, LATERAL (VALUES (0, 'a', '{"b": {"k": ' || k || '}, "list": [1, 2, ' || k || ']}'), (1, 'type', event_type), (2, 'none', 'None')) v(part, title, text)
    WHERE length('{"b": {"k": ' || k || '}, "list": [1, 2, ' || k || ']}') <= 40""",
)

# --- changes


def _symbols(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as symbols before and after: some gone, some with other parameters, defaults, bases or returns."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(F.lit("function"), F.lit("method"), F.lit("class")), (k % 3 + 1).cast("int"))
    base = a.table(s, d, "part").select(F.col("p_brand").alias("path"), k.cast("string").alias("symbol"), kind.alias("kind"), k.alias("k"))
    cols = lambda df, params, n, returns, bases: df.select("path", "symbol", "kind", params.alias("params"), n.cast("int").alias("n_defaults"), returns.alias("returns"), bases.alias("bases"))
    old = cols(base, F.array(F.lit("a"), F.lit("b")), F.lit(0), F.lit("int"), F.array(F.lit("Base")))
    params = F.when(F.col("k") % 5 == 0, F.array(F.lit("a"))).when(F.col("k") % 5 == 1, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    new = cols(base.where("k % 7 <> 0"), params, F.when(F.col("k") % 10 == 1, 1).otherwise(0), F.when(F.col("k") % 4 == 0, "str").otherwise("int"), F.when(F.col("k") % 9 == 2, F.array(F.lit("Other"))).otherwise(F.array(F.lit("Base"))))
    return old, new


register(
    "breaking_changes", lambda s, d: cg.breaking_changes(*_symbols(s, d)),
    """WITH k AS (SELECT p_brand AS path, p_partkey::VARCHAR AS symbol, p_partkey AS k, p_partkey % 3 AS t FROM part)
    SELECT path, symbol, CASE WHEN t = 1 THEN 'removed_method' ELSE 'removed_function' END AS change, 'high' AS severity FROM k WHERE k % 7 = 0
    UNION ALL SELECT path, symbol, 'changed_bases', 'high' FROM k WHERE k % 7 <> 0 AND t = 2 AND k % 9 = 2
    UNION ALL SELECT path, symbol, 'removed_parameter', 'high' FROM k WHERE k % 7 <> 0 AND t < 2 AND k % 5 = 0
    UNION ALL SELECT path, symbol, 'added_required_param', 'high' FROM k WHERE k % 7 <> 0 AND t < 2 AND k % 5 = 1 AND k % 10 <> 1
    UNION ALL SELECT path, symbol, 'changed_signature', 'medium' FROM k WHERE k % 7 <> 0 AND t < 2 AND k % 4 = 0""",
)
register(
    "change_severities", lambda s, d: cg.severities(cg.breaking_changes(*_symbols(s, d))),
    """WITH k AS (SELECT p_partkey AS k, p_partkey % 3 AS t FROM part)
    SELECT 'high' AS severity, CASE WHEN t = 1 THEN 'removed_method' ELSE 'removed_function' END AS change, count(*) AS n FROM k WHERE k % 7 = 0 GROUP BY 2
    UNION ALL SELECT 'high', 'changed_bases', count(*) FROM k WHERE k % 7 <> 0 AND t = 2 AND k % 9 = 2 HAVING count(*) > 0
    UNION ALL SELECT 'high', 'removed_parameter', count(*) FROM k WHERE k % 7 <> 0 AND t < 2 AND k % 5 = 0 HAVING count(*) > 0
    UNION ALL SELECT 'high', 'added_required_param', count(*) FROM k WHERE k % 7 <> 0 AND t < 2 AND k % 5 = 1 AND k % 10 <> 1 HAVING count(*) > 0
    UNION ALL SELECT 'medium', 'changed_signature', count(*) FROM k WHERE k % 7 <> 0 AND t < 2 AND k % 4 = 0 HAVING count(*) > 0""",
)


def _definitions(s: SparkSession, d: str) -> DataFrame:
    """Each part sets the variable of its key from two others of its brand's file."""
    k = F.col("p_partkey")
    return a.table(s, d, "part").select(
        F.col("p_brand").alias("path"), k.cast("int").alias("line"), F.concat(F.lit("v"), (k % 17).cast("string")).alias("variable"),
        F.array(F.concat(F.lit("v"), (k % 5).cast("string")), F.concat(F.lit("v"), ((k * 3) % 17).cast("string"))).alias("used"),
    )


register(
    "backward_slices",
    lambda s, d: cg.backward_slice(_definitions(s, d), a.table(s, d, "part").select(F.col("p_brand").alias("path")).distinct().select("path", F.lit(150).alias("line"), F.lit("v3").alias("variable")), tr.settled),
    """WITH RECURSIVE d AS (SELECT p_brand AS path, p_partkey::INT AS line, 'v' || (p_partkey % 17) AS variable, ['v' || (p_partkey % 5), 'v' || ((p_partkey * 3) % 17)] AS used FROM part WHERE p_partkey <= 150),
    w AS (SELECT DISTINCT p_brand AS path, 'v3' AS variable FROM part UNION SELECT w.path, unnest(used) FROM w JOIN d ON d.path = w.path AND d.variable = w.variable)
    SELECT DISTINCT d.path, d.line FROM d JOIN w ON d.path = w.path AND d.variable = w.variable""",
)

# --- bridges, hybrid search and tiers


def _levels(n: int) -> str:
    """CTEs of betweenness from the pivots (piv) over steps (st), unrolled for n levels."""
    out = ["f0 AS (SELECT node AS pv, node, 1.0::DOUBLE AS paths FROM piv)"]
    for i in range(1, n + 1):
        seen = " UNION ALL ".join(f"SELECT pv, node FROM f{j}" for j in range(i))
        out.append(f"r{i} AS (SELECT pv, next AS node, sum(paths) AS paths FROM f{i - 1} JOIN st USING (node) GROUP BY 1, 2), f{i} AS (SELECT r{i}.* FROM r{i} ANTI JOIN ({seen}) x USING (pv, node))")
    out.append(f"b{n} AS (SELECT *, 0.0::DOUBLE AS share FROM f{n})")
    for i in range(n - 1, -1, -1):
        out.append(f"h{i} AS (SELECT f.pv, f.node, sum(f.paths * (1 + g.share) / g.paths) AS share FROM f{i} f JOIN st USING (node) JOIN b{i + 1} g ON g.pv = f.pv AND g.node = st.next GROUP BY 1, 2), b{i} AS (SELECT f.pv, f.node, f.paths, coalesce(h.share, 0) AS share FROM f{i} f LEFT JOIN h{i} h USING (pv, node))")
    every = " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(n + 1))
    return ", " + ", ".join(out) + f", al AS ({every}) SELECT node, round(sum(share), 6) AS score FROM al WHERE node <> pv GROUP BY node HAVING round(sum(share), 6) > 0"


register(
    "bridge_nodes", lambda s, d: tr.betweenness(a.edges(s, d), a.nodes(s, d).where("kind = 'File'").select(F.col("qualified_name").alias("node"))),
    ", st AS (SELECT DISTINCT source AS node, target AS next FROM edges WHERE source <> target), piv AS (SELECT qualified_name AS node FROM nodes WHERE kind = 'File')" + _levels(7), *G,
)
VECTOR = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]


def _hybrid(s: SparkSession, d: str) -> DataFrame:
    n = a.nodes(s, d)
    names = se.bm25(n.select(F.col("qualified_name").alias("doc_id"), F.col("name").alias("text")), ["small", "widget"], 60).withColumnRenamed("doc_id", "qualified_name")
    near = se.cosine_top(a.table(s, d, "embeddings"), VECTOR, 60).select(F.concat(F.lit("part::"), F.col("vec_id").cast("string")).alias("qualified_name"), F.col("cosine").alias("score"))
    lists = [se.placed(x, "qualified_name", "score") for x in (names, near)]
    return se.hybrid(n, lists, "Small_widget", 20, ["part/Brand#11.md"])


register(
    "hybrid_search", _hybrid,
    """, t AS (SELECT qualified_name, regexp_extract_all(lower(name), '[a-z0-9]+') AS w FROM nodes), z AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
    h AS (SELECT qualified_name, len(w) AS dl, q.term, len(list_filter(w, lambda x: x = q.term)) AS tf FROM t, (SELECT unnest(['small', 'widget']) AS term) q), p AS (SELECT * FROM h WHERE tf > 0), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    b AS (SELECT qualified_name, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score FROM p JOIN f USING (term), z GROUP BY 1 ORDER BY score DESC, qualified_name LIMIT 60),
    v AS (SELECT 'part::' || vec_id AS qualified_name, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: CASE WHEN i % 3 = 0 THEN 1.0::DOUBLE ELSE -0.5 END)), 6) AS score, vec_id FROM embeddings ORDER BY score DESC, vec_id LIMIT 60),
    u AS (SELECT qualified_name, row_number() OVER (ORDER BY score DESC, qualified_name) - 1 AS place FROM b UNION ALL SELECT qualified_name, row_number() OVER (ORDER BY score DESC, qualified_name) - 1 FROM v),
    r AS (SELECT qualified_name, round(sum(1.0::DOUBLE / (60 + place + 1)), 8) AS score FROM u GROUP BY 1)
    SELECT qualified_name, kind, round(score * CASE kind WHEN 'Class' THEN 1.5::DOUBLE WHEN 'Function' THEN 1.5 ELSE 1 END * CASE WHEN file_path = 'part/Brand#11.md' THEN 1.5::DOUBLE ELSE 1 END, 6) AS score
    FROM r JOIN nodes USING (qualified_name) ORDER BY score DESC, qualified_name LIMIT 20""", a.NODES,
)
# --- sinks

register(
    "nodes_without_files", lambda s, d: sk.without(a.nodes(s, d), s.createDataFrame([("nation/3/customer.py",), ("part/Brand#11.md",)], "file_path string")).select("qualified_name"),
    "SELECT qualified_name FROM nodes WHERE file_path NOT IN ('nation/3/customer.py', 'part/Brand#11.md')", a.NODES,
)
register(
    "changed_documents", lambda s, d: sk.changed_only(*a.file_versions(s, d), "path", "hash").select("path"),
    "SELECT c.path FROM after c LEFT JOIN before b ON b.path = c.path WHERE b.hash IS NULL OR b.hash <> c.hash", a.VERSIONS,
)
register(
    "graph_json", lambda s, d: sk.graph_json(a.nodes(s, d), a.edges(s, d)),
    """SELECT '{"type":"node","kind":"' || kind || '","name":"' || name || '","qualified_name":"' || qualified_name || '","file_path":"' || file_path || '"}' AS value FROM nodes
    UNION ALL SELECT '{"type":"edge","kind":"' || kind || '","source":"' || source || '","target":"' || target || '"}' FROM edges""", *G,
)
register(
    "wiki_pages", lambda s, d: sk.wiki_pages(a.nodes(s, d), a.edges(s, d)),
    """, f AS (SELECT community_id, file_path, count(*) AS n FROM nodes WHERE community_id IS NOT NULL GROUP BY 1, 2), l AS (SELECT community_id, sum(n) AS size, string_agg('- ' || file_path || ' (' || n || ')', chr(10) ORDER BY file_path) AS files FROM f GROUP BY 1),
    t AS (SELECT a, b, count(*) AS n FROM ce WHERE a <> b GROUP BY 1, 2), g AS (SELECT a, string_agg('- [[community-' || b || ']] (' || n || ')', chr(10) ORDER BY b) AS ties FROM t GROUP BY 1)
    SELECT community_id, '# Community ' || community_id || chr(10) || chr(10) || size || ' members' || chr(10) || chr(10) || '## Files' || chr(10) || files || chr(10) || chr(10) || '## Ties' || chr(10) || coalesce(ties, '') || chr(10) AS page FROM l LEFT JOIN g ON a = community_id""", *G, COMMUNITY_ENDS,
)

# --- the inverted index

register(
    "postings", lambda s, d: se.postings(a.table(s, d, "documents")),
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2)
    SELECT doc_id, term, tf, sum(tf) OVER (PARTITION BY doc_id)::BIGINT AS length FROM c""",
)
