"""Registered queries of positional and stemmed search and of Leiden communities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import register
from .functions.scalars import resolution
from .functions.stems import porter
from .operators import leiden as le
from .operators import phrases as ph
from .plans import adapters as a

# The words of each document, and Porter's steps, one common table expression a step.
WORDS_SQL = r"""texts AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
size AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM texts)"""
STEMS_SQL = r"""terms AS (SELECT DISTINCT unnest(w) AS term FROM texts),
s0 AS (SELECT term, CASE WHEN term[1] = 'y' THEN 'Y' || term[2:] ELSE term END AS w FROM terms WHERE regexp_matches(term, '^[a-z]{3,64}$')),
s1 AS (SELECT term, CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END AS w FROM s0),
s2 AS (SELECT term, w, CASE WHEN w LIKE '%eed' THEN 'eed' WHEN w LIKE '%ed' THEN 'ed' WHEN w LIKE '%ing' THEN 'ing' ELSE '' END AS e FROM s1),
s3 AS (SELECT term, w, e, left(w, length(w) - length(e)) AS s FROM s2),
s4 AS (SELECT term, CASE
    WHEN e = 'eed' THEN CASE WHEN regexp_matches(s, '^([^aeiou][^aeiouy]*)?[aeiouy][aeiou]*[^aeiou]') THEN w[:-2] ELSE w END
    WHEN e = '' OR NOT regexp_matches(s, '^([^aeiou][^aeiouy]*)?[aeiouy]') THEN w
    WHEN regexp_matches(s, '(at|bl|iz)$') OR regexp_matches(s, '^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxyY]$') THEN s || 'e'
    WHEN length(s) > 1 AND right(s, 1) = lower(s[-2:-2]) AND regexp_matches(s, '[^aeioulsz]$') THEN s[:-2]
    ELSE s END AS w FROM s3),
s5 AS (SELECT term, CASE WHEN w LIKE '%y' AND regexp_matches(w[:-2], '^([^aeiou][^aeiouy]*)?[aeiouy]') THEN w[:-2] || 'i' ELSE w END AS w FROM s4),
s6 AS (SELECT term, w, regexp_extract(w, '^.*?(ational|tional|enci|anci|izer|bli|alli|entli|eli|ousli|ization|ation|ator|alism|iveness|fulness|ousness|aliti|iviti|biliti|logi)$', 1) AS e FROM s5),
s7 AS (SELECT term, CASE WHEN e <> '' AND regexp_matches(left(w, length(w) - length(e)), '^([^aeiou][^aeiouy]*)?[aeiouy][aeiou]*[^aeiou]') THEN left(w, length(w) - length(e)) || CASE
    WHEN e IN ('ational', 'ation', 'ator') THEN 'ate' WHEN e = 'tional' THEN 'tion' WHEN e = 'enci' THEN 'ence' WHEN e = 'anci' THEN 'ance' WHEN e IN ('izer', 'ization') THEN 'ize'
    WHEN e IN ('bli', 'biliti') THEN 'ble' WHEN e IN ('alli', 'alism', 'aliti') THEN 'al' WHEN e = 'entli' THEN 'ent' WHEN e = 'eli' THEN 'e' WHEN e IN ('ousli', 'ousness') THEN 'ous'
    WHEN e IN ('iveness', 'iviti') THEN 'ive' WHEN e = 'fulness' THEN 'ful' ELSE 'log' END ELSE w END AS w FROM s6),
s8 AS (SELECT term, w, regexp_extract(w, '^.*?(icate|ative|alize|iciti|ical|ful|ness)$', 1) AS e FROM s7),
s9 AS (SELECT term, CASE WHEN e <> '' AND regexp_matches(left(w, length(w) - length(e)), '^([^aeiou][^aeiouy]*)?[aeiouy][aeiou]*[^aeiou]') THEN left(w, length(w) - length(e)) || CASE
    WHEN e IN ('icate', 'iciti', 'ical') THEN 'ic' WHEN e = 'alize' THEN 'al' ELSE '' END ELSE w END AS w FROM s8),
s10 AS (SELECT term, w, regexp_extract(w, '^.*?(al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ion|ou|ism|ate|iti|ous|ive|ize)$', 1) AS e FROM s9),
s11 AS (SELECT term, w, e, left(w, length(w) - length(e)) AS s FROM s10),
s12 AS (SELECT term, CASE WHEN e <> '' AND (e <> 'ion' OR regexp_matches(s, '[st]$'))
    AND regexp_matches(s, '^([^aeiou][^aeiouy]*)?[aeiouy][aeiou]*[^aeiou][^aeiouy]*[aeiouy][aeiou]*[^aeiou]') THEN s ELSE w END AS w FROM s11),
s13 AS (SELECT term, CASE WHEN w LIKE '%e' AND (regexp_matches(w[:-2], '^([^aeiou][^aeiouy]*)?[aeiouy][aeiou]*[^aeiou][^aeiouy]*[aeiouy][aeiou]*[^aeiou]')
    OR regexp_matches(w[:-2], '^([^aeiou][^aeiouy]*)?[aeiouy][aeiou]*[^aeiou][^aeiouy]*([aeiouy][aeiou]*)?$') AND NOT regexp_matches(w[:-2], '^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxyY]$'))
    THEN w[:-2] ELSE w END AS w FROM s12),
s14 AS (SELECT term, CASE WHEN w LIKE '%ll' AND regexp_matches(w, '^([^aeiou][^aeiouy]*)?[aeiouy][aeiou]*[^aeiou][^aeiouy]*[aeiouy][aeiou]*[^aeiou]') THEN w[:-2] ELSE w END AS w FROM s13),
stems AS (SELECT term, CASE WHEN w[1] = 'Y' THEN 'y' || w[2:] ELSE w END AS stem FROM s14 UNION ALL SELECT term, term FROM terms WHERE NOT regexp_matches(term, '^[a-z]{3,64}$'))"""
#: Scores of hits (doc_id, unit, tf, length) against size (n, mean).
BM25_SQL = """df AS (SELECT unit, count(*) AS df FROM hits GROUP BY unit),
scored AS (SELECT doc_id, count(*) AS units, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score
  FROM hits JOIN df USING (unit) CROSS JOIN size GROUP BY doc_id)"""


def _search(query: str, k: int, every: bool, stemmed: bool):
    return lambda s, d: ph.search(a.table(s, d, "documents"), query, k, every, stemmed)


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = a.table(spark, sf_dir, "documents").select(F.explode(ph.words(F.col("text"))).alias("term")).distinct()
    return terms.select("term", porter(F.col("term")).alias("stem"))


register("porter_stems", _vocabulary, f"WITH {WORDS_SQL}, {STEMS_SQL} SELECT term, stem FROM stems")
register(
    "phrase_search", _search('"released under the" license', 40, True, False),
    f"""WITH {WORDS_SQL}, hits AS (
      SELECT * FROM (SELECT doc_id, 0 AS unit, len(w) AS length, len(list_filter(range(1, len(w) - 1), lambda i: w[i] = 'released' AND w[i + 1] = 'under' AND w[i + 2] = 'the')) AS tf FROM texts
      UNION ALL SELECT doc_id, 1, len(w), len(list_filter(w, lambda x: x = 'license')) FROM texts) WHERE tf > 0), {BM25_SQL}
    SELECT doc_id, score FROM scored WHERE units = 2 ORDER BY score DESC, doc_id LIMIT 40""",
)
register(
    "phrase_of_repeats", _search('"the the" "of the"', 60, False, False),
    f"""WITH {WORDS_SQL}, hits AS (
      SELECT * FROM (SELECT doc_id, 0 AS unit, len(w) AS length, len(list_filter(range(1, len(w)), lambda i: w[i] = 'the' AND w[i + 1] = 'the')) AS tf FROM texts
      UNION ALL SELECT doc_id, 1, len(w), len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) FROM texts) WHERE tf > 0), {BM25_SQL}
    SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 60""",
)
_STEM_HITS = """said AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM texts),
hits AS (SELECT doc_id, stem AS unit, count(*) AS tf, any_value(length) AS length FROM said JOIN stems USING (term) WHERE stem IN ({}) GROUP BY doc_id, stem)"""
register(
    "all_words_search", _search("releases licensed", 40, True, True),
    f"WITH {WORDS_SQL}, {STEMS_SQL}, {_STEM_HITS.format("'releas', 'licens'")}, {BM25_SQL} SELECT doc_id, score FROM scored WHERE units = 2 ORDER BY score DESC, doc_id LIMIT 40",
)
register(
    "stemmed_search", _search("licensing granted permissions", 50, False, True),
    f"WITH {WORDS_SQL}, {STEMS_SQL}, {_STEM_HITS.format("'licens', 'grant', 'permiss'")}, {BM25_SQL} SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 50",
)
register(
    "tiered_search", lambda s, d: ph.tiers(a.table(s, d, "documents"), "licensed", 30),
    f"WITH {WORDS_SQL}, {STEMS_SQL}, {_STEM_HITS.format("'licens'")}, {BM25_SQL} SELECT doc_id, 1 AS tier, score FROM scored ORDER BY score DESC, doc_id LIMIT 30",
)
register(
    "tiered_search_letters", lambda s, d: ph.tiers(a.table(s, d, "documents"), "icense elea", 30),
    f"""WITH low AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), size AS (SELECT count(*) AS n, avg(greatest(length(t) - 2, 0)) AS mean FROM low),
    hits AS (SELECT * FROM (SELECT doc_id, greatest(length(t) - 2, 0) AS length, u AS unit, (length(t) - length(replace(t, u, ''))) // length(u) AS tf FROM low, (SELECT unnest(['icense', 'elea']) AS u)) WHERE tf > 0), {BM25_SQL}
    SELECT doc_id, 2 AS tier, score FROM scored WHERE units = 2 ORDER BY score DESC, doc_id LIMIT 30""",
)


# --- Leiden communities


def _leiden(spark: SparkSession, sf_dir: str, fineness: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = a.nodes(spark, sf_dir), a.edges(spark, sf_dir)
    return le.leiden(nodes, edges, fineness or resolution(nodes.count())), nodes, edges


register("leiden_communities", lambda s, d: le.communities(*_leiden(s, d)))
register("leiden_assigned", lambda s, d: (lambda m, n, e: le.assign(n, m).select("qualified_name", "kind", "community_id"))(*_leiden(s, d, 1.0)))
