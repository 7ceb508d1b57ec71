"""Reports: quality signals, waste findings, health, risk of changes, token figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import SECURITY, grade


def ladder(value: Column, steps: list[tuple[float, float]], last: float, strict: bool = False) -> Column:
    """The score of the first step whose bound a value reaches (or, if strict, stays below)."""
    out = None
    for bound, score in steps:
        hit = value < bound if strict else value >= bound
        out = F.when(hit, float(score)) if out is None else out.when(hit, float(score))
    return out.otherwise(float(last))


def quality_signals(s: DataFrame) -> DataFrame:
    """Seven signals from 0 to 100 of one row of totals, their weighted sum (1 place) and its grade.

    Columns: filter_pct, graph_pct, n_commands, n_days, n_active_days, n_memory, importance, n_errors,
    n_events, n_good_runs, n_runs, n_media, n_nodes.
    """
    c = F.col
    positive = (c("filter_pct") > 0).cast("int") + (c("graph_pct") > 0).cast("int")
    savings = F.least(F.lit(100.0), 2.0 * (c("filter_pct") + c("graph_pct")) / F.greatest(positive, F.lit(1)))
    days = F.greatest(c("n_days"), F.lit(1))
    coverage = ladder(c("n_commands") / days, [(20, 100), (10, 80), (5, 60), (1, 40)], 10)
    steady = F.least(F.lit(100.0), 120.0 * c("n_active_days") / days)
    n, mean = c("n_memory"), c("importance")
    memory = F.when((n >= 50) & (mean >= 0.5), 100.0).when((n >= 20) & (mean >= 0.4), 75.0).when(n >= 10, 50.0).when(n >= 1, 30.0).otherwise(0.0)
    errors = F.when(c("n_events") == 0, 50.0).otherwise(ladder(c("n_errors") / F.greatest(c("n_events"), F.lit(1)), [(0.05, 100), (0.15, 70), (0.30, 40)], 15, strict=True))
    builds = F.when(c("n_runs") == 0, 50.0).otherwise(F.least(F.lit(100.0), 110.0 * c("n_good_runs") / F.greatest(c("n_runs"), F.lit(1))))
    media = F.when(c("n_nodes") == 0, 30.0).otherwise(ladder(c("n_media") / F.greatest(c("n_nodes"), F.lit(1)), [(0.30, 100), (0.10, 80), (0.01, 60)], 30))
    signals = {"savings": savings, "coverage": coverage, "consistency": steady, "memory": memory, "errors": errors, "builds": builds, "media": media}
    weights = {"savings": 0.20, "coverage": 0.16, "consistency": 0.16, "memory": 0.16, "errors": 0.12, "builds": 0.10, "media": 0.10}
    total = sum((weights[k] * v for k, v in signals.items()), F.lit(0.0))
    return s.select(*[F.round(v, 4).alias(k) for k, v in signals.items()], F.round(total, 1).alias("score"), grade(total).alias("grade"))


def waste(s: DataFrame, by_filter: DataFrame, all_filters: DataFrame) -> DataFrame:
    """Findings (finding, severity, subject, tokens) of seven detectors, from one row of totals and the filters' runs.

    `s`: n_long_sessions, error_rate, n_events, n_compressed, n_calls, n_memory, importance, n_repeated.
    `by_filter`: filter, n, avg_pct.  `all_filters`: filter.
    """

    def finding(df: DataFrame, rule: Column, name: str, severity: str, tokens: Column, subject: Column | None = None) -> DataFrame:
        what = F.lit("") if subject is None else subject
        return df.where(rule).select(F.lit(name).alias("finding"), F.lit(severity).alias("severity"), what.alias("subject"), tokens.cast("long").alias("tokens"))

    c = F.col
    idle = all_filters.join(by_filter, "filter", "left_anti").agg(F.count("*").alias("n_idle"))
    shown = F.concat(c("n_idle").cast("string"), F.lit(" filters"))
    share = c("n_compressed") / F.greatest(c("n_calls"), F.lit(1))
    return (
        finding(by_filter, (c("n") >= 5) & (c("avg_pct") < 5.0), "empty_filter", "low", F.lit(0), c("filter"))
        .unionAll(finding(s, c("n_long_sessions") >= 2, "session_bloat", "medium", c("n_long_sessions") * 50_000))
        .unionAll(finding(s, (c("error_rate") > 0.30) & (c("n_events") > 20), "error_churn", "medium", F.floor(c("n_events") * c("error_rate") * 200)))
        .unionAll(finding(s, (c("n_calls") >= 10) & (share < 0.1), "compression_off", "medium", c("n_calls") * 800))
        .unionAll(finding(idle, c("n_idle") >= 3, "idle_filters", "low", F.lit(0), shown))
        .unionAll(finding(s, (c("n_memory") >= 10) & (c("importance") < 0.3), "memory_neglect", "medium", F.lit(0)))
        .unionAll(finding(s, c("n_repeated") >= 3, "repeated_ingestion", "low", c("n_repeated") * 2_000))
    )


def health(s: DataFrame) -> DataFrame:
    """A score from 70 up and down by what is in use, held within 0 and 100, its grade and the rules that fired.

    Columns: filters_active, memory_used, compression_on, sessions_on, n_filter_events, avg_pct, saved,
    archive_rate, n_memory, graph_empty, n_media.
    """
    c = F.col
    rules = [
        ("filters_active", c("filters_active"), 5), ("memory_used", c("memory_used"), 5), ("compression_on", c("compression_on"), 5),
        ("sessions_on", c("sessions_on"), 5), ("filters_idle", ~c("filters_active") & (c("n_filter_events") == 0), -5),
        ("low_savings", (c("avg_pct") < 20.0) & (c("saved") > 0), -5), ("memory_archived", (c("archive_rate") > 0.80) & (c("n_memory") > 10), -5),
        ("graph_empty", c("graph_empty"), -5), ("no_media", c("n_media") == 0, -3),
    ]
    score = sum((F.when(rule, points).otherwise(0) for _, rule, points in rules), F.lit(70))
    held = F.greatest(F.lit(0), F.least(F.lit(100), score))
    fired = F.array_join(F.array_compact(F.array(*[F.when(rule, name) for name, rule, _ in rules])), ",")
    return s.select(held.cast("int").alias("health"), grade(held).alias("grade"), fired.alias("rules"))


def risk(nodes: DataFrame, edges: DataFrame, flows: DataFrame, tests: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Risk of changing each node, or each of some (`of`: qualified_name), as (qualified_name, risk), 4 places.

    The criticality of its flows (`flows`: node, criticality; 0.25 at most), 0.05 a caller from another
    community (0.15 at most, where the node has a community), 0.30 without tests down to 0.05 with
    five (`tests`: node, test, those of callees too), 0.20 for a security word in either name, and a
    twentieth of the calls up to 0.10.  In whole ten-thousandths but for criticality, which has four places.
    """
    c = nodes.select("qualified_name", "community_id")
    of = None if of is None else of.select("qualified_name")
    only = lambda df, name: df if of is None else df.join(of.withColumnRenamed("qualified_name", name), name, "left_semi")
    calls = only(edges.where(F.col("kind") == "CALLS").select("source", "target"), "target")
    owned = calls.join(c.select(F.col("qualified_name").alias("source"), F.col("community_id").alias("theirs")), "source", "left")
    owned = owned.join(c.select(F.col("qualified_name").alias("target"), F.col("community_id").alias("own")), "target", "left")
    foreign = F.count_distinct(F.when(F.col("theirs") != F.col("own"), F.col("source")))
    per_call = owned.groupBy(F.col("target").alias("qualified_name")).agg(F.count("*").alias("n_calls"), foreign.alias("n_foreign"))
    per_flow = only(flows, "node").groupBy(F.col("node").alias("qualified_name")).agg(F.sum(F.round(F.col("criticality") * 10_000).cast("long")).alias("flow"))
    per_test = only(tests, "node").groupBy(F.col("node").alias("qualified_name")).agg(F.count_distinct("test").alias("n_tests"))
    rows = only(nodes.where(F.col("kind") != "File").select("qualified_name", "name"), "qualified_name")
    for part in (per_call, per_flow, per_test):
        rows = rows.join(part, "qualified_name", "left")
    known = lambda name: F.coalesce(F.col(name), F.lit(0))
    secure = F.lower(F.concat("name", F.lit(" "), "qualified_name")).rlike("|".join(SECURITY))
    points = (
        F.least(known("flow"), F.lit(2_500)) + F.least(500 * known("n_foreign"), F.lit(1_500)) + 3_000 - 500 * F.least(known("n_tests"), F.lit(5))
        + F.when(secure, 2_000).otherwise(0) + F.least(500 * known("n_calls"), F.lit(1_000))
    )
    return rows.select("qualified_name", (F.greatest(F.lit(0), F.least(points, F.lit(10_000))) / 10_000).alias("risk"))


def tests_near(edges: DataFrame) -> DataFrame:
    """(node, test): tests of each node and of what it calls, as often as there are ways to them."""
    direct = edges.where(F.col("kind") == "TESTED_BY").select(F.col("source").alias("node"), F.col("target").alias("test"))
    calls = edges.where(F.col("kind") == "CALLS").select(F.col("source").alias("caller"), F.col("target").alias("node"))
    return direct.unionAll(calls.join(direct, "node").select("caller", "test"))


def change_report(changed: DataFrame, risks: DataFrame, edges: DataFrame) -> DataFrame:
    """Changed nodes (qualified_name, is_test) with their risk, whether a test is missing, and their place among them."""
    tested = edges.where(F.col("kind") == "TESTED_BY").select(F.col("source").alias("qualified_name")).distinct().withColumn("t", F.lit(True))
    rows = changed.join(risks, "qualified_name").join(tested, "qualified_name", "left")
    return rows.select("qualified_name", "risk", (~F.col("is_test") & F.col("t").isNull()).alias("test_gap")).orderBy(F.desc("risk"), "qualified_name")


def token_meta(sizes: DataFrame) -> DataFrame:
    """Answers (id, text, n_results) with their tokens and the tokens a result."""
    total = F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long")
    mean = F.when(F.col("n_results") > 0, F.expr("greatest(1L, length(text) div 4) div n_results")).otherwise(total)
    return sizes.select("id", total.alias("tokens"), "n_results", mean.cast("long").alias("per_result"))


def query_costs(queries: DataFrame, n_files: int) -> DataFrame:
    """Questions (id, text) with estimated tokens from a file list, from the graph, and the share saved."""
    long = F.length("text") > 100
    before = F.lit(100 + 500 + 20 * min(n_files, 50) + 1000 + n_files // 10 + 1500) + F.when(long, 200).otherwise(0)
    after = F.lit(100 + 500 + 2000 + 1000) + F.when(long, 100).otherwise(0)
    return queries.select("id", before.alias("before"), after.alias("after"), F.round((before - after) / before * 100, 2).alias("saved_pct"))


def human_tokens(n: Column) -> Column:
    """1.2M, 3.4K or the number itself."""
    shown = lambda x, unit: F.concat(F.format_string("%.1f", F.round(x, 1)), F.lit(unit))
    return F.when(n >= 1_000_000, shown(n / 1e6, "M")).when(n >= 1_000, shown(n / 1e3, "K")).otherwise(n.cast("string"))
