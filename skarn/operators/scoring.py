"""Scores, lifecycles and budgets: return on memory, packing, quality, pricing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days to live by type, and the types that are never archived.
TTL = {"note": 60, "error_pattern": 90, "bugfix": 90, "decision": 120, "reference": 180, "project": 90, "user": 365, "feedback": 365}
IMMUNE = ["guardrail", "convention", "warning"]
DEFAULT_TTL = 90


def age_days(as_of: str, created: Column) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), created)


def roi(observations: DataFrame, as_of: str) -> DataFrame:
    """Accesses times importance over age in months (one at least); low below 0.1, but for types that are never archived."""
    months = F.greatest(F.lit(1.0), age_days(as_of, F.col("created_at")) / 30.0)
    value = F.round(F.col("access_count") * F.col("importance") / months, 6)
    return observations.where(~F.col("archived")).select("id", value.alias("roi"), ((value < 0.1) & ~F.coalesce(F.col("type"), F.lit("")).isin(IMMUNE)).alias("low"))


def expired(observations: DataFrame, as_of: str) -> DataFrame:
    """Active observations past their type's days to live, never read and not immune."""
    ttl = F.coalesce(F.create_map(*[F.lit(x) for kv in TTL.items() for x in kv])[F.col("type")], F.lit(DEFAULT_TTL))
    old = age_days(as_of, F.col("created_at")) >= ttl
    return observations.where(~F.col("archived") & (F.col("access_count") == 0) & ~F.col("type").isin(IMMUNE) & old).select("id", "type")


def promoted(observations: DataFrame, least: int = 5) -> DataFrame:
    """Notes become conventions and warnings guardrails once read often enough."""
    new = F.when(F.col("type") == "note", "convention").when(F.col("type") == "warning", "guardrail")
    return observations.where(~F.col("archived") & (F.col("access_count") >= least) & F.col("type").isin("note", "warning")).select("id", "type", new.alias("new_type"))


def pack_score(candidates: DataFrame, query: str) -> DataFrame:
    """0.4 relevance + 0.25 / (1 + distance) + 0.2 / (1 + months) + 0.15 accesses of 10 + 0.1 word overlap."""
    asked = F.array_distinct(F.split(F.lower(F.lit(query)), " "))
    named = F.array_distinct(F.split(F.lower("name"), " "))
    overlap = F.size(F.array_intersect(asked, named)) / F.greatest(F.size(F.array_union(asked, named)), F.lit(1))
    score = (
        0.4 * F.col("relevance") + 0.25 / (1 + F.col("distance")) + 0.2 / (1 + F.col("age_days") / 30.0)
        + 0.15 * F.least(F.col("access_count") / 10.0, F.lit(1.0)) + 0.1 * overlap
    )
    return candidates.withColumn("score", F.round(score, 6))


def pack(scored: DataFrame, budget: int) -> DataFrame:
    """Greedy packing per query: densest first, each whole item that still fits.

    A fold over each query's sorted items in the JVM; items that do not fit are passed over and
    later, smaller ones may still go in.  A query's candidates must fit in one row.
    """
    density = F.col("score") / F.greatest(F.col("cost"), F.lit(1))
    items = F.array_sort(F.collect_list(F.struct((-density).alias("d"), "id", "cost")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))

    def take(state: Column, item: Column) -> Column:
        used = state["used"] + item["cost"]
        more = F.struct(used.cast("long").alias("used"), F.concat(state["ids"], F.array(item["id"])).alias("ids"))
        return F.when(used <= budget, more).otherwise(state)

    packed = scored.groupBy("query_id").agg(items.alias("items")).withColumn("p", F.aggregate("items", start, take))
    return packed.select("query_id", F.size("p.ids").alias("n_packed"), F.col("p.used").alias("used"), (F.size("items") - F.size("p.ids")).alias("n_skipped"))


def packed_items(scored: DataFrame, budget: int) -> DataFrame:
    """(query_id, ids): the items that `pack` takes for each query, in the order it takes them."""
    density = F.col("score") / F.greatest(F.col("cost"), F.lit(1))
    items = F.array_sort(F.collect_list(F.struct((-density).alias("d"), "id", "cost")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))

    def take(state: Column, item: Column) -> Column:
        used = (state["used"] + item["cost"]).cast("long")
        return F.when(used <= budget, F.struct(used.alias("used"), F.concat(state["ids"], F.array(item["id"])).alias("ids"))).otherwise(state)

    return scored.groupBy("query_id").agg(items.alias("items")).select("query_id", F.array_join(F.aggregate("items", start, take)["ids"].cast("array<string>"), ",").alias("ids"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "S").when(score >= 80, "A").when(score >= 70, "B").when(score >= 55, "C").when(score >= 40, "D").otherwise("F")


# US dollars for a million input and output tokens, by model; other names of models; words that tell a model.
PRICES = {
    "opus": (15.0, 75.0), "sonnet": (3.0, 15.0), "haiku": (0.8, 4.0), "gpt-5": (2.5, 10.0), "gpt-4.1": (2.0, 8.0), "gpt-4.1-mini": (0.4, 1.6),
    "gpt-4o": (2.5, 10.0), "gpt-4o-mini": (0.15, 0.6), "gemini-2.5-pro": (1.25, 10.0), "gemini-2.0-flash": (0.1, 0.4), "gemini-1.5-pro": (1.25, 5.0),
    "gemini-1.5-flash": (0.075, 0.3), "deepseek-v3": (0.27, 1.1), "deepseek-r1": (0.55, 2.19), "qwen-max": (0.4, 1.2), "mistral-large": (2.0, 6.0),
    "grok-3": (3.0, 15.0),
}
ALIASES = {
    "claude-opus": "opus", "claude-sonnet": "sonnet", "claude-haiku": "haiku", "opus-4": "opus", "sonnet-4": "sonnet", "haiku-4": "haiku",
    "opus-3": "opus", "sonnet-3": "sonnet", "haiku-3": "haiku", "gpt5": "gpt-5", "gpt-4o-mini": "gpt-4o-mini", "gemini-flash": "gemini-2.0-flash",
    "gemini-pro": "gemini-2.5-pro",
}
HINTS = {
    "gpt5": "gpt-5", "4.1-mini": "gpt-4.1-mini", "4o-mini": "gpt-4.1-mini", "gemini-2.5": "gemini-2.5-pro", "gemini-2.0": "gemini-2.0-flash",
    "gemini-flash": "gemini-2.0-flash", "deepseek": "deepseek-v3", "mistral": "mistral-large", "grok": "grok-3",
}
DEFAULT_MODEL = "sonnet"


# Words that tell security-sensitive names.
SECURITY = [
    "auth", "login", "password", "token", "session", "crypt", "secret", "credential", "permission", "sql", "query", "execute", "connect", "socket",
    "request", "http", "sanitize", "validate", "encrypt", "decrypt", "hash", "sign", "verify", "admin", "privilege",
]


def model_name(model: Column) -> Column:
    """The priced model that a name means: an alias, the first priced model within the name, one told by a word, or the default."""
    bare = F.regexp_replace(F.btrim(F.lower(model)), "^(?:anthropic/|openai/|google/|meta/|mistralai/)+", "")
    out = F.lit(DEFAULT_MODEL)
    for part, name in reversed([*((k, k) for k in PRICES), *HINTS.items()]):
        out = F.when(bare.contains(part), name).otherwise(out)
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[bare]
    return F.coalesce(alias, out)


def token_cost(usage: DataFrame) -> DataFrame:
    """`usage` (model, tokens_in, tokens_out) with the priced model and its cost in dollars."""
    family = model_name(F.col("model"))
    price = F.create_map(*[x for k, v in PRICES.items() for x in (F.lit(k), F.array(F.lit(v[0]), F.lit(v[1])))])[family]
    cost = (F.col("tokens_in") * price[0] + F.col("tokens_out") * price[1]) / 1e6
    return usage.withColumns({"family": family, "cost": F.round(cost, 8)})
