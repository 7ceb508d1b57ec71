"""Trees of documents, settings and API descriptions as rows."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Methods of an API, and how deep settings are read.
METHODS = ["get", "post", "put", "delete", "patch", "head", "options"]
DEEPEST = 6


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, at, level, title, parent): Markdown headings and the nearest one above of a lower level (null: the document).

    `at` and `parent` count a document's headings from 1.
    """
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"^#+\s+\S"))
    shaped = F.transform(lines, lambda x, i: F.struct((i + 1).alias("at"), F.length(F.regexp_extract(x, "^(#+)", 1)).alias("level"), F.btrim(F.regexp_extract(x, r"^#+\s+(.+)$", 1), F.lit(" \t\r")).alias("title")))
    rows = docs.select("doc_id", shaped.alias("all")).withColumn("h", F.explode("all"))
    above = F.expr("transform(filter(slice(all, 1, h.at - 1), x -> x.level < h.level), x -> x.at)")
    return rows.withColumn("above", above).select("doc_id", "h.at", "h.level", "h.title", F.expr("try_element_at(above, -1)").alias("parent"))


def as_json(files: DataFrame) -> DataFrame:
    """(path, json) of settings files (path, text): JSON as it is, YAML and TOML converted; what does not parse is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"].fillna(""), strict=True):
                try:
                    if path.lower().endswith(".toml"):
                        value = tomllib.loads(text)
                    else:
                        import yaml  # JSON is YAML

                        value = json.loads(text) if path.lower().endswith(".json") else yaml.safe_load(text)
                except Exception:  # noqa: S112, BLE001  any parser's complaint
                    continue
                if isinstance(value, dict):
                    rows.append((path, json.dumps(value, default=str)))
            yield pd.DataFrame(rows, columns=["path", "json"])

    return files.select("path", "text").mapInPandas(run, "path string, json string")


def setting_keys(files: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(path, key, parent, depth, preview): the keys of settings (path, json) as dotted names, down to a depth.

    The preview is the value's text, cut at 60 characters, the number of a list's items, and null
    for a key with keys of its own.  One pass of the variant's fields for each depth.
    """
    spark = files.sparkSession
    level = files.select("path", F.parse_json("json").alias("v"), F.lit(None).cast("string").alias("parent"))
    out = None
    for depth in range(deepest + 1):
        fields = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "value")).where(F.col("name").isNotNull())
        kind = F.schema_of_variant("value")
        key = F.when(F.col("parent").isNull(), F.col("name")).otherwise(F.concat("parent", F.lit("."), "name"))
        plain = F.expr("try_variant_get(value, '$', 'string')")
        short = F.when(F.length(plain) > 60, F.concat(F.substring(plain, 1, 60), F.lit("..."))).otherwise(plain)
        items = F.concat(F.lit("["), F.coalesce(F.expr("size(try_variant_get(value, '$', 'array<variant>'))"), F.lit(0)).cast("string"), F.lit(" items]"))
        shown = F.when(kind.startswith("OBJECT"), None).when(kind.startswith("ARRAY"), items).otherwise(short)
        rows = fields.select("path", key.alias("key"), "parent", F.lit(depth).alias("depth"), shown.alias("preview"), "value", kind.startswith("OBJECT").alias("inner"))
        found = rows.drop("value", "inner")
        out = found if out is None else out.unionByName(found)
        level = rows.where("inner").select("path", F.col("value").alias("v"), F.col("key").alias("parent"))
    return out


def _references(value) -> Iterator[str]:
    if isinstance(value, dict):
        name = value.get("$ref")
        if isinstance(name, str) and name.startswith("#/components/schemas/"):
            yield name.split("/", 3)[3]
        for child in value.values():
            yield from _references(child)
    elif isinstance(value, list):
        for child in value:
            yield from _references(child)


def _api_rows(path: str, spec: dict) -> Iterator[tuple]:
    """(path, what, name, target): endpoints, schemas, and the schemas that each refers to."""
    for name, schema in ((spec.get("components") or {}).get("schemas") or {}).items():
        yield path, "schema", name, None
        yield from ((path, "reference", name, target) for target in sorted(set(_references(schema)) - {name}))
    for url, methods in (spec.get("paths") or {}).items():
        for method, call in (methods if isinstance(methods, dict) else {}).items():
            if method in METHODS and isinstance(call, dict):
                name = f"{method.upper()} {url}"
                yield path, "endpoint", name, None
                used = {t for part in ("requestBody", "responses", "parameters") for t in _references(call.get(part))}
                yield from ((path, "reference", name, target) for target in sorted(used))


def api_rows(specs: DataFrame) -> DataFrame:
    """(path, what, name, target) of API descriptions (path, json): schemas, endpoints and references between them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for path, text in zip(batch["path"], batch["json"], strict=True) for row in _api_rows(path, json.loads(text))]
            yield pd.DataFrame(rows, columns=["path", "what", "name", "target"])

    return specs.select("path", "json").mapInPandas(run, "path string, what string, name string, target string")
