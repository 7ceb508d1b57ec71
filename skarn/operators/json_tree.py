"""Compression of the texts in JSON of any shape, level by level.

It takes VARIANT values apart one level at a time, a row for each value that the rules go
into, and puts the JSON text together from the deepest level up; values that stay as they are, whole
subtrees too, are never taken apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import json_string, kind_of
from ..functions.text import SKIPPED_KEYS, TEXT_KEYS, compress
from .scratch import Scratch

LONG = 20


def compress_json(docs: DataFrame, level: str = "full") -> DataFrame:
    """(id, json): JSON objects (id, json) with their texts compressed, and all other values as they were.

    The values of SKIPPED_KEYS stay, with all that is in them; texts of TEXT_KEYS are compressed; in
    lists, texts of over 20 characters are; objects and lists are gone into.  Keys come back in
    their byte order.  What is no JSON object stays as it is, null too; rows may share an id.
    """
    if level == "off":
        return docs.select("id", "json")
    scratch = Scratch(docs.sparkSession)
    spark = docs.sparkSession
    # A document is written once: as a value if it is an object, else as its text.
    value = F.try_parse_json("json")
    is_object = F.coalesce(kind_of(value) == "OBJECT", F.lit(False))
    parsed = scratch.keep(docs.select("id", F.when(~is_object, F.col("json")).alias("json"), F.when(is_object, value).alias("value"), is_object.alias("is_object"), F.monotonically_increasing_id().alias("row")))
    levels, at = [], parsed.where("is_object").select("row", F.array().cast("array<int>").alias("path"), "value", F.lit("OBJECT").alias("kind"))
    while not at.isEmpty():
        at.createOrReplaceTempView("_skarn_level")
        child = spark.sql("SELECT p.row, p.path, p.kind AS within, c.pos, c.key, c.value FROM _skarn_level p, LATERAL variant_explode(p.value) c")
        child = child.withColumns({"sort": kind_of(F.col("value")), "said": F.variant_get("value", "$", "string")})
        kind, text = F.col("sort"), F.col("said")
        in_object = F.col("within") == "OBJECT"
        skipped = in_object & F.col("key").isin(SKIPPED_KEYS)
        shorter = (kind == "STRING") & F.when(in_object, F.col("key").isin(TEXT_KEYS)).otherwise(F.length(text) > LONG)
        goes_in = ~skipped & kind.isin("OBJECT", "ARRAY")
        ready = F.when(goes_in, F.lit(None)).when(~skipped & shorter, json_string(compress(text, level))).otherwise(F.coalesce(F.to_json("value"), F.lit("null")))
        rows = scratch.keep(child.select("row", F.concat("path", F.array("pos")).alias("path"), F.col("path").alias("parent"), "within", "pos", "key", ready.alias("text"), F.when(goes_in, F.col("value")).alias("value"), F.when(goes_in, kind).alias("kind")))
        levels.append((at.select("row", "path", "kind"), rows))
        at = rows.where("kind is not null").select("row", "path", "value", "kind")
    made = None
    for above, rows in reversed(levels):
        if made is not None:
            rows = rows.join(made.withColumnRenamed("text", "built"), ["row", "path"], "left").withColumn("text", F.coalesce("text", "built"))
        said = F.when(F.col("within") == "OBJECT", F.concat(json_string(F.col("key")), F.lit(":"), F.col("text"))).otherwise(F.col("text"))
        parts = rows.groupBy("row", F.col("parent").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("said")))), lambda x: x["said"]), ",").alias("inner"))
        inner = F.coalesce("inner", F.lit(""))
        whole = F.when(F.col("kind") == "OBJECT", F.concat(F.lit("{"), inner, F.lit("}"))).otherwise(F.concat(F.lit("["), inner, F.lit("]")))
        made = scratch.keep(above.join(parts, ["row", "path"], "left").select("row", "path", whole.alias("text")))
    if made is None:
        return scratch.result(parsed.select("id", "json"))
    return scratch.result(parsed.join(made.select("row", "text"), "row", "left").select("id", F.coalesce("text", "json").alias("json")))
