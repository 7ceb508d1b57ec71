"""JSON texts as columns: strings, kinds of values, skeletons of types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let


def json_string(text: Column) -> Column:
    """A text as a JSON string."""
    return let(F.to_json(F.array(text)), lambda listed: F.substring(listed, F.lit(2), F.length(listed) - 2))


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING and so on; VOID for a JSON null."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def skeleton(json: Column, depth: int = 3, keys: int = 10) -> Column:
    """The JSON text of a JSON text's types: the first ten keys of objects, lists by their first value and length, texts by length.

    Below `depth` there is only "..."; what is no JSON is null.
    """

    def shape(raw: Column, value: Column, at: int) -> Column:
        if at > depth:
            return F.lit('"..."')

        def of_object(v: Column) -> Column:
            own = F.slice(F.map_entries(F.from_json(raw, "map<string,string>")), 1, keys)
            types = v.cast("map<string,variant>")
            return let(types, lambda t: F.concat(F.lit("{"), F.array_join(F.transform(own, lambda e: F.concat(json_string(e["key"]), F.lit(": "), shape(e["value"], t[e["key"]], at + 1))), ", "), F.lit("}")))

        def of_list(v: Column) -> Column:
            first = lambda items: shape(F.get(F.from_json(raw, "array<string>"), F.lit(0)), F.get(items, F.lit(0)), at + 1)
            some = lambda items: F.concat(F.lit("["), first(items), F.lit(', "... ('), F.size(items).cast("string"), F.lit(' items)"]'))
            return let(v.cast("array<variant>"), lambda items: F.when(F.size(items) == 0, F.lit("[]")).otherwise(some(items)))

        def of_kind(schema: Column) -> Column:
            whole = (schema == "BIGINT") | schema.rlike(r"^DECIMAL\(\d+,0\)")
            text = F.concat(F.lit('"str('), F.length(F.variant_get(value, "$", "string")).cast("string"), F.lit(')"'))
            return (
                F.when(value.isNull() | (schema == "VOID"), F.lit('"null"')).when(schema.startswith("OBJECT"), of_object(value)).when(schema.startswith("ARRAY"), of_list(value))
                .when(schema == "STRING", text).when(schema == "BOOLEAN", F.lit('"bool"')).otherwise(F.when(whole, F.lit('"int"')).otherwise(F.lit('"float"')))
            )

        return let(F.schema_of_variant(value), of_kind)  # which goes through all of a value, and so once

    return let(F.try_parse_json(json), lambda v: F.when(v.isNotNull(), shape(json, v, 0)))
