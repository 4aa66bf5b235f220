"""Loose JSON records: key aliases, defaults, shape checks against a schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repaired(record: Column, aliases: dict[str, str], defaults: dict[str, str]) -> Column:
    """A JSON object of text values as a map: keys by their proper names, defaults where a key is missing.

    A proper key wins over an alias of it.
    """
    m = F.coalesce(F.from_json(record, "map<string,string>"), F.create_map().cast("map<string,string>"))
    names = sorted({*aliases.values(), *defaults})
    values = []
    for name in names:
        given = [F.try_element_at(m, F.lit(key)) for key in (name, *(a for a, to in aliases.items() if to == name))]
        values += [F.lit(name), F.coalesce(*given, F.lit(defaults.get(name)))]
    known = [*names, *aliases]
    return F.map_concat(F.map_filter(m, lambda k, v: ~k.isin(*known)), F.map_filter(F.create_map(*values), lambda k, v: v.isNotNull()))


def kind_of(record: Column, key: str) -> Column:
    """The JSON type of a key's value; NULL where there is no such key."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(record), f"$.{key}", "variant"))
    named = F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "VOID", "null").otherwise("number")
    return F.when(kind.isNotNull(), named)


def problems(record: Column, properties: dict[str, str], required: list[str] | None = None) -> Column:
    """What is wrong with a JSON object: missing keys, values of another type; the top level only."""
    found = []
    for key in required if required is not None else list(properties):
        kind, wanted = kind_of(record, key), properties.get(key)
        wrong = F.lit(False) if wanted is None else kind != wanted
        found.append(F.when(kind.isNull(), F.lit(f"missing:{key}")).when(wrong, F.lit(f"wrongtype:{key} (want {wanted})")))
    is_object = F.schema_of_variant(F.try_parse_json(record)).startswith("OBJECT")
    return F.when(F.coalesce(is_object, F.lit(False)), F.array_compact(F.array(*found))).otherwise(F.array(F.lit("not an object")))


def integer_types(schema: Column) -> Column:
    """How many properties of a schema (JSON text) have the type integer, which the service rejects."""
    return F.size(F.regexp_extract_all(schema, F.lit(r'"type"\s*:\s*"(integer)"'), 1))


def fetched(status: Column, body: Column) -> Column:
    """The body of a response: NULL for one that was not found (404), an error for any other status than 200, a missing one too."""
    told = F.concat(F.lit("fetch failed with status "), F.coalesce(status.cast("string"), F.lit("none")))
    return F.when(status == 200, body).when(status == 404, F.lit(None)).otherwise(F.raise_error(told))


def decoded(json: Column, fields: dict[str, tuple[str, object]]) -> Column:
    """A record of JSON text with the fields (type, default): a field that is missing, null or of another type has its default; text that is no object gives NULL."""
    value = F.try_parse_json(json)
    read = [F.coalesce(F.try_variant_get(value, f"$['{name}']", kind), F.lit(default).cast(kind)).alias(name) for name, (kind, default) in fields.items()]
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.struct(*read))
