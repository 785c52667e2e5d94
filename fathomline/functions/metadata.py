"""Metadata of files: maps from strings to JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _variant(json: Column) -> Column:
    return F.try_parse_json(json)


def text_value(json: Column, key: str) -> Column:
    """The value of a key if it is a JSON string, else null; null for broken JSON."""
    v = F.try_variant_get(_variant(json), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def whole_value(json: Column, key: str) -> Column:
    """The value of a key if it is a whole JSON number from 0, else null."""
    v = F.try_variant_get(_variant(json), f"$.{key}", "variant")
    n = F.try_variant_get(v, "$", "bigint")
    return F.when((F.schema_of_variant(v) == "BIGINT") & (n >= 0), n)


def is_broken(json: Column) -> Column:
    """A value that isn't null and isn't JSON."""
    return json.isNotNull() & _variant(json).isNull()


def as_map(json: Column) -> Column:
    """An object's keys with their values as JSON text; empty for null, broken JSON and other values."""
    # a broken object parses to nulls; only objects are read
    ok = F.coalesce(F.schema_of_variant(_variant(json)).startswith("OBJECT"), F.lit(False))
    return F.coalesce(F.from_json(F.when(ok, json), "map<string,string>"), F.create_map().cast("map<string,string>"))


def merged(old: Column, new: Column) -> Column:
    """Both maps' entries, those of new where both have a key."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
