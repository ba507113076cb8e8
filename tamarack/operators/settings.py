"""Nested settings as VARIANT: typed lookup by path, recursive merge of overrides.

Settings are JSON texts, one a row. Both operators are expressions of the row: nothing is
shuffled, and the types of the values stay as they are.

Defined cases: a null, empty or broken text, or one that isn't an object, has no settings: a
lookup gives the default, a merge the other side (``{}`` if neither has any). A key that is
missing, or null, or stands below something that isn't an object gives the default. An override
of null is kept as null, so that a lookup gives the default. Keys come out in order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Objects are merged so many levels deep; below, an override replaces the whole.
DEPTH = 12


def parsed(config: Column) -> Column:
    """The settings as VARIANT; null for what has none."""
    value = F.try_parse_json(F.when(F.trim(config) != "", config))
    return F.when(_is_object(value), value)


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def lookup(config: Column, path: str, kind: str = "string", default=None) -> Column:
    """The value at a dotted path as ``kind`` (a type, or ``variant``); one of another type that
    can't be cast gives ``default``. A key with both kinds of quotes can't be asked for."""
    quoted = lambda step: f"['{step}']" if "'" not in step else f'["{step}"]'
    steps = "".join(map(quoted, path.split(".")))
    found = F.try_variant_get(parsed(config), "$" + steps, kind)
    return F.coalesce(found, F.lit(default).cast(kind)) if kind != "variant" else found


def merged(base: Column, override: Column) -> Column:
    """``override`` over ``base``, as JSON: objects are merged key by key, all else is replaced."""
    none = F.parse_json(F.lit("{}"))
    both = _over(F.coalesce(parsed(base), none), F.coalesce(parsed(override), none), DEPTH)
    return F.to_json(both)


def _over(base: Column, override: Column, depth: int) -> Column:
    """Merged objects, as VARIANT."""
    fields = lambda v: F.variant_get(v, "$", "map<string,variant>")

    def entry(below: Column, above: Column, key: Column) -> Column:
        old, new = F.try_element_at(below, key), F.try_element_at(above, key)
        value = F.when(F.map_contains_key(above, key), new).otherwise(old)
        if depth:
            value = F.when(_is_object(old) & _is_object(new), _over(old, new, depth - 1)).otherwise(value)
        return F.struct(key.alias("key"), value.alias("value"))

    def joined(below: Column, above: Column) -> Column:
        keys = F.array_union(F.map_keys(below), F.map_keys(above))
        return F.to_variant_object(F.map_from_entries(F.transform(keys, lambda k: entry(below, above, k))))

    # each side is read once: what a lambda refers to is a variable
    pair = F.array(F.struct(fields(base).alias("b"), fields(override).alias("o")))
    return F.element_at(F.transform(pair, lambda p: joined(p["b"], p["o"])), 1)
