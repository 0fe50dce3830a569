"""Objects: fields of structs, and maps of strings where the fields are open."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.arrays import col


def keys(m) -> Column:
    return F.map_keys(col(m))


def values(m) -> Column:
    return F.map_values(col(m))


def entries(m) -> Column:
    return F.map_entries(col(m))


def from_entries(pairs) -> Column:
    """Pairs (key, value) to an object; of equal keys the last counts."""
    pairs = col(pairs)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def assign(destination, source) -> Column:
    """A shallow merge in which the source wins."""
    destination, source = col(destination), col(source)
    return F.map_concat(F.map_filter(destination, lambda k, _: ~F.map_contains_key(source, k)), source)


def merge(left, right, resolve=None) -> Column:
    """As assign; with ``resolve(key, left, right)`` both values decide, and a null result removes the key."""
    left, right = col(left), col(right)
    merged = F.map_zip_with(left, right, resolve or (lambda k, a, b: F.when(F.map_contains_key(right, k), b).otherwise(a)))
    return F.map_filter(merged, lambda _, v: v.isNotNull())


def patched(data, patch) -> Column:
    """A merge patch: a null in it removes the field."""
    data, patch = col(data), col(patch)
    both = F.map_concat(F.map_filter(data, lambda k, _: ~F.map_contains_key(patch, k)), patch)
    return F.map_filter(both, lambda _, v: v.isNotNull())


def select(o, *path: str | int) -> Column:
    """The value at a path, or null."""
    return reduce(lambda c, p: F.try_element_at(c, F.lit(p + 1)) if isinstance(p, int) else c.getField(p), path, col(o))


def select_json(text, *path: str | int) -> Column:
    """The value at a path of a JSON text, as text, or null."""
    return F.get_json_object(col(text), "$" + "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path))


def select_all(a, *path: str) -> Column:
    """The values at a path in each element of an array."""
    return F.transform(col(a), lambda x: select(x, *path))


def has_path(o, *path: str | int) -> Column:
    return select(o, *path).isNotNull()


def contains_field(m, name: str) -> Column:
    return F.map_contains_key(col(m), F.lit(name))


def contains_value(m, value) -> Column:
    return F.exists(F.map_values(col(m)), lambda v: v.eqNullSafe(col(value)))


def to_json(o) -> Column:
    return F.to_json(col(o))


def to_array(m) -> Column:
    return F.map_entries(col(m))
