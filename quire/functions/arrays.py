"""Arrays of objects as a document's lists behave: indexes from either end, slices, edits that give a new list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(items: Column, i: int) -> Column:
    """The item at a place, from the end where it is negative; null beyond."""
    return F.get(items, F.lit(i) if i >= 0 else F.size(items) + i)


def sliced(items: Column, start: int | None = None, stop: int | None = None, step: int = 1) -> Column:
    """``items[start:stop:step]``."""
    if step == 0:
        raise ValueError("a slice has a step")
    n = F.size(items)
    low, high = (F.lit(0), n) if step > 0 else (F.lit(-1), n - 1)
    bound = lambda x, default: default if x is None else F.least(F.greatest(F.lit(x) if x >= 0 else n + x, low), high)
    first, last = (bound(start, low), bound(stop, high)) if step > 0 else (bound(start, high), bound(stop, low))
    inside = (lambda i: (i >= first) & (i < last)) if step > 0 else (lambda i: (i <= first) & (i > last))
    own = F.filter(F.transform(items, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda z: inside(z.i) & ((z.i - first) % step == 0))
    kept = F.transform(own, lambda z: z.x)
    return kept if step > 0 else F.reverse(kept)


def has(items: Column, value: Column) -> Column:
    """Whether the list holds the value."""
    return F.exists(items, lambda x: x.eqNullSafe(value))


def append(items: Column, value: Column) -> Column:
    return F.concat(items, F.array(value))


def extend(items: Column, *others: Column) -> Column:
    return F.concat(items, *others)


def insert(items: Column, i: int, value: Column) -> Column:
    """Before the item at a place; beyond either end at that end."""
    n = F.size(items)
    place = F.greatest(F.lit(0), n + i) if i < 0 else F.least(F.lit(i), n)
    return F.concat(F.slice(items, F.lit(1), place), F.array(value), F.slice(items, place + 1, n - place))


def pop(items: Column, i: int = -1) -> Column:
    """The item at a place and the list without it; both null beyond the ends."""
    n = F.size(items)
    place = F.lit(i) if i >= 0 else n + i
    return F.when((place >= 0) & (place < n), F.struct(F.get(items, place).alias("value"), F.concat(F.slice(items, F.lit(1), place), F.slice(items, place + 2, n)).alias("items")))


def index(items: Column, value: Column) -> Column:
    """The place of the first such item; null where there is none."""
    return F.nullif(F.array_position(items, value), F.lit(0)) - 1


def count(items: Column, value: Column) -> Column:
    return F.size(F.filter(items, lambda x: x.eqNullSafe(value)))


def remove(items: Column, value: Column) -> Column:
    """Without the first such item; null where there is none."""
    place = index(items, value)
    n = F.size(items)
    return F.when(place.isNotNull(), F.concat(F.slice(items, F.lit(1), place), F.slice(items, place + 2, n)))


def wrapped(json: Column) -> Column:
    """A value as a list of one; a list stays. Values are JSON texts."""
    return F.when(F.ltrim(json).startswith("["), json).otherwise(F.concat(F.lit("["), json, F.lit("]")))


def is_rectangle(items: Column) -> Column:
    """Whether the list is of four numbers (null for what is none)."""
    return (F.size(items) == 4) & F.forall(items, lambda x: x.isNotNull())


def has_key(json: Column, key: str) -> Column:
    """Whether a dictionary has the key; its values are no keys."""
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


def length(json: Column) -> Column:
    """How many entries a dictionary or items a list has; null for another value."""
    return F.coalesce(F.size(F.json_object_keys(json)), F.json_array_length(json))


def truth(json: Column) -> Column:
    """Whether a dictionary or list has anything in it."""
    return length(json) > 0
