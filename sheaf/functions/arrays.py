"""Array functions as Column builders; indexes count from zero, misses are null, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str
Fn = Callable[[Column], Column]


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def holds(p: Column) -> Column:
    """A predicate whose null counts as false."""
    return F.coalesce(p, F.lit(False))


def sequence(low, high) -> Column:
    """Integers from low to below high; empty where low >= high."""
    low, high = col(low), col(high)
    return F.when(low < high, F.sequence(low, F.greatest(high - 1, low))).otherwise(F.expr("cast(array() as array<int>)"))


def length(a) -> Column:
    return F.size(col(a))


def at(a, i) -> Column:
    """The element at an index; an error outside the array."""
    a, i = col(a), col(i)
    inside = (i >= 0) & (i < F.size(a))
    return F.when(inside, F.get(a, F.when(inside, i).otherwise(0))).otherwise(F.raise_error(F.lit("array index out of bounds")))


access = at


def fold(a, seed, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(col(a), col(seed), f)


def fold_right(a, seed, f) -> Column:
    return F.aggregate(F.reverse(col(a)), col(seed), f)


def aggregate(a, seed, combine) -> Column:
    """The seed is combined last: combine(value, seed)."""
    return F.coalesce(combine(reduce(a, combine), col(seed)), col(seed))


def reduce(a, f) -> Column:
    """Left to right without a seed; null where empty."""
    a = col(a)
    # under ANSI every branch is evaluated lazily, so an empty array never reaches the slice
    return F.when(F.size(a) > 0, F.aggregate(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.get(a, F.lit(0)), f))


def reduce_right(a, f) -> Column:
    return reduce(F.reverse(col(a)), f)


def any_(a, p: Fn) -> Column:
    return F.exists(col(a), lambda x: holds(p(x)))


def every(a, p: Fn) -> Column:
    return F.forall(col(a), lambda x: holds(p(x)))


def append(a, x) -> Column:
    return F.array_append(col(a), col(x))


def prepend(a, x) -> Column:
    return F.array_prepend(col(a), col(x))


def concat(a, b) -> Column:
    return F.concat(col(a), col(b))


def distinct(a) -> Column:
    """First occurrences, in order."""
    return F.array_distinct(col(a))


def take(a, n) -> Column:
    return F.slice(col(a), 1, F.greatest(col(n), F.lit(0)))


def drop(a, n) -> Column:
    a, n = col(a), F.greatest(col(n), F.lit(0))
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def take_signed(a, n) -> Column:
    """As take; a negative n takes from the end."""
    a, n = col(a), col(n)
    return F.when(n >= 0, take(a, n)).otherwise(drop(a, F.size(a) + n))


def drop_signed(a, n) -> Column:
    """As drop; a negative n drops from the end."""
    a, n = col(a), col(n)
    return F.when(n >= 0, drop(a, n)).otherwise(take(a, F.size(a) + n))


def slice_(a, low, high=None) -> Column:
    """From low to below high; bounds outside the array are drawn in."""
    a = col(a)
    low = F.greatest(col(low), F.lit(0))
    high = F.size(a) if high is None else F.least(col(high), F.size(a))
    return F.slice(a, low + 1, F.greatest(high - low, F.lit(0)))


def entries(a) -> Column:
    """Pairs (index, value)."""
    return F.transform(col(a), lambda x, i: F.struct(i.alias("index"), x.alias("value")))


def filter_(a, p: Fn) -> Column:
    return F.filter(col(a), p)


where = filter_


def map_(a, f: Fn) -> Column:
    return F.transform(col(a), f)


def flatten(a) -> Column:
    return F.flatten(col(a))


def flat_map(a, f: Fn) -> Column:
    return F.flatten(F.transform(col(a), f))


def first(a) -> Column:
    return F.get(col(a), F.lit(0))


def last(a) -> Column:
    return F.try_element_at(col(a), F.lit(-1))


def first_where(a, p: Fn) -> Column:
    return first(F.filter(col(a), p))


def last_where(a, p: Fn) -> Column:
    return last(F.filter(col(a), p))


def index_where(a, p: Fn, start=0) -> Column:
    """First index from start on where p holds, or null."""
    return F.array_min(F.transform(col(a), lambda x, i: F.when(holds(p(x)) & (i >= col(start)), i)))


def last_index_where(a, p: Fn, end=None) -> Column:
    """Last index up to end where p holds, or null."""
    ok = (lambda i: F.lit(True)) if end is None else (lambda i: i <= col(end))
    return F.array_max(F.transform(col(a), lambda x, i: F.when(holds(p(x)) & ok(i), i)))


def index_of(a, x, start=0) -> Column:
    return index_where(a, lambda y: y.eqNullSafe(col(x)), start)


def last_index_of(a, x, end=None) -> Column:
    return last_index_where(a, lambda y: y.eqNullSafe(col(x)), end)


def includes(a, x) -> Column:
    return F.exists(col(a), lambda y: y.eqNullSafe(col(x)))


def is_empty(a) -> Column:
    return F.size(col(a)) == 0


def non_empty(a) -> Column:
    return F.size(col(a)) > 0


def reverse(a) -> Column:
    return F.reverse(col(a))


def order(a, *keys: tuple[Fn, bool]) -> Column:
    """Sorted by keys (accessor, ascending); without keys by value. Nulls are the greatest."""
    if not keys:
        return F.array_sort(col(a))

    def compare(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for key, up in reversed(keys):
            p, q = (key(x), key(y)) if up else (key(y), key(x))
            out = F.when(p.eqNullSafe(q), out).when(q.isNull() | (p < q), -1).otherwise(1)
        return out

    return F.array_sort(col(a), compare)


def union_max(*arrays) -> Column:
    """Multiset union of arrays; each value at its greatest multiplicity, in order of first occurrence."""
    all_ = F.concat(*map(col, arrays))
    times = lambda x: F.greatest(*[F.size(F.filter(col(a), lambda y: y.eqNullSafe(x))) for a in arrays], F.lit(0))
    return F.flatten(F.transform(F.array_distinct(all_), lambda x: F.array_repeat(x, times(x))))


def intersection_min(*arrays) -> Column:
    """Multiset intersection; each value at its least multiplicity."""
    times = lambda x: F.least(*[F.size(F.filter(col(a), lambda y: y.eqNullSafe(x))) for a in arrays], F.lit(1 << 30))
    return F.flatten(F.transform(F.array_distinct(col(arrays[0])), lambda x: F.array_repeat(x, times(x))))


def difference(a, *others) -> Column:
    """Multiset difference: each value as often as it is left over."""
    count = lambda c, x: F.size(F.filter(col(c), lambda y: y.eqNullSafe(x)))

    def left(x: Column) -> Column:
        n = count(a, x)
        for o in others:
            n = n - count(o, x)
        return F.greatest(n, F.lit(0))

    return F.flatten(F.transform(F.array_distinct(col(a)), lambda x: F.array_repeat(x, left(x))))


def sum_(a) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x)


def mean(a) -> Column:
    """Always a double; an error where empty."""
    a = col(a)
    return F.when(F.size(a) > 0, sum_(a) / F.size(a)).otherwise(F.raise_error(F.lit("mean of an empty array")))


def count(a) -> Column:
    return F.size(col(a))


def max_(a) -> Column:
    return F.array_max(col(a))


def min_(a) -> Column:
    return F.array_min(col(a))


def all_true(a) -> Column:
    return every(a, lambda x: x)


def any_true(a) -> Column:
    return any_(a, lambda x: x)
