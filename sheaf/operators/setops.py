"""Algebra of multisets: union at the greatest multiplicity, intersection at the least, difference by presence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 4096


def _counted(sets: tuple[DataFrame, ...]) -> DataFrame:
    """Each distinct row with its multiplicity in each set; counts are combined before the one shuffle."""
    columns = sets[0].columns
    if any(s.columns != columns for s in sets):
        raise ValueError("the sets differ in shape")
    marked = reduce(DataFrame.unionByName, [s.withColumn("_set", F.lit(k)) for k, s in enumerate(sets)])
    return marked.groupBy(*columns).agg(*[F.count_if(F.col("_set") == k).alias(f"_n{k}") for k in range(len(sets))])


def expanded(counted: DataFrame, times, columns: list[str]) -> DataFrame:
    """Rows as often as ``times`` says."""
    # in two steps, so that no array is long where a row is very frequent
    some = counted.withColumn("_times", times).where("_times > 0").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_times") - 1) / CHUNK))))
    own = F.least(F.lit(CHUNK), F.col("_times") - F.col("_chunk") * CHUNK).cast("int")
    return some.select(*(F.col(f"`{c}`") for c in columns), F.explode(F.array_repeat(F.lit(0), own)).alias("_copy")).drop("_copy")


def union_max(*sets: DataFrame) -> DataFrame:
    counts = [F.col(f"_n{k}") for k in range(len(sets))]
    return expanded(_counted(sets), F.greatest(*counts) if len(counts) > 1 else counts[0], sets[0].columns)


def intersection_min(*sets: DataFrame) -> DataFrame:
    counts = [F.col(f"_n{k}") for k in range(len(sets))]
    return expanded(_counted(sets), F.least(*counts) if len(counts) > 1 else counts[0], sets[0].columns)


def difference(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows that are in no other set, as often as the first has them."""
    for other in others:
        same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in first.columns])
        first = first.alias("a").join(other.distinct().alias("b"), same, "left_anti")
    return first


def ranged(ranges: DataFrame, points: DataFrame, equal: list[tuple[Column, Column]], bounds: tuple[Column, Column], point: Column, width: float) -> DataFrame:
    """Pairs with equal keys whose point lies in the range, both bounds included.

    The line is cut into stretches of ``width``, and a range is entered in each that it touches. Rows meet only within a stretch:
    pairs that fail are at most those of the two stretches at a range's ends, and a frequent key is dealt out over tasks.
    """
    low, high = bounds
    place = lambda c: F.floor(c / width)
    entered = ranges.where(low <= high).select("*", F.explode(F.sequence(place(low), place(high))).alias("_stretch"))
    keys = [b for _, b in equal]
    dealt = points.withColumn("_at", place(point)).repartition(*keys, "_at")
    same = reduce(lambda x, y: x & y, [a == b for a, b in equal])
    return entered.join(dealt, same & (F.col("_stretch") == F.col("_at")) & point.between(low, high)).drop("_stretch", "_at")


def sources(**sets: DataFrame) -> DataFrame:
    """Each distinct row, with the names of the sets that hold it."""
    names = sorted(sets)
    columns = sets[names[0]].columns
    marked = reduce(DataFrame.unionByName, [sets[n].withColumn("_source", F.lit(n)) for n in names])
    return marked.groupBy(*columns).agg(F.sort_array(F.collect_set("_source")).alias("sources"))


def index_join(source: DataFrame, target: DataFrame, on, columns: list[str]) -> DataFrame:
    """Elements of the target that the source's values reach, each once."""
    return target.join(source.distinct(), on, "left_semi").select(*columns).distinct()


def semi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_anti")


def historical(sets: dict[str, DataFrame], keys: list[str], rule: str) -> DataFrame:
    """Events of a set made of others: add where membership begins, remove where it ends.

    Each set has the keys, ts and action (add or remove). rule: union, intersection or difference (of the
    first, by name order given, with the rest).
    """
    from pyspark.sql import Window as W

    marked = reduce(DataFrame.unionByName, [s.select(*keys, "ts", "action").withColumn("_set", F.lit(k)) for k, s in enumerate(sets.values())])
    n = len(sets)
    step = F.when(F.col("action") == "add", 1).otherwise(-1)
    upto = W.partitionBy(*keys).orderBy("ts").rangeBetween(W.unboundedPreceding, W.currentRow)
    present = [F.sum(F.when(F.col("_set") == k, step).otherwise(0)).over(upto) > 0 for k in range(n)]
    rules = {"union": reduce(lambda a, b: a | b, present), "intersection": reduce(lambda a, b: a & b, present), "difference": reduce(lambda a, b: a & ~b, present)}
    seen = marked.select(*keys, "ts", rules[rule].alias("_in")).distinct()
    was = F.coalesce(F.lag("_in").over(W.partitionBy(*keys).orderBy("ts")), F.lit(False))
    return seen.withColumn("_was", was).where("_in <> _was").select(*keys, "ts", F.when(F.col("_in"), "add").otherwise("remove").alias("action"))
