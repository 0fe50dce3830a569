"""Ordered sets: a DataFrame with the keys that order it.

Nothing is sorted until rows leave: filters, maps and reversals only rewrite the plan, and a limit
after an order runs as a bounded top-k. Where rows are cut off, by take, drop or a page, the other columns
of simple types break ties after the keys, so rows that still tie are alike and only their number counts.
"""

from __future__ import annotations

import base64
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.operators.setops import expanded

Key = tuple[str, bool]
Predicate = Column | Callable[[DataFrame], Column]
PAGE = 16
SLICE = 500_000  # rows of a slice that a fold by columns takes at a time
WIDE = 32_000  # the same where a row's size has no bound


def shared_folder(spark) -> str | None:
    """The folder that the cluster shares: ``spark.checkpoint.dir``; on one machine a temporary one, else None."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    return found or (tempfile.gettempdir() if re.fullmatch(r"local(\[[^\]]*\])?", sc.master) else None)


def _further(value: Any, reducer: Callable) -> Callable[[Iterator[Row]], Iterator[Any]]:
    """A task's part of a fold."""

    def run(rows: Iterator[Row]) -> Iterator[Any]:
        out = value
        for row in rows:
            out = reducer(out, row)
        yield out

    return run


def _grouped(pieces: list[tuple], size: int) -> Iterator[list[tuple]]:
    """Pieces, each with its number of rows first, as runs of at most ``size`` rows."""
    some, n = [], 0
    for piece in pieces:
        if some and n + piece[0] > size:
            yield some
            some, n = [], 0
        some.append(piece)
        n += piece[0]
    if some:
        yield some


def keys_of(*names: str) -> tuple[Key, ...]:
    """``"-x"`` is descending."""
    return tuple((n.lstrip("-"), not n.startswith("-")) for n in names)


@dataclass(frozen=True)
class Page:
    data: list[Row]
    after: str | None = None
    before: str | None = None


@dataclass(frozen=True)
class Ordered:
    """Null is the greatest value of every key."""

    df: DataFrame
    keys: tuple[Key, ...]
    size: int = PAGE

    @classmethod
    def of(cls, df: DataFrame, *names: str) -> Ordered:
        return cls(df, keys_of(*names))

    @classmethod
    def sequence(cls, spark, low: int, high: int) -> Ordered:
        return cls.of(spark.range(low, max(low, high)).withColumnRenamed("id", "value"), "value")

    @classmethod
    def single(cls, df: DataFrame) -> Ordered:
        return cls(df, ())

    def _with(self, df: DataFrame, keys: tuple[Key, ...] | None = None) -> Ordered:
        return replace(self, df=df, keys=self.keys if keys is None else keys)

    def _column(self, p: Predicate) -> Column:
        return p(self.df) if callable(p) else p

    @property
    def sort(self) -> list[Column]:
        return [F.asc_nulls_last(k) if up else F.desc_nulls_first(k) for k, up in self.keys]

    @property
    def total(self) -> Ordered:
        """By the keys, then by all other columns of simple types."""
        known = {k for k, _ in self.keys}
        simple = [f.name for f in self.df.schema if f.name not in known and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
        up = self.keys[0][1] if self.keys else True  # so that a reversed set is cut at the same rows
        return self._with(self.df, (*self.keys, *((n, up) for n in simple)))

    # lazy

    def where(self, p: Predicate) -> Ordered:
        return self._with(self.df.where(self._column(p)))

    def map(self, **columns: Column) -> Ordered:
        """Project; keys that are not projected are carried along as they order the result."""
        carried = [k for k, _ in self.keys if k not in columns]
        return self._with(self.df.select(*[c.alias(n) for n, c in columns.items()], *carried))

    def flat_map(self, inner: Ordered, on: Column | list[str], how: str = "inner") -> Ordered:
        """For each row the rows of ``inner`` that ``on`` relates to it; the outer order, then the inner."""
        return self._with(self.df.join(inner.df, on, how), self.keys + tuple(k for k in inner.keys if k not in self.keys))

    def explode(self, array: Column, name: str) -> Ordered:
        place = f"{name}_at"
        return self._with(self.df.select("*", F.posexplode(array).alias(place, name)), (*self.keys, (place, True)))

    def order(self, *names: str) -> Ordered:
        """By new keys; the old ones break ties, which makes the sort stable."""
        new = keys_of(*names)
        return self._with(self.df, new + tuple(k for k in self.keys if k[0] not in {n for n, _ in new}))

    def reverse(self) -> Ordered:
        return self._with(self.df, tuple((k, not up) for k, up in self.keys))

    def distinct(self) -> Ordered:
        """Distinct rows, in the order of their values."""
        return self._with(self.df.distinct(), tuple((c, True) for c in self.df.columns))

    def concat(self, other: Ordered, name: str = "part") -> Ordered:
        """These rows, then the other's; both must be ordered by the same keys."""
        if self.keys != other.keys:
            raise ValueError("both sides need the same keys")
        both = self.df.withColumn(name, F.lit(0)).unionByName(other.df.withColumn(name, F.lit(1)))
        return self._with(both, ((name, True), *self.keys))

    def take(self, n: int) -> Ordered:
        if n < 0:
            raise ValueError("take needs a number of at least zero")
        return self._with(self.df.orderBy(*self.total.sort).limit(n))

    def drop(self, n: int) -> Ordered:
        """The rows past the n-th: its key is found by a bounded top-k, and the rest is a filter, not a global offset.

        Rows that are alike and of which the n-th is one stay as often as the first n do not have them.
        """
        if n <= 0:
            return self
        whole = self.total
        names = [f"_last_{k}" for k, _ in whole.keys]
        head = self.take(n).df
        last = whole._with(head).reverse().take(1).df.select(*[F.col(f"`{k}`").alias(m) for (k, _), m in zip(whole.keys, names)])
        past, same = F.lit(False), F.lit(True)
        for (k, up), m in reversed(list(zip(whole.keys, names))):
            c, o = F.col(f"`{k}`"), F.col(f"`{m}`")
            later = (c > o) if up else (c < o)
            over = (c.isNull() & o.isNotNull()) if up else (c.isNotNull() & o.isNull())
            past = F.coalesce(later, F.lit(False)) | over | (c.eqNullSafe(o) & past)
            same = same & c.eqNullSafe(o)
        rest = self.df.join(F.broadcast(last), past).drop(*names)  # one row is broadcast
        taken = head.join(F.broadcast(last), same).agg(F.count(F.lit(1)).alias("_taken"))
        alike = self.df.join(F.broadcast(last), same).drop(*names)
        columns = self.df.columns
        if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) for f in self.df.schema):
            some = alike.agg(F.count(F.lit(1)).alias("_n"), F.collect_list(F.struct(*(F.col(f"`{c}`") for c in columns))).alias("_rows"))
            left = some.crossJoin(F.broadcast(taken)).select(F.explode(F.slice("_rows", F.col("_taken").cast("int") + 1, F.col("_n").cast("int"))).alias("_row")).select("_row.*")
        else:
            times = alike.groupBy(*(F.col(f"`{c}`") for c in columns)).agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(taken))  # one row
            left = expanded(times, F.col("_n") - F.col("_taken"), columns)
        return self._with(rest.unionByName(left))

    def page_size(self, n: int) -> Ordered:
        return replace(self, size=n)

    def range(self, low: tuple = (), high: tuple = ()) -> Ordered:
        """Keys from a prefix to a prefix, both included; in a reversed set low is the greater one."""
        return self.where(self._beyond(low, True, True) & self._beyond(high, False, True))

    def _beyond(self, prefix: tuple, after: bool, inclusive: bool) -> Column:
        """Rows on one side of a key prefix, as a disjunction that reaches the scan as a filter."""
        out = F.lit(inclusive) if prefix else F.lit(True)
        for (k, up), value in reversed(list(zip(self.keys, prefix))):
            c, same = F.col(f"`{k}`"), F.col(f"`{k}`").eqNullSafe(F.lit(value))
            if value is None:
                past = F.lit(False) if up == after else c.isNotNull()
            else:
                past = (F.coalesce(c > value, F.lit(True)) if up == after else F.coalesce(c < value, F.lit(False)))
            out = past | (same & out)
        return out

    # what leaves

    def to_df(self) -> DataFrame:
        return self.df.orderBy(*self.sort) if self.keys else self.df

    def rows(self) -> Iterator[Row]:
        """All rows in order, a partition at a time."""
        return self.to_df().toLocalIterator(prefetchPartitions=True)

    def slices(self, columns: dict[str, Column]) -> Iterator[DataFrame]:
        """All rows in order, in frames of one row each: their columns as an array ``v`` of structs.

        The rows are sorted once, numbered by partition and place and written to files of at most ``SLICE`` rows. Each frame
        is a file, or small ones in a row, read by one task, so no larger array is ever held and no row comes to the driver.
        Where there is no shared folder the executors keep the sorted rows, and each frame's tasks look through all of them.
        """
        names = [f"c{k}" for k in range(len(columns))]
        rows = self.to_df().select(F.monotonically_increasing_id().alias("at"), *[c.alias(n) for n, c in zip(names, columns.values())])
        spark, schema = rows.sparkSession, rows.schema
        fixed = all(isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) for f in schema)
        size = SLICE if fixed else min(SLICE, WIDE)
        packed = F.collect_list(F.struct("at", *[F.col(n).alias(c) for n, c in zip(names, columns)]))
        if any(kind in schema.simpleString() for kind in ("map<", "variant", "interval")):
            packed = F.array_sort(packed, lambda a, b: F.when(a["at"] < b["at"], -1).otherwise(1))
        else:
            packed = F.sort_array(packed)  # the numbers differ, so nothing after them is compared
        bounds = [F.min("at").alias("low"), F.max("at").alias("high"), F.count("at").alias("n")]
        shared = shared_folder(spark)
        if shared is None or any(kind in schema.simpleString() for kind in ("void", "interval", "struct<>")):  # nowhere to write, or no file holds them
            rows = rows.persist()
            try:
                ranges = []
                for r in rows.groupBy(F.shiftright("at", 33)).agg(*bounds).orderBy("low").collect():
                    ranges += [(min(size, r["high"] + 1 - low), low, min(low + size - 1, r["high"])) for low in range(r["low"], r["high"] + 1, size)]
                for some in _grouped(ranges, size):
                    yield rows.where(F.col("at").between(some[0][1], some[-1][2])).agg(packed.alias("v"))
            finally:
                rows.unpersist()
            return
        folder = f"{shared}/sheaf-slices-{uuid.uuid4().hex}"
        try:
            rows.write.option("maxRecordsPerFile", size).parquet(folder)
            files = spark.read.schema(schema).parquet(folder).groupBy("_metadata.file_name").agg(*bounds).orderBy("low").collect()
            if any(r["high"] - r["low"] + 1 != r["n"] for r in files):
                raise RuntimeError("a file of a sorted set does not hold rows in a row")
            for some in _grouped([(r["n"], f"{folder}/{r['file_name']}") for r in files], size):
                yield spark.read.schema(schema).parquet(*[name for _, name in some]).coalesce(1).agg(packed.alias("v"))
        finally:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def to_array(self, name: str = "data") -> DataFrame:
        """One row with all rows as an array: for sets that fit one."""
        cols = [k for k, _ in self.keys]
        packed = F.collect_list(F.struct(*cols, F.struct(*self.df.columns).alias("row")))
        return self.df.agg(F.transform(F.sort_array(packed), lambda x: x["row"]).alias(name))

    def first(self) -> DataFrame:
        return self.take(1).df

    def last(self) -> DataFrame:
        return self.reverse().take(1).df

    def first_where(self, p: Predicate) -> DataFrame:
        return self.where(p).first()

    def last_where(self, p: Predicate) -> DataFrame:
        return self.where(p).last()

    def count(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("count"))

    def is_empty(self) -> DataFrame:
        return self.df.limit(1).agg((F.count(F.lit(1)) == 0).alias("is_empty"))

    def non_empty(self) -> DataFrame:
        return self.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("non_empty"))

    def any(self, p: Predicate) -> DataFrame:
        return self.df.where(self._column(p)).limit(1).agg((F.count(F.lit(1)) > 0).alias("any"))

    def every(self, p: Predicate) -> DataFrame:
        return self.df.where(~F.coalesce(self._column(p), F.lit(False))).limit(1).agg((F.count(F.lit(1)) == 0).alias("every"))

    def includes(self, **values: Any) -> DataFrame:
        same = F.lit(True)
        for k, v in values.items():
            same = same & F.col(k).eqNullSafe(F.lit(v))
        return self.df.where(same).limit(1).agg((F.count(F.lit(1)) > 0).alias("includes"))

    def aggregate(self, **columns: Column) -> DataFrame:
        """Associative folds, as built-in aggregates with partial results."""
        return self.df.agg(*[c.alias(n) for n, c in columns.items()])

    def fold(self, seed: Any, reducer: Callable[[Any, Row], Any]) -> Any:
        """Any reducer, row by row in order, where the rows are: a task for each partition goes on from the last one's value, and
        only that comes to the driver. Use aggregate where it is associative.

        What a reducer does besides is lost there: ``for_each`` is for that. One that can't be sent runs on the driver, in the
        memory of one partition.
        """
        try:
            cloudpickle.dumps((seed, reducer))
        except Exception:  # what can't be sent tells so by errors of many types
            for row in self.rows():
                seed = reducer(seed, row)
            return seed
        rows = self.to_df().rdd  # its shuffle is done once, for all the tasks
        for k in range(rows.getNumPartitions()):
            seed = rows.context.runJob(rows, _further(seed, reducer), [k])[0]
        return seed

    def fold_right(self, seed: Any, reducer) -> Any:
        return self.reverse().fold(seed, reducer)

    def reduce(self, reducer) -> Any:
        """Without a seed; None where empty."""
        out = self.fold((), lambda a, r: (reducer(a[0], r),) if a else (r,))
        return out[0] if out else None

    def reduce_right(self, reducer) -> Any:
        return self.reverse().reduce(reducer)

    def for_each(self, f: Callable[[Row], None]) -> None:
        for row in self.rows():
            f(row)

    # pages

    def _cursor(self, row: Row, seen: int) -> str:
        """The values of a row in the total order, and how many rows like it came so far."""
        return base64.urlsafe_b64encode(json.dumps([[row[k] for k, _ in self.total.keys], seen], default=str).encode()).decode()

    @staticmethod
    def _open(cursor: str) -> tuple[tuple, int]:
        values, seen = json.loads(base64.urlsafe_b64decode(cursor))
        return tuple(values), seen

    def after(self, prefix: tuple, inclusive: bool = False) -> Ordered:
        return self.where(self._beyond(prefix, True, inclusive))

    def before(self, prefix: tuple) -> Ordered:
        """The rows before a key, nearest first."""
        return self.where(self._beyond(prefix, False, False)).reverse()

    def paginate(self, cursor: str | None = None, size: int | None = None) -> Page:
        """A page and the cursor of the next: keys seek into the data, so late pages cost as little as early ones."""
        size, whole = size or self.size, self.total
        place, seen = self._open(cursor) if cursor else ((), 0)
        rows = (whole.after(place, inclusive=True) if cursor else whole).take(size + 1 + seen).df.collect()
        data = rows[seen : seen + size]
        more = len(rows) > seen + size
        alike = lambda r: [r[k] for k, _ in whole.keys]
        count = sum(alike(r) == alike(data[-1]) for r in rows[: seen + size]) if data else 0
        return Page(data, self._cursor(data[-1], count) if more else None, self._cursor(data[0], 0) if data else None)
