"""Collections: tables with gradual schemas, computed fields, checks, unique constraints and indexes.

An index is a lookup by equal terms, ordered by covered values and id. It is a plan over the
collection; ``build`` writes it as a table bucketed by its terms, so lookups and joins on them read
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.operators.ordered import Ordered, keys_of
from sheaf.sources.identity import Identity

Builder = Callable[[DataFrame], Column]


@dataclass(frozen=True)
class Index:
    """terms: columns matched by equality; values: covered columns, ``-x`` descending; multi: terms that are arrays."""

    name: str
    terms: tuple[str, ...]
    values: tuple[str, ...] = ()
    multi: tuple[str, ...] = ()
    computed: dict[str, Builder] = field(default_factory=dict)

    @classmethod
    def folded(cls, name: str, terms: tuple[str, ...], values: tuple[str, ...] = (), fold: tuple[str, ...] = (), bindings: dict[str, Builder] | None = None) -> Index:
        """An index whose text terms of ``fold`` are case-folded, as lookups are to be, and with bindings: terms that are computed."""
        from sheaf.functions import strings

        own = lambda t: lambda df: strings.casefold((bindings or {})[t](df) if t in (bindings or {}) else df[t])
        return cls(name, terms, values, (), {**(bindings or {}), **{t: own(t) for t in fold}})

    def entries(self, df: DataFrame, id_: str) -> DataFrame:
        """Terms, values and id; one row for each distinct element of an array term, none where all terms are null."""
        for n, b in self.computed.items():
            df = df.withColumn(n, b(df))
        covered = [v.lstrip("-") for v in self.values]
        out = df.select(*dict.fromkeys([*self.terms, *covered, id_]))
        for t in self.multi:
            out = out.withColumn(t, F.explode_outer(F.array_distinct(t)))
        if self.terms:
            out = out.where(reduce(lambda a, b: a | b, [F.col(t).isNotNull() for t in self.terms]))
        return out  # ids are unique and arrays' elements distinct, so entries are, too


@dataclass(frozen=True)
class Migration:
    """add, drop, move, split or backfill of fields; applied in order when an older version is read."""

    kind: str
    name: str
    to: tuple[str, ...] = ()
    value: Builder | None = None
    type: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.kind == "add":
            value = self.value(df) if self.value else F.lit(None)
            return df if self.name in df.columns else df.withColumn(self.name, value.cast(self.type) if self.type else value)
        if self.kind == "drop":
            return df.drop(self.name)
        if self.kind == "move":
            return df.withColumnRenamed(self.name, self.to[0])
        if self.kind == "backfill":
            return df.withColumn(self.name, F.coalesce(F.col(self.name), self.value(df)))
        if self.kind == "split":
            # values of the first type go to the first field, what remains to the second
            first, rest = self.to
            cast = F.col(self.name).try_cast(self.type)
            return df.withColumns({first: cast, rest: F.when(cast.isNull(), F.col(self.name))}).drop(self.name)
        raise ValueError(f"no migration {self.kind}")


@dataclass(frozen=True)
class Collection:
    name: str
    df: DataFrame
    id: str = "id"
    defaults: dict[str, Builder] = field(default_factory=dict)
    computed: dict[str, Builder] = field(default_factory=dict)
    checks: dict[str, Builder] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    foreign: dict[str, Collection] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)
    migrations: tuple[Migration, ...] = ()
    readable: Builder | None = None

    @property
    def rows(self) -> DataFrame:
        """Migrated, with defaults and computed fields, and only what the role may read."""
        df = reduce(lambda d, m: m.apply(d), self.migrations, self.df)
        for n, b in self.defaults.items():
            df = df.withColumn(n, F.coalesce(F.col(n), b(df)) if n in df.columns else b(df))
        for n, b in self.computed.items():
            df = df.withColumn(n, b(df))
        return df.where(F.coalesce(self.readable(df), F.lit(False))) if self.readable else df

    def with_index(self, index: Index) -> Collection:
        return replace(self, indexes={**self.indexes, index.name: index})

    def all(self, low=None, high=None) -> Ordered:
        df = self.rows
        if low is not None:
            df = df.where(F.col(self.id) >= low)
        if high is not None:
            df = df.where(F.col(self.id) <= high)
        return Ordered.of(df, self.id)

    def where(self, p) -> Ordered:
        return self.all().where(p)

    def first_where(self, p) -> DataFrame:
        return self.all().first_where(p)

    def by_id(self, id_) -> DataFrame:
        return self.rows.where(F.col(self.id) == id_)

    def by_index(self, name: str, *terms, low: tuple = (), high: tuple = ()) -> Ordered:
        """Rows of equal terms in the index's order, within a range of value prefixes, both ends included."""
        index, df = self.indexes[name], self.rows
        for n, b in index.computed.items():
            df = df.withColumn(n, b(df))
        for t, v in zip(index.terms, terms, strict=True):
            df = df.where(F.array_contains(t, v) if t in index.multi else F.col(t) == v)
        return Ordered(df, (*keys_of(*index.values), *(() if self.id in index.values else keys_of(self.id)))).range(low, high)

    def build(self, name: str, buckets: int) -> DataFrame:
        """The index as a saved table, bucketed by terms and sorted by values within them."""
        index = self.indexes[name]
        table = f"{self.name}_{name}"
        sort = [v.lstrip("-") for v in index.values if not v.startswith("-")] or [self.id]
        index.entries(self.rows, self.id).write.mode("overwrite").bucketBy(buckets, *index.terms).sortBy(*index.terms, *sort).saveAsTable(table)
        return self.df.sparkSession.table(table)

    # constraints: queries whose rows are the violations

    def check_violations(self) -> DataFrame:
        """A check must be true: null rejects."""
        df, out = self.rows, []
        for n, b in self.checks.items():
            out.append(df.where(~F.coalesce(b(df), F.lit(False))).select(self.id, F.lit(n).alias("check")))
        return reduce(DataFrame.unionByName, out)

    def unique_violations(self) -> DataFrame:
        df, out = self.rows, []
        for names in self.unique:
            known = df.where(reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names]))
            twice = known.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min(self.id).alias("first")).where("n > 1")
            out.append(twice.select(F.concat_ws(",", *[F.lit(n) for n in names]).alias("constraint"), "first", "n"))
        return reduce(DataFrame.unionByName, out)

    def foreign_violations(self) -> DataFrame:
        df, out = self.rows, []
        for n, other in self.foreign.items():
            target = other.rows.select(F.col(other.id).alias(n))
            out.append(df.where(F.col(n).isNotNull()).join(target, n, "left_anti").select(self.id, F.lit(n).alias("field")))
        return reduce(DataFrame.unionByName, out)

    def follow(self, **references: tuple[str, Collection]) -> DataFrame:
        """Rows with each referenced document as a struct; null where it is missing."""
        df = self.rows
        for name, (key, other) in references.items():
            target = other.rows.select(F.col(other.id).alias("_ref"), F.struct(*other.rows.columns).alias(name))
            df = df.join(target, df[key] == F.col("_ref"), "left").drop("_ref")
        return df


class Catalog:
    """Named collections, functions and roles of a session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.collections, self.functions, self.roles, self.stores = spark, {}, {}, {}, {}
        self.logs: dict[str, DataFrame] = {}  # versions of collections that no store holds
        self.objects: dict[str, dict[str, dict]] = {}  # what else is defined, by kind and name
        self.identity, self.folder = Identity(), None  # folder: where new collections are stored

    def create(self, collection: Collection) -> Collection:
        self.collections[collection.name] = collection
        return collection

    def collection(self, name: str) -> Collection:
        return self.collections[name]

    def function(self, name: str, body: Callable) -> Callable:
        self.functions[name] = body
        return body

    def call(self, name: str, *args):
        return self.functions[name](*args)

    def definition(self, name: str) -> T.StructType:
        return self.collections[name].rows.schema

    def has(self, kind: str, name: str) -> bool:
        own = {"collection": self.collections, "function": self.functions, "role": self.roles, "index": {i for c in self.collections.values() for i in c.indexes}}
        return name in own.get(kind, ()) or name in self.objects.get(kind, ())

    def forget(self, kind: str, name: str) -> None:
        """Drop a definition; a collection's files stay."""
        for known in ({"collection": self.collections, "function": self.functions, "role": self.roles}.get(kind, {}), self.objects.get(kind, {})):
            known.pop(name, None)
        if kind == "index":
            for c in list(self.collections.values()):
                if name in c.indexes:
                    self.create(replace(c, indexes={k: v for k, v in c.indexes.items() if k != name}))

    def log(self, name: str) -> DataFrame | None:
        """The versions of a collection (id, ts, ord, action, fields), where they are known."""
        return self.stores[name].log() if name in self.stores else self.logs.get(name)

    def as_of(self, ts: Column) -> Catalog:
        """This catalog with collections as they were; those without a log stay."""
        from sheaf.sources import versions

        seen = Catalog(self.spark)
        seen.functions, seen.roles, seen.stores, seen.logs, seen.objects, seen.identity, seen.folder = self.functions, self.roles, self.stores, self.logs, self.objects, self.identity, self.folder
        for n, c in self.collections.items():
            log = self.log(n)
            seen.create(c if log is None else replace(c, df=versions.as_of(log, ts, tie="ord").drop("ts", "ord", "action")))
        return seen

    def new_store(self, name: str, fields: str) -> Collection:
        """An empty collection that can be written, in a folder of its own."""
        from sheaf.sources.store import Store

        if self.folder is None:
            raise ValueError("the catalog has no folder for new collections")
        self.stores[name] = store = Store(self.spark, f"{self.folder}/{name}", T.StructType.fromDDL(fields))
        return self.create(Collection(name, store.rows()))

    def listing(self) -> DataFrame:
        rows = [("collection", n) for n in self.collections] + [("index", f"{n}.{i}") for n, c in self.collections.items() for i in c.indexes]
        rows += [("function", n) for n in self.functions] + [("role", n) for n in self.roles]
        rows += [(k, n) for k, named in self.objects.items() for n in named if (k, n) not in set(rows) and not (k == "index" and any(r[1].endswith(f".{n}") for r in rows))]
        return self.spark.createDataFrame(rows, "kind string, name string")
