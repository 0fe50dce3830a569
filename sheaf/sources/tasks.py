"""Jobs over whole collections: histories of indexes, building, comparing and mending them, staged changes, migration.

Each is one distributed plan. A job that an executor's loss breaks off starts again from its input; what it writes appears
under its name only when it is complete.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.sources import versions
from sheaf.sources.catalog import Catalog, Collection, Index, Migration


def index_events(log: DataFrame, index: Index) -> DataFrame:
    """The history of an index: (terms, values, id, ts, ord, action); add where an entry begins, remove where it ends.

    log has versions (id, ts, ord, action, fields). Both images of a version are turned into entries; what only one of them
    has is an event.
    """
    fields = [f.name for f in log.schema if f.name not in ("ts", "ord", "action")]
    images = versions.before_images(log.withColumn("_id", F.col("id")), fields, tie="ord")
    columns = [*dict.fromkeys([*index.terms, *(v.lstrip("-") for v in index.values), "id"])]

    def entries(side: str) -> DataFrame:
        rows = images.where(F.col(side).isNotNull()).select(F.col("ts").alias("_ts"), F.col("ord").alias("_ord"), f"{side}.*")
        kept = replace(index, values=(*index.values, "_ts", "_ord"))
        return kept.entries(rows, "id").select(*columns, "_ts", "_ord")

    before, after = entries("before").withColumn("_was", F.lit(1)), entries("after").withColumn("_was", F.lit(0))
    sides = before.unionByName(after).groupBy(*columns, "_ts", "_ord").agg(F.count(F.lit(1)).alias("_n"), F.min("_was").alias("_was"))
    changed = sides.where("_n = 1")  # on one side only
    return changed.select(*columns, F.col("_ts").alias("ts"), F.col("_ord").alias("ord"), F.when(F.col("_was") == 1, "remove").otherwise("add").alias("action"))


def sorted_values(log: DataFrame, index: Index, *terms) -> DataFrame:
    """All events of an index under some terms, ordered by value, then id, then time."""
    events = index_events(log, index)
    for t, v in zip(index.terms, terms, strict=True):
        events = events.where(F.col(t) == v)
    order = [F.desc_nulls_first(v[1:]) if v.startswith("-") else F.asc_nulls_last(v) for v in index.values]
    return events.orderBy(*order, "id", "ts", "ord")


def differences(collection: Collection, index: str, stored: DataFrame) -> DataFrame:
    """Entries that a stored index lacks (missing) or has beyond the documents (extra)."""
    want = collection.indexes[index].entries(collection.rows, collection.id)
    marked = want.withColumn("_side", F.lit(0)).unionByName(stored.select(want.columns).withColumn("_side", F.lit(1)))
    sides = marked.groupBy(*want.columns).agg(F.min("_side").alias("_low"), F.max("_side").alias("_high"))
    return sides.where("_low = _high").select(*want.columns, F.when(F.col("_low") == 0, "missing").otherwise("extra").alias("status"))


def repair(collection: Collection, index: str, stored: DataFrame) -> DataFrame:
    """The stored entries without extra ones and with those that were missing."""
    wrong = differences(collection, index, stored)
    columns = [c for c in wrong.columns if c != "status"]
    same = reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"w.{c}")) for c in columns])
    kept = stored.select(columns).alias("s").join(wrong.where("status = 'extra'").alias("w"), same, "left_anti")
    return kept.unionByName(wrong.where("status = 'missing'").select(columns))


def map_rows(collection: Collection, step: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Every document through a step, written as a table."""
    step(collection.rows).write.mode("overwrite").parquet(path)
    return collection.df.sparkSession.read.parquet(path)


def migrate(collection: Collection, path: str) -> Collection:
    """The documents in their newest version, written once, so that reads need no migration any more."""
    df = reduce(lambda d, m: m.apply(d), collection.migrations, collection.df)
    df.write.mode("overwrite").parquet(path)
    return replace(collection, df=df.sparkSession.read.parquet(path), migrations=())


class Staging:
    """Changes of a schema that take effect together: until ``commit`` the catalog shows the old ones."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.pending, self.tables = catalog, {}, {}

    def _of(self, name: str) -> Collection:
        return self.pending.get(name) or self.catalog.collection(name)

    def add_index(self, collection: str, index: Index, buckets: int = 8) -> None:
        """Build the index now; it serves reads from commit on."""
        c = self._of(collection).with_index(index)
        self.pending[collection] = c
        self.tables[collection, index.name] = c.build(index.name, buckets)

    def drop_index(self, collection: str, index: str) -> None:
        c = self._of(collection)
        self.pending[collection] = replace(c, indexes={k: v for k, v in c.indexes.items() if k != index})

    def add_migration(self, collection: str, migration: Migration) -> None:
        c = self._of(collection)
        self.pending[collection] = replace(c, migrations=(*c.migrations, migration))

    def status(self) -> dict[str, tuple[str, ...]]:
        """What waits: for each collection the names of its indexes as they will be."""
        return {n: tuple(c.indexes) for n, c in self.pending.items()}

    def commit(self) -> None:
        """Refused where documents would break a constraint."""
        for c in self.pending.values():
            if c.checks and not c.check_violations().isEmpty():
                raise ValueError(f"documents of {c.name} break a check")
        for c in self.pending.values():
            self.catalog.create(c)
        self.pending = {}

    def abort(self) -> None:
        for c, i in self.tables:
            if c in self.pending:
                self.catalog.spark.sql(f"DROP TABLE IF EXISTS `{c}_{i}`")
        self.pending, self.tables = {}, {}
