"""Collections that can be written: a version log in a folder, to which every write appends.

A write is a batch: its rows are checked against the collection's constraints as they would be read
after it, and only then appended as new versions. Readers see the log as of a time.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.sources import versions
from sheaf.sources.catalog import Collection


class ConstraintError(ValueError):
    pass


class Store:
    """ts is the valid time of a version, ord the number of the write, which orders versions of one time."""

    def __init__(self, spark: SparkSession, path: str, fields: T.StructType, collection: Collection | None = None):
        self.spark, self.path, self.fields = spark, path, fields
        self.schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("ord", T.LongType()), T.StructField("action", T.StringType()), *fields.fields])
        self.collection = collection
        self._writes = 0
        empty = spark.createDataFrame([], self.schema)
        empty.write.mode("append").parquet(path)
        last = self.log().agg(F.max("ord")).first()[0]
        self._writes = (last or 0) + 1

    def log(self) -> DataFrame:
        """All versions, without those that were taken out or replaced; these are few, and joined by id."""
        raw = self.spark.read.schema(self.schema).parquet(self.path)
        edits = raw.where(F.col("action").startswith("-")).select("id", "ts", F.substring("action", 2, 99).alias("action"), F.col("ord").alias("_until"))
        if edits.isEmpty():
            return raw
        last = edits.groupBy("id", "ts", "action").agg(F.max("_until").alias("_until"))
        kept = raw.where(~F.col("action").startswith("-")).join(last, ["id", "ts", "action"], "left").where(F.col("_until").isNull() | (F.col("ord") > F.col("_until")))
        return kept.select(*self.schema.names)

    def rows(self, ts: Column | None = None) -> DataFrame:
        """What is alive now, or was at a time."""
        at = F.current_timestamp() if ts is None else ts
        return versions.as_of(self.log(), at, tie="ord").drop("ts", "ord", "action")

    def history(self, id_: int) -> DataFrame:
        return versions.history(self.log(), id_)

    def _checked(self, new: DataFrame) -> None:
        if self.collection is None:
            return
        c = replace(self.collection, df=new, id="id")
        if c.checks and (bad := c.check_violations().limit(1).collect()):
            raise ConstraintError(f"check {bad[0]['check']} of {bad[0]['id']}")
        if c.foreign and (bad := c.foreign_violations().limit(1).collect()):
            raise ConstraintError(f"reference {bad[0]['field']} of {bad[0]['id']}")
        if c.unique:
            # only against documents that share a key with a new one
            old = self.rows().join(new.select("id"), "id", "left_anti")
            if bad := replace(c, df=old.select(new.columns).unionByName(new)).unique_violations().limit(1).collect():
                raise ConstraintError(f"unique {bad[0]['constraint']} of {bad[0]['first']}")

    def _append(self, rows: DataFrame, action: str, ts: Column | None) -> None:
        out = rows.withColumns({"ts": F.current_timestamp() if ts is None else ts, "ord": F.lit(self._writes).cast("long"), "action": F.lit(action)})
        out.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.mode("append").parquet(self.path)
        self._writes += 1

    def next_id(self) -> int:
        """Unique without a look at the log, so that writers do not meet: microseconds, then random bits."""
        import secrets
        import time

        return (int(time.time() * 1e6) & ((1 << 51) - 1)) << 12 | secrets.randbits(12)

    def put(self, rows: DataFrame, ts: Column, action: str) -> None:
        """A version of a past time; of equal id, time and action the last one written counts."""
        self._append(self._filled(rows), action, ts)

    def take_out(self, id_: int, ts: Column, action: str) -> None:
        """The version of an id, time and action leaves the history: a mark hides it, files are only appended to."""
        self._append(self._filled(self.spark.range(1).select(F.lit(id_).cast("long").alias("id"))), f"-{action}", ts)

    def create(self, rows: DataFrame, ts: Column | None = None) -> None:
        """New documents; an id that is alive is an error."""
        if self.rows().join(rows.select("id"), "id", "left_semi").limit(1).count():
            raise ConstraintError("a document with this id exists")
        rows = self._filled(rows)
        self._checked(rows)
        self._append(rows, "create", ts)

    def _filled(self, rows: DataFrame) -> DataFrame:
        """Fields that are missing take their default, or null."""
        defaults = self.collection.defaults if self.collection else {}
        for f in self.fields:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        for n, b in defaults.items():
            rows = rows.withColumn(n, F.coalesce(F.col(n), b(rows)))
        return rows.select("id", *[F.col(f.name).cast(f.dataType) for f in self.fields])

    def _present(self, ids: DataFrame) -> DataFrame:
        return self.rows().join(ids.select("id").distinct(), "id", "left_semi")

    def update(self, patch: DataFrame, ts: Column | None = None, clear: tuple[str, ...] = ()) -> None:
        """A merge patch: columns of the patch that are not null replace the field; those of ``clear`` become null."""
        fields = [f.name for f in self.fields if f.name in patch.columns]
        new = versions.updated(self._present(patch), patch, F.current_timestamp(), fields).drop("ts", "action")
        for n in clear:
            new = new.withColumn(n, F.lit(None).cast(self.fields[n].dataType))
        new = new.select("id", *self.fields.names)
        self._checked(new)
        self._append(new, "update", ts)

    def replace(self, rows: DataFrame, ts: Column | None = None) -> None:
        """All fields anew, of documents that are alive."""
        new = self._filled(rows.join(self._present(rows).select("id"), "id", "left_semi"))
        self._checked(new)
        self._append(new, "update", ts)

    def delete(self, ids: DataFrame, ts: Column | None = None) -> None:
        self._append(self._present(ids), "delete", ts)
