"""Version logs: rows (id, ts, action, fields) and what time sees in them.

action is create, update or delete. A snapshot is the last version of each id at a time; it is found by a
partial aggregate (max_by), so only one row of each id and task is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(log: DataFrame, ts: Column, order: str = "ts", tie: str | None = None) -> DataFrame:
    """The rows alive at a time; a deleted id has none."""
    rest = [c for c in log.columns if c != "id"]
    rank = F.struct(order, *([tie] if tie else []))
    last = log.where(F.col(order) <= ts).groupBy("id").agg(F.max_by(F.struct(*rest), rank).alias("v"))
    return last.select("id", "v.*").where("action <> 'delete'")


def history(log: DataFrame, id_, order: str = "ts") -> DataFrame:
    return log.where(F.col("id") == id_).orderBy(order)


def live(log: DataFrame, ts: Column, ttl: str = "ttl") -> DataFrame:
    """As of a time, without what has expired by then."""
    return as_of(log, ts).where(F.col(ttl).isNull() | (F.col(ttl) > ts))


def retained(log: DataFrame, since: Column, order: str = "ts") -> DataFrame:
    """Versions that reads since a time can still see: the newer ones and, of each id, the last before."""
    later = F.lead(order).over(W.partitionBy("id").orderBy(order))
    return log.withColumn("_later", later).where((F.col(order) >= since) | F.col("_later").isNull() | (F.col("_later") > since)).drop("_later")


def before_images(log: DataFrame, fields: list[str], order: str = "ts", tie: str | None = None) -> DataFrame:
    """Each version with the fields before it (null at the first, or after a delete)."""
    w = W.partitionBy("id").orderBy(order, *([tie] if tie else []))
    was = F.lag(F.when(F.col("action") != "delete", F.struct(*fields))).over(w)
    return log.withColumn("before", was).withColumn("after", F.when(F.col("action") != "delete", F.struct(*fields)))


def insert(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Historical versions put in place of those of equal id, time and action."""
    return remove(log, rows).unionByName(rows)


def remove(log: DataFrame, rows: DataFrame) -> DataFrame:
    return log.join(rows.select("id", "ts", "action").distinct(), ["id", "ts", "action"], "left_anti")


def created(rows: DataFrame, ts: Column) -> DataFrame:
    return rows.withColumns({"ts": ts, "action": F.lit("create")})


def updated(current: DataFrame, patch: DataFrame, ts: Column, fields: list[str]) -> DataFrame:
    """New versions by merge patch: fields of the patch that are null keep their value."""
    p = patch.select("id", *[F.col(f).alias(f"_{f}") for f in fields])
    out = current.join(p, "id").withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])
    return out.withColumns({"ts": ts, "action": F.lit("update")})


def deleted(current: DataFrame, ids: DataFrame, ts: Column) -> DataFrame:
    return current.join(ids, "id", "left_semi").withColumns({"ts": ts, "action": F.lit("delete")})
