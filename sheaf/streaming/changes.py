"""Change streams: version logs to add, update and remove events, in batches or as a stream.

The rules look only at a version and its before image, so the same functions serve a batch and a
streaming DataFrame whose rows carry both.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def events(changes: DataFrame, where: Callable[[Column], Column] | None = None, select: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows with before and after (structs, null if absent) to event_type and data.

    add where only after passes, update where both do, remove where only before does, else nothing.
    A remove carries the image before.
    """
    passes = lambda image: image.isNotNull() & (F.coalesce(where(image), F.lit(False)) if where else F.lit(True))
    was, now = passes(F.col("before")), passes(F.col("after"))
    kind = F.when(~was & now, "add").when(was & now, "update").when(was & ~now, "remove")
    image = F.when(now, F.col("after")).otherwise(F.col("before"))
    out = changes.withColumn("event_type", kind).where("event_type is not null")
    return out.withColumn("data", select(image) if select else image)


def changed(changes: DataFrame, *fields: str) -> DataFrame:
    """Only changes of the watched fields; a delete stays if all of them were present."""
    before, after = F.col("before"), F.col("after")
    differ = reduce(lambda a, b: a | b, [~before[f].eqNullSafe(after[f]) for f in fields])
    had = reduce(lambda a, b: a & b, [before[f].isNotNull() for f in fields])
    return changes.where(F.when(after.isNull(), had).otherwise(differ))


def document_events(log: DataFrame, id_, fields: list[str], since=None) -> DataFrame:
    """The stream of one document: its state at the start, then each version with what was before it; type is start or version."""
    from sheaf.sources import versions

    own = log.where(F.col("id") == id_)
    images = versions.before_images(own, fields, tie="ord").select("id", "ts", "ord", F.lit("version").alias("type"), "action", "before", "after")
    if since is None:
        return images
    last = own.where(F.col("ts") <= since).agg(F.max_by(F.struct("id", "ts", "ord", "action", F.struct(*fields).alias("image")), F.struct("ts", "ord")).alias("v")).where("v is not null")
    image = F.col("v.image")
    start = last.select("v.id", "v.ts", "v.ord", F.lit("start").alias("type"), "v.action", F.when(F.lit(False), image).alias("before"), F.when(F.col("v.action") != "delete", image).alias("after"))
    return start.unionByName(images.where(F.col("ts") > since))


def cursor_of(ts, ordinal) -> str:
    return base64.urlsafe_b64encode(json.dumps([str(ts), ordinal]).encode()).decode()


def feed(changes: DataFrame, cursor: str | None = None, size: int = 16, ts: str = "ts", ordinal: str = "ord") -> tuple[list[Row], str | None, bool]:
    """(events, cursor, has_next): a page of events after a cursor, in the order of time and ordinal."""
    if cursor:
        t, o = json.loads(base64.urlsafe_b64decode(cursor))
        t = F.lit(t).cast("timestamp")
        changes = changes.where((F.col(ts) > t) | ((F.col(ts) == t) & (F.col(ordinal) > o)))
    rows = changes.orderBy(ts, ordinal).limit(size + 1).collect()
    page = rows[:size]
    return page, cursor_of(page[-1][ts], page[-1][ordinal]) if page else cursor, len(rows) > size


def stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A version log as it grows, a bounded number of new files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def status(spark: SparkSession, cursor: str | None) -> DataFrame:
    """The event that tells a subscriber that it is up to date: its time and the cursor to go on from."""
    return spark.range(1).select(F.lit("status").alias("event_type"), F.current_timestamp().alias("ts"), F.lit(cursor).alias("cursor"))


def error(spark: SparkSession, code: str, message: str) -> DataFrame:
    """The event that ends a stream."""
    return spark.range(1).select(F.lit("error").alias("event_type"), F.current_timestamp().alias("ts"), F.lit(code).alias("code"), F.lit(message).alias("message"))


def subscribe(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, on_status: Callable[[DataFrame], None] | None = None):
    """Push each batch of events; progress is kept in the checkpoint folder, so a restart goes on where it stopped.

    After each batch ``on_status`` gets a status event with the batch's number as its cursor. An error of ``handle`` is
    pushed as an error event, too, and ends the stream.
    """

    def push(batch: DataFrame, number: int) -> None:
        try:
            handle(batch, number)
        except Exception as e:
            if on_status:
                on_status(error(batch.sparkSession, type(e).__name__, str(e)))
            raise
        if on_status:
            on_status(status(batch.sparkSession, str(number)))

    writer = df.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def with_before_images(log: DataFrame, fields: list[str], timeout: str = "NoTimeout") -> DataFrame:
    """Before images over a stream (id, ts, action, fields): the last version of each id is its state."""
    import pandas as pd

    kinds = ", ".join(f"{f}:{log.schema[f].dataType.simpleString()}" for f in fields)
    names = ", ".join(f"`{f}` {log.schema[f].dataType.simpleString()}" for f in fields)
    id_kind = log.schema["id"].dataType.simpleString()

    def step(key, frames, state):
        last = state.get if state.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values("ts", kind="stable").itertuples(index=False):
            image = None if row.action == "delete" else {f: getattr(row, f) for f in fields}
            out.append({"id": key[0], "ts": row.ts, "action": row.action, "before": dict(zip(fields, last)) if last and last[-1] else None, "after": image})
            last = (*[getattr(row, f) for f in fields], row.action != "delete")
        if last:
            state.update(last)
        yield pd.DataFrame(out)

    return log.groupBy("id").applyInPandasWithState(step, f"id {id_kind}, ts timestamp, action string, before struct<{kinds}>, after struct<{kinds}>", f"{names}, alive boolean", "append", timeout)


def windowed(df: DataFrame, ts: str, size: str, *keys: str, late: str = "10 minutes", slide: str | None = None, **aggregates: Column) -> DataFrame:
    """Event-time windows; state is dropped once the watermark has passed."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.withWatermark(ts, late).groupBy(window, *keys).agg(*[c.alias(n) for n, c in aggregates.items()])


#: Operators whose results can only be told at the end of a set: sets with one of them can't be streamed.
UNSTREAMABLE = ("distinct", "order", "concat", "drop", "take", "reverse", "flat_map")


def check_streamable(steps: list[str]) -> None:
    if bad := [s for s in steps if s in UNSTREAMABLE]:
        raise ValueError(f"cannot stream a set with {', '.join(bad)}")
