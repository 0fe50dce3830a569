"""Version logs, histories and change feeds; events of a user are versions of a document."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import setops as X
from sheaf.queries.registry import query, table
from sheaf.sources import tasks
from sheaf.sources import versions as V
from sheaf.sources.catalog import Collection, Index
from sheaf.streaming import changes as C


def log(spark, d):
    """user_id is the document, ts the valid time; purchases create or update, the fifth kind of rows delete."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 5 == 0, "delete").otherwise("update").alias("action"), "event_type", "value")


LOG = "(SELECT user_id AS id, ts, event_id AS ord, CASE WHEN event_id % 5 = 0 THEN 'delete' ELSE 'update' END AS action, event_type, value FROM events)"
MID = "(SELECT to_timestamp((epoch(min(ts)) + epoch(max(ts))) // 2)::TIMESTAMP FROM events)"
IMAGES = f"(SELECT *, lag(CASE WHEN action <> 'delete' THEN value END) OVER w AS before_value, lag(CASE WHEN action <> 'delete' THEN event_type END) OVER w AS before_type, coalesce(lag(action) OVER w, 'delete') <> 'delete' AS had, action <> 'delete' AS has FROM {LOG} WINDOW w AS (PARTITION BY id ORDER BY ts, ord))"


def midway(spark, d):
    """Half way from the first event to the last, to the microsecond: in doubles of seconds, rounded as SQL does."""
    ends = table(spark, d, "events").agg(*(F.unix_micros(f(F.col("ts").cast("timestamp"))) for f in (F.min, F.max))).first()
    if ends[0] is None:
        return F.lit(None).cast("timestamp")
    return F.timestamp_micros(F.lit(round((ends[0] / 1e6 + ends[1] / 1e6) / 2 * 1e6)))


@query(f"SELECT id, ord, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, ord DESC) AS rn FROM {LOG} WHERE ts <= {MID}) WHERE rn = 1 AND action <> 'delete'")
def as_of(spark, d):
    return V.as_of(log(spark, d), midway(spark, d), tie="ord").select("id", "ord", "event_type", "value")


@query(f"SELECT id, ord, action, event_type FROM {LOG} WHERE id = 7")
def history(spark, d):
    return V.history(log(spark, d), 7).select("id", "ord", "action", "event_type")


@query(f"SELECT id, ord, action FROM (SELECT *, lead(ts) OVER (PARTITION BY id ORDER BY ts) AS later FROM (SELECT id, min(ord) AS ord, ts, min(action) AS action FROM {LOG} GROUP BY id, ts)) WHERE ts >= {MID} OR later IS NULL OR later > {MID}")
def retention(spark, d):
    one = log(spark, d).groupBy("id", "ts").agg(F.min("ord").alias("ord"), F.min("action").alias("action"))
    return V.retained(one, midway(spark, d)).select("id", "ord", "action")


@query(f"SELECT id, ord, before_value, before_type, CASE WHEN has THEN value END AS after_value FROM {IMAGES}")
def before_images(spark, d):
    out = V.before_images(log(spark, d), ["value", "event_type"], tie="ord")
    return out.select("id", "ord", F.col("before.value").alias("before_value"), F.col("before.event_type").alias("before_type"), F.col("after.value").alias("after_value"))


@query(f"SELECT id, ord, CASE WHEN NOT was AND now THEN 'add' WHEN was AND now THEN 'update' ELSE 'remove' END AS event_type, CASE WHEN now THEN value ELSE before_value END AS value FROM (SELECT *, had AND coalesce(before_value > 50, false) AS was, has AND coalesce(value > 50, false) AS now FROM {IMAGES}) WHERE was OR now")
def stream_transform(spark, d):
    """Events of the set of rows whose value exceeds 50."""
    images = V.before_images(log(spark, d), ["value", "event_type"], tie="ord").drop("event_type", "value")
    out = C.events(images, where=lambda r: r["value"] > 50, select=lambda r: r["value"])
    return out.select("id", "ord", "event_type", F.col("data").alias("value"))


@query(f"SELECT id, ord FROM {IMAGES} WHERE CASE WHEN NOT has THEN before_type IS NOT NULL ELSE before_type IS DISTINCT FROM event_type END")
def changes_on(spark, d):
    return C.changed(V.before_images(log(spark, d), ["value", "event_type"], tie="ord"), "event_type").select("id", "ord")


@query(f"SELECT id, ord FROM {LOG} ORDER BY ts, ord LIMIT 40 OFFSET 40")
def feed_second_page(spark, d):
    l = log(spark, d)
    _, cursor, _ = C.feed(l, size=40)
    page, _, _ = C.feed(l, cursor, size=40)
    return spark.createDataFrame([(r["id"], r["ord"]) for r in page], "id bigint, ord bigint")


def membership(spark, d, *kinds: str):
    """Add and remove events: a user is in the set of some kinds while the last event of the day was of one of them."""
    e = table(spark, d, "events").select((F.col("user_id") % 50).alias("k"), F.to_date("ts").alias("ts"), "event_type", "event_id")
    last = e.groupBy("k", "ts").agg(F.max_by("event_type", "event_id").alias("t"))
    from pyspark.sql import Window as W

    last = last.withColumn("in", F.col("t").isin(*kinds)).withColumn("was", F.coalesce(F.lag("in").over(W.partitionBy("k").orderBy("ts")), F.lit(False)))
    return last.where("`in` <> was").select("k", "ts", F.when(F.col("in"), "add").otherwise("remove").alias("action"))


DAYS = "(SELECT k, ts, arg_max(event_type, event_id) AS t FROM (SELECT user_id % 50 AS k, CAST(ts AS DATE) AS ts, event_type, event_id FROM events) GROUP BY k, ts)"


@query(f"SELECT k, ts, CASE WHEN now THEN 'add' ELSE 'remove' END AS action FROM (SELECT *, coalesce(lag(now) OVER (PARTITION BY k ORDER BY ts), false) AS was FROM (SELECT k, ts, t IN ('click', 'view') AS now FROM {DAYS})) WHERE now <> was")
def historical_union(spark, d):
    return X.historical({"a": membership(spark, d, "click"), "b": membership(spark, d, "view")}, ["k"], "union")


@query(f"SELECT user_day AS day, event_type, count(*) AS n, round(sum(value), 2) AS v FROM (SELECT CAST(date_trunc('day', ts) AS DATE) AS user_day, event_type, value FROM events) GROUP BY ALL")
def windowed_counts(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = C.windowed(e, "ts", "1 day", "event_type", n=F.count(F.lit(1)), v=F.round(F.sum("value"), 2))
    return out.select(F.to_date("window.start").alias("day"), "event_type", "n", "v")


def history_sql(now: str) -> str:
    return f"SELECT k, ts, CASE WHEN now THEN 'add' ELSE 'remove' END AS action FROM (SELECT *, coalesce(lag(now) OVER (PARTITION BY k ORDER BY ts), false) AS was FROM (SELECT k, ts, {now} AS now FROM {DAYS})) WHERE now <> was"


@query(history_sql("t IN ('click', 'view') AND t NOT IN ('view', 'purchase')"))
def historical_difference(spark, d):
    """The sets overlap: while the last event was a view a user is in both, which ends membership in the difference."""
    return X.historical({"a": membership(spark, d, "click", "view"), "b": membership(spark, d, "view", "purchase")}, ["k"], "difference")


@query(history_sql("t IN ('click', 'view') AND t IN ('view', 'purchase')"))
def historical_intersection(spark, d):
    """The sets overlap: a user is in both while the last event was a view."""
    return X.historical({"a": membership(spark, d, "click", "view"), "b": membership(spark, d, "view", "purchase")}, ["k"], "intersection")


KINDS = Index("byKind", ("event_type",), ("-value",))


@query(f"SELECT event_type, value, id, ts, ord, 'add' AS action FROM {IMAGES} WHERE has AND event_type IS NOT NULL AND NOT (had AND before_type IS NOT DISTINCT FROM event_type AND before_value IS NOT DISTINCT FROM value) UNION ALL SELECT before_type, before_value, id, ts, ord, 'remove' FROM {IMAGES} WHERE had AND before_type IS NOT NULL AND NOT (has AND before_type IS NOT DISTINCT FROM event_type AND before_value IS NOT DISTINCT FROM value)")
def index_history(spark, d):
    """Entries of an index as they begin and end."""
    return tasks.index_events(log(spark, d), KINDS)


@query(f"SELECT value, id, ts, ord, action FROM (SELECT event_type, value, id, ts, ord, 'add' AS action FROM {IMAGES} WHERE has AND NOT (had AND before_type IS NOT DISTINCT FROM event_type AND before_value IS NOT DISTINCT FROM value) UNION ALL SELECT before_type, before_value, id, ts, ord, 'remove' FROM {IMAGES} WHERE had AND NOT (has AND before_type IS NOT DISTINCT FROM event_type AND before_value IS NOT DISTINCT FROM value)) WHERE event_type = 'click'")
def index_sorted_values(spark, d):
    """All events under one term, by value."""
    return tasks.sorted_values(log(spark, d), KINDS, "click").select("value", "id", "ts", "ord", "action")


@query("SELECT c_custkey, lower(c_mktsegment) AS segment, c_nationkey % 5 AS zone FROM customer WHERE lower(c_mktsegment) = 'building' AND c_nationkey % 5 = 2")
def folded_index(spark, d):
    """A case-folded term and a binding."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), "c_nationkey")
    index = Index.folded("bySegment", ("segment", "zone"), fold=("segment",), bindings={"zone": lambda df: df["c_nationkey"] % 5})
    return index.entries(c, "c_custkey").where("segment = 'building' AND zone = 2").select("c_custkey", "segment", "zone")


@query("SELECT o_custkey, o_totalprice, o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN 'missing' ELSE 'extra' END AS status FROM (SELECT o_custkey, o_totalprice, o_orderkey FROM orders WHERE o_orderkey % 7 = 3 UNION ALL SELECT o_custkey + 1, o_totalprice, o_orderkey FROM orders WHERE o_orderkey % 7 = 5)")
def index_differences(spark, d):
    """A stored index that lacks some entries and has wrong ones besides."""
    orders = table(spark, d, "orders")
    c = Collection("orders", orders, "o_orderkey").with_index(Index("byCustomer", ("o_custkey",), ("o_totalprice",)))
    entries = c.indexes["byCustomer"].entries(c.rows, "o_orderkey")
    stored = entries.where("o_orderkey % 7 <> 3").unionByName(entries.where("o_orderkey % 7 = 5").withColumn("o_custkey", F.col("o_custkey") + 1))
    return tasks.differences(c, "byCustomer", stored)


@query("SELECT o_custkey, o_totalprice, o_orderkey FROM orders")
def index_repaired(spark, d):
    orders = table(spark, d, "orders")
    c = Collection("orders", orders, "o_orderkey").with_index(Index("byCustomer", ("o_custkey",), ("o_totalprice",)))
    entries = c.indexes["byCustomer"].entries(c.rows, "o_orderkey")
    stored = entries.where("o_orderkey % 7 <> 3").unionByName(entries.where("o_orderkey % 7 = 5").withColumn("o_custkey", F.col("o_custkey") + 1))
    return tasks.repair(c, "byCustomer", stored)


@query(f"SELECT id, ord, action, CASE WHEN has THEN value END AS value, 'version' AS type FROM {IMAGES} WHERE id = 7 AND ts > {MID} UNION ALL SELECT id, ord, action, CASE WHEN action <> 'delete' THEN value END, 'start' FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, ord DESC) AS rn FROM {LOG} WHERE id = 7 AND ts <= {MID}) WHERE rn = 1")
def document_stream(spark, d):
    out = C.document_events(log(spark, d), 7, ["value", "event_type"], midway(spark, d))
    return out.select("id", "ord", "action", F.col("after.value").alias("value"), "type")
