"""Ordered sets, indexes, paging and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import numbers as N
from sheaf.operators.ordered import Ordered
from sheaf.queries.registry import query, table
from sheaf.sources.catalog import Collection, Index


def ordered(spark, d, name: str, *keys: str) -> Ordered:
    return Ordered.of(table(spark, d, name), *keys)


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey LIMIT 50")
def where_order_take(spark, d):
    out = ordered(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").where(F.col("l_quantity") > 45).order("-l_quantity").take(50)
    return out.df.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_totalprice BETWEEN 1000 AND 200000")
def index_eq_range(spark, d):
    by_customer = Index("by_customer", ("o_custkey",), ("o_totalprice",))
    orders = Collection("orders", table(spark, d, "orders"), "o_orderkey").with_index(by_customer)
    return orders.by_index("by_customer", 7, low=(1000.0,), high=(200000.0,)).df.select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority >= '2' AND o_orderpriority <= '4-ZZZ'")
def range_prefix(spark, d):
    """A range over a prefix of the keys: both ends are included."""
    return ordered(spark, d, "orders", "o_orderpriority", "o_totalprice", "o_orderkey").range(("2",), ("4-ZZZ",)).df.select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE (o_orderpriority, o_totalprice) <= ('3-ZZZ', 150000.0) AND (o_orderpriority > '1-URGENT' OR (o_orderpriority = '1-URGENT' AND o_totalprice >= 50000.0))")
def range_tuple(spark, d):
    return ordered(spark, d, "orders", "o_orderpriority", "o_totalprice", "o_orderkey").range(("1-URGENT", 50000.0), ("3-ZZZ", 150000.0)).df.select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 400")
def collection_all_range(spark, d):
    return Collection("orders", table(spark, d, "orders"), "o_orderkey").all(100, 400).df.select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def by_id(spark, d):
    return Collection("customer", table(spark, d, "customer"), "c_custkey").by_id(42).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 5, 8, 13, 21)")
def multi_get(spark, d):
    ids = spark.createDataFrame([(k,) for k in (3, 5, 8, 13, 21)], "c_custkey bigint")
    return table(spark, d, "customer").join(F.broadcast(ids), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT * FROM (SELECT 1 AS which, n_nationkey, n_name FROM nation ORDER BY n_name, n_nationkey LIMIT 1) UNION ALL SELECT * FROM (SELECT 2, n_nationkey, n_name FROM nation ORDER BY n_name DESC, n_nationkey DESC LIMIT 1) UNION ALL SELECT * FROM (SELECT 3, n_nationkey, n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_name, n_nationkey LIMIT 1) UNION ALL SELECT * FROM (SELECT 4, n_nationkey, n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_name DESC, n_nationkey DESC LIMIT 1)")
def first_last(spark, d):
    s, p = ordered(spark, d, "nation", "n_name", "n_nationkey"), F.col("n_regionkey") == 2
    parts = [s.first(), s.last(), s.first_where(p), s.last_where(p)]
    out = None
    for k, x in enumerate(parts, 1):
        x = x.select(F.lit(k).alias("which"), "n_nationkey", "n_name")
        out = x if out is None else out.unionByName(x)
    return out


@query("SELECT n_nationkey, n_name FROM (SELECT * FROM nation ORDER BY n_name DESC, n_nationkey DESC OFFSET 5) LIMIT 10")
def reverse_drop_take(spark, d):
    return ordered(spark, d, "nation", "n_name", "n_nationkey").reverse().drop(5).take(10).df.select("n_nationkey", "n_name")


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_sorted(spark, d):
    return Ordered.of(table(spark, d, "part").select("p_brand", "p_size"), "p_brand").distinct().to_df()


@query("SELECT 0 AS part, r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation")
def concat_sets(spark, d):
    a = Ordered.of(table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), "k")
    b = Ordered.of(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), "k")
    return a.concat(b).to_df().select("part", "k", "name")


@query("SELECT c_custkey, c_acctbal * 2 AS twice, c_name || '!' AS name FROM customer WHERE c_acctbal > 0")
def map_project(spark, d):
    s = ordered(spark, d, "customer", "c_custkey").where(F.col("c_acctbal") > 0)
    return s.map(twice=F.col("c_acctbal") * 2, name=F.concat("c_name", F.lit("!"))).df.select("c_custkey", "twice", "name")


@query("SELECT unnest(range(3, 12))::BIGINT AS value")
def sequence_set(spark, d):
    return Ordered.sequence(spark, 3, 12).to_df()


@query("SELECT count(*) AS n, count(*) FILTER (l_quantity > 45) > 0 AS any, count(*) FILTER (NOT l_quantity > 0) = 0 AS every, count(*) FILTER (l_partkey = 5) > 0 AS includes, count(*) = 0 AS is_empty, count(*) > 0 AS non_empty FROM lineitem")
def set_tests(spark, d):
    """One scan answers all; alone, each test stops at its first hit."""
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), N.any_of(q > 45).alias("any"), N.every_of(q > 0).alias("every"), N.includes_of("l_partkey", 5).alias("includes"),
        (F.count(F.lit(1)) == 0).alias("is_empty"), (F.count(F.lit(1)) > 0).alias("non_empty"),
    )


@query("SELECT (SELECT count(*) FROM orders WHERE o_totalprice > 100000) > 0 AS any, (SELECT count(*) FROM orders WHERE NOT o_totalprice > 0) = 0 AS every, true AS non_empty, false AS is_empty")
def set_tests_short(spark, d):
    s = ordered(spark, d, "orders", "o_orderkey")
    parts = [s.any(F.col("o_totalprice") > 100000), s.every(F.col("o_totalprice") > 0), s.non_empty(), s.is_empty()]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # single rows
    return out


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_extendedprice), 4) AS mean_price, sum(l_linenumber) // count(l_linenumber) AS int_mean FROM lineitem GROUP BY ALL")
def group_aggregates(spark, d):
    """Grouping by folding into an object, as a partial aggregate."""
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(N.sum_of("l_quantity"), 2).alias("sum_qty"), F.round(N.sum_of(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(N.mean_of("l_extendedprice"), 4).alias("mean_price"), N.mean_of_integers("l_linenumber").alias("int_mean"),
    )


@query("SELECT count(*) AS count, CAST(sum(value) IS NOT NULL AS BOOLEAN) AS has_sum, round(sum(value), 2) AS sum, round(avg(value), 6) AS mean, max(value) AS max, min(value) AS min FROM events")
def set_aggregates(spark, d):
    v = F.col("value")
    return ordered(spark, d, "events", "event_id").aggregate(count=F.count(F.lit(1)), has_sum=F.sum(v).isNotNull(), sum=F.round(N.sum_of(v), 2), mean=F.round(N.mean_of(v), 6), max=F.max(v), min=F.min(v))


@query("SELECT CAST(list_reduce(list_prepend(7::BIGINT, list(o_custkey ORDER BY o_orderkey)), lambda a, x: (a * 31 + x) % 1000003) AS BIGINT) AS folded, CAST(list_reduce(list_prepend(7::BIGINT, list(o_custkey ORDER BY o_orderkey DESC)), lambda a, x: (a * 31 + x) % 1000003) AS BIGINT) AS folded_right FROM orders")
def fold_ordered(spark, d):
    """A fold that is not associative: rows stream in order, a partition at a time, with the columns that the reducer reads."""
    s = ordered(spark, d, "orders", "o_orderkey").map(o_custkey=F.col("o_custkey"))
    step = lambda a, r: (a * 31 + r["o_custkey"]) % 1000003
    return spark.createDataFrame([(s.fold(7, step), s.fold_right(7, step))], "folded bigint, folded_right bigint")


@query("SELECT r_name, array_to_string(list(n_name ORDER BY n_name), ',') AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def to_array_per_group(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("nations"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) > (100000.0, 0) ORDER BY o_totalprice, o_orderkey LIMIT 64")
def page_after(spark, d):
    """Forward from a key, which is included."""
    return ordered(spark, d, "orders", "o_totalprice", "o_orderkey").after((100000.0,), inclusive=True).take(64).df.select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 100000.0 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 64")
def page_before(spark, d):
    """Backward from a key, which is not included."""
    return ordered(spark, d, "orders", "o_totalprice", "o_orderkey").before((100000.0,)).take(64).df.select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 16 OFFSET 32")
def paginate_third(spark, d):
    """The third page by cursors."""
    s = ordered(spark, d, "orders", "-o_totalprice", "o_orderkey")
    page = s.paginate()
    page = s.paginate(page.after)
    page = s.paginate(page.after)
    return spark.createDataFrame([(r["o_orderkey"], r["o_totalprice"]) for r in page.data], "o_orderkey bigint, o_totalprice double")


@query("SELECT doc_id, len(list_distinct(list_filter(string_split(text, ' '), lambda x: x = 'the'))) AS n FROM documents WHERE list_contains(string_split(text, ' '), 'the')")
def mva_index(spark, d):
    """An index over the elements of an array: a row for each distinct element of each document."""
    docs = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("words"))
    entries = Index("by_word", ("words",), multi=("words",)).entries(docs, "doc_id")
    return entries.where(F.col("words") == "the").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT word, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word HAVING count(*) >= 50")
def mva_index_counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("word"))
    return Index("by_word", ("word",), multi=("word",)).entries(docs, "doc_id").groupBy("word").agg(F.count(F.lit(1)).alias("docs")).where("docs >= 50")


@query("SELECT c_custkey, c_acctbal, upper(c_mktsegment) || '/' || c_nationkey AS key FROM customer WHERE upper(c_mktsegment) || '/' || c_nationkey IN ('BUILDING/7', 'MACHINERY/3')")
def computed_index(spark, d):
    """Reads of an index by a computed term; the collection itself has no such field."""
    index = Index("by_key", ("key",), ("-c_acctbal",), computed={"key": lambda df: F.concat_ws("/", F.upper(df["c_mktsegment"]), df["c_nationkey"].cast("string"))})
    c = Collection("customer", table(spark, d, "customer"), "c_custkey").with_index(index)
    found = [c.by_index("by_key", k).df.select("c_custkey", "c_acctbal", "key") for k in ("BUILDING/7", "MACHINERY/3")]
    return found[0].unionByName(found[1])
