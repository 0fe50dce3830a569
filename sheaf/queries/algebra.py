"""Joins, set algebra, schemas and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import setops as X
from sheaf.operators.ordered import Ordered
from sheaf.queries.registry import query, table
from sheaf.sources.catalog import Collection, Migration
from sheaf.sources.export import checksum, sizes, tagged_lines


@query("SELECT o_orderkey, o_totalprice, c_name AS customer_name, n_name AS nation_name, r_name AS region_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 150000")
def fk_projection(spark, d):
    """A projection through references; a missing document gives null."""
    region = Collection("region", table(spark, d, "region"), "r_regionkey")
    nation = Collection("nation", table(spark, d, "nation"), "n_nationkey")
    customer = Collection("customer", table(spark, d, "customer"), "c_custkey")
    nations = Collection("nation", nation.follow(region=("n_regionkey", region)), "n_nationkey")
    customers = Collection("customer", customer.follow(nation=("c_nationkey", nations)), "c_custkey")
    orders = Collection("orders", table(spark, d, "orders").where("o_totalprice > 150000"), "o_orderkey")
    found = orders.follow(customer=("o_custkey", customers))
    return found.select("o_orderkey", "o_totalprice", F.col("customer.c_name").alias("customer_name"), F.col("customer.nation.n_name").alias("nation_name"), F.col("customer.nation.region.r_name").alias("region_name"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def flatmap_equi(spark, d):
    c = Ordered.of(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), "c_custkey")
    o = Ordered.of(table(spark, d, "orders"), "o_orderkey")
    return c.flat_map(o, F.col("o_custkey") == F.col("c_custkey")).df.select("c_custkey", "o_orderkey")


@query("SELECT l_orderkey, unnest([l_returnflag, l_linestatus]) AS flag, unnest([0, 1])::INT AS flag_at FROM lineitem")
def flatmap_array(spark, d):
    s = Ordered.of(table(spark, d, "lineitem"), "l_orderkey")
    return s.explode(F.array("l_returnflag", "l_linestatus"), "flag").df.select("l_orderkey", "flag", "flag_at")


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 10)")
def join_dedup(spark, d):
    """An index join: equal target elements are one."""
    parts = table(spark, d, "part").where("p_size = 10").select(F.col("p_partkey").alias("l_partkey"))
    return X.index_join(parts, table(spark, d, "lineitem"), "l_partkey", ["l_suppkey"])


@query("SELECT c_custkey FROM customer WHERE EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def semi_join(spark, d):
    orders = table(spark, d, "orders").where("o_totalprice > 100000")
    return X.semi(table(spark, d, "customer"), orders, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, d):
    return X.anti(table(spark, d, "customer"), table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND c_acctbal BETWEEN s_acctbal - 500 AND s_acctbal")
def theta_join(spark, d):
    """A condition over ranges beside an equal key: the key and a stretch of the range deal the rows out."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    return X.ranged(s, c, [(s.s_nationkey, c.c_nationkey)], (s.s_acctbal - 500, s.s_acctbal), c.c_acctbal, 125.0).select("s_suppkey", "c_custkey")


@query("SELECT r_regionkey, n_nationkey FROM region, nation")
def cross_join(spark, d):
    """Every pair of two tables of fixed size."""
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).select("r_regionkey", "n_nationkey")


def flagged(spark, d, flag: str):
    return table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select((F.col("l_partkey") % 500).alias("k"), (F.col("l_suppkey") % 10).alias("s"))


COUNTS = "SELECT l_partkey % 500 AS k, l_suppkey % 10 AS s, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY ALL"


@query(f"SELECT k, s FROM (SELECT k, s, unnest(range(greatest(a, b))) FROM ({COUNTS}))")
def union_max(spark, d):
    return X.union_max(flagged(spark, d, "A"), flagged(spark, d, "R"))


@query(f"SELECT k, s FROM (SELECT k, s, unnest(range(least(a, b))) FROM ({COUNTS}))")
def intersection_min(spark, d):
    return X.intersection_min(flagged(spark, d, "A"), flagged(spark, d, "R"))


@query(f"SELECT k, s FROM (SELECT k, s, unnest(range(CASE WHEN b > 0 THEN 0 ELSE a END)) FROM ({COUNTS}))")
def difference_presence(spark, d):
    return X.difference(flagged(spark, d, "A"), flagged(spark, d, "R"))


@query(f"SELECT k, s, array_to_string(list_filter([CASE WHEN a > 0 THEN 'a' END, CASE WHEN b > 0 THEN 'r' END], lambda x: x IS NOT NULL), ',') AS sources FROM ({COUNTS}) WHERE a + b > 0")
def set_sources(spark, d):
    return X.sources(a=flagged(spark, d, "A"), r=flagged(spark, d, "R")).withColumn("sources", F.array_join("sources", ","))


@query("SELECT c_custkey, c_name || ' (' || c_mktsegment || ')' AS label, c_acctbal > 5000 AS rich FROM customer")
def computed_fields(spark, d):
    c = Collection("customer", table(spark, d, "customer"), "c_custkey", computed={"label": lambda x: F.concat(x["c_name"], F.lit(" ("), x["c_mktsegment"], F.lit(")")), "rich": lambda x: x["c_acctbal"] > 5000})
    return c.rows.select("c_custkey", "label", "rich")


@query("SELECT o_orderkey, 'positive' AS \"check\" FROM orders WHERE NOT coalesce(o_totalprice > 2000, false) UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE NOT coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END <> 'X', false)")
def check_violations(spark, d):
    """Null rejects."""
    checks = {"positive": lambda x: x["o_totalprice"] > 2000, "status": lambda x: F.when(x["o_orderstatus"] != "P", x["o_orderstatus"]) != "X"}
    return Collection("orders", table(spark, d, "orders"), "o_orderkey", checks=checks).check_violations()


@query("SELECT 'l_orderkey,l_linenumber' AS \"constraint\", min(l_partkey) AS first, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def unique_violations(spark, d):
    return Collection("lineitem", table(spark, d, "lineitem"), "l_partkey", unique=(("l_orderkey", "l_linenumber"),)).unique_violations()


@query("SELECT o_orderkey, 'o_custkey' AS field FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def foreign_violations(spark, d):
    target = Collection("customer", table(spark, d, "customer").where("c_acctbal > 0"), "c_custkey")
    return Collection("orders", table(spark, d, "orders"), "o_orderkey", foreign={"o_custkey": target}).foreign_violations()


@query("SELECT c_custkey, c_nationkey AS nation, 'new' AS status, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0) AS balance, TRY_CAST(substr(c_mktsegment, 1, 0) || CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_mktsegment END AS BIGINT) AS number, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS words FROM customer")
def migrations(spark, d):
    """add, move, backfill, split and drop, in order."""
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(F.col("c_mktsegment")).alias("mixed"))
    steps = (
        Migration("add", "status", value=lambda x: F.lit("new")), Migration("move", "c_nationkey", ("nation",)), Migration("backfill", "balance", value=lambda x: F.lit(0.0)),
        Migration("split", "mixed", ("number", "words"), type="bigint"), Migration("drop", "c_name"),
    )
    return Collection("customer", old, "c_custkey", migrations=steps).rows.select("c_custkey", "nation", "status", "balance", "number", "words")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def role_filter(spark, d):
    """What a role may read; null denies."""
    return Collection("customer", table(spark, d, "customer"), "c_custkey", readable=lambda x: x["c_nationkey"] == 3).rows.select("c_custkey")


@query("""SELECT '{"n_nationkey":{"@int":"' || n_nationkey || '"},"n_name":"' || n_name || '","n_regionkey":{"@int":"' || n_regionkey || '"}}' AS value FROM nation""")
def export_tagged(spark, d):
    return tagged_lines(table(spark, d, "nation"))


@query("""SELECT c_mktsegment, count(*) AS rows, CAST(sum(strlen('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}')) AS BIGINT) AS bytes FROM customer GROUP BY c_mktsegment""")
def document_sizes(spark, d):
    return sizes(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_mktsegment")


ROW_TEXT = "concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderpriority)"


@query(f"SELECT count(*) AS \"rows\", CAST(sum(CAST('0x' || substr(md5({ROW_TEXT}), 1, 15) AS BIGINT)) AS VARCHAR) || '/' || CAST(sum(CAST('0x' || substr(md5({ROW_TEXT}), 16, 15) AS BIGINT)) AS VARCHAR) AS checksum FROM orders")
def table_checksum(spark, d):
    return checksum(table(spark, d, "orders"))


@query("SELECT event_id, true AS is_integer, false AS is_string_id, true AS is_string, true AS is_timestamp, value IS NOT NULL AS is_double, value IS NULL AS is_null, false AS is_uuid, false AS is_array, false AS is_object, false AS is_boolean, false AS is_bytes, false AS is_date, true AS is_number FROM events")
def type_tests(spark, d):
    from sheaf.functions.types import is_type

    e = table(spark, d, "events")
    tests = {
        "is_integer": ("event_id", "integer"), "is_string_id": ("event_id", "string"), "is_string": ("event_type", "string"), "is_timestamp": ("ts", "timestamp"), "is_double": ("value", "double"), "is_null": ("value", "null"),
        "is_uuid": ("event_type", "uuid"), "is_array": ("value", "array"), "is_object": ("value", "object"), "is_boolean": ("value", "boolean"), "is_bytes": ("value", "bytes"), "is_date": ("ts", "date"), "is_number": ("event_id", "number"),
    }
    return e.select("event_id", *[is_type(e, c, t).alias(n) for n, (c, t) in tests.items()])
