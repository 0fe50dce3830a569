"""Queries written in the text language and in JSON forms, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.plans.interpreter import Interpreter
from sheaf.plans.json_forms import Elements, Forms
from sheaf.queries.registry import QUERIES, SQL, table
from sheaf.queries.temporal import IMAGES
from sheaf.sources import versions
from sheaf.sources.catalog import Catalog, Collection, Index


def catalog(spark, d) -> Catalog:
    """The star schema as collections that refer to each other."""
    c = Catalog(spark)
    region = c.create(Collection("Region", table(spark, d, "region").toDF("id", "name"), "id"))
    nation = c.create(Collection("Nation", table(spark, d, "nation").toDF("id", "name", "region"), "id", foreign={"region": region}))
    customer = Collection("Customer", table(spark, d, "customer").toDF("id", "name", "nation", "balance", "segment"), "id", foreign={"nation": nation})
    customer = c.create(customer.with_index(Index("bySegment", ("segment",), ("balance",))).with_index(Index("byNation", ("nation",))))
    orders = Collection("Order", table(spark, d, "orders").toDF("id", "customer", "status", "total", "date", "priority"), "id", foreign={"customer": customer})
    c.create(orders.with_index(Index("byCustomer", ("customer",), ("total",))).with_index(Index("byStatus", ("status",), ("-total",))).with_index(Index("customersByStatus", ("status",), ("customer",))))
    c.create(Collection("Part", table(spark, d, "part").toDF("id", "name", "brand", "type", "size", "price"), "id").with_index(Index("bySize", ("size",), ("price",))))
    c.create(Collection("Item", table(spark, d, "lineitem").select(*(F.col(n).alias(n[2:]) for n in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")), "id"))
    # users as documents, their events as versions: each fifth one deletes
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 5 == 0, "delete").otherwise("update").alias("action"), F.col("event_type").alias("kind"), "value")
    c.logs["User"] = e
    users = Collection("User", versions.as_of(e, F.current_timestamp(), tie="ord").drop("ts", "ord", "action"))
    c.create(users.with_index(Index("byKind", ("kind",), ("value",))))
    c.function("double", lambda x: x * 2)
    return c


def text(name: str, source: str, sql: str) -> None:
    def run(spark, d):
        return Interpreter(spark, catalog(spark, d)).plan(source)

    QUERIES[name], SQL[name] = run, sql


text("x_where_project", "Customer.all().where(.balance > 9000).map(c => { id: c.id, label: \"#{c.name}/#{c.segment}\", rich: c.balance >= 9500 })", "SELECT c_custkey AS id, c_name || '/' || c_mktsegment AS label, c_acctbal >= 9500 AS rich FROM customer WHERE c_acctbal > 9000")
text("x_index_range", "Customer.bySegment('BUILDING', { from: 1000.0, to: 5000.0 }) { id, balance }", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 1000 AND 5000")
text("x_order_take", "Order.where(.total > 1000).order(desc(.total), .id).take(20) { id, total }", "SELECT o_orderkey AS id, o_totalprice AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
text("x_follow", "Order.byStatus('F').where(.customer.nation.region.name == 'ASIA') { id, total, who: .customer.name, nation: .customer.nation.name }", "SELECT o_orderkey AS id, o_totalprice AS total, c_name AS who, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F' AND r_name = 'ASIA'")
text("x_flat_map", "Nation.where(.name < 'F').flatMap(n => Customer.byNation(n.id).where(.balance > 5000)) { id, nation: .nation.id }", "SELECT c_custkey AS id, c_nationkey AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name < 'F' AND c_acctbal > 5000")
text("x_semi", "Customer.where(c => Order.byCustomer(c.id).where(.total > 150000).nonEmpty()) { id }", "SELECT c_custkey AS id FROM customer WHERE EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
text("x_anti", "Customer.where(c => c.balance > 0 && Order.byCustomer(c.id).isEmpty()) { id }", "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (FROM orders WHERE o_custkey = c_custkey)")
text("x_distinct", "Part.all().map(.brand).distinct()", "SELECT DISTINCT p_brand AS value FROM part")
text("x_concat", "Region.all().map(.name).concat(Nation.all().map(.name))", "SELECT r_name AS value FROM region UNION ALL SELECT n_name FROM nation")
text("x_reverse_drop", "Nation.all().reverse().drop(3).take(5) { id, name }", "SELECT n_nationkey AS id, n_name AS name FROM nation ORDER BY n_nationkey DESC LIMIT 5 OFFSET 3")
text("x_first_where", "let p = Part.firstWhere(.size == 10)\nPart.where(q => q.size == p.size + 1) { id, size }", "SELECT p_partkey AS id, p_size AS size FROM part WHERE p_size = 11")
text("x_if_null", "Customer.all().map(c => if (c.balance < 0) 'owes' else 'has')", "SELECT CASE WHEN c_acctbal < 0 THEN 'owes' ELSE 'has' END AS value FROM customer")
text("x_strings", "Part.all().map(p => { id: p.id, a: p.name.toUpperCase().slice(0, 4), b: p.name.indexOf('a') ?? -1, c: p.brand.replaceAll('Brand', 'B'), d: p.name.split(' ').length, e: p.name.length })", "SELECT p_partkey AS id, upper(substr(p_name, 1, 4)) AS a, CAST(strpos(p_name, 'a') - 1 AS INT) AS b, replace(p_brand, 'Brand', 'B') AS c, CAST(len(string_split(p_name, ' ')) AS INT) AS d, CAST(length(p_name) AS INT) AS e FROM part")
text("x_numbers", "Part.all().map(p => { id: p.id, a: p.size / 7, b: p.size % 7, c: p.size ** 2, d: Math.max(p.size, 25), e: (p.size & 12) | 1, f: Math.floor(p.price) })", "SELECT p_partkey AS id, CAST(p_size // 7 AS BIGINT) AS a, p_size % 7 AS b, CAST(p_size * p_size AS BIGINT) AS c, CAST(greatest(p_size, 25) AS BIGINT) AS d, CAST((p_size & 12) | 1 AS BIGINT) AS e, CAST(floor(p_price) AS BIGINT) AS f FROM (SELECT *, p_retailprice AS p_price FROM part)")
text("x_arrays", "Part.all().map(p => { id: p.id, a: Array.sequence(0, p.size).map(i => i * 2).filter(.mod2 != 1).length })".replace(".filter(.mod2 != 1)", ".filter(i => i % 4 == 0)"), "SELECT p_partkey AS id, CAST((p_size + 1) // 2 AS INT) AS a FROM part")
text("x_fold", "[5, 3, 9].fold(0, (a, x) => a * 10 + x) + Set.sequence(1, 5).toArray().reduce((a, b) => a + b)", "SELECT 549::BIGINT AS value")
text("x_fold_orders", "Order.all().fold(7, (a, o) => (a * 31 + o.customer) % 1000003)", "SELECT CAST(list_reduce(list_prepend(7::BIGINT, list(o_custkey ORDER BY o_orderkey)), lambda a, x: (a * 31 + x) % 1000003) AS BIGINT) AS value FROM orders")
text("x_blocks", "let f = (a, b) => a - b\nlet o = { x: 7, y: [1, 2] }\nf(o.x, o.y[1]) * (if (o.y.includes(3)) 1 else 10)", "SELECT 50::BIGINT AS value")
text("x_dates", "Order.all().map(o => { id: o.id, y: Date('2024-02-28').add(2, 'days').dayOfMonth, t: Time('2024-01-01T00:00:00Z').add(o.id, 'hours').toSeconds() })", "SELECT o_orderkey AS id, 1 AS y, 1704067200 + o_orderkey * 3600 AS t FROM orders")
text("x_aggregates", "{ n: Order.byStatus('F').count(), any: Order.all().any(.total > 1000), every: Customer.all().every(.balance > 0), mean: Math.mean(Part.all().map(.size)), sum: Math.sum(Part.all().map(.size)) }", "SELECT struct_pack(n := (SELECT count(*) FROM orders WHERE o_orderstatus = 'F'), \"any\" := true, every := (SELECT min(c_acctbal) > 0 FROM customer), mean := (SELECT sum(p_size) // count(*) FROM part), sum := (SELECT sum(p_size) FROM part)) AS value")


FOLD = "CAST(list_reduce(list_prepend(7::BIGINT, list({x} ORDER BY l_orderkey * 8 + l_linenumber)), lambda a, x: (a * 31 + x) % 1000003) AS BIGINT)"
text("x_fold_all", "Item.all().fold(7, (a, i) => (a + i.partkey * 31) % 1000003)", "SELECT CAST((7 + sum(l_partkey * 31)) % 1000003 AS BIGINT) AS value FROM lineitem")
PASSES = f"(SELECT *, had AND before_value > 50 AND before_value IS NOT NULL AS was, has AND coalesce(value > 50, false) AS now FROM {IMAGES})"
text("x_event_source", "User.where(.value > 50).map(u => u.kind).eventSource()", f"SELECT id, ts, ord, CASE WHEN NOT was AND now THEN 'add' WHEN was AND now THEN 'update' ELSE 'remove' END AS event_type, CASE WHEN now THEN event_type ELSE before_type END AS data FROM {PASSES} WHERE was OR now")
WATCHED = "CASE WHEN NOT has THEN before_type IS NOT NULL ELSE before_type IS DISTINCT FROM event_type END"
text("x_changes_on", "User.all().changesOn(.kind).where(.value > 50).map(u => u.value)", f"SELECT id, ts, ord, CASE WHEN NOT was AND now THEN 'add' WHEN was AND now THEN 'update' ELSE 'remove' END AS event_type, CASE WHEN now THEN value ELSE before_value END AS data FROM {PASSES} WHERE (was OR now) AND {WATCHED}")
text("x_index_stream", "User.byKind('click').eventsOn(.value).map(u => { value: u.value, twice: u.value * 2 }).map(.twice)", f"SELECT id, ts, ord, CASE WHEN NOT was AND now THEN 'add' WHEN was AND now THEN 'update' ELSE 'remove' END AS event_type, CASE WHEN now THEN value ELSE before_value END * 2 AS data FROM (SELECT *, had AND coalesce(before_type = 'click', false) AS was, has AND coalesce(event_type = 'click', false) AS now FROM {IMAGES}) WHERE (was OR now) AND CASE WHEN NOT has THEN before_value IS NOT NULL ELSE before_value IS DISTINCT FROM value END")
text("x_drop_ties", "Part.all().map(.brand).order().drop(700)", "SELECT p_brand AS value FROM part ORDER BY p_brand OFFSET 700")
text("x_modules", "Part.all().map(p => { id: p.id, a: Object.fromEntries([{ key: 'x', value: p.size }, { key: 'y', value: 2 }, { key: 'x', value: p.size + 1 }]).x, b: Bytes.fromBase64('AQID').toBase64(), c: Date.fromString('2024-02-28').year, d: Time.fromString('2024-01-01T00:00:10Z').second + p.size, e: Math.pow(p.size, 2), f: Object.toString({ k: p.size }), g: Math.floor(Math.PI + Math.E) })", "SELECT p_partkey AS id, CAST(p_size + 1 AS BIGINT) AS a, 'AQID' AS b, 2024 AS c, CAST(10 + p_size AS BIGINT) AS d, CAST(p_size * p_size AS DOUBLE) AS e, '{\"k\":' || p_size || '}' AS f, 5::BIGINT AS g FROM part")
text("x_eval_v4", "evalV4('{\"reverse\": {\"match\": \"F\", \"index\": \"byStatus\"}}').take(30)", "SELECT o_totalprice AS value FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice LIMIT 30")
text("x_definition", "{ name: Collection.byName('Customer').definition.name, fields: Collection.byName('Customer').definition.fields.map(.name), indexes: Customer.definition.indexes, shown: Customer.toString() }", "SELECT struct_pack(name := 'Customer', fields := ['id', 'name', 'nation', 'balance', 'segment'], indexes := ['bySegment', 'byNation'], shown := 'Customer') AS value")


def form(name: str, source, sql: str) -> None:
    def run(spark, d):
        out = Forms(spark, catalog(spark, d)).evaluate(source, {})
        if isinstance(out, Elements):
            return out.df.select(*[F.col(v).alias(f"v{k}") for k, v in enumerate(out.values)])
        return spark.range(1).select(*[(v if not isinstance(v, (int, float, str, bool)) else F.lit(v)).alias(k) for k, v in out.items()])

    QUERIES[name], SQL[name] = run, sql


status = lambda s: {"match": s, "index": "customersByStatus"}
form("v4_match", {"match": "F", "index": "byStatus"}, "SELECT o_totalprice AS v0 FROM orders WHERE o_orderstatus = 'F'")
form("v4_range", {"range": {"match": 10, "index": "bySize"}, "from": 1000.0, "to": 1500.0}, "SELECT p_retailprice AS v0 FROM part WHERE p_size = 10 AND p_retailprice BETWEEN 1000 AND 1500")
SIDES = "SELECT o_custkey AS v0, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY ALL"
form("v4_union", {"union": [status("F"), status("O")]}, f"SELECT v0 FROM (SELECT v0, unnest(range(greatest(a, b))) FROM ({SIDES}))")
form("v4_intersection", {"intersection": [status("F"), status("O")]}, f"SELECT v0 FROM (SELECT v0, unnest(range(least(a, b))) FROM ({SIDES}))")
form("v4_difference", {"difference": [status("F"), status("O")]}, f"SELECT v0 FROM (SELECT v0, unnest(range(CASE WHEN b > 0 THEN 0 ELSE a END)) FROM ({SIDES}))")
form("v4_distinct", {"distinct": status("F")}, "SELECT DISTINCT o_custkey AS v0 FROM orders WHERE o_orderstatus = 'F'")
form("v4_join", {"join": status("F"), "with": {"index": "byCustomer"}}, "SELECT DISTINCT o_totalprice AS v0 FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
form("v4_documents_filter", {"filter": {"lambda": "x", "expr": {"lt": [{"var": "x"}, 50]}}, "collection": {"documents": {"collection": "Customer"}}}, "SELECT c_custkey AS v0 FROM customer WHERE c_custkey < 50")
form(
    "v4_scalars",
    {"object": {
        "a": {"add": [1, 2, 3]}, "b": {"divide": [17, 5]}, "c": {"if": {"gt": [3, 2]}, "then": "yes", "else": "no"}, "d": {"let": [{"x": 4}, {"y": {"multiply": [{"var": "x"}, 2]}}], "in": {"subtract": [{"var": "y"}, 1]}},
        "e": {"concat": ["a", "b", "c"], "separator": "-"}, "f": {"substring": "documents", "start": -4, "length": 2}, "g": {"reduce": {"lambda": ["a", "x"], "expr": {"add": [{"var": "a"}, {"var": "x"}]}}, "initial": 0, "collection": [1, 2, 3]},
        "h": {"mean": [1, 2, 4.5]}, "i": {"sum": [1, 2, 4.5]}, "j": {"select": ["x", 1], "from": {"object": {"x": [5, 6]}}}, "k": {"select": ["z"], "from": {"object": {"x": 1}}, "default": "none"}, "l": {"find_str": "banana", "find": "n"},
        "m": {"equals": [1, 1, 1]}, "n": {"lt": [1, 2, 2]}, "o": {"day_of_week": {"date": "2024-02-29"}}, "p": {"time_diff": {"time": "2024-01-01T00:00:00Z"}, "other": {"time": "2024-01-03T12:00:00Z"}, "unit": "days"},
        "q": {"replace_str": "banana", "find": "a", "replace": "o"}, "r": {"repeat": "ab"}, "s": {"to_string": {"is_null": None}}, "t": {"call": {"function": "double"}, "arguments": 21}, "u": {"round": 3.14159, "precision": 3},
    }},
    "SELECT 6 AS a, 3::BIGINT AS b, 'yes' AS c, 7 AS d, 'a-b-c' AS e, 'en' AS f, 6 AS g, 2.5::DOUBLE AS h, 7.5::DOUBLE AS i, 6 AS j, 'none' AS k, 2 AS l, true AS m, false AS n, 4 AS o, 2::BIGINT AS p, 'bonono' AS q, 'abab' AS r, 'true' AS s, 42 AS t, 3.142::DOUBLE AS u",
)
form(
    "v4_strings",
    {"object": {
        "a": {"casefold": "ÉA"}, "b": {"title_case": "one two"}, "c": {"trim": "  x "}, "d": {"l_trim": "  x"}, "e": {"r_trim": "x  "}, "f": {"contains_str": "banana", "search": "nan"}, "g": {"contains_str_regex": "banana", "pattern": "n.n"},
        "h": {"starts_with": "banana", "search": "ba"}, "i": {"ends_with": "banana", "search": "na"}, "j": {"length": "añ🙂"}, "k": {"lower_case": "ABC"}, "l": {"upper_case": "abc"}, "m": {"replace_str_regex": "a1b2", "pattern": "([0-9])", "replace": "<$1>"},
        "n": {"replace_str_regex": "a1b2", "pattern": "[0-9]", "replace": "#", "first": True}, "o": {"format": "%s has %d", "values": ["x", 3]}, "p": {"space": 2}, "q": {"sub_string": "banana", "start": 2}, "r": {"select": [1], "from": {"split_str": "a,b,c", "token": ","}},
        "s": {"select": [0], "from": {"split_str_regex": "a1b2c", "pattern": "[0-9]", "count": 2}}, "t": {"count": {"ngram": "abcd", "min": 2, "max": 3}}, "u": {"find_str": "banana", "find": "z"}, "v": {"contains_value": 2, "in": [1, 2]},
    }},
    "SELECT 'éa' AS a, 'One Two' AS b, 'x' AS c, 'x' AS d, 'x' AS e, true AS f, true AS g, true AS h, true AS i, 3 AS j, 'abc' AS k, 'ABC' AS l, 'a<1>b<2>' AS m, 'a#b2' AS n, 'x has 3' AS o, '  ' AS p, 'nana' AS q, 'b' AS r, 'a' AS s, 5 AS t, -1 AS u, true AS v",
)
form(
    "v4_numbers_and_times",
    {"object": {
        "a": {"abs": -3}, "b": {"bitand": [12, 10]}, "c": {"bitor": [12, 3]}, "d": {"bitxor": [12, 10]}, "e": {"bitnot": 5}, "f": {"modulo": [17, 5]}, "g": {"max": [3, 9, 4]}, "h": {"min": [3, 9, 4]}, "i": {"pow": 3}, "j": {"hypot": 3, "b": 4},
        "k": {"sign": -4}, "l": {"trunc": 2.718, "precision": 1}, "m": {"and": [True, {"not": False}]}, "n": {"or": [False, False]}, "o": {"lte": [1, 1, 2]}, "p": {"gte": [3, 2, 2]}, "q": {"any": [False, True]}, "r": {"all": [True, False]},
        "s": {"to_seconds": {"time_add": {"time": "2024-01-01T00:00:00Z"}, "offset": 90, "unit": "minutes"}}, "t": {"to_millis": {"epoch": 5, "unit": "seconds"}}, "u": {"month": {"date": "2024-02-29"}}, "v": {"to_integer": "12.9"}, "w": {"to_string": 7},
        "x": {"year": {"time": "2024-05-06T07:08:09Z"}}, "y": {"minute": {"time": "2024-05-06T07:08:09Z"}}, "z": {"day_of_year": {"date": "2024-03-01"}},
    }},
    "SELECT 3 AS a, 8 AS b, 15 AS c, 6 AS d, -6 AS e, 2 AS f, 9 AS g, 3 AS h, 9.0::DOUBLE AS i, 5.0::DOUBLE AS j, -1 AS k, 2.7::DOUBLE AS l, true AS m, false AS n, true AS o, true AS p, true AS q, false AS r, 1704072600::BIGINT AS s, 5000::BIGINT AS t, 2 AS u, 12::BIGINT AS v, '7' AS w, 2024 AS x, 8 AS y, 61 AS z",
)
form(
    "v4_reduce_orders",
    {"object": {"folded": {"reduce": {"lambda": ["a", "x"], "expr": {"modulo": [{"add": [{"multiply": [{"var": "a"}, 31]}, {"var": "x"}]}, 1000003]}}, "initial": 7, "collection": {"documents": {"collection": "Order"}}}}},
    "SELECT CAST(list_reduce(list_prepend(7::BIGINT, list(o_orderkey ORDER BY o_orderkey)), lambda a, x: (a * 31 + x) % 1000003) AS BIGINT) AS folded FROM orders",
)


def row_form(name: str, source: str, keys: list[str], variables: dict[str, str], fields: dict, sql: str) -> None:
    """Scalar forms over the rows of a table: variables are its columns."""

    def run(spark, d):
        df = table(spark, d, source)
        forms = Forms(spark, catalog(spark, d))
        f = forms.evaluate({"lambda": list(variables), "expr": {"object": fields}}, {})
        out = f(*[F.expr(c) for c in variables.values()])
        return df.select(*keys, *[(v if not isinstance(v, (int, float, str, bool)) else F.lit(v)).alias(k) for k, v in out.items()])

    QUERIES[name], SQL[name] = run, sql


n, b = {"var": "n"}, {"var": "b"}
row_form(
    "v4_row_strings", "part", ["p_partkey"], {"n": "CASE WHEN p_size % 7 <> 0 THEN p_name END", "b": "p_brand", "s": "p_size"},
    {
        "a": {"uppercase": n}, "c": {"lowercase": b}, "d": {"titlecase": n}, "e": {"length": n}, "f": {"substring": n, "start": 2, "length": 5}, "g": {"containsstr": n, "search": "a"}, "h": {"startswith": b, "search": "Brand#1"}, "i": {"endswith": b, "search": "3"},
        "j": {"findstr": b, "find": "#"}, "k": {"replacestr": b, "find": "#", "replace": "-"}, "l": {"replacestrregex": b, "pattern": "[0-9]", "replace": "x"}, "m": {"concat": [b, "/", b]}, "o": {"repeat": b, "number": 3}, "p": {"trim": {"concat": ["  ", b, " "]}},
        "q": {"ltrim": {"concat": ["  ", b]}}, "r": {"rtrim": {"concat": [b, "  "]}}, "t": {"containsstrregex": b, "pattern": "#[12]"}, "u": {"casefold": b}, "v": {"select": [1], "from": {"split_str": b, "token": "#"}},
        "w": {"containsstrregex": b, "pattern": "Brand"}, "x": {"concat": [{"space": 2}, b]}, "y": {"to_string": {"var": "s"}}, "z": {"to_integer": {"to_string": {"var": "s"}}}, "aa": {"count": {"findstrregex": b, "pattern": "[a-z]"}},
    },
    "SELECT p_partkey, upper(n) AS a, lower(b) AS c, array_to_string(list_transform(string_split(lower(n), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS d, CAST(length(n) AS INT) AS e, substr(n, 3, 5) AS f, contains(n, 'a') AS g, starts_with(b, 'Brand#1') AS h, ends_with(b, '3') AS i, CAST(strpos(b, '#') - 1 AS INT) AS j, replace(b, '#', '-') AS k, regexp_replace(b, '[0-9]', 'x', 'g') AS l, b || '/' || b AS m, b || b || b AS o, b AS p, b AS q, b AS r, regexp_matches(b, '#[12]') AS t, lower(b) AS u, string_split(b, '#')[2] AS v, true AS w, '  ' || b AS x, CAST(p_size AS VARCHAR) AS y, CAST(p_size AS BIGINT) AS z, 4 AS aa FROM (SELECT *, CASE WHEN p_size % 7 <> 0 THEN p_name END AS n, p_brand AS b FROM part)",
)
six = lambda x: {"round": x, "precision": 6}
of_six = lambda x: f"trunc(({x}) * 1e6 + 0.5) / 1e6"
many = {"var": "x"}
row_form(
    "v4_row_numbers", "part", ["p_partkey"], {"s": "CAST(p_size AS BIGINT)", "x": "p_size / 50.0D", "m": "CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS BIGINT) END"},
    {
        **{k: six({f: many}) for k, f in (("a", "acos"), ("b", "asin"), ("c", "atan"), ("d", "cos"), ("e", "cosh"), ("f", "degrees"), ("g", "exp"), ("h", "ln"), ("i", "log"), ("j", "radians"), ("k", "sin"), ("l", "sinh"), ("m", "sqrt"), ("n", "tan"), ("o", "tanh"))},
        "p": {"ceil": many}, "q": {"floor": many}, "r": {"abs": {"subtract": [0, {"var": "s"}]}}, "t": {"add": [{"var": "s"}, {"var": "m"}]}, "u": {"multiply": [{"var": "s"}, 3, {"var": "m"}]}, "v": {"divide": [{"var": "s"}, 7]}, "w": {"modulo": [{"var": "s"}, 7]},
        "y": {"bitand": [{"var": "s"}, 12]}, "z": {"bitor": [{"var": "s"}, 3]}, "aa": {"bitxor": [{"var": "s"}, 5]}, "ab": {"bitnot": {"var": "s"}}, "ac": {"hypot": {"var": "s"}, "b": 4}, "ad": {"pow": {"var": "s"}, "exp": 2}, "ae": {"sign": {"subtract": [{"var": "s"}, 25]}}, "af": {"trunc": many, "precision": 1},
        "ag": {"max": [{"var": "s"}, 25]}, "ah": {"min": [{"var": "s"}, 25]}, "ai": {"equals": [{"var": "m"}, {"var": "s"}]}, "aj": {"lt": [10, {"var": "s"}, 40]}, "ak": {"gte": [{"var": "s"}, 25]}, "al": {"and": [{"lt": [{"var": "s"}, 30]}, {"not": {"lte": [{"var": "s"}, 10]}}]},
        "am": {"if": {"gt": [{"var": "s"}, 25]}, "then": "big", "else": "small"}, "an": {"is_null": {"var": "m"}}, "ao": {"is_integer": {"var": "s"}}, "ap": {"is_double": many}, "aq": {"is_number": {"var": "m"}}, "ar": {"to_double": {"to_string": many}}, "as_": {"to_number": {"to_string": {"var": "s"}}}, "at_": {"is_string": {"var": "s"}},
    },
    "SELECT p_partkey, " + ", ".join(f"{of_six(e)} AS {k}" for k, e in (("a", "acos(x)"), ("b", "asin(x)"), ("c", "atan(x)"), ("d", "cos(x)"), ("e", "cosh(x)"), ("f", "degrees(x)"), ("g", "exp(x)"), ("h", "ln(x)"), ("i", "log10(x)"), ("j", "radians(x)"), ("k", "sin(x)"), ("l", "sinh(x)"), ("m", "sqrt(x)"), ("n", "tan(x)"), ("o", "tanh(x)")))
    + ", CAST(ceil(x) AS BIGINT) AS p, CAST(floor(x) AS BIGINT) AS q, s AS r, s + m AS t, s * 3 * m AS u, s // 7 AS v, s % 7 AS w, s & 12 AS y, s | 3 AS z, xor(s, 5) AS aa, ~s AS ab, sqrt(s * s + 16) AS ac, CAST(s * s AS DOUBLE) AS ad, CAST(sign(s - 25) AS INT) AS ae, trunc(x * 10) / 10 AS af, greatest(s, 25) AS ag, least(s, 25) AS ah, m IS NOT DISTINCT FROM s AS ai, 10 < s AND s < 40 AS aj, s >= 25 AS ak, s < 30 AND s > 10 AS al, CASE WHEN s > 25 THEN 'big' ELSE 'small' END AS am, m IS NULL AS an, true AS ao, true AS ap, m IS NOT NULL AS aq, x AS ar, CAST(s AS DOUBLE) AS as_, false AS at_ FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS s, p_size / 50.0::DOUBLE AS x, CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS BIGINT) END AS m FROM part)",
)
t = {"var": "t"}
row_form(
    "v4_row_times", "events", ["event_id"], {"t": "CAST(ts AS TIMESTAMP)", "i": "event_id"},
    {
        "a": {"to_micros": t}, "b": {"to_millis": t}, "c": {"to_seconds": t}, "d": {"second": t}, "e": {"minute": t}, "f": {"hour": t}, "g": {"day_of_month": t}, "h": {"day_of_week": t}, "i": {"day_of_year": t}, "j": {"month": t}, "k": {"year": t},
        "l": {"to_seconds": {"time_add": t, "offset": 3, "unit": "hours"}}, "m": {"to_seconds": {"time_subtract": t, "offset": 2, "unit": "days"}}, "n": {"time_diff": t, "other": {"time_add": t, "offset": 90, "unit": "minutes"}, "unit": "minutes"}, "o": {"to_date": t}, "p": {"is_timestamp": t}, "q": {"is_date": {"to_date": t}},
        "r": {"to_seconds": {"epoch": {"var": "i"}, "unit": "seconds"}}, "s": {"to_seconds": {"to_time": {"to_string": t}}}, "t": {"is_object": t},
    },
    "SELECT event_id, epoch_us(ts) AS a, epoch_us(ts) // 1000 AS b, epoch_us(ts) // 1000000 AS c, CAST(second(ts) AS INT) AS d, CAST(minute(ts) AS INT) AS e, CAST(hour(ts) AS INT) AS f, CAST(day(ts) AS INT) AS g, CAST(isodow(ts) AS INT) AS h, CAST(dayofyear(ts) AS INT) AS i, CAST(month(ts) AS INT) AS j, CAST(year(ts) AS INT) AS k, epoch_us(ts) // 1000000 + 10800 AS l, epoch_us(ts) // 1000000 - 172800 AS m, 90::BIGINT AS n, CAST(ts AS DATE) AS o, true AS p, true AS q, event_id AS r, epoch_us(ts) // 1000000 AS s, false AS t FROM events",
)
ITEMS = {"documents": {"collection": "Item"}}
form("v4_reduce_all", {"object": {"folded": {"reduce": {"lambda": ["a", "x"], "expr": {"modulo": [{"add": [{"multiply": [{"var": "a"}, 31]}, {"var": "x"}]}, 1000003]}}, "initial": 7, "collection": ITEMS}}}, f"SELECT {FOLD.format(x='l_orderkey * 8 + l_linenumber')} AS folded FROM lineitem")
form("v4_reverse_first", {"object": {"a": {"first": {"match": "F", "index": "byStatus"}}, "b": {"first": {"reverse": {"match": "F", "index": "byStatus"}}}, "c": {"last": {"match": "F", "index": "byStatus"}}, "d": {"last": {"reverse": {"reverse": {"match": 10, "index": "bySize"}}}}}}, "SELECT max(o_totalprice) FILTER (o_orderstatus = 'F') AS a, min(o_totalprice) FILTER (o_orderstatus = 'F') AS b, min(o_totalprice) FILTER (o_orderstatus = 'F') AS c, (SELECT max(p_retailprice) FROM part WHERE p_size = 10) AS d FROM orders")
form("v4_desc_range", {"range": {"match": "F", "index": "byStatus"}, "from": 200000.0, "to": 100000.0}, "SELECT o_totalprice AS v0 FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 100000 AND 200000")
form("v4_drop_ties", {"drop": 100, "collection": {"union": [status("F"), status("O")]}}, f"SELECT v0 FROM (SELECT v0, unnest(range(greatest(a, b))) FROM ({SIDES})) ORDER BY v0 OFFSET 100")
form("v4_take_reversed", {"take": 50, "collection": {"reverse": status("F")}}, "SELECT o_custkey AS v0 FROM orders WHERE o_orderstatus = 'F' ORDER BY o_custkey DESC LIMIT 50")
form("v4_lambda_join", {"join": status("F"), "with": {"lambda": "c", "expr": {"match": {"add": [{"var": "c"}, 1]}, "index": "byCustomer"}}}, "SELECT DISTINCT o_totalprice AS v0 FROM orders WHERE o_custkey - 1 IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
form("v4_lambda_join_union", {"join": {"documents": {"collection": "Nation"}}, "with": {"lambda": "c", "expr": {"let": {"d": {"modulo": [{"var": "c"}, 5]}}, "in": {"union": [{"match": {"var": "c"}, "index": "byNation"}, {"match": {"add": [{"var": "d"}, 20]}, "index": "byNation"}]}}}}, "SELECT DISTINCT c_custkey AS v0 FROM customer JOIN nation n ON c_nationkey = n.n_nationkey OR c_nationkey = n.n_nationkey % 5 + 20")
form("v4_events", {"events": {"match": "click", "index": "byKind"}}, "SELECT ts AS v0, CASE WHEN event_id % 5 = 0 THEN 'delete' ELSE 'update' END AS v1, user_id AS v2 FROM events WHERE event_type = 'click'")
form("v4_mapped_set", {"map": {"lambda": "x", "expr": {"multiply": [{"var": "x"}, 2]}}, "collection": {"match": 10, "index": "bySize"}}, "SELECT p_retailprice * 2 AS v0 FROM part WHERE p_size = 10")


def paged(name: str, source: dict, pages: int, sql: str) -> None:
    """Elements of the last of so many pages, each from the cursor of the one before."""

    def run(spark, d):
        forms = Forms(spark, catalog(spark, d))
        page = forms.run(source)
        for _ in range(pages - 1):
            page = forms.run({**source, "cursor": {"quote": {"after": page["after"]}}})
        return spark.createDataFrame([tuple(x) if isinstance(x, list) else (x,) for x in page["data"]], "v0 double")

    QUERIES[name], SQL[name] = run, sql


paged("v4_desc_page", {"paginate": {"match": "F", "index": "byStatus"}, "size": 40}, 3, "SELECT o_totalprice AS v0 FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC LIMIT 40 OFFSET 80")
paged("v4_page_ties", {"paginate": {"map": {"lambda": "x", "expr": {"multiply": [{"modulo": [{"var": "x"}, 3]}, 1.0]}}, "collection": {"documents": {"collection": "Nation"}}}, "size": 4}, 2, "SELECT CAST(n_nationkey % 3 AS DOUBLE) AS v0 FROM nation ORDER BY n_nationkey LIMIT 4 OFFSET 4")


def v4_type_tests(spark, d):
    """Tests of type over all kinds of values, a row each: those that hold."""
    values = {
        "collection": {"collection": "Customer"}, "index": {"index": "byStatus"}, "function": {"function": "double"}, "database": {"database": "main"}, "role": {"role": "reader"}, "ref": {"ref": {"collection": "Customer"}, "id": 7}, "key": {"ref": {"quote": "keys"}, "id": 1},
        "token": {"ref": {"quote": "tokens"}, "id": 1}, "credentials": {"ref": {"quote": "credentials"}, "id": 1}, "set": {"match": "F", "index": "byStatus"}, "doc": {"get": {"ref": {"collection": "Customer"}, "id": 7}}, "string": "x", "integer": 3, "double": 2.5, "boolean": True, "null": None,
        "array": [1, 2], "object": {"object": {"a": 1}}, "lambda": {"lambda": "x", "expr": {"var": "x"}}, "timestamp": {"time": "2024-01-01T00:00:00Z"}, "date": {"date": "2024-01-01"}, "bytes": {"@bytes": "AQID"}, "uuid": {"@uuid": "123e4567-e89b-12d3-a456-426614174000"},
    }
    tests = ["number", *values]
    forms, rows = Forms(spark, catalog(spark, d)), []
    for name, v in values.items():
        held = [t for t in tests if forms.run({f"is_{t}": v})]
        rows.append((name, ",".join(sorted(held))))
    return spark.createDataFrame(rows, "value string, tests string")


QUERIES["v4_type_tests"] = v4_type_tests
SQL["v4_type_tests"] = """SELECT * FROM (VALUES ('collection', 'collection,ref'), ('index', 'index,ref'), ('function', 'function,ref'), ('database', 'database,ref'), ('role', 'ref,role'), ('ref', 'ref'), ('key', 'key,ref'), ('token', 'ref,token'), ('credentials', 'credentials,ref'),
('set', 'set'), ('doc', 'doc,object'), ('string', 'string'), ('integer', 'integer,number'), ('double', 'double,number'), ('boolean', 'boolean'), ('null', 'null'), ('array', 'array'), ('object', 'object'), ('lambda', 'lambda'), ('timestamp', 'timestamp'), ('date', 'date'), ('bytes', 'bytes'), ('uuid', 'uuid')) t(value, tests)"""
