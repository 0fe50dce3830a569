"""The scalar libraries on real columns. Columns are made lazily: Spark needs a session for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import arrays as A
from sheaf.functions import dates as D
from sheaf.functions import numbers as N
from sheaf.functions import objects as O
from sheaf.functions import strings as S
from sheaf.functions import types as Y
from sheaf.queries.registry import columns, joined, table


def of_orders(spark, d):
    """Arrays of each order's lines: q quantities, p part keys."""
    line = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q")).alias("x"))
    each = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return each.select(F.col("l_orderkey").alias("k"), F.transform("xs", lambda x: x["q"]).alias("q"), F.transform("xs", lambda x: x["l_partkey"]).alias("p"))


ORDERS = "(SELECT l_orderkey AS k, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_quantity) AS q, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS p FROM lineitem GROUP BY l_orderkey)"
text = lambda a: f"array_to_string({a}, ',')"

columns(
    "array_access", of_orders, ORDERS, ["k"],
    length=(lambda: A.length("q"), "CAST(len(q) AS INT)"),
    at_0=(lambda: A.at("q", 0), "q[1]"),
    first=(lambda: A.first("q"), "q[1]"),
    last=(lambda: A.last("q"), "q[-1]"),
    is_empty=(lambda: A.is_empty("q"), "len(q) = 0"),
    non_empty=(lambda: A.non_empty("q"), "len(q) > 0"),
    includes=(lambda: A.includes("q", 7), "list_contains(q, 7)"),
    index_of=(lambda: A.index_of("q", A.last("q")), "CAST(list_position(q, q[-1]) - 1 AS INT)"),
    index_of_start=(lambda: A.index_of("q", A.last("q"), 1), "CAST(CASE WHEN len(q) > 1 THEN list_position(q[2:], q[-1]) END AS INT)"),
    last_index_of=(lambda: A.last_index_of("q", A.first("q")), "CAST(len(q) - list_position(list_reverse(q), q[1]) AS INT)"),
    last_index_of_end=(lambda: A.last_index_of("q", A.first("q"), 0), "0"),
    index_where=(lambda: A.index_where("q", lambda x: x > 25), "CAST(CASE WHEN len(list_filter(q, lambda x: x > 25)) > 0 THEN list_position(list_transform(q, lambda x: x > 25), true) - 1 END AS INT)"),
    last_index_where=(lambda: A.last_index_where("q", lambda x: x > 25), "CAST(CASE WHEN len(list_filter(q, lambda x: x > 25)) > 0 THEN len(q) - list_position(list_reverse(list_transform(q, lambda x: x > 25)), true) END AS INT)"),
    first_where=(lambda: A.first_where("q", lambda x: x > 25), "list_filter(q, lambda x: x > 25)[1]"),
    last_where=(lambda: A.last_where("q", lambda x: x > 25), "list_filter(q, lambda x: x > 25)[-1]"),
)

columns(
    "array_shape", of_orders, ORDERS, ["k"],
    sequence=(lambda: joined(A.sequence(1, F.size("q"))), text("range(1, len(q))")),
    append=(lambda: joined(A.append("q", 99)), text("list_append(q, 99)")),
    prepend=(lambda: joined(A.prepend("q", 99)), text("list_prepend(99, q)")),
    concat=(lambda: joined(A.concat("q", "p")), text("list_concat(q, p)")),
    take=(lambda: joined(A.take("q", 2)), text("q[1:2]")),
    drop=(lambda: joined(A.drop("q", 2)), text("q[3:]")),
    take_signed=(lambda: joined(A.take_signed("q", -2)), text("q[greatest(len(q) - 1, 1):]")),
    drop_signed=(lambda: joined(A.drop_signed("q", -2)), text("q[1:greatest(len(q) - 2, 0)]")),
    slice=(lambda: joined(A.slice_("q", 1, 3)), text("q[2:3]")),
    slice_from=(lambda: joined(A.slice_("q", 1)), text("q[2:]")),
    reverse=(lambda: joined(A.reverse("q")), text("list_reverse(q)")),
    order=(lambda: joined(A.order("q")), text("list_sort(q)")),
    order_desc=(lambda: joined(A.order("q", (lambda x: x, False))), text("list_reverse_sort(q)")),
    distinct=(lambda: joined(A.order(A.distinct("q"))), text("list_sort(list_distinct(q))")),
    entries=(lambda: joined(A.map_(A.entries("q"), lambda e: F.concat_ws(":", e["index"], e["value"]))), text("list_transform(q, lambda x, i: (i - 1) || ':' || x)")),
    flatten=(lambda: joined(A.flatten(F.array("q", "p"))), text("list_concat(q, p)")),
)

columns(
    "array_higher_order", of_orders, ORDERS, ["k"],
    map=(lambda: joined(A.map_("q", lambda x: x * 2)), text("list_transform(q, lambda x: x * 2)")),
    filter=(lambda: joined(A.filter_("q", lambda x: x % 2 == 0)), text("list_filter(q, lambda x: x % 2 = 0)")),
    where=(lambda: joined(A.where("q", lambda x: x > 10)), text("list_filter(q, lambda x: x > 10)")),
    flat_map=(lambda: joined(A.flat_map("q", lambda x: F.array(x, -x))), text("flatten(list_transform(q, lambda x: [x, -x]))")),
    any=(lambda: A.any_("q", lambda x: x > 40), "len(list_filter(q, lambda x: x > 40)) > 0"),
    every=(lambda: A.every("q", lambda x: x > 5), "len(list_filter(q, lambda x: x > 5)) = len(q)"),
    fold=(lambda: A.fold("q", F.lit(1).cast("long"), lambda a, x: a * 3 % 1009 + x), "list_reduce(list_prepend(1::BIGINT, q), lambda a, x: a * 3 % 1009 + x)"),
    fold_right=(lambda: A.fold_right("q", F.lit(1).cast("long"), lambda a, x: a * 3 % 1009 + x), "list_reduce(list_prepend(1::BIGINT, list_reverse(q)), lambda a, x: a * 3 % 1009 + x)"),
    reduce=(lambda: A.reduce("q", lambda a, x: a * 2 % 1009 + x), "list_reduce(q, lambda a, x: a * 2 % 1009 + x)"),
    reduce_right=(lambda: A.reduce_right("q", lambda a, x: a * 2 % 1009 + x), "list_reduce(list_reverse(q), lambda a, x: a * 2 % 1009 + x)"),
    aggregate=(lambda: A.aggregate("q", F.lit(0).cast("long"), lambda a, b: F.greatest(a, b)), "list_max(q)"),
    sum=(lambda: A.sum_("q"), "CAST(list_sum(q) AS DOUBLE)"),
    mean=(lambda: F.round(A.mean("q"), 6), "round(list_avg(q), 6)"),
    max=(lambda: A.max_("q"), "list_max(q)"),
    min=(lambda: A.min_("q"), "list_min(q)"),
    all_true=(lambda: A.all_true(A.map_("q", lambda x: x > 2)), "len(list_filter(q, lambda x: x > 2)) = len(q)"),
    any_true=(lambda: A.any_true(A.map_("q", lambda x: x > 45)), "len(list_filter(q, lambda x: x > 45)) > 0"),
)

MOD = "(SELECT k, list_transform(q, lambda x: x % 4) AS a, list_transform(p, lambda x: x % 4) AS b FROM " + ORDERS + ")"
times = lambda x, a: f"len(list_filter({a}, lambda y: y = {x}))"


def of_residues(spark, d):
    return of_orders(spark, d).select("k", F.transform("q", lambda x: x % 4).alias("a"), F.transform("p", lambda x: x % 4).alias("b"))


columns(
    "array_multisets", of_residues, MOD, ["k"],
    union_max=(lambda: joined(A.order(A.union_max("a", "b"))), text(f"flatten(list_transform([0, 1, 2, 3], lambda x: list_transform(range(greatest({times('x', 'a')}, {times('x', 'b')})), lambda i: x)))")),
    intersection_min=(lambda: joined(A.order(A.intersection_min("a", "b"))), text(f"flatten(list_transform([0, 1, 2, 3], lambda x: list_transform(range(least({times('x', 'a')}, {times('x', 'b')})), lambda i: x)))")),
    difference=(lambda: joined(A.order(A.difference("a", "b"))), text(f"flatten(list_transform([0, 1, 2, 3], lambda x: list_transform(range(greatest({times('x', 'a')} - {times('x', 'b')}, 0)), lambda i: x)))")),
)

columns(
    "string_tests", "part", "part", ["p_partkey"],
    starts_with=(lambda: S.starts_with("p_type", F.lit("S")), "starts_with(p_type, 'S')"),
    ends_with=(lambda: S.ends_with("p_name", F.lit("1")), "ends_with(p_name, '1')"),
    includes=(lambda: S.includes("p_name", F.lit("a")), "contains(p_name, 'a')"),
    includes_regex=(lambda: S.includes_regex("p_name", "[0-9]{2}"), "regexp_matches(p_name, '[0-9]{2}')"),
    length=(lambda: S.length("p_name"), "CAST(length(p_name) AS INT)"),
    index_of=(lambda: S.index_of("p_name", F.lit("a")), "CAST(nullif(strpos(p_name, 'a'), 0) - 1 AS INT)"),
    index_of_start=(lambda: S.index_of("p_name", F.lit("a"), 2), "CAST(CASE WHEN strpos(substr(p_name, 3), 'a') > 0 THEN strpos(substr(p_name, 3), 'a') + 1 END AS INT)"),
    last_index_of=(lambda: S.last_index_of("p_name", F.lit("a")), "CAST(CASE WHEN strpos(reverse(p_name), 'a') > 0 THEN length(p_name) - strpos(reverse(p_name), 'a') END AS INT)"),
    index_of_regex=(lambda: S.index_of_regex("p_name", "[0-9]"), "CAST(CASE WHEN regexp_matches(p_name, '[0-9]') THEN length(regexp_extract(p_name, '^[^0-9]*')) END AS INT)"),
    find_str=(lambda: S.find_str("p_name", F.lit("q")), "CAST(strpos(p_name, 'q') - 1 AS INT)"),
)

columns(
    "string_edits", "part", "part", ["p_partkey"],
    at_0=(lambda: S.at("p_name", 0), "p_name[1]"),
    concat=(lambda: S.concat("p_name", F.col("p_brand")), "p_name || p_brand"),
    add=(lambda: S.add("p_name", F.col("p_size")), "p_name || p_size"),
    template=(lambda: S.template("<", F.col("p_size"), ">"), "'<' || p_size || '>'"),
    insert=(lambda: S.insert("p_name", 2, F.lit("--")), "substr(p_name, 1, 2) || '--' || substr(p_name, 3)"),
    slice=(lambda: S.slice_("p_name", 1, 4), "substr(p_name, 2, 3)"),
    slice_from=(lambda: S.slice_("p_name", 3), "substr(p_name, 4)"),
    substring=(lambda: S.substring("p_name", -3), "right(p_name, 3)"),
    lower=(lambda: S.to_lower_case("p_brand"), "lower(p_brand)"),
    upper=(lambda: S.to_upper_case("p_name"), "upper(p_name)"),
    trim=(lambda: S.trim(F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))), "p_name"),
    ltrim=(lambda: S.ltrim(F.concat(F.lit("  "), F.col("p_name"), F.lit("."))), "p_name || '.'"),
    rtrim=(lambda: S.rtrim(F.concat(F.lit("."), F.col("p_name"), F.lit("  "))), "'.' || p_name"),
    repeat=(lambda: S.repeat("p_brand"), "p_brand || p_brand"),
    space=(lambda: S.space(3), "'   '"),
    replace=(lambda: S.replace("p_name", F.lit("a"), F.lit("$1")), "CASE WHEN strpos(p_name, 'a') > 0 THEN substr(p_name, 1, strpos(p_name, 'a') - 1) || '$1' || substr(p_name, strpos(p_name, 'a') + 1) ELSE p_name END"),
    replace_all=(lambda: S.replace_all("p_name", F.lit("a"), F.lit("$1")), "replace(p_name, 'a', '$1')"),
    replace_regex=(lambda: S.replace_regex("p_name", "[0-9]", F.lit("#")), "regexp_replace(p_name, '[0-9]', '#')"),
    replace_all_regex=(lambda: S.replace_all_regex("p_name", "[0-9]", F.lit("$")), "regexp_replace(p_name, '[0-9]', '$', 'g')"),
    replace_groups=(lambda: S.replace_groups("p_name", "([0-9])", "<$1>"), r"regexp_replace(p_name, '([0-9])', '<\1>', 'g')"),
    format=(lambda: S.format_("%s-%05d", "p_brand", "p_size"), "printf('%s-%05d', p_brand, p_size)"),
)

columns(
    "string_parts", "part", "part", ["p_partkey"],
    matches=(lambda: joined(S.matches("p_name", "[0-9]")), text("regexp_extract_all(p_name, '[0-9]')")),
    match_indexes=(lambda: joined(A.map_(S.match_indexes("p_brand", "[a-z]+"), lambda m: F.concat_ws(":", m["index"], m["match"]))), "CASE WHEN regexp_matches(p_brand, '[a-z]') THEN length(regexp_extract(p_brand, '^[^a-z]*')) || ':' || regexp_extract(p_brand, '[a-z]+') ELSE '' END"),
    split=(lambda: joined(S.split("p_name", F.lit(" "))), text("string_split(p_name, ' ')")),
    split_letters=(lambda: joined(S.split("p_brand", F.lit(""))), text("list_transform(range(1, length(p_brand) + 1), lambda i: p_brand[i])")),
    split_regex=(lambda: joined(S.split_regex("p_name", "[ae]")), text("regexp_split_to_array(p_name, '[ae]')")),
    split_at=(lambda: joined(S.split_at("p_name", 3)), "substr(p_name, 1, 3) || ',' || substr(p_name, 4)"),
    ngram=(lambda: joined(S.ngram("p_brand", 2, 2)), text("list_transform(range(1, length(p_brand)), lambda i: substr(p_brand, i, 2))")),
    casefold=(lambda: S.casefold("p_brand"), "lower(p_brand)"),
)

columns(
    "parse_and_convert", "part", "part", ["p_partkey"],
    parse_long=(lambda: S.parse_long(F.col("p_size").cast("string")), "CAST(p_size AS BIGINT)"),
    parse_long_hex=(lambda: S.parse_long(F.lower(F.hex("p_size")), 16), "CAST(p_size AS BIGINT)"),
    parse_int=(lambda: S.parse_int(F.col("p_size").cast("string")), "p_size"),
    parse_int_bad=(lambda: S.parse_int("p_name"), "TRY_CAST(NULL AS INT)"),
    parse_double=(lambda: S.parse_double(F.col("p_retailprice").cast("string")), "p_retailprice"),
    parse_number=(lambda: S.parse_number(F.col("p_size").cast("string")), "CAST(p_size AS DOUBLE)"),
    to_string=(lambda: Y.to_string(F.when(F.col("p_size") > 25, F.col("p_size"))), "CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE 'null' END"),
    to_number=(lambda: Y.to_number(F.concat("p_size", F.lit("abc"))), "CAST(p_size AS DOUBLE)"),
    to_integer=(lambda: Y.to_integer(F.concat("p_size", F.lit(".7"))), "CAST(p_size AS BIGINT)"),
    base64=(lambda: Y.bytes_to_base64(F.col("p_name").cast("binary")), "to_base64(encode(p_name))"),
    from_base64=(lambda: Y.bytes_from_base64(Y.bytes_to_base64(F.col("p_brand").cast("binary"))).cast("string"), "p_brand"),
    to_id=(lambda: Y.to_id(F.col("p_size").cast("string")), "CAST(p_size AS BIGINT)"),
)

columns(
    "math_functions", "part", "part", ["p_partkey"],
    abs=(lambda: N.abs_(F.col("p_size") - 25), "abs(p_size - 25)"),
    acos=(lambda: F.round(N.acos(F.col("p_size") / 100), 9), "round(acos(p_size / 100), 9)"),
    asin=(lambda: F.round(N.asin(F.col("p_size") / 100), 9), "round(asin(p_size / 100), 9)"),
    atan=(lambda: F.round(N.atan("p_size"), 9), "round(atan(p_size), 9)"),
    ceil=(lambda: N.ceil("p_retailprice").cast("double"), "ceil(p_retailprice)"),
    floor=(lambda: N.floor("p_retailprice").cast("double"), "floor(p_retailprice)"),
    cos=(lambda: F.round(N.cos("p_size"), 9), "round(cos(p_size), 9)"),
    sin=(lambda: F.round(N.sin("p_size"), 9), "round(sin(p_size), 9)"),
    tan=(lambda: F.round(N.tan(F.col("p_size") / 100), 9), "round(tan(p_size / 100), 9)"),
    cosh=(lambda: F.round(N.cosh(F.col("p_size") / 20), 9), "round(cosh(p_size / 20), 9)"),
    sinh=(lambda: F.round(N.sinh(F.col("p_size") / 20), 9), "round(sinh(p_size / 20), 9)"),
    tanh=(lambda: F.round(N.tanh(F.col("p_size") / 20), 9), "round(tanh(p_size / 20), 9)"),
    degrees=(lambda: F.round(N.degrees("p_size"), 6), "round(degrees(p_size), 6)"),
    radians=(lambda: F.round(N.radians("p_size"), 9), "round(radians(p_size), 9)"),
    exp=(lambda: F.round(N.exp(F.col("p_size") / 10), 6), "round(exp(p_size / 10), 6)"),
    hypot=(lambda: F.round(N.hypot("p_size", "p_retailprice"), 6), "round(sqrt(p_size * p_size + p_retailprice * p_retailprice), 6)"),
    ln=(lambda: F.round(N.log("p_retailprice"), 9), "round(ln(p_retailprice), 9)"),
    log10=(lambda: F.round(N.log10("p_retailprice"), 9), "round(log10(p_retailprice), 9)"),
    max=(lambda: N.max_("p_size", 25), "greatest(p_size, 25)"),
    min=(lambda: N.min_("p_size", 25), "least(p_size, 25)"),
    pow=(lambda: N.power("p_size", 3), "pow(p_size, 3)"),
    round=(lambda: N.round_("p_retailprice", 1), "trunc(p_retailprice * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE"),
    round_negative=(lambda: N.round_(-F.col("p_retailprice"), 1), "trunc(-p_retailprice * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE"),
    trunc=(lambda: N.trunc("p_retailprice", 1), "trunc(p_retailprice * 10.0::DOUBLE) / 10.0::DOUBLE"),
    sign=(lambda: N.sign(F.col("p_size") - 25), "CAST(sign(p_size - 25) AS INT)"),
    sqrt=(lambda: F.round(N.sqrt("p_size"), 9), "round(sqrt(p_size), 9)"),
    e_pi=(lambda: F.round(N.e() * N.pi(), 9), "round(exp(1) * pi(), 9)"),
)

columns(
    "number_operators", "lineitem", "lineitem", ["l_orderkey", "l_partkey", "l_linenumber"],
    add=(lambda: N.add("l_partkey", F.col("l_suppkey")), "l_partkey + l_suppkey"),
    add_big=(lambda: N.add(F.lit((1 << 53) + 1), F.col("l_partkey")), "9007199254740993 + l_partkey"),
    add_overflow=(lambda: N.add(F.lit((1 << 63) - 500), F.col("l_partkey")), "CASE WHEN l_partkey < 500 THEN 9223372036854775308 + least(l_partkey, 499) END"),
    add_widened=(lambda: N.widened(N.add, F.lit((1 << 63) - 1), F.col("l_partkey")), "CAST(9223372036854775807 AS DOUBLE) + CAST(l_partkey AS DOUBLE)"),
    subtract=(lambda: N.subtract("l_partkey", F.col("l_suppkey")), "l_partkey - l_suppkey"),
    multiply_overflow=(lambda: N.multiply(F.lit(1 << 54), F.col("l_partkey")), "CASE WHEN l_partkey < 512 THEN 18014398509481984 * least(l_partkey, 511) END"),
    multiply=(lambda: N.multiply("l_partkey", F.col("l_suppkey")), "l_partkey * l_suppkey"),
    negate=(lambda: N.negate("l_partkey"), "-l_partkey"),
    divide_int=(lambda: N.divide_int(-F.col("l_partkey"), F.col("l_linenumber") + 1), "CAST(-l_partkey // (l_linenumber + 1) AS BIGINT)"),
    divide=(lambda: F.round(N.divide("l_extendedprice", F.col("l_quantity")), 6), "round(l_extendedprice / l_quantity, 6)"),
    modulo=(lambda: N.modulo(-F.col("l_partkey"), F.col("l_linenumber") + 1), "-l_partkey % (l_linenumber + 1)"),
    sum_chain=(lambda: N.chain(N.add, "l_partkey", F.col("l_suppkey"), F.col("l_linenumber")), "l_partkey + l_suppkey + l_linenumber"),
    bit_and=(lambda: N.bit_and("l_partkey", F.col("l_suppkey")), "l_partkey & l_suppkey"),
    bit_or=(lambda: N.bit_or("l_partkey", F.col("l_suppkey")), "l_partkey | l_suppkey"),
    bit_xor=(lambda: N.bit_xor("l_partkey", F.col("l_suppkey")), "xor(l_partkey, l_suppkey)"),
    bit_not=(lambda: N.bit_not("l_partkey"), "~l_partkey"),
)

NULLED = "(SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS a, CASE WHEN c_nationkey > 5 THEN c_nationkey * 100.0::DOUBLE END AS b FROM customer)"


def of_nulls(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("a"), F.when(F.col("c_nationkey") > 5, F.col("c_nationkey") * 100.0).alias("b"))


columns(
    "null_semantics", of_nulls, NULLED, ["c_custkey"],
    equal=(lambda: N.equal("a", F.col("b")), "a IS NOT DISTINCT FROM b"),
    not_equal=(lambda: N.not_equal("a", F.col("b")), "a IS DISTINCT FROM b"),
    less=(lambda: N.less("a", F.col("b")), "coalesce(a < b, false)"),
    less_or_equal=(lambda: N.less_or_equal("a", F.col("b")), "coalesce(a <= b, a IS NULL AND b IS NULL)"),
    greater=(lambda: N.greater("a", F.col("b")), "coalesce(a > b, false)"),
    greater_or_equal=(lambda: N.greater_or_equal("a", F.col("b")), "coalesce(a >= b, a IS NULL AND b IS NULL)"),
    increasing=(lambda: N.increasing(N.less, F.lit(0.0), F.col("a"), F.col("b")), "coalesce(0 < a, false) AND coalesce(a < b, false)"),
    coalesced=(lambda: F.coalesce("a", "b", F.lit(0.0)), "coalesce(a, b, 0.0)"),
    conditional=(lambda: F.when(F.col("a").isNull(), "none").when(F.col("a") > 5000, "high").otherwise("low"), "CASE WHEN a IS NULL THEN 'none' WHEN a > 5000 THEN 'high' ELSE 'low' END"),
    if_without_else=(lambda: F.when(N.less("a", F.col("b")), 1), "CASE WHEN a < b THEN 1 END"),
    and_or=(lambda: (F.col("a").isNull() & F.col("b").isNull()) | ~F.col("a").isNull(), "(a IS NULL AND b IS NULL) OR a IS NOT NULL"),
)

columns(
    "time_functions", "events", "events", ["event_id"],
    year=(lambda: D.year("ts"), "CAST(year(ts) AS INT)"),
    month=(lambda: D.month("ts"), "CAST(month(ts) AS INT)"),
    day_of_month=(lambda: D.day_of_month("ts"), "CAST(day(ts) AS INT)"),
    day_of_week=(lambda: D.day_of_week("ts"), "CAST(isodow(ts) AS INT)"),
    day_of_year=(lambda: D.day_of_year("ts"), "CAST(dayofyear(ts) AS INT)"),
    hour=(lambda: D.hour("ts"), "CAST(hour(ts) AS INT)"),
    minute=(lambda: D.minute("ts"), "CAST(minute(ts) AS INT)"),
    second=(lambda: D.second("ts"), "CAST(second(ts) AS INT)"),
    to_micros=(lambda: D.to_micros(F.col("ts").cast("timestamp")), "epoch_us(ts)"),
    to_millis=(lambda: D.to_millis(F.col("ts").cast("timestamp")), "epoch_us(ts) // 1000"),
    to_seconds=(lambda: D.to_seconds(F.col("ts").cast("timestamp")), "epoch_us(ts) // 1000000"),
    add=(lambda: D.to_micros(D.add(F.col("ts").cast("timestamp"), 36, "hours")), "epoch_us(ts) + 36 * 3600000000"),
    add_half_day=(lambda: D.to_micros(D.add(F.col("ts").cast("timestamp"), 3, "half days")), "epoch_us(ts) + 3 * 43200000000"),
    subtract=(lambda: D.to_micros(D.subtract(F.col("ts").cast("timestamp"), 90, "seconds")), "epoch_us(ts) - 90000000"),
    difference=(lambda: D.difference(F.col("ts").cast("timestamp"), F.lit("2024-01-01T00:00:00Z").cast("timestamp"), "hours"), "CAST(trunc((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000) AS BIGINT)"),
    epoch=(lambda: D.to_seconds(D.epoch(F.col("event_id"), "minutes")), "event_id * 60"),
    parse=(lambda: D.to_micros(D.parse(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))), "epoch_us(ts)"),
)

columns(
    "date_functions", "orders", "orders", ["o_orderkey"],
    date=(lambda: D.date_parse(F.date_format("o_orderdate", "yyyy-MM-dd")), "CAST(o_orderdate AS DATE)"),
    add=(lambda: D.date_add(F.to_date("o_orderdate"), 30), "CAST(CAST(o_orderdate AS DATE) + 30 AS DATE)"),
    subtract=(lambda: D.date_subtract(F.to_date("o_orderdate"), 30), "CAST(CAST(o_orderdate AS DATE) - 30 AS DATE)"),
    difference=(lambda: D.date_difference(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")), "CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS BIGINT)"),
    day_of_week=(lambda: D.day_of_week(F.to_date("o_orderdate")), "CAST(isodow(o_orderdate) AS INT)"),
)


def of_objects(spark, d):
    nation = table(spark, d, "nation")
    return nation.select(
        "n_nationkey",
        F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string")).alias("m"),
        F.create_map(F.lit("region"), F.lit("x"), F.lit("flag"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("even"))).alias("w"),
        F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("key")).alias("region")).alias("s"),
        F.to_json(F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("key")).alias("region"))).alias("j"),
    )


shown = lambda m: joined(F.transform(F.sort_array(F.map_entries(m)), lambda x: F.concat_ws("=", x["key"], F.coalesce(x["value"], F.lit("null")))))
EVEN = "CASE WHEN n_nationkey % 2 = 0 THEN 'even' END"
columns(
    "object_functions", of_objects, "nation", ["n_nationkey"],
    keys=(lambda: joined(O.keys("m")), "'name,region'"),
    values=(lambda: joined(O.values("m")), "n_name || ',' || n_regionkey"),
    entries=(lambda: shown(F.map_from_entries(O.entries("m"))), "'name=' || n_name || ',region=' || n_regionkey"),
    from_entries=(lambda: shown(O.from_entries(F.concat(F.map_entries("m"), F.map_entries("w")))), f"'flag=' || coalesce({EVEN}, 'null') || ',name=' || n_name || ',region=x'"),
    assign=(lambda: shown(O.assign("m", "w")), f"'flag=' || coalesce({EVEN}, 'null') || ',name=' || n_name || ',region=x'"),
    merge=(lambda: shown(O.merge("m", "w")), f"coalesce('flag=' || {EVEN} || ',', '') || 'name=' || n_name || ',region=x'"),
    merge_resolved=(lambda: shown(O.merge("m", "w", lambda k, a, b: F.coalesce(a, b))), f"coalesce('flag=' || {EVEN} || ',', '') || 'name=' || n_name || ',region=' || n_regionkey"),
    patched=(lambda: shown(O.patched("m", "w")), f"coalesce('flag=' || {EVEN} || ',', '') || 'name=' || n_name || ',region=x'"),
    select=(lambda: O.select("s", "region", "key"), "n_regionkey"),
    select_json=(lambda: O.select_json("j", "region", "key"), "CAST(n_regionkey AS VARCHAR)"),
    has_path=(lambda: O.has_path("s", "name"), "true"),
    contains_field=(lambda: O.contains_field("w", "flag"), "true"),
    contains_value=(lambda: O.contains_value("w", F.lit("even")), "n_nationkey % 2 = 0"),
    to_json=(lambda: O.to_json("s"), """'{"name":"' || n_name || '","region":{"key":' || n_regionkey || '}}'"""),
)
