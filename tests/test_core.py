"""Ordered sets, catalogs, versions, streams, exports and the two languages on small fixtures."""

import datetime as dt
import functools
import json

import pytest
from pyspark.sql import functions as F

from sheaf.functions import arrays as A
from sheaf.functions import numbers as N
from sheaf.functions import strings as S
from sheaf.functions import types as Y
from sheaf.operators import setops as X
from sheaf.operators.ordered import Ordered
from sheaf.plans.interpreter import EvalError, Interpreter
from sheaf.plans.json_forms import Elements, FormError, Forms
from sheaf.plans.syntax import ParseError, parse
from sheaf.sources import export, versions
from sheaf.sources.catalog import Catalog, Collection, Index
from sheaf.streaming import changes


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_nulls_are_greatest(spark):
    s = Ordered.of(spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id int, v int"), "v", "id")
    assert [r["id"] for r in s.rows()] == [1, 3, 2]
    assert [r["id"] for r in s.reverse().rows()] == [2, 3, 1]
    assert [r["id"] for r in s.order("-v").take(1).df.collect()] == [2]


def test_pages_cover_all_rows_once(spark):
    df = spark.createDataFrame([(k, k % 3 if k % 5 else None) for k in range(40)], "id int, v int")
    for keys in (("v", "id"), ("-v", "id"), ("v", "-id")):
        s, seen, cursor = Ordered.of(df, *keys), [], None
        while True:
            page = s.paginate(cursor, 7)
            seen += [r["id"] for r in page.data]
            cursor = page.after
            if not cursor:
                break
        assert seen == [r["id"] for r in s.rows()]


def test_folds(spark):
    s = Ordered.of(spark.createDataFrame([(k, str(k)) for k in range(5)], "id int, t string"), "id")
    assert s.fold("", lambda a, r: a + r["t"]) == "01234" and s.fold_right("", lambda a, r: a + r["t"]) == "43210"
    assert s.reduce(lambda a, r: a if a["id"] > r["id"] else r)["id"] == 4
    assert s.where(F.lit(False)).reduce(lambda a, r: a) is None
    assert s.where(F.lit(False)).every(F.lit(False)).first()[0] and not s.any(F.col("id") > 9).first()[0]
    assert s.includes(id=3).first()[0] and len(s.to_array().first()["data"]) == 5
    with pytest.raises(ValueError):
        s.take(-1)


def test_scalar_errors(spark):
    for c in (N.sqrt(F.lit(-1.0)), N.acos(F.lit(2.0)), N.log(F.lit(0.0)), N.divide_int(F.lit(1), F.lit(0)), A.at(F.array(F.lit(1)), 1), S.at(F.lit("a"), 1), A.mean(F.expr("cast(array() as array<int>)"))):
        with pytest.raises(Exception):
            one(spark, c)
    assert one(spark, N.divide(F.lit(1.0), F.lit(0))) == float("inf")
    assert one(spark, A.reduce(F.expr("cast(array() as array<int>)"), lambda a, x: a + x)) is None


def test_strings(spark):
    assert one(spark, S.replace(F.lit("a.b.c.d"), F.lit("."), F.lit("$1"), 2)) == "a$1b$1c.d"
    assert one(spark, S.replace_regex(F.lit("a1b22c3"), "[0-9]+", F.lit("#"), 2)) == "a#b#c3"
    assert one(spark, S.split(F.lit(",a,,b,"), F.lit(","))) == ["", "a", "", "b", ""] and one(spark, S.split(F.lit("añ🙂"), F.lit(""))) == ["a", "ñ", "🙂"]
    assert [tuple(x) for x in one(spark, S.match_indexes(F.lit("ab12c345"), "[0-9]+"))] == [(2, "12"), (5, "345")]
    assert one(spark, S.casefold(F.lit("Straße ﬁ"))) == "strasse fi"
    assert one(spark, S.last_index_of(F.lit("abcabc"), F.lit("bc"), 3)) == 1
    assert one(spark, S.ngram(F.lit("abc"))) == ["a", "b", "c", "ab", "bc"]
    assert one(spark, S.parse_int(F.lit("-12"))) == -12 and one(spark, S.parse_int(F.lit("99999999999"))) is None and one(spark, S.parse_long(F.lit("zz"), 36)) == 1295


def test_array_order(spark):
    a = F.expr("array(named_struct('k', 2, 'n', 'b'), named_struct('k', null, 'n', 'c'), named_struct('k', 2, 'n', 'a'), named_struct('k', 1, 'n', 'd'))")
    assert [x["n"] for x in one(spark, A.order(a, (lambda x: x["k"], True), (lambda x: x["n"], True)))] == ["d", "a", "b", "c"]
    assert [x["n"] for x in one(spark, A.order(a, (lambda x: x["k"], False), (lambda x: x["n"], False)))] == ["c", "b", "a", "d"]


def test_historical_algebra(spark):
    t = lambda k: dt.datetime(2024, 1, k)
    a = spark.createDataFrame([(1, t(1), "add"), (1, t(4), "remove"), (2, t(2), "add")], "k int, ts timestamp, action string")
    b = spark.createDataFrame([(1, t(2), "add"), (1, t(6), "remove"), (2, t(2), "add"), (2, t(3), "remove")], "k int, ts timestamp, action string")
    of = lambda rule: sorted((r["k"], r["ts"].day, r["action"]) for r in X.historical({"a": a, "b": b}, ["k"], rule).collect())
    assert of("union") == [(1, 1, "add"), (1, 6, "remove"), (2, 2, "add")]
    assert of("intersection") == [(1, 2, "add"), (1, 4, "remove"), (2, 2, "add"), (2, 3, "remove")]
    assert of("difference") == [(1, 1, "add"), (1, 2, "remove"), (2, 3, "add")]


def test_versions(spark):
    t = lambda k: dt.datetime(2024, 1, k)
    log = spark.createDataFrame([(1, t(1), "create", 5), (1, t(3), "update", 6), (1, t(5), "delete", 6), (2, t(2), "create", 7)], "id int, ts timestamp, action string, v int")
    at = lambda k: sorted((r["id"], r["v"]) for r in versions.as_of(log, F.lit(t(k))).collect())
    assert (at(1), at(3), at(6)) == ([(1, 5)], [(1, 6), (2, 7)], [(2, 7)])
    assert versions.retained(log, F.lit(t(4))).count() == 3
    patch = spark.createDataFrame([(2, 9)], "id int, v int")
    new = versions.updated(versions.as_of(log, F.lit(t(6))), patch, F.lit(t(7)), ["v"]).select(log.columns)
    assert versions.as_of(log.unionByName(new), F.lit(t(8))).first()["v"] == 9
    assert versions.remove(log, log.where("id = 2")).count() == 3 and versions.insert(log, log.where("id = 2")).count() == 4


def test_stream_equals_batch(spark, tmp_path):
    t = lambda k: dt.datetime(2024, 1, 1, k)
    rows = [(k % 3, t(k), "delete" if k % 7 == 6 else "update", k * 10 % 70) for k in range(20)]
    log = spark.createDataFrame(rows, "id int, ts timestamp, action string, v int")
    for k in range(2):
        log.where((F.hour("ts") < 10) == F.lit(k == 0)).coalesce(1).write.parquet(f"{tmp_path}/log/{k}")
    keep = lambda r: r["v"] > 25
    batch = changes.events(versions.before_images(log, ["v"]).drop("v"), keep)
    stream = changes.stream(spark, f"{tmp_path}/log/*", log.schema)
    found = changes.events(changes.with_before_images(stream, ["v"]), keep)
    out = []
    q = changes.subscribe(found, lambda df, _: out.extend(df.collect()), f"{tmp_path}/check", once=True)
    q.awaitTermination(120)
    key = lambda rs: sorted((r["id"], r["ts"], r["event_type"], r["data"]["v"]) for r in rs)
    assert key(out) == key(batch.collect()) and len(out) > 5


def test_feed_and_watch(spark):
    rows = [(k, dt.datetime(2024, 1, 1 + k // 4), k) for k in range(10)]
    log = spark.createDataFrame(rows, "id int, ts timestamp, ord int")
    seen, cursor, more = [], None, True
    while more:
        page, cursor, more = changes.feed(log, cursor, 4)
        seen += [r["id"] for r in page]
    assert seen == list(range(10))
    with pytest.raises(ValueError):
        changes.check_streamable(["where", "order"])


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, 'a"b', dt.date(2024, 1, 2), [1, 2], None)], "i int, d double, s string, t date, a array<bigint>, n string")
    export.export(df, f"{tmp_path}/x", tagged=True, compress=True)
    (line,) = spark.read.text(f"{tmp_path}/x").collect()
    assert json.loads(line[0]) == {"i": {"@int": "1"}, "d": {"@double": "2.5"}, "s": 'a"b', "t": {"@date": "2024-01-02"}, "a": [{"@long": "1"}, {"@long": "2"}], "n": None}
    export.export(df.union(df), f"{tmp_path}/y", form="json", fragments=1)
    assert len(json.loads("".join(r[0] for r in spark.read.text(f"{tmp_path}/y").collect()))) == 2
    assert export.read(spark, f"{tmp_path}/x", "text").count() == 1
    assert Y.simple({"a": 1, "b": [2.5, None]}) == {"a": 1, "b": [2.5, None]} and Y.tagged({"@x": 1}) == {"@object": {"@x": {"@int": "1"}}}


@pytest.fixture(scope="module")
def people(spark):
    c = Catalog(spark)
    town = c.create(Collection("Town", spark.createDataFrame([(1, "Ulm"), (2, "Bonn")], "id long, name string")))
    person = Collection("Person", spark.createDataFrame([(1, "Ann", 40, 1), (2, "Bob", None, 2), (3, "Cy", 20, 9), (4, "Ann", 30, 1)], "id long, name string, age long, town long"), foreign={"town": town})
    c.create(person.with_index(Index("byName", ("name",), ("-age",))))
    return c


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("1 + 2 * 3", 7), ("7 / 2", 3), ("-7 / 2", -3), ("7.0 / 2", 3.5), ("2 ** 3 ** 2", 512), ("'a' + 1", "a1"), ("null ?? 3", 3), ("null == null", True), ("null < 1", False), ("1 isa Number", True),
        ("[3, 1, 2].order()", [1, 2, 3]), ("[1, 2, 3].map(x => x * 2).filter(.x2 > 2)".replace(".x2 > 2", "y => y > 2"), [4, 6]), ("'abc'.slice(1)", "bc"), ("'a,b'.split(',')", ["a", "b"]),
        ("let x = 5; x - 1", 4), ("if (1 > 2) 'a' else 'b'", "b"), ("if (1 > 2) 'a'", None), ("{ a: 1, b: [2] }", {"a": 1, "b": [2]}), ("Math.max(2, 3)", 3), ("Object.keys({ a: 1, b: 2 })", ["a", "b"]),
        ("[1, 2].fold(10, (a, x) => a - x)", 7), ("Array.sequence(1, 4)", [1, 2, 3]), ("\"n: #{1 + 1}\"", "n: 2"), ("(x => x + 1)(2)", 3), ("Date('2024-03-01').subtract(1, 'days').dayOfMonth", 29),
        ("Person.byName('Ann').first()!.age", 40), ("Person.byId(3)!.name", "Cy"), ("Person.all().count()", 4), ("Person.all().map(.name).distinct().toArray()", ["Ann", "Bob", "Cy"]),
        ("Person.firstWhere(.age == 77)?.name", None), ("Person(2)!.town", 2), ("Math.mean(Person.byName('Ann').map(.age))", 35), ("Person.all().map(.age).includes(20)", True),
    ],
)
def test_language(people, source, want):
    assert Interpreter(people.spark, people).run(source) == want


def test_language_sets(people):
    run = Interpreter(people.spark, people).run
    assert run("Person.byName('Ann') { id, age }").data == [{"id": 1, "age": 40}, {"id": 4, "age": 30}]
    assert run("Person.all() { name, town { name } }").data[2] == {"name": "Cy", "town": None}
    assert run("Person.all().order(desc(.age), .id).map(.id)").data == [2, 1, 4, 3]
    assert run("Person.where(.town.name == 'Ulm').map(.id)").data == [1, 4]
    assert run("Town.all().flatMap(t => Person.where(p => p.town.id == t.id)).map(.id)").data == [1, 4, 2]
    assert run("Set.sequence(0, 40)").data == list(range(16))
    with pytest.raises(ValueError):
        run("Person.all().order(.age).toStream()")
    with pytest.raises(EvalError):
        run("nothing.here")
    for bad in ("1 +", "let x = 1", "{ a: 1, a: 2 }", "'open"):
        with pytest.raises(ParseError):
            parse(bad)


def test_folds_of_whole_sets(people, monkeypatch):
    want, wanted = 7, 7
    for x in range(40_000):
        want, wanted = (want * 31 + x) % 1000003, (wanted * 31 + 39_999 - x) % 1000003
    it = Interpreter(people.spark, people)
    step = "(a, x) => (a * 31 + x) % 1000003"
    assert it.run(f"Set.sequence(0, 40000).fold(7, {step})") == want
    assert it.run(f"Set.sequence(0, 40000).foldRight(7, {step})") == wanted
    assert it.run("Set.sequence(0, 40000).reduce((a, x) => if (a > x) a else x)") == 39_999
    assert it.run("Set.sequence(0, 40000).reduceRight((a, x) => a - x)") == 39_999 - sum(range(39_999))
    assert it.run("Set.sequence(0, 40000).aggregate(5, (a, x) => a + x)") == 5 + sum(range(40_000))
    monkeypatch.setattr("sheaf.plans.interpreter.MOST", 2)
    seen = []
    it.on_set(it.evaluate(parse("Set.sequence(0, 50)"), {}), "forEach", [seen.append])
    assert [v.const for v in seen] == list(range(50))
    assert it.run("Person.all().fold(0, (a, p) => a * 10 + p.id)") == 1234
    # more than an array of a set ever held
    many = Forms(people.spark, people)
    numbers = Elements(people.spark.range(100_010), ("id",))
    f = lambda a, x: (a * F.lit(31) + x) % 1000003
    got = many.form_reduce({"reduce": {"var": "f"}, "initial": 7, "collection": {"var": "c"}}, {"f": f, "c": numbers})
    want = 7
    for x in range(100_010):
        want = (want * 31 + x) % 1000003
    assert people.spark.range(1).select(got).first()[0] == want


def held_by_executors(monkeypatch):
    """No set's rows may come to the driver; slices are small."""

    def refused(self, *args, **kwargs):
        raise AssertionError("rows of a set come to the driver")

    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", refused)
    monkeypatch.setattr("sheaf.operators.ordered.SLICE", 7_000)


def test_text_folds_leave_rows_with_executors(people, monkeypatch):
    held_by_executors(monkeypatch)
    it = Interpreter(people.spark, people)
    step = lambda a, x: (a * 31 + x) % 1000003
    up, total, last = 7, 0, 0
    for x in range(40_000):
        up, total, last = step(up, x), total + x, x
    assert it.run("Set.sequence(0, 40000).fold(7, (a, x) => (a * 31 + x) % 1000003)") == up
    assert it.run("Set.sequence(0, 40000).reduceRight((a, x) => a - x)") == 39_999 - sum(range(39_999))
    assert it.run("Set.sequence(0, 40000).aggregate(5, (a, x) => a + x)") == 5 + total
    assert it.run("Set.sequence(0, 40000).map(x => if (x % 2 == 0) x else null).fold(0, (a, x) => a + (x ?? 1))") == sum(x if x % 2 == 0 else 1 for x in range(40_000))
    rows = "Set.sequence(0, 40000).map(x => { a: x, b: 'n', c: x % 7 })"
    assert it.run(f"{rows}.fold(7, (a, o) => (a * 31 + o.c) % 1000003)") == functools.reduce(step, (x % 7 for x in range(40_000)), 7)
    assert it.run(f"{rows}.fold(0, (a, o) => a + 1)") == 40_000
    assert it.run(f"{rows}.fold({{ n: 0, m: 0 }}, (a, o) => {{ n: a.n + o.a, m: o.a }})") == {"n": total, "m": last}
    assert it.run(f"{rows}.reduce((a, o) => if (a.a > o.a) a else o)") == {"a": 39_999, "b": "n", "c": 39_999 % 7}


def test_text_folds_keep_the_order_of_sets(people, monkeypatch):
    held_by_executors(monkeypatch)
    key = lambda x: (x * 7919) % 40009
    want = functools.reduce(lambda a, x: (a * 31 + x) % 1000003, sorted(range(40_000), key=key, reverse=True), 7)
    assert Interpreter(people.spark, people).run("Set.sequence(0, 40000).order(desc(x => (x * 7919) % 40009)).fold(7, (a, x) => (a * 31 + x) % 1000003)") == want


def test_slices_of_few_rows_and_without_a_folder(spark, monkeypatch):
    monkeypatch.setattr("sheaf.operators.ordered.SLICE", 30)
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k"), F.lit(None).alias("none")).repartition(40)
    want = sorted((k * 7919) % 1009 for k in range(1000))
    for folder in (True, False):
        if not folder:
            monkeypatch.setattr("sheaf.operators.ordered.shared_folder", lambda _: None)
        for columns in ({"k": F.col("k")}, {"k": F.col("k"), "none": F.col("none")}):  # no file holds a column without a type
            got = [[x["k"] for x in part.first()["v"]] for part in Ordered.of(df, "k").slices(columns)]
            assert sum(got, []) == want and max(map(len, got)) <= 30 and len(got) < 80
    assert list(Ordered.of(df.where("k < 0"), "k").slices({"k": F.col("k")})) == []


def folded_form(forms, elements, f, seed):
    got = forms.form_reduce({"reduce": {"var": "f"}, "initial": seed, "collection": {"var": "c"}}, {"f": f, "c": elements})
    return forms.spark.range(1).select(F.struct(got.alias("v"))).first()[0]["v"]


def test_form_folds_leave_rows_with_executors(people, monkeypatch):
    held_by_executors(monkeypatch)
    forms = Forms(people.spark, people)
    f = lambda a, x: (a * F.lit(31) + x) % 1000003
    numbers = Elements(people.spark.range(20_000).select("id", (-F.col("id")).alias("down")), ("id",), (("down", True),))
    assert folded_form(forms, numbers, f, 7) == functools.reduce(lambda a, x: (a * 31 + x) % 1000003, reversed(range(20_000)), 7)


def test_form_folds_of_pairs_and_nulls(people, monkeypatch):
    held_by_executors(monkeypatch)
    forms = Forms(people.spark, people)
    pairs = Elements(people.spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("even")), ("id", "even"), (("id", True),))
    assert folded_form(forms, pairs, lambda a, x: a + F.coalesce(x[1], F.lit(1)), 0) == sum(x if x % 2 == 0 else 1 for x in range(20_000))
    evens = Elements(pairs.df, ("even",), (("id", True),))
    assert folded_form(forms, evens, lambda a, x: a + F.coalesce(x, F.lit(1)), 0) == sum(x if x % 2 == 0 else 1 for x in range(20_000))
    assert folded_form(forms, Elements(pairs.df.where("id < 0"), ("id",)), lambda a, x: a + x, 5) == 5


def test_reducers_run_with_executors(spark, monkeypatch):
    held_by_executors(monkeypatch)
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k")).repartition(8)
    s, keys = Ordered.of(df, "k"), sorted(k * 7919 % 20_011 for k in range(20_000))
    step = lambda a, r: (a * 31 + r["k"]) % 1000003
    plain = lambda a, k: (a * 31 + k) % 1000003
    assert s.fold(7, step) == functools.reduce(plain, keys, 7)
    assert s.fold_right(7, step) == functools.reduce(plain, reversed(keys), 7)
    assert s.reduce(lambda a, r: a if a["k"] > r["k"] else r)["k"] == s.reduce_right(lambda a, r: a if a["k"] > r["k"] else r)["k"] == keys[-1]
    assert s.where(F.lit(False)).reduce(lambda a, r: a) is None and s.where(F.lit(False)).fold(3, step) == 3


def test_reducers_that_cannot_be_sent_run_here(spark):
    import threading

    lock, seen = threading.Lock(), []

    def reducer(a, r):
        with lock:
            seen.append(r["id"])
        return a + r["id"]

    assert Ordered.of(spark.range(50), "id").fold(0, reducer) == sum(range(50)) and seen == list(range(50))


def test_ranged_joins(spark):
    odd = [None, float("nan"), float("inf"), -float("inf"), 1e18, 0.0, -0.0, 125.0, 124.99999999999999, -125.0, 500.0, -500.0, -999.99]
    values = odd + [(k * 7919 % 11_000) - 999.5 for k in range(150)]
    a = spark.createDataFrame([(k, k % 2, v) for k, v in enumerate(values)], "a int, k int, v double").repartition(3)
    b = spark.createDataFrame([(k, k % 2 if k % 17 else None, v) for k, v in enumerate(odd + [(k * 104729 % 11_000) - 999.5 for k in range(400)])], "b int, j int, w double")
    pairs = lambda df: sorted(map(tuple, df.select("a", "b").collect()))
    want = pairs(a.join(b, (a.k == b.j) & b.w.between(a.v - 500, a.v)))
    got = X.ranged(a, b, [(a.k, b.j)], (a.v - 500, a.v), b.w, 125.0)
    assert pairs(got) == want and len(want) > 1000 and got.columns == [*a.columns, *b.columns]
    assert pairs(X.ranged(a, b, [(a.k, b.j)], (a.v, a.v - 500), b.w, 125.0)) == pairs(a.join(b, (a.k == b.j) & b.w.between(a.v, a.v - 500)))


def test_theta_join_deals_out_a_key(spark):
    from sheaf.queries import QUERIES

    plan = QUERIES["theta_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "_stretch" in plan


def test_forms(people):
    run = Forms(people.spark, people).run
    assert run({"paginate": {"match": "Ann", "index": "byName"}, "size": 1}) == {"data": [40], "after": 30}  # the index is descending
    assert run({"get": {"ref": {"collection": "Person"}, "id": 3}})["name"] == "Cy"
    assert run({"exists": {"ref": {"collection": "Person"}, "id": 33}}) is False
    assert run({"merge": {"object": {"a": 1, "b": 2}}, "with": {"object": {"b": None, "c": 3}}}) == {"a": 1, "c": 3}
    assert run({"take": 2, "collection": [1, 2, 3]}) == [1, 2] and run({"drop": -1, "collection": [1, 2, 3]}) == [1, 2]
    assert run({"union": [[1, 1, 2], [1, 3]]}) == [1, 1, 2, 3] and run({"difference": [[1, 1, 2], [1]]}) == [1, 2]
    assert run({"map": {"lambda": "x", "expr": {"add": [{"var": "x"}, 1]}}, "collection": [1, 2]}) == [2, 3]
    assert run({"is_string": "x"}) is True and run({"is_integer": True}) is False
    with pytest.raises(FormError):
        run({"no_such": 1})
    with pytest.raises(FormError):
        run({"select": ["a"], "from": {"object": {"b": 1}}})


def test_bucketed_index(spark, people):
    table = people.collection("Person").with_index(Index("byTown", ("town",), ("age",))).build("byTown", 4)
    assert table.where("town = 1").count() == 2


def test_roles_and_functions(people):
    assert people.listing().where("kind = 'index'").count() == 1 and "name" in people.definition("Person").names
    people.function("twice", lambda x: x * 2)
    assert people.call("twice", 4) == 8


SCHEMA = """
collection Town { name: String }
collection Person {
  name: String
  age: Int? = 18
  town: Ref<Town>?
  tags: Array<String>
  compute label: String = (doc => doc.name + "/" + doc.age)
  check grown (doc => doc.age >= 0)
  unique [.name]
  index byTown { terms [.town] values [desc(.age), .name] }
  index byTag { terms [mva(.tags)] }
  history_days 3
}
function older(p: Person, n: Int): Boolean { p.age > n }
role reader { privileges Person { read { predicate (doc => doc.age < 50) } } privileges Town { read } }
"""


def test_schema_language(spark):
    from sheaf.plans import schema

    towns = spark.createDataFrame([(1, "Ulm")], "id long, name string")
    people = spark.createDataFrame([(1, "Ann", 40, 1, ["x", "y", "x"]), (2, "Bob", None, 1, ["y"]), (3, "Cy", 60, None, None), (4, "Cy", -1, 7, [])], "id long, name string, age int, town long, tags array<string>")
    c = Catalog(spark)
    schema.apply(c, SCHEMA, {"Town": towns, "Person": people})
    run = Interpreter(spark, c).run
    assert run("Person.byTown(1).map(.label)").data == ["Ann/40", "Bob/18"]
    assert run("Person.byTag('y').map(.id)").data == [1, 2]
    assert run("Person.where(p => older(p, 30)).map(p => p.town.name ?? 'none')").data == ["Ulm", "none"]
    p = c.collection("Person")
    assert [r["id"] for r in p.check_violations().collect()] == [4] and p.unique_violations().first()["n"] == 2 and [r["id"] for r in p.foreign_violations().collect()] == [4]
    schema.apply(c, SCHEMA, {"Town": towns, "Person": people}, role="reader")
    assert run("Person.all().map(.id)").data == [1, 2, 4]
    assert schema.differences(SCHEMA, SCHEMA.replace("history_days 3", "email: String?").replace("check grown", "check old")) == [("added", "Person", "checks.old"), ("added", "Person", "fields.email"), ("removed", "Person", "checks.grown")]


def test_schema_migrations(spark):
    from sheaf.plans import schema

    text = """collection A { n: Int? rest: String? kind: String
      migrations { split .mixed -> .n, .rest
        move .sort -> .kind
        backfill .kind = "none"
        drop .old } }"""
    c = Catalog(spark)
    schema.apply(c, text, {"A": spark.createDataFrame([(1, "12", "a", 0), (2, "x", None, 0)], "id long, mixed string, sort string, old int")})
    assert Interpreter(spark, c).run("A.all() { id, n, rest, kind }").data == [{"id": 1, "n": 12, "rest": None, "kind": "a"}, {"id": 2, "n": None, "rest": "x", "kind": "none"}]


def test_writes(spark, tmp_path):
    from pyspark.sql.types import StructType

    from sheaf.sources.store import ConstraintError, Store

    c = Catalog(spark)
    rules = Collection("Acc", spark.createDataFrame([], "id long, owner string, balance long"), checks={"solvent": lambda d: d["balance"] >= 0}, unique=(("owner",),), defaults={"balance": lambda d: F.lit(5)})
    store = Store(spark, f"{tmp_path}/acc", StructType.fromDDL("owner string, balance long"), rules)
    c.stores["Acc"] = store
    c.create(rules)
    run = Interpreter(spark, c).run
    assert run("Acc.create({ id: 1, owner: 'a', balance: 100 })") == {"id": 1, "owner": "a", "balance": 100}
    assert run("Acc.create({ id: 9, owner: 'b' })")["balance"] == 5
    assert run("Acc.byId(1)!.update({ balance: 70 })") == {"id": 1, "owner": "a", "balance": 70}
    mark = spark.range(1).select(F.current_timestamp()).first()[0]
    assert run("Acc(1)!.replace({ owner: 'z', balance: 1 })")["owner"] == "z"
    assert run("Acc(9)!.update({ owner: null })") == {"id": 9, "owner": None, "balance": 5}
    run("Acc(9)!.delete()")
    assert run("Acc.all().map(.id)").data == [1]
    assert run(f"at (Time('{mark.isoformat()}Z')) {{ Acc.all().map(.balance) }}").data == [70, 5]
    for bad in ("Acc.create({ owner: 'q', balance: -1 })", "Acc.create({ owner: 'z', balance: 1 })", "Acc.create({ id: 1, owner: 'n' })"):
        with pytest.raises(ConstraintError):
            run(bad)
    assert [r["action"] for r in store.history(9).collect()] == ["create", "update", "delete"]


def test_ties(spark):
    """Drops, takes and pages of sets whose rows tie, or are alike, cover each row once."""
    rows = [(k % 2, "ab"[k % 4 // 2], k % 3) for k in range(30)] + [(None, "a", 1)] * 3
    df = spark.createDataFrame(rows, "v int, w string, x int")
    alike = sorted(map(str, rows))
    for keys in (("v",), ("-v",), ("w", "-v"), ()):
        s = Ordered.of(df, *keys)
        for n in (0, 1, 5, 16, 29, 33, 40):
            parts = [tuple(r) for o in (s.take(n), s.drop(n)) for r in o.df.collect()]
            assert sorted(map(str, parts)) == alike
        seen, cursor = [], None
        while True:
            page = s.paginate(cursor, 4)
            seen += [tuple(r) for r in page.data]
            cursor = page.after
            if not cursor:
                break
        assert sorted(map(str, seen)) == alike and len(seen) == 33
    nested = Ordered.of(spark.createDataFrame([(1, [1]), (1, [1]), (1, [2])], "v int, a array<int>"), "v")
    assert len(nested.drop(1).df.collect()) == 2


def test_exact_integers(spark):
    big = 1 << 53
    assert one(spark, N.add(F.lit(big + 1), F.lit(0))) == big + 1 and one(spark, N.multiply(F.lit(big + 1), F.lit(3))) == 3 * big + 3
    for a, b in ((1 << 63) - 1, 1), (-(1 << 63), -1), ((1 << 63) - 1, 0), (-(1 << 63), 0), (5, -7):
        fits = lambda x: x if -(1 << 63) <= x < 1 << 63 else None
        c = [F.lit(x).cast("bigint") for x in (a, b)]
        assert (one(spark, N.add(*c)), one(spark, N.subtract(*c)), one(spark, N.multiply(*c))) == (fits(a + b), fits(a - b), fits(a * b))
    assert one(spark, N.widened(N.add, F.lit((1 << 63) - 1), F.lit(1))) == 2.0**63
    assert one(spark, N.add(F.lit(1e300), F.lit(1e300))) == 2e300 and one(spark, N.multiply(F.lit(1e200), F.lit(1e10))) == 1e210


def test_form_pages(people):
    """Pages of a descending index, backward and forward, with ties and sources."""
    forms = Forms(people.spark, people)
    forms.catalog.create(Collection("Num", people.spark.createDataFrame([(k, "a" if k < 9 else "b", k // 4) for k in range(12)], "id long, t string, v long")).with_index(Index("byT", ("t",), ("-v",))).with_index(Index("vByT", ("t",), ("v",))))
    for source in ({"match": "a", "index": "byT"}, {"reverse": {"match": "a", "index": "byT"}}, {"union": [{"match": "a", "index": "vByT"}, {"match": "b", "index": "vByT"}]}):
        want = [r[0] for r in forms.evaluate(source, {}).ordered().rows()]
        seen, cursor = [], {}
        while True:
            page = forms.run({"paginate": source, "size": 2, **cursor})
            seen += page["data"]
            if "after" not in page:
                break
            cursor = {"after": {"quote": page["after"]}}
        assert seen == want
    back = forms.run({"paginate": {"match": "a", "index": "byT"}, "size": 3, "before": 0})
    assert back["data"] == [1, 1, 1] and back["before"]["at"][0] == 1
    more = forms.run({"paginate": {"match": "a", "index": "byT"}, "size": 3, "before": {"quote": back["before"]}})
    assert more["data"] == [2, 1][:1] + [1] or more["data"] == [2, 1]
    page = forms.run({"paginate": {"union": [{"match": "a", "index": "vByT"}, {"match": "b", "index": "vByT"}]}, "sources": True, "size": 100})
    assert [(x["value"], len(x["sources"])) for x in page["data"]][-1] == (2, 2)
    people.collections.pop("Num")


def test_form_writes(spark, tmp_path):
    """Documents, histories and definitions are made, changed and dropped by forms."""
    c = Catalog(spark)
    c.folder = str(tmp_path)
    run = Forms(spark, c).run
    run({"create_collection": {"object": {"name": "Acc", "fields": "owner string, balance long"}}})
    made = run({"create": {"collection": "Acc"}, "params": {"object": {"data": {"object": {"owner": "ann", "balance": 5}}}}})
    ref = {"quote": made["ref"]}
    assert made["data"] == {"owner": "ann", "balance": 5} and run({"exists": ref})
    assert run({"update": ref, "params": {"object": {"data": {"object": {"balance": 7}}}}})["data"] == {"owner": "ann", "balance": 7}
    assert run({"replace": ref, "params": {"object": {"data": {"object": {"owner": "bob"}}}}})["data"] == {"owner": "bob", "balance": None}
    run({"create_index": {"object": {"name": "byOwner", "source": {"collection": "Acc"}, "terms": [{"object": {"field": ["data", "owner"]}}], "values": [{"object": {"field": ["data", "balance"], "reverse": True}}]}}})
    assert run({"count": {"match": "bob", "index": "byOwner"}}) == 1 and c.collection("Acc").indexes["byOwner"].values == ("-balance",)
    run({"insert": ref, "ts": {"time": "2020-01-01T00:00:00Z"}, "action": "create", "params": {"object": {"data": {"object": {"owner": "old", "balance": 1}}}}})
    assert run({"paginate": {"documents": {"collection": "Acc"}}, "ts": "2020-06-01T00:00:00Z"})["data"] == [made["ref"].id]
    assert [x[1] for x in run({"paginate": ref, "events": True})["data"]] == ["create", "create", "update", "update"]
    run({"remove": ref, "ts": {"time": "2020-01-01T00:00:00Z"}, "action": "create"})
    assert run({"paginate": {"documents": {"collection": "Acc"}}, "ts": "2020-06-01T00:00:00Z"})["data"] == []
    assert run({"delete": ref})["data"]["owner"] == "bob" and not run({"exists": ref})
    with pytest.raises(FormError):
        run({"update": ref, "params": {}})
    run({"create_function": {"object": {"name": "inc", "body": {"lambda": "x", "expr": {"add": [{"var": "x"}, 1]}}}}})
    assert run({"call": {"function": "inc"}, "arguments": 4}) == 5
    for kind in ("role", "database", "access_provider"):
        run({f"create_{kind}": {"object": {"name": f"one_{kind}"}}})
        assert run({f"{kind}s": None}).df.count() == 1
    run({"move_database": {"database": "one_database"}, "to": {"database": "other"}})
    assert run({"update": {"role": "one_role"}, "params": {"object": {"note": "x"}}})["note"] == "x"
    run({"delete": {"role": "one_role"}})
    assert run({"roles": None}).df.count() == 0 and run({"indexes": None}).df.count() == 1
    with pytest.raises(FormError):
        run({"create_database": {"object": {"name": "one_database"}}})


def test_identity(people):
    forms = Forms(people.spark, people)
    run, ann = forms.run, {"ref": {"collection": "Person"}, "id": 1}
    people.identity.set_password(("Person", 1), "secret")
    assert run({"identify": ann, "password": "secret"}) is True and run({"identify": ann, "password": "no"}) is False
    with pytest.raises(FormError):
        run({"login": ann, "params": {"object": {"password": "no"}}})
    token = run({"login": ann, "params": {"object": {"password": "secret"}}})
    assert run({"has_current_identity": None}) is False
    people.identity.use(token["secret"])
    assert run({"has_identity": None}) and run({"current_identity": None}).id == 1 and run({"current_token": None}).id == token["ref"].id and run({"tokens": None}).df.count() == 1
    it = Interpreter(people.spark, people)
    assert it.run("Query.identity()!.name") == "Ann" and it.run("Query.token()") == token["ref"].id and it.run("Token.byDocument(Person(1))").data == [token["ref"].id]
    assert run({"logout": True}) is True and run({"has_current_token": None}) is False and it.run("Query.identity()") is None
    with pytest.raises(FormError):
        run({"current_identity": None})
    key = run({"create_key": {"object": {"name": "k1", "role": "admin"}}})
    assert run({"key_from_secret": key["secret"]})["role"] == "admin" and run({"keys": None}).df.count() == 1
    assert run({"issue_access_jwt": ann, "expire_in": 60}).count(".") == 2


def test_language_modules(people, caplog):
    it = Interpreter(people.spark, people)
    run = it.run
    page = run("Person.all().map(.id).pageSize(3)")
    assert page.data == [1, 2, 3] and run(f"Set.paginate('{page.after}')").data == [4]
    with pytest.raises(EvalError):
        run("Set.paginate('nothing')")
    assert run("Collection('Town').all().map(.name)").data == ["Ulm", "Bonn"] and run("Collection.all().map(.name)").data == ["Person", "Town"]
    assert run("Person.definition.indexes") == ["byName"] and run("Town.toString()") == "Town" and run("Town") == "Town"
    assert run("Schema.defForIdentifier('Town')") == {"kind": "collection", "name": "Town"} and run("Schema.defForIdentifier('x')") is None
    assert run("evalV4('{\"add\": [1, 2]}') + 1") == 4 and run("FQL.Math.max(2, 3)") == 3 and run("Query.isEnvProtected()") is False
    assert run("TransactionTime().year > 2000") is True and run("Person.all().any(.age > 35)") is True and run("[1, 2].map(x => x + Person.all().count())") == [5, 6]
    assert run("Math.sum(Set.sequence(0, 5))") == 10 and run("if (Person.all().isEmpty()) 1 else 2") == 2
    import logging

    with caplog.at_level(logging.INFO, "sheaf"):
        run("log('here', 1 + 1)")
    assert "here 2" in caplog.text
    with pytest.raises(EvalError):
        run("at (Time.now().add(3, 'days')) { 1 }")


def test_language_streams(spark):
    t = lambda k: dt.datetime(2024, 1, 1, k)
    rows = [(1, t(1), 1, "create", 40, "a"), (1, t(2), 2, "update", 41, "a"), (1, t(3), 3, "update", 42, "b"), (1, t(4), 4, "update", 43, "b"), (2, t(5), 5, "create", 42, "c"), (2, t(6), 6, "delete", 42, "c"), (1, t(7), 7, "update", 41, "b")]
    c = Catalog(spark)
    c.logs["Foo"] = log = spark.createDataFrame(rows, "id long, ts timestamp, ord long, action string, n long, s string")
    c.create(Collection("Foo", versions.as_of(log, F.current_timestamp(), tie="ord").drop("ts", "ord", "action")).with_index(Index("byS", ("s",), ("n",))))
    it = Interpreter(spark, c)
    events = lambda text: [(r["ord"], r["event_type"], r["data"]) for r in it.plan(text).orderBy("ord").collect()]
    want = [(2, "add", 41), (3, "update", 42), (4, "remove", 42), (5, "add", 42), (6, "remove", 42), (7, "add", 41)]
    assert events("Foo.where(f => f.n >= 41 && f.n < 43).map(.n).eventSource()") == want
    assert events("Foo.all().toStream().where(f => f.n >= 41 && f.n < 43).map(.n)") == want
    assert events("Foo.all().changesOn(.s).map(.s)") == [(1, "add", "a"), (3, "update", "b"), (5, "add", "c"), (6, "remove", "c")]
    assert events("Foo.byS('b').eventsOn(.n).map(.n)") == [(3, "add", 42), (4, "update", 43), (7, "update", 41)]
    page = it.run("Foo.all().eventSource()")
    assert len(page.data) == 7 and page.after
    for bad in ("Foo.byS('b').eventsOn(.id)", "Foo.all().distinct().eventSource()", "Foo.all().changesOn(f => f.n + 1)", "Set.sequence(1, 3).eventSource()", "Foo.all().eventSource().take(1)"):
        with pytest.raises((EvalError, ValueError)):
            it.plan(bad)


def test_staging_and_tasks(spark, tmp_path):
    from sheaf.sources import tasks
    from sheaf.sources.catalog import Migration

    c = Catalog(spark)
    c.create(Collection("Staged", spark.createDataFrame([(1, "b", 3), (2, "a", None)], "id long, n string, v int"), checks={"named": lambda d: d["n"].isNotNull()}))
    work = tasks.Staging(c)
    work.add_index("Staged", Index("byN", ("n",), ("v",)), 2)
    work.add_migration("Staged", Migration("backfill", "v", value=lambda d: F.lit(9)))
    assert not c.collection("Staged").indexes and work.status() == {"Staged": ("byN",)} and work.tables["Staged", "byN"].count() == 2
    work.commit()
    assert [r["v"] for r in c.collection("Staged").by_index("byN", "a").df.collect()] == [9]
    done = tasks.migrate(c.collection("Staged"), f"{tmp_path}/new")
    assert not done.migrations and sorted(r["v"] for r in done.df.collect()) == [3, 9]
    assert tasks.map_rows(done, lambda d: d.where("v > 3"), f"{tmp_path}/some").count() == 1
    work.drop_index("Staged", "byN")
    work.abort()
    assert "byN" in c.collection("Staged").indexes
    broken = tasks.Staging(c)
    c.create(Collection("Bad", spark.createDataFrame([(1, None)], "id long, n string"), checks={"named": lambda d: d["n"].isNotNull()}))
    broken.add_migration("Bad", Migration("add", "x", type="int"))
    with pytest.raises(ValueError):
        broken.commit()


def test_status_events(spark, tmp_path):
    spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "create", 5)], "id int, ts timestamp, action string, v int").write.parquet(f"{tmp_path}/log/0")
    stream = changes.stream(spark, f"{tmp_path}/log/*", "id int, ts timestamp, action string, v int")
    seen, told = [], []
    changes.subscribe(stream, lambda df, _: seen.extend(df.collect()), f"{tmp_path}/check", once=True, on_status=lambda df: told.extend(df.collect())).awaitTermination(120)
    assert len(seen) == 1 and {r["event_type"] for r in told} == {"status"} and told[0]["cursor"] == "0"

    def broken(df, _):
        raise KeyError("x")

    q = changes.subscribe(stream, broken, f"{tmp_path}/check2", once=True, on_status=lambda df: told.extend(df.collect()))
    with pytest.raises(Exception):
        q.awaitTermination(120)
    assert told[-1]["event_type"] == "error" and told[-1]["code"] == "KeyError"


def test_forms_of_results():
    value = {"a": [1, 2.5, None], "b c": 'x"y', "t": dt.datetime(2024, 1, 2, 3), "d": dt.date(2024, 1, 2), "r": b"ab", "ok": True}
    assert Y.decorated(value) == '{ a: [1, 2.5, null], "b c": "x\\"y", t: Time("2024-01-02T03:00:00Z"), d: Date("2024-01-02"), r: Bytes("YWI="), ok: true }'
    assert Y.v4_value({"t": dt.datetime(2024, 1, 2, 3), "x": [dt.date(2024, 1, 2), b"ab"], "@k": 1}) == {"@obj": {"t": {"@ts": "2024-01-02T03:00:00Z"}, "x": [{"@date": "2024-01-02"}, {"@bytes": "YWI="}], "@k": 1}}
    from sheaf.plans.json_forms import Ref

    assert Y.v4_value(Ref("Person", 3)) == {"@ref": {"id": "3", "collection": "Person"}}
