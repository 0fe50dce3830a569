"""The JSON expression language: each form is an object whose first key names the function.

Scalars become Columns, sets are DataFrames of index values (see ``Elements``). Writes of documents append
versions to the collection's store; collections, indexes, functions, roles, databases and keys are entries of
the catalog.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions import arrays as A
from sheaf.functions import dates as D
from sheaf.functions import numbers as N
from sheaf.functions import strings as S
from sheaf.functions import types as Y
from sheaf.operators import setops as X
from sheaf.operators.ordered import Key, Ordered, keys_of
from sheaf.sources.catalog import Catalog, Index


SCHEMA_KINDS = frozenset("collection database index function key token credentials role access_provider".split())


class FormError(ValueError):
    pass


@dataclass(frozen=True)
class Elements:
    """A set: its value columns, and the keys that order it; by default the values, ascending."""

    df: DataFrame
    values: tuple[str, ...]
    keys: tuple[Key, ...] | None = None
    log: DataFrame | None = None  # versions (id, ts, action, ...) of the documents, where the set can tell its events

    def ordered(self) -> Ordered:
        keys = keys_of(*self.values) if self.keys is None else self.keys
        return Ordered(self.df.select(*dict.fromkeys([*self.values, *(k for k, _ in keys)])), keys)

    def but(self, df: DataFrame) -> Elements:
        return replace(self, df=df)


@dataclass(frozen=True)
class Ref:
    collection: str
    id: Any


class Named(str):
    """The name of a part of the schema, and what it names."""

    kind: str

    def __new__(cls, kind: str, name: str):
        out = super().__new__(cls, name)
        out.kind = kind
        return out


class Document(dict):
    """A document that was read."""


class Uuid(str):
    pass


def _many(x: Any) -> list:
    return x if isinstance(x, list) else [x]


def _c(x: Any) -> Column:
    if isinstance(x, list):
        return F.array(*map(_c, x))
    if isinstance(x, dict):
        return F.struct(*[_c(v).alias(k) for k, v in x.items()])
    return x if isinstance(x, Column) else F.lit(x)


def _chain(f: Callable) -> Callable:
    return lambda xs: N.chain(f, *map(_c, _many(xs)))


def _compare(f: Callable) -> Callable:
    return lambda xs: N.increasing(f, *map(_c, _many(xs)))


#: One argument, or several under the first key alone.
SIMPLE: dict[str, Callable] = {
    "abs": lambda x: N.abs_(_c(x)), "acos": lambda x: N.acos(_c(x)), "asin": lambda x: N.asin(_c(x)), "atan": lambda x: N.atan(_c(x)), "ceil": lambda x: N.ceil(_c(x)), "floor": lambda x: N.floor(_c(x)),
    "cos": lambda x: N.cos(_c(x)), "cosh": lambda x: N.cosh(_c(x)), "degrees": lambda x: N.degrees(_c(x)), "exp": lambda x: N.exp(_c(x)), "ln": lambda x: N.log(_c(x)), "log": lambda x: N.log10(_c(x)),
    "radians": lambda x: N.radians(_c(x)), "sign": lambda x: N.sign(_c(x)), "sin": lambda x: N.sin(_c(x)), "sinh": lambda x: N.sinh(_c(x)), "sqrt": lambda x: N.sqrt(_c(x)), "tan": lambda x: N.tan(_c(x)),
    "tanh": lambda x: N.tanh(_c(x)), "bitnot": lambda x: N.bit_not(_c(x)), "bitand": _chain(N.bit_and), "bitor": _chain(N.bit_or), "bitxor": _chain(N.bit_xor),
    "add": _chain(lambda a, b: a + b), "subtract": _chain(lambda a, b: a - b), "multiply": _chain(lambda a, b: a * b), "divide": _chain(N.divide_int), "modulo": _chain(N.modulo),
    "and": lambda xs: reduce(lambda a, b: a & b, map(_c, _many(xs))), "or": lambda xs: reduce(lambda a, b: a | b, map(_c, _many(xs))), "not": lambda x: ~_c(x),
    "equals": _compare(N.equal), "lt": _compare(N.less), "lte": _compare(N.less_or_equal), "gt": _compare(N.greater), "gte": _compare(N.greater_or_equal),
    "length": lambda x: S.length(_c(x)), "lowercase": lambda x: S.to_lower_case(_c(x)), "uppercase": lambda x: S.to_upper_case(_c(x)), "titlecase": lambda x: S.title_case(_c(x)), "trim": lambda x: S.trim(_c(x)),
    "ltrim": lambda x: S.ltrim(_c(x)), "rtrim": lambda x: S.rtrim(_c(x)), "space": lambda x: S.space(_c(x)),
    "time": lambda x: F.current_timestamp() if x == "now" else D.parse(_c(x)), "now": lambda _: F.current_timestamp(), "date": lambda x: D.date_parse(_c(x)),
    "to_micros": lambda x: D.to_micros(_c(x)), "to_millis": lambda x: D.to_millis(_c(x)), "to_seconds": lambda x: D.to_seconds(_c(x)), "second": lambda x: D.second(_c(x)), "minute": lambda x: D.minute(_c(x)),
    "hour": lambda x: D.hour(_c(x)), "day_of_month": lambda x: D.day_of_month(_c(x)), "day_of_week": lambda x: D.day_of_week(_c(x)), "day_of_year": lambda x: D.day_of_year(_c(x)), "month": lambda x: D.month(_c(x)), "year": lambda x: D.year(_c(x)),
    "to_string": lambda x: Y.to_string(_c(x)), "to_number": lambda x: Y.to_number(_c(x)), "to_double": lambda x: Y.to_double(_c(x)), "to_integer": lambda x: Y.to_integer(_c(x)), "to_time": lambda x: Y.to_time(_c(x), "integer" if isinstance(x, int) else "string"), "to_date": lambda x: Y.to_date(_c(x)),
    "abort": lambda x: Y.abort(_c(x)), "next_id": lambda _: Y.new_id(), "new_id": lambda _: Y.new_id(), "is_null": lambda x: _c(x).isNull(),
}

#: The first key's argument, then those of the further keys; a tuple gives a default.
KEYED: dict[str, tuple[tuple, Callable]] = {
    "hypot": ((("b", None),), lambda a, b: N.hypot(_c(a), None if b is None else _c(b))), "pow": ((("exp", 2),), lambda a, b: N.power(_c(a), _c(b))),
    "round": ((("precision", 2),), lambda x, p: N.round_(_c(x), p)), "trunc": ((("precision", 2),), lambda x, p: N.trunc(_c(x), p)),
    "concat": ((("separator", ""),), lambda xs, s: F.concat_ws(s, *map(_c, _many(xs)))), "casefold": ((("normalizer", "NFKCCaseFold"),), lambda x, n: S.casefold(_c(x), n)),
    "startswith": (("search",), lambda x, t: S.starts_with(_c(x), _c(t))), "endswith": (("search",), lambda x, t: S.ends_with(_c(x), _c(t))), "containsstr": (("search",), lambda x, t: S.includes(_c(x), _c(t))),
    "containsstrregex": (("pattern",), lambda x, r: S.includes_regex(_c(x), r)), "regexescape": ((), lambda x: F.concat(F.lit("\\Q"), _c(x), F.lit("\\E"))),
    "findstr": (("find", ("start", 0)), lambda x, t, s: S.find_str(_c(x), _c(t), _c(s))), "findstrregex": (("pattern", ("start", 0)), lambda x, r, s: S.match_indexes(S.slice_(_c(x), s), r)),
    "repeat": ((("number", 2),), lambda x, n: S.repeat(_c(x), _c(n))), "replacestr": (("find", "replace"), lambda x, f, r: S.replace_all(_c(x), _c(f), _c(r))),
    "replacestrregex": (("pattern", "replace", ("first", False)), lambda x, p, r, f: S.replace_groups(_c(x), p, r, f)), "substring": ((("start", 0), ("length", None)), lambda x, s, n: S.substring(_c(x), _c(s), n)),
    "ngram": ((("min", 1), ("max", 2)), lambda x, a, b: F.flatten(F.array(*[S.ngram(_c(t), a, b) for t in _many(x)]))), "format": (("values",), lambda p, v: S.format_(p, *map(_c, _many(v)))),
    "split_str": (("token", ("count", -1)), lambda x, t, n: S.split_count(_c(x), _c(t), n)), "split_str_regex": (("pattern", ("count", -1)), lambda x, r, n: S.split_regex(_c(x), r, n)),
    "epoch": (("unit",), lambda x, u: D.epoch(_c(x), u)), "time_add": (("offset", "unit"), lambda t, n, u: D.add(_c(t), n, u)), "time_subtract": (("offset", "unit"), lambda t, n, u: D.subtract(_c(t), n, u)),
    "time_diff": (("other", "unit"), lambda a, b, u: D.difference(_c(b), _c(a), u)),
    "prepend": (("collection",), lambda xs, c: F.concat(_c(_many(xs)), _c(c))), "append": (("collection",), lambda xs, c: F.concat(_c(c), _c(_many(xs)))),
}
ALIASES = {
    "contains_str": "containsstr", "contains_str_regex": "containsstrregex", "find_str": "findstr", "find_str_regex": "findstrregex", "lower_case": "lowercase", "upper_case": "uppercase", "title_case": "titlecase",
    "l_trim": "ltrim", "r_trim": "rtrim", "replace_str": "replacestr", "replace_str_regex": "replacestrregex", "sub_string": "substring", "starts_with": "startswith", "ends_with": "endswith", "regex_escape": "regexescape",
    "bit_and": "bitand", "bit_or": "bitor", "bit_xor": "bitxor", "bit_not": "bitnot", "contains": "contains_path", "classes": "collections", "class": "collection",
}


class Forms:
    def __init__(self, spark: SparkSession, catalog: Catalog):
        self.spark, self.catalog = spark, catalog

    def run(self, form: Any) -> Any:
        """Scalars as values; sets as they are, not read."""
        return self.plain(self.evaluate(form, {}))

    def plain(self, out: Any) -> Any:
        """A result with all Columns in it read, in one job."""
        columns: list[Column] = []

        def find(x: Any) -> None:
            if isinstance(x, Column):
                columns.append(x)
            elif isinstance(x, dict):
                for v in x.values():
                    find(v)
            elif isinstance(x, list):
                for v in x:
                    find(v)

        find(out)
        if not columns:
            return out
        found = iter(self.spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())

        def put(x: Any) -> Any:
            if isinstance(x, Column):
                return Y.simple(next(found))
            if isinstance(x, dict):
                return type(x)({k: put(v) for k, v in x.items()})
            return [put(v) for v in x] if isinstance(x, list) else x

        return put(out)

    def evaluate(self, form: Any, env: dict) -> Any:
        if isinstance(form, list):
            return [self.evaluate(x, env) for x in form]
        if not isinstance(form, dict):
            return form
        if not form:
            return {}
        name = next(iter(form))
        name = ALIASES.get(name, name)
        if (f := getattr(self, f"form_{name}", None)) is not None:
            return f(form, env)
        first, rest = next(iter(form.values())), form
        if name.startswith("is_"):
            return self.type_test(name[3:], self.evaluate(first, env))
        if name in SIMPLE:
            return SIMPLE[name](self.evaluate(first, env))
        if name in KEYED:
            keys, f = KEYED[name]
            args = []
            for k in keys:
                k, default = k if isinstance(k, tuple) else (k, ...)
                if k not in rest and default is ...:
                    raise FormError(f"{name} needs {k}")
                args.append(self.evaluate(rest[k], env) if k in rest else default)
            return f(self.evaluate(first, env), *args)
        raise FormError(f"no form {name}")

    def args(self, form: dict, env: dict, *keys: str) -> list:
        return [self.evaluate(form[k], env) if k in form else None for k in keys]

    # literals

    def form_object(self, form, env):
        return {k: self.evaluate(v, env) for k, v in form["object"].items()}

    form_quote = lambda self, form, env: form["quote"]

    def evaluate_literal(self, kind: str, value: Any) -> Any:
        return {"@ts": lambda: D.parse(F.lit(value)), "@date": lambda: D.date_parse(F.lit(value)), "@bytes": lambda: F.unbase64(F.lit(value)), "@uuid": lambda: Uuid(value), "@ref": lambda: Ref(value["collection"], value["id"]), "@set": lambda: self.evaluate(value, {}), "@int": lambda: int(value), "@long": lambda: int(value), "@double": lambda: float(value), "@obj": lambda: value}[kind]()

    def __getattr__(self, name: str):
        if name.startswith("form_@"):
            kind = name[5:]
            return lambda form, env: self.evaluate_literal(kind, form[kind])
        raise AttributeError(name)

    # control

    def form_let(self, form, env):
        env = dict(env)
        for part in _many(form["let"]):
            for k, v in part.items():
                env[k] = self.evaluate(v, env)
        return self.evaluate(form["in"], env)

    def form_var(self, form, env):
        return env[form["var"]]

    def form_if(self, form, env):
        test = self.evaluate(form["if"], env)
        if isinstance(test, bool):
            return self.evaluate(form["then" if test else "else"], env)
        return F.when(test, _c(self.evaluate(form["then"], env))).otherwise(_c(self.evaluate(form["else"], env)))

    def form_do(self, form, env):
        return self.evaluate(form["do"], env)[-1]

    def form_lambda(self, form, env):
        names = form["lambda"]

        def call(*args):
            if isinstance(names, str):
                return self.evaluate(form["expr"], {**env, names: args[0] if len(args) == 1 else list(args)})
            values = list(args) if len(args) == len(names) else [A.at(args[0], k) if isinstance(args[0], Column) else args[0][k] for k in range(len(names))]
            return self.evaluate(form["expr"], {**env, **dict(zip(names, values))})

        return call

    form_query = lambda self, form, env: self.evaluate(form["query"], env)

    def form_call(self, form, env):
        f = form["call"]
        f = f["function"] if isinstance(f, dict) else f
        return self.catalog.call(f, *_many(self.evaluate(form.get("arguments", []), env)))

    # arrays, pages and sets

    def form_map(self, form, env):
        f, c = self.evaluate(form["map"], env), self.evaluate(form["collection"], env)
        if isinstance(c, Elements):
            row = [F.col(v) for v in c.values]
            out = f(*row)
            o = c.ordered()
            kept = [F.col(k).alias(f"_k{n}") for n, (k, _) in enumerate(o.keys)]
            return Elements(c.df.select(_c(out).alias("value"), *kept), ("value",), tuple((f"_k{n}", up) for n, (_, up) in enumerate(o.keys)))
        return [f(x) for x in c] if isinstance(c, list) else A.map_(c, lambda x: _c(f(x)))

    def form_foreach(self, form, env):
        self.form_map({"map": form["foreach"], "collection": form["collection"]}, env)
        return self.evaluate(form["collection"], env)

    def form_filter(self, form, env):
        f, c = self.evaluate(form["filter"], env), self.evaluate(form["collection"], env)
        if isinstance(c, Elements):
            return c.but(c.df.where(f(*[F.col(v) for v in c.values])))
        return A.filter_(_c(c), lambda x: f(x))

    def form_reduce(self, form, env):
        f, seed, c = self.evaluate(form["reduce"], env), self.evaluate(form["initial"], env), self.evaluate(form["collection"], env)
        if isinstance(c, Elements):
            try:
                return self.folded(f, _c(seed), c)
            except AnalysisException:  # the lambda reads a row around it, so the array must stand there
                c = [r[0] if len(c.values) == 1 else list(r) for r in c.ordered().rows()]
        return A.fold(_c(c), _c(seed), lambda a, x: _c(f(a, x)))

    def folded(self, f: Callable, seed: Column, c: Elements) -> Column:
        """A fold over a set of any size: a slice of the sorted rows at a time where they are, each fold going on from the last one's
        value. Only that value comes to the driver."""
        o = c.ordered()
        x = F.col(c.values[0]) if len(c.values) == 1 else F.array(*c.values)
        element, one = o.df.select(x.alias("x")).schema["x"].dataType, self.spark.range(1)
        held = one.select(seed.alias("a")).schema["a"].dataType
        for _ in range(2):  # the value may be wider than the seed
            held = one.select(F.lit(None).cast(held).alias("a"), F.lit(None).cast(element).alias("x")).select(_c(f(F.col("a"), F.col("x"))).alias("a")).schema["a"].dataType
        value = one.select(seed.cast(held).alias("a")).first()["a"]
        step = A.fold(F.col("v"), F.col("a"), lambda a, e: _c(f(a, e["x"])).cast(held))
        for part in o.slices({"x": x}):
            last = self.spark.createDataFrame([(value,)], T.StructType([T.StructField("a", held)]))
            part = part.crossJoin(last) if isinstance(value, (Row, list, dict)) else part.withColumn("a", F.lit(value).cast(held))
            value = part.select(step.alias("a")).first()["a"]
        return _c(value.asDict(True) if isinstance(value, Row) else value).cast(held)

    def _sized(self, name: str, signed: Callable, form, env):
        n, c = self.evaluate(form[name], env), self.evaluate(form["collection"], env)
        if isinstance(c, Elements):
            return c.but(getattr(c.ordered(), name)(n).df)
        return signed(_c(c), n)

    form_take = lambda self, form, env: self._sized("take", A.take_signed, form, env)
    form_drop = lambda self, form, env: self._sized("drop", A.drop_signed, form, env)

    def _test(self, name: str, form, env):
        c = self.evaluate(form[name], env)
        if isinstance(c, Elements):
            return c.df.limit(1).count() == 0
        return F.size(_c(c)) == 0

    form_is_empty = lambda self, form, env: self._test("is_empty", form, env)

    def form_is_nonempty(self, form, env):
        t = self._test("is_nonempty", form, env)
        return not t if isinstance(t, bool) else ~t

    def _folded(self, name: str, of_array: Callable, of_set: Callable, form, env):
        c = self.evaluate(form[name], env)
        if isinstance(c, Elements):
            return c.df.agg(of_set(c.values[0]).alias("v")).first()["v"]
        return of_array(_c(c))

    form_count = lambda self, form, env: self._folded("count", A.count, lambda _: F.count(F.lit(1)), form, env)
    form_sum = lambda self, form, env: self._folded("sum", A.sum_, N.sum_of, form, env)
    form_mean = lambda self, form, env: self._folded("mean", A.mean, N.mean_of, form, env)
    form_max = lambda self, form, env: self._folded("max", A.max_, F.max, form, env)
    form_min = lambda self, form, env: self._folded("min", A.min_, F.min, form, env)
    form_any = lambda self, form, env: self._folded("any", A.any_true, N.any_of, form, env)
    form_all = lambda self, form, env: self._folded("all", A.all_true, N.every_of, form, env)

    # objects

    def _path(self, path: list, value: Any) -> Any:
        for p in path:
            if isinstance(value, Column):
                value = A.first(A.drop(value, p)) if isinstance(p, int) else value.getField(p)
            elif isinstance(value, dict):
                value = value.get(p)
            elif isinstance(value, list) and isinstance(p, int):
                value = value[p] if p < len(value) else None
            else:
                return None
        return value

    def form_select(self, form, env):
        found = self._path(_many(self.evaluate(form["select"], env)), self.evaluate(form["from"], env))
        if "default" in form:
            default = self.evaluate(form["default"], env)
            return F.coalesce(found, _c(default)) if isinstance(found, Column) else default if found is None else found
        if found is None:
            raise FormError("value not found at path")
        return found

    def form_select_all(self, form, env):
        path, value = _many(self.evaluate(form["select_all"], env)), self.evaluate(form["from"], env)
        return [x for x in (self._path(path, v) for v in value) if x is not None] if isinstance(value, list) else A.map_(value, lambda x: self._path(path, x))

    def form_contains_path(self, form, env):
        found = self._path(_many(self.evaluate(form[next(iter(form))], env)), self.evaluate(form["in"], env))
        return found.isNotNull() if isinstance(found, Column) else found is not None

    def form_contains_field(self, form, env):
        return self.form_contains_path({"contains_path": form["contains_field"], "in": form["in"]}, env)

    def form_contains_value(self, form, env):
        value, c = self.evaluate(form["contains_value"], env), self.evaluate(form["in"], env)
        return A.includes(_c(list(c.values()) if isinstance(c, dict) else c), _c(value))

    def form_merge(self, form, env):
        out, others = dict(self.evaluate(form["merge"], env)), _many(self.evaluate(form["with"], env))
        f = self.evaluate(form["lambda"], env) if "lambda" in form else None
        for other in others:
            for k in [*out, *(x for x in other if x not in out)]:
                value = f(k, out.get(k), other.get(k)) if f else other.get(k, out.get(k)) if k in other else out[k]
                out[k] = value
            out = {k: v for k, v in out.items() if v is not None}
        return out

    def form_to_object(self, form, env):
        return {k: v for k, v in self.evaluate(form["to_object"], env)}

    def form_to_array(self, form, env):
        return [[k, v] for k, v in self.evaluate(form["to_array"], env).items()]

    def type_test(self, name: str, v: Any) -> Any:
        kinds = {"number": (int, float), "double": float, "integer": int, "boolean": bool, "array": list, "object": dict, "ref": (Ref, Named), "set": Elements, "lambda": type(lambda: 0), "doc": Document, "uuid": Uuid}
        if isinstance(v, Column):
            if name == "null":
                return v.isNull()
            names = {"number": "bigint|int|double|float|smallint|tinyint|decimal.*", "double": "double|float", "integer": "bigint|int|smallint|tinyint", "boolean": "boolean", "string": "string", "array": "array.*", "object": "struct.*|map.*", "bytes": "binary", "timestamp": "timestamp.*", "date": "date"}
            return F.typeof(v).rlike(f"^({names[name]})$") & v.isNotNull() if name in names else F.lit(False)
        if name == "null":
            return v is None
        if name == "string":
            return isinstance(v, str) and not isinstance(v, (Named, Uuid))
        if name in SCHEMA_KINDS:  # a name of such a part, or a reference to a document of such a kind
            return isinstance(v, Named) and v.kind == name or isinstance(v, Ref) and v.collection == {"key": "keys", "token": "tokens"}.get(name, name)
        return isinstance(v, kinds.get(name, ())) and not (name in ("number", "integer") and isinstance(v, bool))

    # refs and sets

    def form_ref(self, form, env):
        c, i = self.args(form, env, "ref", "id")
        return Ref(c, i)

    def _named(kind: str):  # noqa: N805
        def named(self, form, env):
            return Named(kind, self.evaluate(next(iter(form.values())), env))

        return named

    form_collection, form_index, form_function, form_role, form_database, form_access_provider = map(_named, ("collection", "index", "function", "role", "database", "access_provider"))

    def _listed(kind: str):  # noqa: N805
        def listed(self, form, env):
            return Elements(self.catalog.listing().where(F.col("kind") == kind).select("name"), ("name",))

        return listed

    form_collections, form_indexes, form_functions, form_roles, form_databases, form_keys, form_tokens, form_credentials, form_access_providers = map(
        _listed, ("collection", "index", "function", "role", "database", "key", "token", "credentials", "access_provider")
    )

    def form_documents(self, form, env):
        c = self.catalog.collection(self.evaluate(form["documents"], env))
        return Elements(c.rows, (c.id,), log=self.catalog.log(c.name))

    def form_singleton(self, form, env):
        r = self.evaluate(form["singleton"], env)
        c = self.catalog.collection(r.collection)
        log = self.catalog.log(c.name)
        return Elements(c.by_id(r.id), (c.id,), log=None if log is None else log.where(F.col("id") == r.id))

    def _index(self, name: str):
        for c in self.catalog.collections.values():
            if name in c.indexes:
                return c, c.indexes[name]
        raise FormError(f"no index {name}")

    def form_match(self, form, env):
        c, index = self._index(self.evaluate(form["index"], env) if "index" in form else self.evaluate(form["match"], env))
        terms = _many(self.evaluate(form["terms"] if "terms" in form else form["match"], env)) if index.terms else []
        df, log = index.entries(c.rows, c.id), self.catalog.log(c.name)
        for t, v in zip(index.terms, terms, strict=True):
            df = df.where(F.col(t) == _c(v))
            if log is not None:
                log = log.where(F.array_contains(t, _c(v)) if t in index.multi else F.col(t) == _c(v)) if t in log.columns else None
        # entries are ordered by their values in the index's directions, then by the document
        values = tuple(v.lstrip("-") for v in index.values) or (c.id,)
        return Elements(df, values, (*keys_of(*(index.values or (c.id,))), *(() if c.id in values else keys_of(c.id))), log)

    def _sets(self, name: str, of_sets: Callable, of_arrays: Callable, form, env):
        parts = _many(self.evaluate(form[name], env))
        if isinstance(parts[0], Elements):
            frames = [p.df.select(*[F.col(v).alias(f"v{k}") for k, v in enumerate(p.values)]) for p in parts]
            return Elements(of_sets(*frames), tuple(frames[0].columns))
        return of_arrays(*map(_c, parts))

    form_union = lambda self, form, env: self._sets("union", X.union_max, A.union_max, form, env)
    form_intersection = lambda self, form, env: self._sets("intersection", X.intersection_min, A.intersection_min, form, env)
    form_difference = lambda self, form, env: self._sets("difference", X.difference, A.difference, form, env)

    def form_distinct(self, form, env):
        c = self.evaluate(form["distinct"], env)
        return Elements(c.df.select(*c.values).distinct(), c.values) if isinstance(c, Elements) else A.distinct(_c(c))

    def form_join(self, form, env):
        """Elements that the target yields for any element of the source, each once.

        A lambda's body may be a match, whose terms are any expression of the source's values, and unions, let and distinct of
        such; it becomes one join on the terms.
        """
        source, target = self.evaluate(form["join"], env), form["with"]
        if isinstance(target, dict) and "lambda" in target:
            names = target["lambda"]
            df = source.df.select(*[F.col(v).alias(f"_s{k}") for k, v in enumerate(source.values)])
            own = [F.col(f"_s{k}") for k in range(len(source.values))]
            bound = {names: own[0] if len(own) == 1 else own} if isinstance(names, str) else dict(zip(names, own, strict=True))
            return self._joined(df, target["expr"], {**env, **bound})
        c, index = self._index(self.evaluate(target, env))
        return self._entries_of(source.df.select(*[F.col(v).alias(t) for v, t in zip(source.values, index.terms)]), c, index)

    def _entries_of(self, terms: DataFrame, c, index) -> Elements:
        values = tuple(v.lstrip("-") for v in index.values) or (c.id,)
        return Elements(X.index_join(terms, index.entries(c.rows, c.id), list(index.terms), list(values)), values, keys_of(*(index.values or (c.id,))))

    def _joined(self, source: DataFrame, body: Any, env: dict) -> Elements:
        name = next(iter(body))
        if name == "let":
            env = dict(env)
            for part in _many(body["let"]):
                env |= {k: self.evaluate(v, env) for k, v in part.items()}
            return self._joined(source, body["in"], env)
        if name == "distinct":
            return self._joined(source, body["distinct"], env)
        if name == "union":
            parts = [self._joined(source, x, env) for x in _many(body["union"])]
            frames = [p.df.select(*[F.col(v).alias(f"v{k}") for k, v in enumerate(p.values)]) for p in parts]
            return Elements(reduce(DataFrame.unionByName, frames).distinct(), tuple(frames[0].columns))
        if name != "match":
            raise FormError(f"a join's lambda cannot have {name}")
        c, index = self._index(self.evaluate(body["index"], env) if "index" in body else self.evaluate(body["match"], env))
        terms = _many(self.evaluate(body["terms"] if "terms" in body else body["match"], env))
        return self._entries_of(source.select(*[_c(v).alias(t) for t, v in zip(index.terms, terms, strict=True)]), c, index)

    def form_range(self, form, env):
        """Between two prefixes of values in the set's order, both included; of a reversed set, from is the greater one."""
        c, low, high = self.args(form, env, "range", "from", "to")
        as_tuple = lambda x: tuple(x) if isinstance(x, list) else () if x is None else (x,)
        return c.but(c.ordered().range(as_tuple(low), as_tuple(high)).df)

    def form_reverse(self, form, env):
        c = self.evaluate(form["reverse"], env)
        if isinstance(c, Elements):
            return replace(c, keys=c.ordered().reverse().keys)
        return A.reverse(_c(c))

    def form_events(self, form, env):
        """The versions of a document, or of a set's documents, as a set of (ts, action, document); for paginate."""
        c = self.evaluate(form["events"], env)
        if isinstance(c, Ref):
            c = self.form_singleton({"singleton": {"quote": c}}, env)
        return self._events(c)

    def _events(self, c: Elements) -> Elements:
        if c.log is None:
            raise FormError("no log tells the events of this set")
        return Elements(c.log.select("ts", "action", F.col("id").alias("document")), ("ts", "action", "document"))

    def form_exists(self, form, env):
        c = self.evaluate(form["exists"], env)
        if isinstance(c, Ref):
            return self.catalog.collection(c.collection).by_id(c.id).limit(1).count() > 0
        return c.df.limit(1).count() > 0

    def _end(self, name: str, form, env):
        c = self.evaluate(form[name], env)
        if isinstance(c, Ref):
            rows = self.catalog.collection(c.collection).by_id(c.id).take(1)
            if not rows:
                raise FormError("instance not found")
            return Document(rows[0].asDict())
        if isinstance(c, Elements):
            o = c.ordered()
            rows = (o.last() if name == "last" else o.first()).select(*c.values).collect()
            if not rows:
                raise FormError("the set is empty")
            return rows[0][0] if len(c.values) == 1 else list(rows[0])
        a = _c(c)
        return F.when(F.size(a) > 0, A.last(a) if name == "last" else A.first(a)).otherwise(F.raise_error(F.lit("the array is empty")))

    form_get = lambda self, form, env: self._end("get", form, env)
    form_first = lambda self, form, env: self._end("first", form, env)
    form_last = lambda self, form, env: self._end("last", form, env)

    def form_paginate(self, form, env):
        """Forward from after, which is included; backward from before, which is not; 64 elements, in the set's order.

        A cursor is the next element. Where the page ends among equal elements, or the order has other keys, it is {"at", "skip"}: the
        element's keys, and how many of its like came before. cursor: a cursor under the name of its direction. ts: documents as of then. events: versions instead of
        elements. sources: each element with the sets of a union, intersection or difference that hold it.
        """
        if "ts" in form:
            at = self.evaluate(form["ts"], env)
            seen = Forms(self.spark, self.catalog.as_of(D.parse(F.lit(at)) if isinstance(at, str) else F.timestamp_micros(F.lit(at)) if isinstance(at, int) else at))
            return seen.form_paginate({k: v for k, v in form.items() if k != "ts"}, env)
        inner = form["paginate"]
        c, size, after, before = self.args(form, env, "paginate", "size", "after", "before")
        if "cursor" in form:
            cursor = self.evaluate(form["cursor"], env)
            after, before = (cursor.get("after"), cursor.get("before")) if isinstance(cursor, dict) and cursor.keys() & {"after", "before"} else (cursor, None)
        if isinstance(c, Ref):
            c = self.form_singleton({"singleton": {"quote": c}}, env)
        if isinstance(c, (list, Column)):
            return {"data": c}
        if form.get("events"):
            c = self._events(c)
        held = None
        if form.get("sources"):
            parts = _many(inner[next(iter(inner))]) if next(iter(inner)) in ("union", "intersection", "difference") else [inner]
            sets = [self.evaluate(p, env) for p in parts]
            frames = {str(k): p.df.select(*[F.col(v).alias(w) for v, w in zip(p.values, c.values)]) for k, p in enumerate(sets)}
            held = X.sources(**frames)
        size, o = size or 64, c.ordered()
        flat = lambda r: r[c.values[0]] if len(c.values) == 1 else [r[v] for v in c.values]
        place = lambda r: [r[k] for k, _ in o.keys]
        by_value = [k for k, _ in o.keys][: len(c.values)] == list(c.values)
        opened = lambda x: (tuple(x["at"]), x["skip"]) if isinstance(x, dict) and "at" in x else (tuple(_many(x)), 0)

        def cursor_of(row: Row, passed: list[Row], at: tuple, skip: int) -> Any:
            """The row's value, if that tells it from all rows passed; else its keys, and how many of its like were passed."""
            if by_value and all(flat(r) != flat(row) for r in passed):
                return flat(row)
            return {"at": place(row), "skip": sum(place(r) == place(row) for r in passed) + (skip if place(row) == list(at) else 0)}

        if before is not None:
            at, skip = opened(before)
            rows = o.before(at).take(size + 1).df.collect() if not skip else [*o.range(at, at).take(skip).reverse().df.collect(), *o.before(at).take(size + 1).df.collect()]
            page = {"data": [flat(r) for r in reversed(rows[:size])], "after": before}
            if len(rows) > size:
                alike = sum(place(r) == place(rows[size - 1]) for r in rows[size:])
                whole = by_value and flat(rows[size]) != flat(rows[size - 1])
                page["before"] = flat(rows[size - 1]) if whole else {"at": place(rows[size - 1]), "skip": alike}
        else:
            at, skip = opened(after) if after is not None else ((), 0)
            rows = (o.after(at, inclusive=True) if after is not None else o).take(size + 1 + skip).df.collect()[skip:]
            page = {"data": [flat(r) for r in rows[:size]]}
            if len(rows) > size:
                page["after"] = cursor_of(rows[size], rows[:size], at, skip)
            if after is not None:
                page["before"] = after
        if held is not None:
            names = {tuple(_many(flat(r))): r["sources"] for r in held.join(F.broadcast(self.spark.createDataFrame([tuple(_many(x)) for x in page["data"]], held.select(*c.values).schema)), list(c.values), "left_semi").collect()} if page["data"] else {}
            page["data"] = [{"value": x, "sources": [parts[int(k)] for k in names[tuple(_many(x))]]} for x in page["data"]]
        return page

    # writes

    def _store(self, name: str):
        if name not in self.catalog.stores:
            raise FormError(f"{name} has no store to write to")
        return self.catalog.stores[name]

    def _params(self, form: dict, env: dict, id_: Any = None) -> DataFrame:
        data = self.evaluate(form["params"], env) if "params" in form else {}
        data = data.get("data", {}) if isinstance(data, dict) else data
        return self.spark.range(1).select(*([] if id_ is None else [F.lit(id_).cast("long").alias("id")]), *[_c(v).alias(k) for k, v in data.items()])

    def _fresh(self, name: str, id_: Any = None) -> Any:
        """The collection as it is after a write, and one of its documents."""
        c = self.catalog.create(replace(self.catalog.collection(name), df=self._store(name).rows(), id="id"))
        rows = c.by_id(id_).take(1) if id_ is not None else []
        return Document({"ref": Ref(name, id_), "data": {k: v for k, v in rows[0].asDict().items() if k != "id"}}) if rows else None

    def form_create(self, form, env):
        target = self.evaluate(form["create"], env)
        name, id_ = (target.collection, target.id) if isinstance(target, Ref) else (str(target), None)
        store = self._store(name)
        id_ = store.next_id() if id_ is None else id_
        store.create(self._params(form, env, id_))
        return self._fresh(name, id_)

    def _changed(self, action: str, form, env):
        r = self.evaluate(form[action], env)
        if isinstance(r, Named):
            return self._defined(action, r, form, env)
        store = self._store(r.collection)
        if not self._fresh(r.collection, r.id):
            raise FormError("instance not found")
        rows = self._params(form, env, r.id)
        if action == "update":
            data = self.evaluate(form.get("params", {}), env).get("data", {})
            store.update(rows, clear=tuple(k for k, v in data.items() if v is None))
        else:
            getattr(store, action)(rows)
        return self._fresh(r.collection, r.id)

    form_update = lambda self, form, env: self._changed("update", form, env)
    form_replace = lambda self, form, env: self._changed("replace", form, env)

    def form_delete(self, form, env):
        r = self.evaluate(form["delete"], env)
        if isinstance(r, Named):
            return self.catalog.forget(r.kind, str(r))
        was = self._fresh(r.collection, r.id)
        self._changed("delete", form, env)
        return was

    def form_insert(self, form, env):
        """A version put into the history of a document, in place of one of that time and action."""
        r, at, action = self.args(form, env, "insert", "ts", "action")
        store = self._store(r.collection)
        store.put(self._params(form, env, r.id), _c(at), action)
        self._fresh(r.collection)
        return {"ts": at, "action": action, "document": r}

    def form_remove(self, form, env):
        r, at, action = self.args(form, env, "remove", "ts", "action")
        self._store(r.collection).take_out(r.id, _c(at), action)
        self._fresh(r.collection)

    def _defined(self, action: str, name: Named, form: dict, env: dict):
        params = self.evaluate(form.get("params", {}), env)
        known = self.catalog.objects.setdefault(name.kind, {})
        if name not in known and not self.catalog.has(name.kind, str(name)):
            raise FormError(f"no {name.kind} {name}")
        known[str(name)] = {**known.get(str(name), {}), **params} if action == "update" else dict(params)
        return Document({"ref": name, **known[str(name)]})

    def _new(kind: str):  # noqa: N805
        def create(self, form, env):
            params = self.evaluate(next(iter(form.values())), env)
            name = params.get("name") or secrets.token_hex(8)
            if self.catalog.has(kind, name):
                raise FormError(f"{kind} {name} exists")
            out = {k: v for k, v in params.items() if not callable(v)}
            if kind == "collection":
                self.catalog.new_store(name, params.get("fields", "data string"))
            elif kind == "index":
                c = self.catalog.collection(str(params["source"]))
                path = lambda x: x["field"][-1] if isinstance(x, dict) else x
                terms = tuple(map(path, params.get("terms", [])))
                values = tuple(("-" if isinstance(v, dict) and v.get("reverse") else "") + path(v) for v in params.get("values", []))
                multi = tuple(f.name for f in c.rows.schema if f.name in terms and isinstance(f.dataType, T.ArrayType))
                self.catalog.create(c.with_index(Index(name, terms, values, multi)))
            elif kind == "function":
                body = params["body"]
                self.catalog.function(name, body)
            elif kind == "key":
                out["secret"] = self.catalog.identity.new_key(name, params.get("role"))
            self.catalog.objects.setdefault(kind, {})[name] = {k: v for k, v in out.items() if k != "secret"}
            return Document({"ref": Named(kind, name), **out})

        return create

    form_create_collection, form_create_index, form_create_function, form_create_role, form_create_database, form_create_key, form_create_access_provider = map(
        _new, ("collection", "index", "function", "role", "database", "key", "access_provider")
    )
    form_create_class = form_create_collection

    def form_move_database(self, form, env):
        name, to = self.args(form, env, "move_database", "to")
        self.catalog.objects["database"][str(name)]["parent"] = str(to)

    # identity

    def form_key_from_secret(self, form, env):
        found = self.catalog.identity.key_of(self.evaluate(form["key_from_secret"], env))
        if found is None:
            raise FormError("no key has this secret")
        return Document({"ref": Ref("keys", found[0]), "role": found[1]})

    def form_identify(self, form, env):
        r, password = self.args(form, env, "identify", "password")
        return self.catalog.identity.verify((r.collection, r.id), password)

    def form_login(self, form, env):
        r, params = self.args(form, env, "login", "params")
        if not self.catalog.identity.verify((r.collection, r.id), params["password"]):
            raise FormError("authentication failed")
        token, secret = self.catalog.identity.login((r.collection, r.id))
        self.catalog.objects.setdefault("token", {})[token] = {"instance": r}
        return Document({"ref": Ref("tokens", token), "instance": r, "secret": secret})

    def form_logout(self, form, env):
        gone = self.catalog.identity.logout(bool(self.evaluate(form["logout"], env)))
        for t in gone:
            self.catalog.objects.get("token", {}).pop(t, None)
        return bool(gone)

    def form_current_identity(self, form, env):
        who = self.catalog.identity.who
        if who is None:
            raise FormError("no identity")
        return Ref(*who)

    def form_current_token(self, form, env):
        if self.catalog.identity.token is None:
            raise FormError("no token")
        return Ref("tokens", self.catalog.identity.token)

    form_identity = form_current_identity
    form_has_identity = form_has_current_identity = lambda self, form, env: self.catalog.identity.who is not None
    form_has_current_token = lambda self, form, env: self.catalog.identity.token is not None

    def form_issue_access_jwt(self, form, env):
        r, seconds = self.args(form, env, "issue_access_jwt", "expire_in")
        return self.catalog.identity.jwt((r.collection, r.id), int(seconds or 3600))
