"""Evaluation of the text language: expressions become Columns, sets become Ordered plans.

A row's fields are columns under names of its own set, so that lambdas may use rows of several sets at
once. What a predicate or an inner set says about an outer row is gathered as a join condition:
``flatMap`` becomes a join, ``nonEmpty()`` and ``isEmpty()`` in a predicate a semi or anti join, and a
field that refers to another collection a left join. Nothing is read until the result is asked for.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions import arrays as A
from sheaf.functions import dates as D
from sheaf.functions import numbers as N
from sheaf.functions import strings as S
from sheaf.functions import types as Y
from sheaf.operators.ordered import Ordered, Page
from sheaf.plans.syntax import THIS, parse
from sheaf.sources.catalog import Catalog, Collection

_SERIAL = itertools.count()
MOST = 16_000  # elements that an array made of a set may have


class EvalError(ValueError):
    pass


class TooMany(EvalError):
    pass


@dataclass(frozen=True)
class Value:
    """A column, its type, and the sets whose rows it needs; const: its value where it is a literal."""

    c: Column
    kind: T.DataType
    refs: frozenset = frozenset()
    const: Any = None
    owner: Collection | None = None  # of a document that was read


@dataclass(frozen=True)
class Exists:
    inner: SetValue
    negated: bool


@dataclass(frozen=True)
class Ordering:
    key: Callable
    up: bool


@dataclass
class RowValue:
    """A row of a set; fields that refer to other collections become joins of the set."""

    owner: SetValue
    columns: dict[str, tuple[str, T.DataType]]
    collection: Collection | None

    def get(self, name: str) -> Any:
        if name == "id" and self.collection and "id" not in self.columns:
            name = self.collection.id
        if name not in self.columns:
            return Value(F.lit(None), T.NullType())
        if self.collection and name in self.collection.foreign:
            return self.owner.follow(self.columns[name][0], self.collection.foreign[name])
        c, kind = self.columns[name]
        return Value(F.col(c), kind, frozenset([self.owner.serial]))

    def packed(self) -> Value:
        return Value(F.struct(*[F.col(c).alias(n) for n, (c, _) in self.columns.items()]), T.StructType([T.StructField(n, k) for n, (_, k) in self.columns.items()]), frozenset([self.owner.serial]))


@dataclass
class SetValue:
    """single: rows hold one value each, under the column ``value``."""

    set: Ordered
    columns: dict[str, tuple[str, T.DataType]]
    collection: Collection | None = None
    single: bool = False
    outer: list[Column] = field(default_factory=list)
    refs: frozenset = frozenset()
    steps: tuple[str, ...] = ()
    joins: dict = field(default_factory=dict)
    pipeline: tuple | None = ()  # (step, lambda) since the collection, as long as a stream could go through them
    covered: tuple[str, ...] | None = None  # of an index: the fields that it holds
    serial: int = field(default_factory=lambda: next(_SERIAL))

    @classmethod
    def of(cls, rows: Ordered, collection: Collection | None = None, single: bool = False) -> SetValue:
        tag = next(_SERIAL)
        names = {f.name: (f"s{tag}_{f.name}", f.dataType) for f in rows.df.schema}
        df = rows.df.select(*[F.col(f"`{n}`").alias(c) for n, (c, _) in names.items()])
        return cls(Ordered(df, tuple((names[k][0], up) for k, up in rows.keys), rows.size), names, collection, single)

    def follow(self, key: str, target: Collection) -> RowValue:
        if (key, target.name) not in self.joins:
            self.joins[key, target.name] = SetValue.of(Ordered.of(target.rows, target.id), target)
        other = self.joins[key, target.name]
        other.serial = self.serial  # its rows come with this set's
        return _Followed(self, other.columns, target)

    def joined(self) -> Ordered:
        df = self.set.df
        for (key, _), other in list(self.joins.items()):
            column = other.columns[other.collection.id][0]
            if column not in df.columns:
                df = df.join(other.set.df, F.col(key) == F.col(column), "left")
        return replace(self.set, df=df)

    def row(self) -> Any:
        if self.single:
            c, kind = self.columns["value"]
            return Value(F.col(c), kind, frozenset([self.serial]))
        return RowValue(self, self.columns, self.collection)

    def but(self, rows: Ordered, step: str, **changes) -> SetValue:
        return replace(self, set=rows, steps=(*self.steps, step), **changes)


@dataclass(frozen=True)
class EventSource:
    """Changes of a set: its collection's versions through the set's filters and maps, before and after each change."""

    collection: Collection
    pipeline: tuple = ()
    watched: tuple[str, ...] = ()


class _Followed(RowValue):
    """A referenced row, joined to the set that refers to it; further references join to the same set."""


class Interpreter:
    def __init__(self, spark: SparkSession, catalog: Catalog):
        self.spark, self.catalog = spark, catalog
        self.cursors: dict[str, SetValue] = {}
        self.one = spark.range(1).select(F.lit(0).alias("nothing"))

    # running

    def run(self, text: str) -> Any:
        """A page for a set, a value for all else."""
        return self.result(self.evaluate(parse(text), {}))

    def plan(self, text: str) -> DataFrame:
        """The set's rows, or a single row with the value, not yet read."""
        return self.frame(self.evaluate(parse(text), {}))

    def result(self, v: Any) -> Any:
        if isinstance(v, SetValue):
            page = Ordered(v.set.df, v.set.keys, v.set.size).paginate()
            back = {c: n for n, (c, _) in v.columns.items()}
            rows = [{back[c]: x for c, x in r.asDict().items() if c in back} for r in page.data]
            return self.paged(v, Page([r["value"] for r in rows] if v.single else rows, page.after))
        if isinstance(v, EventSource):
            from sheaf.streaming.changes import feed

            rows, cursor, _ = feed(self.events(v))
            return Page([r.asDict(True) for r in rows], cursor)
        if isinstance(v, Collection):
            return v.name
        if isinstance(v, RowValue):
            v = v.packed()
        if isinstance(v, Value):
            return v.const if v.const is not None else Y.simple(self.one.select(v.c.alias("value")).first()["value"])
        return v

    def frame(self, v: Any) -> DataFrame:
        if isinstance(v, SetValue):
            return v.set.to_df().select(*[F.col(c).alias(n) for n, (c, _) in v.columns.items()])
        if isinstance(v, EventSource):
            return self.events(v)
        if isinstance(v, RowValue):
            v = v.packed()
        return self.one.select(v.c.alias("value")) if isinstance(v, Value) else v

    # values

    def lit(self, x: Any) -> Value:
        kind = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}[type(x)]
        return Value(F.lit(x).cast(kind) if x is not None else F.lit(None), kind, const=x)

    def typed(self, c: Column, *sources: Value) -> Value:
        """A column's type, as Spark's analysis finds it over stand-ins for what it reads."""
        refs = frozenset().union(*[s.refs for s in sources])
        frames = [s for s in self.live if s.serial in refs]
        df = self.one
        for s in frames:
            df = df.crossJoin(s.joined().df.limit(0))  # never run: only the schema is asked for
        for n, k in self.bound.items():
            df = df.withColumn(n, F.lit(None).cast(k))
        return Value(c, df.select(c.alias("value")).schema[0].dataType, refs)

    def plain(self, x: Any) -> Value:
        """A plain Python value as a literal."""
        if isinstance(x, dict):
            items = [(k, self.plain(v)) for k, v in x.items()]
            return self.typed(F.struct(*[v.c.alias(k) for k, v in items]) if items else F.from_json(F.lit("{}"), "struct<>"))
        if isinstance(x, (list, tuple)):
            return self.typed(F.array(*[self.plain(v).c for v in x]))
        return self.lit(x if isinstance(x, (bool, int, float, str, type(None))) else str(x))

    def logged(self, args) -> Value:
        """Values go to the log as they are; a set shows its first page."""
        import logging

        logging.getLogger("sheaf").info("%s", " ".join(str(self.result(a)) for a in args if not (isinstance(a, Value) and a.refs)))
        return self.lit(None)

    def resumed(self, s: SetValue, cursor: str, size: Value | None) -> Any:
        back = {c: n for n, (c, _) in s.columns.items()}
        page = Ordered(s.set.df, s.set.keys, int(size.const) if size else s.set.size).paginate(cursor)
        rows = [{back[c]: x for c, x in r.asDict().items() if c in back} for r in page.data]
        return self.paged(s, Page([r["value"] for r in rows] if s.single else rows, page.after))

    def paged(self, s: SetValue, page: Page) -> Page:
        """The set stays known under the cursor: it is the set as it was planned then."""
        if page.after:
            if len(self.cursors) >= 10_000:
                self.cursors.pop(next(iter(self.cursors)))
            self.cursors[page.after] = s
        return page

    live: list[SetValue] = []
    inside = 0  # lambdas over arrays
    bound: dict[str, T.DataType] = {}

    def value(self, v: Any) -> Value:
        if isinstance(v, RowValue):
            return v.packed()
        if isinstance(v, Value):
            return v
        if isinstance(v, SetValue):
            return self.materialised(v)
        raise EvalError(f"not a value: {type(v).__name__}")

    def materialised(self, s: SetValue) -> Value:
        rows = self.result(replace(s, set=s.set.page_size(MOST + 1))).data
        if len(rows) > MOST:
            raise TooMany(f"a set of more than {MOST} elements as an array")
        kind = s.columns["value"][1] if s.single else T.StructType([T.StructField(n, k) for n, (_, k) in s.columns.items()])
        df = self.spark.createDataFrame([(rows if s.single else [tuple(r.get(n) for n in s.columns) for r in rows],)], T.StructType([T.StructField("v", T.ArrayType(kind))]))
        return Value(F.from_json(F.lit(df.select(F.to_json("v")).first()[0]), T.ArrayType(kind)), T.ArrayType(kind))

    def stream(self, s: SetValue) -> Iterator[Any]:
        """All elements in order, a partition at a time: values, or objects by name."""
        df = s.set.to_df().select(*[F.col(c).alias(n) for n, (c, _) in s.columns.items()])
        for r in df.toLocalIterator(prefetchPartitions=True):
            yield r["value"] if s.single else r.asDict()

    def large(self, s: SetValue) -> bool:
        """Whether the set is too large for an array; no task reads further than to know."""
        return s.set.df.limit(MOST + 1).count() > MOST

    def read_by(self, f: Callable, seed: Value, kind: T.StructType) -> list[str]:
        """The fields of its second argument that a reducer reads, as the plan of a frame of all of them tells."""
        held, names = f"b{next(_SERIAL)}", {n: f"b{next(_SERIAL)}" for n in kind.names}
        kinds = {held: seed.kind, **{c: kind[n].dataType for n, c in names.items()}}
        saved, self.bound = self.bound, {**self.bound, **kinds}
        try:
            x = Value(F.struct(*[F.col(c).alias(n) for n, c in names.items()]), kind)
            out = self.value(f(Value(F.col(held), seed.kind), x)).c
        finally:
            self.bound = saved
        frame = self.spark.createDataFrame(self.spark.sparkContext.emptyRDD(), T.StructType([T.StructField(c, k) for c, k in kinds.items()]))
        found = frame.select(out.alias("value"))._jdf.queryExecution().optimizedPlan().references().iterator()
        read = set()
        while found.hasNext():
            read.add(found.next().name())
        return [n for n, c in names.items() if c in read]

    def folded(self, name: str, s: SetValue, args: list) -> Value:
        """A fold over a set of any size: a slice of the sorted rows at a time where they are, each fold going on from the last one's
        value. Only that value comes to the driver."""
        rows = s.set.reverse() if name.endswith("Right") else s.set
        seeded, f = name in ("fold", "foldRight"), args[1] if len(args) > 1 else args[0]
        kind = s.columns["value"][1] if s.single else T.StructType([T.StructField(n, k) for n, (_, k) in s.columns.items()])
        fields = list(s.columns) if s.single or not seeded else self.read_by(f, self.value(args[0]), kind)
        packed = T.StructType([T.StructField(n, s.columns[n][1]) for n in fields])
        v = Value(F.col("v"), T.ArrayType(packed))

        def step(a: Value, x: Value) -> Any:
            """The reducer over an element as it is held: of a value its only field, of a row the fields that are read."""
            if s.single:
                return f(a, Value(x.c.getField("value"), kind))
            return f(a, Value(F.struct(*[(x.c.getField(n) if n in fields else F.lit(None).cast(k)).alias(n) for n, (_, k) in s.columns.items()]), kind))

        value, out, held = None, None, None
        for part in rows.slices({n: F.col(s.columns[n][0]) for n in fields}):
            if seeded and (value is None or held != out.kind):
                held = out.kind if out else None
                out = self.over_array("fold", v, [args[0] if value is None else Value(F.col("a"), held), step])
            elif not seeded and (value is None or held is None):
                held = kind if value else None
                plain = F.transform("v", lambda x: x["value"] if s.single else F.struct(*[x[n].alias(n) for n in s.columns]))
                out = self.over_array("reduce", Value(F.concat(F.array(F.col("a")), plain) if value else plain, T.ArrayType(kind)), [f])
            if value is not None:
                part = part.crossJoin(self.spark.createDataFrame([value], T.StructType([T.StructField("a", held)]))) if isinstance(value[0], (Row, list, dict)) else part.withColumn("a", F.lit(value[0]).cast(held))
            value = (part.select(out.c.alias("value")).first()["value"],)
        held = out.kind if seeded else kind
        nested = isinstance(value[0], (Row, list))
        schema = T.StructType([T.StructField("v", held)])
        c = F.from_json(F.lit(self.spark.createDataFrame([value], schema).select(F.to_json(F.struct("v"))).first()[0]), schema)["v"] if nested else F.lit(value[0]).cast(held)
        result = Value(c, held)
        if name == "aggregate":
            return self.over_array(name, Value(F.array(result.c), T.ArrayType(kind)), args)
        return result

    # evaluation

    def evaluate(self, node, env: dict) -> Any:
        return getattr(self, "on_" + node[0])(node, env)

    def on_lit(self, node, env):
        return self.lit(node[1])

    def on_template(self, node, env):
        parts = [p if isinstance(p, str) else self.value(self.evaluate(p, env)) for p in node[1]]
        return Value(S.template(*[p if isinstance(p, str) else p.c for p in parts]), T.StringType(), frozenset().union(*[p.refs for p in parts if not isinstance(p, str)]))

    def on_array(self, node, env):
        items = [self.value(self.evaluate(x, env)) for x in node[1]]
        if not items:
            return Value(F.array(), T.ArrayType(T.NullType()))
        return self.typed(F.array(*[x.c for x in items]), *items)

    def on_object(self, node, env):
        items = [(k, self.value(self.evaluate(x, env))) for k, x in node[1]]
        kind = T.StructType([T.StructField(k, v.kind) for k, v in items])
        return Value(F.struct(*[v.c.alias(k) for k, v in items]), kind, frozenset().union(*[v.refs for _, v in items]))

    def on_block(self, node, env):
        env, out = dict(env), None
        for s in node[1]:
            if s[0] == "let":
                env[s[1]] = self.evaluate(s[2], env)
            else:
                out = self.evaluate(s[1], env)
        return out

    def on_lambda(self, node, env):
        return lambda *args: self.evaluate(node[2], {**env, **dict(zip(node[1], args)), **({"_": args[0]} if args else {})})

    def on_var(self, node, env):
        name = node[1]
        if name in env:
            return env[name]
        if name in self.catalog.collections:
            return self.catalog.collections[name]
        if name in self.catalog.functions:
            return self.catalog.functions[name]
        if name in GLOBALS:
            return GLOBALS[name]
        if name in MODULES:
            return MODULES[name]
        raise EvalError(f"unbound: {name}")

    def on_if(self, node, env):
        test, yes, no = (self.evaluate(x, env) for x in node[1:])
        if test.const is not None:
            return yes if test.const else no
        yes, no = self.value(yes), self.value(no)
        return Value(F.when(test.c, yes.c).otherwise(no.c), no.kind if isinstance(yes.kind, T.NullType) else yes.kind, test.refs | yes.refs | no.refs)

    def on_unary(self, node, env):
        v = self.evaluate(node[2], env)
        if node[1] == "!" and isinstance(v, Exists):
            return Exists(v.inner, not v.negated)
        if v.const is not None and node[1] == "-":
            return self.lit(-v.const)
        return Value({"!": lambda c: ~c, "-": N.negate, "~": N.bit_not}[node[1]](v.c), v.kind, v.refs)

    def on_bang(self, node, env):
        v = self.value(self.evaluate(node[1], env))
        return Value(F.when(v.c.isNotNull(), v.c).otherwise(F.raise_error(F.lit("null value"))), v.kind, v.refs, owner=v.owner)

    def on_isa(self, node, env):
        v = self.value(self.evaluate(node[1], env))
        kinds = {"Number": T.NumericType, "Int": T.IntegralType, "Long": T.IntegralType, "Double": T.FractionalType, "Float": T.FractionalType, "String": T.StringType, "Boolean": T.BooleanType, "Time": T.TimestampType, "Date": T.DateType, "Array": T.ArrayType, "Object": T.StructType, "Null": T.NullType, "Bytes": T.BinaryType}
        if node[2] == "Null":
            return Value(v.c.isNull(), T.BooleanType(), v.refs)
        return Value(F.lit(isinstance(v.kind, kinds[node[2]])) & v.c.isNotNull(), T.BooleanType(), v.refs)

    def on_as_of(self, node, env):
        when, saved = self.value(self.evaluate(node[1], env)), self.catalog
        if when.const is None and self.one.select(when.c > F.current_timestamp()).first()[0]:
            raise EvalError("at: a time in the future")
        self.catalog = saved.as_of(when.c)
        try:
            return self.evaluate(node[2], env)
        finally:
            self.catalog = saved

    def on_op(self, node, env):
        op, a, b = node[1], self.evaluate(node[2], env), self.evaluate(node[3], env)
        if op == "&&" and (isinstance(a, (Exists, list)) or isinstance(b, (Exists, list))):
            return [*(a if isinstance(a, list) else [a]), *(b if isinstance(b, list) else [b])]
        a, b = self.value(a), self.value(b)
        refs = a.refs | b.refs
        if op in COMPARE:
            return Value(COMPARE[op](a.c, b.c), T.BooleanType(), refs)
        if op in ("&&", "||"):
            return Value(a.c & b.c if op == "&&" else a.c | b.c, T.BooleanType(), refs)
        if op == "??":
            return Value(F.coalesce(a.c, b.c), b.kind if isinstance(a.kind, T.NullType) else a.kind, refs)
        whole = isinstance(a.kind, T.IntegralType) and isinstance(b.kind, T.IntegralType)
        if op == "+" and isinstance(a.kind, T.StringType):
            return Value(S.add(a.c, b.c), T.StringType(), refs)
        if op in "+-*" and op != "**":
            f = {"+": N.add, "-": N.subtract, "*": N.multiply}[op]
            return Value(f(a.c, b.c), T.LongType(), refs) if whole else Value(f(a.c.cast("double"), b.c.cast("double")), T.DoubleType(), refs)
        if op == "/":
            return Value(N.divide_int(a.c, b.c) if whole else N.divide(a.c, b.c), T.LongType() if whole else T.DoubleType(), refs)
        if op == "%":
            return Value(N.modulo(a.c, b.c), a.kind if whole else T.DoubleType(), refs)
        if op == "**":
            p = N.power(a.c, b.c)
            return Value(p.cast("bigint") if whole else p, T.LongType() if whole else T.DoubleType(), refs)
        return Value({"&": N.bit_and, "|": N.bit_or, "^": N.bit_xor}[op](a.c, b.c), T.LongType(), refs)

    def on_at(self, node, env):
        v, i = self.evaluate(node[1], env), self.value(self.evaluate(node[2], env))
        if isinstance(v, RowValue):
            return v.get(i.const)
        v = self.value(v)
        if isinstance(v.kind, T.ArrayType):
            return Value(F.get(v.c, i.c.cast("int")) if node[3] else A.at(v.c, i.c.cast("int")), v.kind.elementType, v.refs | i.refs)
        if isinstance(v.kind, T.StructType):
            return Value(v.c.getField(i.const), v.kind[i.const].dataType, v.refs)
        return Value(S.at(v.c, i.c.cast("int")), T.StringType(), v.refs | i.refs)

    def on_get(self, node, env):
        v, name = self.evaluate(node[1], env), node[2]
        if isinstance(v, RowValue):
            return v.get(name)
        if isinstance(v, dict):
            return v[name]() if name in ("E", "PI", "NaN", "Infinity") else v[name]
        if isinstance(v, Collection):
            if name == "definition":
                return self.defined(v)
            if name == "name":
                return self.lit(v.name)
        if isinstance(v, Value):
            if isinstance(v.kind, T.StructType) and name in v.kind.names:
                return Value(v.c.getField(name), v.kind[name].dataType, v.refs)
            if isinstance(v.kind, T.NullType):
                return v
            if (f := FIELDS.get((type(v.kind), name))) is not None:
                return self.typed(f(v.c), v)
        raise EvalError(f"no field {name}")

    def on_project(self, node, env):
        v = self.evaluate(node[1], env)
        if isinstance(v, SetValue):
            return self.mapped(v, lambda row: self.projected(row, node[2], env))
        if isinstance(v, Value) and isinstance(v.kind, T.ArrayType):
            return self.over_array("map", v, [lambda x: self.projected(x, node[2], env)])
        return self.projected(v, node[2], env)

    def projected(self, v: Any, fields: list, env: dict) -> Value:
        out = []
        for n, e in fields:
            if n == "*":
                packed = self.value(v)
                out += [(f.name, Value(packed.c.getField(f.name), f.dataType, packed.refs)) for f in packed.kind]
                continue
            x = self.evaluate(e, {**env, THIS: v})
            x = self.value(x(v) if callable(x) else x)
            out.append((n, x))
        kind = T.StructType([T.StructField(n, x.kind) for n, x in out])
        packed = F.struct(*[x.c.alias(n) for n, x in out])
        refs = frozenset().union(*[x.refs for _, x in out])
        if isinstance(v, Value) and isinstance(v.kind, T.StructType):
            packed = F.when(v.c.isNotNull(), packed)
        elif isinstance(v, _Followed):
            packed = F.when(F.col(v.columns[v.collection.id][0]).isNotNull(), packed)
        return Value(packed, kind, refs)

    def on_call(self, node, env):
        callee, args = node[1], node[2]
        if callee[0] == "get":
            target, name = self.evaluate(callee[1], env), callee[2]
            values = [self.evaluate(a, env) for a in args]
            return self.method(target, name, values)
        f = self.evaluate(callee, env)
        values = [self.evaluate(a, env) for a in args]
        if isinstance(f, Collection):
            return self.document(f, values[0])
        if isinstance(f, dict):
            f = f["()"]
        return f(self, *values) if getattr(f, "takes_self", False) else f(*values)

    # methods

    def method(self, target: Any, name: str, args: list) -> Any:
        if isinstance(target, Collection):
            return self.on_collection(target, name, args)
        if isinstance(target, EventSource):
            if name not in ("where", "map"):
                raise EvalError(f"no method {name} on an event source")
            return replace(target, pipeline=(*target.pipeline, (name, args[0])))
        if isinstance(target, SetValue):
            return self.on_set(target, name, args)
        if isinstance(target, dict):
            f = target[name]
            if getattr(f, "takes_self", False):
                return f(self, *args)
            values = [self.value(a) for a in args]
            return self.typed(f(*[v.c for v in values]), *values)
        if name == "exists":
            key = target.columns[target.collection.id][0] if isinstance(target, RowValue) else None
            return Value(F.col(key).isNotNull() if key else self.value(target).c.isNotNull(), T.BooleanType(), frozenset([target.owner.serial]) if key else target.refs)
        if name in ("update", "replace", "delete", "updateData", "replaceData") and isinstance(target, Value) and target.owner:
            return self.write(target.owner, name.removesuffix("Data"), self.one.select(target.c.getField("id")).first()[0], *args)
        v = self.value(target)
        if isinstance(v.kind, T.ArrayType):
            return self.over_array(name, v, args)
        f = METHODS.get((type(v.kind), name)) or (METHODS.get((T.DoubleType, name)) if isinstance(v.kind, T.NumericType) else None) or METHODS.get((None, name))
        if f is None:
            raise EvalError(f"no method {name} on {v.kind.simpleString()}")
        raw = getattr(f, "raw", ())
        values = [self.value(a) for a in args]
        return self.typed(f(v.c, *[x.const if k in raw else x.c for k, x in enumerate(values)]), v, *values)

    def document(self, c: Collection, id_: Value) -> RowValue | Value:
        s = SetValue.of(Ordered.of(c.rows.where(F.col(c.id) == id_.c), c.id), c)
        return replace(self.single_row(s), owner=c)

    def write(self, c: Collection, action: str, id_: int | None, data: Value | None = None) -> Value:
        """A version of one document; the document as it is then."""
        if self.live:
            raise EvalError("no writes within a lambda over a set")
        if c.name not in self.catalog.stores:
            raise EvalError(f"{c.name} has no store to write to")
        store = self.catalog.stores[c.name]
        rows = self.one.select(F.lit(id_).cast("long").alias("id")) if data is None else self.one.select(*([F.lit(id_).cast("long").alias("id")] if id_ is not None else []), data.c.alias("d")).select("*", "d.*").drop("d")
        if "id" not in rows.columns:
            rows = rows.withColumn("id", F.lit(store.next_id()))
        id_ = rows.first()["id"]
        if action == "update":
            store.update(rows, clear=tuple(f.name for f in data.kind if isinstance(f.dataType, T.NullType)))
        else:
            getattr(store, action)(rows)
        fresh = self.catalog.create(replace(c, df=store.rows()))
        return self.document(fresh, self.lit(id_))

    def defined(self, c: Collection) -> Value:
        """What a collection is: its name, fields, computed fields, indexes, checks and unique constraints."""
        names = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
        fields = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type")) for f in c.rows.schema])
        packed = F.struct(F.lit(c.name).alias("name"), fields.alias("fields"), names(c.computed).alias("computed"), names(c.indexes).alias("indexes"), names(c.checks).alias("checks"), names(",".join(u) for u in c.unique).alias("unique"))
        return self.typed(packed)

    def fields_of(self, s: SetValue, lambdas: list) -> tuple[str, ...]:
        """The fields that accessors name."""
        back, out = {c: n for n, (c, _) in s.columns.items()}, []
        for f in lambdas:
            v = self.on_row(s, f)
            named = [n for c, n in back.items() if isinstance(v, Value) and str(v.c._jc.toString()) == c]
            if not named:
                raise EvalError("a watched field is an accessor such as .name")
            out.append(named[0])
        return tuple(out)

    def event_source(self, s: SetValue, lambdas: list) -> EventSource:
        from sheaf.streaming.changes import check_streamable

        check_streamable(list(s.steps))
        if s.pipeline is None or s.collection is None and not s.pipeline:
            raise EvalError("only sets of a collection or an index can be streamed")
        watched = self.fields_of(s, lambdas)
        if s.covered is not None and (bad := [f for f in watched if f not in s.covered]):
            raise EvalError(f"the index does not hold {', '.join(bad)}")
        return EventSource(s.pipeline[0][1], s.pipeline[1:], watched)

    def events(self, e: EventSource) -> DataFrame:
        """(id, ts, ord, event_type, data): add, update or remove, as the images before and after pass the set's filters."""
        from sheaf.sources import versions
        from sheaf.streaming import changes

        log = self.catalog.log(e.collection.name)
        if log is None:
            raise EvalError(f"no log tells the changes of {e.collection.name}")
        plain = [f.name for f in log.schema if f.name not in ("ts", "ord", "action")]
        images = versions.before_images(log.withColumn("_id", F.col("id")), plain, tie="ord").select("id", "ts", "ord", "before", "after")
        if e.watched:
            images = changes.changed(images, *e.watched)
        tag, passed, data = next(_SERIAL), {}, {}
        df = images
        for side in ("before", "after"):
            df = df.select("*", *[F.col(side).getField(n).alias(f"s{tag}{side}_{n}") for n in plain])
        for side in ("before", "after"):
            s = SetValue(Ordered(df, ()), {n: (f"s{tag}{side}_{n}", log.schema[n].dataType) for n in plain}, e.collection)
            row: Any = s.row()
            ok = F.col(side).isNotNull()
            for step, f in e.pipeline:
                self.live = [*self.live, s]
                try:
                    v = f(row)
                    if step == "where":
                        ok = ok & F.coalesce(self.value(v).c, F.lit(False))
                    else:
                        row = self.value(v)
                finally:
                    self.live = self.live[:-1]
            if s.joins:
                raise EvalError("a stream's filters and maps read the document only")
            passed[side], data[side] = ok, self.value(row).c
        kind = F.when(~passed["before"] & passed["after"], "add").when(passed["before"] & passed["after"], "update").when(passed["before"] & ~passed["after"], "remove")
        out = df.select("id", "ts", "ord", kind.alias("event_type"), F.when(passed["after"], data["after"]).otherwise(data["before"]).alias("data"))
        return out.where("event_type is not null")

    def single_row(self, s: SetValue) -> Any:
        """The first row as a value, read now; null where there is none."""
        rows = self.result(replace(s, set=s.set.page_size(1))).data
        kind = s.columns["value"][1] if s.single else T.StructType([T.StructField(n, k) for n, (_, k) in s.columns.items()])
        if not rows:
            return Value(F.lit(None).cast(kind), kind)
        df = self.spark.createDataFrame([(rows[0] if s.single else tuple(rows[0][n] for n in s.columns),)], T.StructType([T.StructField("v", kind)]))
        if s.single and not isinstance(kind, (T.StructType, T.ArrayType)):
            return Value(F.lit(rows[0]).cast(kind), kind, const=rows[0] if isinstance(rows[0], (int, float, str, bool)) else None)
        return Value(F.from_json(F.lit(df.select(F.to_json("v", {"ignoreNullFields": "false"})).first()[0]), kind), kind)

    def on_collection(self, c: Collection, name: str, args: list) -> Any:
        if name == "all":
            low = high = None
            if args:
                low, high = (self.bounds(args[0], k) for k in ("from", "to"))
            return replace(SetValue.of(c.all(low, high), c), pipeline=(("from", c),) if low is None and high is None else None)
        if name == "toString":
            return self.lit(c.name)
        if name == "byId":
            return self.document(c, args[0])
        if name in ("create", "createData"):
            return self.write(c, "create", None, args[0])
        if name in c.indexes:
            index = c.indexes[name]
            n = len(index.terms)
            base = SetValue.of(Ordered(c.rows, Ordered.of(c.rows, *index.values, c.id).keys), c)
            given = [self.value(a) for a in args[:n]]
            same = lambda row: Value(reduce(lambda x, y: x & y, [F.array_contains(row.get(t).c, a.c) if t in index.multi else row.get(t).c == a.c for t, a in zip(index.terms, given)], F.lit(True)), T.BooleanType())
            fixed = len(args) == n and not any(a.refs for a in given) and not index.computed
            base = replace(base, pipeline=(("from", c), ("where", same)) if fixed else None, covered=(*index.terms, *(v.lstrip("-") for v in index.values)))
            for t, a in zip(index.terms, args[:n]):
                a = self.value(a)
                column = F.col(base.columns[t][0])
                base = self.restricted(base, F.array_contains(column, a.c) if t in index.multi else column == a.c, a.refs)
            if len(args) > n:
                low, high = (self.bounds(args[n], k) for k in ("from", "to"))
                as_tuple = lambda x: () if x is None else tuple(x) if isinstance(x, (list, tuple)) else (x,)
                base = base.but(base.set.range(as_tuple(low), as_tuple(high)), "range")
            return base
        return self.on_set(replace(SetValue.of(c.all(), c), pipeline=(("from", c),)), name, args)

    def bounds(self, v: Value, key: str) -> Any:
        if key not in v.kind.names:
            return None
        return self.one.select(v.c.getField(key).alias("v")).first()["v"]

    def restricted(self, s: SetValue, p: Column, refs: frozenset, how: str = "where") -> SetValue:
        """Own conditions filter; those on outer rows wait for the join."""
        if refs - {s.serial}:
            return replace(s, outer=[*s.outer, p], refs=s.refs | (refs - {s.serial}))
        return s.but(s.joined().where(p), how)

    def on_row(self, s: SetValue, f: Callable) -> Any:
        self.live = [*self.live, s]
        try:
            return f(s.row())
        finally:
            self.live = self.live[:-1]

    def filtered(self, s: SetValue, f: Callable) -> SetValue:
        found = self.on_row(s, f)
        for p in found if isinstance(found, list) else [found]:
            if isinstance(p, Exists):
                inner = p.inner
                on = inner.outer[0] if inner.outer else F.lit(True)
                for c in inner.outer[1:]:
                    on = on & c
                joined = s.joined()
                s = s.but(replace(joined, df=joined.df.join(inner.joined().df, on, "left_anti" if p.negated else "left_semi")), "where")
            else:
                s = self.restricted(s, p.c, p.refs)
        return s

    def mapped(self, s: SetValue, f: Callable) -> SetValue:
        v = self.on_row(s, lambda row: self.value(f(row)))
        tag, joined = next(_SERIAL), s.joined()
        if isinstance(v.kind, T.StructType):
            columns = {k.name: (f"s{tag}_{k.name}", k.dataType) for k in v.kind}
            df = joined.df.withColumn(f"s{tag}", v.c)
            df = df.select("*", *[F.col(f"s{tag}").getField(n).alias(c) for n, (c, _) in columns.items()])
        else:
            columns = {"value": (f"s{tag}_value", v.kind)}
            df = joined.df.withColumn(f"s{tag}_value", v.c)
        keep = [*dict.fromkeys([*[c for c, _ in columns.values()], *[k for k, _ in s.set.keys]])]
        return s.but(replace(joined, df=df.select(*keep) if not s.outer else df), "map", columns=columns, collection=None, single=not isinstance(v.kind, T.StructType), joins={})

    def on_set(self, s: SetValue, name: str, args: list) -> Any:
        if name in ("where", "filter", "$where"):
            return replace(self.filtered(s, args[0]), pipeline=s.pipeline and (*s.pipeline, ("where", args[0])))
        if name in ("map", "$map"):
            return replace(self.mapped(s, args[0]), pipeline=s.pipeline and (*s.pipeline, ("map", args[0])))
        if name == "$flatMap":
            name = "flatMap"
        if name == "flatMap":
            inner = self.on_row(s, args[0])
            if isinstance(inner, Value) and isinstance(inner.kind, T.ArrayType):
                tag, joined = next(_SERIAL), s.joined()
                both = joined.explode(inner.c, f"s{tag}_value")
                return s.but(both, "flat_map", columns={"value": (f"s{tag}_value", inner.kind.elementType)}, collection=None, single=True, joins={})
            if not isinstance(inner, SetValue):
                raise EvalError("flatMap needs a set")
            on = F.lit(True)
            for c in inner.outer:
                on = on & c
            return replace(inner, set=s.joined().flat_map(inner.joined(), on), outer=list(s.outer), refs=s.refs, steps=(*s.steps, "flat_map"), joins={})
        if name == "order":
            keys, joined = [], s.joined()
            for k, a in enumerate(args or [lambda x: x]):
                o = a if isinstance(a, Ordering) else Ordering(a, True)
                v = self.on_row(s, lambda row, o=o: self.value(o.key(row)))
                column = f"k{next(_SERIAL)}"
                joined = replace(joined, df=s.joined().df.withColumn(column, v.c) if not k else joined.df.withColumn(column, v.c))
                keys.append(column if o.up else f"-{column}")
            return s.but(joined.order(*keys), "order", joins={})
        if name in ("take", "drop"):
            return s.but(getattr(s.set, name)(int(args[0].const)), name)
        if name == "pageSize":
            return s.but(s.set.page_size(int(args[0].const)), "page")
        if name == "reverse":
            return s.but(s.set.reverse(), "reverse")
        if name == "distinct":
            rows = Ordered(s.set.df.select(*[c for c, _ in s.columns.values()]), ())
            return s.but(rows.distinct(), "distinct", joins={})
        if name == "concat":
            parts, keys = [], [("_part", True)]
            for k, x in enumerate((s, args[0])):
                names = [(f"_k{k}_{i}", c, up) for i, (c, up) in enumerate(x.set.keys)]
                keys += [(n, up) for n, _, up in names]
                parts.append(x.set.df.select(*[F.col(c).alias(n) for n, (c, _) in x.columns.items()], F.lit(k).alias("_part"), *[F.col(c).alias(n) for n, c, _ in names]))
            both = parts[0].unionByName(parts[1], allowMissingColumns=True)
            out = SetValue.of(Ordered(both, tuple(keys)), None, s.single)
            return replace(out, columns={n: out.columns[n] for n in s.columns}, steps=(*s.steps, "concat"))
        if name == "toSet":
            return s
        if name in ("toStream", "eventSource", "changesOn", "eventsOn"):
            return self.event_source(s, args)
        if name == "first":
            return self.single_row(s)
        if name == "last":
            return self.single_row(s.but(s.set.reverse(), "reverse"))
        if name == "firstWhere":
            return self.single_row(self.filtered(s, args[0]))
        if name == "lastWhere":
            s = self.filtered(s, args[0])
            return self.single_row(s.but(s.set.reverse(), "reverse"))
        if name == "includes":
            found = s.set.df.where(F.col(s.columns["value"][0]).eqNullSafe(args[0].c)).limit(1)
            return self.subquery(found.agg((F.count(F.lit(1)) > 0).alias("v")), T.BooleanType())
        if name in ("isEmpty", "nonEmpty"):
            if s.outer:
                return Exists(s, name == "isEmpty")
            some = s.set.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("v"))
            return self.subquery(some, T.BooleanType(), lambda c: c if name == "nonEmpty" else ~c)
        if name == "any":
            return self.on_set(self.filtered(s, args[0]), "nonEmpty", [])
        if name == "every":
            p = self.on_row(s, args[0])
            return self.subquery(s.joined().df.where(~F.coalesce(p.c, F.lit(False))).limit(1).agg((F.count(F.lit(1)) == 0).alias("v")), T.BooleanType())
        if name == "count":
            return self.subquery(s.set.df.agg(F.count(F.lit(1)).alias("v")), T.LongType())
        if name == "toArray":
            return self.materialised(s)
        if name in ("fold", "foldRight", "reduce", "reduceRight", "aggregate"):
            return self.folded(name, s, args) if self.large(s) else self.over_array(name, self.materialised(s), args)
        if name == "forEach":
            for x in self.stream(s):
                args[0](self.lit(x) if not isinstance(x, (dict, list)) else x)
            return self.lit(None)
        if name == "paginate":
            return self.result(s.but(s.set.page_size(int(args[0].const)), "page") if args else s)
        raise EvalError(f"no method {name} on a set")

    def subquery(self, df: DataFrame, kind: T.DataType, then: Callable = lambda c: c) -> Value:
        """A single row's single value as part of the plan. Within a lambda over an array it is read now, since Spark can't plan it there."""
        if self.bound or self.live or self.inside:
            return Value(then(F.lit(df.first()[0]).cast(kind)), kind)
        return Value(then(df.scalar()), kind)

    def over_array(self, name: str, v: Value, args: list) -> Any:
        element = v.kind.elementType
        refs = v.refs

        def scalar(f: Callable, *kinds: T.DataType) -> tuple[Callable, T.DataType]:
            """The lambda over columns, and its type found over stand-ins."""
            names = [f"b{next(_SERIAL)}" for _ in kinds]
            saved, self.bound = self.bound, {**self.bound, **dict(zip(names, kinds))}
            try:
                out = self.value(f(*[Value(F.col(n), k) for n, k in zip(names, kinds)]))
                kind = self.typed(out.c, out).kind
            finally:
                self.bound = saved

            def run(*cs: Column) -> Column:
                self.inside += 1
                try:
                    return self.value(f(*[Value(c, k) for c, k in zip(cs, kinds)])).c
                finally:
                    self.inside -= 1

            # Spark tells a lambda's arguments by its signature
            return (lambda x: run(x)) if len(kinds) == 1 else (lambda a, x: run(a, x)), kind

        if name in ("map", "flatMap"):
            f, kind = scalar(args[0], element)
            return Value(A.map_(v.c, f) if name == "map" else A.flat_map(v.c, f), T.ArrayType(kind) if name == "map" else kind, refs)
        if name in ("filter", "where", "any", "every", "firstWhere", "lastWhere", "indexWhere", "lastIndexWhere"):
            f, _ = scalar(args[0], element)
            g = {"filter": A.filter_, "where": A.filter_, "any": A.any_, "every": A.every, "firstWhere": A.first_where, "lastWhere": A.last_where, "indexWhere": A.index_where, "lastIndexWhere": A.last_index_where}[name]
            rest = [a.c.cast("int") for a in args[1:]]
            kind = {"any": T.BooleanType(), "every": T.BooleanType(), "firstWhere": element, "lastWhere": element, "indexWhere": T.IntegerType(), "lastIndexWhere": T.IntegerType()}.get(name, v.kind)
            return Value(g(v.c, f, *rest), kind, refs)
        if name in ("fold", "foldRight", "aggregate"):
            seed = self.value(args[0])
            _, kind = scalar(args[1], seed.kind, element)
            f, _ = scalar(args[1], kind, element)
            g = {"fold": A.fold, "foldRight": A.fold_right, "aggregate": A.aggregate}[name]
            return Value(g(v.c, seed.c.cast(kind), lambda a, x: f(a, x).cast(kind)), kind, refs | seed.refs)
        if name in ("reduce", "reduceRight"):
            f, kind = scalar(args[0], element, element)
            return Value((A.reduce if name == "reduce" else A.reduce_right)(v.c, lambda a, x: f(a, x).cast(element)), element, refs)
        if name == "order":
            keys = [(scalar(a.key if isinstance(a, Ordering) else a, element)[0], a.up if isinstance(a, Ordering) else True) for a in args]
            return Value(A.order(v.c, *keys), v.kind, refs)
        if name == "toSet":
            df = self.one.select(F.posexplode(v.c).alias("at", "value"))
            out = SetValue.of(Ordered.of(df, "at"), single=True)
            return replace(out, columns={"value": out.columns["value"]})
        if name == "toArray":
            return v
        if name == "forEach":
            return self.lit(None)
        plain = {"append": A.append, "prepend": A.prepend, "concat": A.concat, "distinct": A.distinct, "entries": A.entries, "first": A.first, "last": A.last, "flatten": A.flatten, "includes": A.includes, "isEmpty": A.is_empty, "nonEmpty": A.non_empty, "reverse": A.reverse}
        whole = {"at": A.at, "drop": A.drop, "take": A.take, "slice": A.slice_}
        values = [self.value(a) for a in args]
        if name in plain:
            return self.typed(plain[name](v.c, *[a.c for a in values]), v, *values)
        if name in whole:
            return self.typed(whole[name](v.c, *[a.c.cast("int") for a in values]), v, *values)
        if name in ("indexOf", "lastIndexOf"):
            g = A.index_of if name == "indexOf" else A.last_index_of
            return self.typed(g(v.c, values[0].c, *[a.c.cast("int") for a in values[1:]]), v, *values)
        raise EvalError(f"no method {name} on an array")


COMPARE = {"==": N.equal, "!=": N.not_equal, "<": N.less, "<=": N.less_or_equal, ">": N.greater, ">=": N.greater_or_equal}


def _raw(f: Callable, *places: int) -> Callable:
    """Arguments at these places are constants."""

    def g(*args):
        return f(*args)

    g.raw = places
    return g


def _own(f: Callable) -> Callable:
    """A function that takes the interpreter and unevaluated sets."""
    f.takes_self = True
    return f


FIELDS: dict[tuple[Any, str], Callable] = {(T.StringType, "length"): S.length, (T.ArrayType, "length"): A.length}
for _t in (T.TimestampType, T.DateType):
    FIELDS |= {(_t, n): f for n, f in {"year": D.year, "month": D.month, "dayOfMonth": D.day_of_month, "dayOfWeek": D.day_of_week, "dayOfYear": D.day_of_year, "hour": D.hour, "minute": D.minute, "second": D.second}.items()}

METHODS: dict[tuple[Any, str], Callable] = {
    (T.StringType, n): f
    for n, f in {
        "at": S.at, "concat": S.concat, "endsWith": S.ends_with, "startsWith": S.starts_with, "includes": S.includes, "includesRegex": _raw(S.includes_regex, 0), "insert": S.insert,
        "indexOf": S.index_of, "indexOfRegex": _raw(S.index_of_regex, 0), "lastIndexOf": S.last_index_of, "matches": _raw(S.matches, 0), "matchIndexes": _raw(S.match_indexes, 0),
        "replace": _raw(S.replace, 2), "replaceRegex": _raw(S.replace_regex, 0, 2), "replaceAll": S.replace_all, "replaceAllRegex": _raw(S.replace_all_regex, 0), "slice": S.slice_,
        "toLowerCase": S.to_lower_case, "toUpperCase": S.to_upper_case, "casefold": _raw(S.casefold, 0), "parseNumber": S.parse_number, "parseDouble": S.parse_double, "parseLong": _raw(S.parse_long, 0),
        "parseInt": _raw(S.parse_int, 0), "split": S.split, "splitRegex": _raw(S.split_regex, 0), "splitAt": S.split_at,
    }.items()
}
METHODS |= {
    (T.TimestampType, "add"): _raw(D.add, 1), (T.TimestampType, "subtract"): _raw(D.subtract, 1), (T.TimestampType, "difference"): _raw(D.difference, 1),
    (T.TimestampType, "toMicros"): D.to_micros, (T.TimestampType, "toMillis"): D.to_millis, (T.TimestampType, "toSeconds"): D.to_seconds,
    (T.DateType, "add"): _raw(D.date_add, 1), (T.DateType, "subtract"): _raw(D.date_subtract, 1), (T.DateType, "difference"): D.date_difference,
    (T.BinaryType, "toBase64"): Y.bytes_to_base64, (None, "toString"): Y.to_string,
}


def _mean(self, v):
    if isinstance(v, SetValue):
        c, kind = v.columns["value"]
        whole = isinstance(kind, T.IntegralType)
        return self.subquery(v.set.df.agg((N.mean_of_integers(c) if whole else N.mean_of(c)).alias("v")), T.LongType() if whole else T.DoubleType())
    return self.typed(A.mean(v.c), v)


def _sum(self, v):
    if isinstance(v, SetValue):
        c, kind = v.columns["value"]
        if isinstance(kind, T.IntegralType):  # null where the exact sum is no long
            exact = F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
            return self.subquery(v.set.df.agg(exact.try_cast("bigint").alias("v")), T.LongType())
        return self.subquery(v.set.df.agg(N.sum_of(c).alias("v")), T.DoubleType())
    return self.typed(A.sum_(v.c), v)


def _paginate(self, cursor, size=None):
    """The page after a cursor that a page of the same set gave: ``Set.paginate([set, cursor])`` names both; see ``resumed``."""
    saved = self.cursors.get(cursor.const)
    if saved is None:
        raise EvalError("unknown cursor; a page of this session gives one")
    return self.resumed(saved, cursor.const, size)


def _v4(self, form):
    """Evaluate a JSON form, given as text."""
    import json

    from sheaf.plans.json_forms import Elements, Forms

    forms = Forms(self.spark, self.catalog)
    out = forms.evaluate(json.loads(form.const), {})
    if isinstance(out, Elements):
        o = out.ordered()
        s = SetValue.of(Ordered(o.df, o.keys))
        if len(out.values) == 1:
            return replace(s, columns={"value": s.columns[out.values[0]]}, single=True)
        return replace(s, columns={v: s.columns[v] for v in out.values})
    if isinstance(out, Column):
        return self.typed(out)
    return self.plain(out)


def _from_entries(self, pairs):
    """Pairs [key, value] or { key, value } to an object; keys are constants, of equal keys the last counts."""
    kind = pairs.kind.elementType
    keyed = isinstance(kind, T.StructType)
    key = (lambda x: x["key"]) if keyed else (lambda x: x[0])
    df = self.one
    for s in self.live:
        df = df.crossJoin(s.joined().df.limit(1))  # a row to stand in; keys do not depend on it
    names = df.select(F.transform(pairs.c, lambda x: key(x).cast("string")).alias("k")).first()["k"]
    last = {n: k for k, n in enumerate(names)}
    return self.typed(F.struct(*[(F.get(pairs.c, F.lit(k))["value"] if keyed else F.get(F.get(pairs.c, F.lit(k)), F.lit(1))).alias(n) for n, k in last.items()]), pairs)


def _named(kind: str):
    """The module of definitions of a kind: all of them, or one by its name."""

    def by_name(self, name):
        if kind == "collection" and name.const in self.catalog.collections:
            return self.catalog.collections[name.const]
        if kind == "function" and name.const in self.catalog.functions:
            return self.catalog.functions[name.const]
        if not self.catalog.has(kind, name.const):
            raise EvalError(f"no {kind} {name.const}")
        return self.plain({"name": name.const, **self.catalog.objects.get(kind, {}).get(name.const, {})})

    def every(self):
        return SetValue.of(Ordered.of(self.catalog.listing().where(F.col("kind") == kind).select("name"), "name"))

    return {"()": _own(by_name), "byName": _own(by_name), "all": _own(every), "exists": _own(lambda self, name: self.lit(self.catalog.has(kind, name.const)))}


def _who(self):
    who = self.catalog.identity.who
    return self.document(self.catalog.collections[who[0]], self.lit(who[1])) if who else self.lit(None)


def _tokens_of(self, d):
    id_ = self.one.select(self.value(d).c.getField("id")).first()[0]
    found = [(t,) for t, x in self.catalog.objects.get("token", {}).items() if (x["instance"].collection, x["instance"].id) == (d.owner.name, id_)]
    return SetValue.of(Ordered.of(self.spark.createDataFrame(found, "value string"), "value"), single=True)


def _identifier(self, name):
    kind = next((k for k in ("collection", "function", "role", "index", "database", "key", "token", "access_provider") if self.catalog.has(k, name.const)), None)
    return self.plain({"kind": kind, "name": name.const}) if kind else self.lit(None)


MODULES: dict[str, dict[str, Callable]] = {
    "Math": {
        "abs": N.abs_, "acos": N.acos, "asin": N.asin, "atan": N.atan, "ceil": N.ceil, "cos": N.cos, "cosh": N.cosh, "degrees": N.degrees, "exp": N.exp, "floor": N.floor, "hypot": N.hypot,
        "log": N.log, "log10": N.log10, "max": N.max_, "min": N.min_, "pow": N.power, "radians": N.radians, "sign": N.sign, "sin": N.sin, "sinh": N.sinh, "sqrt": N.sqrt, "tan": N.tan, "tanh": N.tanh,
        "round": _own(lambda self, x, p=None: self.typed(N.round_(x.c, int(p.const) if p else 0), x)), "trunc": _own(lambda self, x, p=None: self.typed(N.trunc(x.c, int(p.const) if p else 0), x)),
        "E": lambda: Value(F.e(), T.DoubleType()), "PI": lambda: Value(F.pi(), T.DoubleType()), "NaN": lambda: Value(N.nan(), T.DoubleType()), "Infinity": lambda: Value(N.infinity(), T.DoubleType()),
        "mean": _own(_mean), "sum": _own(_sum),
    },
    "Array": {"sequence": lambda a, b: A.sequence(a.cast("int"), b.cast("int"))},
    "Set": {
        "sequence": _own(lambda self, a, b: SetValue.of(Ordered.sequence(self.spark, int(a.const), int(b.const)), single=True)),
        "single": _own(lambda self, v: SetValue.of(Ordered.single(self.one.select(v.c.alias("value"))), single=True)),
        "paginate": _own(_paginate),
    },
    "Time": {"()": _own(lambda self, s: self.typed(D.parse(s.c), s)), "fromString": D.parse, "now": D.now, "epoch": _own(lambda self, x, u: self.typed(D.epoch(x.c, u.const), x))},
    "Date": {"()": _own(lambda self, s: self.typed(D.date_parse(s.c), s)), "fromString": D.date_parse, "today": D.today},
    "Bytes": {"()": _own(lambda self, s: self.typed(Y.bytes_from_base64(s.c), s)), "fromBase64": Y.bytes_from_base64},
    "ID": {"()": _own(lambda self, s: self.typed(Y.to_id(s.c), s))},
    "Object": {
        "keys": _own(lambda self, o: Value(F.array(*[F.lit(n) for n in o.kind.names]), T.ArrayType(T.StringType()), o.refs)),
        "values": _own(lambda self, o: self.typed(F.array(*[o.c.getField(n) for n in o.kind.names]), o)),
        "entries": _own(lambda self, o: self.typed(F.array(*[F.struct(F.lit(n).alias("key"), o.c.getField(n).alias("value")) for n in o.kind.names]), o)),
        "assign": _own(lambda self, a, b: self.typed(F.struct(*[a.c.getField(n).alias(n) for n in a.kind.names if n not in b.kind.names], *[b.c.getField(n).alias(n) for n in b.kind.names]), a, b)),
        "select": _own(lambda self, o, path: self.typed(_path(o, path), o)), "hasPath": _own(lambda self, o, path: self.typed(_path(o, path).isNotNull(), o)),
        "fromEntries": _own(_from_entries), "toString": _own(lambda self, o: self.typed(F.to_json(o.c) if isinstance(o.kind, (T.StructType, T.ArrayType)) else Y.to_string(o.c), o)),
    },
}


def _path(o: Value, path: Value) -> Column:
    import re

    names = re.findall(r"'?([A-Za-z_]\w*)'?", str(path.c._jc.toString()).split("(", 1)[-1]) if path.const is None else [path.const]
    c, kind = o.c, o.kind
    for n in names:
        if not isinstance(kind, T.StructType) or n not in kind.names:
            return F.lit(None)
        c, kind = c.getField(n), kind[n].dataType
    return c


MODULES |= {
    "Collection": _named("collection"), "Function": _named("function"), "Role": _named("role"), "Database": _named("database"), "Key": _named("key"), "AccessProvider": _named("access_provider"),
    "Token": {**_named("token"), "byDocument": _own(_tokens_of)},
    "Query": {
        "identity": _own(_who), "token": _own(lambda self: self.lit(self.catalog.identity.token)),
        "isEnvTypechecked": _own(lambda self: self.lit(False)), "isEnvProtected": _own(lambda self: self.lit(bool(self.catalog.objects.get("environment", {}).get("protected")))),
    },
    "Schema": {"defForIdentifier": _own(_identifier)},
    "TransactionTime": {"()": _own(lambda self: self.typed(F.current_timestamp()))},
}
MODULES["FQL"] = MODULES

GLOBALS: dict[str, Any] = {
    "asc": lambda key: Ordering(key, True), "desc": lambda key: Ordering(key, False),
    "newId": _own(lambda self: self.typed(Y.new_id())), "abort": _own(lambda self, v: Value(Y.abort(v.c), T.StringType(), v.refs)),
    "log": _own(lambda self, *args: self.logged(args)), "dbg": _own(lambda self, v: (self.logged([v]), v)[1]), "evalV4": _own(_v4),
}
