"""Conversions, tests of type, and the forms of results."""

from __future__ import annotations

import base64
import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.arrays import col

_TESTS = {
    "number": (T.NumericType,), "double": (T.DoubleType, T.FloatType), "integer": (T.IntegralType,), "boolean": (T.BooleanType,),
    "bytes": (T.BinaryType,), "timestamp": (T.TimestampType, T.TimestampNTZType), "date": (T.DateType,), "string": (T.StringType,),
    "array": (T.ArrayType,), "object": (T.StructType, T.MapType),
}


def is_type(df: DataFrame, column: str, name: str) -> Column:
    """Whether a column's values are of a type: known from the schema, false for null."""
    if name == "null":
        return F.col(column).isNull()
    if name == "uuid":
        return F.coalesce(F.col(column).cast("string").rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lit(False))
    kind = df.select(column).schema[0].dataType
    return F.lit(isinstance(kind, _TESTS[name])) & F.col(column).isNotNull()


def to_string(x) -> Column:
    return F.coalesce(col(x).cast("string"), F.lit("null"))


def to_number(x) -> Column:
    """A text's leading number; an error without one."""
    x = col(x).cast("string")
    head = F.regexp_extract(x, r"^-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:E[0-9]+)?", 0)
    return F.when(head != "", head.try_cast("double")).otherwise(F.raise_error(F.concat(F.lit("not a number: "), x)))


to_double = to_number


def to_integer(x) -> Column:
    return to_number(x).cast("bigint")


def to_time(x, kind: str = "string") -> Column:
    """From epoch milliseconds, a date (midnight) or text."""
    return F.timestamp_millis(col(x)) if kind == "integer" else col(x).cast("timestamp")


def to_date(x) -> Column:
    return col(x).cast("date")


def bytes_from_base64(s) -> Column:
    return F.unbase64(col(s))


def bytes_to_base64(b) -> Column:
    return F.base64(col(b))


def to_id(x) -> Column:
    return col(x).cast("bigint")


def new_id() -> Column:
    """Unique, increasing 64-bit ids; not reproducible if a partition is computed again."""
    return F.monotonically_increasing_id()


def abort(value) -> Column:
    return F.raise_error(col(value).cast("string"))


def tagged(x: Any) -> Any:
    """A collected value with its type beside it: ``{"@int": "3"}``."""
    if x is None or isinstance(x, (bool, str)):
        return x
    if isinstance(x, int):
        return {"@int" if -(1 << 31) <= x < 1 << 31 else "@long": str(x)}
    if isinstance(x, float):
        return {"@double": str(x)}
    if isinstance(x, dt.datetime):
        return {"@time": x.isoformat() + ("Z" if x.tzinfo is None else "")}
    if isinstance(x, dt.date):
        return {"@date": x.isoformat()}
    if isinstance(x, (bytes, bytearray)):
        return {"@bytes": base64.b64encode(x).decode()}
    if isinstance(x, dict):
        out = {k: tagged(v) for k, v in x.items()}
        return {"@object": out} if any(k.startswith("@") for k in out) else out
    if hasattr(x, "asDict"):
        return tagged(x.asDict())
    if isinstance(x, (list, tuple)):
        return [tagged(v) for v in x]
    raise TypeError(f"no form for {type(x)}")


def simple(x: Any) -> Any:
    """A collected value as plain JSON."""
    t = tagged(x)
    if isinstance(t, dict) and len(t) == 1 and next(iter(t)).startswith("@"):
        (k, v), = t.items()
        return int(v) if k in ("@int", "@long") else float(v) if k == "@double" else simple(x if k == "@object" else v) if k != "@object" else {a: simple(b) for a, b in (x.asDict() if hasattr(x, "asDict") else x).items()}
    if isinstance(x, dict) or hasattr(x, "asDict"):
        return {k: simple(v) for k, v in (x.asDict() if hasattr(x, "asDict") else x).items()}
    return [simple(v) for v in x] if isinstance(x, (list, tuple)) else t


def decorated(x: Any) -> Any:
    """A collected value as text of the language: ``{ a: 1, at: Time("...") }``."""
    if x is None or isinstance(x, bool):
        return {None: "null", True: "true", False: "false"}[x]
    if isinstance(x, str):
        return '"' + x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    if isinstance(x, (int, float)):
        return str(x)
    if isinstance(x, dt.datetime):
        return f'Time("{x.isoformat()}Z")'
    if isinstance(x, dt.date):
        return f'Date("{x.isoformat()}")'
    if isinstance(x, (bytes, bytearray)):
        return f'Bytes("{base64.b64encode(x).decode()}")'
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return "{ " + ", ".join(f"{k if k.isidentifier() else decorated(k)}: {decorated(v)}" for k, v in x.items()) + " }" if x else "{}"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(decorated, x)) + "]"
    raise TypeError(f"no form for {type(x)}")


def v4_value(x: Any) -> Any:
    """A collected value as JSON of the expression language: ``{"@ts": "..."}``, ``{"@ref": ...}``."""
    if isinstance(x, dt.datetime):
        return {"@ts": x.isoformat() + "Z"}
    if isinstance(x, dt.date):
        return {"@date": x.isoformat()}
    if isinstance(x, (bytes, bytearray)):
        return {"@bytes": base64.b64encode(x).decode()}
    if hasattr(x, "collection") and hasattr(x, "id"):
        return {"@ref": {"id": str(x.id), "collection": str(x.collection)}}
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        out = {k: v4_value(v) for k, v in x.items()}
        return {"@obj": out} if any(k.startswith("@") for k in out) else out
    return [v4_value(v) for v in x] if isinstance(x, (list, tuple)) else x
