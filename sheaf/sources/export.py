"""Sinks and readers: JSON and JSON lines, plain or gzip, simple or tagged values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _tagged(c: Column, kind: T.DataType) -> Column:
    """A value as JSON text with its type beside it, written by Spark itself."""
    name = {T.IntegerType: "@int", T.ShortType: "@int", T.ByteType: "@int", T.LongType: "@long", T.DoubleType: "@double", T.FloatType: "@double"}.get(type(kind))
    quoted = lambda x: F.regexp_replace(F.to_json(F.struct(x.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", "$1")
    if isinstance(kind, T.TimestampType):
        name, c = "@time", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    elif isinstance(kind, T.DateType):
        name = "@date"
    elif isinstance(kind, T.BinaryType):
        name, c = "@bytes", F.base64(c)
    if name:
        out = F.concat(F.lit(f'{{"{name}":"'), c.cast("string"), F.lit('"}'))
    elif isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f'"{f.name}":'), _tagged(c[f.name], f.dataType)) for f in kind]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _tagged(x, kind.elementType)), ","), F.lit("]"))
    else:
        out = quoted(c)
    return F.coalesce(F.when(c.isNotNull(), out), F.lit("null"))


def tagged_lines(df: DataFrame) -> DataFrame:
    """One column, value: each row as a JSON text with tagged values."""
    return df.select(_tagged(F.struct(*df.columns), df.schema).alias("value"))


def export(df: DataFrame, path: str, form: str = "jsonl", compress: bool = False, tagged: bool = False, fragments: int | None = None) -> None:
    """Write a table; ``json`` writes each fragment as one array, ``jsonl`` a document on each line."""
    if fragments:
        df = df.repartition(fragments)
    lines = tagged_lines(df) if tagged else df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    if form == "json":

        def arrays(batches):
            import pyarrow as pa

            started = False
            for b in batches:
                for x in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_pydict({"value": [("[" if not started else ",") + x]})
                    started = True
            yield pa.RecordBatch.from_pydict({"value": ["]" if started else "[]"]})

        lines = lines.mapInArrow(arrays, "value string")
    elif form != "jsonl":
        raise ValueError(f"no form {form}")
    lines.write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def read(spark: SparkSession, path: str, form: str, schema: str | None = None, **options) -> DataFrame:
    """Parquet, ORC, JSON lines, CSV, text or JDBC; a schema saves the pass that would infer it."""
    reader = spark.read.format({"jsonl": "json"}.get(form, form)).options(**options)
    return (reader.schema(schema) if schema else reader).load(path or None)


def sizes(df: DataFrame, by: str) -> DataFrame:
    """Estimated bytes and rows of documents, by a column; combined before the shuffle."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("bytes"))


def checksum(df: DataFrame) -> DataFrame:
    """A digest of a table that does not depend on the order of its rows: sums of two parts of each row's MD5.

    A row is its values as text, joined by bars; a null is left out, as ``concat_ws`` has it.
    """
    digest = F.md5(F.concat_ws("|", *(F.col(f"`{c}`").cast("string") for c in df.columns)))
    part = lambda k: F.sum(F.conv(F.substring(digest, k, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("/", part(1), part(16)).alias("checksum"))
