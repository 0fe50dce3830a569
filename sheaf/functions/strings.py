"""String functions as Column builders; positions are code points from zero, misses are null."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sheaf.functions.arrays import col


def _literal(s: Column) -> Column:
    """A regular expression that fits the text itself."""
    return F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _plain(replacement: Column) -> Column:
    """A replacement in which no group reference is left."""
    return F.replace(F.replace(replacement, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def display(x) -> Column:
    return F.coalesce(col(x).cast("string"), F.lit("null"))


def add(s, other) -> Column:
    return F.concat(col(s), display(other))


concat = lambda s, t: F.concat(col(s), col(t))
ends_with = lambda s, t: F.endswith(col(s), col(t))
starts_with = lambda s, t: F.startswith(col(s), col(t))
includes = lambda s, t: F.contains(col(s), col(t))
includes_regex = lambda s, r: F.rlike(col(s), F.lit(r))
length = lambda s: F.char_length(col(s))
to_lower_case = lambda s: F.lower(col(s))
to_upper_case = lambda s: F.upper(col(s))
trim = lambda s: F.trim(col(s))
ltrim = lambda s: F.ltrim(col(s))
rtrim = lambda s: F.rtrim(col(s))
space = lambda n: F.repeat(F.lit(" "), col(n))


def repeat(s, n=2) -> Column:
    return F.repeat(col(s), col(n))


def at(s, i) -> Column:
    """The code point at an index; an error outside the text."""
    s, i = col(s), col(i)
    return F.when((i >= 0) & (i < F.char_length(s)), F.substring(s, i + 1, 1)).otherwise(F.raise_error(F.lit("string index out of bounds")))


access = at


def slice_(s, start, end=None) -> Column:
    s, start = col(s), F.greatest(col(start), F.lit(0))
    end = F.char_length(s) if end is None else F.least(col(end), F.char_length(s))
    return F.substring(s, start + 1, F.greatest(end - start, F.lit(0)))


def insert(s, i, other) -> Column:
    return F.concat(slice_(s, 0, i), col(other), slice_(s, i))


def index_of(s, t, start=0) -> Column:
    found = F.call_function("locate", col(t), col(s), col(start) + 1)
    return F.when(found > 0, found - 1)


def last_index_of(s, t, end=None) -> Column:
    s, t = col(s), col(t)
    if end is not None:
        s = slice_(s, 0, col(end) + F.char_length(t))
    found = F.call_function("locate", F.reverse(t), F.reverse(s), F.lit(1))
    return F.when(found > 0, F.char_length(s) - F.char_length(t) - found + 1)


def index_of_regex(s, r: str, start=0) -> Column:
    found = F.regexp_instr(slice_(s, start), F.lit(r))
    return F.when(found > 0, found - 1 + F.greatest(col(start), F.lit(0)))


def matches(s, r: str) -> Column:
    return F.regexp_extract_all(col(s), F.lit(r), F.lit(0))


def match_indexes(s, r: str) -> Column:
    """(index, match) of all matches: each text before a match is split off, and its length counted."""
    s = col(s)
    found = matches(s, r)
    between = F.split(s, r, -1)
    places = F.transform(
        found,
        lambda m, i: F.struct(
            (F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda n, x: n + F.char_length(x)) + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda n, x: n + F.char_length(x))).alias("index"),
            m.alias("match"),
        ),
    )
    return places


def replace(s, t, replacement, amount: int = 1) -> Column:
    """The first ``amount`` occurrences of a text."""
    return F.concat_ws("", _interleaved(F.split(col(s), _literal(col(t)), amount + 1), col(replacement)))


def _interleaved(parts: Column, between: Column) -> Column:
    return F.flatten(F.transform(parts, lambda x, i: F.when(i == 0, F.array(x)).otherwise(F.array(between, x))))


def replace_regex(s, r: str, replacement, amount: int = 1) -> Column:
    """The first ``amount`` matches; the replacement is plain text."""
    return F.concat_ws("", _interleaved(F.split(col(s), r, amount + 1), col(replacement)))


def replace_all(s, t, replacement) -> Column:
    return F.replace(col(s), col(t), col(replacement))


def replace_all_regex(s, r: str, replacement) -> Column:
    return F.regexp_replace(col(s), F.lit(r), _plain(col(replacement)))


def replace_groups(s, r: str, replacement: str, first_only: bool = False) -> Column:
    """Regex replacement with group references, all matches or the first."""
    if not first_only:
        return F.regexp_replace(col(s), r, replacement)
    return F.regexp_replace(col(s), f"(?s)\\A(.*?)(?:{r})", "$1" + _shifted(replacement)) if "$" in replacement else replace_regex(s, r, F.lit(replacement))


def _shifted(replacement: str) -> str:
    import re

    return re.sub(r"\$(\d+)", lambda m: f"${int(m[1]) + 1}", replacement)


def split(s, separator) -> Column:
    """At a literal text, empty parts kept; an empty separator splits into characters."""
    s, separator = col(s), col(separator)
    letters = F.filter(F.split(s, ""), lambda x: x != "")
    return F.when(separator == "", letters).otherwise(F.split(s, _literal(separator), -1))


def split_regex(s, r: str, count: int = -1) -> Column:
    return F.split(col(s), r, count)


def split_count(s, separator, count: int) -> Column:
    return F.split(col(s), _literal(col(separator)), count)


def split_at(s, i) -> Column:
    return F.array(slice_(s, 0, i), slice_(s, i))


@F.pandas_udf(StringType())
def _normal_form(s: pd.Series, form: pd.Series) -> pd.Series:
    import unicodedata

    def one(x, f):
        if x is None:
            return None
        if f == "NFKCCaseFold":
            x = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x).casefold())
            return "".join(c for c in x if unicodedata.category(c) != "Cf")
        return unicodedata.normalize(f, x)

    return pd.Series([one(x, f) for x, f in zip(s, form)], dtype=object)


def casefold(s, form: str = "NFKCCaseFold") -> Column:
    """Unicode normal forms, which Spark has no function for; Arrow batches."""
    return _normal_form(col(s), F.lit(form))


def parse_long(s, radix: int = 10) -> Column:
    s = col(s)
    if radix == 10:
        return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))
    digits = "0-9" if radix == 10 else f"0-{'0123456789'[min(radix, 10) - 1]}" + (f"a-{chr(86 + radix)}A-{chr(54 + radix)}" if radix > 10 else "")
    return F.when(s.rlike(f"^[{digits}]+$"), F.conv(s, radix, 10).try_cast("bigint"))


def parse_int(s, radix: int = 10) -> Column:
    n = parse_long(s, radix)
    return F.when(n.between(-(1 << 31), (1 << 31) - 1), n.cast("int"))


def parse_double(s) -> Column:
    return col(s).try_cast("double")


def parse_number(s) -> Column:
    """The value as a double: of an integer if it is one, else of a decimal, else null."""
    return F.coalesce(parse_long(s).cast("double"), parse_double(s))


def find_str(s, t, start=0) -> Column:
    """First index, or -1."""
    return F.coalesce(index_of(s, t, start), F.lit(-1))


def substring(s, start, count=None) -> Column:
    """From a start that may count from the end; past the end empty."""
    s, start = col(s), col(start)
    start = F.when(start < 0, F.greatest(F.char_length(s) + start, F.lit(0))).otherwise(start)
    return slice_(s, start, None if count is None else start + col(count))


def title_case(s) -> Column:
    return F.initcap(col(s))


def ngram(s, low: int = 1, high: int = 2) -> Column:
    """All character n-grams of low to high characters, shorter ones first."""
    s = col(s)

    def of(n: int) -> Column:
        last = F.char_length(s) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(s, i + 1, n))).otherwise(F.expr("cast(array() as array<string>)"))

    return F.concat(*[of(n) for n in range(low, high + 1)])


def format_(pattern: str, *values) -> Column:
    return F.format_string(pattern, *map(col, values))


def template(*parts) -> Column:
    """Interpolated text: strings as they are, columns displayed."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else display(p) for p in parts])
