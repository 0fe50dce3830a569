"""Numbers and mathematics as Column builders.

Integers stay exact longs; since a column has one type, those that overflow are null, or with ``widened``
all results are doubles. Domain errors are raised, since Spark itself would give null or NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.arrays import col


def _checked(ok: Column, value: Column, what: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(what)))


_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _long(x) -> Column:
    """Integers as longs, doubles as they are."""
    return col(x) + F.lit(0).cast("bigint")


def _exact(a: Column, b: Column, over: Column, value: Column) -> Column:
    """Null where longs overflow, told without an exception in advance; doubles never do."""
    whole = (F.typeof(a) == "bigint") & (F.typeof(b) == "bigint")
    return F.when(~(whole & F.coalesce(over, F.lit(False))), value)


def add(a, b) -> Column:
    """Exact for integers, as a long; null where they overflow, see ``widened``. Doubles as IEEE has it."""
    a, b = _long(a), _long(b)
    return _exact(a, b, F.when(a >= 0, b > F.lit(_MOST) - F.greatest(a, F.lit(0))).otherwise(b < F.lit(_LEAST) - F.least(a, F.lit(0))), a + b)


def subtract(a, b) -> Column:
    a, b = _long(a), _long(b)
    return _exact(a, b, F.when(b >= 0, a < F.lit(_LEAST) + F.greatest(b, F.lit(0))).otherwise(a > F.lit(_MOST) + F.least(b, F.lit(0))), a - b)


def multiply(a, b) -> Column:
    a, b = _long(a), _long(b)
    small = a.between(-(1 << 31), 1 << 31) & b.between(-(1 << 31), 1 << 31)
    product = a.try_cast("decimal(19,0)") * b.try_cast("decimal(19,0)")
    return _exact(a, b, ~small & ~product.between(F.lit(_LEAST), F.lit(_MOST)), a * b)


def widened(f, a, b) -> Column:
    """add, subtract or multiply as a double: exact until integers overflow, or need more than 53 bits."""
    a, b = col(a), col(b)
    return F.coalesce(f(a, b).cast("double"), f(a.cast("double"), b.cast("double")))


def negate(a) -> Column:
    return -col(a)


def divide_int(a, b) -> Column:
    """Integers: truncated towards zero; zero divisors are errors."""
    a, b = col(a), col(b)
    return _checked(b != 0, F.try_divide((a - F.try_mod(a, b)).cast("decimal(38,0)"), b.cast("decimal(38,0)")).cast("bigint"), "divide by zero")


def divide(a, b) -> Column:
    """Doubles, as IEEE has it: a zero divisor gives an infinity or NaN."""
    a, b = col(a).cast("double"), col(b).cast("double")
    zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan"))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def divide_checked(a, b) -> Column:
    a, b = col(a), col(b)
    return _checked(b != 0, F.try_divide(a.cast("double"), b.cast("double")), "divide by zero")


def modulo(a, b) -> Column:
    """The remainder with the dividend's sign."""
    a, b = col(a), col(b)
    return _checked(b != 0, F.try_mod(a, b), "divide by zero")


def power(a, b) -> Column:
    return F.pow(col(a), col(b))


def chain(f, *args) -> Column:
    """An operation of two arguments over several, from the left."""
    out = col(args[0])
    for a in args[1:]:
        out = f(out, a)
    return out


bit_and = lambda a, b: col(a).bitwiseAND(col(b))
bit_or = lambda a, b: col(a).bitwiseOR(col(b))
bit_xor = lambda a, b: col(a).bitwiseXOR(col(b))
bit_not = lambda a: F.bitwise_not(col(a))

nan = lambda: F.lit(float("nan"))
infinity = lambda: F.lit(float("inf"))
e = F.e
pi = F.pi
abs_ = lambda x: F.abs(col(x))
atan = lambda x: F.atan(col(x))
ceil = lambda x: F.ceil(col(x))
floor = lambda x: F.floor(col(x))
cos = lambda x: F.cos(col(x))
sin = lambda x: F.sin(col(x))
tan = lambda x: F.tan(col(x))
cosh = lambda x: F.cosh(col(x))
sinh = lambda x: F.sinh(col(x))
tanh = lambda x: F.tanh(col(x))
degrees = lambda x: F.degrees(col(x))
radians = lambda x: F.radians(col(x))
exp = lambda x: F.exp(col(x))
sign = lambda x: F.signum(col(x).cast("double")).cast("int")
max_ = lambda x, y: F.greatest(col(x), col(y))
min_ = lambda x, y: F.least(col(x), col(y))


def hypot(x, y=None) -> Column:
    return F.hypot(col(x), col(x if y is None else y))


def acos(x) -> Column:
    x = col(x)
    return _checked(x.between(-1, 1), F.acos(x), "acos outside [-1, 1]")


def asin(x) -> Column:
    x = col(x)
    return _checked(x.between(-1, 1), F.asin(x), "asin outside [-1, 1]")


def log(x) -> Column:
    x = col(x)
    return _checked(x > 0, F.ln(x), "logarithm of a number that is not positive")


def log10(x) -> Column:
    x = col(x)
    return _checked(x > 0, F.log10(x), "logarithm of a number that is not positive")


def sqrt(x) -> Column:
    x = col(x)
    return _checked(x >= 0, F.sqrt(x), "square root of a negative number")


def round_(x, precision: int = 0) -> Column:
    """Half a unit is added and the rest cut off towards zero, so negative numbers lean upwards."""
    x, scale = col(x), 10.0**precision
    return ((x * scale + 0.5).cast("bigint")) / F.lit(scale)


def trunc(x, precision: int = 0) -> Column:
    """Towards zero at a precision."""
    x, scale = col(x), 10.0**precision
    return (x * scale).cast("bigint") / F.lit(scale)


# aggregates over the rows of a group


def sum_of(x) -> Column:
    """Zero where empty; integers that overflow turn into a double."""
    x = col(x)
    return F.coalesce(F.try_sum(x).cast("double"), F.sum(x.cast("double")), F.lit(0.0))


def mean_of(x) -> Column:
    """A double; an error where empty."""
    x = col(x)
    return _checked(F.count(x) > 0, F.avg(x), "mean of an empty set")


def mean_of_integers(x) -> Column:
    """Integers' sum by their count, cut off towards zero."""
    x = col(x)
    return divide_int(F.sum(x), F.count(x))


def any_of(p) -> Column:
    return F.coalesce(F.bool_or(F.coalesce(col(p), F.lit(False))), F.lit(False))


def every_of(p) -> Column:
    return F.coalesce(F.bool_and(F.coalesce(col(p), F.lit(False))), F.lit(True))


def includes_of(x, value) -> Column:
    return F.coalesce(F.bool_or(col(x).eqNullSafe(col(value))), F.lit(False))


# comparison: across null and values nothing is less, two nulls are equal


def equal(a, b) -> Column:
    return col(a).eqNullSafe(col(b))


def not_equal(a, b) -> Column:
    return ~equal(a, b)


def less(a, b) -> Column:
    return F.coalesce(col(a) < col(b), F.lit(False))


def less_or_equal(a, b) -> Column:
    a, b = col(a), col(b)
    return F.coalesce(a <= b, a.isNull() & b.isNull())


def greater(a, b) -> Column:
    return less(b, a)


def greater_or_equal(a, b) -> Column:
    return less_or_equal(b, a)


def increasing(f, *args) -> Column:
    """A comparison of two over several neighbours."""
    out = F.lit(True)
    for a, b in zip(args, args[1:]):
        out = out & f(a, b)
    return out
