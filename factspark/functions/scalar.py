"""The scalar and row-making functions, as column expressions.

A partial function has no value where it is not defined: the column is null there,
and ``defined`` drops such rows. Mixed comparisons take two columns of one type.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import number_text

INFINITY, NAN = float("inf"), float("nan")


def _double(x: Column) -> Column:
    return x.cast("double")


# Comparisons.
def greater(a: Column, b: Column) -> Column:
    return a > b


def greater_or_equal(a: Column, b: Column) -> Column:
    return a >= b


def less(a: Column, b: Column) -> Column:
    return a < b


def less_or_equal(a: Column, b: Column) -> Column:
    return a <= b


def not_equal(a: Column, b: Column) -> Column:
    """Inequality; of a number and a text the text's number counts, and text without one is unequal. Null if either is."""
    mixed = (F.typeof(a) == "string") != (F.typeof(b) == "string")
    number = lambda x: x.cast("string").try_cast("double")
    unlike = F.when(a.isNotNull() & b.isNotNull(), ~F.coalesce(number(a) == number(b), F.lit(False)))
    return F.when(mixed, unlike).otherwise(a != b)


def equal(a: Column, b: Column) -> Column:
    return a == b


def loose_equal(a: Column, b: Column) -> Column:
    """Equality of a number and a text: the text's number counts, and text without one is unequal."""
    return F.coalesce(_double(a) == b.try_cast("double"), F.lit(False))


# Arithmetic on doubles.
def add(a: Column, b: Column) -> Column:
    return _double(a) + _double(b)


def subtract(a: Column, b: Column) -> Column:
    return _double(a) - _double(b)


def multiply(a: Column, b: Column) -> Column:
    return _double(a) * _double(b)


def divide(a: Column, b: Column) -> Column:
    """a / b; by zero it is an infinity of a's sign, and 0 / 0 is not a number."""
    x, y = _double(a), _double(b)
    by_zero = F.when((x == 0) | F.isnan(x), NAN).otherwise(F.when(x > 0, INFINITY).otherwise(-INFINITY))
    return F.when(y == 0, F.when(x.isNotNull(), by_zero)).otherwise(F.try_divide(x, y))


def modulo(value: Column, by: Column) -> Column:
    """The remainder with the sign of ``value``; by zero it is not a number."""
    x, y = _double(value), _double(by)
    return F.when(y == 0, F.when(x.isNotNull(), NAN)).otherwise(F.try_mod(x, y))


def floor(x: Column) -> Column:
    return _double(F.floor(_double(x)))


def ceiling(x: Column) -> Column:
    return _double(F.ceil(_double(x)))


def round_half_up(x: Column) -> Column:
    """The nearest whole number; halves go towards plus infinity."""
    return _double(F.floor(_double(x) + 0.5))


def _radians(degrees: Column) -> Column:
    return _double(degrees) / F.lit(180.0) * F.lit(math.pi)


def sine(degrees: Column) -> Column:
    return F.sin(_radians(degrees))


def cosine(degrees: Column) -> Column:
    return F.cos(_radians(degrees))


def tangent(degrees: Column) -> Column:
    return F.tan(_radians(degrees))


def maximum(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(_double(a), _double(b)))


def minimum(a: Column, b: Column) -> Column:
    """The smaller number; not a number if either is not."""
    x, y = _double(a), _double(b)
    return F.when(F.isnan(x) | F.isnan(y), NAN).when(x.isNotNull() & y.isNotNull(), F.least(x, y))


def absolute(x: Column) -> Column:
    return F.abs(_double(x))


def power(value: Column, exponent: Column) -> Column:
    return F.pow(_double(value), _double(exponent))


def natural_log(x: Column) -> Column:
    """ln x: minus infinity at zero, not a number below."""
    y = _double(x)
    return F.when(y == 0, -INFINITY).when(y < 0, NAN).otherwise(F.ln(y))


def to_fixed(x: Column, digits: int) -> Column:
    """Text with so many decimals."""
    return F.format_string(f"%.{digits}f", _double(x))


def convert_base(x: Column, base: int) -> Column:
    """Lower-case text of a whole number in a base from 2 to 36; else no value."""
    if not 2 <= base <= 36:
        return F.lit(None).cast("string")
    whole = F.floor(F.abs(_double(x)))
    text = F.lower(F.conv(whole.cast("string"), 10, base))
    return F.when(_double(x) == F.floor(_double(x)), F.when((_double(x) < 0) & (whole > 0), F.concat(F.lit("-"), text)).otherwise(text))


def range_values(start: Column, stop: Column) -> Column:
    """Array of start, start + 1, ... as far as stop, in either order; explode it for rows."""
    low, high = F.least(_double(start), _double(stop)), F.greatest(_double(start), _double(stop))
    steps = F.sequence(F.lit(0), F.floor(high - low).cast("int"))
    return F.when(low.isNotNull() & high.isNotNull() & start.isNotNull() & stop.isNotNull(), F.transform(steps, lambda i: low + i))


# Text.
def replace(text: Column, search: Column, substitute: Column) -> Column:
    return F.replace(text, search, substitute)


def character_at(text: Column, at: Column) -> Column:
    """The character at a place counted from 1; past the end there is no value."""
    return F.when((at >= 1) & (at <= F.length(text)), F.substr(text, at.cast("int"), F.lit(1)))


def uppercase(text: Column) -> Column:
    return F.upper(text)


def lowercase(text: Column) -> Column:
    return F.lower(text)


def index_of(text: Column, part: Column) -> Column:
    """The first place of ``part``, counted from 1; no value if there is none."""
    found = F.locate(part, text) if isinstance(part, str) else F.position(part, text)
    return F.when(found > 0, found)


def codepoint_length(text: Column) -> Column:
    return F.length(text)


def concat_values(*texts: Column) -> Column:
    return F.concat(*texts)


# The rest.
def random_number(seed: Column) -> Column:
    """A number from 0 up to 1 that depends on the seed only."""
    return F.pmod(F.xxhash64(seed.cast("string"), F.lit("random")), F.lit(1 << 53)).cast("double") / float(1 << 53)


def toggle(value: Column) -> Column:
    """true and false exchanged; other texts have no value."""
    return F.when(value == "true", "false").when(value == "false", "true")


#: Letters of date masks and what Spark calls them, longest first.
MASKS = [
    ("dddd", "EEEE"), ("ddd", "EEE"), ("dd", "dd"), ("d", "d"), ("mmmm", "MMMM"), ("mmm", "MMM"), ("mm", "MM"), ("m", "M"), ("yyyy", "yyyy"), ("yy", "yy"),
    ("HH", "HH"), ("H", "H"), ("hh", "hh"), ("h", "h"), ("MM", "mm"), ("M", "m"), ("ss", "ss"), ("s", "s"), ("TT", "a"), ("l", "SSS"),
]


def date_format(timestamp_ms: Column, mask: str) -> Column:
    """A time in milliseconds as text, in the session's time zone."""
    out, at = "", 0
    while at < len(mask):
        letters, spark = next(((a, b) for a, b in MASKS if mask.startswith(a, at)), (mask[at], "'" + mask[at] + "'" if mask[at].isalpha() else mask[at]))
        out, at = out + spark, at + len(letters)
    return F.date_format(F.timestamp_millis(timestamp_ms.cast("bigint")), out)


def defined(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns and keep the rows in which all of them have a value."""
    out = df.withColumns(columns)
    for name in columns:
        out = out.filter(F.col(name).isNotNull())
    return out


FUNCTIONS: dict[str, Callable] = {
    "compare/>": greater, "compare/>=": greater_or_equal, "compare/<": less, "compare/<=": less_or_equal, "compare/!=": not_equal, "compare/==": equal,
    "math/+": add, "math/-": subtract, "math/*": multiply, "math//": divide, "math/floor": floor, "math/ceiling": ceiling, "math/round": round_half_up,
    "math/sin": sine, "math/cos": cosine, "math/tan": tangent, "math/max": maximum, "math/min": minimum, "math/mod": modulo, "math/absolute": absolute,
    "math/pow": power, "math/ln": natural_log, "math/to-fixed": to_fixed, "math/convert-base": convert_base, "math/range": range_values,
    "string/replace": replace, "string/get": character_at, "string/uppercase": uppercase, "string/lowercase": lowercase, "string/index-of": index_of,
    "string/codepoint-length": codepoint_length, "random/number": random_number, "logic/toggle": toggle, "date/format": date_format, "internal/concat": concat_values, "internal/number-text": number_text,
}


def define_function(name: str, build: Callable[..., Column]) -> None:
    """Register a function of one's own: columns in, a column out (null: no value)."""
    if name in FUNCTIONS:
        raise ValueError(f"{name} is already defined")
    FUNCTIONS[name] = build


def apply(df: DataFrame, name: str, out: str, *args) -> DataFrame:
    """Add the function's value as ``out`` and keep the rows that have one.

    If ``out`` is already a column, rows whose column equals the value are kept instead.
    """
    value = FUNCTIONS[name](*args)
    if out in df.columns:
        return df.filter(F.col(out) == value)
    return defined(df, **{out: value})


def apply_rows(df: DataFrame, name: str, out: str, *args) -> DataFrame:
    """A row for each element of a row-making function's array."""
    return df.withColumn(out, F.explode(FUNCTIONS[name](*args)))
