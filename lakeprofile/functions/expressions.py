"""Column expressions that several operators publish numbers with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE_FLOOR, RATE_CEILING = 1e-6, 0.999999
CANDIDATE_KEY_RATIO = 0.9999
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
CLOCKED = (T.TimestampType, T.TimestampNTZType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
DAY = 86_400_000_000
NESTED = (T.ArrayType, T.MapType, T.StructType)


def family(kind: T.DataType) -> str:
    """The type family that decides what is measured of a column."""
    for name, kinds in (("boolean", (T.BooleanType,)), ("temporal", TEMPORAL), ("numeric", NUMERIC), ("binary", (T.BinaryType,)), ("text", (T.StringType, T.CharType, T.VarcharType)), ("json", (T.VariantType,)), ("nested", NESTED)):
        if isinstance(kind, kinds):
            return name
    return "unsupported"


def rate(part: Column, whole: Column) -> Column:
    """A share at six decimals that is 0 only for none and 1 only for all."""
    plain = F.round(part / whole, 6)
    return F.when(whole == 0, F.lit(0.0)).when((part > 0) & (plain < RATE_FLOOR), RATE_FLOOR).when((part < whole) & (plain > RATE_CEILING), RATE_CEILING).otherwise(plain)


def ratio(cardinality: Column, rows: Column) -> Column:
    """Distinct values a row, at six decimals, at least the floor where there is any."""
    return F.when((rows == 0) | (cardinality == 0), F.lit(0.0)).otherwise(F.greatest(F.round(cardinality / rows, 6), F.lit(RATE_FLOOR)))


def finite(c: Column, kind: T.DataType) -> Column:
    """``c``, or null where it is NaN or infinite."""
    if not isinstance(kind, FLOATING):
        return c
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def local(c: Column, kind: T.DataType) -> Column:
    """A date or time as a local time, an instant as that of UTC; the session's zone does not matter."""
    if isinstance(kind, T.TimestampType):
        return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit("1970-01-01").cast("timestamp_ntz"))
    return c.cast("timestamp_ntz")


def written(at: Column) -> Column:
    """A local time as text with six decimals."""
    text = at.cast("string")  # formatting functions would go through the session's zone
    return F.concat(F.translate(F.substring_index(text, ".", 1), " ", "T"), F.lit("."), F.rpad(F.when(text.contains("."), F.substring_index(text, ".", -1)).otherwise(""), 6, "0"))


def published(c: Column, kind: T.DataType) -> Column:
    """A value as the text that lists and samples show."""
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, T.TimestampType):
        return F.concat(written(local(c, kind)), F.lit("Z"))
    if isinstance(kind, T.TimestampNTZType):
        return written(c)
    return c.cast("string")


def micros(c: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970 of a date, an instant or a local time."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    if isinstance(kind, T.DateType):
        return days * DAY
    within = F.hour(c) * 3600 + F.minute(c) * 60
    return days * DAY + within.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def whole_day(c: Column, kind: T.DataType) -> Column:
    """Whether a time is the first instant of a day, of an instant's day in UTC."""
    if isinstance(kind, T.TimestampNTZType):
        return c == c.cast("date").cast("timestamp_ntz")
    return F.pmod(micros(c, kind), F.lit(DAY)) == 0


def representable(c: Column, kind: T.DataType) -> Column:
    """Whether the year of a date or time has four digits."""
    return F.year(local(c, kind).cast("date")).between(1, 9999)


def rounded(c: Column) -> Column:
    """A double at six decimals, or at six significant figures where those would leave nothing of it."""
    plain = F.round(c, 6)
    return F.when((plain == 0) & (c != 0), F.format_string("%.5e", c).cast("double")).otherwise(plain)


def low64(c: Column) -> Column:
    """The low eight bytes of the MD5 of a value's canonical text, unsigned."""
    return F.conv(F.substring(F.md5(c), 17, 16), 16, 10).cast("decimal(20,0)")


def folded(c: Column) -> Column:
    """What spellings of one value have in common."""
    return F.lower(F.trim(c))


def classification(kind: T.DataType, cardinality: Column, threshold: int = 50, foreign_key: bool = False, parts: bool = False) -> Column:
    """The semantic class; few distinct values make a column categorical before its type does, and ``parts`` says that nested columns are descended into."""
    group = family(kind)
    if group == "nested" and parts:
        return F.lit("vector" if is_vector(kind) else "composite")
    if group in ("nested", "unsupported"):
        return F.lit("unsupported")
    if group in ("boolean", "json"):
        return F.lit(group)
    if foreign_key:
        return F.lit("foreign_key_candidate")
    return F.when(cardinality <= threshold, "categorical").otherwise(group)


def is_vector(kind: T.DataType) -> bool:
    """Arrays of floating numbers are read as vectors."""
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, FLOATING)
