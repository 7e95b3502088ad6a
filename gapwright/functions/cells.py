"""Cell-level expressions: what is missing, its number, and the way back to a type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.FloatType, T.DoubleType)
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
LABELS = (T.StringType, T.VarcharType, T.CharType, T.BooleanType)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (*FLOATS, *INTEGERS, T.DecimalType))


def is_label(kind: T.DataType) -> bool:
    return isinstance(kind, LABELS)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def missing_sql(name: str, kind: T.DataType) -> str:
    c = quoted(name)
    return f"({c} is null or isnan({c}))" if isinstance(kind, FLOATS) else f"({c} is null)"


def number_sql(name: str, kind: T.DataType) -> str:
    c = quoted(name)
    return f"if(isnan({c}), null, cast({c} as double))" if isinstance(kind, FLOATS) else f"cast({c} as double)"


def missing(name: str, kind: T.DataType) -> Column:
    """NULL, and NaN in floating columns."""
    return F.expr(missing_sql(name, kind))


def number(name: str, kind: T.DataType) -> Column:
    """The cell as a double, NULL where missing."""
    return F.expr(number_sql(name, kind))


def restore(value: Column, kind: T.DataType) -> Column:
    """A double as ``kind``: integers are rounded half to even; NULL if out of range."""
    if isinstance(kind, INTEGERS):
        return F.rint(value).try_cast(kind)
    return value.try_cast(kind)


def relu(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def zero_to_missing(name: str) -> Column:
    """NULL for cells that hold the sentinel 0."""
    return F.nullif(F.col(f"`{name}`"), F.lit(0)).alias(name)
