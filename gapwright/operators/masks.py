"""Missingness masks: one bit a column, and what follows from them."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwright.errors import GapValueError
from gapwright.functions.cells import missing_sql

#: Bits of a BIGINT mask; wider tables use a text of 0 and 1.
WORD = 62


def mask(schema: T.StructType, columns: list[str]) -> Column:
    """Bit i is set where ``columns[i]`` is missing."""
    lacks = [missing_sql(c, schema[c].dataType) for c in columns]
    if len(columns) > WORD:
        return F.expr("concat(" + ", ".join(f"if({x}, '1', '0')" for x in reversed(lacks)) + ")")
    return F.expr(" | ".join(["0L", *(f"if({x}, {1 << i}L, 0L)" for i, x in enumerate(lacks))]))


def as_int(value: int | str) -> int:
    """A collected mask as a Python int."""
    return int(value, 2) if isinstance(value, str) else int(value)


def vector(values: Iterable[int], columns: int) -> np.ndarray:
    """Masks as an array that & works on: words if they fit, else Python ints."""
    return np.array(list(values), dtype=np.int64 if columns <= WORD else object)


def admitted(values: np.ndarray, need: np.ndarray) -> np.ndarray:
    """[needs, masks]: which masks lack none of the needed bits."""
    return np.equal(values[None, :] & need[:, None], 0).astype(bool)


def bits(columns: list[str], of: Iterable[str]) -> int:
    return sum(1 << columns.index(c) for c in of)


def groups(df: DataFrame, columns: list[str]) -> DataFrame:
    """(mask, n_missing, rows): the distinct masks of a table."""
    if len(columns) > WORD:
        raise GapValueError(f"at most {WORD} columns have a mask of one word")
    found = df.groupBy(mask(df.schema, columns).alias("mask")).agg(F.count("*").alias("rows"))
    return found.select("mask", F.bit_count("mask").alias("n_missing"), "rows")


def complete(df: DataFrame, columns: list[str], needed: list[str]) -> DataFrame:
    """Rows that are complete in ``needed``."""
    return df.where(mask(df.schema, columns).bitwiseAND(F.lit(bits(columns, needed)).cast("bigint")) == 0)


def trainable(mask_groups: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(pattern, usable, rows): of each pattern of rows that lack ``target``, the
    rows of the table that can train its model: their missing columns are among
    the pattern's.

    A containment join of the mask groups with themselves, so its size is that
    of the distinct masks and not of the rows.
    """
    bit = 1 << columns.index(target)
    full = (1 << len(columns)) - 1
    wanted = mask_groups.where(F.col("mask").bitwiseAND(F.lit(bit)) != 0).select(F.col("mask").alias("pattern"))
    need = F.bitwise_not(F.col("pattern")).bitwiseAND(F.lit(full)).bitwiseOR(F.lit(bit))
    pairs = wanted.join(mask_groups, F.col("mask").bitwiseAND(need) == 0, "left")
    usable = F.lit(len(columns)) - F.bit_count("pattern")
    return pairs.groupBy("pattern").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).select("pattern", usable.alias("usable"), "rows")
