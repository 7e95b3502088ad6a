"""One-pass column profiles and standardisation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwright.errors import GapTypeError, GapValueError
from gapwright.functions.cells import FLOATS, is_label, is_numeric, missing_sql, number, number_sql, quoted
from gapwright.operators.masks import mask

#: Up to so many columns the profile is one SQL aggregate; beyond, code for thousands of sums costs more than it saves.
SQL_COLUMNS = 64


@dataclass
class ColumnProfile:
    count: int
    mean: float
    std: float
    infinite: bool = False

    @property
    def scale(self) -> float:
        return self.std if self.std and self.std > 0 else 1.0


def check_schema(df: DataFrame) -> None:
    """Refuses streams and columns that are neither numbers, labels nor void."""
    if df.isStreaming:
        raise GapTypeError("a streaming table cannot be fitted; fit a batch table and apply it to the stream")
    for f in df.schema.fields:
        if not (is_numeric(f.dataType) or is_label(f.dataType) or isinstance(f.dataType, T.NullType)):
            raise GapValueError(f"column {f.name} has the unsupported type {f.dataType.simpleString()}")


@dataclass
class TableProfile:
    """Profiles by column, the rows, and about how many distinct masks there are (if asked for)."""

    columns: dict[str, ColumnProfile]
    rows: int
    masks: int | None = None


def profile_row(df: DataFrame, with_masks: bool = False) -> DataFrame:
    """One row: for every column count, and for numbers mean, population std and infinities.

    All in one aggregate, so a table is read once; Spark's central moments are
    stable and merge between tasks.
    """
    out = [F.count("*").alias(":rows")]
    if with_masks:
        known = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NullType)]
        out.append(F.approx_count_distinct(mask(df.schema, known), 0.05).alias(":masks"))
    for f in df.schema.fields:
        name, kind = f.name, f.dataType
        out.append(F.expr(f"count_if(not {missing_sql(name, kind)}) as {quoted(name + ':n')}"))
        if is_numeric(kind):
            x = number_sql(name, kind)
            out += [F.expr(f"avg({x}) as {quoted(name + ':mean')}"), F.expr(f"stddev_pop({x}) as {quoted(name + ':std')}")]
            if isinstance(kind, FLOATS):
                out.append(F.expr(f"max(abs({x}) = double('infinity')) as {quoted(name + ':inf')}"))
    return df.agg(*out)


def _wide_profile(df: DataFrame) -> TableProfile:
    """As ``profile_all`` for many columns: tasks sum whole batches of numbers.

    Each task gives count, sum and squared deviations from its own mean of
    every column; these merge by the parallel variance formula.
    """
    numbers = [f for f in df.schema.fields if is_numeric(f.dataType)]
    others = [f for f in df.schema.fields if not is_numeric(f.dataType)]
    counted = others and df.agg(*(F.expr(f"count_if(not {missing_sql(f.name, f.dataType)}) as {quoted(f.name)}") for f in others)).first()
    cells = ", ".join(f"coalesce({number_sql(f.name, f.dataType)}, double('nan'))" for f in numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n, total, m2, odd = 0, np.zeros(len(numbers)), np.zeros(len(numbers)), np.zeros(len(numbers)), np.zeros(len(numbers), bool)
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, len(numbers))
            seen = ~np.isnan(x)
            odd |= np.isinf(x).any(axis=0)
            x = np.where(seen & np.isfinite(x), x, 0)
            k, s = seen.sum(axis=0), x.sum(axis=0)
            mean = s / np.maximum(k, 1)
            d2 = (np.where(seen, x - mean, 0) ** 2).sum(axis=0)
            gap = mean - total / np.maximum(n, 1)
            m2 += d2 + np.where((n > 0) & (k > 0), gap**2 * n * k / np.maximum(n + k, 1), 0)
            rows, n, total = rows + batch.num_rows, n + k, total + s
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(numbers)), pa.int32()), pa.array(np.full(len(numbers), rows)), pa.array(n), pa.array(total), pa.array(m2), pa.array(odd)],
            ["i", "rows", "n", "s", "m2", "odd"],
        )

    parts = df.select(F.expr(f"array({cells})")).mapInArrow(run, "i int, rows bigint, n double, s double, m2 double, odd boolean")
    merged = parts.groupBy("i").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("odd").alias("odd"),
        F.sum(F.expr("m2 + if(n > 0, s * s / n, 0)")).alias("q"),
    )
    found, rows = {}, 0
    for r in merged.collect():  # one row a column
        name, n, rows = numbers[r["i"]].name, r["n"], r["rows"]
        if r["odd"]:
            raise GapValueError(f"column {name} holds infinite values")
        mean = r["s"] / n if n else 0.0
        spread = max(r["q"] - n * mean * mean, 0.0) if n else 0.0
        # what cancellation leaves of a constant column is no spread
        found[name] = ColumnProfile(int(n), mean, math.sqrt(spread / n) if n and spread > 1e-14 * r["q"] else 0.0)
    for f in others:
        found[f.name] = ColumnProfile(counted[f.name], 0.0, 0.0)
    return TableProfile({c: found.get(c, ColumnProfile(0, 0.0, 0.0)) for c in df.columns}, rows)


def profile_all(df: DataFrame, with_masks: bool = False) -> TableProfile:
    """The profile of every column; infinities are refused."""
    if len(df.columns) > SQL_COLUMNS:
        return _wide_profile(df)
    row = profile_row(df, with_masks).first().asDict()
    found = {}
    for name in df.columns:
        if row.get(f"{name}:inf"):
            raise GapValueError(f"column {name} holds infinite values")
        found[name] = ColumnProfile(row[f"{name}:n"], row.get(f"{name}:mean") or 0.0, row.get(f"{name}:std") or 0.0)
    return TableProfile(found, row[":rows"], row.get(":masks"))


def profile(df: DataFrame) -> dict[str, ColumnProfile]:
    """The profile of every column, by name."""
    return profile_all(df).columns


def profile_table(df: DataFrame) -> DataFrame:
    """(column, observed, missing, mean, std) of the numeric columns, as a table."""
    names = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    wide = profile_row(df.select(*(F.col(f"`{n}`") for n in names))).withColumnRenamed(":rows", "rows")
    parts = [
        F.struct(F.lit(n).alias("column"), F.col(f"`{n}:n`").alias("observed"), (F.col("rows") - F.col(f"`{n}:n`")).alias("missing"),
                 F.col(f"`{n}:mean`").alias("mean"), F.col(f"`{n}:std`").alias("std"))
        for n in names
    ]
    return wide.select(F.inline(F.array(*parts)))


def standardise(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """Adds (x - mean) / std of each column; the scale of a constant column is 1."""
    found = profile(df.select(*columns))
    z = {c + suffix: (number(c, df.schema[c].dataType) - found[c].mean) / found[c].scale for c in columns}
    return df.withColumns(z)


def all_missing(df: DataFrame) -> list[str]:
    """Columns without any observed cell."""
    return [c for c, p in profile(df).items() if p.count == 0]
