"""Synthetic missingness, by chance, by key and in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwright.errors import GapValueError


def blank(df: DataFrame, where: dict[str, Column]) -> DataFrame:
    """NULL in each named column where its condition holds; types stay."""
    return df.withColumns({c: F.when(~F.coalesce(cond, F.lit(False)), F.col(f"`{c}`")) for c, cond in where.items()})


def at_random(df: DataFrame, ratio: float, columns: list[str] | None = None, seed: int = 0, key: str | None = None) -> DataFrame:
    """Each cell goes with probability ``ratio``, whatever the data.

    With a ``key`` column, that tells rows apart, the draw is a hash of seed,
    column and key: the same in every evaluation of every plan.
    """
    if not 0 <= ratio <= 1:
        raise GapValueError("the ratio must lie between 0 and 1")
    if key is None:
        return blank(df, {c: F.rand(seed + i) < ratio for i, c in enumerate(columns or df.columns)})
    chosen = columns or [c for c in df.columns if c != key]
    draw = lambda c: F.pmod(F.xxhash64(F.lit(seed), F.lit(c), F.col(f"`{key}`")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return blank(df, {c: draw(c) < ratio for c in chosen})


def by_key(df: DataFrame, column: str, expression: Column, every: int) -> DataFrame:
    """Cells whose integer key expression is divisible by ``every`` go; the same in every run and engine."""
    return blank(df, {column: expression % every == 0})


def blocks(df: DataFrame, starts: dict[str, int], length: int, order: str) -> DataFrame:
    """``length`` rows in a row go in each column from its start; ``order`` numbers rows from 0."""
    if length < 1:
        raise GapValueError("a block has one row at least")
    return blank(df, {c: F.col(order).between(s, s + length - 1) for c, s in starts.items()})


def block_starts(columns: list[str], rows: int, frac_columns: float, length_ratio: float, seed: int = 0) -> tuple[dict[str, int], int]:
    """A random choice of columns (one at least) and of starts for blocks of a share of the rows."""
    import numpy as np

    draw = np.random.default_rng(seed)
    chosen = draw.choice(len(columns), size=max(1, int(len(columns) * frac_columns)), replace=False)
    length = max(1, int(rows * length_ratio))
    return {columns[i]: int(draw.integers(0, max(1, rows - length + 1))) for i in sorted(chosen)}, length
