"""Benchmark runs: hide cells, impute, and score what was filled."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.errors import GapValueError
from gapwright.functions.cells import is_numeric
from gapwright.operators.inject import at_random, block_starts, blocks
from gapwright.operators.numbering import numbered
from gapwright.operators.quality import classification_quality, coverage, numeric_quality
from gapwright.operators.series_imputer import SeriesImputer
from gapwright.operators.table_imputer import TableImputer, free_prefix
from gapwright.operators.timegrid import regularise
from gapwright.sources.datasets import DATASETS
from gapwright.sources.tables import complete_rows, write

#: Ways to hide cells: name to (kind, arguments).
PATTERNS: dict[str, tuple[str, dict]] = {
    "MAR_0.10": ("mar", {"ratio": 0.10}),
    "Blocks_0.20x0.30": ("blocks", {"length_ratio": 0.20, "frac_columns": 0.30}),
}


def hide(df: DataFrame, order: str, columns: list[str], pattern: str, seed: int = 0) -> DataFrame:
    """``df`` with cells of ``columns`` hidden; only observed cells count as hidden later."""
    kind, how = PATTERNS[pattern]
    if kind == "mar":
        return at_random(df, how["ratio"], columns, seed, order)
    starts, length = block_starts(columns, df.count(), how["frac_columns"], how["length_ratio"], seed)
    return blocks(df, starts, length, order)


def score(truth: DataFrame, hidden: DataFrame, filled: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """One row: numeric and label scores over the hidden cells, and how many were filled.

    The three tables are joined on ``order``, a unique number of each row.
    """
    names = lambda df, mark: df.select(F.col(f"`{order}`").alias("__o"), *(F.col(f"`{c}`").alias(f"{mark}{c}") for c in columns))
    wide = names(truth, "t_").join(names(hidden, "h_"), "__o").join(names(filled, "f_"), "__o")
    gone = {c: F.col(f"`h_{c}`").isNull() & F.col(f"`t_{c}`").isNotNull() for c in columns}
    numbers = [c for c in columns if is_numeric(truth.schema[c].dataType)]
    labels = [c for c in columns if c not in numbers]

    def pairs(chosen: list[str], kind: str) -> DataFrame:
        cells = F.array(*(F.struct(gone[c].alias("g"), F.col(f"`t_{c}`").cast(kind).alias("t"), F.col(f"`f_{c}`").cast(kind).alias("f")) for c in chosen))
        return wide.select(F.explode(cells).alias("x")).where("x.g").select("x.t", "x.f")

    parts = []
    if numbers:
        parts.append(numeric_quality(pairs(numbers, "double"), F.col("t"), F.col("f")))
    if labels:
        parts.append(classification_quality(pairs(labels, "string"), F.col("t"), F.col("f")))
    done = coverage(wide, gone, {c: F.col(f"`f_{c}`") for c in columns})
    parts.append(done.agg(F.sum("masked").alias("masked"), F.sum("filled").alias("filled"), F.try_divide(F.sum("filled"), F.sum("masked")).alias("coverage")))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row by one row
    return out


def run_table(df: DataFrame, pattern: str, seed: int = 0, **call) -> DataFrame:
    """Hides cells of the complete rows of a table, imputes and scores; adds the seconds taken.

    Rows are numbered in the order of all columns; equal rows may change places,
    which changes nothing.
    """
    row = f"{free_prefix(df.columns)}row"
    truth, _ = numbered(complete_rows(df), df.columns, row)
    return _run(truth, row, df.columns, pattern, seed, lambda hidden: TableImputer().fit_table(hidden, beside=[row], **call).apply_beside(hidden))


def run_series(df: DataFrame, time_col: str, step: int | str | None, pattern: str, seed: int = 0, lags: tuple[int, ...] = (1, 2, 3, -1, -2, -3), **call) -> DataFrame:
    """As ``run_table`` for a series: only observed cells of the grid are hidden."""
    truth = regularise(df, time_col, step)
    columns = [c for c in df.columns if c != time_col]

    def fill(hidden: DataFrame) -> DataFrame:
        out = SeriesImputer(time_col, lags, step).impute(hidden.drop("__ord"), **call)
        return out.join(hidden.select(time_col, "__ord"), time_col)

    return _run(truth, "__ord", columns, pattern, seed, fill)


def _run(truth: DataFrame, order: str, columns: list[str], pattern: str, seed: int, fill: Callable[[DataFrame], DataFrame]) -> DataFrame:
    if pattern not in PATTERNS:
        raise GapValueError(f"unknown pattern {pattern}; known are {sorted(PATTERNS)}")
    hidden = hide(truth, order, columns, pattern, seed)
    began = time.time()
    found = score(truth, hidden, fill(hidden), order, columns).toArrow()
    took = time.time() - began
    out = truth.sparkSession.createDataFrame(found)
    return out.withColumns({"pattern": F.lit(pattern), "seconds": F.lit(took)})


def run_suite(spark, names: list[str] | None = None, seed: int = 0, folder: str = "", out: str | None = None, check: bool = True) -> DataFrame:
    """All patterns over datasets whose files lie in ``folder`` (by default those that need none),
    one row each; also written as CSV to ``out``."""
    found = None
    for name in names or [n for n, d in DATASETS.items() if d.make]:
        if name not in DATASETS:
            raise GapValueError(f"unknown dataset {name}; known are {sorted(DATASETS)}")
        dataset = DATASETS[name]
        df = dataset.load(spark, folder, check)
        for pattern in PATTERNS:
            row = run_series(df, "time", dataset.step, pattern, seed, **dataset.call) if dataset.kind == "series" else run_table(df, pattern, seed, **dataset.call)
            row = row.withColumn("dataset", F.lit(name))
            found = row if found is None else found.unionByName(row, allowMissingColumns=True)
    if out:
        write(found.coalesce(1), out, "csv")  # some rows a dataset
    return found
