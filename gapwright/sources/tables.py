"""Sources and sinks: delimited files, sentinels, slices, synthetic tables, a registry."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwright.errors import GapTypeError, GapValueError
from gapwright.functions.cells import is_numeric, zero_to_missing
from gapwright.operators.timegrid import regularise


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, sep: str = ",", header: bool = True, null_value: str = "") -> DataFrame:
    """A delimited file; without a schema it is inferred in one more pass."""
    reader = spark.read.option("sep", sep).option("header", header).option("nullValue", null_value)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_series_csv(spark: SparkSession, path: str, step: int | str, schema: str | T.StructType | None = None, sep: str = ",") -> DataFrame:
    """A delimited file whose first column is the time, on a fixed grid."""
    df = read_csv(spark, path, schema, sep)
    time_col = df.columns[0]
    df = df.withColumn(time_col, F.to_timestamp_ntz(F.col(time_col).cast("string")))
    return regularise(df, time_col, step).drop("__ord")


def from_rows(spark: SparkSession, data: object, columns: list[str] | None = None) -> DataFrame:
    """A numeric matrix, a pandas frame or an Arrow table as a DataFrame."""
    import numpy as np
    import pandas as pd

    if isinstance(data, DataFrame):
        if data.isStreaming:
            raise GapTypeError("a streaming table cannot be fitted")
        return data
    if isinstance(data, np.ndarray):
        if data.ndim != 2 or data.dtype.kind not in "fiu":
            raise GapValueError("a matrix must be numeric and of two dimensions")
        data = pd.DataFrame(data, columns=columns or [f"col_{i}" for i in range(data.shape[1])])
    return spark.createDataFrame(data)


def zeros_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Zeros in numeric columns become NULL, for sources that write 0 for no reading."""
    names = columns or [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    return df.withColumns({c: zero_to_missing(c) for c in names})


def slice_rows(df: DataFrame, order: str, rows: int, columns: list[str] | None = None) -> DataFrame:
    """The first rows by an order, and some columns."""
    return df.orderBy(order).limit(rows).select(*(columns or df.columns))


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without a missing cell (NULL or NaN)."""
    return df.na.drop("any")


def synthetic_mixed(spark: SparkSession, seed: int = 0, rows: int = 1200) -> DataFrame:
    """Three numbers, two labels and a flag that depend on one another; made by the tasks."""
    u = [F.rand(seed + i) for i in range(6)]
    base = spark.range(rows).select("id", *(x.alias(f"u{i}") for i, x in enumerate(u)))
    age = (F.lit(18) + 60 * F.col("u0")).alias("age")
    income = (F.lit(20000) + 900 * 60 * F.col("u0") + 8000 * F.col("u1")).alias("income")
    points = (0.5 * F.col("u0") + 0.5 * F.col("u2")).alias("score")
    segment = F.when(F.col("u0") < 0.33, "young").when(F.col("u0") < 0.66, "middle").otherwise("senior").alias("segment")
    region = F.element_at(F.array(*(F.lit(x) for x in ("north", "south", "east", "west"))), (F.floor(F.col("u3") * 4) + 1).cast("int")).alias("region")
    return base.select(age, income, points, segment, region, (F.col("u0") + F.col("u4") > 1).alias("is_active"))


def checked_file(path: str, expected: str, algorithm: str = "sha256") -> str:
    """A local file's path, if its content has the expected digest."""
    digest = hashlib.new(algorithm)
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            digest.update(block)
    if digest.hexdigest() != expected:
        raise GapValueError(f"{path} is not the expected file")
    return path


#: Loaders by name: (kind, loader of (spark, path), arguments of the imputer).
REGISTRY: dict[str, tuple[str, Callable[..., DataFrame], dict]] = {
    "synthetic_mixed": ("table", lambda spark, path=None: synthetic_mixed(spark), {}),
    "csv": ("table", read_csv, {}),
    "csv_zero_missing": ("table", lambda spark, path: zeros_missing(read_csv(spark, path)), {}),
    "csv_series": ("series", lambda spark, path: read_series_csv(spark, path, 300_000_000), {"lags": (1, 2, 3, -1, -2, -3)}),
}


def write(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet, ORC, JSON or CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)
