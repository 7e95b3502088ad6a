"""A fitted model on a stream: a projection and a join with a static table of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import DataStreamWriter

from gapwright.errors import GapTypeError
from gapwright.operators.table_imputer import Fitted


def impute_stream(fitted: Fitted, stream: DataFrame, selected: Column | None = None) -> DataFrame:
    """Fills a stream of rows like those the model was fitted on.

    Stateless: every row is filled from itself, so there is no watermark and
    no row is ever late.  Masks that the fitted table did not have get the mean
    or the mode.
    """
    if not stream.isStreaming:
        raise GapTypeError("not a streaming table; use apply")
    return fitted.apply(stream, selected)


def to_memory(df: DataFrame, name: str) -> DataStreamWriter:
    """A writer that runs what is there and stops; for tests and small backfills."""
    return df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
