"""Sums of products per missingness mask: one aggregate that serves every model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwright.errors import GapValueError
from gapwright.operators import masks
from gapwright.operators.columns import Encoding

#: Up to so many features the sums are SQL aggregates; beyond, Arrow-batched partial sums.
SQL_FEATURES = 16
#: Bytes of distinct masks and their sums that the driver takes.
DRIVER_BYTES = 512 << 20


@dataclass
class Moments:
    """Of each distinct mask: rows, selected rows, and the Gram matrix of [features, 1] with missing as 0."""

    masks: list[int]
    keys: list[int | str]
    rows: np.ndarray
    selected: np.ndarray
    gram: np.ndarray


def gram_columns(values: list[Column]) -> list[Column]:
    """sum(z_i z_j) for i <= j over the values and a constant 1."""
    z = [F.coalesce(v, F.lit(0.0)) for v in values]
    out = []
    for i in range(len(z)):
        out += [F.sum(z[i] * z[j]).alias(f"g_{i}_{j}") for j in range(i, len(z))]
        out.append(F.sum(z[i]).alias(f"g_{i}_{len(z)}"))
    return out


def sql_moments(df: DataFrame, encoding: Encoding, selected: Column | None = None) -> DataFrame:
    """(mask, rows, selected, g_i_j…) by partial and final hash aggregation."""
    chosen = F.lit(1) if selected is None else F.when(selected, 1).otherwise(0)
    rows = df.select(masks.mask(encoding.schema, encoding.sources).alias("mask"), chosen.alias("sel"), *(v.alias(f"z{i}") for i, v in enumerate(encoding.values())))
    z = [F.col(f"z{i}") for i in range(len(encoding.features))]
    return rows.groupBy("mask").agg(F.count("*").alias("rows"), F.sum("sel").alias("selected"), *gram_columns(z))


def arrow_moments(df: DataFrame, encoding: Encoding, selected: Column | None = None) -> DataFrame:
    """(mask, rows, selected, gram): each task sums its own batches by mask, then masks are summed."""
    e = len(encoding.features)
    chosen = F.lit(1) if selected is None else F.when(selected, 1).otherwise(0)
    rows = df.select(masks.mask(encoding.schema, encoding.sources).alias("mask"), chosen.alias("sel"), F.array(*(F.coalesce(v, F.lit(0.0)) for v in encoding.values())).alias("z"))
    kind = rows.schema["mask"].dataType.simpleString()
    top = np.triu_indices(e + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("mask").dictionary_encode()
            which = np.asarray(coded.indices)
            z = np.asarray(batch.column("z").flatten()).reshape(batch.num_rows, e)
            z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
            sel = np.asarray(batch.column("sel"))
            grams = []
            order = np.argsort(which, kind="stable")
            cuts = np.cumsum(np.bincount(which, minlength=len(coded.dictionary)))[:-1]
            for part in np.split(order, cuts):
                grams.append((z[part].T @ z[part])[top])
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary, pa.array(np.bincount(which, minlength=len(grams))), pa.array(np.bincount(which, weights=sel, minlength=len(grams)).astype(np.int64)), pa.array(grams, pa.list_(pa.float64()))],
                ["mask", "rows", "selected", "gram"],
            )

    parts = rows.mapInArrow(run, f"mask {kind}, rows bigint, selected bigint, gram array<double>")
    cells = parts.select("mask", "rows", "selected", F.posexplode("gram").alias("at", "x"))
    sums = cells.groupBy("mask", "at").agg(F.sum("x").alias("x"), F.sum("rows").alias("rows"), F.sum("selected").alias("selected"))
    packed = sums.groupBy("mask").agg(F.max("rows").alias("rows"), F.max("selected").alias("selected"), F.array_sort(F.collect_list(F.struct("at", "x"))).alias("cells"))
    return packed.select("mask", "rows", "selected", F.transform("cells", lambda c: c["x"]).alias("gram"))


def collect(df: DataFrame, encoding: Encoding, selected: Column | None = None) -> Moments:
    """The compact table on the driver, behind a check of its size."""
    e = len(encoding.features)
    by_sql = e <= SQL_FEATURES
    table = sql_moments(df, encoding, selected) if by_sql else arrow_moments(df, encoding, selected)
    limit = max(1, DRIVER_BYTES // (8 * (e + 1) * (e + 2) // 2))
    found = table.limit(limit + 1).toArrow()
    if found.num_rows > limit:
        raise GapValueError(f"more than {limit} distinct missingness masks over {e} features; impute fewer columns at a time or set n_nearest_features")
    found = found.sort_by("mask") if found.num_rows else found
    n = found.num_rows
    gram = np.zeros((n, e + 1, e + 1))
    if by_sql:
        for i in range(e):
            for j in range(i, e + 1):
                gram[:, i, j] = gram[:, j, i] = np.asarray(found[f"g_{i}_{j}"]) if n else 0
    elif n:
        flat = np.asarray(found["gram"].combine_chunks().flatten()).reshape(n, -1)
        i, j = np.triu_indices(e + 1)
        gram[:, i, j] = gram[:, j, i] = flat
    keys = found["mask"].to_pylist()
    rows = np.asarray(found["rows"], dtype=np.int64) if n else np.zeros(0, np.int64)
    gram[:, e, e] = rows
    selected_rows = np.asarray(found["selected"], dtype=np.int64) if n else np.zeros(0, np.int64)
    return Moments([masks.as_int(k) for k in keys], keys, rows, selected_rows, gram)
