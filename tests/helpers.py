"""Shared by tests: small frames with gaps and a plain NumPy model of the imputer."""

import numpy as np
import pandas as pd


def holes(n, k, share, seed, offset=0.0, scale=1.0):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 3)) @ draw.normal(size=(3, k)) + 0.3 * draw.normal(size=(n, k))
    x = x * scale + offset
    full = x.copy()
    x[draw.random(x.shape) < share] = np.nan
    return x, full


def frame(spark, x, names="abcdefghijklmnopqrstuvwxyz"):
    return spark.createDataFrame(pd.DataFrame({"row": np.arange(len(x)), **{names[j]: x[:, j] for j in range(x.shape[1])}}))


def plain_ridge(x, alpha=0.01, least=20, normalize=True):
    """Every cell from the rows complete for its pattern; NaN where there are too few."""
    mean, std = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    z = (x - mean) / std if normalize else x
    out = x.copy()
    for i, c in np.argwhere(np.isnan(x)):
        use = [j for j in range(x.shape[1]) if j != c and not np.isnan(x[i, j])]
        rows = ~np.isnan(z[:, [*use, c]]).any(axis=1)
        if not use or rows.sum() < least:
            continue
        X, y = z[rows][:, use], z[rows, c]
        coef = np.linalg.solve((X - X.mean(0)).T @ (X - X.mean(0)) + alpha * np.eye(len(use)), (X - X.mean(0)).T @ (y - y.mean()))
        value = y.mean() + (z[i, use] - X.mean(0)) @ coef
        out[i, c] = value * std[c] + mean[c] if normalize else value
    return out


def values(df, columns):
    return df.orderBy("row").select(*columns).toPandas().to_numpy(dtype=float)
