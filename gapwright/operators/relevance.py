"""Feature relevance from mask moments, and the nearest features of each target."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from gapwright.errors import GapValueError
from gapwright.operators.columns import Encoding
from gapwright.operators.moments import Moments

Scoring = Callable[[Moments, Encoding, list[int]], np.ndarray]


def relevance(moments: Moments, encoding: Encoding, targets: list[int]) -> np.ndarray:
    """(targets, features): the share of rows with both observed, times the
    absolute correlation of the columns with their gaps filled by the mean.

    Rolled up from the sums by mask; a constant column gives NaN.
    """
    e = len(encoding.features)
    total = max(1, int(moments.rows.sum()))
    seen = np.array([[not m & encoding.bit(i) for i in range(e)] for m in moments.masks], dtype=float).reshape(-1, e)
    sums = np.einsum("mi,mi->i", seen, moments.gram[:, :e, e])
    count = seen.T @ moments.rows
    mean = np.divide(sums, count, out=np.zeros(e), where=count > 0)
    # missing cells are 0 in the sums, so a product only counts where both are there
    shared = seen.T @ (moments.rows[:, None] * seen)
    cross = moments.gram[:, :e, :e].sum(axis=0)
    by_i = moments.gram[:, :e, e].T @ seen
    by_j = by_i.T
    dev = cross - mean[None, :] * by_i - mean[:, None] * by_j + shared * np.outer(mean, mean)
    var = np.where(np.diag(dev) > 1e-12 * np.maximum(1, np.abs(np.diag(cross))), np.diag(dev), np.nan)
    with np.errstate(invalid="ignore"):
        score = shared / total * np.abs(dev) / np.sqrt(np.outer(var, var))
    return score[targets]


def how_many(n_nearest: int | float | None, features: int) -> int | None:
    """A count as it is; a fraction in (0, 1] of the encoded features."""
    if n_nearest is None:
        return None
    if isinstance(n_nearest, bool) or not isinstance(n_nearest, (int, float)):
        raise GapValueError("n_nearest_features must be an integer or a fraction")
    if isinstance(n_nearest, float):
        if not 0 < n_nearest <= 1:
            raise GapValueError("n_nearest_features as a fraction must be above 0 and at most 1")
        n_nearest = int(n_nearest * features)
    if n_nearest < 1:
        raise GapValueError("n_nearest_features must leave at least one feature")
    return n_nearest


def nearest(score: np.ndarray, target: int, candidates: list[int], k: int | None) -> list[int]:
    """The k best candidates, in column order; NaN scores last, ties to the lower column."""
    if k is None or k >= len(candidates):
        return candidates
    order = sorted(candidates, key=lambda j: (np.isnan(score[j]), -score[j] if not np.isnan(score[j]) else 0.0, j))
    return sorted(order[:k])
