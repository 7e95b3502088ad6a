"""Ridge models from Gram matrices, many patterns at once."""

from __future__ import annotations

import numpy as np

from gapwright.errors import GapValueError
from gapwright.operators import masks

#: Patterns that are solved side by side.
BATCH = 512


def _compact(gram: np.ndarray, columns: np.ndarray, target: int, alpha: float, fit_intercept: bool) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients [p, k] and intercepts of systems with k features each, ``columns`` [p, k]."""
    p, k = columns.shape
    of = np.arange(p)[:, None]
    take = np.concatenate([columns, np.full((p, 1), target)], axis=1)
    sums, rows = gram[of, take, -1], gram[:, -1, -1]
    spread = gram[of[:, :, None], take[:, :, None], take[:, None, :]]
    if fit_intercept:
        spread -= sums[:, :, None] * (sums / rows[:, None])[:, None, :]
    left, right = spread[:, :k, :k] + alpha * np.eye(k), spread[:, :k, k:]
    if not k:
        coef = np.zeros((p, 0))
    elif alpha > 0:
        coef = np.linalg.solve(left, right)[:, :, 0]
    else:
        coef = np.stack([np.linalg.lstsq(a, b[:, 0], rcond=None)[0] for a, b in zip(left, right, strict=True)])
    level = (sums[:, k] - np.einsum("pk,pk->p", coef, sums[:, :k])) / rows if fit_intercept else np.zeros(p)
    return coef, level


def from_gram(gram: np.ndarray, target: int, features: np.ndarray, alpha: float = 0.01, fit_intercept: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients[p, e], intercept[p]) for Grams [p, e+1, e+1] of [z, 1].

    ``features`` [p, e] says which columns a model uses.  Models of equally many
    features are cut out of their Grams and solved side by side.  ``alpha`` is
    added to the diagonal of the (centred) sums; the intercept is not penalised.
    """
    coef, intercept = np.zeros(features.shape), np.zeros(len(gram))
    sizes = features.sum(axis=1)
    for k in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == k)
        for at in range(0, len(which), BATCH):
            part = which[at : at + BATCH]
            columns = np.nonzero(features[part])[1].reshape(len(part), k)
            coef[part[:, None], columns], intercept[part] = _compact(gram[part], columns, target, alpha, fit_intercept)
    return coef, intercept


def roll_up(values: np.ndarray, need: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Of each pattern: the sums over the mask groups that lack none of its needed bits."""
    out = np.zeros((len(need), *gram.shape[1:]))
    flat = gram.reshape(len(gram), -1)
    for at in range(0, len(need), BATCH):
        part = masks.admitted(values, need[at : at + BATCH]).astype(float)
        out[at : at + BATCH] = (part @ flat).reshape(-1, *gram.shape[1:])
    return out


class Ridge:
    """Ridge regression on arrays, for use as an estimator object."""

    def __init__(self, alpha: float = 0.01, fit_intercept: bool = True):
        if alpha < 0:
            raise GapValueError("alpha must not be negative")
        self.alpha, self.fit_intercept = alpha, fit_intercept

    def fit(self, X: np.ndarray, y: np.ndarray) -> Ridge:
        centre = X.mean(axis=0) if self.fit_intercept else np.zeros(X.shape[1])
        z = np.concatenate([X - centre, y[:, None], np.ones((len(X), 1))], axis=1).astype(float)
        features = np.ones((1, X.shape[1] + 1), dtype=bool)
        features[0, -1] = False
        coef, intercept = from_gram((z.T @ z)[None], X.shape[1], features, self.alpha, self.fit_intercept)
        self.coef_, self.intercept_ = coef[0, :-1], float(intercept[0] - coef[0, :-1] @ centre)
        return self

    def predict(self, X: np.ndarray) -> np.ndarray:
        return X @ self.coef_ + self.intercept_
