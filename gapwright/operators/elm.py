"""Extreme learning machine: a seeded random layer under a ridge."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.errors import GapValueError
from gapwright.operators.ridge import Ridge, from_gram


#: Parameters and what must hold of each.
PARAMETERS = {
    "n_features": lambda x: isinstance(x, int) and x >= 1,
    "alpha": lambda x: x >= 0,
    "random_state": lambda x: isinstance(x, int) and x >= 0,
    "min_samples_per_feature": lambda x: isinstance(x, int),
}


@lru_cache(maxsize=4096)
def _unit(seed: int, inputs: int, number: int) -> np.ndarray:
    """Weights and, last, the bias of one hidden unit, drawn from a seed of its own."""
    return np.random.default_rng((seed, inputs, number)).standard_normal(inputs + 1) / np.sqrt(inputs)


class RandomLayerRidge:
    """``n_features`` hidden units, max(x W + b, 0), then a ridge.

    Unit j of so many inputs is the same whatever the width.  There is at most
    one unit for ``min_samples_per_feature`` rows (0: no such bound).
    """

    def __init__(self, n_features: int = 100, alpha: float = 1.0, random_state: int = 0, min_samples_per_feature: int = 5):
        self.set_params(n_features=n_features, alpha=alpha, random_state=random_state, min_samples_per_feature=min_samples_per_feature)

    def get_params(self, deep: bool = True) -> dict:
        return {name: vars(self)[name] for name in PARAMETERS}

    def set_params(self, **params) -> RandomLayerRidge:
        for name, value in params.items():
            if name not in PARAMETERS:
                raise GapValueError(f"unknown parameter {name}")
            if not PARAMETERS[name](value):
                raise GapValueError(f"{name} cannot be {value}")
        vars(self).update(params)
        return self

    def width(self, rows: int) -> int:
        per = self.min_samples_per_feature
        return max(1, min(self.n_features, rows // per)) if per > 0 else self.n_features

    def hidden(self, X: np.ndarray, units: int) -> np.ndarray:
        layer = np.stack([_unit(self.random_state, X.shape[1], j) for j in range(units)], axis=1)
        return np.maximum(X @ layer[:-1] + layer[-1], 0)

    def fit(self, X: np.ndarray, y: np.ndarray) -> RandomLayerRidge:
        self.units_ = self.width(len(X))
        self.ridge_ = Ridge(self.alpha).fit(self.hidden(X, self.units_), y)
        return self

    def predict(self, X: np.ndarray) -> np.ndarray:
        return self.ridge_.predict(self.hidden(X, self.units_))

    def fit_table(self, df: DataFrame, features: list[str], target: str) -> RandomLayerRidge:
        """Fits on a whole table: every task sums the Gram matrix of its own
        hidden rows, and only these sums (one matrix) come together."""
        rows = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)), F.col(target).cast("double").alias("y")).na.drop("any")
        z = rows.select(F.array(*(f"x{i}" for i in range(len(features))), "y").alias("z"))
        use = [(tuple(range(len(features))), self.width(rows.count()))]
        return self.solve(self.sums(z, len(features), use, lambda batch: [None])[0])

    def sums(self, rows: DataFrame, target: int, plans: list[tuple[tuple[int, ...], int]], which: Callable[[pa.RecordBatch], list]) -> np.ndarray:
        """[plan, k, k]: of each (inputs, units), the Gram matrix of [hidden, y, 1] over all of its rows.

        ``rows`` have an array ``z`` that holds y at ``target``; ``which`` says of
        a batch which rows each plan takes (None for all).
        """
        size = max((units for _, units in plans), default=0) + 2
        top = np.triu_indices(size)
        hidden = self.hidden

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                values = np.asarray(batch.column("z").flatten(), dtype=float).reshape(batch.num_rows, -1)
                for i, ((use, units), at) in enumerate(zip(plans, which(batch), strict=True)):
                    x = values if at is None else values[at]
                    if not len(x):
                        continue
                    z = np.zeros((len(x), size))
                    z[:, :units], z[:, -2], z[:, -1] = hidden(x[:, list(use)], units), x[:, target], 1
                    total[i] = total.get(i, 0) + z.T @ z
            for i, gram in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top[0]), i), pa.int32()), pa.array(np.arange(len(top[0])), pa.int32()), pa.array(gram[top])], ["plan", "at", "x"])

        found = rows.mapInArrow(run, "plan int, at int, x double").groupBy("plan", "at").agg(F.sum("x").alias("x")).toArrow()
        gram = np.zeros((len(plans), size, size))
        if found.num_rows:
            i, at = np.asarray(found["plan"]), np.asarray(found["at"])
            gram[i, top[0][at], top[1][at]] = gram[i, top[1][at], top[0][at]] = np.asarray(found["x"])
        return gram

    def solve(self, gram: np.ndarray) -> RandomLayerRidge:
        """Takes the sums over some rows as its training."""
        k = len(gram) - 2
        self.units_ = min(k, self.width(int(round(gram[-1, -1]))))
        use = np.zeros((1, k + 1), dtype=bool)
        use[0, : self.units_] = True
        coef, intercept = from_gram(gram[None], k, use, self.alpha)
        self.ridge_ = Ridge(self.alpha)
        self.ridge_.coef_, self.ridge_.intercept_ = coef[0, : self.units_], float(intercept[0])
        return self
