"""Scores of imputed cells against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Values that are sorted on the driver once their ranks are known to be among them.
FEW_VALUES = 50_000


def middle(df: DataFrame, column: str) -> float | None:
    """The exact median of a double column without NULLs, by narrowing its range; None for no rows.

    Each pass estimates two bounds around the middle ranks and counts what lies
    below and at them, so no task holds more than its own rows; the passes grow
    with the logarithm of the table, by thousands.
    """
    x = F.col(f"`{column}`")
    total = df.count()
    if not total:
        return None
    ranks, found, inside, below, rows = [(total - 1) // 2, total // 2], {}, df, 0, total
    while rows > FEW_VALUES:
        share = [min(1.0, max(0.0, (r - below + d) / rows + e)) for r, d, e in ((ranks[0], 0, -0.002), (ranks[1], 1, 0.002))]
        low, high = inside.agg(F.percentile_approx(x, share, 10_000)).first()[0]
        c = inside.agg(F.count_if(x < low), F.count_if(x <= low), F.count_if(x < high), F.count_if(x <= high)).first()
        left = []
        for r in ranks:
            at = r - below
            if c[0] <= at < c[1]:
                found[r] = low
            elif c[2] <= at < c[3]:
                found[r] = high
            else:
                left.append(r)
        if not left:
            return (found[(total - 1) // 2] + found[total // 2]) / 2
        ranks = left
        inside, below, rows = inside.where((x > low) & (x < high)), below + c[1], c[2] - c[1]
    values = sorted(inside.select(x.alias("x")).toArrow()["x"].to_pylist())
    found |= {r: values[r - below] for r in ranks}
    return (found[(total - 1) // 2] + found[total // 2]) / 2


def numeric_quality(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row: rmse, mae, r2, mape, smape, median_ae, bias, nrmse_range, nrmse_std over pairs that are both finite.

    The median is found at once (it takes passes of its own); the rest is one aggregate.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    pairs = df.select(truth.cast("double").alias("y"), guess.cast("double").alias("p")).where(finite(F.col("y")) & finite(F.col("p")))
    e, y = F.col("p") - F.col("y"), F.col("y")
    median = middle(pairs.select(F.abs(e).alias("e")), "e")
    sums = pairs.agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
        F.var_pop(y).alias("var"), (F.max(y) - F.min(y)).alias("range"),
        F.avg(F.when(y != 0, F.abs(F.try_divide(e, y)))).alias("ape"),
        F.avg(F.try_divide(2 * F.abs(e), F.abs(y) + F.abs(F.col("p")))).alias("sape"),
    )
    rmse = F.sqrt("mse")
    return sums.select(
        rmse.alias("rmse"), "mae", (1 - F.try_divide("mse", "var")).alias("r2"), (F.col("ape") * 100).alias("mape"), (F.col("sape") * 100).alias("smape"),
        F.lit(median).cast("double").alias("median_ae"), "bias", F.try_divide(rmse, "range").alias("nrmse_range"), F.try_divide(rmse, F.sqrt("var")).alias("nrmse_std"),
    )


def classification_quality(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row: accuracy, balanced accuracy, macro precision, recall and F1, MCC and kappa.

    All from the confusion table, whose size is that of the labels.
    """
    cells = df.select(truth.cast("string").alias("t"), guess.cast("string").alias("p")).na.drop("any").groupBy("t", "p").agg(F.count("*").alias("n"))
    by_truth = cells.groupBy(F.col("t").alias("k")).agg(F.sum("n").alias("a"))
    by_guess = cells.groupBy(F.col("p").alias("k")).agg(F.sum("n").alias("b"))
    hits = cells.where("t = p").select(F.col("t").alias("k"), F.col("n").alias("h"))
    k = by_truth.join(by_guess, "k", "full").join(hits, "k", "left").na.fill(0, ["a", "b", "h"])
    precision, recall = F.coalesce(F.try_divide("h", "b"), F.lit(0.0)), F.try_divide("h", "a")
    f1 = F.try_divide(2 * F.col("h"), F.col("a") + F.col("b"))
    s = k.agg(
        F.sum("a").alias("n"), F.sum("h").alias("c"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"),
        F.avg(recall).alias("balanced_accuracy"), F.avg(precision).alias("precision_macro"), F.avg(F.coalesce(recall, F.lit(0.0))).alias("recall_macro"), F.avg(f1).alias("f1_macro"),
    )
    n, c, ab = (F.col(x).cast("double") for x in ("n", "c", "ab"))
    spread = F.sqrt(n * n - F.col("aa").cast("double")) * F.sqrt(n * n - F.col("bb").cast("double"))
    mcc = F.when(spread == 0, 0.0).otherwise(F.try_divide(c * n - ab, spread))
    chance = F.try_divide(ab, n * n)
    return s.select(
        F.try_divide(c, n).alias("accuracy"), "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro",
        mcc.alias("mcc"), F.try_divide(F.try_divide(c, n) - chance, 1 - chance).alias("kappa"),
    )


def coverage(df: DataFrame, masked: dict[str, Column], filled: dict[str, Column]) -> DataFrame:
    """(column, masked, filled, coverage): how many masked cells got a value."""
    wide = df.agg(*(x for c in masked for x in (F.count_if(masked[c]).alias(f"{c}:m"), F.count_if(masked[c] & filled[c].isNotNull()).alias(f"{c}:f"))))
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}:m`").alias("masked"), F.col(f"`{c}:f`").alias("filled"),
                      F.try_divide(f"`{c}:f`", f"`{c}:m`").alias("coverage")) for c in masked]
    return wide.select(F.inline(F.array(*parts)))
