import numpy as np
import pytest
from helpers import frame, holes, plain_ridge, values
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from gapwright.errors import GapError, GapTypeError, GapValueError
from gapwright.operators import masks
from gapwright.operators.columns import encode
from gapwright.operators.elm import RandomLayerRidge
from gapwright.operators.moments import arrow_moments, collect, sql_moments
from gapwright.operators.profile import profile
from gapwright.operators.rectangle import largest
from gapwright.operators.relevance import nearest, relevance
from gapwright.operators.ridge import Ridge
from gapwright.operators.table_imputer import TableImputer
from gapwright.operators.tree import GiniTree


def impute(df, imputer=None, **call):
    fitted = (imputer or TableImputer()).fit_table(df, call.pop("rows", None), beside=["row"], **call)
    return fitted.apply_beside(df)


@pytest.mark.parametrize("normalize", [True, False])
@pytest.mark.parametrize(("offset", "scale"), [(0, 1), (120, 5), (50_000, 1000)])
def test_matches_plain_ridge(spark, offset, scale, normalize):
    x, _ = holes(400, 6, 0.15, 1, offset, scale)
    out = values(impute(frame(spark, x), normalize=normalize), "abcdef")
    want = plain_ridge(x, normalize=normalize)
    known = ~np.isnan(want)
    assert np.abs(out - want)[known].max() < 1e-5 * np.nanstd(x)
    assert (out[~np.isnan(x)] == x[~np.isnan(x)]).all()
    assert not np.isnan(out).any()


def test_result_does_not_depend_on_partitions(spark):
    x, _ = holes(300, 5, 0.2, 2)
    df = frame(spark, x)
    one, many = (values(impute(df.repartition(n)), "abcde") for n in (1, 7))
    assert np.allclose(one, many, rtol=0, atol=1e-9)


def test_null_and_nan_are_both_missing(spark):
    x, _ = holes(200, 4, 0.15, 3)
    df = frame(spark, x)
    null = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in "abcd"})
    assert np.allclose(values(impute(df), "abcd"), values(impute(null), "abcd"))
    kept = TableImputer(fallback=None).fit_table(df.select("row", "a"), beside=["row"]).apply_beside(df.select("row", "a"))
    assert kept.where(F.isnan("a")).count() == int(np.isnan(x[:, 0]).sum())


def test_sql_and_arrow_moments_agree(spark):
    x, _ = holes(300, 4, 0.2, 4)
    df = frame(spark, x).drop("row")
    e = encode(df, profile(df), True, True)
    by_sql = {r["mask"]: r for r in sql_moments(df, e).collect()}
    for r in arrow_moments(df, e).collect():
        i, j = np.triu_indices(5)
        want = [by_sql[r["mask"]][f"g_{a}_{b}"] if a < 4 else by_sql[r["mask"]]["rows"] for a, b in zip(i, j, strict=True)]
        assert np.allclose(r["gram"], want) and r["rows"] == by_sql[r["mask"]]["rows"]


def test_wide_table_takes_the_arrow_path(spark):
    x, full = holes(400, 20, 0.02, 5)
    out = values(impute(frame(spark, x)), "abcdefghijklmnopqrst")
    hole = np.isnan(x)
    want = plain_ridge(x)
    assert np.abs(out - want)[hole & ~np.isnan(want)].max() < 1e-6
    assert np.sqrt(((out - full)[hole] ** 2).mean()) < 0.5


def test_wide_profile_equals_the_sql_one(spark, monkeypatch):
    import gapwright.operators.profile as module

    x, _ = holes(300, 5, 0.2, 12, 1e4, 3)
    df = frame(spark, x).withColumn("k", F.when(F.col("row") % 3 == 0, "s")).withColumn("dead", F.lit(None).cast("double")).withColumn("same", F.lit(7.5)).repartition(5)
    want = module.profile_all(df)
    monkeypatch.setattr(module, "SQL_COLUMNS", 1)
    got = module.profile_all(df)
    assert got.rows == want.rows == 300
    for c in df.columns:
        a, b = got.columns[c], want.columns[c]
        assert a.count == b.count and abs(a.mean - b.mean) < 1e-8 and abs(a.std - b.std) < 1e-6 and (c != "same" or a.scale == 1)


def test_many_columns_are_solved_where_the_rows_are(spark):
    x, full = holes(300, 70, 0.05, 13)
    names = [f"c{i}" for i in range(70)]
    df = frame(spark, x, names)
    fitted = TableImputer().fit_table(df, beside=["row"], n_nearest_features=10)
    assert fitted.wide is not None
    out = values(fitted.apply_beside(df), names)
    hole = np.isnan(x)
    assert not np.isnan(out).any() and (out[~hole] == x[~hole]).all()
    assert np.sqrt(((out - full)[hole] ** 2).mean()) < 0.6


@pytest.mark.parametrize(("columns", "share", "least"), [(18, 0.15, 20), (18, 0.15, 60), (24, 0.3, 20), (17, 0.3, 500)])
def test_both_ways_give_equal_results(spark, monkeypatch, columns, share, least):
    """The way by masks and the wide one, on one table each."""
    x, _ = holes(400, columns, share, 31)
    names = [f"c{i}" for i in range(columns)]
    df = frame(spark, x, names).withColumn("k", F.when(F.col("row") % 7 > 0, F.when(F.col("c0") > 0, "high").otherwise("low"))).repartition(3)

    def run(wide, **call):
        monkeypatch.setattr(TableImputer, "_is_wide", lambda *a: wide)
        fitted = TableImputer(min_samples_train=least).fit_table(df, beside=["row"], **call)
        assert (fitted.wide is not None) == wide
        out = fitted.apply_beside(df).orderBy("row").toPandas()
        return out[names].to_numpy(dtype=float), out["k"].tolist()

    for call in ({}, {"n_nearest_features": 6}):
        (a, k), (b, m) = run(False, **call), run(True, **call)
        assert k == m and np.abs(a - b).max() < 1e-6


def test_memory_of_a_worker_does_not_grow_with_targets():
    from gapwright.operators.wide import Target, WideModel

    draw = np.random.default_rng(0)
    z = draw.normal(size=(500, 40))
    z[draw.random(z.shape) < 0.05] = np.nan
    model = WideModel([z], [Target(i, np.array([j for j in range(40) if j != i]), True) for i in range(40)], 0.01, True, 20, 1000)
    model.fill(z[:50])
    held = [v for t in model.ready.values() for v in t] + list(model.shared)
    assert sum(v.nbytes for v in held) < 2 * z.nbytes and not model.parts


def test_columns_named_like_internal_ones_come_back(spark):
    x, _ = holes(80, 4, 0.2, 33)
    df = frame(spark, x)
    extra = {"__mask": "m", "__sel": "s", "__z0": "z", "__m0": "n", "__p0": "p", "__w_0": "w", "__z": "y"}
    own = df.withColumns({c: F.lit(v) for c, v in extra.items()})
    for imputer in (TableImputer(), TableImputer(regressor=_Own())):
        out = imputer.fit_table(own, beside=["row", *extra]).apply_beside(own)
        assert out.columns == own.columns and {tuple(r[c] for c in extra) for r in out.collect()} == {tuple(extra.values())}
        assert np.allclose(values(out, "abcd"), values(impute(df, imputer), "abcd"))
    clash = df.withColumnRenamed("a", "__mask").withColumnRenamed("b", "__z0")
    assert np.allclose(values(impute(clash), ["__mask", "__z0", "c", "d"]), values(impute(df), "abcd"))


def test_rows_by_place_and_by_many_keys(spark, monkeypatch):
    import gapwright.operators.table_imputer as module

    x, _ = holes(120, 4, 0.2, 34)
    df = frame(spark, x).repartition(5)
    want = values(TableImputer().impute(df, rows=F.col("row").isin(0, 5, 119)), "abcd")
    for few in (200, 1):
        monkeypatch.setattr(module, "FEW_ROWS", few)
        for rows in ({"row": [0, 5, 119]}, {"order": "row", "at": [0, 5, -1]}):
            out = TableImputer().impute(df, rows=rows)
            assert out.columns == df.columns and np.allclose(values(out, "abcd"), want, equal_nan=True)
    for bad, kind in (({"order": "row", "at": [120]}, GapValueError), ({"order": "row", "at": ["x"]}, GapTypeError), ({"order": "zz", "at": [0]}, GapValueError)):
        with pytest.raises(kind):
            TableImputer().impute(df, rows=bad)


def test_row_numbers(spark, monkeypatch):
    import gapwright.operators.numbering as module

    monkeypatch.setattr(module, "RANGE", 50)
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), F.lit(1).alias("n_range")).repartition(6)
    for table in (df, df.where("k < 0"), df.where("k < 10")):
        got, total = module.numbered(table, ["k"], "n")
        rows = sorted((r["k"], r["n"]) for r in got.collect())
        assert total == len(rows) and [n for _, n in rows] == list(range(total))


def test_saved_and_loaded_in_a_pipeline(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import VectorAssembler

    x, _ = holes(60, 3, 0.2, 35)
    df = frame(spark, x, "abc").drop("row")
    stages = [TableImputer(alpha=0.5, rng=3, regressor="elm"), VectorAssembler(inputCols=["a", "b", "c"], outputCol="v")]
    model = Pipeline(stages=stages).fit(df)
    model.write().overwrite().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    assert again.stages[0].get_params() == stages[0].get_params() and again.stages[0].uid == stages[0].uid
    a, b = (m.transform(df).orderBy("a", "b", "c").select("a", "b", "c").toPandas().to_numpy() for m in (again, model))
    assert np.allclose(a, b) and not np.isnan(a).any()
    TableImputer(regressor=_Own()).write().save(str(tmp_path / "t"))
    assert type(TableImputer.load(str(tmp_path / "t")).regressor) is _Own
    for bad in (-1, True, "x"):
        with pytest.raises(GapValueError):
            TableImputer(rng=bad)


def test_labels_of_very_many_values_do_not_stop_a_table(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 10 > 0, F.concat(F.lit("city"), F.col("id") % 1500)).alias("city"), F.when(F.col("id") % 4 > 0, F.col("id") * 2.0).alias("x"), (F.col("id") * 1.0).alias("y"))
    df = df.unionByName(spark.createDataFrame([("most", 1.0, 1.0)] * 40, df.schema))
    out = TableImputer().impute(df).toPandas()
    assert not out.isna().any().any() and (out["city"] == "most").sum() == 340
    assert np.abs(out["x"] - 2 * out["y"])[: 3000].max() < 5


def test_selectors(spark):
    x, _ = holes(100, 4, 0.2, 6)
    df = frame(spark, x)
    out = values(TableImputer().fit_table(df, F.col("row") < 10, ["b"], beside=["row"]).apply_beside(df, F.col("row") < 10), "abcd")
    changed = np.argwhere(np.isnan(x) & ~np.isnan(out))
    assert set(changed[:, 1]) == {1} and changed[:, 0].max() < 10
    listed = TableImputer().impute(df, rows={"row": [0, 1, 2]}, cols=[1, 2])
    assert listed.count() == 100
    with pytest.raises(GapValueError, match="unknown columns"):
        TableImputer().impute(df, cols=["nope"])
    with pytest.raises(GapValueError, match="unknown rows"):
        TableImputer().impute(df, rows={"row": [5, 100_000]})
    with pytest.raises(GapTypeError):
        TableImputer().impute(df, rows=[1, 2])


def test_mixed_types_keep_their_schema(spark):
    draw = np.random.default_rng(0)
    u = draw.random(240)
    gone = lambda i: draw.random() < 0.15 and i > 20
    rows = [(i, None if gone(i) else float(v), None if gone(i) else int(v * 10), None if gone(i) else ("low" if v < 0.5 else "high"), None if gone(i) else bool(v > 0.3)) for i, v in enumerate(u)]
    df = spark.createDataFrame(rows, "row int, x double, n int, label string, flag boolean")
    out = impute(df)
    assert out.schema == df.schema
    done = out.orderBy("row").collect()
    assert all(None not in r for r in done)
    right = [d["label"] == ("low" if u[i] < 0.5 else "high") for i, (d, r) in enumerate(zip(done, rows, strict=True)) if r[3] is None]
    assert np.mean(right) > 0.8
    assert all(d[k] == r[k] for d, r in zip(done, rows, strict=True) for k in range(5) if r[k] is not None)


def test_integers_round_half_to_even(spark):
    df = spark.createDataFrame([(0, 2), (1, 3), (2, None)], "row int, n int")
    assert impute(df).where("row = 2").first()["n"] == 2


def test_fallback_and_empty_columns(spark):
    df = spark.createDataFrame([(0, "b", 1.0, None), (1, "a", None, None), (2, "b", 3.0, None), (3, None, None, None), (4, "a", None, None)], "row int, k string, x double, dead double")
    out = {r["row"]: r for r in impute(df).collect()}
    assert out[3]["k"] == "a" and out[3]["x"] == 2.0 and out[3]["dead"] is None
    none = {r["row"]: r for r in impute(df, TableImputer(fallback=None)).collect()}
    assert none[3]["x"] is None


def test_void_column_stays(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None)], "row int, x double").withColumn("void", F.lit(None))
    assert impute(df).select("void").schema == df.select("void").schema


def test_empty_table(spark):
    df = spark.createDataFrame([], "row int, x double, k string")
    assert impute(df).count() == 0


def test_nearest_features_and_scores(spark):
    x, _ = holes(300, 8, 0.2, 7)
    df = frame(spark, x).drop("row")
    e = encode(df, profile(df), True, True)
    got = relevance(collect(df, e), e, [0, 3])
    filled = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    seen = ~np.isnan(x)
    for i, c in enumerate((0, 3)):
        for j in range(8):
            want = (seen[:, c] & seen[:, j]).mean() * abs(np.corrcoef(filled[:, c], filled[:, j])[0, 1])
            assert abs(got[i, j] - want) < 1e-9
    assert nearest(np.array([0.1, 0.5, np.nan, 0.5, 0.2]), 0, [1, 2, 3, 4], 2) == [1, 3]
    assert nearest(np.array([0.0, np.nan, 0.1, np.nan]), 0, [1, 2, 3], 2) == [1, 2]
    imputer = TableImputer()
    imputer.impute(frame(spark, x).drop("row"), cols=["a"], n_nearest_features=0.5)
    assert len(imputer.imputation_features_["a"]) == 4
    fixed = TableImputer(scoring=lambda m, e, t: np.tile(np.arange(8.0), (len(t), 1)))
    fixed.impute(df, cols=["a"], n_nearest_features=2)
    assert fixed.imputation_features_["a"] == ["g", "h"]
    for bad in (0, 0.0, 1.5, "x", True):
        with pytest.raises(GapValueError):
            TableImputer().impute(df, n_nearest_features=bad)


def plain_largest(lacks, rows, width, least):
    """By trying every column set."""
    n = lacks.shape[1]
    best = (False, 0.0, 0)
    for k in range(1, 1 << n):
        keep = np.array([k >> j & 1 for j in range(n)], bool)
        block = int(rows[~lacks[:, keep].any(axis=1)].sum())
        if block:
            best = max(best, (block >= least, float(block * width[keep].sum()), block))
    return best


def test_rectangle():
    lacks = np.zeros((2, 6), bool)
    lacks[1, 1:] = True
    rows = np.array([10, 20])
    assert largest(lacks, rows, np.ones(6)).all()
    kept = largest(lacks, rows, np.ones(6), min_rows=20)
    assert kept.tolist() == [True] + [False] * 5
    assert not largest(np.ones((1, 3), bool), np.array([5]), np.ones(3)).any() and largest(np.zeros((0, 0), bool), np.zeros(0), np.zeros(0)).shape == (0,)
    draw = np.random.default_rng(0)
    for i in range(300):
        n = 7 if i % 2 else 5
        lacks = draw.random((30, n)) < 0.3
        lacks[:, 1] = lacks[:, 0] if i % 5 == 0 else lacks[:, 1]
        rows, width, least = draw.integers(1, 9, 30), draw.integers(1, 4, n).astype(float), int(draw.integers(1, 60))
        kept = largest(lacks, rows, width, least)
        block = int(rows[~lacks[:, kept].any(axis=1)].sum()) if kept.any() else 0
        assert (block >= least and block > 0, float(block * width[kept].sum()), block) == plain_largest(lacks, rows, width, least)
    many = draw.random((40, 20)) < 0.2
    kept = largest(many, np.ones(40), np.ones(20), 5)
    assert kept.any() and (~many[:, kept].any(axis=1)).sum() >= 5


def test_rectangle_path_leaves_nothing_missing(spark):
    x, _ = holes(60, 5, 0.45, 8)
    out = values(impute(frame(spark, x)), "abcde")
    assert not np.isnan(out).any()


def test_estimator_objects(spark):
    x, _ = holes(200, 4, 0.15, 9)
    df = frame(spark, x)

    own = values(impute(df, TableImputer(regressor=_Own())), "abcd")
    assert np.allclose(own, values(impute(df), "abcd"), atol=1e-6)
    assert not np.isnan(values(impute(df, TableImputer(regressor="elm")), "abcd")).any()


class _Own(Ridge):
    pass


class _Majority:
    def fit(self, X, y):
        self.value = np.bincount(y).argmax()

    def predict(self, X):
        return np.full(len(X), self.value)


def test_custom_classifier(spark):
    rows = [(i, float(i), ("a", "b", "b", None)[i % 4]) for i in range(120)]
    df = spark.createDataFrame(rows, "row int, x double, k string")
    out = impute(df, TableImputer(classifier=_Majority()))
    assert {r["k"] for r in out.where("row % 4 = 3").collect()} == {"b"}


def test_tree():
    draw = np.random.default_rng(0)
    X = draw.random((300, 3))
    y = (X[:, 1] > 0.4).astype(int) + (X[:, 0] > 0.7)
    tree = GiniTree().fit(X, y)
    assert (tree.predict(X) == y).mean() > 0.97
    assert (GiniTree().fit(X, np.full(300, 2)).predict(X) == 2).all()


def test_elm_on_a_table_and_parameters(spark):
    draw = np.random.default_rng(0)
    X = draw.normal(size=(500, 3))
    y = X[:, 0] - X[:, 1] ** 2
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(X, y, strict=True)], "p double, q double, r double, y double")
    a = RandomLayerRidge(n_features=40).fit(X, y)
    b = RandomLayerRidge(n_features=40).fit_table(df, ["p", "q", "r"], "y")
    assert np.allclose(a.predict(X), b.predict(X), atol=1e-6)
    assert RandomLayerRidge().width(50) == 10 and RandomLayerRidge(min_samples_per_feature=0).width(50) == 100
    old = b.hidden(X, 5)
    assert np.allclose(b.hidden(X, 9)[:, :5], old) and not np.allclose(b.set_params(random_state=1).hidden(X, 5), old)
    with pytest.raises(GapValueError):
        RandomLayerRidge(n_features=0)
    with pytest.raises(GapValueError):
        b.set_params(nope=1)


def test_ridge_object():
    draw = np.random.default_rng(0)
    X, y = draw.normal(size=(50, 3)), draw.normal(size=50)
    m = Ridge(1.0).fit(X, y)
    Xc, yc = X - X.mean(0), y - y.mean()
    assert np.allclose(m.coef_, np.linalg.solve(Xc.T @ Xc + np.eye(3), Xc.T @ yc))
    flat = Ridge(1.0, fit_intercept=False).fit(X, y)
    assert np.allclose(flat.coef_, np.linalg.solve(X.T @ X + np.eye(3), X.T @ y)) and flat.intercept_ == 0
    assert np.allclose(Ridge(0).fit(X, y).coef_, np.linalg.lstsq(Xc, yc, rcond=None)[0])


def test_errors(spark):
    with pytest.raises(GapValueError, match="infinite"):
        TableImputer().impute(spark.createDataFrame([(float("inf"), 1.0), (1.0, 2.0)], "a double, b double"))
    with pytest.raises(GapValueError, match="unsupported type"):
        TableImputer().impute(spark.createDataFrame([([1],)], "a array<int>"))
    for bad in ({"fallback": "median"}, {"scoring": "best"}, {"regressor": "svm"}, {"classifier": "svm"}):
        with pytest.raises(GapValueError):
            TableImputer(**bad)
    assert issubclass(GapValueError, (ValueError,)) and issubclass(GapTypeError, GapError)


def test_pipeline(spark):
    x, _ = holes(80, 3, 0.1, 10)
    df = frame(spark, x)
    assert not np.isnan(values(Pipeline(stages=[TableImputer()]).fit(df).transform(df), "abc")).any()


def test_masks(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (None, 2)], "a double, b int")
    got = {r["mask"]: (r["n_missing"], r["rows"]) for r in masks.groups(df, ["a", "b"]).collect()}
    assert got == {2: (1, 1), 3: (2, 1), 1: (1, 1)}


def test_fits_by_tasks_equal_those_of_the_driver(spark, monkeypatch):
    import gapwright.operators.table_imputer as module

    draw = np.random.default_rng(3)
    x = draw.random((200, 3))
    gone = draw.random((200, 4)) < 0.2
    rows = [(i, *(None if gone[i, j] else float(x[i, j]) for j in range(3)), None if gone[i, 3] else ("lo" if x[i, 0] + x[i, 1] < 1 else "hi")) for i in range(200)]
    df = spark.createDataFrame(rows, "row int, a double, b double, c double, k string")
    for imputer in (TableImputer(), TableImputer(regressor=_Own(), classifier=_Majority())):
        monkeypatch.setattr(module, "FEW_FITS", 1000)
        want = impute(df, imputer).orderBy("row").collect()
        monkeypatch.setattr(module, "FEW_FITS", 0)
        got = impute(df, imputer).orderBy("row").collect()
        assert all(a["k"] == b["k"] and np.allclose(a[1:4], b[1:4]) for a, b in zip(got, want, strict=True))


class _Mean:
    def fit(self, X, y):
        self.rows, self.value = len(y), float(np.mean(y))

    def predict(self, X):
        return np.full(len(X), self.value)


@pytest.mark.parametrize("regressor", [_Mean(), _Own(), RandomLayerRidge(n_features=20)])
def test_regressor_objects_are_fitted_on_all_rows(spark, regressor):
    x, _ = holes(400, 4, 0.2, 21)
    df = frame(spark, x)
    want = TableImputer(regressor=regressor).fit_table(df, beside=["row"], cols=["a"])
    few = TableImputer(regressor=regressor, fit_rows=30).fit_table(df, beside=["row"], cols=["a"])
    assert np.allclose(values(few.apply_beside(df), "abcd"), values(want.apply_beside(df), "abcd"), atol=1e-9, equal_nan=True)
    z = (x - np.nanmean(x, axis=0)) / np.nanstd(x, axis=0)
    for mask, found in few.models.items():
        model, use = few.objects["a"][found["a"][0]]
        rows = ~np.isnan(z[:, [0, *use]]).any(axis=1)
        own = type(regressor)() if not isinstance(regressor, RandomLayerRidge) else RandomLayerRidge(n_features=20)
        own.fit(z[rows][:, use], z[rows, 0])
        assert np.allclose(model.predict(z[rows][:, use]), own.predict(z[rows][:, use]), atol=1e-6)
        assert not isinstance(model, _Mean) or model.rows == rows.sum()


def test_wide_models_use_all_rows_beyond_one_matrix(spark, monkeypatch):
    import gapwright.operators.wide as module

    x, _ = holes(240, 70, 0.004, 22)
    names = [f"c{i}" for i in range(70)]
    df = frame(spark, x, names).withColumn("k", F.when(F.col("row") % 9 > 0, F.when(F.col("row") % 2 == 0, "even").otherwise("odd"))).repartition(3)
    cols = ["c0", "c1", "c2", "c3", "k"]

    def run():
        fitted = TableImputer(min_samples_train=150).fit_table(df, beside=["row"], cols=cols, n_nearest_features=12)
        out = fitted.apply_beside(df).orderBy("row").toPandas()
        return fitted, out[cols[:4]].to_numpy(dtype=float), out["k"].tolist()

    whole, numbers, labels = run()
    monkeypatch.setattr(module, "MATRIX_BYTES", 8 * 74 * 40)
    monkeypatch.setattr(module, "PART_BYTES", 8 * 74 * 40, raising=False)
    parted, got, got_labels = run()
    assert parted.features == whole.features and got_labels == labels
    assert np.abs(got - numbers).max() < 1e-8
    assert len(parted.wide.parts) > 3
