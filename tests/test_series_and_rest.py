import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapwright.errors import GapTypeError, GapValueError
from gapwright.operators.gaps import gap_runs, interpolate
from gapwright.operators.inject import at_random, block_starts, blocks
from gapwright.operators.quality import classification_quality, numeric_quality
from gapwright.operators.series_imputer import SeriesImputer
from gapwright.operators.table_imputer import TableImputer
from gapwright.operators.timefeatures import add_calendar, add_lags
from gapwright.operators.timegrid import infer_step, regularise
from gapwright.sources.tables import complete_rows, from_rows, read_csv, read_series_csv, slice_rows, synthetic_mixed, write, zeros_missing
from gapwright.streaming.apply import impute_stream, to_memory

START = dt.datetime(2024, 1, 1)


def hours(spark, points, schema="ts timestamp_ntz, v double"):
    return spark.createDataFrame([(START + dt.timedelta(hours=h), *rest) for h, *rest in points], schema)


def test_step_inference(spark):
    assert infer_step(hours(spark, [(0, 1.0), (2, 1.0), (6, 1.0)]), "ts") == 2 * 3_600_000_000
    for points, said in (([(0, 1.0)], "two points"), ([(0, 1.0), (0, 2.0), (1, 1.0)], "repeated"), ([(0, 1.0), (24, 1.0), (60, 1.0)], "irregular")):
        with pytest.raises(GapValueError, match=said):
            infer_step(hours(spark, points), "ts")
    with pytest.raises(GapTypeError):
        infer_step(spark.createDataFrame([(1,)], "ts int"), "ts")


def test_grid_dates_and_months(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 1, 2), 2.0), (dt.date(2024, 1, 5), 3.0)], "d date, v double")
    grid = regularise(days, "d")
    assert grid.count() == 5 and grid.schema["d"].dataType.simpleString() == "date"
    months = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0), (dt.datetime(2024, 4, 1), 2.0)], "d timestamp_ntz, v double")
    assert [r["d"].month for r in regularise(months, "d", "1 month").orderBy("d").collect()] == [1, 2, 3, 4]


def test_calendar_series_are_their_own_grid(spark):
    make = lambda days: spark.createDataFrame([(d.to_pydatetime(), float(i)) for i, d in enumerate(days)], "d timestamp_ntz, v double")
    for freq in ("MS", "ME", "QS", "YS", "B"):
        days = pd.date_range("2023-01-02", periods=12, freq=freq)
        got = regularise(make(days), "d").orderBy("d").collect()
        assert [r["__ord"] for r in got] == list(range(12)), freq
    gappy = [d for i, d in enumerate(pd.date_range("2023-01-01", periods=12, freq="MS")) if i != 4]
    with pytest.raises(GapValueError, match="irregular"):
        regularise(make(gappy), "d")
    week = pd.date_range("2023-01-02", periods=4, freq="D")
    assert regularise(make(week), "d").count() == 4


def test_lags_over_buckets_equal_shifts(spark, monkeypatch):
    import gapwright.operators.timegrid as timegrid

    monkeypatch.setattr(timegrid.with_neighbours, "__defaults__", ("__ord", 7))
    x = np.arange(50.0)
    grid = regularise(hours(spark, [(i, float(v)) for i, v in enumerate(x)]), "ts")
    got = add_lags(grid, ["v"], [1, 3, -2]).orderBy("__ord").toPandas()
    s = pd.Series(x)
    for k in (1, 3, -2):
        assert got[f"v_lag_{k}"].equals(s.shift(k).rename(f"v_lag_{k}"))
    for bad, error in ((0, GapValueError), (1.5, GapTypeError)):
        with pytest.raises(error):
            add_lags(grid, ["v"], [bad])
    with pytest.raises(GapValueError):
        add_lags(grid.withColumn("v_lag_1", F.lit(1)), ["v"], [1])


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_interpolation_equals_pandas(spark, longest):
    draw = np.random.default_rng(longest)
    for _ in range(4):
        x = draw.normal(size=40)
        x[draw.random(40) < 0.45] = np.nan
        if np.isnan(x).all():
            continue
        s = pd.Series(x)
        run = s.isna().ne(s.isna().shift()).cumsum()
        size = s.isna().groupby(run).transform("size")
        want = s.where(~(s.isna() & (size <= longest)), s.interpolate())
        df = spark.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "__ord bigint, v double")
        got = interpolate(df, ["v"], longest).orderBy("__ord").toPandas()["v"].to_numpy(dtype=float)
        assert np.allclose(got, want.to_numpy(), equal_nan=True)
        runs = {(r["start"], r["end"]) for r in gap_runs(df, "v").collect()}
        want_runs = {(int(g.index[0]), int(g.index[-1])) for _, g in s[s.isna()].groupby(run[s.isna()])}
        assert runs == want_runs


def test_calendar(spark):
    df, names = add_calendar(regularise(hours(spark, [(i, 1.0) for i in range(30)]), "ts").withColumn("__time_trend", F.lit(0)), "ts")
    assert "__time_trend_1" in names
    r = df.where("__ord = 6").first()
    assert abs(r["__time_day_sin"] - 1) < 1e-9 and abs(r["__time_week_cos"] - 1) < 1e-9 and abs(r["__time_trend_1"] - 6 / 29) < 1e-9


def test_series_end_to_end(spark):
    t = np.arange(200)
    v = 10 + np.sin(2 * np.pi * t / 24)
    gone = set(range(60, 66)) | {100, 101, 150}
    df = hours(spark, [(int(i), float(v[i]), "hi" if v[i] > 10 else "lo") for i in t if i not in gone], "ts timestamp_ntz, v double, level string")
    out = SeriesImputer("ts", lags=(1, 2, -1, -2)).impute(df).orderBy("ts").collect()
    assert len(out) == 200 and all(None not in r for r in out)
    assert np.mean([abs(out[i]["v"] - v[i]) for i in gone]) < 0.3
    part = SeriesImputer("ts").impute(df, cols=["v"], before=START + dt.timedelta(hours=62)).orderBy("ts").collect()
    assert part[61]["v"] is not None and part[62]["v"] is None and part[61]["level"] is None
    by_place = SeriesImputer("ts").impute(df, rows=[100]).orderBy("ts").collect()
    assert by_place[100]["v"] is not None and by_place[101]["v"] is None
    by_time = SeriesImputer("ts").impute(df, rows=[START + dt.timedelta(hours=101)]).orderBy("ts").collect()
    assert by_time[101]["v"] is not None and by_time[100]["v"] is None
    with pytest.raises(GapTypeError):
        SeriesImputer(3)


def test_injection(spark):
    df = spark.range(2000).select("id", F.rand(1).alias("x"))
    assert abs(at_random(df, 0.3, ["x"], 1).where("x is null").count() / 2000 - 0.3) < 0.05
    starts, length = block_starts(["a", "b", "c"], 100, 0.3, 0.2, 1)
    assert len(starts) == 1 and length == 20
    rows = [r["id"] for r in blocks(df, {"x": 10}, 5, "id").where("x is null").collect()]
    assert sorted(rows) == [10, 11, 12, 13, 14]
    with pytest.raises(GapValueError):
        at_random(df, 1.2)


def test_quality(spark):
    df = spark.createDataFrame([(1.0, 1.5, "a", "a"), (2.0, 1.0, "b", "a"), (4.0, 4.0, "b", "b"), (None, 1.0, None, "a")], "y double, p double, t string, q string")
    r = numeric_quality(df, F.col("y"), F.col("p")).first()
    e = np.array([0.5, -1, 0])
    assert abs(r["rmse"] - np.sqrt((e**2).mean())) < 1e-12 and abs(r["bias"] - e.mean()) < 1e-12
    c = classification_quality(df, F.col("t"), F.col("q")).first()
    assert abs(c["accuracy"] - 2 / 3) < 1e-12 and abs(c["balanced_accuracy"] - 0.75) < 1e-12 and abs(c["kappa"] - 0.4) < 1e-12
    empty = numeric_quality(df.where("false"), F.col("y"), F.col("p")).first()
    assert empty["rmse"] is None


def test_sources(spark, tmp_path):
    df = synthetic_mixed(spark, rows=50)
    assert df.count() == 50 and len(df.columns) == 6
    write(df, str(tmp_path / "x"), "csv")
    assert read_csv(spark, str(tmp_path / "x")).count() == 50
    (tmp_path / "s.csv").write_text("time,v\n2024-01-01 00:00:00,1\n2024-01-01 00:15:00,0\n")
    series = read_series_csv(spark, str(tmp_path / "s.csv"), 300_000_000)
    assert series.count() == 4
    assert zeros_missing(series).where("v is null").count() == 3
    assert complete_rows(series).count() == 2
    assert from_rows(spark, np.eye(3)).count() == 3
    assert slice_rows(spark.range(9).toDF("i"), "i", 4).count() == 4
    with pytest.raises(GapValueError):
        from_rows(spark, np.array([["a"]]))


def test_stream(spark, tmp_path):
    rows = [(float(i), None if i % 5 == 0 else 2.0 * i) for i in range(100)]
    df = spark.createDataFrame(rows, "x double, y double")
    df.write.parquet(str(tmp_path / "in"))
    fitted = TableImputer().fit_table(df)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = to_memory(impute_stream(fitted, stream), "filled").start()
    q.awaitTermination(60)
    got = {r["x"]: r["y"] for r in spark.table("filled").collect()}
    assert len(got) == 100 and all(abs(y - 2 * x) < 0.5 for x, y in got.items())
    with pytest.raises(GapTypeError):
        TableImputer().fit_table(stream)
    with pytest.raises(GapTypeError):
        impute_stream(fitted, df)


def test_evaluation(spark):
    from gapwright.plans.evaluation import run_series, run_suite

    rows = run_suite(spark).collect()
    assert {r["pattern"] for r in rows} == {"MAR_0.10", "Blocks_0.20x0.30"}
    for r in rows:
        assert r["coverage"] == 1.0 and r["masked"] == r["filled"] > 0 and r["seconds"] > 0
    assert rows[0]["r2"] > 0.5 and rows[0]["accuracy"] > 0.5
    t = np.arange(300)
    df = hours(spark, [(int(i), float(np.sin(i / 5)), float(np.cos(i / 5))) for i in t], "ts timestamp_ntz, v double, w double")
    r = run_series(df, "ts", None, "MAR_0.10").first()
    assert r["coverage"] == 1.0 and r["r2"] > 0.9
    with pytest.raises(GapValueError):
        run_series(df, "ts", None, "nope")


def test_parameters(spark):
    t = TableImputer(alpha=2.0)
    assert t.get_params()["alpha"] == 2.0 and t.set_params(fallback=None).fallback is None and t.alpha == 2.0
    s = SeriesImputer("ts").set_params(lags=(1, 2), min_samples_train=5)
    assert s.lags == [1, 2] and s.table.min_samples == 5
    for bad in (t, s):
        with pytest.raises(GapValueError):
            bad.set_params(nope=1)


def test_calendar_grids_equal_plain_ones(spark):
    import pandas as pd

    for step, freq, start, end, kind in (
        ("1 month", pd.DateOffset(months=1), "2020-01-31", "2023-05-31", "date"), ("3 months", pd.DateOffset(months=3), "2020-01-15", "2024-02-01", "timestamp_ntz"),
        ("1 year", pd.DateOffset(years=1), "2001-03-01", "2020-03-01", "date"), ("1 week", pd.DateOffset(weeks=1), "2024-01-01", "2024-06-05", "date"),
        ("6 hours", pd.DateOffset(hours=6), "2024-01-01", "2024-01-05", "timestamp_ntz"),
    ):
        df = spark.createDataFrame([(start, 1.0), (end, 2.0)], "d string, v double").select(F.col("d").cast(kind).alias("d"), "v")
        got = regularise(df, "d", step).orderBy("__ord").collect()
        want, i = [], 0
        while (t := pd.Timestamp(start) + i * freq) <= pd.Timestamp(end):
            want.append(t)
            i += 1
        assert [pd.Timestamp(r["d"]) for r in got] == want and [r["__ord"] for r in got] == list(range(len(want)))
    with pytest.raises(GapValueError):
        regularise(df, "d", "0 months")


def test_median_by_narrowing(spark, monkeypatch):
    import gapwright.operators.quality as module

    monkeypatch.setattr(module, "FEW_VALUES", 20)
    draw = np.random.default_rng(0)
    for values in (draw.normal(size=3001), draw.normal(size=5000), draw.integers(0, 2, 4000) * 1.0, draw.integers(0, 2, 4001) * 1.0, np.repeat([1.0, 3.0], 500), np.ones(999), np.array([4.0]), np.zeros(0), np.concatenate([np.zeros(2000), draw.normal(size=2000)])):
        df = spark.createDataFrame([(float(v),) for v in values], "e double").repartition(3)
        assert module.middle(df, "e") == (float(np.median(values)) if len(values) else None)


def test_hidden_cells_are_the_same_in_every_plan(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), F.rand(3).alias("a"), F.lit(1.0).alias("b"))
    one = at_random(df, 0.2, ["a", "b"], 5, "k")
    a = {r["k"] for r in one.where("a is null").select("k").collect()}
    assert a == {r["k"] for r in one.repartition(7).orderBy(F.desc("k")).where("a is null").select("k").collect()}
    b = {r["k"] for r in one.where("b is null").select("k").collect()}
    assert 300 < len(a) < 500 and 300 < len(b) < 500 and a != b and len(a & b) < 150


def test_series_columns_named_like_internal_ones(spark):
    rows = [(dt.datetime(2024, 1, 1, h), None if h % 5 == 2 else float(h), float(h * h)) for h in range(24) if h != 7]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double, w double")
    want = SeriesImputer("t", interpolate_gaps_less_than=1).impute(df).orderBy("t").collect()
    for names in (("__ord", "__bucket"), ("__home", "__pv0"), ("__mask", "__ord")):
        own = df.withColumnsRenamed(dict(zip(("v", "w"), names, strict=True)))
        got = SeriesImputer("t", interpolate_gaps_less_than=1).impute(own)
        assert got.columns == own.columns and [tuple(r) for r in got.orderBy("t").collect()] == [tuple(r) for r in want]
    got = SeriesImputer("__ord", interpolate_gaps_less_than=1).impute(df.withColumnRenamed("t", "__ord"), cols=["v"])
    assert got.columns == ["__ord", "v", "w"]


def test_series_imputer_saved_and_loaded(spark, tmp_path):
    s = SeriesImputer("t", lags=(1, -1), interpolate_gaps_less_than=2, rng=4)
    s.write().save(str(tmp_path / "s"))
    assert SeriesImputer.load(str(tmp_path / "s")).get_params() == s.get_params()


def test_datasets_from_files(spark, tmp_path):
    """Small files of the public ones' layout."""
    import hashlib

    from gapwright.plans.evaluation import run_suite
    from gapwright.sources.datasets import DATASETS

    draw = np.random.default_rng(0)
    x = draw.normal(size=(120, 3)) @ draw.normal(size=(3, 12))
    times = pd.date_range("2024-01-01", periods=120, freq="5min")
    frame_ = pd.DataFrame(x, columns=[f"c{i}" for i in range(12)])
    frame_.to_csv(tmp_path / "winequality-red.csv", sep=";", index=False)
    frame_.iloc[:, :4].where(frame_["c0"] < 2, 0.0).set_index(times).drop(times[7]).to_csv(tmp_path / "METR-LA.csv")
    hours_ = pd.date_range("2010-01-01", periods=120, freq="h")
    pd.DataFrame({"No": range(120), "year": hours_.year, "month": hours_.month, "day": hours_.day, "hour": hours_.hour, "pm2.5": x[:, 0], "cbwd": np.where(x[:, 1] > 0, "NW", "cv"), "Is": range(120)}).drop(30).to_csv(tmp_path / "PRSA_data_2010.1.1-2014.12.31.csv", index=False, na_rep="NA")
    pd.concat([pd.Series(draw.choice(list("MFI"), 120)), frame_.iloc[:, :8]], axis=1).to_csv(tmp_path / "abalone.data", index=False, header=False)
    load = lambda n: DATASETS[n].load(spark, str(tmp_path), check=False)
    assert load("wine_quality_red").count() == 120 and len(load("wine_quality_red").columns) == 12
    metr = load("metr_la")
    assert metr.count() == 120 and metr.columns[0] == "time" and metr.where("c0 is null").count() == (x[:, 0] >= 2).sum() + (x[7, 0] < 2)
    pm = load("beijing_pm25")
    assert pm.columns == ["time", "pm2.5", "cbwd", "Is"] and pm.count() == 120 and pm.where("cbwd is null").count() == 1
    assert dict(load("abalone").dtypes)["sex"] == "string" and load("abalone").columns[-1] == "rings"
    with pytest.raises(GapValueError):
        DATASETS["abalone"].load(spark, str(tmp_path))
    (tmp_path / "abalone.data").rename(tmp_path / "spambase.data")
    with pytest.raises(GapValueError):
        DATASETS["spambase"].load(spark, str(tmp_path), check=False)
    assert hashlib.md5((tmp_path / "spambase.data").read_bytes()).hexdigest() != DATASETS["spambase"].md5
    rows = run_suite(spark, ["wine_quality_red"], folder=str(tmp_path), out=str(tmp_path / "out"), check=False).collect()
    assert {r["dataset"] for r in rows} == {"wine_quality_red"} and all(r["coverage"] == 1.0 for r in rows)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    with pytest.raises(GapValueError):
        run_suite(spark, ["nope"])


def test_names_with_dots(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), None if h % 5 == 2 else float(h), "a" if h % 2 else "b", float(h * h)) for h in range(60)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double, k string, w double")
    dotted = df.withColumnsRenamed({"v": "v.1", "t": "t.x", "k": "k 2"})
    want = SeriesImputer("t", interpolate_gaps_less_than=1).impute(df).orderBy("t").collect()
    got = SeriesImputer("t.x", interpolate_gaps_less_than=1).impute(dotted).orderBy("`t.x`")
    assert got.columns == dotted.columns and [tuple(r) for r in got.collect()] == [tuple(r) for r in want]
    table = TableImputer().impute(dotted.drop("t.x"))
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, TableImputer().impute(df.drop("t")).collect()))
