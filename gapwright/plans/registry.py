"""The registered queries of the imputation engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwright.functions.cells import number
from gapwright.operators import masks
from gapwright.operators.columns import code, discover, encode, label, one_hot
from gapwright.operators.gaps import gap_runs, interpolate
from gapwright.operators.inject import blocks, by_key
from gapwright.operators.moments import collect, sql_moments
from gapwright.operators.profile import profile, profile_table, standardise
from gapwright.operators.quality import classification_quality, coverage, numeric_quality
from gapwright.operators.rectangle import largest
from gapwright.operators.relevance import nearest, relevance
from gapwright.operators.ridge import Ridge, from_gram, roll_up
from gapwright.operators.series_imputer import SeriesImputer
from gapwright.operators.table_imputer import TableImputer
from gapwright.operators.timefeatures import add_calendar, add_lags
from gapwright.operators.timegrid import infer_step, regularise
from gapwright.plans.fixtures import GRID, HOURLY, KEYS, LINEITEM_GAPS, MEASURES, ORDERS_GAPS, PART_GAPS, hourly, lineitem_gaps, orders_gaps, part_gaps, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
BITS = {m: 1 << i for i, m in enumerate(MEASURES)}
MASK = " + ".join(f"(case when {m} is null then {b} else 0 end)" for m, b in BITS.items())


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def beside(spark: SparkSession, sf_dir: str, names: list[str], imputer: TableImputer, **call) -> DataFrame:
    """Imputes some columns of the lineitem fixture and keeps the keys beside them."""
    df = lineitem_gaps(spark, sf_dir).select(*KEYS, *names)
    rows = call.pop("rows", None)
    fitted = imputer.fit_table(df, rows, beside=KEYS, **call)
    return fitted.apply_beside(df, rows)


# --- profile and masks


@query(
    "with d as (" + LINEITEM_GAPS + ")"
    + " union all ".join(
        f"select '{c}' as \"column\", count({c}) as observed, count(*) - count({c}) as missing, round(avg({c}), 4) as mean, round(stddev_pop({c}), 4) as std from d"
        for c in [*MEASURES, "l_tax"]
    )
)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile_table(lineitem_gaps(spark, sf_dir).select(*MEASURES, "l_tax")), {"mean": 4, "std": 4})


@query(f"""with d as ({LINEITEM_GAPS}) select l_orderkey, l_linenumber,
  round((l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over (), 5) as l_quantity_z,
  round((l_tax - avg(l_tax) over ()) / stddev_pop(l_tax) over (), 5) as l_tax_z from d""")
def standardize_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = standardise(lineitem_gaps(spark, sf_dir), ["l_quantity", "l_tax"])
    return rounded(df.select(*KEYS, "l_quantity_z", "l_tax_z"), {"l_quantity_z": 5, "l_tax_z": 5})


@query(f"""with d as ({LINEITEM_GAPS}), g as (select ({MASK})::bigint as mask from d)
  select mask, bit_count(mask)::int as n_missing, count(*) as rows from g group by mask""")
def missing_mask_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.groups(lineitem_gaps(spark, sf_dir), MEASURES)


@query(f"""with d as ({LINEITEM_GAPS}), g as (select ({MASK})::bigint as mask, count(*) as n from d group by 1)
  select p.mask as pattern, (3 - bit_count(p.mask))::int as usable, coalesce(sum(g.n), 0)::bigint as rows
  from g p left join g on (g.mask & ((7 & ~p.mask) | 1)) = 0 where p.mask & 1 = 1 group by p.mask""")
def complete_rows_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.trainable(masks.groups(lineitem_gaps(spark, sf_dir), MEASURES), MEASURES, "l_quantity")


@query(f"with d as ({LINEITEM_GAPS}) select count(*) as rows, round(sum(l_tax), 2) as tax from d where l_quantity is not null and l_discount is not null")
def complete_case_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = masks.complete(lineitem_gaps(spark, sf_dir), MEASURES, ["l_quantity", "l_discount"])
    return rows.agg(F.count("*").alias("rows"), F.round(F.sum("l_tax"), 2).alias("tax"))


# --- moments, scores


def _pairs_sql() -> str:
    parts = [
        f"select '{a}' as a, '{b}' as b, count(case when {a} is not null and {b} is not null then 1 end) as n, "
        f"round(avg(({a} - (select avg({a}) from d)) * ({b} - (select avg({b}) from d))), 8) as cross_mean from d"
        for a, b in combinations(MEASURES, 2)
    ]
    return f"with d as ({LINEITEM_GAPS}) " + " union all ".join(parts)


@query(_pairs_sql())
def pairwise_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lineitem_gaps(spark, sf_dir).select(*MEASURES)
    found = profile(df)
    dev = {c: number(c, df.schema[c].dataType) - found[c].mean for c in MEASURES}
    wide = df.agg(*(x for a, b in combinations(MEASURES, 2) for x in (F.count(dev[a] * dev[b]).alias(f"n:{a}:{b}"), F.avg(dev[a] * dev[b]).alias(f"c:{a}:{b}"))))
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n:{a}:{b}").alias("n"), F.round(F.col(f"c:{a}:{b}"), 8).alias("cross_mean")) for a, b in combinations(MEASURES, 2)]
    return wide.select(F.inline(F.array(*parts)))


Z = ", ".join(f"coalesce(({m} - avg({m}) over ()) / stddev_pop({m}) over (), 0) as z{i}" for i, m in enumerate(MEASURES))


@query(f"""with d as ({LINEITEM_GAPS}), s as (select ({MASK})::bigint as mask, {Z} from d)
  select mask, count(*) as rows, round(avg(z0 * z0), 5) as g00, round(avg(z0 * z1), 5) as g01, round(avg(z1 * z2), 5) as g12, round(avg(z2), 5) as g2 from s group by mask""")
def mask_group_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lineitem_gaps(spark, sf_dir).select(*MEASURES)
    g = sql_moments(df, encode(df, profile(df), True, True))
    part = lambda c: F.round(F.col(c) / F.col("rows"), 5)
    return g.select("mask", "rows", part("g_0_0").alias("g00"), part("g_0_1").alias("g01"), part("g_1_2").alias("g12"), part("g_2_3").alias("g2"))


FILLED = ", ".join(f"coalesce({m}, avg({m}) over ()) as {m}, case when {m} is null then 0 else 1 end as o_{m}" for m in [*MEASURES, "l_tax"])
SCORES = f"with d as ({LINEITEM_GAPS}), f as (select {FILLED} from d) " + " union all ".join(
    f"select '{a}' as target, '{b}' as feature, round(avg(o_{a} * o_{b}) * abs(corr({a}, {b})), 8) as score from f" for a in MEASURES for b in [*MEASURES, "l_tax"] if a != b
)


def _scores(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, list[str]]:
    df = lineitem_gaps(spark, sf_dir).select(*MEASURES, "l_tax")
    e = encode(df, profile(df), True, True)
    return relevance(collect(df, e), e, [0, 1, 2]), [*MEASURES, "l_tax"]


@query(SCORES)
def relevance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, names = _scores(spark, sf_dir)
    rows = [(MEASURES[i], names[j], float(score[i, j])) for i in range(3) for j in range(4) if i != j]
    return rounded(spark.createDataFrame(rows, "target string, feature string, score double"), {"score": 8})


@query(f"select target, feature from (select *, row_number() over (partition by target order by score desc) as k from ({SCORES})) where k <= 2")
def nearest_features_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, names = _scores(spark, sf_dir)
    rows = [(MEASURES[i], names[j]) for i in range(3) for j in nearest(score[i], i, [j for j in range(4) if j != i], 2)]
    return spark.createDataFrame(rows, "target string, feature string")


# --- ridge


def _fit_sql(target: str, features: list[str], alpha: float = 0.01) -> str:
    """Intercept and coefficients, on standardised values, over rows complete in all (one or two features)."""
    full = " and ".join(f"z_{c} is not null" for c in [target, *features])
    if len(features) == 1:
        x = f"z_{features[0]}"
        slope = f"(regr_sxy(z_{target}, {x}) / (regr_sxx(z_{target}, {x}) + {alpha}))"
        return f"select avg(z_{target}) - {slope} * avg({x}) as b0, {slope} as b1, 0.0 as b2 from s where {full}"
    x, y, t = f"z_{features[0]}", f"z_{features[1]}", f"z_{target}"
    sums = (f"select count(*) * var_pop({x}) + {alpha} as sxx, count(*) * var_pop({y}) + {alpha} as syy, count(*) * covar_pop({x}, {y}) as sxy, "
            f"count(*) * covar_pop({x}, {t}) as sxt, count(*) * covar_pop({y}, {t}) as syt, avg({x}) as mx, avg({y}) as my, avg({t}) as mt from s where {full}")  # fmt: skip
    return ("select mt - b1 * mx - b2 * my as b0, b1, b2 from (select *, (sxt * syy - syt * sxy) / (sxx * syy - sxy * sxy) as b1, "
            f"(syt * sxx - sxt * sxy) / (sxx * syy - sxy * sxy) as b2 from ({sums}))")  # fmt: skip


def _standard(names: list[str], extra: str = "") -> str:
    z = ", ".join(f"({m} - avg({m}) over ()) / stddev_pop({m}) over () as z_{m}, avg({m}) over () as m_{m}, stddev_pop({m}) over () as s_{m}" for m in names)
    return f"with d as ({LINEITEM_GAPS}), s as (select l_orderkey, l_linenumber, {', '.join(names)}{extra}, {z} from d)"


def _impute_sql(names: list[str], targets: list[str] | None = None, rows: str = "true", digits: int = 2) -> str:
    """All patterns of up to two features, then the mean."""
    targets = targets or names
    ctes, columns, joins = [], [], []
    for t in names:
        if t not in targets:
            columns.append(t)
            continue
        others = [c for c in names if c != t]
        cases = []
        for n in range(len(others), 0, -1):
            for k, use in enumerate(combinations(others, n)):
                name = f"f_{names.index(t)}_{n}_{k}"
                ctes.append(f"{name} as ({_fit_sql(t, list(use))})")
                joins.append(name)
                observed = " and ".join(f"{c} is not null" for c in use)
                value = f"{name}.b0 + " + " + ".join(f"{name}.b{i + 1} * z_{c}" for i, c in enumerate(use))
                cases.append(f"when {observed} then round(({value}) * s_{t} + m_{t}, {digits})")
        columns.append(f"case when {t} is not null or not ({rows}) then {t} {' '.join(cases)} else round(m_{t}, {digits}) end as {t}")
    return f"{_standard(names)}, {', '.join(ctes)} select l_orderkey, l_linenumber, {', '.join(columns)} from s, {', '.join(joins)}"


def _values_sql(names: list[str], t: str, ctes: list[str], joins: list[str]) -> dict[tuple[str, ...], str]:
    """The prediction of a target from one or two features, by those features; adds the fits to ``ctes`` and ``joins``."""
    out = {}
    others = [c for c in names if c != t]
    for use in [*combinations(others, 1), *combinations(others, 2)]:
        name = f"f_{names.index(t)}_" + "_".join(str(names.index(c)) for c in use)
        ctes.append(f"{name} as ({_fit_sql(t, list(use))})")
        joins.append(name)
        value = f"{name}.b0 + " + " + ".join(f"{name}.b{i + 1} * z_{c}" for i, c in enumerate(use))
        out[use] = f"round(({value}) * s_{t} + m_{t}, 2)"
    return out


def _nearest_sql(names: list[str]) -> str:
    """Ridge from those of the two nearest features that a row has, then the mean."""
    ctes, joins, columns = [f"near as (select target, string_agg(feature, ',' order by feature) as best from (select *, row_number() over (partition by target order by score desc) as k from ({SCORES})) where k <= 2 group by 1)"], [], []
    for t in MEASURES:
        value = _values_sql(names, t, ctes, joins)
        cases = []
        for a, b in combinations([c for c in names if c != t], 2):
            first, second = sorted((a, b))
            inner = f"case when {a} is not null and {b} is not null then {value[a, b]} when {a} is not null then {value[a,]} when {b} is not null then {value[b,]} else round(m_{t}, 2) end"
            cases.append(f"when (select best from near where target = '{t}') = '{first},{second}' then {inner}")
        columns.append(f"case when {t} is not null then {t} {' '.join(cases)} end as {t}")
    return f"{_standard(names)}, {', '.join(ctes)} select l_orderkey, l_linenumber, {', '.join(columns)}, l_tax from s, {', '.join(joins)}"


def _block_sql(share: float) -> str:
    """As ``_impute_sql`` for three measures, where fewer than a share of all rows makes a model take the largest complete block."""
    ctes, joins, columns = [f"least as (select floor(count(*) * {share}) as n from s)"], [], []
    for t in MEASURES:
        value = _values_sql(MEASURES, t, ctes, joins)
        a, b = (c for c in MEASURES if c != t)
        rows = lambda *use, t=t: "(select count(*) from s where " + " and ".join(f"{c} is not null" for c in (t, *use)) + ")"
        sets = " union all ".join(f"select '{k}' as k, {len(use)} * {rows(*use)} as area, {rows(*use)} as r, {i} as prio" for i, (k, use) in enumerate((("ab", (a, b)), ("a", (a,)), ("b", (b,)))))
        ctes.append(f"pick_{t} as (select k as k_{t} from ({sets}), least order by r >= n desc, area desc, r desc, prio limit 1)")
        joins.append(f"pick_{t}")
        both = f"case k_{t} when 'ab' then {value[a, b]} when 'a' then {value[a,]} else {value[b,]} end"
        columns.append(f"case when {t} is not null then {t} when {a} is not null and {b} is not null then {both} when {a} is not null then {value[a,]} when {b} is not null then {value[b,]} else round(m_{t}, 2) end as {t}")
    return f"{_standard(MEASURES)}, {', '.join(ctes)} select l_orderkey, l_linenumber, {', '.join(columns)} from s, {', '.join(joins)}"


def _rounded_new(spark: SparkSession, sf_dir: str, out: DataFrame, names: list[str], digits: int = 2) -> DataFrame:
    """Observed measures have two decimals at most, so rounding touches new cells only."""
    return rounded(out, {c: digits for c in names})


@query(_impute_sql(MEASURES))
def impute_lineitem_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_new(spark, sf_dir, beside(spark, sf_dir, MEASURES, TableImputer()), MEASURES)


@query(_standard(MEASURES[:2]) + f" select round(b0, 6) as intercept, round(b1, 6) as slope from ({_fit_sql('l_quantity', ['l_extendedprice'])})")
def ridge_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lineitem_gaps(spark, sf_dir).select(*MEASURES[:2])
    e = encode(df, profile(df), True, True)
    m = collect(df, e)
    gram = roll_up(masks.vector(m.masks, 2), masks.vector([3], 2), m.gram)
    coef, intercept = from_gram(gram, 0, np.array([[False, True]]))
    return rounded(spark.createDataFrame([(float(intercept[0]), float(coef[0, 1]))], "intercept double, slope double"), {"intercept": 6, "slope": 6})


@query(
    _standard(MEASURES) + " select * from (" + " union all ".join(
        f"select {pattern} as pattern, round(b0, 6) as intercept, round({c1}, 6) as coef_price, round({c2}, 6) as coef_discount from ({_fit_sql('l_quantity', use)})"
        for pattern, use, c1, c2 in ((1, MEASURES[1:], "b1", "b2"), (3, [MEASURES[2]], "b2", "b1"), (5, [MEASURES[1]], "b1", "b2"))
    ) + ")"
)
def ridge_two_features_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lineitem_gaps(spark, sf_dir).select(*MEASURES)
    fitted = TableImputer().fit_table(df, cols=["l_quantity"])
    rows = [(m, f["l_quantity"][0], f["l_quantity"][1][1], f["l_quantity"][1][2]) for m, f in fitted.models.items() if "l_quantity" in f]
    return rounded(spark.createDataFrame(rows, "pattern int, intercept double, coef_price double, coef_discount double"), {"intercept": 6, "coef_price": 6, "coef_discount": 6})


PAIR = MEASURES[:2]


@query(_standard(PAIR) + """, f as (select sum(z_l_quantity * z_l_extendedprice) / (sum(z_l_extendedprice * z_l_extendedprice) + 0.01) as w from s
  where l_quantity is not null and l_extendedprice is not null)
  select l_orderkey, l_linenumber, case when l_quantity is not null then l_quantity when l_extendedprice is not null
    then round(w * z_l_extendedprice * s_l_quantity + m_l_quantity, 2) else round(m_l_quantity, 2) end as l_quantity, l_extendedprice from s, f""")  # fmt: skip
def impute_no_intercept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_new(spark, sf_dir, beside(spark, sf_dir, PAIR, TableImputer(fit_intercept=False), cols=["l_quantity"]), ["l_quantity"])


@query(_standard(PAIR) + """, f as (select regr_sxy(l_quantity, l_extendedprice) / (regr_sxx(l_quantity, l_extendedprice) + 0.01) as w,
    avg(l_quantity) as my, avg(l_extendedprice) as mx from s where l_quantity is not null and l_extendedprice is not null)
  select l_orderkey, l_linenumber, case when l_quantity is not null then l_quantity when l_extendedprice is not null
    then round(my + w * (l_extendedprice - mx), 2) else round(m_l_quantity, 2) end as l_quantity, l_extendedprice from s, f""")  # fmt: skip
def impute_unnormalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_new(spark, sf_dir, beside(spark, sf_dir, PAIR, TableImputer(), cols=["l_quantity"], normalize=False), ["l_quantity"])


@query(_impute_sql(MEASURES, rows="l_linenumber <= 3"))
def impute_selected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_new(spark, sf_dir, beside(spark, sf_dir, MEASURES, TableImputer(), rows=F.col("l_linenumber") <= 3), MEASURES)


@query(_impute_sql(MEASURES, targets=["l_discount"]))
def impute_selected_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_new(spark, sf_dir, beside(spark, sf_dir, MEASURES, TableImputer(), cols=["l_discount"]), ["l_discount"])


@query(_nearest_sql([*MEASURES, "l_tax"]))
def impute_nearest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*MEASURES, "l_tax"]
    return _rounded_new(spark, sf_dir, beside(spark, sf_dir, names, TableImputer(), n_nearest_features=2), names)


# --- fallback, labels, integers


@query(f"with d as ({LINEITEM_GAPS}) select l_orderkey, l_linenumber, round(coalesce(l_quantity, avg(l_quantity) over ()), 4) as l_quantity from d")
def fallback_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(beside(spark, sf_dir, ["l_quantity"], TableImputer()), {"l_quantity": 4})


@query(f"""with d as ({ORDERS_GAPS}), m as (select o_orderstatus as v from d where o_orderstatus is not null group by 1 order by count(*) desc, 1 limit 1)
  select o_orderkey, coalesce(o_orderstatus, v) as o_orderstatus from d, m""")
def fallback_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders_gaps(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    return TableImputer().fit_table(df, beside=["o_orderkey"]).apply_beside(df)


@query(f"with d as ({ORDERS_GAPS}) select o_orderkey, o_orderstatus from d")
def fallback_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders_gaps(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    return TableImputer(fallback=None).fit_table(df, beside=["o_orderkey"]).apply_beside(df)


@query(f"""with d as ({ORDERS_GAPS}) select o_orderkey, o_orderstatus, (o_orderstatus = 'F')::int as "o_orderstatus_F",
  (o_orderstatus = 'O')::int as "o_orderstatus_O", (o_orderstatus = 'P')::int as "o_orderstatus_P" from d""")
def one_hot_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_hot(orders_gaps(spark, sf_dir).select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])


@query(f"with d as ({ORDERS_GAPS}) select o_orderkey, case when o_orderpriority is not null then (dense_rank() over (order by o_orderpriority) - 1)::int end as code from d")
def ordinal_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders_gaps(spark, sf_dir)
    return df.select("o_orderkey", code(F.col("o_orderpriority"), discover(df, ["o_orderpriority"])["o_orderpriority"]).alias("code"))


@query(f"with d as ({ORDERS_GAPS}) select o_orderkey, o_orderpriority from d")
def label_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders_gaps(spark, sf_dir)
    labels = discover(df, ["o_orderpriority"])["o_orderpriority"]
    return df.select("o_orderkey", label(code(F.col("o_orderpriority"), labels), labels, df.schema["o_orderpriority"].dataType).alias("o_orderpriority"))


@query(f"""with d as ({PART_GAPS}), s as (select *, (p_size - avg(p_size) over ()) / stddev_pop(p_size) over () as t, avg(p_size) over () as m, stddev_pop(p_size) over () as sd,
    (p_retailprice - avg(p_retailprice) over ()) / stddev_pop(p_retailprice) over () as x from d),
  f as (select regr_sxy(t, x) / (regr_sxx(t, x) + 0.01) as w, avg(t) as mt, avg(x) as mx from s where t is not null)
  select p_partkey, coalesce(p_size, round_even((mt + w * (x - mx)) * sd + m, 0)::int) as p_size from s, f""")
def integer_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = part_gaps(spark, sf_dir)
    return TableImputer().fit_table(df, beside=["p_partkey"]).apply_beside(df).select("p_partkey", "p_size")


# --- rectangles, trees, estimator objects


FOUR = [*MEASURES, "l_tax"]


@query(f"""with d as ({LINEITEM_GAPS}), g as (select ({MASK})::bigint as mask, count(*) as n from d group by 1),
  s as (select k, (select sum(n) from g where mask & k = 0) as rows from range(1, 16) as t(k)),
  best as (select * from s where rows is not null order by rows * bit_count(k) desc, rows desc, (k & 1) * 8 + (k & 2) * 2 + (k & 4) // 2 + (k & 8) // 8 desc limit 1)
  select list_filter([{", ".join(f"case when k & {1 << i} > 0 then '{c}' end" for i, c in enumerate(FOUR))}], lambda x: x is not null) as columns, rows::bigint as rows from best""")
def max_complete_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = FOUR
    groups = masks.groups(lineitem_gaps(spark, sf_dir), names).collect()
    lacks = np.array([[bool(g["mask"] >> i & 1) for i in range(4)] for g in groups])
    rows = np.array([g["rows"] for g in groups])
    keep = largest(lacks, rows, np.ones(4))
    complete = int(rows[~lacks[:, keep].any(axis=1)].sum())
    return spark.createDataFrame([([n for n, k in zip(names, keep, strict=True) if k], complete)], "columns array<string>, rows bigint")


@query(_block_sql(0.78))
def impute_rectangle_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").count()
    return _rounded_new(spark, sf_dir, beside(spark, sf_dir, MEASURES, TableImputer(min_samples_train=int(rows * 0.78))), MEASURES)


@query()
def impute_categorical_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders_gaps(spark, sf_dir).drop("o_custkey")
    return TableImputer().fit_table(df, beside=["o_orderkey"]).apply_beside(df)


class MeanOfTarget:
    """The simplest estimator object."""

    def fit(self, X: np.ndarray, y: np.ndarray) -> None:
        self.value = float(np.mean(y))

    def predict(self, X: np.ndarray) -> np.ndarray:
        return np.full(len(X), self.value)


@query(_standard(PAIR) + """, f as (select avg(l_quantity) as mean from s where l_quantity is not null and l_extendedprice is not null)
  select l_orderkey, l_linenumber, case when l_quantity is not null then l_quantity when l_extendedprice is not null then round(mean, 2)
    else round(m_l_quantity, 2) end as l_quantity, l_extendedprice from s, f""")  # fmt: skip
def impute_custom_estimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_new(spark, sf_dir, beside(spark, sf_dir, PAIR, TableImputer(regressor=MeanOfTarget()), cols=["l_quantity"]), ["l_quantity"])


@query()
def impute_elm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_new(spark, sf_dir, beside(spark, sf_dir, MEASURES, TableImputer(regressor="elm"), cols=["l_quantity"]), ["l_quantity"])


class OwnRidge(Ridge):
    """A subclass takes the general path of estimator objects."""


@query(_impute_sql(PAIR, targets=["l_quantity"]))
def impute_ridge_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_new(spark, sf_dir, beside(spark, sf_dir, PAIR, TableImputer(regressor=OwnRidge()), cols=["l_quantity"]), ["l_quantity"])


# --- time series


@query(f"with h as ({HOURLY}) select (min(d) * 1000000)::bigint as step_micros from (select epoch(hour)::bigint - lag(epoch(hour)::bigint) over (order by hour) as d from h)")
def infer_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(infer_step(hourly(spark, sf_dir), "hour"),)], "step_micros bigint")


@query(f"select ord, hour, value from ({GRID})")
def regularize_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regularise(hourly(spark, sf_dir), "hour").withColumnRenamed("__ord", "ord")


@query(f"""with g as ({GRID}) select ord, lag(value, 1) over (order by ord) as "value_lag_1", lag(value, 24) over (order by ord) as "value_lag_24",
  lead(value, 2) over (order by ord) as "value_lag_-2" from g""")
def lag_lead_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_lags(regularise(hourly(spark, sf_dir), "hour"), ["value"], [1, 24, -2]).drop("hour", "value").withColumnRenamed("__ord", "ord")


@query(f"""with g as ({GRID}), a as (select *, 2 * pi() * (hour(hour) + minute(hour) / 60.0) / 24 as day, 2 * pi() * (isodow(hour) - 1) / 7 as week from g)
  select ord, round(ord::double / max(ord) over (), 6) as "__time_trend", round(2 + sin(day), 6) as "__time_day_sin", round(2 + cos(day), 6) as "__time_day_cos",
  round(2 + sin(week), 6) as "__time_week_sin", round(2 + cos(week), 6) as "__time_week_cos" from a""")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = add_calendar(regularise(hourly(spark, sf_dir), "hour"), "hour")
    # the waves are raised by 2, so that no rounded value is a negative zero
    trend, *waves = names
    return df.select(F.col("__ord").alias("ord"), F.round(trend, 6).alias(trend), *(F.round(2 + F.col(n), 6).alias(n) for n in waves))


RUNS = f"""with g as ({GRID}), r as (select *, ord - row_number() over (order by ord) as grp from g where value is null)
  select min(ord) as start, max(ord) as "end", count(*) as length from r group by grp"""


@query(RUNS)
def gap_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_runs(regularise(hourly(spark, sf_dir), "hour"), "value").select("start", "end", "length")


@query(f"""with g as ({GRID}), n as (select *, last_value(case when value is not null then ord end ignore nulls) over (order by ord) as po,
    last_value(value ignore nulls) over (order by ord) as pv,
    first_value(case when value is not null then ord end ignore nulls) over (order by ord rows between current row and unbounded following) as no,
    first_value(value ignore nulls) over (order by ord rows between current row and unbounded following) as nv, max(ord) over () as top from g)
  select ord, round(case when value is not null then value when no - po - 1 <= 3 then pv + (nv - pv) * (ord - po)::double / (no - po)
    when no is null and top - po <= 3 then pv end, 6) as value from n""")
def interpolate_small_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = interpolate(regularise(hourly(spark, sf_dir), "hour"), ["value"], 3)
    return df.select(F.col("__ord").alias("ord"), F.round("value", 6).alias("value"))


@query(f"""with g as ({GRID}), l as (select *, lag(value) over (order by ord) as p from g),
  s as (select *, (value - avg(value) over ()) / stddev_pop(value) over () as t, avg(value) over () as m, stddev_pop(value) over () as sd,
    (p - avg(p) over ()) / stddev_pop(p) over () as x from l),
  f as (select regr_sxy(t, x) / (regr_sxx(t, x) + 0.01) as w, avg(t) as mt, avg(x) as mx from s where t is not null and x is not null)
  select hour, round(case when value is not null then value when x is not null then (mt + w * (x - mx)) * sd + m else m end, 4) as value from s, f""")
def impute_event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(SeriesImputer("hour", lags=(1,), add_time_features=False).impute(hourly(spark, sf_dir)), {"value": 4})


@query()
def impute_event_series_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = hourly(spark, sf_dir).withColumn("level", F.when(F.col("value") > 50, "high").otherwise("low"))
    out = SeriesImputer("hour", lags=(1, -1), interpolate_gaps_less_than=2).impute(df)
    return rounded(out, {"value": 4})


# --- injection and quality


@query(f"with d as ({LINEITEM_GAPS}) select l_orderkey, l_linenumber, l_quantity from d")
def inject_mar_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return by_key(df, "l_quantity", F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17, 10).select(*KEYS, "l_quantity")


@query("select p_partkey, case when p_partkey not between 20 and 59 then p_size end as p_size, case when p_partkey not between 100 and 139 then p_retailprice end as p_retailprice from part")
def inject_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return blocks(df, {"p_size": 20, "p_retailprice": 100}, 40, "p_partkey")


TRUTH = "select l_extendedprice as y, l_quantity * 1000 + l_tax as p from lineitem"


@query(f"""with d as ({TRUTH}), e as (select *, p - y as e from d) select round(sqrt(avg(e * e)), 2) as rmse, round(avg(abs(e)), 2) as mae,
  round(1 - avg(e * e) / var_pop(y), 6) as r2, round(avg(abs(e / y)) * 100, 4) as mape, round(avg(2 * abs(e) / (abs(y) + abs(p))) * 100, 4) as smape,
  round(median(abs(e)), 2) as median_ae, round(avg(e), 2) as bias, round(sqrt(avg(e * e)) / (max(y) - min(y)), 6) as nrmse_range,
  round(sqrt(avg(e * e)) / stddev_pop(y), 6) as nrmse_std from e""")
def numeric_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    out = numeric_quality(df, F.col("l_extendedprice"), F.col("l_quantity") * 1000 + F.col("l_tax"))
    return rounded(out, {"rmse": 2, "mae": 2, "r2": 6, "mape": 4, "smape": 4, "median_ae": 2, "bias": 2, "nrmse_range": 6, "nrmse_std": 6})


@query("""with d as (select o_orderstatus as t, case when o_orderkey % 3 = 0 then o_orderstatus when o_orderkey % 3 = 1 then 'O' else 'F' end as p from orders),
  k as (select k, (select count(*) from d where t = k) as a, (select count(*) from d where p = k) as b, (select count(*) from d where t = k and p = k) as h
    from (select distinct t as k from d union select distinct p from d)),
  s as (select sum(a)::double as n, sum(h)::double as c, sum(a * b)::double as ab, sum(a * a)::double as aa, sum(b * b)::double as bb,
    avg(h / a) as balanced_accuracy, avg(coalesce(h / nullif(b, 0), 0)) as precision_macro, avg(coalesce(h / a, 0)) as recall_macro, avg(2 * h / (a + b)) as f1_macro from k)
  select round(c / n, 6) as accuracy, round(balanced_accuracy, 6) as balanced_accuracy, round(precision_macro, 6) as precision_macro,
    round(recall_macro, 6) as recall_macro, round(f1_macro, 6) as f1_macro,
    round((c * n - ab) / (sqrt(n * n - aa) * sqrt(n * n - bb)), 6) as mcc, round((c / n - ab / (n * n)) / (1 - ab / (n * n)), 6) as kappa from s""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    third = F.col("o_orderkey") % 3
    out = classification_quality(df, F.col("o_orderstatus"), F.when(third == 0, F.col("o_orderstatus")).when(third == 1, F.lit("O")).otherwise(F.lit("F")))
    return rounded(out, {c: 6 for c in out.columns})


@query(f"""with d as ({ORDERS_GAPS}) select 'o_orderstatus' as "column", count(*) filter (o_orderstatus is null) as masked, 0::bigint as filled, 0.0::double as coverage from d
  union all select 'o_orderpriority', count(*) filter (o_orderpriority is null), count(*) filter (o_orderpriority is null), 1.0 from d""")
def imputation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders_gaps(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    marked = df.withColumns({"m1": F.col("o_orderstatus").isNull(), "m2": F.col("o_orderpriority").isNull()})
    beside_ = ["o_orderkey", "m1", "m2"]
    out = TableImputer().fit_table(marked, cols=["o_orderpriority"], beside=beside_).apply_beside(marked)
    return coverage(out, {"o_orderstatus": F.col("m1"), "o_orderpriority": F.col("m2")}, {c: F.col(c) for c in ("o_orderstatus", "o_orderpriority")})


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
